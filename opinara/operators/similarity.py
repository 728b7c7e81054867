"""Exact neighbourhood joins over vectors, and what is built on them.

Distances cannot be an equi-join key, so points are placed in cells around pivots.  A
query is compared only with the cells its reach can touch (triangle inequality), which keeps the
result exact.  Neighbouring cells form about ``GRID`` regions, and a query is sent once to each region that holds such a
cell: what is shuffled follows the number of vectors, not the number of cells.  Regions are cut into chunks of bounded size;
a task compares one chunk of points with one chunk of visitors, cell by cell as matrix products of bounded size, and returns one
row per visitor (or ``k``), never the pairs.  Equal vectors are merged before, with a weight, so copies
cost nothing however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize

CHUNK = 2048        # rows of one side in one matrix product
GRID = 12           # regions and chunks of visitors, about, unless chunks would be larger than LARGEST
LARGEST = 65_536    # rows of one side in one task
MAX_PIVOTS = 2048   # bound of what is collected and broadcast
SLACK = 1e-6        # rounding allowance of the pruning rule


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


# ---------------------------------------------------------------- distinct vectors

def distinct_vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Unit vectors without copies ``(id, v, w)`` and the map ``(key, id)`` of all rows."""
    unit = df.select(key, C.l2_normalize(vector).alias("v")).withColumn(
        "_h", F.sha2(F.to_json(F.struct("v")), 256))
    reps = materialize(
        unit.groupBy("_h").agg(F.min(key).alias("id"), F.first("v").alias("v"),
                               F.count("*").alias("w")), "vectors")
    members = unit.select(key, "_h").join(reps.select("_h", "id"), "_h").drop("_h")
    return reps.drop("_h"), members


# ---------------------------------------------------------------- cells

@dataclass
class CellIndex:
    points: DataFrame       # id, v, cell and further columns
    pivots: np.ndarray      # one row per cell
    radii: np.ndarray       # largest distance of a cell's points from its pivot
    regions: np.ndarray     # the region of each cell
    chunk: int              # rows of one side in one task


def build_index(reps: DataFrame, cells: int | None = None) -> CellIndex:
    """Place every point in the cell of its nearest pivot.

    Pivots are the points of smallest hash: a deterministic sample of at most
    ``MAX_PIVOTS`` vectors.
    """
    spark = reps.sparkSession
    if cells is None:
        cells = min(MAX_PIVOTS, max(8, math.ceil(reps.count() / CHUNK)))
    rows = reps.orderBy(F.xxhash64("id"), "id").limit(cells).select("v").collect()
    pivots = np.array([r["v"] for r in rows], dtype=np.float64)
    shared = spark.sparkContext.broadcast(pivots)
    names = reps.columns

    def place(batches):
        for pdf in batches:
            if len(pdf):
                d = distances(matrix(pdf["v"]), shared.value)
                pdf = pdf.assign(cell=d.argmin(axis=1).astype("int32"), far=d.min(axis=1))
                yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reps.schema)
    points = materialize(reps.mapInPandas(place, f"{schema}, cell int, far double"), "cells")
    radii, counts = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in points.groupBy("cell").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect():
        radii[r["cell"]], counts[r["cell"]] = r["r"], r["n"]
    chunk = min(LARGEST, max(CHUNK, math.ceil(counts.sum() / GRID)))
    return CellIndex(points.select(*names, "cell"), pivots, radii, _regions(pivots, counts, chunk), chunk)


def _regions(pivots: np.ndarray, counts: np.ndarray, chunk: int) -> np.ndarray:
    """The region of each cell: cells in order of their nearest leader, cut into stretches of about ``chunk`` points."""
    if not len(pivots):
        return np.zeros(0, np.int32)
    d = distances(pivots, pivots[:GRID])
    order = np.lexsort((d.min(axis=1), d.argmin(axis=1)))
    middle = counts[order].cumsum() - counts[order] / 2
    regions = np.empty(len(pivots), np.int32)
    regions[order] = middle // chunk
    return regions


def visits(queries: DataFrame, index: CellIndex, own: bool = False, upwards: bool = False) -> DataFrame:
    """Each query ``(id, v, reach, ...)`` once per region it may have neighbours in.

    A null reach means no bound.  With ``own`` only the query's own cell counts.  With ``upwards`` a query stays away from
    regions below its own: of two points, at least one then visits the other's region.  Both need the query's cell.
    """
    shared = queries.sparkSession.sparkContext.broadcast((index.pivots, index.radii, index.regions))

    def visit(batches):
        pivots, radii, regions = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            if own:
                yield pdf.assign(region=regions[pdf["cell"].to_numpy()])
                continue
            near = _touched(matrix(pdf["v"]), pdf["reach"], pivots, radii)
            reached = np.zeros((len(pdf), regions.max() + 1), dtype=bool)
            row, cell = np.nonzero(near)
            reached[row, regions[cell]] = True
            if upwards:
                reached &= regions[pdf["cell"].to_numpy()][:, None] <= np.arange(reached.shape[1])[None, :]
            row, region = np.nonzero(reached)
            yield pdf.iloc[row].assign(region=region.astype("int32"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInPandas(visit, f"{schema}, region int")


def _touched(v: np.ndarray, reach: pd.Series, pivots: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Which cells each vector's reach can touch."""
    bound = reach.astype("float64").fillna(np.inf).to_numpy()[:, None]
    return distances(v, pivots) - radii <= bound + SLACK


@dataclass
class Tile:
    """Points of one cell and visitors that may reach them."""

    at: slice               # points
    rows: np.ndarray        # visitors
    points: np.ndarray
    visitors: np.ndarray

    def cosines(self) -> np.ndarray:
        return self.visitors @ self.points.T


def region_join(points: DataFrame, visitors: DataFrame, index: CellIndex,
                kernel: Callable[[pd.DataFrame, pd.DataFrame, Iterator[Tile]], pd.DataFrame], schema: str,
                own: bool = False) -> DataFrame:
    """Apply ``kernel`` to every (chunk of points, chunk of visitors) of every region.

    Points carry ``id``, ``v`` and ``cell``, visitors come from `visits`.  The kernel gets both chunks, points in order of cell
    and id, and the tiles in which they are to be compared: those of cells that the visitors' reach touches, or of their own.
    """
    shared = points.sparkSession.sparkContext.broadcast((index.pivots, index.radii, index.regions))

    @F.pandas_udf("int")
    def region(cell: pd.Series) -> pd.Series:
        return pd.Series(shared.value[2][cell.to_numpy()])

    def tiles(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[Tile]:
        pivots, radii, _ = shared.value
        va, vb = matrix(a["v"]), matrix(b["v"])
        cells, starts = np.unique(a["cell"].to_numpy(), return_index=True)
        if own:
            near = b["cell"].to_numpy()[:, None] == cells[None, :]
        else:
            near = _touched(vb, b["reach"], pivots[cells], radii[cells])
        for n, (start, end) in enumerate(zip(starts, [*starts[1:], len(a)])):
            rows = np.flatnonzero(near[:, n])
            for i in range(start, end, CHUNK):
                at = slice(i, min(end, i + CHUNK))
                for j in range(0, len(rows), CHUNK):
                    some = rows[j: j + CHUNK]
                    yield Tile(at, some, va[at], vb[some])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values(["cell", "id"], ignore_index=True)
        return kernel(a, b, tiles(a, b))

    return block_join(points.withColumn("region", region("cell")), visitors, run, schema, index.chunk, "region", few=True)


def block_join(points: DataFrame, visitors: DataFrame,
               kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
               chunk: int | None = None, cell: str = "cell", few: bool = False) -> DataFrame:
    """Apply ``kernel`` to every (chunk of points, chunk of visitors) of every cell.

    Both sides carry ``id`` and ``cell``.  Chunk counts follow from the cell sizes, so a
    cell with a third of all rows becomes many groups of about ``chunk`` rows.  If there are only a `few` cells, their sizes
    are broadcast, so that rows move once.
    """
    chunk = chunk or CHUNK
    visitors = visitors.toDF(*visitors.columns)  # both sides may stem from one table
    sizes = points.groupBy(cell).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_pc")).join(
        visitors.groupBy(cell).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_vc")), cell)
    if few:
        sizes = sizes.hint("broadcast")
    slot = F.xxhash64("id")
    left = points.join(sizes, cell).withColumns({
        "_p": F.pmod(slot, F.col("_pc")).cast("int"),
        "_v": F.explode(F.sequence(F.lit(0), F.col("_vc") - 1)),
    }).drop("_pc", "_vc")
    right = visitors.join(sizes, cell).withColumns({
        "_v": F.pmod(slot, F.col("_vc")).cast("int"),
        "_p": F.explode(F.sequence(F.lit(0), F.col("_pc") - 1)),
    }).drop("_pc", "_vc")
    keys = [cell, "_p", "_v"]
    columns = [part.strip().split()[0] for part in schema.split(",")]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=columns)
        return kernel(a, b)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


# ---------------------------------------------------------------- nearest neighbours

def _nearest(points: pd.DataFrame, visitors: pd.DataFrame, tiles: Iterator[Tile], k: int) -> pd.DataFrame:
    """The nearest points of each visitor, ties by id: one running list per visitor."""
    ids, own = points["id"].to_numpy(), visitors["id"].to_numpy()
    reach = visitors["reach"].astype("float64").fillna(np.inf).to_numpy() + SLACK
    dist, at = np.full((len(own), k), np.inf), np.full((len(own), k), -1)
    for tile in tiles:
        cos, rows = tile.cosines(), tile.rows
        bound = np.minimum(reach[rows], dist[rows, -1] + SLACK)
        loose = np.isinf(bound)
        if loose.any():     # nothing bounds these yet: the k + 1 nearest of the tile, one of which may be the point itself
            place = min(k, cos.shape[1] - 1)
            least = -np.partition(-cos[loose], place, axis=1)[:, place]
            bound[loose] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * least)) + SLACK
        r, c = np.nonzero(cos >= (1.0 - bound * bound / 2.0)[:, None])
        c_at = c + tile.at.start
        other = own[rows[r]] != ids[c_at]
        r, c, c_at = r[other], c[other], c_at[other]
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos[r, c])).round(9)
        held = np.unique(r)     # rows whose lists may change
        old = np.repeat(held, k)
        row = np.concatenate([old, r])
        d = np.concatenate([dist[rows[held]].ravel(), d])
        p = np.concatenate([at[rows[held]].ravel(), c_at])
        order = np.lexsort((np.where(p < 0, np.iinfo(np.int64).max, ids[p]), d, row))
        row, d, p = row[order], d[order], p[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
        pick = starts[:, None] + np.arange(k)[None, :]
        dist[rows[held]], at[rows[held]] = d[pick], p[pick]
    keep = np.isfinite(dist)
    return pd.DataFrame({"id": np.repeat(own, keep.sum(axis=1)), "nbr": ids[at[keep]], "dist": dist[keep],
                         "w": points["w"].to_numpy()[at[keep]]})


def neighbours(reps: DataFrame, k: int = 10, cells: int | None = None) -> DataFrame:
    """The ``k`` nearest other vectors ``(id, nbr, dist, w, rank)`` of every vector, exactly.

    A first round inside the own cell gives each vector an upper bound of its k-th
    distance; the second round visits the regions within that bound.
    """
    index = build_index(reps, cells)
    schema = "id bigint, nbr bigint, dist double, w bigint"

    def kernel(a, b, tiles):
        return _nearest(a, b, tiles, k)

    def best(found):
        w = Window.partitionBy("id").orderBy("dist", "nbr")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    points = index.points.select("id", "v", "w", "cell")
    inside = visits(points.select("id", "v", "cell", F.lit(None).cast("double").alias("reach")), index, own=True)
    local = best(region_join(points, inside, index, kernel, schema, own=True))
    bound = materialize(local.where(F.col("rank") == k).select("id", F.col("dist").alias("reach")), "bounds")
    queries = points.select("id", "v").join(bound, "id", "left")
    return best(region_join(points, visits(queries, index), index, kernel, schema))


def density_outliers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10,
                     cells: int | None = None) -> DataFrame:
    """Distance to the k-th neighbour and its ratio to the neighbours' own distances.

    A ratio well above one marks a point in a thinner region than its neighbours.  Copies
    of a vector count as neighbours at distance zero.
    """
    reps, members = distinct_vectors(df, key, vector)
    near = neighbours(reps, k, cells).select("id", "nbr", "dist", "w")
    copies = reps.where("w > 1").select("id", F.col("id").alias("nbr"), F.lit(0.0).alias("dist"),
                                        (F.col("w") - 1).alias("w"))
    order = Window.partitionBy("id").orderBy("dist", "nbr")
    upto = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    used = near.unionByName(copies).withColumn("_to", upto).withColumn(
        "take", F.least(F.col("w"), F.lit(k) - (F.col("_to") - F.col("w")))).where("take > 0")
    used = materialize(used, "neighbours")
    core = used.groupBy("id").agg(F.max("dist").alias("core_distance"))
    around = (used.join(core.select(F.col("id").alias("nbr"), F.col("core_distance").alias("_c")), "nbr")
              .groupBy("id").agg((F.sum(F.col("_c") * F.col("take")) / F.sum("take")).alias("_m")))
    out = core.join(around, "id").withColumn("density_ratio",
                                             F.try_divide(F.col("core_distance"), F.col("_m")))
    return members.join(out, "id", "left").select(key, "core_distance", "density_ratio")


# ---------------------------------------------------------------- density clusters

def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of an undirected edge list ``(a, b)``; the root is the smallest id.

    Every round hooks each vertex to its smallest neighbour and contracts the edges, so
    the number of live vertices at least halves.  Rounds are cut by written tables.
    """
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
                         .withColumn("root", F.col("id")), "labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("p"))
        hop = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = materialize(up.join(hop, "p").select("a", F.col("pp").alias("p")), "parents")
        pa = parent.select("a", F.col("p").alias("x"))
        pb = parent.select(F.col("a").alias("b"), F.col("p").alias("y"))
        edges = materialize(edges.join(pa, "a").join(pb, "b").where("x <> y")
                            .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        labels = materialize(
            labels.join(parent.withColumnRenamed("a", "root"), "root", "left")
            .select("id", F.coalesce("p", "root").alias("root")), "labels")
    return labels


def _within(cos: np.ndarray, eps: float) -> np.ndarray:
    """Whether the cosine distance, rounded to nine digits, is at most ``eps``; only close calls are rounded."""
    near = cos >= 1.0 - eps - 1e-8
    r, c = np.nonzero(near & (cos <= 1.0 - eps + 1e-8))
    near[r, c] = (1.0 - cos[r, c]).round(9) <= eps
    return near


def _joined(near: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest label that each row and column is connected to."""
    top = np.iinfo(np.int64).max
    while True:
        new_rows = np.minimum(rows, np.where(near, columns[None, :], top).min(axis=1))
        new_columns = np.minimum(columns, np.where(near, new_rows[:, None], top).min(axis=0))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def _forest(a: pd.DataFrame, b: pd.DataFrame, tiles: Iterator[Tile], eps: float) -> pd.DataFrame:
    """Star edges that join what the chunk pair connects: one row per vertex at most.

    Vectors that are connected already are not compared again.
    """
    ids, place = np.unique(np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()]), return_inverse=True)
    in_a, in_b = place[:len(a)], place[len(a):]
    label = np.arange(len(ids))     # the smallest place of the part

    def connect(at: np.ndarray, rows: np.ndarray, points: np.ndarray, visitors: np.ndarray) -> None:
        nonlocal label
        if not len(at) or not len(rows):
            return
        near = _within(visitors @ points.T, eps)
        some_rows, some_at = near.any(axis=1), near.any(axis=0)
        if not some_rows.any():
            return
        near, rows, at = near[some_rows][:, some_at], rows[some_rows], at[some_at]
        old = np.concatenate([label[rows], label[at]])
        new = np.concatenate(_joined(near, label[rows], label[at]))
        parent = {}

        def find(i: int) -> int:
            while i in parent:
                i = parent[i]
            return i

        changed = old != new
        for x, y in set(zip(old[changed].tolist(), new[changed].tolist())):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if parent:
            to = np.arange(len(label))
            for x in parent:
                to[x] = find(x)
            label = to[label]

    for tile in tiles:
        at, rows = in_a[tile.at], in_b[tile.rows]
        found, n = np.unique(np.concatenate([label[at], label[rows]]), return_counts=True)
        if len(found) == 1:
            continue
        common = found[n.argmax()]
        outside = label[rows] != common
        connect(at, rows[outside], tile.points, tile.visitors[outside])
        apart = label[at] != common
        connect(at[apart], rows[~outside], tile.points[apart], tile.visitors[~outside])
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})


def dbscan(df: DataFrame, key: str = "vec_id", vector: str = "embedding", eps: float = 0.5,
           min_points: int = 5, cells: int | None = None) -> DataFrame:
    """Density clusters under cosine distance.

    A cluster is named by its smallest core id; a border point joins the smallest-named
    cluster in reach; noise is -1.
    """
    reps, members = distinct_vectors(df, key, vector)
    index = build_index(reps, cells)
    points, regions = index.points.select("id", "v", "w", "cell"), index.regions
    reach = F.lit(math.sqrt(2.0 * eps)).alias("reach")

    def count(a, b, tiles):
        """Neighbours of visitors, and of points whose region is above the visitor's: those do not visit it."""
        wa, wb = a["w"].to_numpy(dtype=float), b["w"].to_numpy(dtype=float)
        wb = np.where(regions[b["cell"].to_numpy()] == regions[a["cell"].to_numpy()[0]], 0.0, wb)
        na, nb = np.zeros(len(a)), np.zeros(len(b))
        for t in tiles:
            near = _within(t.cosines(), eps).astype(float)
            nb[t.rows] += near @ wa[t.at]
            na[t.at] += wb[t.rows] @ near
        out = pd.DataFrame({"id": np.concatenate([a["id"], b["id"]]), "n": np.concatenate([na, nb]).astype("int64")})
        return out[out["n"] > 0]

    everyone = visits(points.select("id", "v", "w", "cell", reach), index, upwards=True)
    counts = region_join(points, everyone, index, count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    core = materialize(counts.where(F.col("n") >= min_points).select("id"), "core")
    core_points = materialize(points.join(core, "id", "left_semi"), "core_points")

    def forest(a, b, tiles):
        return _forest(a, b, tiles, eps)

    core_visits = visits(core_points.select("id", "v", "cell", reach), index, upwards=True)
    linked = connected_components(region_join(core_points, core_visits, index, forest, "a bigint, b bigint"))
    roots = materialize(core.join(linked, "id", "left")
                        .select("id", F.coalesce("root", "id").alias("root")), "roots")

    def border(a, b, tiles):
        top = np.iinfo(np.int64).max
        root, best = a["root"].to_numpy(), np.full(len(b), top)
        for t in tiles:
            rows = best[t.rows] > root[t.at].min()      # others have a smaller one already
            if rows.any():
                near = _within(t.visitors[rows] @ t.points.T, eps)
                found = np.where(near, root[t.at][None, :], top).min(axis=1)
                best[t.rows[rows]] = np.minimum(best[t.rows[rows]], found)
        hit = best < top
        return pd.DataFrame({"id": b["id"].to_numpy()[hit], "root": best[hit]})

    rest = materialize(points.join(core, "id", "left_anti").select("id", "v", reach), "rest")
    rooted = materialize(core_points.join(roots, "id"), "rooted")
    edge = region_join(rooted, visits(rest, index), index, border, "id bigint, root bigint").groupBy(
        "id").agg(F.min("root").alias("root"))
    return (members.join(roots.unionByName(edge), "id", "left")
            .select(key, F.coalesce("root", F.lit(-1)).alias("cluster")))
