"""Clusters of varying density: the hierarchy of mutual reachability distances.

The mutual reachability distance of two vectors is the largest of their distance and of their core distances, a core distance
being the one to the k-th other vector. Its minimum spanning tree grows in rounds: each component, but for the largest,
finds its smallest edge to another one. Neighbour lists and the pivots of the cells bound that edge, so a vector only visits
cells within the bound, and one whose core distance lies above it none. Edges are totally ordered, so a round
at least halves the components.

The tree's edges, in order of weight, merge components into a hierarchy. Seen from the top, a cluster of at least
`min_size` vectors splits where two or more parts of that size come apart; smaller parts fall out of it. All edges of one
weight act at once, so the result does not depend on the order of ties. Each component is a row of a few numbers (a small
one also lists its members, fewer than `min_size`), so edges are taken in slices: as many of the lightest as leave no
connected part with more than `slice_edges` edges. The parts of a slice are merged each in a task of its own, and
the next slice starts from their rows.

The stability of a cluster is the sum over its vectors of the density (one by distance) at which they leave it less the density at which it
appears. A cluster is chosen if it is at least as stable as the best choice below it; the whole is never chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import similarity as S

SLICE_EDGES = 200_000   # edges that one task merges, unless they share one weight
LEAST = 1e-9            # distances count as at least this much


# ---------------------------------------------------------------- spanning tree

def core_distances(reps: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """``(id, core)``: distance to the k-th other vector, copies counted; the farthest if there are fewer."""
    copies = reps.where("w > 1").select("id", F.col("id").alias("nbr"), F.lit(0.0).alias("dist"), (F.col("w") - 1).alias("w"))
    before = F.sum("w").over(Window.partitionBy("id").orderBy("dist", "nbr").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("w")
    found = near.select("id", "nbr", "dist", "w").unionByName(copies).withColumn("_before", before)
    core = found.where(F.col("_before") < k).groupBy("id").agg(F.max("dist").alias("core"))
    return reps.select("id").join(core, "id", "left").na.fill(0.0, ["core"])


def _least(pdf: pd.DataFrame) -> pd.DataFrame:
    """The smallest edge of each component."""
    return pdf.sort_values(["dist", "lo", "hi"], kind="stable").drop_duplicates("comp")


_EDGE = "comp bigint, dist double, lo bigint, hi bigint, other bigint"


def _edges(own: pd.DataFrame, ids, comps, cores, vectors) -> pd.DataFrame:
    """The smallest edge of each component of `own` to the given points, which are in order of id."""
    d = S.distances(S.matrix(own["v"]), vectors).round(9)
    d = np.maximum(np.maximum(d, own["core"].to_numpy()[:, None]), cores[None, :])
    d[own["comp"].to_numpy()[:, None] == comps[None, :]] = np.inf
    at = d.argmin(axis=1)
    best = d[np.arange(len(own)), at]
    a, b = own["id"].to_numpy(), ids[at]
    out = pd.DataFrame({"comp": own["comp"].to_numpy(), "dist": best, "lo": np.minimum(a, b), "hi": np.maximum(a, b),
                        "other": comps[at]})
    return _least(out[np.isfinite(best)])


def _kernel(points: pd.DataFrame, visitors: pd.DataFrame, tiles: Iterator[S.Tile]) -> pd.DataFrame:
    """The smallest edge of each component of the visitors that is no longer than its reach."""
    ids, comps, cores = (points[c].to_numpy() for c in ("id", "comp", "core"))
    own, own_comp, own_core = (visitors[c].to_numpy() for c in ("id", "comp", "core"))
    kinds, kind = np.unique(own_comp, return_inverse=True)
    reach = np.full(len(kinds), -np.inf)
    np.maximum.at(reach, kind, visitors["reach"].astype("float64").fillna(np.inf).to_numpy() + S.SLACK)
    found = []
    for tile in tiles:
        rows = tile.rows[own_core[tile.rows] <= reach[kind[tile.rows]]]
        if not len(rows):
            continue
        cos = (tile.visitors if len(rows) == len(tile.rows) else tile.visitors[np.isin(tile.rows, rows)]) @ tile.points.T
        bound = reach[kind[rows]]
        near = cos >= (1.0 - bound * bound / 2.0)[:, None]
        near &= own_comp[rows][:, None] != comps[tile.at][None, :]
        near &= cores[tile.at][None, :] <= bound[:, None]
        r, c = np.nonzero(near)
        if not len(r):
            continue
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos[r, c])).round(9)
        a, at = rows[r], c + tile.at.start
        d = np.maximum(np.maximum(d, own_core[a]), cores[at])
        np.minimum.at(reach, kind[a], d + S.SLACK)
        some = d <= reach[kind[a]]
        a, at, d = a[some], at[some], d[some]
        found.append(_least(pd.DataFrame({
            "comp": own_comp[a], "dist": d, "lo": np.minimum(own[a], ids[at]), "hi": np.maximum(own[a], ids[at]), "other": comps[at]})))
    columns = ["comp", "dist", "lo", "hi", "other"]
    return _least(pd.concat(found)) if found else pd.DataFrame(columns=columns)


def _smallest(edges: DataFrame) -> DataFrame:
    best = F.min(F.struct("dist", "lo", "hi", "other")).alias("e")
    return edges.groupBy("comp").agg(best).select("comp", "e.*")


def spanning_tree(reps: DataFrame, k: int = 10, cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors ``(id, w, core)`` and the edges ``(a, b, dist)`` of the minimum spanning tree.

    `reps` holds different unit vectors ``(id, v, w)``.
    """
    spark = reps.sparkSession
    near = materialize(S.neighbours(reps, k, cells), "near")
    core = materialize(core_distances(reps, near, k), "core")
    index = S.build_index(reps, cells)
    points = materialize(index.points.join(core, "id"), "points")
    anchors = points.orderBy(F.xxhash64("id"), "id").limit(len(index.pivots)).select("id", "v", "core")
    anchors = sorted(anchors.collect(), key=lambda r: r["id"])
    ids, cores = np.array([r["id"] for r in anchors], np.int64), np.array([r["core"] for r in anchors], float)
    vectors = np.array([r["v"] for r in anchors], float)

    both = near.select("id", "nbr", "dist").join(core, "id").join(
        core.select(F.col("id").alias("nbr"), F.col("core").alias("_c")), "nbr")
    listed = materialize(both.select(
        F.col("id").alias("comp"), F.col("nbr").alias("other"), F.greatest("dist", "core", "_c").alias("dist"),
        F.least("id", "nbr").alias("lo"), F.greatest("id", "nbr").alias("hi")), "listed")
    labels = materialize(reps.select("id", F.col("id").alias("comp"), "w"), "labels")
    tree = None
    while True:
        sizes = materialize(labels.groupBy("comp").agg(F.sum("w").alias("n")), "sizes")
        largest = sizes.orderBy(F.desc("n"), "comp").select("comp").limit(2).collect()
        if len(largest) < 2:
            break
        rest = materialize(points.join(labels.select("id", "comp"), "id"), "rest")
        moving = rest.where(F.col("comp") != largest[0]["comp"])
        home = {r["id"]: r["comp"] for r in labels.where(F.col("id").isin(ids.tolist())).select("id", "comp").collect()}
        shared = spark.sparkContext.broadcast((ids, np.array([home[i] for i in ids.tolist()], np.int64), cores, vectors))

        def to_anchors(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield _edges(pdf, *shared.value)

        known = listed.where(F.col("comp") != largest[0]["comp"]).select("comp", "dist", "lo", "hi", "other")
        known = materialize(_smallest(known.unionByName(
            moving.select("id", "v", "comp", "core").mapInPandas(to_anchors, _EDGE))), "known")
        bound = known.select("comp", F.col("dist").alias("reach"))
        queries = moving.drop("cell").join(bound, "comp", "left").where("reach is null or core <= reach").select(
            "id", "v", "reach", "comp", "core")
        found = S.region_join(rest.select("id", "v", "cell", "comp", "core"), S.visits(queries, index), index, _kernel, _EDGE)
        chosen = materialize(_smallest(found.unionByName(known)), "chosen")
        edges = chosen.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "dist").distinct()
        tree = edges if tree is None else tree.unionByName(edges)
        roots = S.connected_components(chosen.select(F.col("comp").alias("a"), F.col("other").alias("b")))
        roots = materialize(roots, "roots")
        labels = materialize(_renamed(labels, roots, "comp"), "labels")
        listed = materialize(_renamed(_renamed(listed, roots, "comp"), roots, "other").where("comp <> other"), "listed")
    vertices = reps.select("id", "w").join(core, "id")
    empty = spark.createDataFrame([], "a bigint, b bigint, dist double")
    return vertices, materialize(empty if tree is None else tree, "tree")


def _renamed(df: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    to = roots.select(F.col("id").alias(column), F.col("root").alias("_root"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


# ---------------------------------------------------------------- hierarchy

_ROW = ("kind int, id bigint, cid string, parent string, chosen boolean, lam double, stability double, points bigint, "
        "fall double, best double, top double, members array<struct<id: bigint, w: bigint>>")
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")[:11]] + ["members"]
PART, POINT, CLUSTER = range(3)     # kinds of rows: a component, a vector that left a cluster, a cluster that ended


class _Part:
    """A component: small with its members, or a cluster that goes on."""

    __slots__ = ("best", "cid", "fall", "id", "members", "points", "top")

    def __init__(self, id, members=(), points=0, cid=None, fall=0.0, best=0.0, top=0.0):
        self.id, self.members, self.points, self.cid = id, members, points, cid
        self.fall, self.best, self.top = fall, best, top


def _joined(parts: list[_Part], lam: float, min_size: int, rows: list[tuple]) -> _Part:
    """What the parts become when they meet at this density; rows get what left a cluster there."""
    clusters = [p for p in parts if p.cid is not None]
    small = [m for p in parts if p.cid is None for m in p.members]
    low, points = min(p.id for p in parts), sum(p.points for p in parts)
    loose = sum(w for _, w in small)
    if not clusters and points < min_size:
        return _Part(low, tuple(small), points)
    if len(clusters) == 1:
        out = clusters[0]
        out.id, out.points, out.fall = low, points, out.fall + loose * lam
    else:
        out = _Part(low, (), points, f"{low}/{points}", points * lam, top=max([lam, *(c.top for c in clusters)]))
        for c in clusters:
            stability = c.fall - c.points * lam
            chosen = stability >= c.best
            out.best += max(stability, c.best)
            rows.append((CLUSTER, c.id, c.cid, out.cid, chosen, lam, stability, c.points, c.fall, c.best, c.top, None))
    rows += [(POINT, i, out.cid, None, None, lam, None, w, None, None, None, None) for i, w in small]
    return out


def merge_edges(edges: list[tuple[int, int, float]], parts: dict[int, _Part], min_size: int) -> tuple[list[tuple], list[_Part]]:
    """Merge components by edges between them, all edges of one weight at once: (rows, components)."""
    parent = {i: i for i in parts}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows: list[tuple] = []
    parts = dict(parts)
    for dist, tied in groupby(sorted(edges, key=lambda e: e[2]), key=lambda e: e[2]):
        ends = [(find(a), find(b)) for a, b, _ in tied]
        for a, b in ends:
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        groups: dict[int, list[int]] = {}
        for i in sorted({i for pair in ends for i in pair}):
            groups.setdefault(find(i), []).append(i)
        for root, old in groups.items():
            parts[root] = _joined([parts.pop(i) for i in old], 1.0 / max(dist, LEAST), min_size, rows)
    return rows, list(parts.values())


def _merged(min_size: int):
    def run(edges: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        parts = {}
        for r in states.itertuples(index=False):
            cid = r.cid if isinstance(r.cid, str) else None
            members = () if cid is not None else tuple((int(m["id"]), int(m["w"])) for m in r.members)
            parts[int(r.id)] = _Part(int(r.id), members, int(r.points), cid, r.fall, r.best, r.top)
        rows, left = merge_edges(list(zip(edges["a"].tolist(), edges["b"].tolist(), edges["dist"].tolist())), parts, min_size)
        for p in left:
            members = [{"id": i, "w": w} for i, w in p.members]
            rows.append((PART, p.id, p.cid, None, None, None, None, p.points, p.fall, p.best, p.top, members))
        return pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _slice(edges: DataFrame, slice_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """The lightest edges with the connected part each belongs to, and the rest."""
    n = edges.count()
    if n <= slice_edges:
        return edges.withColumn("part", F.lit(0).cast("bigint")), None
    share, lightest = 0.5, edges.agg(F.min("dist")).first()[0]
    while True:
        limit = edges.agg(F.percentile_approx("dist", share, 10_000)).first()[0] if share > 1.0 / n else lightest
        light = edges.where(F.col("dist") <= limit)
        roots = materialize(S.connected_components(light.select("a", "b")), "roots")
        own = light.join(roots.select(F.col("id").alias("a"), F.col("root").alias("part")), "a", "left")
        own = materialize(own.withColumn("part", F.coalesce("part", "a")), "slice")
        if limit <= lightest or own.groupBy("part").count().agg(F.max("count")).first()[0] <= slice_edges:
            rest = materialize(edges.where(F.col("dist") > limit), "edges")
            return own.select("a", "b", "dist", "part"), rest
        share /= 2


def hierarchy(vertices: DataFrame, tree: DataFrame, min_size: int = 10,
              slice_edges: int = SLICE_EDGES) -> tuple[DataFrame, DataFrame]:
    """Clusters ``(cid, parent, chosen, lam, stability, points, top)`` and where vectors left them ``(id, cid, lam)``.

    The root has no parent and is not chosen; `lam` is the density at which a cluster appears or a vector leaves.
    """
    if min_size < 2:
        raise ValueError("a cluster has at least two members")
    zero = F.lit(0.0)
    states = vertices.select(
        F.lit(PART).alias("kind"), "id", F.lit(None).cast("string").alias("cid"), F.col("w").alias("points"), zero.alias("fall"),
        zero.alias("best"), zero.alias("top"), F.array(F.struct("id", "w")).alias("members"))
    # copies of a vector meet at its core distance
    own = vertices.where(F.col("w") >= min_size).select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("core").alias("dist"))
    rest = materialize(tree.select("a", "b", "dist").unionByName(own), "edges")
    left, done = None, None
    while rest is not None and not rest.isEmpty():
        edges, rest = _slice(rest, slice_edges)
        ends = materialize(edges.select(F.explode(F.array("a", "b")).alias("id"), "part").distinct(), "ends")
        touched = states.join(ends, "id")
        rows = edges.groupBy("part").cogroup(touched.groupBy("part")).applyInPandas(_merged(min_size), _ROW)
        rows = materialize(rows, "rows")
        events = rows.where(F.col("kind") != PART)
        done = events if done is None else done.unionByName(events)
        merged = rows.where(F.col("kind") == PART).select(*states.columns)
        states = materialize(merged.unionByName(states.join(ends, "id", "left_anti").select(*states.columns)), "states")
        if rest is not None:    # the part's smallest id names what it has become
            to = ends.groupBy("part").agg(F.min("id").alias("root")).join(ends, "part").select("id", "root")
            rest = materialize(_renamed(_renamed(rest, to, "a"), to, "b"), "edges")
    roots = states.where("cid is not null").select(
        "cid", F.lit(None).cast("string").alias("parent"), F.lit(False).alias("chosen"), F.lit(0.0).alias("lam"),
        F.col("fall").alias("stability"), "points", "top")
    if done is None:
        return roots, vertices.limit(0).select("id", F.lit("").alias("cid"), F.lit(0.0).alias("lam"))
    clusters = done.where(F.col("kind") == CLUSTER).select("cid", "parent", "chosen", "lam", "stability", "points", "top")
    return roots.unionByName(clusters), done.where(F.col("kind") == POINT).select("id", "cid", "lam")


def _highest_chosen(clusters: DataFrame) -> DataFrame:
    """``(cid, pick)``: the highest chosen cluster from each cluster upwards, by doubling steps."""
    steps = materialize(clusters.select("cid", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("cid")).alias("pick")),
                        "steps")
    while not steps.where("up is not null").isEmpty():
        over = steps.select(F.col("cid").alias("up"), F.col("up").alias("_up"), F.col("pick").alias("_pick"))
        steps = materialize(steps.join(over, "up", "left").select(
            "cid", F.col("_up").alias("up"), F.coalesce("_pick", "pick").alias("pick")), "steps")
    return steps.select("cid", "pick")


def density_clusters(df: DataFrame, key: str = "vec_id", vector: str = "embedding", min_size: int = 10, k: int | None = None,
                     cells: int | None = None, slice_edges: int = SLICE_EDGES) -> DataFrame:
    """``(key, cluster, leaves_at, outlier_score)`` of every row.

    `k` is the neighbour that gives the core distance, by default `min_size`. A cluster is named by its smallest key; -1 is
    noise. `leaves_at` is the density at which a row leaves the hierarchy, the score how far that is below the largest density
    beneath the cluster it left: 0 for the densest rows. Copies share everything; tables of fewer than
    `min_size` rows are noise without a score.
    """
    reps, members = S.distinct_vectors(df, key, vector)
    vertices, tree = spanning_tree(reps, k or min_size, cells)
    clusters, left = hierarchy(vertices, tree, min_size, slice_edges)
    clusters = materialize(clusters, "clusters")
    at = left.join(clusters.select("cid", "top").join(_highest_chosen(clusters), "cid"), "cid").select(
        "id", "pick", "lam", (1 - F.col("lam") / F.col("top")).alias("score"))
    rows = materialize(members.join(at, "id", "left"), "rows")
    names = rows.where("pick is not null").groupBy("pick").agg(F.min(key).alias("cluster"))
    return rows.join(names, "pick", "left").select(
        key, F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.col("lam").alias("leaves_at"), F.col("score").alias("outlier_score"))
