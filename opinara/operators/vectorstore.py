"""A persisted vector table whose cells are folders, so that a question reads only the cells that may hold an answer.

Each vector lies in the folder of its nearest pivot. A small table keeps pivots, radii and row counts per addition. A
search first reads the nearest cells that together hold `k` vectors; the k-th distance found there bounds the second read by the
triangle inequality. Both reads are partition filters on the table, and results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize
from . import similarity as S
from .retrieval import SCHEMA, _best, _rank

VECTORS_PER_CELL = 2048
CELLS = 2048            # at most; the table of pivots stays small


def _encoded(df: DataFrame, text: str, vector: str, encode: Callable[[DataFrame, str, str], DataFrame] | None) -> DataFrame:
    """Scrubbed preview and unit vector of every row."""
    if encode is None:
        return df.withColumn("v", C.l2_normalize(vector))
    safe = materialize(df.withColumn(text, C.scrub_pii(text)), "scrubbed")   # read twice
    return safe.join(encode(safe, "review_id", text).select("review_id", C.l2_normalize("embedding").alias("v")), "review_id")


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("struct<cell: int, far: double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        d = S.distances(S.matrix(v), shared.value)
        return pd.DataFrame({"cell": d.argmin(axis=1).astype("int32"), "far": d.min(axis=1)})

    return rows.withColumn("_n", nearest("v")).select("*", "_n.cell", "_n.far").drop("_n")


def _stored(df: DataFrame, path: str, pivots: np.ndarray, text: str, vector: str, encode, preview: int,
            scrubbed: bool) -> None:
    own = [c for c in ("parent_asin", "date") if c in df.columns]
    shown = F.substring(text if scrubbed else C.scrub_pii(text), 1, preview) if text in df.columns else F.lit(None).cast("string")
    rows = _placed(_encoded(df, text, vector, encode), pivots).select(
        F.col("review_id").cast("string").alias("review_id"), *own, shown.alias("text_preview"), "v", "cell", "far")
    rows = materialize(rows, "placed")
    rows.drop("far").repartition("cell").write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")
    rows.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).write.mode("append").parquet(f"{path}/cells")


def build_index(df: DataFrame, path: str, text: str = "text", vector: str = "embedding",
                encode: Callable[[DataFrame, str, str], DataFrame] | None = None, cells: int | None = None,
                preview: int = 300) -> None:
    """Scrub, encode, normalise and write all rows; `encode(df, key, text)` gives vectors, else they are in `vector`.

    Pivots are the vectors of smallest hash. Rows need `review_id`; `parent_asin`, `date` and a text preview are kept.
    """
    spark = df.sparkSession
    rows = materialize(_encoded(df, text, vector, encode).withColumnRenamed("v", "_unit"), "encoded")
    if cells is None:
        cells = min(CELLS, max(8, -(-rows.count() // VECTORS_PER_CELL)))
    chosen = rows.orderBy(F.xxhash64("review_id"), "review_id").limit(cells).select(F.col("_unit").alias("v")).collect()
    if not chosen:
        raise ValueError("an index needs at least one row")
    spark.createDataFrame([(i, r["v"]) for i, r in enumerate(chosen)], "cell int, pivot array<double>").write.parquet(
        f"{path}/pivots")
    _stored(rows, path, np.array([r["v"] for r in chosen], float), text, "_unit", None, preview, encode is not None)


def _pivots(spark: SparkSession, path: str) -> np.ndarray:
    rows = sorted(spark.read.parquet(f"{path}/pivots").collect(), key=lambda r: r["cell"])
    return np.array([r["pivot"] for r in rows], float)


def add_rows(df: DataFrame, path: str, text: str = "text", vector: str = "embedding",
             encode: Callable[[DataFrame, str, str], DataFrame] | None = None, preview: int = 300) -> None:
    """Add rows, a month say, to the cells that are there; radii and counts follow."""
    _stored(df, path, _pivots(df.sparkSession, path), text, vector, encode, preview, encode is not None)


def _cells(spark: SparkSession, path: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    radii, counts = np.full(n, -np.inf), np.zeros(n, np.int64)
    for r in spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.max("radius").alias("r"), F.sum("n").alias("n")).collect():
        radii[r["cell"]], counts[r["cell"]] = r["r"], r["n"]
    return radii, counts


def read_cells(spark: SparkSession, path: str, cells: list[int]) -> DataFrame:
    """The vectors of some cells; other folders are not opened."""
    return spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin(cells))


def _scored(spark: SparkSession, path: str, visits: DataFrame, k: int) -> DataFrame:
    visits = materialize(visits, "visits")
    cells = [r["cell"] for r in visits.select("cell").distinct().collect()]

    def block(points: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        best, ids = _best((S.matrix(visitors["v"]) @ S.matrix(points["v"]).T).round(9), points["id"].to_numpy(dtype=str), k)
        return pd.DataFrame({"question_id": np.repeat(visitors["id"].to_numpy(), best.shape[1]), "review_id": ids.ravel(),
                             "score": best.ravel()})

    points = read_cells(spark, path, cells).select(F.col("review_id").alias("id"), "v", "cell")
    return _rank(S.block_join(points, visits.select("id", "v", "cell"), block, SCHEMA), k)


def search(spark: SparkSession, path: str, questions: DataFrame, k: int = 8, vector: str = "embedding") -> DataFrame:
    """Exact cosine top-k ``(question_id, review_id, score, rank)`` of every question."""
    pivots = _pivots(spark, path)
    radii, counts = _cells(spark, path, len(pivots))
    shared = spark.sparkContext.broadcast((pivots, radii, counts))
    q = materialize(questions.select(F.col("question_id").alias("id"), C.l2_normalize(vector).alias("v")), "questions")

    def first(batches):
        pivots, _, counts = shared.value
        for pdf in batches:
            if len(pdf):
                order = S.distances(S.matrix(pdf["v"]), pivots).argsort(axis=1, kind="stable")
                held = counts[order].cumsum(axis=1)
                need = (np.hstack([np.zeros((len(pdf), 1), np.int64), held[:, :-1]]) < k) & (counts[order] > 0)
                row, at = np.nonzero(need)
                yield pdf.iloc[row].assign(cell=order[row, at].astype("int32"))

    def second(batches):
        pivots, radii, _ = shared.value
        for pdf in batches:
            if len(pdf):
                near = S.distances(S.matrix(pdf["v"]), pivots) - radii
                row, cell = np.nonzero(near <= pdf["reach"].to_numpy()[:, None] + S.SLACK)
                yield pdf.iloc[row].assign(cell=cell.astype("int32"))

    found = _scored(spark, path, q.mapInPandas(first, "id bigint, v array<double>, cell int"), k)
    # distance of unit vectors from their cosine; fewer than k found means all there are
    reach = found.groupBy(F.col("question_id").alias("id")).agg(
        F.when(F.count("*") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score")))).otherwise(F.lit(2.0)).alias("reach"))
    within = q.join(reach, "id").mapInPandas(second, "id bigint, v array<double>, reach double, cell int")
    return _scored(spark, path, within.drop("reach"), k)
