"""A fitted text encoder: TF-IDF and its leading singular directions, found without a dense covariance.

The vocabulary holds the `max_features` most frequent topic words, so everything that reaches the driver has a size that
the parameters fix: a word list and matrices of words by directions. From a random start a basis grows: each round multiplies
its newest block by X'X (each Arrow batch multiplies its rows by the block and by their transposes, tasks hand on one sum
each, and sums meet block by block of words on two levels), the products yield the best directions inside the basis, and what
these leave unexplained is the next block. Rounds end when nothing is left, at the latest when the basis spans all words; a basis
of BLOCKS blocks shrinks to its best directions. The model encodes any text, questions too, and is saved as a table of one row per word.

Defined results: a null or empty text, and one without words of the vocabulary, is the zero vector; a model has at most as many
directions as there are words or independent texts; a table without words cannot be fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize

ROUNDS = 60             # products with X'X, at most
BLOCKS = 12             # blocks of a basis, at most
LEFT = 1e-8             # norm of what a direction leaves, by the largest squared singular value, that counts as nothing
ROWS, WORDS = 256, 64   # rows multiplied at once; words of a block of sums
SALTS = 64              # sums that meet on the first level, by block
LARGEST = 256 << 20     # bytes of a model that is sent to all tasks


def _tokens(df: DataFrame, key: str, col: str) -> DataFrame:
    return df.select(F.col(key).alias("_id"), C.topic_tokens(col).alias("tokens"))


def _matrix(tokens: pd.Series, place: dict[str, int], idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length."""
    out = np.zeros((len(tokens), len(place)))
    for i, words in enumerate(tokens):
        for w in words if words is not None else ():
            j = place.get(w)
            if j is not None:
                out[i, j] += idf[j]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


@dataclass
class Embedder:
    terms: list[str]
    idf: np.ndarray
    directions: np.ndarray      # words by directions
    singular_values: np.ndarray
    left: float = 0.0           # largest norm of what a direction leaves, by the largest squared singular value

    def transform(self, df: DataFrame, key: str = "review_id", col: str = "text") -> DataFrame:
        """``(key, embedding)``: unit vectors, one per row."""
        if self.directions.nbytes > LARGEST:
            raise ValueError("the model is too large to be sent to every task")
        shared = df.sparkSession.sparkContext.broadcast((
            {t: i for i, t in enumerate(self.terms)}, self.idf, self.directions))

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place, idf, directions = shared.value
            for pdf in batches:
                for at in range(0, len(pdf), ROWS):
                    some = pdf.iloc[at: at + ROWS]
                    v = _matrix(some["tokens"], place, idf) @ directions  # zero rows stay zero
                    norms = np.linalg.norm(v, axis=1, keepdims=True)
                    norms[norms == 0] = 1.0
                    yield pd.DataFrame({"_id": some["_id"], "embedding": list(v / norms)})

        kind = dict(df.dtypes)[key]
        return _tokens(df, key, col).mapInPandas(encode, f"_id {kind}, embedding array<double>").withColumnRenamed("_id", key)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, t, float(w), v.tolist()) for i, (t, w, v) in enumerate(zip(self.terms, self.idf, self.directions, strict=True))]
        spark.createDataFrame(rows, "ix int, term string, idf double, direction array<double>").write.parquet(f"{path}/words")
        values = [(i, float(s)) for i, s in enumerate(self.singular_values)]
        spark.createDataFrame(values, "ix int, value double").write.parquet(f"{path}/values")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Embedder:
        words = sorted(spark.read.parquet(f"{path}/words").collect(), key=lambda r: r["ix"])
        values = sorted(spark.read.parquet(f"{path}/values").collect(), key=lambda r: r["ix"])
        return Embedder([r["term"] for r in words], np.array([r["idf"] for r in words]),
                        np.array([r["direction"] for r in words]), np.array([r["value"] for r in values]))


def _sparse(rows: DataFrame, place: dict[str, int], idf: np.ndarray) -> DataFrame:
    """Places and weights of each text's words; texts without a known word are left out."""
    shared = rows.sparkSession.sparkContext.broadcast((place, idf))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, idf = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                x = _matrix(pdf["tokens"].iloc[at: at + ROWS], place, idf)
                full = [r for r in x if r.any()]
                if full:
                    yield pd.DataFrame({"at": [np.flatnonzero(r).astype("int32") for r in full], "w": [r[r != 0] for r in full]})

    return materialize(rows.mapInPandas(count, "at array<int>, w array<double>"), "sparse")


def _product(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """X'XQ over all texts."""
    shared = rows.sparkSession.sparkContext.broadcast(q)
    shape = q.shape

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, total = shared.value, np.zeros(shape)
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                some = pdf.iloc[at: at + ROWS]
                x = np.zeros((len(some), shape[0]))
                for i, (places, weights) in enumerate(zip(some["at"], some["w"], strict=True)):
                    x[i, places] = weights
                total += x.T @ (x @ q)
        starts = range(0, shape[0], WORDS)
        yield pd.DataFrame({"block": list(starts), "salt": TaskContext.get().partitionId() % SALTS,
                            "z": [total[a: a + WORDS].tobytes() for a in starts]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(z) for z in pdf["z"]], axis=0)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "salt": pdf["salt"].iloc[:1], "z": [total.tobytes()]})

    schema = "block int, salt int, z binary"
    sums = rows.mapInPandas(multiply, schema).groupBy("block", "salt").applyInPandas(add, schema)
    found = sums.groupBy("block").applyInPandas(add, schema).collect()
    shared.unpersist()
    return np.concatenate([np.frombuffer(r["z"]).reshape(-1, shape[1]) for r in sorted(found, key=lambda r: r["block"])])


def fit(df: DataFrame, col: str = "text", max_features: int = 1024, dims: int = 384, seed: int = 42) -> Embedder:
    """Learn vocabulary, weights and directions from all texts."""
    toks = materialize(df.select(C.topic_tokens(col).alias("tokens")), "tokens")
    n = toks.count()
    often = toks.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    often = often.orderBy(F.desc("n"), "term").limit(max_features)
    held = toks.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    words = sorted((r["term"], r["df"]) for r in often.select("term").join(held, "term").collect())
    if not words:
        raise ValueError("no text has a word to learn from")
    place = {t: i for i, (t, _) in enumerate(words)}
    idf = np.log((1 + n) / (1 + np.array([d for _, d in words], float))) + 1
    m = len(words)
    width = min(m, 2 * min(dims, m) + 32)
    rows = _sparse(toks, place, idf)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, width)))[0]
    z = _product(rows, q)
    for _ in range(ROUNDS):
        small = q.T @ z
        squares, turn = np.linalg.eigh((small + small.T) / 2)
        squares, turn = squares[::-1], turn[:, ::-1]
        k = min(dims, int((squares > 1e-12 * squares[0]).sum()))
        directions = q @ turn[:, :k]
        unexplained = z @ turn[:, :width] - (q @ turn[:, :width]) * squares[:width]
        left = float(np.linalg.norm(unexplained[:, :k], axis=0).max() / squares[0])
        if left <= LEFT or q.shape[1] == m:
            break
        if q.shape[1] >= BLOCKS * width:
            q, z = q @ turn[:, :2 * width], z @ turn[:, :2 * width]
        for _ in range(2):      # twice, for rounding
            unexplained -= q @ (q.T @ unexplained)
        block, sizes, _ = np.linalg.svd(unexplained, full_matrices=False)
        block = block[:, sizes > 1e-12 * squares[0]][:, : m - q.shape[1]]
        block = np.linalg.qr(block - q @ (q.T @ block))[0]
        q, z = np.hstack([q, block]), np.hstack([z, _product(rows, block)])
    directions *= np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(k)])
    return Embedder([t for t, _ in words], idf, directions, np.sqrt(squares[:k]), left)
