"""Scoring inside the stream: each micro-batch of reviews becomes aspect mentions, once.

A batch writes its mentions into a folder of its own number, and then its number into a ledger. A batch that is repeated after a
failure finds its number in the ledger and adds nothing, or overwrites the folder that it had not finished. Reviews that were
taken before, in another batch, are left out by their ids, which the ledger's table of ids keeps; within a batch each id counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import extract_aspects
from ..session import materialize, scratch_path
from ..sources.readers import path_exists

Scorer = Callable[[DataFrame], DataFrame]


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def ingest_batch(reviews: DataFrame, batch_id: int, path: str, score: Scorer = extract_aspects, key: str = "review_id") -> None:
    """Score one micro-batch into the table at `path`; safe to repeat."""
    spark = reviews.sparkSession
    ledger = _known(spark, f"{path}/ledger", "batch bigint, reviews bigint")
    if not ledger.where(F.col("batch") == batch_id).isEmpty():
        return
    kind = dict(reviews.dtypes)[key]
    # ids of a batch that did not reach the ledger do not count
    taken = _known(spark, f"{path}/ids", f"{key} {kind}, batch bigint").join(ledger.select("batch"), "batch", "left_semi")
    fresh = materialize(reviews.where(F.col(key).isNotNull()).dropDuplicates([key]).join(
        taken.select(key), key, "left_anti"), "batch")
    score(fresh).write.mode("overwrite").parquet(f"{path}/mentions/batch={batch_id}")
    fresh.select(key).write.mode("overwrite").parquet(f"{path}/ids/batch={batch_id}")
    spark.createDataFrame([(batch_id, fresh.count())], "batch bigint, reviews bigint").write.mode("append").parquet(f"{path}/ledger")


def run_scored_ingest(stream: DataFrame, path: str, checkpoint: str | None = None, score: Scorer = extract_aspects,
                      key: str = "review_id") -> DataFrame:
    """Process what is available and read the mentions of all finished batches."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "ingest-progress")

    def take(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, path, score, key)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return scored_mentions(spark, path)


def scored_mentions(spark: SparkSession, path: str) -> DataFrame:
    """Mentions of the batches in the ledger."""
    done = spark.read.parquet(f"{path}/ledger").select(F.col("batch").cast("int").alias("batch"))
    return spark.read.parquet(f"{path}/mentions").join(done, "batch", "left_semi").drop("batch")
