"""Streaming twins of the batch operators.  Each equals its batch form on closed windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import columns as C
from ..session import scratch_path
from ..sources.readers import is_folder


def read_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The table ``name`` of ``folder`` as a stream: all files of a folder of that name, or else the file."""
    if is_folder(spark, f"{folder}/{name}"):
        return spark.readStream.schema(schema).parquet(f"{folder}/{name}")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_to_table(stream: DataFrame, name: str, checkpoint: str | None = None,
                 path: str | None = None) -> DataFrame:
    """Process what is available, append it to files and read them back."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    checkpoint = checkpoint or scratch_path(spark, f"{name}-progress")
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def dedup_stream(stream: DataFrame, key: str = "review_id", ts: str = "ts",
                 delay: str = "1 day") -> DataFrame:
    """Every review once, as long as its repeats arrive within ``delay``."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def trend_stream(stream: DataFrame, size: str = "1 day", slide: str | None = None, ts: str = "ts",
                 delay: str = "1 day") -> DataFrame:
    """Counts and mean score per tumbling or sliding window and sentiment."""
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (stream.withWatermark(ts, delay).groupBy(win.alias("w"), "sentiment")
            .agg(F.count("*").alias("n"), F.avg("sentiment_score").alias("avg_sentiment"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "sentiment", "n",
                    "avg_sentiment"))


def session_stream(stream: DataFrame, gap: str = "6 hours", key: str = "user_id", ts: str = "ts",
                   delay: str = "1 day") -> DataFrame:
    """Activity sessions per user, closed after ``gap`` without an event."""
    return (stream.withWatermark(ts, delay)
            .groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
            .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


CUSUM_STATE = "n long, mean double, m2 double, up double, down double"
CUSUM_OUT = "series_id string, ds timestamp, direction string"


def window_means(stream: DataFrame, key: str, size: str = "1 day", ts: str = "ts",
                 delay: str = "1 day") -> DataFrame:
    """Mean score per key and closed window."""
    return (stream.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), key)
            .agg(F.avg("sentiment_score").alias("y"))
            .select(F.col(key).alias("series_id"), F.col("w.end").alias("ds"), "y"))


def cusum_stream(windows: DataFrame, drift: float = 0.5, threshold: float = 3.0,
                 warmup: int = 10) -> DataFrame:
    """Change-point alerts per series with running mean and deviation.

    The input is the stream of closed windows that ``window_means`` writes, so the
    stateful step sees one row per series and window, however busy the series.  The mean
    is the running one: a stream has no other.
    """

    def step(keys, batches: Iterator[pd.DataFrame], state: GroupState):
        n, mean, m2, up, down = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
        hits = []
        rows = pd.concat(list(batches)).sort_values("ds")
        for ds, y in zip(rows["ds"], rows["y"]):
            sd = (m2 / n) ** 0.5 if n else 0.0
            if n >= warmup and sd > 0:
                z = (y - mean) / sd
                up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
                if max(up, down) > threshold:
                    hits.append((keys[0], ds, "up" if up >= down else "down"))
                    up = down = 0.0
            n += 1
            delta = y - mean
            mean += delta / n
            m2 += delta * (y - mean)
        state.update((n, mean, m2, up, down))
        yield pd.DataFrame(hits, columns=["series_id", "ds", "direction"])

    return windows.groupBy("series_id").applyInPandasWithState(
        step, CUSUM_OUT, CUSUM_STATE, "append", GroupStateTimeout.NoTimeout)


def scored_events(events: DataFrame) -> DataFrame:
    """Rated events with sentiment and score, event time as a zoned timestamp."""
    label = C.rating_label()
    return events.select(
        "review_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "rating",
        F.initcap(label).alias("sentiment"), ((F.col("rating") - 3) / 2).alias("sentiment_score"),
        "main_category")
