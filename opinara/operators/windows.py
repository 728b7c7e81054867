"""Rolling sentiment, momentum and rolling activity.

A product or user may own a third of all rows, so no window here runs over raw rows of
one key.  Mentions are summed per (key, day) first: the rolling mean depends on the day
only, and a key has no more days than the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

PRODUCT = "parent_asin"


def daily_scores(df: DataFrame, key: str = PRODUCT) -> DataFrame:
    """Score sum and mention count per key and day."""
    return df.groupBy(key, "date").agg(
        F.sum("sentiment_score").alias("s"), F.count("*").alias("n"))


def _days_back(key: str, days: int):
    return (Window.partitionBy(key).orderBy(C.day_number("date"))
            .rangeBetween(-(days - 1), Window.currentRow))


def rolling_daily(daily: DataFrame, days: int = 7, key: str = PRODUCT) -> DataFrame:
    """Mean score of the last ``days`` days, the current day included."""
    w = _days_back(key, days)
    return daily.withColumn("rolling", F.sum("s").over(w) / F.sum("n").over(w))


def rolling_sentiment(df: DataFrame, days: int = 7, key: str = PRODUCT) -> DataFrame:
    """Rolling mean per key and day, with the day's mention count."""
    return daily_scores(df, key).transform(rolling_daily, days, key).select(
        key, "date", F.col("n").alias("mention_count"), "rolling"
    )


def latest_and_previous(daily: DataFrame, days: int = 7, rows_back: int = 7,
                        key: str = PRODUCT) -> DataFrame:
    """The newest rolling value of every key and the one ``rows_back`` mentions earlier.

    Which day holds the earlier mention follows from the running count, newest first.
    Keys with fewer mentions fall back to their first day.
    """
    newest_first = (Window.partitionBy(key).orderBy(F.desc("date"))
                    .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = rolling_daily(daily, days, key).withColumn("upto", F.sum("n").over(newest_first))
    k = rows_back + 1
    here = (F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)
    return r.groupBy(key).agg(
        F.sum("n").alias("mention_count"),
        F.max("date").alias("last_date"),
        F.max_by("rolling", "date").alias("recent"),
        F.coalesce(F.max(F.when(here, F.col("rolling"))),
                   F.min_by("rolling", "date")).alias("previous"),
    )


def previous_by_days(daily: DataFrame, days: int = 7, key: str = PRODUCT) -> DataFrame:
    """Variant that compares with the last rolling value at least ``days`` days old."""
    r = rolling_daily(daily, days, key).withColumn(
        "last_date", F.max("date").over(Window.partitionBy(key)))
    old = F.col("date") <= F.date_sub("last_date", days)
    return r.groupBy(key).agg(
        F.sum("n").alias("mention_count"),
        F.max("last_date").alias("last_date"),
        F.max_by("rolling", "date").alias("recent"),
        F.coalesce(F.max_by(F.when(old, F.col("rolling")), F.when(old, F.col("date"))),
                   F.min_by("rolling", "date")).alias("previous"),
    )


def momentum(df: DataFrame, days: int = 14, key: str = PRODUCT) -> DataFrame:
    """Slope of the last ``days`` rolling points (one point per mention); 0 with fewer."""
    newest_first = (Window.partitionBy(key).orderBy(F.desc("date"))
                    .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = (
        daily_scores(df, key).transform(rolling_daily, days, key)
        .withColumn("upto", F.sum("n").over(newest_first))
        .where(F.col("upto") - F.col("n") < days)
        .withColumn("take", F.least("upto", F.lit(days)) - (F.col("upto") - F.col("n")))
        .withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("take"))))
        .withColumn("x", -(F.col("upto") - F.col("n") + F.col("i")))
    )
    slope = F.regr_slope("rolling", F.col("x").cast("double"))
    return r.groupBy(key).agg(
        F.when(F.count("*") < days, 0.0).otherwise(slope).alias("momentum")
    )


def rolling_count(df: DataFrame, key: str, ts: str, row_id: str, days: int = 7) -> DataFrame:
    """Rows of the same key in the half-open window (ts - days, ts], for every row.

    The count is the difference of two running counts: up to ``ts`` and up to
    ``ts - days``.  Each row therefore asks twice.  A running count is the total of the
    earlier hours plus the rank inside the hour, so the ranking is split by (key, hour)
    and a busy key spreads over all its hours.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    hour = 3_600_000_000
    base = df.select(key, F.col(row_id).alias("_id"), micros.alias("_t"))
    asks = base.select(
        key, "_id",
        F.explode(F.array(
            F.struct(F.col("_t").alias("t"), F.lit(1).alias("own")),
            F.struct((F.col("_t") - days * 24 * hour).alias("t"), F.lit(0).alias("own")),
        )).alias("a"),
    ).select(key, "_id", F.col("a.t").alias("_t"), F.col("a.own").alias("_own"),
             F.floor(F.col("a.t") / hour).cast("bigint").alias("_h"))
    inside = (Window.partitionBy(key, "_h").orderBy("_t")
              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = asks.withColumn("_rank", F.sum("_own").over(inside))
    hours = asks.groupBy(key, "_h").agg(F.sum("_own").alias("_k"))
    before = (Window.partitionBy(key).orderBy("_h")
              .rowsBetween(Window.unboundedPreceding, -1))
    hours = hours.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    running = ranked.join(hours, [key, "_h"]).withColumn("_c", F.col("_before") + F.col("_rank"))
    return running.groupBy(key, F.col("_id").alias(row_id)).agg(
        F.sum(F.when(F.col("_own") == 1, F.col("_c")).otherwise(-F.col("_c"))).alias("n")
    )


def user_activity(df: DataFrame, days: int = 7, threshold: int = 5, ts: str = "ts") -> DataFrame:
    """Reviews of the user in the last ``days`` days and a high-activity flag."""
    return rolling_count(df, "user_id", ts, "review_id", days).select(
        "review_id", "user_id", F.col("n").alias("reviews_in_window"),
        (F.col("n") > threshold).alias("high_activity"),
    )
