"""Exact quantiles that never gather a group's values in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def value_counts(df: DataFrame, groups: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """``(groups, v, c)``: each distinct value with its count, combined map-side; a row counts ``weight`` times."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias("v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("c"))
    )


def _range_of(v: Column, cuts: Column) -> Column:
    """How many of the sorted cuts are at most v, by binary search."""
    steps = F.array(*[F.lit(BUCKETS >> i) for i in range(1, BUCKETS.bit_length())])

    def take(at: Column, step: Column) -> Column:
        return F.when((at + step < BUCKETS) & (F.get(cuts, at + step - 1) <= v), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), take)


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str,
                    probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """Interpolated quantiles per group, one column per entry of ``probs``, plus ``n``.

    Equal values collapse first.  The distinct values of a group are split into ranges that hold
    about equally many of them, wherever they lie: the bounds come from a sketch.  Range totals
    tell which range holds a wanted rank, and only those ranges are ranked in detail, so the result is exact.
    A group with a third of all rows, or one far outlier, is therefore spread over many tasks.
    """
    groups = list(groups)
    counts = value_counts(df, groups, value, weight)
    if not groups:
        counts = counts.withColumn("_g", F.lit(0))
    g = groups or ["_g"]
    cuts = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    stats = counts.groupBy(*g).agg(F.sum("c").alias("n"), F.percentile_approx("v", cuts, 10 * BUCKETS).alias("_cuts"))
    placed = counts.join(stats, g).withColumn("_b", _range_of(F.col("v"), F.col("_cuts"))).drop("_cuts")

    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p))
        for p in probs.values()
    ])))
    totals = placed.groupBy(*g, "_b").agg(F.sum("c").alias("_nb"), F.max("n").alias("n"))
    cum = F.sum("_nb").over(
        Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    )
    wanted = (
        totals.withColumn("_before", cum - F.col("_nb"))
        .withColumn("_ranks", F.filter(
            ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_nb"))))
        .where(F.size("_ranks") > 0)
        .select(*g, "_b", "_before", "_ranks")
    )
    upto = F.sum("c").over(
        Window.partitionBy(*g, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    )
    picked = (
        placed.join(wanted, [*g, "_b"])
        .withColumn("_end", F.col("_before") + upto)
        .withColumn("_rank", F.explode("_ranks"))
        .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("c")))
    )

    def at(rank):
        return F.max(F.when(F.col("_rank") == rank, F.col("v")))

    out = picked.groupBy(*g, "n").agg(
        *[at(F.floor((F.col("n") - 1) * p)).alias(f"_lo_{k}") for k, p in probs.items()],
        *[at(F.ceil((F.col("n") - 1) * p)).alias(f"_hi_{k}") for k, p in probs.items()],
    )
    cols = []
    for k, p in probs.items():
        lo, hi = F.col(f"_lo_{k}"), F.col(f"_hi_{k}")
        frac = (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
        cols.append((lo + (hi - lo) * frac).alias(k))
    return out.select(*groups, "n", *cols)
