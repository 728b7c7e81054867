"""Column profiles that can be stored per month and merged, and the exact form beside them.

A stored profile has one row per (period, column): counts, mean and squared deviations, bounds, and three sketches as binary or
struct values: quantiles, distinct values and frequent values. All columns are profiled by one aggregate per period, combined map-side;
no row is expanded per column. Merging reads rows of the stored table only. A merged quantile lies within RANK_ERROR of the wanted
rank, a merged distinct count within about DISTINCT_ERROR; counts, means, deviations and bounds are exact.

Numbers of every type count as double; dates and timestamps as seconds since 1970, shown as timestamps. A column of nulls has null summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .quantiles import exact_quantiles

SKETCH = 800            # size of the quantile sketch
RANK_ERROR = 0.01       # of the rank, twice what a sketch of this size promises
DISTINCT_BITS = 12
DISTINCT_ERROR = 0.05   # three standard errors at that size
TOP, TRACKED = 5, 1000  # frequent values shown, and counters kept
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def kind_of(dtype: str) -> str:
    if dtype in _NUMBERS or dtype.startswith("decimal"):
        return "number"
    return "time" if dtype in ("date", "timestamp", "timestamp_ntz") else "other"


def _number(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    return (F.unix_micros(c.cast("timestamp")) / 1e6 if kind == "time" else c).cast("double")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def profile_periods(df: DataFrame, period: str) -> DataFrame:
    """One row per (period, column) of all other columns, with mergeable sketches."""
    entries, aggregates = [], [F.count(F.lit(1)).alias("_rows")]
    for i, (name, dtype) in enumerate((n, t) for n, t in df.dtypes if n != period):
        kind, c = kind_of(dtype), F.col(_quoted(name))
        number = _number(name, kind) if kind != "other" else F.lit(None).cast("double")
        parts = {
            "kind": F.lit(kind), "filled": F.count(c), "mean": F.avg(number), "spread": F.var_pop(number) * F.count(number),
            "low": F.min(number), "high": F.max(number),
            "quantiles": F.kll_sketch_agg_double(number, SKETCH) if kind != "other" else F.lit(None).cast("binary"),
            "distinct": F.hll_sketch_agg(c.cast("string"), F.lit(DISTINCT_BITS)),
            "frequent": F.expr(f"approx_top_k_accumulate(cast({_quoted(name)} as string), {TRACKED})"),
        }
        aggregates += [v.alias(f"_{i}_{k}") for k, v in parts.items()]
        entries.append(F.struct(F.lit(name).alias("column"), F.col("_rows").alias("rows"),
                                *[F.col(f"_{i}_{k}").alias(k) for k in parts]))
    return df.groupBy(period).agg(*aggregates).select(period, F.inline(F.array(*entries)))


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """One row per column over all the given periods: the readable profile."""
    n, mean = F.col("filled"), F.col("mean")
    total = F.sum(F.when(mean.isNotNull(), n))
    centre = F.sum(n * mean) / total
    merged = profiles.groupBy("column", "kind").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), total.alias("_n"), centre.alias("mean"),
        (F.sum(F.col("spread") + n * mean * mean) - total * centre * centre).alias("_spread"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.kll_merge_agg_double("quantiles").alias("_k"),
        F.hll_union_agg("distinct", F.lit(True)).alias("_h"), F.expr("approx_top_k_combine(frequent)").alias("_f"))
    wanted = F.array(*[F.lit(p) for p in QUARTILES.values()])
    shown = merged.withColumn("_q", F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_k", wanted)))
    return _readable(shown.select(
        "column", "kind", "rows", (F.col("rows") - F.col("filled")).alias("nulls"),
        F.hll_sketch_estimate("_h").alias("distinct_values"), "mean",
        F.when(F.col("_n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("_spread")) / (F.col("_n") - 1))).alias("std"), "low", "high",
        *[F.get("_q", F.lit(i)).alias(q) for i, q in enumerate(QUARTILES)],
        F.expr(f"transform(approx_top_k_estimate(_f, {TOP}), x -> x.item)").alias("frequent")))


def _readable(out: DataFrame) -> DataFrame:
    """Times as timestamps in columns of their own; a mean of times is one of them, a deviation is not."""
    time, number = F.col("kind") == "time", F.col("kind") == "number"
    return out.withColumns({
        "first_time": F.when(time, F.timestamp_micros((F.col("low") * 1e6).cast("bigint"))),
        "last_time": F.when(time, F.timestamp_micros((F.col("high") * 1e6).cast("bigint"))),
        **{c: F.when(number, F.col(c)) for c in ("low", "high", "mean", "std", *QUARTILES)},
    }).withColumnsRenamed({"low": "min", "high": "max"})


def profile_exact(df: DataFrame) -> DataFrame:
    """The same profile of a table, exact throughout; distinct values and quartiles are counted by (column, value).

    The counts are written once: rows are expanded per column and shuffled a single time.
    """
    columns = [(n, kind_of(t)) for n, t in df.dtypes]
    each = df.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("column"), F.lit(k).alias("kind"), F.col(_quoted(n)).cast("string").alias("value"),
        (_number(n, k) if k != "other" else F.lit(None).cast("double")).alias("number")) for n, k in columns])))
    counts = materialize(each.groupBy("column", "kind", "value", "number").agg(F.count(F.lit(1)).alias("n")), "counts")
    filled = F.col("value").isNotNull()
    basic = counts.groupBy("column", "kind").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("nulls"),
        F.count(F.when(filled, 1)).alias("distinct_values"), (F.sum(F.col("n") * F.col("number")) / F.sum(
            F.when(F.col("number").isNotNull(), F.col("n")))).alias("mean"),
        F.min("number").alias("low"), F.max("number").alias("high"))
    squares = counts.join(basic.select("column", F.col("mean").alias("_m")), "column").groupBy("column").agg(
        (F.sum(F.col("n") * (F.col("number") - F.col("_m")) * (F.col("number") - F.col("_m")))).alias("_s"),
        F.sum(F.when(F.col("number").isNotNull(), F.col("n"))).alias("_n"))
    quartiles = exact_quantiles(counts, ["column"], "number", QUARTILES, weight="n").drop("n")
    out = basic.join(squares, "column").join(quartiles, "column", "left")
    return _readable(out.withColumn("std", F.when(F.col("_n") > 1, F.sqrt(F.col("_s") / (F.col("_n") - 1)))).drop("_s", "_n"))
