"""Alerts over all products, categories and aspects at once.

All alerts but the shifts are built from one small table of additive cells per product, day and aspect. They take
mention rows, with or without metadata, or such cells; ``products`` supplies titles, categories and ratings, which are joined
to aggregates only, never to mentions. Without it the rows' own metadata is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize
from .preprocess import top_per_group
from .windows import daily_scores, latest_and_previous, previous_by_days

PRODUCT, ASPECT = "parent_asin", "aspect_term_normalized"


INFO = ("title", "main_category", "average_rating")


def alert_cells(df: DataFrame) -> DataFrame:
    """Sums per product, day and aspect, written once for all alerts that read them."""
    return materialize(df.groupBy(PRODUCT, "date", ASPECT).agg(
        F.count("*").alias("n"), F.sum("sentiment_score").alias("s"), F.count("sentiment_score").alias("sn"),
        *[C.count_if(F.col("sentiment") == kind).alias(name) for name, kind in (
            ("pos", C.POSITIVE), ("neg", C.NEGATIVE), ("neu", C.NEUTRAL))]), "cells")


def _cells(df: DataFrame) -> DataFrame:
    return df if {"n", "s", "sn", "neg"} <= set(df.columns) else alert_cells(df)


def _days(df: DataFrame) -> DataFrame:
    """Cells, or mentions as cells of one mention each: what sums by aspect need no shuffle by product for."""
    if {"n", "s", "sn", "neg"} <= set(df.columns):
        return df
    return materialize(df.select(ASPECT, PRODUCT, "date", F.lit(1).cast("bigint").alias("n"), F.col("sentiment_score").alias("s"),
                                 F.when(F.col("sentiment") == C.NEGATIVE, 1).otherwise(0).cast("bigint").alias("neg")), "mentions")


def product_info(df: DataFrame) -> DataFrame:
    """One row of metadata per product, from a product table or from mentions that carry it."""
    key = F.trim(F.col(PRODUCT).cast("string")).alias(PRODUCT)
    return df.groupBy(key).agg(*[F.max(c).alias(c) for c in INFO if c in df.columns])


def _latest_day(df: DataFrame):
    return df.agg(F.max("date")).scalar()


def _change(recent="recent", previous="previous"):
    r, p = F.col(recent), F.col(previous)
    return F.when(p > 0, (r - p) / F.abs(p))


def sentiment_shifts(df: DataFrame, threshold: float = 0.2, days: int = 7, min_mentions: int = 5,
                     previous: str = "rows") -> DataFrame:
    """Products whose rolling sentiment fell by more than ``threshold``.

    ``previous="rows"`` compares with the rolling value ``days`` mentions ago,
    ``"days"`` with the one ``days`` days ago.
    """
    daily = daily_scores(df, PRODUCT)
    pair = (latest_and_previous(daily, days, days) if previous == "rows"
            else previous_by_days(daily, days))
    return (
        pair.where(F.col("mention_count") >= min_mentions)
        .withColumn("sentiment_change", _change())
        .where(F.col("sentiment_change") < -threshold)
        .select(PRODUCT, "sentiment_change", F.col("recent").alias("recent_sentiment"),
                F.col("previous").alias("previous_sentiment"),
                F.col("last_date").alias("alert_date"), "mention_count")
    )


def sentiment_drops(df: DataFrame, threshold: float = 0.2, days: int = 7,
                    min_mentions: int = 5, products: DataFrame | None = None) -> DataFrame:
    """Drop alerts with severity, mentions of the period and its three most frequent
    negative aspects.

    The cells feed the rolling values, the period count and the aspect ranking.  Titles are
    looked up for the alerted products only.
    """
    cells = _cells(df)
    daily = cells.groupBy(PRODUCT, "date").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    alerts = materialize(
        latest_and_previous(daily, days, days)
        .where(F.col("mention_count") >= max(min_mentions, 2))
        .withColumn("sentiment_change", _change())
        .where(F.col("sentiment_change") < -threshold), "alerts")
    info = product_info((df if products is None else products).join(alerts.select(PRODUCT), PRODUCT, "left_semi"))
    period = (
        cells.join(alerts.select(PRODUCT, "last_date"), PRODUCT)
        .where(F.col("date") >= F.date_sub("last_date", days))
        .groupBy(PRODUCT, ASPECT).agg(F.sum("n").alias("n"), F.sum("neg").alias("neg"))
    )
    counts = period.groupBy(PRODUCT).agg(F.sum("n").alias("mention_count_period"))
    negatives = top_per_group(period.where("neg > 0"), [PRODUCT], [F.desc("neg"), ASPECT], 3)
    names = negatives.groupBy(PRODUCT).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", ASPECT))),
                                 lambda s: s[ASPECT]), ", ").alias("top_negative_aspects"))
    return (
        alerts.join(counts, PRODUCT).join(info, PRODUCT, "left").join(names, PRODUCT, "left")
        .select(
            F.lit("Sentiment Drop").alias("alert_type"),
            F.when(F.col("sentiment_change") < -0.5, "High").otherwise("Medium").alias("severity"),
            F.col(PRODUCT).alias("product_asin"), F.col("title").alias("product_title"),
            F.col("main_category").alias("category"), "sentiment_change",
            F.col("recent").alias("recent_sentiment"),
            F.col("previous").alias("previous_sentiment"),
            F.col("last_date").alias("alert_date"), "mention_count_period",
            F.coalesce("top_negative_aspects", F.lit("")).alias("top_negative_aspects"),
        )
        .orderBy("sentiment_change", "product_asin")
    )


def category_trends(df: DataFrame, min_mentions: int = 50, days: int = 30,
                    products: DataFrame | None = None) -> DataFrame:
    """Last ``days`` days against everything before, per category.

    Cells are summed per product before the category is joined.
    """
    cells = _cells(df)
    recent = F.col("date") > F.date_sub(_latest_day(cells), days)
    per_product = cells.withColumn("_recent", recent).groupBy(PRODUCT).agg(*[
        F.sum(F.when(F.col("_recent") if new else ~F.col("_recent"), F.col(c))).alias(f"{c}_{name}")
        for name, new in (("new", True), ("old", False)) for c in ("n", "s", "sn", "neg")])
    info = product_info(df if products is None else products).select(PRODUCT, "main_category")
    g = (
        per_product.join(info, PRODUCT).where(F.col("main_category").isNotNull())
        .groupBy(F.col("main_category").alias("category"))
        .agg(
            F.try_divide(F.sum("s_new"), F.sum("sn_new")).alias("recent_sentiment"),
            F.try_divide(F.sum("s_old"), F.sum("sn_old")).alias("historical_sentiment"),
            F.coalesce(F.sum("n_new"), F.lit(0)).alias("recent_mention_count"),
            F.coalesce(F.sum("n_old"), F.lit(0)).alias("historical_mention_count"),
            C.percent(F.sum("neg_new"), F.sum("n_new")).alias("recent_pct_negative"),
        )
        .where((F.col("recent_mention_count") >= min_mentions)
               & (F.col("historical_mention_count") >= min_mentions))
    )
    h = F.col("historical_sentiment")
    change = F.when(h != 0, (F.col("recent_sentiment") - h) / F.abs(h)).otherwise(0.0)
    return (
        g.withColumn("change", change)
        .withColumn("trend", F.when(F.col("change") > 0.1, "Improving")
                    .when(F.col("change") < -0.1, "Declining").otherwise("Stable"))
        .orderBy("change", "category")
    )


def emerging_aspects(df: DataFrame, lookback_days: int = 30, min_mentions: int = 5,
                     against: str = "previous", products: DataFrame | None = None) -> DataFrame:
    """Aspects of the last ``lookback_days`` days that the reference period lacks.

    The reference period is the ``lookback_days`` days before (``against="previous"``)
    or all earlier data (``"all"``).  Both periods are counted by aspect alone, in the same pass; products
    are counted for the aspects that are left and their last days only.
    """
    days = _days(df)
    cutoff = F.date_sub(_latest_day(days), lookback_days)
    recent = F.col("date") > cutoff
    older = F.col("date") <= cutoff
    if against == "previous":
        older = older & (F.col("date") > F.date_sub(cutoff, lookback_days))

    def new(c):
        return F.coalesce(F.sum(F.when(F.col("_recent"), F.col(c))), F.lit(0))

    marked = days.withColumns({"_recent": recent, "_older": older}).where("_recent or _older")
    fresh = materialize(
        marked.groupBy(ASPECT)
        .agg(
            new("n").alias("mention_count"), F.coalesce(F.sum(F.when(F.col("_older"), F.col("n"))), F.lit(0)).alias("old"),
            new("s").alias("s"), C.percent(new("neg"), new("n")).alias("pct_negative"),
            F.min(F.when(F.col("_recent"), F.col("date"))).alias("first_seen"),
        )
        .where((F.col("old") == 0) & (F.col("mention_count") >= min_mentions)), "aspects")
    cells = materialize(marked.where("_recent").join(fresh.select(ASPECT), ASPECT, "left_semi").groupBy(
        ASPECT, PRODUCT).agg(F.sum("n").alias("n")), "products")
    counted = cells.groupBy(ASPECT).agg(C.count_if(F.col("n") > 0).alias("unique_products"))
    ranked = top_per_group(cells.where("n > 0"), [ASPECT], [F.desc("n"), PRODUCT], 3)
    titles = product_info((df if products is None else products).join(
        ranked.select(PRODUCT).distinct(), PRODUCT, "left_semi")).select(PRODUCT, "title")
    names = ranked.join(titles, PRODUCT, "left").groupBy(ASPECT).agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", F.coalesce("title", PRODUCT).alias("t")))),
            lambda s: s["t"]), ", ").alias("top_products"))
    return (
        fresh.join(counted, ASPECT).join(names, ASPECT)
        .select(F.col(ASPECT).alias("aspect"), "mention_count",
                (F.col("s") / F.col("mention_count")).alias("avg_sentiment"), "pct_negative",
                "unique_products", "top_products", "first_seen")
        .orderBy(F.desc("mention_count"), "aspect")
    )


def emerging_set(df: DataFrame, lookback_days: int = 30) -> DataFrame:
    """Just the names: recent aspects minus all earlier ones."""
    cutoff = F.date_sub(_latest_day(df), lookback_days)
    return (df.groupBy(ASPECT).agg(F.min("date").alias("first_seen"))
            .where(F.col("first_seen") > cutoff))


def rating_divergence(df: DataFrame, threshold: float = 1.5, min_mentions: int = 10,
                      products: DataFrame | None = None) -> DataFrame:
    """Products whose star rating and rescaled sentiment differ by ``threshold`` or more."""
    sums = _cells(df).groupBy(PRODUCT).agg(F.sum("s").alias("s"), F.sum("sn").alias("sn"), F.sum("n").alias("n"))
    g = sums.join(product_info(df if products is None else products), PRODUCT, "left").select(
        F.col(PRODUCT).alias("product_asin"), F.col("title").alias("product_title"),
        F.col("main_category").alias("category"), F.col("average_rating").alias("product_rating"),
        C.to_star_scale(F.try_divide("s", "sn")).alias("sentiment_rating"), F.col("n").alias("mention_count"))
    gap = F.abs(F.col("product_rating") - F.col("sentiment_rating"))
    return (
        g.where(F.col("mention_count") >= min_mentions)
        .withColumn("divergence", gap)
        .where(F.col("divergence") >= threshold)
        .withColumn("interpretation",
                    F.when(F.col("product_rating") > F.col("sentiment_rating"),
                           "Rating higher than sentiment").otherwise("Sentiment higher than rating"))
        .orderBy(F.desc("divergence"), "product_asin")
    )


def alert_report(df: DataFrame, products: DataFrame | None = None, **params) -> dict[str, DataFrame]:
    """The four alert tables by name, from one table of cells; ``params`` maps a table to its arguments."""
    makers = {"sentiment_drops": sentiment_drops, "category_trends": category_trends,
              "emerging_aspects": emerging_aspects, "rating_divergence": rating_divergence}
    info = materialize(product_info(df if products is None else products), "info")
    cells = _cells(df)
    return {name: fn(cells, products=info, **params.get(name, {})) for name, fn in makers.items()}


def alert_summary(report: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the report's tables."""
    out = None
    for name, table in report.items():
        row = table.agg(F.count("*").alias("alerts")).select(F.lit(name).alias("report"), "alerts")
        out = row if out is None else out.unionByName(row)
    return out
