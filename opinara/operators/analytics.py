"""Aggregates behind the KPI, trend, product and coherence views.

Everything here is a group-by whose partial aggregates run before the shuffle, so a
group holding a third of the rows costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize
from .preprocess import top_per_group
from .quantiles import exact_quantiles, value_counts as distinct_counts

N = "*"
ASPECT = "aspect_term_normalized"
PRODUCT = "parent_asin"


def _is(sentiment: str):
    return F.col("sentiment") == sentiment


def _pct(sentiment: str):
    return C.percent(C.count_if(_is(sentiment)), F.count(N))


INFO = ("title", "main_category", "average_rating")


def cells(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Additive sums per key combination, the first level of a two-level aggregate.

    Distinct counts become plain counts of these cells, so no row is expanded per distinct
    column, and metadata travels as grouping key, which keeps the aggregate hash-based.
    """
    return df.groupBy(*keys).agg(
        F.count(N).alias("n"), F.sum("sentiment_score").alias("s"),
        F.count("sentiment_score").alias("sn"), F.sum("confidence").alias("c"),
        F.count("confidence").alias("cn"),
        C.count_if(_is(C.POSITIVE)).alias("pos"), C.count_if(_is(C.NEGATIVE)).alias("neg"),
        C.count_if(_is(C.NEUTRAL)).alias("neu"))


def _mean(total: str, count: str):
    return F.try_divide(F.sum(total), F.sum(count))


def _share(part: str):
    return C.percent(F.sum(part), F.sum("n"))


def kpis(df: DataFrame) -> DataFrame:
    """Headline numbers in one row."""
    return cells(df, [PRODUCT, ASPECT]).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("mention_count"),
        F.count_distinct(PRODUCT).alias("product_count"),
        F.count_distinct(ASPECT).alias("aspect_count"),
        _mean("c", "cn").alias("avg_confidence"),
        _share("pos").alias("pct_positive"),
        _share("neg").alias("pct_negative"),
        _share("neu").alias("pct_neutral"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts with their share of all non-null rows."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(
        F.count(N).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def top_values(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """Most frequent values; ties go by value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(N).alias("n"))
            .orderBy(F.desc("n"), col).limit(n))


def restrict_to_top(df: DataFrame, col: str, n: int) -> DataFrame:
    """Semi-join to the ``n`` most frequent values (the key side holds ``n`` rows)."""
    keys = top_values(df, col, n).select(col)
    return df.join(F.broadcast(keys), col, "left_semi")


def polarity_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        C.count_if(_is(C.POSITIVE)).alias("positive"),
        C.count_if(_is(C.NEGATIVE)).alias("negative"),
        C.count_if(_is(C.NEUTRAL)).alias("neutral"),
        F.count(N).alias("total"),
    )


def aspect_summary(df: DataFrame, n: int = 10) -> DataFrame:
    """Most mentioned aspects with (positive - negative) / total."""
    return (
        polarity_counts(df, [ASPECT])
        .withColumn("score", (F.col("positive") - F.col("negative")) / F.col("total"))
        .orderBy(F.desc("total"), ASPECT)
        .limit(n)
    )


def sentiment_ratio(df: DataFrame) -> DataFrame:
    """Share of positives among polar mentions, per aspect."""
    return polarity_counts(df, [ASPECT]).withColumn(
        "positive_ratio", C.percent(F.col("positive"), F.col("positive") + F.col("negative"))
    )


def product_top_aspects(df: DataFrame, n: int = 10) -> DataFrame:
    """Most mentioned aspects of every product."""
    stats = df.groupBy(PRODUCT, ASPECT).agg(
        F.count(N).alias("mention_count"),
        F.avg("sentiment_score").alias("avg_sentiment"),
        F.sum("is_positive").alias("positive"),
        F.sum("is_negative").alias("negative"),
        F.sum("is_neutral").alias("neutral"),
    )
    return top_per_group(stats, [PRODUCT], [F.desc("mention_count"), ASPECT], n)


def aspect_product_matrix(df: DataFrame, top_aspects: int = 15, top_products: int = 10) -> DataFrame:
    """Mean score per (aspect, product) cell of the most frequent ones, long form."""
    return (
        df.transform(restrict_to_top, ASPECT, top_aspects)
        .join(F.broadcast(top_values(df, PRODUCT, top_products).select(PRODUCT)), PRODUCT, "left_semi")
        .groupBy(ASPECT, PRODUCT)
        .agg(F.avg("sentiment_score").alias("avg_sentiment"))
    )


def pivot_matrix(cells: DataFrame, products: Sequence[str]) -> DataFrame:
    """Wide form of the matrix for a given product list."""
    return cells.groupBy(ASPECT).pivot(PRODUCT, list(products)).agg(F.first("avg_sentiment"))


def product_comparison(df: DataFrame, asins: Sequence[str] | None = None) -> DataFrame:
    """Side-by-side product figures, for the given products or for all."""
    if asins is not None:
        df = df.where(F.col(PRODUCT).isin(list(asins)))
    return df.groupBy(PRODUCT).agg(
        F.max("title").alias("title"),
        F.count(N).alias("mention_count"),
        F.count_distinct("review_id").alias("review_count"),
        F.avg("sentiment_score").alias("avg_sentiment"),
        _pct(C.POSITIVE).alias("pct_positive"),
        _pct(C.NEGATIVE).alias("pct_negative"),
        F.count_distinct(ASPECT).alias("unique_aspects"),
        F.avg("confidence").alias("avg_confidence"),
    )


def category_stats(df: DataFrame) -> DataFrame:
    return (
        cells(df.where(F.col("main_category").isNotNull()), ["main_category", PRODUCT])
        .groupBy(F.col("main_category").alias("category"))
        .agg(
            F.sum("n").alias("mention_count"),
            F.count(PRODUCT).alias("product_count"),
            _mean("s", "sn").alias("avg_sentiment"),
            F.sum("pos").alias("positive_count"),
            F.sum("neg").alias("negative_count"),
            _mean("c", "cn").alias("avg_confidence"),
            _share("pos").alias("pct_positive"),
            _share("neg").alias("pct_negative"),
        )
        .orderBy(F.desc("mention_count"), "category")
    )


def product_cards(df: DataFrame) -> DataFrame:
    """The figures of a product's detail page, for every product."""
    per_aspect = cells(df, [PRODUCT, ASPECT, *INFO]).groupBy(PRODUCT, ASPECT).agg(
        *[F.sum(c).alias(c) for c in ("n", "s", "sn", "pos", "neg")],
        *[F.max(c).alias(c) for c in INFO])
    return per_aspect.groupBy(PRODUCT).agg(
        *[F.max(c).alias(c) for c in INFO],
        F.sum("n").alias("mention_count"),
        _mean("s", "sn").alias("avg_sentiment"),
        _share("pos").alias("pct_positive"),
        _share("neg").alias("pct_negative"),
        F.count(ASPECT).alias("unique_aspects"),
    )


def product_stats(df: DataFrame) -> DataFrame:
    """Per-product counts with the product's metadata, without a join back."""
    return cells(df, [PRODUCT, *INFO]).groupBy(PRODUCT).agg(
        F.sum("n").alias("mention_count"),
        _mean("s", "sn").alias("avg_sentiment_score"),
        F.sum("pos").alias("positive_count"),
        F.sum("neg").alias("negative_count"),
        F.sum("neu").alias("neutral_count"),
        *[F.max(c).alias(c) for c in INFO],
    )


def product_explorer(df: DataFrame, min_mentions: int = 10, rating_range=(1.0, 5.0),
                     search: str | None = None, n: int = 20, products: DataFrame | None = None) -> DataFrame:
    """The ``n`` most reviewed products that pass the filters, with their three most
    frequent positive and negative aspects.

    One cell per (product, aspect) gives statistics and aspect lists; metadata is joined per product.
    """
    from .alerts import product_info

    cell = materialize(cells(df, [PRODUCT, ASPECT]), "cells")
    stats = cell.groupBy(PRODUCT).agg(
        F.sum("n").alias("mention_count"), _mean("s", "sn").alias("avg_sentiment_score"),
        F.sum("pos").alias("positive_count"), F.sum("neg").alias("negative_count"), F.sum("neu").alias("neutral_count"))
    stats = stats.where(F.col("mention_count") >= min_mentions).join(
        product_info(df if products is None else products), PRODUCT).where(F.col("average_rating").between(*rating_range))
    if search:
        stats = stats.where(F.lower("title").contains(search.lower()))
    chosen = stats.orderBy(F.desc("mention_count"), PRODUCT).limit(n)
    own = cell.join(F.broadcast(chosen.select(PRODUCT)), PRODUCT, "left_semi")
    polar = own.select(PRODUCT, ASPECT, F.explode(F.array(
        F.struct(F.lit(C.POSITIVE).alias("sentiment"), F.col("pos").alias("k")),
        F.struct(F.lit(C.NEGATIVE).alias("sentiment"), F.col("neg").alias("k")))).alias("p")).select(
        PRODUCT, ASPECT, "p.*").where("k > 0")
    ranked = top_per_group(polar, [PRODUCT, "sentiment"], [F.desc("k"), ASPECT], 3)

    def names(sentiment):
        entry = F.when(_is(sentiment), F.struct("rank", ASPECT))
        return F.array_join(
            F.transform(F.array_sort(F.collect_list(entry)), lambda s: s[ASPECT]), ", ")

    lists = ranked.groupBy(PRODUCT).agg(
        names(C.POSITIVE).alias("top_positive"), names(C.NEGATIVE).alias("top_negative"))
    return chosen.join(lists, PRODUCT, "left").na.fill("", ["top_positive", "top_negative"])


def product_index(df: DataFrame) -> DataFrame:
    """Products by mention count with their titles."""
    return (df.groupBy(PRODUCT, "title").agg(F.count(N).alias("n"))
            .groupBy(PRODUCT).agg(F.sum("n").alias("mention_count"), F.max("title").alias("title"))
            .orderBy(F.desc("mention_count"), PRODUCT))


def sentiment_trend(df: DataFrame, freq: str = "W") -> DataFrame:
    return df.groupBy(C.period_start("date", freq).alias("period"), "sentiment").agg(
        F.count(N).alias("n"))


def score_trend(df: DataFrame, freq: str = "W") -> DataFrame:
    return df.groupBy(C.period_start("date", freq).alias("period")).agg(
        F.avg("sentiment_score").alias("avg_sentiment"), F.count(N).alias("n"))


def aspect_evolution(df: DataFrame, freq: str = "W", top: int = 5) -> DataFrame:
    """Mentions per period of the most frequent aspects, labelled by the period's end."""
    return (df.transform(restrict_to_top, ASPECT, top)
            .groupBy(C.period_end("date", freq).alias("period"), ASPECT)
            .agg(F.count(N).alias("n")))


def product_aspect_daily(df: DataFrame) -> DataFrame:
    return df.groupBy(PRODUCT, "date", ASPECT).agg(
        F.avg("sentiment_score").alias("avg_sentiment"), F.count(N).alias("n"))


def aspect_by_sentiment(df: DataFrame, top: int = 10) -> DataFrame:
    """Polarity counts of each product's most frequent aspects."""
    counts = df.groupBy(PRODUCT, ASPECT).agg(
        C.count_if(_is(C.POSITIVE)).alias("positive"),
        C.count_if(_is(C.NEGATIVE)).alias("negative"),
        C.count_if(_is(C.NEUTRAL)).alias("neutral"),
        F.count(N).alias("total"),
    )
    return top_per_group(counts, [PRODUCT], [F.desc("total"), ASPECT], top)


# ---------------------------------------------------------------- reviews

def review_aggregate(df: DataFrame, weighted: bool = True) -> DataFrame:
    """One row per review: score, rating, dominant sentiment, aspect count.

    The dominant sentiment of a tie is the alphabetically smallest.  A zero total
    confidence gives a null score.
    """
    score = (F.try_divide(F.sum(F.col("sentiment_score") * F.col("confidence")), F.sum("confidence"))
             if weighted else F.avg("sentiment_score"))
    k = {s: C.count_if(_is(s)) for s in (C.NEGATIVE, C.NEUTRAL, C.POSITIVE)}
    most = F.greatest(*k.values())
    mode = F.when(k[C.NEGATIVE] == most, C.NEGATIVE).when(k[C.NEUTRAL] == most, C.NEUTRAL).otherwise(
        C.POSITIVE)
    extra = [F.max(F.length("text")).alias("review_length")] if "text" in df.columns else []
    return df.groupBy("review_id").agg(
        score.alias("sentiment_score"), F.max("rating").alias("rating"), mode.alias("sentiment"),
        F.count(N).alias("aspect_count"), *extra)


def coherent():
    r, s = F.col("rating"), F.col("sentiment_score")
    return ((r >= 4) & (s > 0)) | ((r <= 2) & (s < 0)) | ((r == 3) & (F.abs(s) < 0.3))


def divergent():
    r, s = F.col("rating"), F.col("sentiment_score")
    return ((r >= 4) & (s < -0.3)) | ((r <= 2) & (s > 0.3))


def coherence_metrics(reviews: DataFrame) -> DataFrame:
    return reviews.agg(
        F.corr("rating", "sentiment_score").alias("pearson"),
        C.percent(C.count_if(coherent()), F.count(N)).alias("coherence_pct"),
        C.percent(C.count_if(divergent()), F.count(N)).alias("divergence_pct"),
        F.avg("aspect_count").alias("avg_aspects"),
        F.count(N).alias("review_count"),
    )


def divergent_reviews(reviews: DataFrame, texts: DataFrame | None = None, n: int = 10) -> DataFrame:
    """Strong mismatches of rating and sentiment, with a text excerpt when given."""
    top = reviews.where(divergent()).orderBy("review_id").limit(n)
    if texts is None:
        return top
    hit = texts.join(F.broadcast(top.select("review_id")), "review_id", "left_semi").select(
        "review_id", F.concat(F.substring("text", 1, 200), F.lit("...")).alias("excerpt"))
    return top.join(hit, "review_id", "left")


def stats_by_rating(reviews: DataFrame) -> DataFrame:
    base = reviews.groupBy("rating").agg(
        F.count("sentiment_score").alias("n"), F.avg("sentiment_score").alias("mean"),
        F.stddev_samp("sentiment_score").alias("std"), F.min("sentiment_score").alias("min"),
        F.max("sentiment_score").alias("max"))
    median = exact_quantiles(reviews, ["rating"], "sentiment_score", {"median": 0.5}).drop("n")
    return base.join(median, "rating").select(
        "rating", "n", *[F.round(c, 3).alias(c) for c in ("mean", "median", "std", "min", "max")])


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, 1.5 IQR fences and the number of points outside them.

    The outliers are counted on the distinct values, not on the rows.
    """
    q = exact_quantiles(df, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    fences = q.withColumns({"lower_fence": F.col("q1") - 1.5 * iqr,
                            "upper_fence": F.col("q3") + 1.5 * iqr})
    counts = distinct_counts(df, [group], value)
    outside = (F.col("v") < F.col("lower_fence")) | (F.col("v") > F.col("upper_fence"))
    out = (counts.join(fences.select(group, "lower_fence", "upper_fence"), group)
           .groupBy(group).agg(F.sum(F.when(outside, F.col("c")).otherwise(0)).alias("outliers")))
    return fences.join(out, group)


def hist2d(df: DataFrame, x: str, y: str, x_range, y_range, nx: int = 10, ny: int = 20) -> DataFrame:
    """Counts on an equal-width grid; the top edge belongs to the last bin."""
    def bin_of(c, lo, hi, k):
        i = F.floor((F.col(c) - lo) * k / (hi - lo))
        return F.greatest(F.least(i, F.lit(k - 1)), F.lit(0)).cast("int")

    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
            .groupBy(bin_of(x, *x_range, nx).alias("x_bin"), bin_of(y, *y_range, ny).alias("y_bin"))
            .agg(F.count(N).alias("n")))


def hist1d(df: DataFrame, value: str, bins: int = 50, cap: float = 0.95) -> DataFrame:
    """Histogram of the values up to the ``cap`` quantile."""
    limit = exact_quantiles(df, [], value, {"cap": cap}).select("cap").scalar()
    kept = df.where(F.col(value) <= limit)
    edges = kept.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("e")).scalar()
    e = edges
    width = e["hi"].cast("double") - e["lo"].cast("double")
    i = F.when(width > 0, F.floor((F.col(value) - e["lo"]) * bins / width)).otherwise(0)
    return (kept.groupBy(F.least(i, F.lit(bins - 1)).cast("int").alias("bin"))
            .agg(F.count(N).alias("n"), F.min(value).cast("double").alias("min_value"),
                 F.max(value).cast("double").alias("max_value")))


# ---------------------------------------------------------------- profiling

def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Nulls, distinct values and numeric summary per column, from one aggregate.

    Exact distinct counts expand every row once per column; ``approximate`` uses sketches
    and suits wide tables.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    numeric = {c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")}
    aggs = [F.count(N).alias("_rows")]
    for c in df.columns:
        aggs += [F.count(c).alias(f"{c}|k"), distinct(c).alias(f"{c}|u")]
        if c in numeric:
            aggs += [F.avg(c).alias(f"{c}|a"), F.min(c).cast("double").alias(f"{c}|lo"),
                     F.max(c).cast("double").alias(f"{c}|hi")]
    null = F.lit(None).cast("double")
    entries = [
        F.struct(
            F.lit(c).alias("column"), F.lit(c in numeric).alias("numeric"),
            (F.col("_rows") - F.col(f"`{c}|k`")).alias("nulls"), F.col(f"`{c}|u`").alias("distinct_values"),
            (F.col(f"`{c}|a`") if c in numeric else null).alias("mean"),
            (F.col(f"`{c}|lo`") if c in numeric else null).alias("min"),
            (F.col(f"`{c}|hi`") if c in numeric else null).alias("max"),
        )
        for c in df.columns
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def reviews_per_period(df: DataFrame, ts: str = "ts", freq: str = "M") -> DataFrame:
    return df.groupBy(C.period_start(F.col(ts).cast("date"), freq).alias("period")).agg(
        F.count(N).alias("n"))


def reviews_per_user(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.count(N).alias("n"))


def impute_rating_median(df: DataFrame) -> DataFrame:
    """Fill a missing rating with the median of its product.

    Only products that miss a rating need a median, and only rows without a rating take
    part in the join.
    """
    missing = df.where(F.col("rating").isNull())
    medians = exact_quantiles(df, [PRODUCT], "rating", {"_median": 0.5}).select(PRODUCT, "_median")
    filled = missing.join(medians, PRODUCT, "left").withColumn("rating", F.col("_median"))
    return df.where(F.col("rating").isNotNull()).unionByName(filled.select(*df.columns))


def inference_summary(scored: DataFrame) -> DataFrame:
    """Totals over rows that carry an ``aspects`` array."""
    k = F.greatest(F.size("aspects"), F.lit(0))
    return scored.agg(F.count(N).alias("reviews"), F.sum(k).alias("total_aspects"),
                      F.avg(k).alias("avg_aspects"))


def forecast_scope(df: DataFrame, min_mentions: int = 50, top: int = 20) -> DataFrame:
    """Aspects frequent enough to forecast, with their share of all mentions."""
    counts = df.groupBy(ASPECT).agg(F.count(N).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return (counts.withColumn("share_pct", F.col("n") * 100.0 / total)
            .where(F.col("n") >= min_mentions).orderBy(F.desc("n"), ASPECT).limit(top))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    cells = df.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(F.count(N).alias("n"))
    hits = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)
    both = cells.select(F.col("l").alias("label"), F.col("n").alias("support"),
                        F.lit(0).cast("bigint").alias("predicted"), hits.alias("tp")).unionByName(
        cells.select(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"),
                     F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))
    s = both.groupBy("label").agg(F.sum("support").alias("support"),
                                  F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    return s.select("label", p.alias("precision"), r.alias("recall"),
                    F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def universal_concerns(df: DataFrame, share: float = 0.7, top: int = 5) -> DataFrame:
    """Each category's most frequent negative aspects, marked universal (in at least
    ``share`` of the categories) or specific (in exactly one)."""
    negative = df.where(_is(C.NEGATIVE) & F.col("main_category").isNotNull())
    counts = negative.groupBy("main_category", ASPECT).agg(F.count(N).alias("n"))
    tops = top_per_group(counts, ["main_category"], [F.desc("n"), ASPECT], top)
    total = counts.agg(F.count_distinct("main_category")).scalar()
    return (
        tops.groupBy(ASPECT)
        .agg(F.count(N).alias("categories"), F.min("main_category").alias("first_category"))
        .withColumns({"universal": F.col("categories") >= total * share,
                      "specific": F.col("categories") == 1})
    )


def duplicate_ratio(df: DataFrame) -> DataFrame:
    """Share of rows that repeat an earlier row in full.

    Rows are told apart by a SHA-256 digest, so the shuffle moves digests, not texts.
    """
    digest = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    groups = df.groupBy(digest.alias("digest")).agg(F.count(N).alias("k"))
    return groups.agg(F.sum("k").alias("row_count"), F.count(N).alias("distinct_rows"),
                      (1 - F.count(N) / F.sum("k")).alias("duplicate_ratio"))


def rating_correlations(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    return df.agg(*[F.corr("rating", m).alias(f"corr_{m}") for m in measures])
