"""From raw aspect mentions to the clean fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L

WHITESPACE = " \t\n\r\f"
MENTION_ORDER = ("pos", "aspect_term", "sentiment", "confidence", "timestamp")


def _strip(c):
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(WHITESPACE))


def normalize_aspects(df: DataFrame, term: str = "aspect_term",
                      out: str = "aspect_term_normalized", variants=None) -> DataFrame:
    """Map every surface term to its canonical aspect; unknown terms stand for themselves.

    The dictionary has a fixed size (79 entries as shipped), so it is broadcast.
    """
    mapping = L.aspect_map(df.sparkSession, variants)
    raw = F.lower(_strip(term))
    return (
        df.withColumn("_raw", raw)
        .join(F.broadcast(mapping), F.col("_raw") == F.col("variant"), "left")
        .withColumn(out, F.coalesce("canonical", "_raw"))
        .drop("_raw", "variant", "canonical")
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key: the first in ``order``.

    ``row_number() <= 1`` is planned with a group limit ahead of the shuffle, so a hot
    key sends one row per task, not all its rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int,
                  rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def dedup_mentions(df: DataFrame,
                   keys: Sequence[str] = ("review_id", "aspect_term_normalized"),
                   order: Sequence[str] = MENTION_ORDER) -> DataFrame:
    """Keep the first mention of an aspect in a review."""
    return keep_first(df, keys, [c for c in order if c in df.columns])


def dedup_products(products: DataFrame) -> DataFrame:
    """One metadata row per product key, in the order of all other columns."""
    rest = [c for c in products.columns if c != "parent_asin"]
    return keep_first(products, ["parent_asin"], rest)


def merge_metadata(mentions: DataFrame, products: DataFrame, unique: bool = False) -> DataFrame:
    """Left join of product metadata with a ``has_metadata`` flag.

    Clashing names get the suffixes ``_review`` and ``_product``.  A duplicated product
    key fans out unless ``unique`` is set.  There is no broadcast hint: the optimizer
    broadcasts the product table when its measured size allows and otherwise runs a
    shuffled join whose hot keys the adaptive skew join splits.
    """
    if unique:
        products = dedup_products(products)
    left = mentions.withColumn("parent_asin", _strip("parent_asin"))
    right = products.withColumn("parent_asin", _strip("parent_asin"))
    for name in set(left.columns) & set(right.columns) - {"parent_asin"}:
        left = left.withColumnRenamed(name, f"{name}_review")
        right = right.withColumnRenamed(name, f"{name}_product")
    title = "title" if "title" in right.columns else "title_product"
    return left.join(right, "parent_asin", "left").withColumn(
        "has_metadata", F.col(title).isNotNull()
    )


def metadata_coverage(merged: DataFrame) -> DataFrame:
    """How many mentions found metadata."""
    hit = C.count_if(F.col("has_metadata"))
    return merged.agg(
        F.count(F.lit(1)).alias("mention_count"),
        hit.alias("with_metadata"),
        (F.count(F.lit(1)) - hit).alias("without_metadata"),
        C.percent(hit, F.count(F.lit(1))).alias("coverage_pct"),
    )


def min_confidence(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.where(F.col("confidence") >= threshold)


def exclude_generic(df: DataFrame, words: Sequence[str] | None = None,
                    aspect: str = "aspect_term_normalized") -> DataFrame:
    """Drop aspects that carry no meaning (null aspects stay)."""
    words = list(words or L.EXCLUDED_ASPECTS)
    return df.where(F.coalesce(~F.col(aspect).isin(words), F.lit(True)))


def derive(df: DataFrame) -> DataFrame:
    """Signed score, calendar fields and polarity flags."""
    return C.calendar_fields(df.withColumn("sentiment_score", C.sentiment_score())).withColumns(
        C.sentiment_flags()
    )


def clean_mentions(mentions: DataFrame, threshold: float = 0.5, exclude=None) -> DataFrame:
    """Normalise, de-duplicate, filter, derive.

    De-duplication comes before the confidence filter on purpose: a weak first mention
    hides a stronger later one.
    """
    return (
        mentions.transform(normalize_aspects)
        .transform(dedup_mentions)
        .transform(min_confidence, threshold)
        .transform(exclude_generic, exclude)
        .transform(derive)
    )


def preprocess(mentions: DataFrame, products: DataFrame, threshold: float = 0.5,
               exclude=None) -> DataFrame:
    """The complete preprocessing plan.

    Metadata is joined after the filters, to the rows that survive, with one metadata
    row per product; de-duplication would remove any fan-out anyway, so the result is
    the one of joining first.
    """
    return clean_mentions(mentions, threshold, exclude).transform(
        merge_metadata, products, unique=True
    )


# ---------------------------------------------------------------- report

def aspect_reduction(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Distinct aspects before and after normalisation."""
    before = original.agg(F.count_distinct(F.lower("aspect_term")).alias("v"))
    after = cleaned.agg(F.count_distinct("aspect_term_normalized").alias("v"))
    both = before.select(F.col("v").alias("b"), F.lit(None).cast("bigint").alias("a")).unionByName(
        after.select(F.lit(None).cast("bigint").alias("b"), F.col("v").alias("a"))
    )
    return both.agg(F.max("b").alias("original_aspects"), F.max("a").alias("normalized_aspects")
                    ).select(
        "original_aspects",
        "normalized_aspects",
        (F.col("original_aspects") - F.col("normalized_aspects")).alias("reduction"),
        C.percent(F.col("original_aspects") - F.col("normalized_aspects"),
                  F.col("original_aspects")).alias("reduction_pct"),
    )


def aspect_variants(cleaned: DataFrame, top: int = 10, samples: int = 5) -> DataFrame:
    """Canonical aspects that absorbed several variants, with sample variants."""
    pairs = cleaned.groupBy("aspect_term_normalized", "aspect_term").agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = pairs.withColumns(
        {
            "k": F.row_number().over(
                Window.partitionBy("aspect_term_normalized").orderBy("aspect_term")
            ),
        }
    )
    return (
        ranked.groupBy("aspect_term_normalized")
        .agg(
            F.count(F.lit(1)).alias("variant_count"),
            F.array_join(
                F.array_sort(F.collect_list(F.when(F.col("k") <= samples, F.col("aspect_term")))),
                ", ",
            ).alias("sample_variants"),
        )
        .where("variant_count > 1")
        .orderBy(F.desc("variant_count"), "aspect_term_normalized")
        .limit(top)
    )


def unmapped_aspects(cleaned: DataFrame, top: int = 20) -> DataFrame:
    """Most frequent aspects that equal their own raw spelling."""
    same = F.col("aspect_term_normalized") == F.lower(_strip("aspect_term"))
    return (
        cleaned.where(same)
        .groupBy("aspect_term_normalized")
        .agg(F.count(F.lit(1)).alias("mention_count"))
        .orderBy(F.desc("mention_count"), "aspect_term_normalized")
        .limit(top)
    )


def normalization_report(original: DataFrame, cleaned: DataFrame, top: int = 20) -> DataFrame:
    """All report sections in one long table ``(section, item, value)``."""
    reduction = aspect_reduction(original, cleaned).select(
        F.lit("reduction").alias("section"),
        F.explode(
            F.create_map(
                F.lit("original_aspects"), F.col("original_aspects").cast("double"),
                F.lit("normalized_aspects"), F.col("normalized_aspects").cast("double"),
                F.lit("reduction"), F.col("reduction").cast("double"),
                F.lit("reduction_pct"), F.col("reduction_pct"),
            )
        ).alias("item", "value"),
    )
    tops = (
        cleaned.groupBy("aspect_term_normalized").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "aspect_term_normalized").limit(top)
        .select(F.lit("top_aspects").alias("section"), F.col("aspect_term_normalized").alias("item"),
                F.col("n").cast("double").alias("value"))
    )
    variants = aspect_variants(cleaned).select(
        F.lit("variants").alias("section"), F.col("aspect_term_normalized").alias("item"),
        F.col("variant_count").cast("double").alias("value"),
    )
    unmapped = unmapped_aspects(cleaned, top).select(
        F.lit("unmapped").alias("section"), F.col("aspect_term_normalized").alias("item"),
        F.col("mention_count").cast("double").alias("value"),
    )
    return reduction.unionByName(tops).unionByName(variants).unionByName(unmapped)
