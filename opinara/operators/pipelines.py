"""Whole preparation pipelines, as functions from DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import filters, preprocess
from .analytics import impute_rating_median
from .text import explode_aspects, nfkc


def advanced_preprocess(reviews: DataFrame, text: str = "text", date: str = "date", key: str = "review_id") -> DataFrame:
    """Ratings imputed by product median, rows without text or date dropped, repeats of a review removed (the earliest
    stays; texts travel as digests), suspicious rows dropped, text normalised (NFKC) and cleaned."""
    rows = impute_rating_median(reviews).transform(filters.require_non_null, [text, date])
    rows = preprocess.keep_first(rows.withColumn("_digest", F.sha2(text, 256)), [key, "_digest"], [date]).drop("_digest")
    rows = rows.transform(filters.drop_suspicious)
    return nfkc(rows, text).withColumn(text, C.clean_text_full(text))


def explore_preprocess(reviews: DataFrame) -> DataFrame:
    """Title and text joined and cleaned, with lengths; rows without product or rating dropped, unknown keys filled."""
    rows = reviews.withColumn("review_clean", C.clean_text_basic(C.review_full()))
    rows = rows.transform(filters.require_non_null, ["asin", "rating"]).transform(filters.fill_unknown)
    return rows.withColumns({"review_length": F.length("review_clean"), "word_count": F.size(C.words("review_clean"))})


def scored_to_mentions(scored: DataFrame, products: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Scored reviews to clean mentions: one row per aspect, normalised, de-duplicated, filtered, with derived fields,
    and with product metadata if a product table is given."""
    rows = (explode_aspects(scored).transform(preprocess.normalize_aspects)
            .transform(preprocess.dedup_mentions, order=["pos"])
            .transform(preprocess.min_confidence, threshold).transform(preprocess.exclude_generic))
    rows = rows.withColumn("sentiment_score", C.sentiment_score()).withColumns(C.sentiment_flags())
    return rows if products is None else preprocess.merge_metadata(rows, products)
