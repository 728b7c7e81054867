"""Row filters and projections over reviews and mentions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def filter_year_month(df: DataFrame, year: int, month: int | None = None,
                      ts: str = "timestamp") -> DataFrame:
    """Calendar filter written as a range, so the file scan can skip row groups."""
    start = date(year, month or 1, 1)
    if month is None:
        end = date(year + 1, 1, 1)
    else:
        end = date(year + month // 12, month % 12 + 1, 1)
    low, high = (F.lit(d.isoformat()).cast(df.schema[ts].dataType) for d in (start, end))
    return df.where((F.col(ts) >= low) & (F.col(ts) < high))


def verified_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("verified_purchase"))


def require_non_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def empty_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Rows whose text is missing or blank."""
    return df.where(F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"\s+", "") == "")


def filter_by_date_range(df: DataFrame, start: str, end: str, col: str = "date") -> DataFrame:
    """Both ends inclusive."""
    return df.where(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def filter_dims(df: DataFrame, category: str = "All", asin: str = "All",
                sentiment: str = "All") -> DataFrame:
    """Equality filters; "All" (or None) leaves a dimension open."""
    for col, value in (("main_category", category), ("parent_asin", asin), ("sentiment", sentiment)):
        if value not in (None, "All"):
            df = df.where(F.col(col) == value)
    return df


def apply_global_filters(df: DataFrame, start: str, end: str, min_confidence: float = 0.5,
                         category: str = "All", asin: str = "All",
                         sentiment: str = "All") -> DataFrame:
    return (
        df.transform(filter_by_date_range, start, end)
        .where(F.col("confidence") >= min_confidence)
        .transform(filter_dims, category, asin, sentiment)
    )


def title_search(df: DataFrame, term: str, col: str = "title") -> DataFrame:
    """Case-insensitive substring match; a missing title does not match."""
    return df.where(F.lower(F.col(col)).contains(term.lower()))


def suspicious(text: str = "text", rating: str = "rating"):
    """Abnormal length, or praise with one star, or "terrible" with five."""
    t, r = F.lower(F.coalesce(F.col(text), F.lit(""))), F.col(rating)
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    odd = (n < 10) | (n > 2000)
    mismatch = ((r == 1) & t.contains("great")) | ((r == 5) & t.contains("terrible"))
    return F.coalesce(odd | mismatch, odd)


def drop_suspicious(df: DataFrame, text: str = "text", rating: str = "rating") -> DataFrame:
    return df.where(~suspicious(text, rating))


def fill_unknown(df: DataFrame, cols: Sequence[str] = ("parent_asin", "user_id")) -> DataFrame:
    return df.fillna("UNKNOWN", subset=list(cols))


def validate_reviews(df: DataFrame) -> DataFrame:
    """Documented input rules: entities decoded, short texts dropped, ratings outside
    1-5 nulled, vote text split into two numbers, malformed product ids flagged, and a
    fixed column order."""
    text = F.trim(F.regexp_replace(C.decode_entities("text"), r"\s+", " "))
    rating = F.col("rating").cast("double")
    votes = F.col("helpful_vote").cast("string")
    return (
        df.withColumns(
            {
                "text": text,
                "rating": F.when(rating.between(1.0, 5.0), rating),
                "helpful_yes": F.regexp_extract(votes, r"(\d+)", 1).try_cast("int"),
                "helpful_total": F.regexp_extract(votes, r"\d+\s+out of\s+(\d+)", 1).try_cast("int"),
                "valid_asin": F.col("parent_asin").rlike("^[A-Za-z0-9]{10}$"),
                "has_title": F.length(F.trim(F.coalesce("title", F.lit("")))) > 0,
                "quarter": F.quarter("timestamp"),
            }
        )
        .where(F.length("text") >= 10)
        .select("review_id", "parent_asin", "rating", "timestamp", "text", "title",
                "verified_purchase", "user_id", "helpful_yes", "helpful_total", "valid_asin",
                "has_title", "quarter")
    )
