"""Fake-review flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L


def user_flags(df: DataFrame, max_reviews: int = 100, min_reviews: int = 1) -> DataFrame:
    """Users to suspect: too many reviews, or the same rating every time."""
    return (
        df.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.count("asin").alias("user_reviews"), F.min("rating").alias("lo"),
             F.max("rating").alias("hi"))
        .withColumn("behavior", (F.col("user_reviews") > max_reviews)
                    | (F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
                       & (F.col("user_reviews") >= min_reviews)))
        .where("behavior")
        .select("user_id", "behavior")
    )


def detect_fake_reviews(df: DataFrame, max_words: int = 500, max_exclamations: int = 5,
                        max_user_reviews: int = 100, min_user_reviews: int = 1,
                        strict_compat: bool = False) -> DataFrame:
    """Content, behaviour and trust flags and their combination.

    Exclamation marks are counted on the raw text; ``strict_compat`` counts them on the
    cleaned text, where none can be left.  Per-user facts come from one aggregate; the
    join back carries only suspected users, and a hot user's rows are split by the
    adaptive skew join.
    """
    clean = C.clean_text_basic(C.review_full())
    marks = F.regexp_count(F.lit("") if strict_compat else C.review_full(), F.lit("!"))
    tech = F.col("review_clean").rlike("|".join(L.JARGON_WORDS))
    base = df.withColumn("review_clean", clean).withColumns(
        {
            "review_length": F.length("review_clean"),
            "word_count": F.size(C.words("review_clean")),
            "tech_flag": tech,
            "exclamation_flag": marks > max_exclamations,
        }
    )
    content = ((F.col("word_count") > max_words)
               | F.col("review_clean").rlike("great great|buy buy")
               | F.col("tech_flag") | F.col("exclamation_flag"))
    trust = (F.col("unverified_flag") & F.col("no_helpful_flag") & F.col("no_image_flag"))
    return (
        base.join(user_flags(df, max_user_reviews, min_user_reviews), "user_id", "left")
        .withColumns({
            "content_flag": content,
            "behavior_flag": F.coalesce("behavior", F.lit(False)),
            "unverified_flag": ~F.coalesce("verified_purchase", F.lit(True)),
            "no_helpful_flag": F.coalesce("helpful_vote", F.lit(0)) == 0,
            "no_image_flag": F.col("images").isNull(),
        })
        .withColumn("fake_flag", F.col("content_flag") | F.col("behavior_flag") | trust)
        .drop("behavior")
    )


def rating_mismatch(df: DataFrame, polarity: str = "polarity") -> DataFrame:
    """Ratings that contradict the polarity of the text."""
    r, p = F.col("rating"), F.col(polarity)
    return df.withColumn("mismatch", F.coalesce(((r >= 4) & (p < 0)) | ((r <= 2) & (p > 0)),
                                                F.lit(False)))
