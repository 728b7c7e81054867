"""Views that give the driver's tables the shape of reviews, mentions and products.

Every view covers its whole table.  ``plans.base_sql`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from .readers import spread

# Raw aspect spellings handed out by part key; with case and space variants, synonyms,
# generic words and words the dictionary does not know.
TERMS = [" Color ", "COLOURS", "shade", "quality", "Qualities", "smell", "scent", "fragrance",
         "price", "value", "cost", "package", "box", "texture", "feel", "size", "amount",
         "bottle", "jar", "product", "item", "use", "application", "skin", "hair", "effect",
         "results", "ingredient", "formula", "brand", "delivery", "shipping", "lasting",
         "Longevity", "thing", "it", "durability", "design", "cap", "pump"]
LATE_TERM, LATE_FROM = "refill", "2001-10-05"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.sql(
        "select * from values "
        + ", ".join(f"({i}, {L.quote(t)})" for i, t in enumerate(TERMS))
        + " as t(ix, term)"
    )
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rating = (F.col("l_orderkey") % 5 + 1).cast("double")
    late = (F.col("term") == "pump") & (F.col("l_shipdate").cast("date") >= F.lit(LATE_FROM).cast("date"))
    return (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(F.broadcast(terms), F.col("l_partkey") % len(TERMS) == F.col("ix"))
        .select(
            F.col("l_orderkey").cast("string").alias("review_id"),
            (F.col("o_custkey") * 2).cast("string").alias("parent_asin"),
            F.concat(F.lit("u"), F.floor(F.col("l_orderkey") / 3).cast("string")).alias("user_id"),
            rating.alias("rating"),
            F.col("l_shipdate").alias("timestamp"),
            F.col("l_linenumber").alias("pos"),
            F.when(late, LATE_TERM).otherwise(F.col("term")).alias("aspect_term"),
            F.when(F.col("l_returnflag") == "R", "Negative")
            .when(F.col("l_returnflag") == "N", "Positive")
            .when(rating >= 4, "Positive")
            .when(rating <= 2, "Negative")
            .otherwise("Neutral")
            .alias("sentiment"),
            (F.col("l_quantity") / 50.0).alias("confidence"),
            (F.col("l_linestatus") == "F").alias("verified_purchase"),
            (F.col("l_linenumber") - 1).alias("helpful_vote"),
        )
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("parent_asin"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("main_category"),
        (1 + (F.col("p_size") % 41) / 10.0).alias("average_rating"),
        F.when(F.col("p_partkey") % 7 == 0, "None")
        .otherwise(F.col("p_retailprice").cast("string")).alias("price"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews, with gaps in every nullable column."""
    d = F.col("doc_id")
    return documents(spark, sf_dir).select(
        d.cast("string").alias("review_id"),
        F.when(d % 11 != 0, (d % 5 + 1).cast("double")).alias("rating"),
        F.when(d % 10 != 0, F.concat(F.lit("Notes from "), F.col("source"))).alias("title"),
        F.col("text"),
        F.when(d % 2 != 0, F.array(F.struct(F.lit("img").alias("small_image_url")))).alias("images"),
        F.when(d % 13 == 0, "bad asin")
        .otherwise(F.concat(F.lit("B"), F.lpad((d % 200).cast("string"), 9, "0"))).alias("asin"),
        F.when(d % 17 != 0, F.concat(F.lit("B"), F.lpad((d % 20).cast("string"), 9, "0")))
        .alias("parent_asin"),
        F.when(d % 19 != 0, F.concat(F.col("lang"), F.lit("-"), (d % 97).cast("string")))
        .alias("user_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (d % 366).cast("int")).alias("date"),
        F.when(d % 4 != 3, (d % 4).cast("int")).alias("helpful_vote"),
        (d % 3 != 0).alias("verified_purchase"),
        F.col("lang"),
    )


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one review each, for user behaviour and streams."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("review_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("parent_asin"),
        (F.col("event_id") % 5 + 1).cast("double").alias("rating"),
        F.col("event_type").alias("main_category"),
        F.col("value"),
        F.col("ts"),
    )
