"""Explicit schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

ASPECT = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
ASPECTS = T.ArrayType(ASPECT)

REVIEWS = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField(
            "images",
            T.ArrayType(T.StructType([T.StructField("small_image_url", T.StringType())])),
        ),
        T.StructField("asin", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("helpful_vote", T.IntegerType()),
        T.StructField("verified_purchase", T.BooleanType()),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("parent_asin", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("main_category", T.StringType()),
        T.StructField("average_rating", T.DoubleType()),
        T.StructField("price", T.StringType()),
    ]
)

SCORED = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("aspects_json", T.StringType()),
    ]
)

EVIDENCE = T.StructType(
    [T.StructField("index", T.IntegerType()), T.StructField("excerpt", T.StringType())]
)
STRUCTURED_ANSWER = T.StructType(
    [
        T.StructField("summary", T.StringType()),
        T.StructField("pros", T.ArrayType(T.StringType())),
        T.StructField("cons", T.ArrayType(T.StringType())),
        T.StructField("evidence", T.ArrayType(EVIDENCE)),
    ]
)

CORPUS = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("text_preview", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
