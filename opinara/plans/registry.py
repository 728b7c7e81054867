"""Named queries and the SQL each one must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, prepare
from ..sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round doubles so that summation order cannot show."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean mentions without product metadata."""
    from ..operators.preprocess import clean_mentions

    return clean_mentions(fx.mentions(spark, sf_dir))


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean mentions with product metadata."""
    from ..operators.preprocess import preprocess

    return preprocess(fx.mentions(spark, sf_dir), fx.products(spark, sf_dir))


ANALYSED = ("parent_asin", "aspect_term_normalized", "date", "sentiment", "sentiment_score",
            "confidence", "title", "main_category", "average_rating")


def table(df: DataFrame, *cols: str) -> DataFrame:
    """Write the columns a query needs once, when it reads them several times."""
    return materialize(df.select(*cols) if cols else df, "mentions")
