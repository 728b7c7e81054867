"""Table scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import parse_timestamp
from ..schemas import CORPUS, PRODUCTS, REVIEWS, SCORED


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines reviews; the timestamp may be epoch milliseconds or text."""
    return spark.read.schema(REVIEWS).json(path).withColumn("timestamp", parse_timestamp("timestamp"))


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRODUCTS).parquet(path)


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """Preprocessed mentions with their time columns typed."""
    df = spark.read.parquet(path)
    types = {"timestamp": "timestamp", "date": "date"}
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


def read_scored_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scored reviews from CSV; ids stay text, quoted fields may hold line breaks."""
    return (spark.read.schema(SCORED).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Distribute a scan that has fewer tasks than the cluster has cores.

    A table of many files is left alone; one that sits in a few row groups would keep
    most cores idle in every step before the first shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def load_embeddings(spark: SparkSession, path: str) -> DataFrame | None:
    """The persisted vector table, or None when there is none yet."""
    if not path_exists(spark, path):
        return None
    return spark.read.schema(CORPUS).parquet(path)
