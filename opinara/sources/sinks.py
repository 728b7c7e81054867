"""Table writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import scrub_pii
from ..operators.preprocess import top_per_group
from ..session import materialize
from .readers import path_exists


def write_results(df: DataFrame, path: str, fmt: str = "csv", ts: str = "timestamp") -> None:
    """Scored rows in one folder per year and month; months that ``df`` does not hold stay as they are."""
    writer = df.withColumns({"year": F.year(ts), "month": F.month(ts)}).write.mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "dynamic")
    writer = writer.partitionBy("year", "month").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)


def unseen(df: DataFrame, existing: DataFrame | None, key: str | list[str] = "review_id") -> DataFrame:
    """Rows whose key the existing output lacks."""
    keys = [key] if isinstance(key, str) else key
    return df if existing is None else df.join(existing.select(*keys), keys, "left_anti")


def append_incremental(df: DataFrame, path: str, ts: str = "timestamp",
                       key: str = "review_id", fixed_month: bool = False) -> None:
    """Append the rows that are not in the output yet, one folder per month; rows without a date share one.

    Of rows that share a key in one batch the earliest stays.  Keys are compared with the key column of all months;
    rows without a key are compared by their whole content.  ``fixed_month`` states that a key never changes its month:
    then only the months of the batch are read.  Running it again adds nothing, so an interrupted run can simply be repeated.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c != "year_month"]

    def content(rows: DataFrame) -> DataFrame:
        body = F.struct(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in names])
        return rows.withColumn("_content", F.when(F.col(key).isNull(), F.sha2(F.to_json(body), 256)))

    batch = top_per_group(content(df), [key, "_content"], [ts], 1).drop("rank")
    month = batch.withColumn("year_month", F.date_format(ts, "yyyy-MM"))
    if path_exists(spark, path):
        old = spark.read.parquet(path)
        if fixed_month:
            found = F.col("year_month").cast("string") if "year_month" in old.columns else F.date_format(ts, "yyyy-MM")
            # as many values as the batch has months: the calendar bounds them, and partitions are pruned by them
            months = [r[0] for r in month.select("year_month").distinct().collect()]
            old = old.where(found.isin([m for m in months if m]) | (found.isNull() if None in months else F.lit(False)))
        nameless = content(old.where(F.col(key).isNull()))
        month = unseen(month.where(F.col(key).isNotNull()), old, key).unionByName(
            unseen(month.where(F.col(key).isNull()), nameless, "_content"))
    month.drop("_content").write.mode("append").partitionBy("year_month").parquet(path)


def save_preprocessed(df: DataFrame, path: str) -> None:
    """Format by file extension: csv or json, else Parquet by month."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif path.endswith(".json"):
        df.write.mode("overwrite").json(path)
    elif "year_month" in df.columns:
        df.write.mode("overwrite").partitionBy("year_month").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "json") -> list[str]:
    """One folder per named table; empty tables are left out.  Returns the names written.

    A table is computed once, into the scratch folder, before it is looked at.
    """
    written = []
    for name, table in tables.items():
        table = materialize(table, "report")
        if table.isEmpty():
            continue
        writer = table.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.save(f"{path}/{name}")
        written.append(name)
    return written


def persist_embeddings(df: DataFrame, path: str, overwrite: bool = False, text: str = "text",
                       preview: int = 300) -> str:
    """Vectors with key, product, date and a scrubbed text preview.

    Returns ``"exists"`` when a table is there and may not be replaced.
    """
    if path_exists(df.sparkSession, path) and not overwrite:
        return "exists"
    df.select(
        F.col("review_id").cast("string").alias("review_id"),
        F.col("parent_asin").cast("string").alias("parent_asin"),
        F.col("date").cast("date").alias("date"),
        F.substring(scrub_pii(text), 1, preview).alias("text_preview"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    ).write.mode("overwrite").parquet(path)
    return "written"
