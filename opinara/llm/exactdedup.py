"""Exact de-duplication by 128-bit content hash, with built-in functions only.

Two texts are equal when they are the same after every blank (space, tab, line feed, vertical tab, form feed,
carriage return) is deleted; a null text counts as empty. Of equal texts the row with the most characters in
the original text stays, then the one with the smallest id.

Rows meet under their 128-bit hash *and* the blank-free bytes, so texts that only collide stay apart. Spark
combines copies in each map task before the shuffle: a group that holds a third of all rows arrives as one
row per task. The large side of the join back to the rows holds ids and digests, never texts, and adaptive
execution can split a hot digest there.

Defined results: an empty table gives an empty one; a null id loses against every other id, and names its
group only when nothing else does (`keep_id` is then null); rows that repeat both id and text are reported
each, under one `keep_id`, and `drop_copies` keeps a single one of them. Columns beside the id and the text
take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed value: the characters that do not count
BLANKS = " \t\n\x0b\x0c\r"

_STEP = "100000000000000000000"    # 10^20: one more character outweighs any id
_TOP = "10000000000000000000"      # 10^19: beyond any id


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken or f"{name}_kept" in taken:
        name = f"_{name}"
    return name


def blank_free(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def _rank(chars: Column, key: Column) -> Column:
    """Characters first, then smaller id, in one decimal: it fits a hash aggregate, a struct would need a sort."""
    below = F.lit(_TOP).cast("decimal(20,0)") - key.cast("decimal(19,0)")
    return (chars.cast("decimal(10,0)") * F.lit(_STEP).cast("decimal(21,0)")
            + F.coalesce(below.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))).cast("decimal(38,0)")


def _digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    bare = docs.select(F.col(key).alias("_id"), blank_free(text).alias("_bare"),
                       F.length(F.coalesce(F.col(text), F.lit(""))).alias("_chars"))
    return bare.select("_id", "_chars", "_bare", F.unhex(F.md5("_bare")).alias("_h"),
                       F.sha2("_bare", 256).alias("_sha"))


def group_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, keep_id, group_size, kept, text_sha256."""
    rows = _digests(docs, key, text)
    rest = F.col("_best") % F.lit(_STEP).cast("decimal(21,0)")
    groups = (
        rows.groupBy("_h", "_sha", "_bare")
        .agg(F.count("*").alias("group_size"), F.max(_rank(F.col("_chars"), F.col("_id"))).alias("_best"))
        .select("_h", "_sha", "group_size",
                F.when(rest > 0, (F.lit(_TOP).cast("decimal(20,0)") - rest).cast("bigint")).alias("keep_id"))
    )
    return (
        rows.select("_id", "_h", "_sha").join(groups, ["_h", "_sha"])
        .select(F.col("_id").alias(key), "keep_id", "group_size",
                F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    id_, sha, nth = (unused(docs, name) for name in ("keep_id", "sha", "nth"))
    kept = group_copies(docs, key, text).where("kept").select(
        F.col(key).alias(id_), F.col("text_sha256").alias(sha + "_kept")).distinct()
    rows = docs.withColumn(sha, F.sha2(blank_free(text), 256))
    stay = rows.join(kept, rows[key].eqNullSafe(kept[id_]) & (rows[sha] == kept[sha + "_kept"]), "left_semi")
    # the join has already brought equal (id, text) rows together: no further shuffle
    first = Window.partitionBy(key, sha).orderBy(F.length(text).desc_nulls_last(), text)
    return stay.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth, sha)


def sql(table: str = "documents") -> str:
    """The same rows in DuckDB SQL."""
    return f"""
        with bare as (
            select doc_id, length(coalesce(text, '')) as chars,
                   regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as body
            from {table}
        ), ranked as (
            select doc_id, body, count(*) over (partition by body) as group_size,
                   first_value(doc_id) over (partition by body order by chars desc, doc_id) as keep_id
            from bare
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256
        from ranked"""
