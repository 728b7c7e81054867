"""Sharding by extendible hashing: every shard below a byte limit, and only oversized buckets split.

A document's place is the bits of a hash of its id. The directory is indexed by the first bits of it; a bucket of local
depth d holds all documents whose first d bits agree. A bucket above the limit is split on its next bit, others stay as they
are. The result is a fixed point: a document's bucket is the shortest prefix of its hash whose total fits the limit (or that
holds a single key). It is found without moving texts: documents are reduced to (hash, bytes), those to totals per
cell of a fine prefix, a few cells per shard; cells are rolled up to all shorter prefixes at once. Cells
that are still too large are looked at again with more bits, until everything fits or the bits are used up.

Equal keys cannot be told apart by a hash: if one key's rows are larger than the limit, their bucket says so in `oversize`, as
does a bucket with one larger document. No row is left out.

Defined results: a null text has no bytes; a null id is hashed as empty text; rows that repeat an id share a shard; an empty
table gives an empty result and no directory; extra columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

LIMIT = 16 << 20
BITS = 60
CELLS_PER_SHARD = 16    # fine cells for every shard that is expected
MORE_BITS = 8           # added when a cell is still too large


def hash_bits(key: str) -> Column:
    """The first 60 bits of the md5 of the id as text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _shift(value: str, drop: Column | int) -> Column:
    """`value` without its last `drop` bits."""
    return F.call_function("shiftright", F.col(value), (drop if isinstance(drop, Column) else F.lit(drop)).cast("int"))


def buckets(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Leaves of the directory from (h, bytes) rows: depth, prefix, shard_bytes, shard_docs, oversize."""
    total, n = sizes.agg(F.sum("bytes"), F.count("*")).first()
    if not n:
        return sizes.sparkSession.createDataFrame([], "depth int, prefix bigint, shard_bytes bigint, shard_docs bigint, oversize boolean")
    fine = min(BITS, max(1, math.ceil(math.log2(max(1.0, (total or 0) / limit) * CELLS_PER_SHARD))))
    low, rows, leaves = 0, sizes, None
    while True:
        # totals per cell, then of all its prefixes from the last depth on: cells only, never documents
        cells = rows.groupBy(_shift("h", BITS - fine).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("least"), F.max("h").alias("most"))
        cells = materialize(cells, "cells")
        depth = F.explode(F.sequence(F.lit(low), F.lit(fine))).alias("depth")
        tree = cells.select("*", depth).groupBy(
            "depth", _shift("cell", F.lit(fine) - F.col("depth")).alias("prefix")).agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"),
            F.min("least").alias("least"), F.max("most").alias("most"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("least") == F.col("most"))
        tree = materialize(tree.withColumn("fits", fits), "tree")
        up = tree.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        split = tree.where("fits").withColumn("parent", _shift("prefix", 1))
        leaf = split.join(up, ["depth", "parent"], "left_semi")
        # what fits at the first depth of a round has no parent in it: the parents were too large before, or there are none
        leaf = leaf.unionByName(split.where(F.col("depth") == low))
        leaf = leaf.select("depth", "prefix", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversize"))
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        large = tree.where((F.col("depth") == fine) & ~F.col("fits")).select("prefix")
        if fine >= BITS or large.isEmpty():
            return leaves
        rows = rows.withColumn("prefix", _shift("h", BITS - fine)).join(large, "prefix", "left_semi").drop("prefix")
        low, fine = fine + 1, min(BITS, fine + MORE_BITS)


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, n_bytes, shard_id (the prefix as bits), depth, shard_bytes, shard_docs, oversize."""
    sized = materialize(docs.select(F.col(key).alias("_id"), hash_bits(key).alias("h"),
                                    F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes")), "sizes")
    leaves = materialize(buckets(sized.select("h", "bytes"), limit), "leaves")
    depths = [r["depth"] for r in leaves.select("depth").distinct().collect()]  # at most BITS + 1
    # a document meets its leaf under one of the few depths that occur
    tries = sized.select("*", F.explode(F.array(*[F.lit(d) for d in sorted(depths)] or [F.lit(0)])).alias("depth")).withColumn(
        "prefix", _shift("h", F.lit(BITS) - F.col("depth")))
    name = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return tries.join(leaves, ["depth", "prefix"]).select(
        F.col("_id").alias(key), F.col("bytes").alias("n_bytes"), name.alias("shard_id"), "depth", "shard_bytes",
        "shard_docs", "oversize")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Write the rows of each shard into a folder of its own, with the directory beside them."""
    shards = assign(docs, limit, key, text)
    placed = shards.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), "shard_id").distinct()
    rows = docs.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit(""))).join(placed, "_key").drop("_key")
    n = max(1, shards.select("shard_id").distinct().count())
    rows.repartition(n, "shard_id").withColumn("shard_id", F.concat(F.lit("b"), "shard_id")).write.partitionBy(
        "shard_id").parquet(f"{path}/shards")
    shards.groupBy("shard_id", "depth").agg(F.first("shard_bytes").alias("shard_bytes"), F.first("shard_docs").alias(
        "shard_docs"), F.first("oversize").alias("oversize")).write.parquet(f"{path}/directory")


def sql(limit: int = LIMIT, table: str = "documents") -> str:
    """The rows of `assign` in DuckDB SQL: the shortest prefix that fits."""
    return f"""
        with sized as (
            select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h,
                   coalesce(strlen(text), 0) as n_bytes from {table}
        ), tries as (select *, d::int as depth, h >> ({BITS} - d)::int as prefix from sized, range(0, {BITS} + 1) r(d)),
        totals as (
            select depth, prefix, sum(n_bytes)::bigint as shard_bytes, count(*) as shard_docs, min(h) = max(h) as one
            from tries group by all
        ), fitting as (select * from totals where shard_bytes <= {limit} or one),
        first as (select doc_id, h, n_bytes, min(depth) as depth from tries join fitting using (depth, prefix) group by all)
        select doc_id, n_bytes, case when depth = 0 then '' else right(lpad(bin(h), {BITS}, '0')[1:depth], depth) end as shard_id,
               depth, shard_bytes, shard_docs, shard_bytes > {limit} as oversize
        from first join fitting using (depth) where fitting.prefix = first.h >> ({BITS} - depth)"""
