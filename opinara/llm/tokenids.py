"""Token-id files: one zstandard frame per document, with a shared dictionary and an index of offsets.

A file set is a folder of three tables, all written and read by Spark alone, so any store will do:

* `dictionary`: one row, the dictionary trained on serialized id arrays, and its hash;
* `segments`: binary segments in ascending order of id, with their first and last id and their totals. A segment's body
  is a header (magic, version, bytes per id, dictionary hash, number of documents), an index (id, has-id flag,
  frame offset, frame length, number of ids for each document) and the frames;
* `offsets`: ids before each segment.

A short document costs one index look-up and one frame, see `lookup`. A frame whose dictionary hash differs from
the dictionary at hand is refused.

The dictionary learns from a bounded sample: at most about DICTIONARY_ROWS texts of at most DICTIONARY_CHARS
characters, by hash over the whole table. Everything else covers all documents in full.

Defined results: a null text is an empty text and has its end id alone; null ids come first; rows that repeat an
id keep one frame each, ordered by their content; an empty table gives an empty, readable file set; extra columns do not
matter.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays, tokens

DICTIONARY_ROWS = 1000
DICTIONARY_CHARS = 20_000
DICTIONARY_BYTES = 64 << 10
PART_ROWS = 20_000          # documents of a range of ids, about
SEGMENT_BYTES = 256 << 10
LEVEL = 1

_MAGIC = b"TIDS"
_VERSION = 1
_HEADER = struct.Struct("<4sHHQQ")  # magic, version, bytes per id, dictionary hash, documents
_INDEX = np.dtype([("id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("size", "<u8"), ("n", "<u8")])


def _hash(dictionary: bytes) -> int:
    return int(arrays.mix(np.array([zlib.crc32(dictionary) << 32 | zlib.adler32(dictionary)], np.uint64))[0])


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """A compressor that has digested the dictionary once, not for every document."""
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    known = zstandard.ZstdCompressionDict(dictionary)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known)


def _options(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def train_dictionary(docs: DataFrame, vocabulary: str, width: int, key: str = "doc_id", text: str = "text") -> bytes:
    """A dictionary for serialized id arrays, from a bounded sample; empty when there is too little to learn from."""
    short = docs.where(F.length(text) <= DICTIONARY_CHARS).select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    share = min(1.0, DICTIONARY_ROWS / max(1, short.count()))
    point = F.pmod(F.xxhash64("_id", "_text"), F.lit(1_000_000)) / F.lit(1_000_000.0)

    def serialize(batches):
        for batch in batches:
            ids = [_narrow(x, width) for x in tokens.encode_column(batch.column("_text"), vocabulary)]
            yield pa.RecordBatch.from_pydict({"ids": pa.array(ids, pa.binary())})

    rows = short.where(point < share).select("_text").mapInArrow(serialize, "ids binary").collect()
    samples = sorted(bytes(r["ids"]) for r in rows if r["ids"])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _bounds(docs: DataFrame, key: str) -> list[int]:
    """Ids that cut the table into ranges of about PART_ROWS documents."""
    n, lowest = docs.agg(F.count(key), F.min(key)).first()
    parts = math.ceil(n / PART_ROWS)
    if parts < 2:
        return []
    cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0]
    return sorted(set(cuts) - {lowest})


def _pack(rows: list[tuple[int | None, int, bytes]], width: int, digest: int) -> bytes:
    index = np.zeros(len(rows), _INDEX)
    offset = 0
    for i, (own, n, frame) in enumerate(rows):
        index[i] = (own or 0, own is not None, offset, len(frame), n)
        offset += len(frame)
    return b"".join([_HEADER.pack(_MAGIC, _VERSION, width, digest, len(rows)), index.tobytes(), *(r[2] for r in rows)])


def _open(body: bytes, digest: int) -> tuple[int, np.ndarray, int]:
    """Bytes per id, index and start of the frames of a segment."""
    magic, version, width, stored, n = _HEADER.unpack_from(body)
    if magic != _MAGIC or version != _VERSION:
        raise ValueError("not a token-id segment of this version")
    if stored != digest:
        raise ValueError("the segment was written with another dictionary")
    return width, np.frombuffer(body, _INDEX, n, _HEADER.size), _HEADER.size + n * _INDEX.itemsize


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Write the file set of all documents in ascending order of id."""
    spark = docs.sparkSession
    size = tokens.encoder(vocabulary).tokenizer.get_vocab_size()
    width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, vocabulary, width, key, text)
    digest = _hash(dictionary)
    spark.createDataFrame([(str(digest), bytearray(dictionary))], "hash string, dictionary binary").write.parquet(
        f"{path}/dictionary")
    bounds = _bounds(docs, key)
    shared = spark.sparkContext.broadcast((dictionary, np.array(bounds, np.int64)))
    end = np.array([end_id], "<u4").tobytes()

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cuts = shared.value
        press = _compressor(known)
        for batch in tokens.slices(batches):
            ids = [x + end for x in tokens.encode_column(batch.column("_text"), vocabulary)]
            own = batch.column("_id")
            part = np.searchsorted(cuts, own.fill_null(-(1 << 63)).to_numpy(), "right")
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(part, pa.int64()), "_id": own,
                "n": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "frame": pa.array([press.compress(_narrow(x, width)) for x in ids], pa.binary())})

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, rows, held = None, 0, [], 0

        def close() -> pa.RecordBatch:
            named = [r[0] for r in rows if r[0] is not None]
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "segment": pa.array([number], pa.int64()),
                "first_id": pa.array([min(named, default=None)], pa.int64()),
                "last_id": pa.array([max(named, default=None)], pa.int64()),
                "documents": pa.array([len(rows)], pa.int64()), "tokens": pa.array([sum(r[1] for r in rows)], pa.int64()),
                "body": pa.array([_pack(rows, width, digest)], pa.binary())})

        for batch in tokens.slices(batches):
            for p, own, n, frame in zip(*(batch.column(c).to_pylist() for c in ("part", "_id", "n", "frame")), strict=True):
                if rows and (p != part or held + len(frame) > SEGMENT_BYTES):
                    yield close()
                    number, rows, held = (number + 1 if p == part else 0), [], 0
                part = p
                rows.append((own, n, frame))
                held += len(frame)
        if rows:
            yield close()

    frames = docs.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_text")).mapInArrow(
        compress, "part bigint, _id bigint, n bigint, frame binary")
    # one task per range of ids: a hash of the range number would put several into one
    (frames.repartitionById(len(bounds) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "_id", "n", "frame")
     .mapInArrow(segments, "part bigint, segment bigint, first_id bigint, last_id bigint, documents bigint, "
                           "tokens bigint, body binary")
     .write.option("compression", "none").parquet(f"{path}/segments"))
    _offsets(spark.read.parquet(f"{path}/segments").select("part", "segment", "tokens")).write.parquet(f"{path}/offsets")


def _offsets(segments: DataFrame) -> DataFrame:
    """Ids before each segment, by running totals on three levels: no task sees all segments."""
    def before(by: list[str], order: str, value: str):
        return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))

    own = segments.withColumn("_group", F.floor(F.col("part") / 1024))
    parts = own.groupBy("_group", "part").agg(F.sum("tokens").alias("_t"))
    groups = parts.groupBy("_group").agg(F.sum("_t").alias("_t")).withColumn("_all", F.lit(0))
    parts = parts.withColumn("_in_group", before(["_group"], "part", "_t")).select("part", "_in_group")
    groups = groups.withColumn("_in_all", before(["_all"], "_group", "_t")).select("_group", "_in_all")
    return (own.withColumn("_in_part", before(["part"], "segment", "tokens")).join(parts, "part").join(groups, "_group")
            .select("part", "segment", (F.col("_in_part") + F.col("_in_group") + F.col("_in_all")).alias("before")))


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if _hash(bytes(row["dictionary"])) != int(row["hash"]):
        raise ValueError("the dictionary is damaged")
    return bytes(row["dictionary"]), int(row["hash"])


def _decode(segments: DataFrame, dictionary: tuple[bytes, int], with_ids: bool, wanted: list[int] | None = None) -> DataFrame:
    shared = segments.sparkSession.sparkContext.broadcast((dictionary, wanted))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, digest), only = shared.value
        expand = zstandard.ZstdDecompressor(**_options(known))
        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column("body")[i].as_py()
                width, index, at = _open(body, digest)
                starts = np.cumsum(index["n"].astype(np.int64)) - index["n"].astype(np.int64)
                rows = np.arange(len(index)) if only is None else np.flatnonzero(
                    np.isin(index["id"], only) & (index["has_id"] == 1))
                ids = []
                for r in rows:
                    a = at + int(index["offset"][r])
                    raw = expand.decompress(body[a: a + int(index["size"][r])])
                    ids.append(raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                own = index[rows]
                columns = {
                    "part": pa.array([batch.column("part")[i].as_py()] * len(rows), pa.int64()),
                    "segment": pa.array([batch.column("segment")[i].as_py()] * len(rows), pa.int64()),
                    "doc_id": pa.array(own["id"].astype(np.int64), mask=own["has_id"] == 0),
                    "_start": pa.array(starts[rows]), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "part bigint, segment bigint, doc_id bigint, _start bigint, n_tokens bigint, ids_crc32 bigint"
    return segments.select("part", "segment", "body").mapInArrow(decode, schema + ", ids binary" * with_ids)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""
    rows = _decode(spark.read.parquet(f"{path}/segments"), _dictionary(spark, path), with_ids)
    rows = rows.join(spark.read.parquet(f"{path}/offsets"), ["part", "segment"])
    return rows.select("doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32",
                       *["ids"] * with_ids)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The id arrays of a few documents: only segments whose range holds one are read, only their frames expanded."""
    inside = F.lit(False)
    for own in ids:
        inside = inside | (F.lit(own).between(F.col("first_id"), F.col("last_id")))
    segments = spark.read.parquet(f"{path}/segments").where(inside)
    return _decode(segments, _dictionary(spark, path), True, list(ids)).select("doc_id", "n_tokens", "ids_crc32", "ids")
