"""Packing token sequences by minimum bin slack.

A document's ids, with an end id, are cut into full windows and one remaining piece. How many pieces have each
length is a table of at most `window` rows, whatever the input. On it, minimum bin slack chooses windows: the longest
remaining piece opens a window, and a subset-sum over a bitset of reachable fills, with bounded counts, finds the
multiset of further pieces that comes closest to the capacity; counts are read back from the bitset's stages. A
choice is repeated as often as its counts allow, so there are a few choices per length at most, and they fit a broadcast.

Pieces then find their place in parallel: the n-th piece of a length takes the n-th slot of that length. Ranks
come from two levels, inside a (length, bucket) cell and from the running totals of cells, so a length that
holds a third of all pieces is spread over the buckets.

Defined results: a null text packs as empty text, that is its end id alone; rows that repeat an id are packed each; a
null id is carried along; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import arrays, tokens

WINDOW = 2048
CELL = 100_000  # pieces of one length that one task ranks, about


# ---------------------------------------------------------------- choosing windows

def _closest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most `counts` of each, whose sum is closest to `capacity` from below."""
    if capacity <= 0:
        return {}
    mask, goal = (1 << (capacity + 1)) - 1, 1 << capacity
    reach, stages = 1, []
    for length in sorted((x for x in counts if x <= capacity and counts[x] > 0), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0:  # binary splitting: 1, 2, 4, ... copies at once
            take = min(take, left)
            stages.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(stages):
        if not before >> at & 1:  # only this stage reaches the fill
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def choose_windows(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """[(lengths of a window with their counts, how many such windows)], every piece used once."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        chosen = _closest(rest, window - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // used for n, used in chosen.items())
        for n, used in chosen.items():
            left[n] -= used * times
            if not left[n]:
                del left[n]
        out.append((chosen, times))
    return out


def slots(choices: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies in a window, offset, first sequence) sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, times in choices:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.append((length, used.get(length, 0), n, offset, sequence))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# ---------------------------------------------------------------- pieces

def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, key: str = "doc_id",
               text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most `window` ids: key, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    kind = dict(docs.dtypes)[key]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches):
            rows = []
            for i, ids in enumerate(tokens.encode_column(batch.column("_text"), vocabulary)):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start: 4 * (start + window)]
                    rows.append((i, start, len(part) // 4, zlib.crc32(part), total, part if with_ids else None))
            at, start, length, crc, total, part = (list(x) for x in zip(*rows, strict=True)) if rows else [[]] * 6
            columns = {"_id": batch.column("_id").take(pa.array(at, pa.int64()))}
            columns |= {name: pa.array(x, pa.int64()) for name, x in
                        zip(("start", "length", "ids_crc32", "doc_tokens"), (start, length, crc, total), strict=True)}
            if with_ids:
                columns["ids"] = pa.array(part, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)
        arrays.trim()

    schema = f"_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids
    return (docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(cut, schema)
            .withColumnRenamed("_id", key))


def place_pieces(pieces: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """`pieces`, which is read twice, with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(choose_windows(counts, window))
    buckets = max(1, math.ceil(max(counts.values(), default=0) / CELL))
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    cells = pieces.withColumn("_bucket", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = cells.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(
        Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    inside = Window.partitionBy("length", "_bucket").orderBy(key, "start", "ids_crc32", "doc_tokens")
    ranked = (cells.withColumn("_nth", F.row_number().over(inside)).join(before, ["length", "_bucket"])
              .withColumn("_rank", F.col("_nth") - 1 + F.coalesce("_before", F.lit(0)))
              .drop("_nth", "_before", "_bucket"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, lowest, copies, offset, sequence = shared.value.T
        keys = (length << 44) | lowest
        for batch in batches:
            own = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy().astype(np.int64)
            row = np.searchsorted(keys, (own << 44) | rank, "right") - 1
            nth = rank - lowest[row]
            yield (batch.drop_columns(["_rank"])
                   .append_column("sequence_id", pa.array(sequence[row] + nth // copies[row]))
                   .append_column("offset", pa.array(offset[row] + nth % copies[row] * own)))

    # with keys shifted by 44 bits a length may have 17 million million pieces
    order = [c for c in pieces.columns if c != "length"]
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.select("length", *order, "_rank").drop("_rank").dtypes)
    placed = ranked.select("length", *order, "_rank").mapInArrow(place, schema + ", sequence_id bigint, offset bigint")
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The pieces, a few numbers each, are written to the shared folder once, so texts are tokenized once.
    """
    return place_pieces(materialize(cut_pieces(docs, vocabulary, end_id, window, key, text), "pieces"), window, key)


def assemble(placed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Sequences from placed pieces that carry their ids: sequence_id, n_tokens, ids as little-endian 32-bit integers.

    A sequence has at most `window` ids. It is padded to the window unless its length is a power of two.
    """
    parts = placed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("_parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    exact = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(window) - F.col("n_tokens")).cast("int")))
    return parts.select("sequence_id", "n_tokens", F.when(exact, joined).otherwise(F.concat(joined, pad)).alias("ids"))
