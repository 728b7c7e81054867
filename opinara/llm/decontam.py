"""Benchmark decontamination: SimHash fingerprints of item-sized windows, verified by weighted-shingle similarity.

For an item of w words, the windows of w words of a document are compared with it. A window's fingerprint is the
SimHash of its word shingles, each weighted by how often it occurs; fingerprints of an item and a window at similarity
0.8 differ in about 10 of 64 bits. All within RADIUS bits are found: the fingerprint is cut into BLOCKS blocks, and if two
differ in at most RADIUS bits, they differ in at most RADIUS // BLOCKS bits in some block, so each item is listed in each
block under all values that close. Candidates are then measured exactly: the sum of the smaller over
the sum of the larger shingle counts (weighted Jaccard).

A window that holds none of an item's shingles has similarity 0 to it, so only windows around an item's shingles are
fingerprinted; this loses nothing and makes ordinary text cost one table look-up a word.

Items are taken in slabs of at most about SLAB_BYTES of text, each broadcast by itself; documents stay where they are,
nothing is shuffled but matches.

Defined results: words as in `arrays`; an item with fewer words than a shingle matches where its words stand
consecutively, one without words matches nothing, and so do null texts; a document with fewer words than
the item is one window; repeated items or rows report each of their pairs once; of a pair the window of highest similarity counts, then the
first; empty tables give empty results; extra columns do not matter.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays

WORDS = 5
THRESHOLD = 0.8
RADIUS = 20
BLOCKS = 7
SLAB_BYTES = 8 << 20
_BITS = 64
_EDGES = [round(i * _BITS / BLOCKS) for i in range(BLOCKS + 1)]
_MOST = max(b - a for a, b in itertools.pairwise(_EDGES))


def fingerprints(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of the shingles in each range [start, end); a shingle counts as often as it occurs."""
    bits = ((grams[:, None] >> np.arange(_BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.int8)
    sums = np.zeros((len(grams) + 1, _BITS), np.int32)
    np.cumsum(2 * bits - 1, axis=0, dtype=np.int32, out=sums[1:])
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), 1 << 16):
        part = slice(at, at + (1 << 16))
        ones = sums[ends[part]] > sums[starts[part]]
        out[part] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    low, high = _EDGES[b], _EDGES[b + 1]
    return ((prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)


def _near_values(width: int) -> list[int]:
    """All bit patterns with at most RADIUS // BLOCKS ones."""
    return [sum(1 << i for i in ones) for n in range(RADIUS // BLOCKS + 1) for ones in itertools.combinations(range(width), n)]


class Index:
    """Items of one slab: shingles, fingerprints and the Hamming blocks."""

    def __init__(self, ids: list, texts: list[str], threshold: float):
        self.ids, self.threshold = ids, threshold
        data, offsets = arrays.buffers(pa.array(texts, pa.string()))
        words = arrays.Words(data, offsets, 0, len(texts))
        self.sizes = words.counts
        grams, owners = arrays.shingles(words, WORDS)
        self.counts = [Counter() for _ in ids]
        for gram, owner in zip(grams.tolist(), owners.tolist(), strict=True):
            self.counts[owner][gram] += 1
        self.totals = np.bincount(owners, minlength=len(ids))
        self.short = {int(w): {} for w in set(self.sizes.tolist()) if 0 < w < WORDS}
        for gram, owner in zip(grams.tolist(), owners.tolist(), strict=True):
            if self.sizes[owner] < WORDS:
                self.short[int(self.sizes[owner])].setdefault(gram, []).append(owner)

        usual = self.sizes[owners] >= WORDS
        grams, owners = grams[usual], owners[usual]
        self.lookup = arrays.Lookup(np.unique(grams))
        pairs = np.unique(np.stack([np.searchsorted(self.lookup.keys, grams), owners.astype(np.int64)], axis=1), axis=0)
        self.holders = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.lookup.keys) + 1))

        whole = np.flatnonzero(self.sizes >= WORDS)
        ends = np.cumsum(self.totals[whole])
        self.prints = np.zeros(len(ids), np.uint64)
        self.prints[whole] = fingerprints(grams, ends - self.totals[whole], ends)
        self.kinds = np.unique(self.sizes[whole])
        self.blocks = []
        for b in range(BLOCKS):  # (size, value) -> items, sorted
            own = _block(self.prints[whole], b)
            near = np.array(_near_values(_EDGES[b + 1] - _EDGES[b]), np.int64)
            kind = np.searchsorted(self.kinds, self.sizes[whole])
            keys = ((kind << _MOST)[:, None] | (own[:, None] ^ near[None, :])).ravel()
            order = np.argsort(keys, kind="stable")
            self.blocks.append((np.searchsorted(keys[order], np.arange((len(self.kinds) << _MOST) + 1)),
                                np.repeat(whole, len(near))[order]))

    def within_radius(self, kinds: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items of the window's size whose fingerprint is within RADIUS bits."""
        found = []
        for b in range(BLOCKS):
            first, items = self.blocks[b]
            keys = (kinds << _MOST) | _block(prints, b)
            n = first[keys + 1] - first[keys]
            window = np.repeat(np.arange(len(keys)), n)
            place = np.repeat(first[keys] - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(window * len(self.ids) + items[place])
        pairs = np.unique(np.concatenate(found))
        window, item = pairs // len(self.ids), pairs % len(self.ids)
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[close], item[close]

    def matches(self, words: arrays.Words) -> list[tuple[int, int, int, int, float]]:
        """(document, item, first word, words, similarity) of a block, the best window of each pair."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}

        def offer(document: int, item: int, similarity: float, start: int, n: int) -> None:
            old = best.get((document, item))
            if old is None or (-similarity, start) < (-old[0], old[1]):
                best[document, item] = (similarity, start, n)

        owner = np.repeat(np.arange(len(words.counts)), words.counts)
        for w, known in self.short.items():
            for at in arrays.Lookup(np.array(list(known), np.uint64)).hits(grams := arrays.rolling(words.hashes, w)).tolist():
                if owner[at] == owner[at + w - 1]:
                    for item in known[int(grams[at])]:
                        offer(int(owner[at]), item, 1.0, at - int(words.bounds[owner[at]]), w)

        grams = arrays.rolling(words.hashes, WORDS)
        hits = self.lookup.hits(grams)
        hits = hits[owner[hits] == owner[hits + WORDS - 1]]
        if len(hits):
            starts, sizes, kinds = self._windows(words, owner, grams, hits)
            # positions of all shingles in some window, closed up: windows stay contiguous
            edges = np.zeros(len(grams) + 1, np.int64)
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + sizes - WORDS + 1, -1)
            covered = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
            inner = grams[covered]
            left = np.searchsorted(covered, starts)
            right = left + sizes - WORDS + 1
            window, item = self.within_radius(kinds, fingerprints(inner, left, right))
            for k, i in zip(window.tolist(), item.tolist(), strict=True):
                seen = Counter(inner[left[k]: right[k]].tolist())
                common = sum((seen & self.counts[i]).values())
                similarity = common / int(right[k] - left[k] + self.totals[i] - common)
                if similarity >= self.threshold:
                    document = int(owner[starts[k]])
                    offer(document, i, similarity, int(starts[k] - words.bounds[document]), int(sizes[k]))
        return [(d, i, start, n, s) for (d, i), (s, start, n) in sorted(best.items())]

    def _windows(self, words: arrays.Words, owner: np.ndarray, grams: np.ndarray,
                 hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows (first word, words, number of the item size) that hold a shingle of an item of that size."""
        key = np.searchsorted(self.lookup.keys, grams[hits])
        n = self.first[key + 1] - self.first[key]
        place = np.repeat(self.first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
        kind = np.searchsorted(self.kinds, self.sizes[self.holders[place]])
        pairs = np.unique(np.repeat(hits, n) * len(self.kinds) + kind)
        at, kind = pairs // len(self.kinds), pairs % len(self.kinds)
        begin, end = words.bounds[owner[at]], words.bounds[owner[at] + 1]
        size = np.minimum(self.kinds[kind], end - begin)  # a shorter document is one window
        low, high = np.maximum(begin, at - (size - WORDS)), np.minimum(at, end - size)
        n = high - low + 1
        starts = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        windows = np.unique(np.repeat(kind, n) * (len(words) + 1) + starts)
        kind, starts = windows // (len(words) + 1), windows % (len(words) + 1)
        return starts, np.minimum(self.kinds[kind], words.counts[owner[starts]]), kind


def _slabs(items: DataFrame, key: str, text: str, threshold: float) -> Iterator[Index]:
    """Indexes of all items, a bounded slab at a time."""
    own = items.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    total = own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = math.ceil(total / SLAB_BYTES)
    slab = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, n)))
    for i in range(n):
        rows = own.where(slab == i).orderBy("id", "text").collect()
        if rows:
            yield Index([r["id"] for r in rows], [r["text"] for r in rows], threshold)


def _blocks(column: pa.Array) -> Iterator[tuple[int, arrays.Words]]:
    data, offsets = arrays.buffers(column)
    for first, last in arrays.blocks(offsets):
        yield first, arrays.Words(data, offsets, first, last)


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item found in it: key, item key, start (words from 0), n_words, similarity."""
    kind, item_kind = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    schema = f"_id {kind}, _item {item_kind}, start bigint, n_words bigint, similarity double"
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _slabs(items, item_key, item_text, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches, shared=shared):
            names = pa.array(shared.value.ids)
            for batch in batches:
                for first, words in _blocks(batch.column("_text")):
                    found_here = shared.value.matches(words)
                    document, item, start, n, similarity = zip(*found_here, strict=True) if found_here else [()] * 5
                    yield pa.RecordBatch.from_arrays([
                        batch.column("_id").slice(first).take(pa.array(document, pa.int64())),
                        names.take(pa.array(item, pa.int64())), pa.array(start, pa.int64()), pa.array(n, pa.int64()),
                        pa.array(similarity, pa.float64())], ["_id", "_item", "start", "n_words", "similarity"])

        found = found.unionByName(rows.mapInArrow(search, schema))
    best = Window.partitionBy("_id", "_item").orderBy(F.desc("similarity"), "start", "n_words")
    return (found.withColumn("_nth", F.row_number().over(best)).where("_nth = 1")
            .select(F.col("_id").alias(key), F.col("_item").alias(item_key), "start", "n_words", "similarity"))


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
               item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` in which no item is found, with all their columns; nothing is shuffled."""
    for index in _slabs(items, item_key, item_text, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, words in _blocks(batch.column(text)):
                    clean[[first + m[0] for m in shared.value.matches(words)]] = False
                yield batch.filter(pa.array(clean))
            arrays.trim()

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def sql(docs: str = "documents", items: str = "benchmark") -> str:
    """The same rows in DuckDB SQL, for items and documents of at least WORDS words."""
    def words(key: str, table: str) -> str:
        return f"""select {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {table}"""

    def grams(key: str, table: str) -> str:
        return f"""select {key}, len(w) as n, unnest(range(0, len(w) - {WORDS - 1})) as p, array_to_string(w[p + 1:p + {WORDS}], ' ') as g
                   from {table} where len(w) >= {WORDS}"""

    return f"""
        with dw as ({words("doc_id", docs)}), iw as ({words("item_id", items)}),
        dg as ({grams("doc_id", "dw")}), ig as ({grams("item_id", "iw")}),
        ic as (select item_id, n, g, count(*) as c from ig group by all),
        hits as (
            select distinct doc_id, item_id, dg.p, least(ic.n, dg.n) as size, dg.n as have, ic.n - {WORDS - 1} as grams
            from dg join ic using (g)
        ), starts as (
            select distinct doc_id, item_id, size, grams,
                   unnest(range(greatest(0, p - size + {WORDS}), least(p, have - size) + 1)) as start from hits
        ), inside as (
            select s.doc_id, s.item_id, s.start, s.size, s.grams, dg.g, count(*) as c
            from starts s join dg on dg.doc_id = s.doc_id and dg.p between s.start and s.start + s.size - {WORDS} group by all
        ), measured as (
            select doc_id, item_id, start, size, sum(least(inside.c, coalesce(ic.c, 0))) as common,
                   size - {WORDS - 1} + grams as whole
            from inside left join ic using (item_id, g) group by doc_id, item_id, start, size, grams
        )
        select doc_id, item_id, start, size as n_words, common::double / (whole - common)::double as similarity
        from measured where common::double / (whole - common)::double >= {THRESHOLD}
        qualify row_number() over (partition by doc_id, item_id order by similarity desc, start) = 1"""
