"""Language identification with one interpolated Kneser-Ney character model per language.

Text is reduced to lower-case letters and single blanks. A model gives each letter, and the blank that ends a word, a
probability after the four characters before it; interpolated Kneser-Ney discounting falls back over shorter
contexts. All languages share one sorted array of n-gram hashes per order, with one column of log
probabilities per language, so that a position costs one lookup however many languages there are. The language
of lowest cross-entropy per character wins.

Rejection is calibrated on labelled rows the models have not seen: a text is rejected when its
cross-entropy lies above what any of them shows at that length, with a margin: a slack for all lengths, which long rows
set, and for short texts a spread that shrinks with the root of the length, which only an excess over the slack can widen. Texts without a letter, and null texts,
are `und` and rejected.

Learning reads a bounded sample of the labelled rows: at most about SAMPLE_ROWS per language (chosen by hash of
the id, over the whole table) of at most SAMPLE_CHARS characters each. So the n-gram table stays below
SAMPLE_ROWS x SAMPLE_CHARS entries per language at any input size, and may be broadcast. Scoring reads every text
in full.

Defined results: ties go to the first language in alphabetical order; without any labelled row everything is
`und`; a null id is hashed as empty text; extra columns and their names do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays, tokens

ORDER = 5
SAMPLE_ROWS = 1200
SAMPLE_CHARS = 20_000
CALIBRATION = 5          # one sampled row in five calibrates and is not learned
MARGIN = 1.5
LEAST_SLACK = 1.0        # nats per character above a language's mean that never reject
LEAST_SPREAD = 5.0       # the same, times the root of the length: what short texts may add to the slack
_BLANK = 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def bucket(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


# ---------------------------------------------------------------- characters

_folded: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Code point to lower-case letter, or to the blank; beyond the second plane a letter stays itself."""
    if not _folded:
        table = np.full(0x110000, _BLANK, np.uint32)
        for code in range(0x20000):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 else code
        table[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)
        _folded.append(table)
    return _folded[0]


def _characters(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of a block, each document after ORDER - 1 blanks; and the document of each character.

    The leading blanks carry document number -1: they are context only.
    """
    raw = data[offsets[first]: offsets[last]]
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    begins = np.flatnonzero((raw & 0xC0) != 0x80)  # first bytes of characters
    ends = np.searchsorted(begins, offsets[first: last + 1] - offsets[first])
    folded = _fold_table()[codes]
    owner = np.repeat(np.arange(last - first), np.diff(ends))
    keep = folded != _BLANK
    keep[1:] |= (folded[:-1] != _BLANK) & (owner[1:] == owner[:-1])  # the blank that ends a word
    folded, owner = folded[keep], owner[keep]
    pad = ORDER - 1
    sizes = np.bincount(owner, minlength=last - first)
    places = np.arange(len(folded)) + pad * (owner + 1)
    chars = np.full(len(folded) + pad * (last - first), _BLANK, np.uint32)
    whose = np.full(len(chars), -1, np.int64)
    chars[places], whose[places] = folded, owner
    assert sizes.sum() == len(folded)
    return chars, whose


def _hash(grams: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given as n columns of characters."""
    total = np.full(len(grams[0]), len(grams), np.uint64)
    for column in grams:
        total *= _PRIME
        total += column
    return arrays.mix(total)


class _Table:
    """Sorted hashes; the top bits index the place where a hash would stand."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.ascontiguousarray(values[order])
        bits = max(8, min(22, int(len(keys)).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        tops = (self.keys >> self.shift).astype(np.int64)
        self.start = np.searchsorted(tops, np.arange((1 << bits) + 1)).astype(np.int32)
        self.deep = int(np.diff(self.start).max()) if len(keys) else 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        if not len(self.keys):
            return out
        top = (hashes >> self.shift).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        live = np.flatnonzero(at < end)
        at, end, wanted = at[live], end[live], hashes[live]
        for _ in range(self.deep):
            same = self.keys[at] == wanted
            out[live[same]] = at[same]
            more = ~same & (at + 1 < end)
            if not more.any():
                break
            live, at, end, wanted = live[more], at[more] + 1, end[more], wanted[more]
        return out


@dataclass
class LanguageModel:
    """languages; per order: log probabilities of n-grams and log back-off weights of contexts; calibration."""

    languages: list[str]
    grams: list[_Table]       # by order, from 1
    weights: list[_Table]     # by order of the n-gram that follows, from 1
    floor: np.ndarray         # log probability of a letter never seen
    mean: np.ndarray | None = None
    slack: np.ndarray | None = None
    spread: np.ndarray | None = None

    def positions(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of the characters at the given places, one column per language."""
        out = np.zeros((len(at), len(self.languages)), np.float32)
        todo = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            place = at[todo]
            columns = [chars[place - j] for j in range(n - 1, -1, -1)]
            row = self.grams[n - 1].find(_hash(columns))
            seen = row >= 0
            out[todo[seen]] += self.grams[n - 1].values[row[seen]]
            todo, columns = todo[~seen], [c[~seen] for c in columns]
            if not len(todo):
                return out
            if n > 1:
                row = self.weights[n - 1].find(_hash(columns[:-1]))
                known = row >= 0
                out[todo[known]] += self.weights[n - 1].values[row[known]]
        out[todo] += self.floor
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character in each language, and the number of characters, for every text."""
        data, offsets = arrays.buffers(column)
        n = len(offsets) - 1
        entropy = np.zeros((n, len(self.languages)))
        sizes = np.zeros(n, np.int64)
        for first, last in arrays.blocks(offsets, arrays.BLOCK // 2):
            chars, whose = _characters(data, offsets, first, last)
            at = np.flatnonzero(whose >= 0)
            if not len(at):
                continue
            count = np.bincount(whose[at], minlength=last - first)
            full = np.flatnonzero(count)
            starts = np.cumsum(count)[full] - count[full]
            if len(self.languages):
                logs = self.positions(chars, at)
                entropy[first + full] = -np.add.reduceat(logs, starts, axis=0, dtype=np.float64) / count[full][:, None]
            sizes[first: last] = count
        return entropy, sizes

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, confidence, cross-entropy and rejection of every text."""
        entropy, sizes = self.entropies(column)
        if not self.languages:
            n = len(sizes)
            return ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(best)), best]
        reach = np.minimum(sizes, 25)[:, None]
        share = np.exp((lowest[:, None] - entropy) * reach)
        score = np.where(sizes > 0, 1.0 / share.sum(axis=1), 0.0)
        rejected = sizes == 0
        if self.mean is not None:
            limit = self.mean[best] + self.slack[best] + self.spread[best] / np.sqrt(np.maximum(sizes, 1))
            rejected |= lowest > limit
        names = [self.languages[i] if n else "und" for i, n in zip(best, sizes, strict=True)]
        return names, score, np.where(sizes > 0, lowest, 0.0), rejected


# ---------------------------------------------------------------- learning

def sample(docs: DataFrame, key: str, text: str, lang: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` labelled rows per language, by hash of the id: (_id, text, lang)."""
    labelled = docs.where(F.col(lang).isNotNull() & (F.length(text) <= SAMPLE_CHARS)).select(
        F.col(key).alias("_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return labelled
    share = F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, min(1.0, rows / n))])
    point = F.pmod(F.xxhash64("_id", "text"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return labelled.where(point < share[F.col("lang")])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of each batch with their counts, by language; columns c0..c4 are characters."""
    tokens.release()
    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), object)
        column = batch.column("text")
        for name in sorted(set(langs.tolist())):
            data, offsets = arrays.buffers(column.filter(pa.array(langs == name)))
            for first, last in arrays.blocks(offsets, 2 * arrays.BLOCK):
                chars, whose = _characters(data, offsets, first, last)
                at = np.flatnonzero(whose >= 0)
                if not len(at):
                    continue
                grams = np.stack([chars[at - j] for j in range(ORDER - 1, -1, -1)], axis=1)
                grams, counts = np.unique(grams, axis=0, return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"lang": [name] * len(grams)} | {f"c{j}": grams[:, j].astype(np.int32) for j in range(ORDER)}
                    | {"n": counts.astype(np.int64)})


def _estimate(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """Models from counts of the longest n-grams: (characters, count) by language."""
    languages = sorted(counts)
    width = len(languages)
    by_order: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [dict() for _ in range(ORDER + 1)]
    for name in languages:
        grams, n = counts[name]
        by_order[ORDER][name] = (grams, n.astype(np.float64))
        for order in range(ORDER - 1, 0, -1):  # how many different characters stand before it
            shorter, kinds = np.unique(by_order[order + 1][name][0][:, 1:], axis=0, return_counts=True)
            by_order[order][name] = (shorter, kinds.astype(np.float64))
    letters = {int(c) for name in languages for c in by_order[1][name][0][:, 0]}
    floor = np.full(width, -math.log(len(letters) + 1), np.float32)

    grams: list[_Table] = []
    weights: list[_Table] = []
    below = None
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([by_order[order][x][0] for x in languages]), axis=0)
        contexts = np.unique(np.concatenate([by_order[order][x][0][:, :-1] for x in languages]), axis=0)
        keys = _hash([union[:, j] for j in range(order)])
        if order > 1:
            ckeys = _hash([contexts[:, j] for j in range(order - 1)])
            tail = below.values[below.find(_hash([union[:, j] for j in range(1, order)]))]
            lower = np.exp(tail.astype(np.float64))
        else:
            ckeys = np.zeros(1, np.uint64)
            lower = np.repeat(np.exp(floor.astype(np.float64))[None, :], len(union), axis=0)
        back = np.zeros((len(ckeys), width))
        prob = np.zeros((len(union), width))
        table = _Table(keys, np.arange(len(keys)))
        ctable = _Table(ckeys, np.arange(len(ckeys)))
        for i, name in enumerate(languages):
            own, n = by_order[order][name]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            where = np.zeros(len(own), np.int64) if order == 1 else ctable.values[
                ctable.find(_hash([own[:, j] for j in range(order - 1)]))]
            total = np.bincount(where, n, len(ckeys))
            kinds = np.bincount(where, minlength=len(ckeys))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            back[:, i] = np.log(weight)
            spot = table.values[table.find(_hash([own[:, j] for j in range(order)]))]
            prob[spot, i] = np.maximum(n - discount, 0) / total[where]
            every = np.zeros(len(union), np.int64) if order == 1 else ctable.values[
                ctable.find(_hash([union[:, j] for j in range(order - 1)]))]
            prob[:, i] += weight[every] * lower[:, i]
        grams.append(_Table(keys, np.log(prob).astype(np.float32)))
        weights.append(_Table(ckeys, back.astype(np.float32)))
        below = grams[-1]
        if order == 1:  # a letter never seen: the weight left over, spread evenly
            floor = (back[0] + floor).astype(np.float32)
    return LanguageModel(languages, grams, weights, floor)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn models and their rejection limits from the rows of `docs` with a language."""
    drawn = sample(docs, key, text, lang, rows)
    part = F.pmod(F.xxhash64("text", "_id"), F.lit(CALIBRATION))
    schema = "lang string, " + ", ".join(f"c{j} int" for j in range(ORDER)) + ", n bigint"
    names = [f"c{j}" for j in range(ORDER)]
    counted = (drawn.where(part != 0).select("text", "lang").mapInArrow(_count, schema)
               .groupBy("lang", *names).agg(F.sum("n").alias("n"))).toPandas()
    counts = {name: (own[names].to_numpy(np.uint32), own["n"].to_numpy())
              for name, own in counted.groupby("lang", sort=True)}
    if not counts:
        return LanguageModel([], [], [], np.zeros(0, np.float32))
    model = _estimate(counts)

    shared = drawn.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            entropy, sizes = shared.value.entropies(batch.column("text"))
            at = {name: i for i, name in enumerate(shared.value.languages)}
            rows_ = [(name, float(entropy[i, at[name]]), int(sizes[i]))
                     for i, name in enumerate(batch.column("lang").to_pylist()) if sizes[i] and name in at]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([r[0] for r in rows_], pa.string()),
                "e": pa.array([r[1] for r in rows_], pa.float64()),
                "n": pa.array([r[2] for r in rows_], pa.int64())})

    held = (drawn.where(part == 0).select("text", "lang")
            .mapInArrow(measure, "lang string, e double, n bigint")).toPandas()
    shared.unpersist()
    width = len(model.languages)
    model.mean, model.slack, model.spread = np.zeros(width), np.zeros(width), np.zeros(width)
    for i, name in enumerate(model.languages):
        own = held[held["lang"] == name]
        if len(own) < 5:  # too few to calibrate on: reject nothing but texts without letters
            model.slack[i] = np.inf
            continue
        e, n = own["e"].to_numpy(), own["n"].to_numpy()
        model.mean[i] = np.average(e, weights=n)
        over = e - model.mean[i]
        long = over[n >= 200]
        model.slack[i] = max(LEAST_SLACK, MARGIN * (long.max() if len(long) else over.max()))
        # the slack already covers long rows: what they exceed the mean by says nothing about short texts
        model.spread[i] = max(LEAST_SPREAD, MARGIN * float(((over - model.slack[i]) * np.sqrt(n)).max()))
    return model


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, lang_pred, score, cross_entropy, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            names, score, entropy, rejected = shared.value.predict(batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(names, pa.string()), pa.array(score), pa.array(entropy),
                 pa.array(rejected)], ["_id", "lang_pred", "score", "cross_entropy", "rejected"])

    kind = dict(docs.dtypes)[key]
    return (docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
            .mapInArrow(predict, f"_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
            .withColumnRenamed("_id", key))


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows whose text is not rejected, with all their columns and in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        tokens.release()
        for batch in batches:
            rejected = shared.value.predict(batch.column(text))[3]
            yield batch.filter(pa.array(~rejected))
        arrays.trim()

    return docs.mapInArrow(keep, docs.schema)
