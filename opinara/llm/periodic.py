"""Periodic runs of words: Lyndon arrays from the first phase of Baier's suffix sorter, roots extended into runs.

A run is a stretch of words with smallest period q that no neighbouring word extends keeping q; wanted are those of at least
`least` words and `powers` periods. Each run has, under the alphabet's order or under the reverse order, roots that
are the longest Lyndon words at their places. The first phase of Baier's suffix sorter groups suffixes by that word:
groups are taken from the highest down, each member extends the context of the nearest place before it
that lies in a lower group, and the extended places form new groups right above their old one. When a group is taken, its
context length is the Lyndon array of its members, so no suffix array is needed. The phase runs once for either order.
Three equal Lyndon lengths q at places q apart mark a possible root; its run is found by extending the match of the
words with the words q further to both sides, comparing the words themselves.

Before that, words that cannot lie in a wanted run are set aside, without loss: in a run of m words or less, each word stands
again within m / powers words, and at least `powers` times in all. What remains between such words is shorter, which
sets more words aside, until nothing changes; prose vanishes, repetition stays. Words are compared by their bytes.

Texts are independent, nothing is shuffled. Memory follows the longest text of a batch.

Defined results: a null text has no words; empty texts and texts without a run have an empty list of runs and keep all
words; keys may be null or repeated, each row has its own result; an empty table gives an empty result; extra columns
do not matter, the key may have any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

LEAST = 6    # words of a run
POWERS = 4   # periods of a run
BLANKS = r"[\x20\x09-\x0D]+"

Run = tuple[int, int, int]   # start, length, period


# ---------------------------------------------------------------- Lyndon arrays

def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place; ranks are 0, 1, ... without gaps."""
    n = len(ranks)
    out = [0] * n
    members: list[set[int]] = [set() for _ in range(max(ranks, default=-1) + 1)]
    for i, r in enumerate(ranks):
        members[r].add(i)
    context = [1] * len(members)                # words that the members of a group are known to share
    below = list(range(-1, len(members) - 1))   # neighbouring groups that are not yet taken
    above = [*range(1, len(members)), -1]
    group = list(ranks)
    left = list(range(-1, n - 1))               # the nearest place before that is not yet taken, or a step towards it
    taken = [False] * n
    top = len(members) - 1
    while top >= 0:
        places, length = members[top], context[top]
        for i in places:
            taken[i] = True
            out[i] = length
        followed: dict[int, int] = {}           # place -> how often the taken context follows its own
        for i in places:
            p = left[i]
            while p >= 0 and taken[p]:
                p = left[p]
            j = i
            while j > p and left[j] != p:       # shorten the way for those who come later
                left[j], j = p, left[j]
            if p >= 0:
                followed[p] = followed.get(p, 0) + 1
        moved: dict[int, dict[int, list[int]]] = {}
        for p, times in followed.items():
            moved.setdefault(group[p], {}).setdefault(times, []).append(p)
        if below[top] >= 0:
            above[below[top]] = -1
        for old, by_times in moved.items():
            whole = members[old]
            if len(by_times) == 1:
                (times, some), = by_times.items()
                if len(some) == len(whole):     # nobody stays behind
                    context[old] += times * length
                    continue
            at = old
            for times in sorted(by_times):      # more copies of a higher word: a higher group
                whole.difference_update(by_times[times])
                new, over = len(members), above[at]
                members.append(set(by_times[times]))
                context.append(context[old] + times * length)
                below.append(at)
                above.append(over)
                above[at] = new
                if over >= 0:
                    below[over] = new
                for p in by_times[times]:
                    group[p] = new
                at = new
            if below[top] == old:               # the new groups stand between
                below[top] = at
        members[top] = set()
        top = below[top]
    return out


# ---------------------------------------------------------------- runs

def _stretches(ids: np.ndarray, least: int, powers: int) -> list[tuple[int, int]]:
    """Ranges of places outside of which no wanted run lies."""
    n = len(ids)
    if n < least:
        return []
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    step = np.where(same, order[1:] - order[:-1], n)
    near = np.full(n, n, np.int64)              # distance to the nearest equal word
    near[order[1:]] = step
    near[order[:-1]] = np.minimum(near[order[:-1]], step)
    alive = (np.bincount(ids)[ids] >= powers) & (near * powers <= n)
    found, spans = [], [(0, n)]
    while spans:
        parts = []
        for a, b in spans:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], alive[a:b].view(np.int8), [0])))).reshape(-1, 2) + a
            parts += [(x, y) for x, y in edge.tolist() if y - x >= least]
        spans = []
        for a, b in parts:
            keep = near[a:b] * powers <= b - a
            if keep.all():
                found.append((a, b))
            else:
                alive[a:b] &= keep
                spans.append((a, b))
    return sorted(found)


def _match(words: np.ndarray, a: int, b: int) -> int:
    """How many words from a on equal those from b on (a < b)."""
    n, size, at = len(words) - b, 64, 0
    while at < n:
        size = min(size, n - at)
        differ = words[a + at: a + at + size] != words[b + at: b + at + size]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at += size
        size *= 2
    return n


def runs_of(ids: np.ndarray, least: int = LEAST, powers: int = POWERS) -> list[Run]:
    """All wanted runs of a text whose words have these numbers, by start, then period."""
    out: set[Run] = set()
    for a, b in _stretches(ids, least, powers):
        words = ids[a:b]
        ranks = np.unique(words, return_inverse=True)[1]
        back = words[::-1]
        n = len(words)
        for line in (ranks, ranks.max() - ranks):
            lyndon = np.array(lyndon_array(line.tolist()), np.int64)
            place = np.arange(n)
            fits = np.flatnonzero((place + 3 * lyndon <= n) & (lyndon * powers <= n)) if powers >= 4 else place
            if powers >= 4:
                q = lyndon[fits]
                fits = fits[(lyndon[fits + q] == q) & (lyndon[fits + 2 * q] == q)]
            ends: dict[int, int] = {}           # period -> end of its last run
            for i in fits.tolist():
                q = int(lyndon[i])
                if i + q <= ends.get(q, -1):
                    continue
                end = i + q + _match(words, i, i + q)
                start = i - _match(back, n - i - q, n - i) if i else 0
                ends[q] = end
                if end - start >= max(least, powers * q):
                    out.add((a + start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run repeats after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def _number(words: list[bytes]) -> np.ndarray:
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(place.__getitem__, words), np.int64, len(words))


# ---------------------------------------------------------------- on Spark

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, powers: int = POWERS) -> DataFrame:
    """One row per row of `docs`: its key, n_words, runs (start, length, period) and the collapsed text."""
    if least < 2 or powers < 2:
        raise ValueError("a run has at least two words and two periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches):
            sizes, found, texts = [], [], []
            for t in batch.column("_text").cast(pa.binary()):
                words = (t.as_py() or b"").split()      # bytes are split at [\x20\x09-\x0D] alone
                runs = runs_of(_number(words), least, powers) if len(words) >= least else []
                sizes.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(b" ".join(collapse(words, runs) if runs else words))
            yield pa.RecordBatch.from_pydict({
                "_id": batch.column("_id"), "n_words": pa.array(sizes, pa.int64()), "runs": pa.array(found, pa.list_(_RUN)),
                "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})

    schema = (f"_id {dict(docs.dtypes)[key]}, n_words bigint, "
              "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return (docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, schema)
            .withColumnRenamed("_id", key))


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text; where crc32 of the key ends in 0, the words repeat with some period from some place on."""
    h = F.crc32(F.col(key).cast("string"))
    # a column of its own: inside the lambda below the split would run once for each word
    split = docs.select(key, text, h.alias("_h"), F.when(h % 10 == 0, F.filter(
        F.split(F.col(text), BLANKS), lambda w: w != "")).alias("_words"))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    a = split.select(key, text, "_words", n.alias("_n"), F.when(n > 0, g % n).alias("_a"), (3 + g % 8).alias("_parts"))
    a = a.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / F.col("_parts")))
    repeated = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.element_at("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p") + 1).cast("int"))))
    return a.select(key, F.when(F.col("_n") > 0, F.array_join(repeated, " ")).otherwise(F.col(text)).alias(text))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, number of runs, the longest one, and the digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        key, F.size("runs").cast("bigint").alias("n_runs"), (-longest["start"]).alias("start"),
        longest["length"].alias("length"), (-longest["period"]).alias("period"),
        F.floor(longest["length"] * 1000 / -longest["period"]).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
