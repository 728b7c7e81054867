"""Near-duplicate self-join: exact Jaccard similarity of word n-gram sets, candidates from a MinHash LSH forest.

1. Every text becomes its set of n-gram hashes and a MinHash signature, in one pass. Texts with the same set are one
   *class*; only one representative of a class goes on, with the size of its class.
2. Of an LSH forest of TREES trees only the last level is evaluated: the prefix length is shortened, from threshold and
   target alone, until the chance that a pair at the threshold shares one in some tree reaches the target recall, and
   representatives that share such a prefix are candidates. Since prefixes nest, that level holds the candidates of all
   longer ones, so no trie is built; the places behind it serve the agreement count.
3. Candidates whose signatures agree too little are cut, at a level that keeps the target recall, and what remains of a
   trie node is passed on as a spanning forest: at most one row per member and chunk pair, never the pairs. Its
   connected components are *clusters*: every candidate pair lies inside one.
4. The n-gram sets of clustered representatives are made again from their texts and sent to their cluster once. A cluster
   is cut into chunks, a task compares two chunks exactly, and returns for each member how many texts it is linked to and
   one link that joins it to its component.

No list of pairs exists at any point, however large a group of near copies is; a hot trie node or cluster is spread
over its chunk pairs. The work on one is still the square of its different texts, as exact link counts need it.

Defined results: words and n-grams as in `arrays` (a text of fewer than n words is one n-gram, a text without words links
to nothing but is returned, and so is a null text); a row is known by its id, null included, and its text: rows that repeat both
count as one, and an id that stands on several texts is several documents; `near_duplicates` leaves out rows of a null id, as its
SQL does, while `keep_one` compares them like all others; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.similarity import connected_components
from ..session import materialize
from . import arrays, tokens
from .exactdedup import unused

WORDS = 5
THRESHOLD = 0.8
TREES = 14
LENGTH = 6              # longest prefix
TARGET = 0.9995         # chance to find a pair at the threshold
CHUNK = 512

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, TREES * LENGTH, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, TREES * LENGTH, dtype=np.uint64)


def prefix_length(threshold: float = THRESHOLD, target: float = TARGET) -> int:
    """The longest prefix, found by shortening, at which a pair at the threshold is met with the target chance."""
    for length in range(LENGTH, 1, -1):
        if 1 - (1 - threshold ** length) ** TREES >= target:
            return length
    return 1


def least_agreement(threshold: float = THRESHOLD, target: float = TARGET) -> int:
    """Equal signature places that a pair at the threshold has with the target chance (lower binomial tail)."""
    places, tail = TREES * LENGTH, 0.0
    for k in range(places + 1):
        tail += math.comb(places, k) * threshold ** k * (1 - threshold) ** (places - k)
        if tail > 1 - target:
            return k
    return places


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Low 16 bits of MinHash values, one row per set; `starts` are the places where non-empty sets begin.

    Different values rarely share these bits; where they do, one candidate more is verified.
    """
    out = np.empty((len(starts), TREES * LENGTH), np.uint16)
    for k in range(TREES * LENGTH):
        out[:, k] = np.minimum.reduceat((hashes * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(32), starts)
    return out


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks: first and last document, distinct n-gram hashes by document, and the bounds of each document."""
    data, offsets = arrays.buffers(column)
    for first, last in arrays.blocks(offsets):
        words = arrays.Words(data, offsets, first, last)
        hashes, owners = arrays.unique_per_owner(*arrays.shingles(words, WORDS))
        yield first, last, hashes, np.searchsorted(owners, np.arange(last - first + 1))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens.release()
    for batch in batches:
        for first, last, hashes, bounds in _sets(batch.column("_text")):
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            digests = np.zeros((last - first, 2), np.uint64)
            rows: list[bytes | None] = [None] * (last - first)
            if len(full):
                starts = bounds[:-1][full]
                digests[full, 0] = np.add.reduceat(hashes, starts)
                digests[full, 1] = np.add.reduceat(arrays.mix(hashes), starts)
                for i, row in zip(full.tolist(), signatures(hashes, starts), strict=True):
                    rows[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).slice(first, last - first) for c in ("id", "k0", "k1")), pa.array(n, pa.int64()),
                pa.array(digests[:, 0].view(np.int64)), pa.array(digests[:, 1].view(np.int64)),
                pa.array(rows, pa.binary())], ["id", "k0", "k1", "n", "d0", "d1", "signature"])
    arrays.trim()


def _forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what `near` (rows b, columns a) connects: at most one per vertex."""
    lab_a, lab_b = a.copy(), b.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(lab_b, np.where(near, lab_a[None, :], top).min(axis=1, initial=top))
        new_a = np.minimum(lab_a, np.where(near, new_b[:, None], top).min(axis=0, initial=top))
        if (new_a == lab_a).all() and (new_b == lab_b).all():
            break
        lab_a, lab_b = new_a, new_b
    vertices, labels = np.concatenate([a, b]), np.concatenate([lab_a, lab_b])
    moved = vertices != labels
    return vertices[moved], labels[moved]


def _chunk_pairs(members: DataFrame, by: list[str], size: int) -> DataFrame:
    """Rows of `members` (with `by` and id) for each pair of chunks (x, y) of their group; `side` is 0 or 1.

    A group of g > 1 rows has ceil(g / size) chunks, told apart by a hash of the id; a row meets each of them once.
    """
    sizes = members.groupBy(*by).agg(F.count("*").alias("_g")).where("_g > 1")
    rows = members.join(sizes, by).withColumn("_chunks", F.ceil(F.col("_g") / size).cast("int"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_chunks").cast("bigint")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_other")
    return rows.select("*", other).select(
        "*", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side")).drop("_g", "_chunks", "_own", "_other")


def _per_group(rows: DataFrame, by: list[str], function, schema: str) -> DataFrame:
    """`function` on each group of rows, streamed from sorted partitions: groups are small and many."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[by].to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
            out = []
            for i, j in itertools.pairwise(cuts):
                own = tuple(keys[i])
                if held and own != key:
                    out.append(function(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                key = own
                held.append(pdf.iloc[i:j])
            if out:
                yield pd.concat(out)
        if held:
            yield function(pd.concat(held) if len(held) > 1 else held[0])

    return rows.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


def _sides(pdf: pd.DataFrame) -> tuple[bool, pd.DataFrame, pd.DataFrame]:
    """Whether a chunk meets itself, and the rows of either side."""
    if pdf["x"].iat[0] == pdf["y"].iat[0]:
        return True, pdf, pdf
    side = pdf["side"].to_numpy() == 0
    return False, pdf[side], pdf[~side]


def _candidates(least: int):
    def connect(pdf: pd.DataFrame) -> pd.DataFrame:
        _, one, two = _sides(pdf)
        ids_a, ids_b = one["id"].to_numpy(np.int64), two["id"].to_numpy(np.int64)
        if not len(ids_a) or not len(ids_b):
            return pd.DataFrame({"a": ids_a[:0], "b": ids_b[:0]})
        a, b = (np.frombuffer(b"".join(x["signature"]), np.uint16).reshape(len(x), -1) for x in (one, two))
        near = np.zeros((len(b), len(a)), bool)
        for i in range(len(b)):
            near[i] = (a == b[i]).sum(axis=1) >= least
        left, right = _forest(near, ids_a, ids_b)
        return pd.DataFrame({"a": left, "b": right})

    return connect


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections (rows b, columns a), exactly, through the sorted union of all elements."""
    from_a = np.concatenate(a)
    order = np.argsort(from_a, kind="stable")
    keys, owner = from_a[order], np.repeat(np.arange(len(a)), [len(x) for x in a])[order]
    out = np.zeros((len(b), len(a)), np.int64)
    for i, own in enumerate(b):
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        count = high - low
        hit = count > 0
        low, count = low[hit], count[hit]
        if len(low):
            places = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            out[i] = np.bincount(owner[places], minlength=len(a))
    return out


def _verify(threshold: float):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one, left_rows, right_rows = _sides(pdf)
        ids_a, ids_b = left_rows["id"].to_numpy(np.int64), right_rows["id"].to_numpy(np.int64)
        out = []
        if len(ids_a) and len(ids_b):
            a = [np.frombuffer(x, np.uint64) for x in left_rows["grams"]]
            b = [np.frombuffer(x, np.uint64) for x in right_rows["grams"]]
            common = _shared(a, b)
            sizes = np.array([len(x) for x in b])[:, None] + np.array([len(x) for x in a])[None, :] - common
            near = common >= threshold * sizes - 1e-9
            if one:
                np.fill_diagonal(near, False)
            wa, wb = left_rows["weight"].to_numpy(np.int64), right_rows["weight"].to_numpy(np.int64)
            out.append(pd.DataFrame({"id": ids_b, "links": near @ wa, "b": ids_b}))
            if not one:
                out.append(pd.DataFrame({"id": ids_a, "links": near.T @ wb, "b": ids_a}))
            left, right = _forest(near, ids_a, ids_b)
            out.append(pd.DataFrame({"id": left, "links": np.zeros(len(left), np.int64), "b": right}))
        found = pd.concat(out) if out else pd.DataFrame({"id": [], "links": [], "b": []})
        return found[(found["links"] > 0) | (found["id"] != found["b"])].astype("int64")

    return compare


def _row_key(key: str, text: str) -> list[Column]:
    """Two digests that name a row by its id, null included, and its text."""
    id_ = F.col(key).cast("bigint")
    return [F.xxhash64(id_.isNull(), id_, F.col(text)), F.xxhash64(id_.isNull(), id_, F.md5(F.col(text).cast("binary")))]


def _classes(docs: DataFrame, key: str, text: str, threshold: float, target: float) -> tuple[DataFrame, DataFrame]:
    """Documents (id, k0, k1, n, d0, d1), one per row key; and their sets (n, d0, d1, root, weight, links).

    `root` names the component of a set, `weight` counts its documents, `links` those of other sets near to it.
    """
    k0, k1 = _row_key(key, text)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), k0.alias("k0"), k1.alias("k1"), F.col(text).alias("_text"))
    signed = materialize(rows.mapInArrow(
        _sign, "id bigint, k0 bigint, k1 bigint, n bigint, d0 bigint, d1 bigint, signature binary"), "signatures")

    # classes of equal sets; texts without n-grams are classes of their own
    named = signed.select("id", "k0", "k1", "n", "d0", "d1").distinct()
    sets = materialize(
        named.where("n > 0").groupBy("n", "d0", "d1").agg(F.min("k0").alias("k0"), F.count("*").alias("weight")), "sets")
    reps = materialize(
        signed.where("n > 0").join(sets, ["k0", "n", "d0", "d1"]).dropDuplicates(["n", "d0", "d1"])
        .withColumn("name", F.xxhash64("n", "d0", "d1")).select("name", "k0", "n", "d0", "d1", "weight", "signature"), "reps")

    # trie nodes at the shortest prefix, as (tree, hash of the prefix)
    length = prefix_length(threshold, target)
    nodes = F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(
        F.lit(t), F.substring("signature", 2 * LENGTH * t + 1, 2 * length)).alias("prefix")) for t in range(TREES)])
    leaves = reps.select(F.col("name").alias("id"), F.explode(nodes).alias("node")).select("id", "node.*")
    # chunk pairs are made of ids alone; signatures join the few that share a node
    pairs = _chunk_pairs(leaves, ["tree", "prefix"], CHUNK).join(
        reps.select(F.col("name").alias("id"), "signature"), "id")
    edges = _per_group(pairs, ["tree", "prefix", "x", "y"], _candidates(least_agreement(threshold, target)), "a bigint, b bigint")
    clusters = connected_components(edges)  # (id, root) of representatives with a candidate

    # exact comparison inside clusters
    chosen = materialize(reps.join(clusters.withColumnRenamed("id", "name"), "name")
                         .select("name", "k0", "n", "d0", "d1", "weight", "root"), "chosen")
    again = (rows.select("k0", "_text").join(chosen.select("k0").distinct(), "k0", "left_semi")
             .mapInArrow(_grams, "k0 bigint, n bigint, d0 bigint, d1 bigint, grams binary"))
    full = materialize(again.join(chosen, ["k0", "n", "d0", "d1"]).dropDuplicates(["name"])
                       .select(F.col("name").alias("id"), "root", "weight", "grams"), "grams")
    found = materialize(_per_group(_chunk_pairs(full, ["root"], CHUNK // 2), ["root", "x", "y"], _verify(threshold),
                                   "id bigint, links bigint, b bigint"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("id <> b").select(F.col("id").alias("a"), "b"))
    own = reps.select("name", "n", "d0", "d1", "weight")
    joined = own.join(parts.withColumnRenamed("id", "name"), "name", "left").join(
        links.withColumnRenamed("id", "name"), "name", "left")
    return named, joined.select("n", "d0", "d1", F.coalesce("root", "name").alias("root"), "weight", "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    target: float = TARGET) -> DataFrame:
    """One row per document, told apart by id and text, null ids included: key, class_id, n_links, n_ngrams, set_size.

    `class_id` is the smallest id that is connected to the document by links (its own, if there is none; null if only
    documents without id are), a link being
    a pair of similarity >= threshold; `n_links` counts the document's links to other documents, copies included;
    `set_size` counts the documents with exactly the same n-gram set.
    """
    named, sets = _classes(docs, key, text, threshold, target)
    # a component is named by the smallest document id in it
    least = named.where("n > 0").groupBy("n", "d0", "d1").agg(F.min("id").alias("least"))
    joined = materialize(sets.join(least, ["n", "d0", "d1"]), "joined")
    smallest = joined.groupBy("root").agg(F.min("least").alias("class_id"))
    labelled = joined.join(smallest, "root").select("n", "d0", "d1", "class_id", "weight", "links")
    per_text = named.join(labelled, ["n", "d0", "d1"], "left").select(
        "id", "n", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("weight", F.lit(1)).alias("set_size"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"))
    return per_text.select(F.col("id").alias(key), "class_id", "n_links", F.col("n").alias("n_ngrams"), "set_size")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-gram sets themselves, with the digests that name them."""
    for batch in batches:
        for first, last, hashes, bounds in _sets(batch.column("_text")):
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            if not len(full):
                continue
            starts = bounds[:-1][full]
            yield pa.RecordBatch.from_arrays([
                batch.column("k0").slice(first, last - first).take(pa.array(full)), pa.array(n[full], pa.int64()),
                pa.array(np.add.reduceat(hashes, starts).view(np.int64)),
                pa.array(np.add.reduceat(arrays.mix(hashes), starts).view(np.int64)),
                pa.array([hashes[bounds[i]: bounds[i + 1]].tobytes() for i in full], pa.binary())],
                ["k0", "n", "d0", "d1", "grams"])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` without near duplicates: of each class one row, the one with the smallest id (null last).

    Rows are told apart by id and text, so a row whose id also stands on another text is judged by its own text. Texts without
    words are near to nothing and all stay.
    """
    named, sets = _classes(docs, key, text, threshold, TARGET)
    rank = F.struct(F.col("id").isNull().alias("nameless"), "id", "k0", "k1")
    best = named.where("n > 0").groupBy("n", "d0", "d1").agg(F.min(rank).alias("best"))
    joined = materialize(sets.join(best, ["n", "d0", "d1"]).select("n", "d0", "d1", "root", "best"), "joined")
    first = joined.groupBy("root").agg(F.min("best").alias("first"))
    stays = joined.join(first, "root").select("n", "d0", "d1", F.col("first.k0").alias("s0"), F.col("first.k1").alias("s1"))
    k0, k1, nth = (unused(docs, name) for name in ("k0", "k1", "nth"))
    gone = named.join(stays, ["n", "d0", "d1"]).where("k0 <> s0 or k1 <> s1").select(
        F.col("k0").alias(k0), F.col("k1").alias(k1))

    worded = F.coalesce(F.col(text).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    a, b = _row_key(key, text)
    rows = docs.where(worded).withColumns({k0: a, k1: b})
    # rows that repeat id and text: map tasks already pass on one of each
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and c not in (key, text)]
    once = Window.partitionBy(k0, k1).orderBy(F.xxhash64(*plain) if plain else F.col(k0))
    rows = rows.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1)
    return rows.join(gone, [k0, k1], "left_anti").select(*docs.columns).union(docs.where(~worded))


def sql(table: str = "documents") -> str:
    """The same rows in DuckDB SQL."""
    return f"""
        with recursive keyed as materialized (
            select row_number() over () as k, doc_id, text from (select distinct doc_id, text from {table})
        ), words as (
            select k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
            from keyed
        ), grams as (
            select distinct k, unnest(case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')]
                else list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))
                end) as g from words
        ), sizes as (select k, count(*) as n from grams group by k),
        common as (
            select a.k as a, b.k as b, count(*) as c from grams a join grams b using (g) where a.k <> b.k group by 1, 2
        ), links as (
            select a, b, c = x.n and c = y.n as same from common join sizes x on x.k = a join sizes y on y.k = b
            where c >= {THRESHOLD} * (x.n + y.n - c) - 1e-9
        ), reach as (
            select k as id, k as root from words
            union
            select links.b, reach.root from reach join links on links.a = reach.id where reach.root < links.b
        ), roots as (select id, min(root) as root from reach group by id),
        classes as (select root, min(doc_id) as class_id from roots join keyed on k = id group by root)
        select doc_id, class_id, coalesce(l.n, 0) as n_links, coalesce(sizes.n, 0) as n_ngrams,
               coalesce(l.same, 0) + 1 as set_size
        from roots join keyed on keyed.k = id join classes using (root)
        left join (select a, count(*) as n, count(*) filter (where same) as same from links group by a) l on l.a = id
        left join sizes on sizes.k = id"""
