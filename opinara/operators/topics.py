"""Topics of all categories in one job, by expectation and maximisation over counted words.

A category's texts mix `k` topics; a topic is a distribution over words. Each round shares out every count (text, word) among the
topics by the product of the text's and the word's weights, and sums the shares by (category, word) and by (category, text). Texts
are dealt into blocks of about `BLOCK` counts. In a round each block meets the weights of its own words, shares out its counts and hands on
one sum per word and text; a count is never a row that is shuffled or written. Neither a vocabulary nor a category name leaves the
cluster, and the start is a hash of text and topic, so results repeat. Categories with fewer than `min_reviews` texts, words in fewer than two texts of a category, and words in
more than half of them are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize
from .mining import ASPECT, _filtered, _top_map
from .preprocess import top_per_group

ALPHA, BETA = 0.1, 0.01     # what each topic of a text, and each word of a topic, has before any count
CATEGORY = "main_category"
BLOCK = 6_000_000           # counts of a block, about
SLICE = 500_000             # counts shared out at once
WORD, TEXT = range(2)       # kinds of rows


def topic_counts(mentions: DataFrame, texts: DataFrame, sentiment: str | None = "Negative", min_reviews: int = 20) -> DataFrame:
    """``(main_category, review_id, word, n)`` of the reviews with matching mentions."""
    return _counts(_filtered(mentions, sentiment, None), texts, min_reviews)


def _counts(matching: DataFrame, texts: DataFrame, min_reviews: int) -> DataFrame:
    own = matching.where(F.col(CATEGORY).isNotNull()).select("review_id", CATEGORY).distinct()
    # a text moves as one row of words to its category: they are counted where it is
    words = texts.select("review_id", C.topic_tokens("text").alias("_words")).join(own, "review_id")
    counts = words.select(CATEGORY, "review_id", F.explode("_words").alias("word")).groupBy(CATEGORY, "review_id", "word").agg(
        F.count("*").alias("n"))
    counts = materialize(counts, "counts")
    size = counts.select(CATEGORY, "review_id").distinct().groupBy(CATEGORY).agg(F.count("*").alias("_d")).where(
        F.col("_d") >= min_reviews)
    often = counts.groupBy(CATEGORY, "word").agg(F.count("*").alias("_f")).join(size, CATEGORY).where(
        (F.col("_f") >= 2) & (F.col("_f") <= F.col("_d") * 0.5))
    return counts.join(often.select(CATEGORY, "word"), [CATEGORY, "word"])


def _shares(values: Sequence[Column]) -> list[Column]:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return [v / total for v in values]


def _numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows, written, with a number from 0 each, without gaps."""
    rows = materialize(df.withColumn("_id", F.monotonically_increasing_id()), name)
    part, start, starts = F.shiftright("_id", 33), 0, []
    for r in sorted(rows.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):  # one row per task
        starts.append(F.struct(F.lit(r["part"]).cast("bigint").alias("_part"), F.lit(start).cast("bigint").alias("_start")))
        start += r["count"]
    if not starts:
        return rows.withColumn(column, F.lit(0)).drop("_id")
    known = df.sparkSession.range(1).select(F.inline(F.array(*starts)))
    number = F.col("_start") + F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return rows.withColumn("_part", part).join(F.broadcast(known), "_part").withColumn(column, number.cast("int")).drop(
        "_id", "_part", "_start")


def _shared_out(k: int, first: bool):
    """One round inside a block: sums of the shares by word, and the texts' new weights."""
    names = [f"w{z}" for z in range(k)]

    def run(texts: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values("text", ignore_index=True)
        weights = weights.sort_values("id")
        p = weights.loc[weights["kind"] == TEXT, names].to_numpy(dtype=float)     # in order of the text, as the rows are
        known = weights[weights["kind"] == WORD]
        q = known[names].to_numpy(dtype=float)
        text = np.repeat(np.arange(len(texts)), texts["n"].map(len).to_numpy())
        word, n = np.concatenate(texts["word"].tolist()), np.concatenate(texts["n"].tolist())
        ids = np.unique(word) if first else known["id"].to_numpy()
        place = np.searchsorted(ids, word)
        by_word, by_text = np.zeros((len(ids), k)), np.zeros((len(texts), k))
        for at in range(0, len(n), SLICE):
            t, w = text[at: at + SLICE], place[at: at + SLICE]
            share = p[t]
            if not first:
                share = share * q[w]
                share /= share.sum(axis=1, keepdims=True)
            share *= n[at: at + SLICE, None]
            for z in range(k):
                by_word[:, z] += np.bincount(w, share[:, z], len(ids))
                by_text[:, z] += np.bincount(t, share[:, z], len(texts))
        new = by_text + ALPHA
        new = p if first else new / new.sum(axis=1, keepdims=True)
        out = pd.DataFrame(np.concatenate([by_word, new]), columns=names)
        out["id"] = np.concatenate([ids, texts["text"].to_numpy()])
        out["kind"] = np.repeat([WORD, TEXT], [len(ids), len(texts)])
        out["block"] = texts["block"].iloc[0]
        return out

    return run


def em_topics(counts: DataFrame, k: int = 5, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """Word weights ``(main_category, word, q0...)`` and text weights ``(main_category, review_id, p0...)`` after some rounds."""
    def hashed(z: int) -> Column:
        digits = F.substring(F.md5(F.concat("review_id", F.lit(f":{z}"))), 1, 4)
        return 1 + F.conv(digits, 16, 10).cast("double") / 65536

    counts = materialize(counts.dropna(subset=[CATEGORY, "review_id", "word"]), "counts")
    blocks = max(1, math.ceil(counts.count() / BLOCK))
    vocabulary = _numbered(counts.select(CATEGORY, "word").distinct(), "id", "vocabulary")
    texts = _numbered(counts.select(CATEGORY, "review_id").distinct(), "text", "docs").withColumn(
        "block", F.pmod(F.xxhash64(CATEGORY, "review_id"), F.lit(blocks)).cast("int"))
    pair = F.struct(F.col("id").alias("word"), F.col("n").cast("int").alias("n"))
    held = counts.join(vocabulary, [CATEGORY, "word"]).join(texts, [CATEGORY, "review_id"]).groupBy("block", "text").agg(
        F.collect_list(pair).alias("_c"))
    held = materialize(held.select("block", "text", F.col("_c.word").alias("word"), F.col("_c.n").alias("n")), "held")
    used = materialize(held.select("block", F.explode("word").alias("id")).distinct(), "used")

    # every round reads the blocks where they lie; a lost one is dealt again from the written table. With fewer partitions than
    # a shuffle has, the rounds would move them
    partitions = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = held.repartition(max(blocks, partitions), "block").persist(StorageLevel.DISK_ONLY)

    names = [f"w{z}" for z in range(k)]
    schema = ", ".join(f"{c} double" for c in names) + ", id int, kind int, block int"
    start = _shares([hashed(z) for z in range(k)])
    weights = texts.select(*[p.alias(c) for p, c in zip(start, names)], F.col("text").alias("id"), F.lit(TEXT).alias("kind"), "block")
    for n in range(rounds + 1):
        found = held.groupBy("block").cogroup(weights.groupBy("block")).applyInPandas(_shared_out(k, n == 0), schema)
        found = materialize(found, "shares")
        sums = found.where(F.col("kind") == WORD).groupBy("id").agg(*[(F.sum(c) + BETA).alias(c) for c in names])
        sums = materialize(sums.join(vocabulary.select("id", CATEGORY), "id"), "words")
        totals = sums.groupBy(CATEGORY).agg(*[F.sum(c).alias(f"t{c}") for c in names])
        words = sums.join(totals, CATEGORY).select("id", *[(F.col(c) / F.col(f"t{c}")).alias(c) for c in names])
        docs = found.where(F.col("kind") == TEXT)
        weights = used.join(words, "id").select(*names, "id", F.lit(WORD).alias("kind"), "block").unionByName(docs)
    out_words = vocabulary.join(words, "id").select(CATEGORY, "word", *[F.col(c).alias(f"q{z}") for z, c in enumerate(names)])
    out_docs = texts.join(docs.select(F.col("id").alias("text"), *names), "text").select(
        CATEGORY, "review_id", *[F.col(c).alias(f"p{z}") for z, c in enumerate(names)])
    held.unpersist()
    return materialize(out_words, "words"), materialize(out_docs, "docs")


def by_topic(weights: DataFrame, prefix: str, k: int) -> DataFrame:
    """One row per topic and weight."""
    keys = [c for c in weights.columns if not (c.startswith(prefix) and c[1:].isdigit())]
    return weights.select(*keys, F.posexplode(F.array(*[F.col(f"{prefix}{z}") for z in range(k)])).alias("topic", "p"))


def category_topics(mentions: DataFrame, texts: DataFrame, k: int = 5, rounds: int = 20, sentiment: str | None = "Negative",
                    min_reviews: int = 20, top_words: int = 10, weight: float = 0.3) -> DataFrame:
    """Topics of every category: words with weights, texts above `weight`, and those texts' most frequent aspects."""
    found = _filtered(mentions, sentiment, None).groupBy("review_id", CATEGORY, ASPECT).agg(F.count("*").alias("k"))
    found = materialize(found, "mentions")      # mentions may come from an extraction
    words, docs = em_topics(_counts(found, texts, min_reviews), k, rounds)
    top = top_per_group(by_topic(words, "q", k), [CATEGORY, "topic"], [F.desc(F.round("p", 12)), "word"], top_words)
    named = top.groupBy(CATEGORY, "topic").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "p"))).alias("_w")).select(
        CATEGORY, "topic", F.transform("_w", lambda s: s["word"]).alias("words"), F.transform("_w", lambda s: s["p"]).alias("probabilities"))
    strong = materialize(by_topic(docs, "p", k).where(F.col("p") > weight).select(CATEGORY, "review_id", "topic"), "strong")
    group = F.struct(CATEGORY, "topic").alias("_g")
    aspects = _top_map(found.join(strong, ["review_id", CATEGORY]).select(group, ASPECT, "k"), "_g", ASPECT, 5, "top_aspects")
    sizes = strong.groupBy(CATEGORY, "topic").agg(F.count("*").alias("document_count"))
    return (named.join(sizes, [CATEGORY, "topic"], "left").na.fill(0, ["document_count"])
            .join(aspects.select(f"_g.{CATEGORY}", "_g.topic", "top_aspects"), [CATEGORY, "topic"], "left"))


def topic_concerns(topics: DataFrame, share: float = 0.7) -> DataFrame:
    """Aspects of the topics: in how many categories, whether in at least `share` of those with topics, or in one alone."""
    total = topics.agg(F.count_distinct(CATEGORY)).scalar()
    each = topics.select(CATEGORY, F.explode(F.map_keys("top_aspects")).alias(ASPECT)).distinct()
    counted = each.groupBy(ASPECT).agg(F.count("*").alias("categories"), F.min(CATEGORY).alias("first_category"))
    return counted.withColumns({"universal": F.col("categories") >= total * share, "specific": F.col("categories") == 1})
