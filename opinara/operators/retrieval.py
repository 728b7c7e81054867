"""Similarity retrieval and reranking for a table of questions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize
from .similarity import block_join, matrix
from .text import term_counts

SLAB = 2048       # questions, about, whose matrix is broadcast at a time
TEXTS = 2_000     # texts, about, whose words are counted in one task
POSTINGS = 4_000_000  # postings that a task takes up before it merges them
COMMON = 100_000  # most frequent terms, broadcast with their weights
SLACK = 2e-9      # scores are rounded to nine digits


def label_centroids(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector per label."""
    means = (df.select(label, F.posexplode(vector).alias("i", "x"))
             .groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x")))
    return means.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
        .alias("centroid"))


def build_corpus(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Corpus rows with unit vectors."""
    return df.withColumn(vector, C.l2_normalize(vector).cast("array<float>"))


def product_corpus(corpus: DataFrame, asin: str, text: str = "text") -> DataFrame:
    """The reviews of one product, their texts scrubbed."""
    own = corpus.where(F.col("parent_asin") == asin)
    return own.withColumn(text, C.scrub_pii(text)) if text in own.columns else own


def _rank(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "review_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


SCHEMA = "question_id bigint, review_id string, score double"


def _best(scores, ids, k):
    """The top ``k`` columns of a score matrix per row; ties by id."""
    order = np.argsort(ids, kind="stable")
    s = scores[:, order]
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(s, top, axis=1), ids[order][top]


def retrieve_top_k(corpus: DataFrame, questions: DataFrame, k: int = 8,
                   same_product: bool = False) -> DataFrame:
    """Exact cosine top-k of every question: ``(question_id, review_id, score, rank)``.

    Global search takes the questions in slabs of about ``SLAB``, by hash of the id.  A slab's
    matrix is broadcast; each Arrow batch of the corpus is scored against it with a running top-k
    per task, so a task returns ``k`` rows per question whatever its share of the corpus.  With ``same_product`` only reviews of the
    question's product compete, found by an equi-join in bounded chunks.
    """
    q = questions.select("question_id", C.l2_normalize("embedding").alias("v"),
                         *(["parent_asin"] if same_product else []))
    c = corpus.select("review_id", C.l2_normalize("embedding").alias("v"),
                      *(["parent_asin"] if same_product else []))

    def block(points, visitors):
        scores = (matrix(visitors["v"]) @ matrix(points["v"]).T).round(9)
        best, ids = _best(scores, points["id"].to_numpy(dtype=str), k)
        return pd.DataFrame({
            "question_id": np.repeat(visitors["id"].to_numpy(), best.shape[1]),
            "review_id": ids.ravel(), "score": best.ravel()})

    if same_product:
        return _rank(block_join(
            c.select(F.col("review_id").alias("id"), "v", F.col("parent_asin").alias("cell")),
            q.select(F.col("question_id").alias("id"), "v", F.col("parent_asin").alias("cell")),
            block, SCHEMA), k)

    slabs = math.ceil(q.count() / SLAB)
    found = None
    for slab in range(slabs):
        rows = q.where(F.pmod(F.xxhash64("question_id"), F.lit(slabs)) == slab).collect()
        if rows:
            best = _scan(c, rows, k)
            found = best if found is None else found.unionByName(best)
    return _rank(corpus.sparkSession.createDataFrame([], SCHEMA) if found is None else found, k)


def _scan(corpus: DataFrame, questions: list, k: int) -> DataFrame:
    """The best ``k`` of each task for a slab of questions."""
    shared = corpus.sparkSession.sparkContext.broadcast((
        np.array([r["question_id"] for r in questions], dtype=np.int64),
        np.array([r["v"] for r in questions], dtype=np.float64)))

    def scan(batches):
        qids, m = shared.value
        scores, ids = np.empty((len(qids), 0)), np.empty((len(qids), 0), dtype=str)
        for pdf in batches:
            if not len(pdf) or not len(qids):
                continue
            s, i = _best((m @ matrix(pdf["v"]).T).round(9),
                         pdf["review_id"].to_numpy(dtype=str), k)
            s, i = np.concatenate([scores, s], axis=1), np.concatenate([ids, i], axis=1)
            top = np.lexsort((i, -s), axis=-1)[:, :k]
            scores, ids = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        yield pd.DataFrame({"question_id": np.repeat(qids, scores.shape[1]),
                            "review_id": ids.ravel(), "score": scores.ravel()})

    return corpus.mapInPandas(scan, SCHEMA)


def post_filter_product(candidates: DataFrame, corpus: DataFrame, questions: DataFrame,
                        k: int = 8) -> DataFrame:
    """Keep candidates of the question's own product; may leave nothing."""
    owner = corpus.select("review_id", "parent_asin")
    kept = (candidates.drop("rank").join(owner, "review_id")
            .join(questions.select("question_id", "parent_asin"), ["question_id", "parent_asin"],
                  "left_semi"))
    return _rank(kept.drop("parent_asin"), k)


def snippets(candidates: DataFrame, texts: DataFrame, chars: int = 1000) -> DataFrame:
    """Candidates with their scrubbed text and date; blank texts drop out.

    Texts are scrubbed before they are cut, so that no half of an address survives.  Only texts of candidates are scrubbed:
    they are written first, since the optimiser would move the test for blank texts, and the scrubbing with it, below a join.
    """
    candidates = materialize(candidates, "candidates")
    own = materialize(texts.select("review_id", "text", "date").join(
        candidates.select("review_id").distinct(), "review_id", "left_semi"), "texts")
    t = own.select("review_id", F.substring(C.scrub_pii("text"), 1, chars).alias("text"), "date")
    return candidates.join(t, "review_id").where(F.trim("text") != "")


# ---------------------------------------------------------------- TF-IDF search

def text_counts(texts: DataFrame, tasks: int) -> DataFrame:
    """``(review_id, _p, term, tf)`` of ``(review_id, _p, text)``: the words of ``columns.topic_tokens``, those of one key's rows together.

    Words are split and counted by Arrow where the rows of an id meet; a key holds one row per word there, however many texts it has.
    """
    stop = list(C.STOP_WORDS)

    def count(batches):
        keys, held, rows, own = ["review_id", "_p", "term"], [], 0, []

        def merged():
            return pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("tf", "sum")]).rename_columns([*keys, "tf"])

        for batch in batches:
            own.append(pa.table({c: batch.column(c) for c in keys[:2]}))
            split = pc.split_pattern_regex(batch.column("text"), "[^a-z0-9]+")
            at, term = pc.list_parent_indices(split), pc.list_flatten(split)
            kept = pc.and_not(pc.greater(pc.binary_length(term), 2), pc.is_in(term, value_set=pa.array(stop)))
            at, term = at.filter(kept), term.filter(kept)
            # a number for a row is a narrower key than its id and product
            part = pa.table({"at": at, "term": term}).group_by(["at", "term"], use_threads=False).aggregate([([], "count_all")])
            at = part.column("at")
            held.append(pa.table({"review_id": batch.column("review_id").take(at), "_p": batch.column("_p").take(at),
                                  "term": part.column("term"), "tf": part.column("count_all")}))
            rows += len(part)
            if rows > POSTINGS:
                held, rows = [merged()], 0
        if held:
            own = pa.concat_tables(own)
            apart = len(own.group_by(keys[:2], use_threads=False).aggregate([])) == len(own)
            for part in held if apart else [merged()]:  # keys that have one text each are counted already
                yield from part.to_batches(max_chunksize=100_000)

    moved = texts.withColumn("text", F.lower("text")).repartition(tasks, "review_id")
    return moved.mapInArrow(count, "review_id string, _p string, term string, tf bigint")


def tfidf_search(questions: DataFrame, texts: DataFrame, k: int = 20, product: str = "parent_asin") -> DataFrame:
    """Top-k texts of the question's product by TF-IDF cosine: ``(question_id, review_id, score, rank)``.

    Texts are scrubbed inside their row and move once, to tasks of about ``TEXTS`` texts that count their words.
    Document frequencies cover the whole corpus and every term counts, however rare.  A question meets the reviews of
    its own product that share a term with it, and pair scores are summed map-side.

    Postings stay where they were counted: the ``COMMON`` most frequent terms are broadcast with their weights, every other
    weight lies between two numbers, so each score has bounds.  Only texts whose upper bound reaches the k-th lower bound of a question
    get their norm from all terms; no other text can be among the first ``k``.
    """
    spark = texts.sparkSession
    n = texts.count()
    tf = text_counts(texts.select("review_id", F.col(product).alias("_p"), C.scrub_pii("text").alias("text")),
                     max(spark.sparkContext.defaultParallelism, -(-n // TEXTS)))
    tf = materialize(tf, "postings")
    idf = materialize(tf.groupBy("term").agg((F.log((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf")), "vocabulary")
    # only reviews of an asked product can win
    products = questions.select(F.col(product).alias("_p")).distinct()
    own = tf.join(products, "_p", "left_semi")

    asked = (questions.select("question_id", F.col(product).alias("_p"), F.explode(C.topic_tokens("question")).alias("term"))
             .groupBy("question_id", "_p", "term").agg(F.count("*").alias("tf")))
    qt = materialize(asked.join(idf, "term").select("question_id", "_p", "term", (F.col("tf") * F.col("idf")).alias("qw"), "idf"), "asked")
    dots = (tf.join(qt, ["_p", "term"]).groupBy("question_id", "review_id")
            .agg(F.sum(F.col("qw") * (F.col("tf") * F.col("idf"))).alias("dot")))
    qnorms = qt.groupBy("question_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))

    common = materialize(idf.orderBy("idf", "term").limit(COMMON), "common")
    low, high = common.agg(F.max("idf")).first()[0], idf.agg(F.max("idf")).first()[0]

    def norm(rest):
        w = F.col("tf") * F.coalesce("idf", F.lit(rest).cast("double"))
        return F.sqrt(F.sum(w * w))

    norms = own.join(F.broadcast(common), "term", "left").groupBy("review_id").agg(norm(low).alias("least"), norm(high).alias("most"))
    bounds = materialize(dots.join(norms, "review_id").join(qnorms, "question_id").select(
        "question_id", "review_id", "dot", "qnorm", (F.col("dot") / (F.col("most") * F.col("qnorm"))).alias("low"),
        (F.col("dot") / (F.col("least") * F.col("qnorm"))).alias("high")), "bounds")
    best = Window.partitionBy("question_id").orderBy(F.desc("low"), "review_id")
    floor = bounds.select("question_id", "review_id", "low").withColumn("_n", F.row_number().over(best)).where(
        F.col("_n") == k).select("question_id", F.col("low").alias("floor"))
    reach = materialize(bounds.join(floor, "question_id", "left").where(
        F.col("floor").isNull() | (F.col("high") >= F.col("floor") - SLACK)).select("question_id", "review_id", "dot", "qnorm"), "reach")

    # a part of the vocabulary is hashed where its postings are, which then need no sorting by word
    weighted = materialize(own.join(reach.select("review_id").distinct(), "review_id", "left_semi").join(
        idf.hint("shuffle_hash"), "term").select("review_id", (F.col("tf") * F.col("idf")).alias("w")), "weights")
    exact = weighted.groupBy("review_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return _rank(reach.join(exact, "review_id").select(
        "question_id", "review_id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 9).alias("score")), k)


def tfidf_rerank(candidates: DataFrame, questions: DataFrame, k: int = 8) -> DataFrame:
    """Rerank each question's candidates by TF-IDF fitted on the question and them.

    ``candidates`` holds a bounded number of rows per question (the search's k).
    """
    cand = candidates.select("question_id", "review_id", "text", "score", "date",
                             F.struct("question_id", "review_id").alias("doc"))
    ask = questions.select("question_id", F.col("question").alias("text"),
                           F.struct("question_id", F.lit(None).cast("string").alias("review_id"))
                           .alias("doc"))
    both = cand.select("doc", "text").unionByName(ask.select("doc", "text"))
    tf = term_counts(both, "doc").select(
        F.col("doc.question_id").alias("question_id"), F.col("doc.review_id").alias("review_id"),
        "term", "tf")
    size = both.groupBy(F.col("doc.question_id").alias("question_id")).agg(F.count("*").alias("n"))
    per_term = Window.partitionBy("question_id", "term")
    w = tf.join(size, "question_id").withColumn(
        "w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.count("*").over(per_term))) + 1))
    w = w.withColumn("qw", F.max(F.when(F.col("review_id").isNull(), F.col("w"))).over(per_term))
    dots = w.groupBy("question_id", "review_id").agg(
        F.sum(F.col("w") * F.coalesce("qw", F.lit(0.0))).alias("dot"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    qn = dots.where("review_id is null").select("question_id", F.col("norm").alias("qnorm"))
    scored = (dots.where("review_id is not null").join(qn, "question_id", "left")
              .select("question_id", "review_id",
                      F.round(F.coalesce(F.try_divide("dot", F.col("norm") * F.col("qnorm")),
                                         F.lit(0.0)), 9).alias("rerank_score")))
    out = cand.drop("doc").join(scored, ["question_id", "review_id"], "left").na.fill(
        0.0, ["rerank_score"])
    order = Window.partitionBy("question_id").orderBy(F.desc("rerank_score"), F.desc("score"), "review_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank_topk(candidates: DataFrame, questions: DataFrame,
                scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None,
                k: int = 8) -> DataFrame:
    """Rerank by a pair scorer applied in Arrow batches; without one the order stays."""
    if scorer is None:
        return candidates.where(F.col("rank") <= k).withColumn("rerank_score", F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def score(question: pd.Series, text: pd.Series) -> pd.Series:
        return scorer(question, text)

    scored = candidates.join(questions.select("question_id", "question"), "question_id").withColumn(
        "rerank_score", score("question", "text")).drop("rank", "question")
    order = Window.partitionBy("question_id").orderBy(F.desc("rerank_score"), F.desc("score"), "review_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
