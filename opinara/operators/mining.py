"""Embeddings, clusters, topics and classification with MLlib.

Vocabularies are capped, so the models that reach the driver have a fixed size; the
documents never leave the executors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import (IDF, PCA, CountVectorizer, Normalizer, StringIndexer)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..session import materialize, scratch_path
from .analytics import classification_report
from .preprocess import top_per_group

ASPECT = "aspect_term_normalized"
SUMS = 1_000_000    # rows of sums by word that a task holds before it merges them


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a hash of key and seed: the same rows on every run."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(order, key).limit(n)


def split_train_test(df: DataFrame, key: str, train: float = 0.8, seed: int = 42):
    """Hash split: a row stays on its side whatever else is in the table."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000))
    return df.where(bucket < int(train * 10_000)), df.where(bucket >= int(train * 10_000))


def counted_words(df: DataFrame, key: str = "review_id", col: str = "text") -> DataFrame:
    """``(key, words, n)``: the different words of ``columns.topic_tokens``, joined by spaces, and how often each occurs, as 32-bit
    numbers in a row; one row per row of ``df``.

    Words are split and counted by Arrow where the text lies, and a text moves as two values, not as lists of words.
    """
    stop = list(C.STOP_WORDS)

    def count(batches):
        for batch in batches:
            split = pc.split_pattern_regex(batch.column("text"), "[^a-z0-9]+")
            at, word = pc.list_parent_indices(split), pc.list_flatten(split)
            kept = pc.and_not(pc.greater(pc.binary_length(word), 2), pc.is_in(word, value_set=pa.array(stop)))
            part = pa.table({"at": at.filter(kept), "word": word.filter(kept)}).group_by(["at", "word"], use_threads=False).aggregate(
                [([], "count_all")])
            at = part.column("at").to_numpy()
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(len(batch) + 1)).astype("int32")
            words = pa.ListArray.from_arrays(ends, part.column("word").take(pa.array(order)).combine_chunks())
            n = part.column("count_all").to_numpy()[order].astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(key), pc.binary_join(words, " "),
                                              pa.array([n[4 * x: 4 * y] for x, y in zip(ends, ends[1:])], pa.binary())], [key, "words", "n"])

    kind = T.StructType([df.schema[key]]).add("words", "string").add("n", "binary")
    return df.select(key, F.lower(F.coalesce(col, F.lit(""))).alias("text")).mapInArrow(count, kind)


def _unpacked(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Row, word and number of every count of `counted_words`."""
    split = pc.split_pattern(batch.column("words"), " ")
    at, word = pc.list_parent_indices(split), pc.list_flatten(split)
    real = pc.not_equal(word, "")
    return at.filter(real), word.filter(real), np.frombuffer(b"".join(batch.column("n").to_pylist()), "<i4")


def word_sums(counted: DataFrame, group: str | None = None, weight: str | None = None) -> DataFrame:
    """``(group, word, n, texts)``: occurrences of each word, times a text's weight, and in how many texts; summed inside the tasks first."""
    keys = [group, "word"] if group else ["word"]

    def merged(held):
        return pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("texts", "sum")]).rename_columns(
            [*keys, "n", "texts"])

    def add(batches):
        held, rows = [], 0
        for batch in batches:
            at, word, n = _unpacked(batch)
            n = n.astype("int64")
            if weight:
                n = n * batch.column(weight).take(at).to_numpy(zero_copy_only=False)
            own = {group: batch.column(group).take(at)} if group else {}
            held.append(merged([pa.table({**own, "word": word, "n": n, "texts": np.ones(len(n), "int64")})]))
            rows += len(held[-1])
            if rows > SUMS:
                held = [merged(held)]
                rows = len(held[0])
                if 2 * rows > SUMS:
                    yield from held[0].to_batches(max_chunksize=100_000)
                    held, rows = [], 0
        if held:
            yield from merged(held).to_batches(max_chunksize=100_000)

    kind = T.StructType([counted.schema[c] for c in [group] if c]).add("word", "string").add("n", "long").add("texts", "long")
    rows = counted.select(*[c for c in (group, weight) if c], "words", "n").mapInArrow(add, kind)
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def _vocabulary(counted: DataFrame, size: int | None, min_df: int = 1, max_df: float | None = None) -> list[str]:
    """The ``size`` most frequent words, or all, of those that stand in ``min_df`` to ``max_df`` texts."""
    words = word_sums(counted).where(F.col("texts") >= min_df)
    if max_df is not None:
        words = words.where(F.col("texts") <= max_df)
    words = words.orderBy(F.desc("n"), "word").select("word")
    return [r[0] for r in (words if size is None else words.limit(size)).collect()]


def _features(counted: DataFrame, key: str, vocabulary: list[str]) -> DataFrame:
    """``(key, features)``: counts by place in the vocabulary as sparse vectors, written once."""
    size, known = len(vocabulary), pa.array(vocabulary, pa.string())

    def place(batches):
        for batch in batches:
            at, word, n = _unpacked(batch)
            ix = pc.index_in(word, value_set=known)
            own = pc.is_valid(ix).to_numpy(zero_copy_only=False)
            at, ix, n = at.to_numpy()[own], ix.to_numpy(zero_copy_only=False)[own], n[own]
            order = np.lexsort((ix, at))
            ends = np.searchsorted(at[order], np.arange(len(batch) + 1)).astype("int32")
            rows = len(batch)
            yield pa.RecordBatch.from_arrays([
                batch.column(key), pa.array(np.zeros(rows, "int8")), pa.array(np.full(rows, size, "int32")),
                pa.ListArray.from_arrays(ends, pa.array(ix[order].astype("int32"))),
                pa.ListArray.from_arrays(ends, pa.array(n[order].astype("float64")))], [key, "type", "size", "indices", "values"])

    own = T.StructType([counted.schema[key]])
    kind = T.StructType([*own.fields]).add("type", "byte").add("size", "integer").add("indices", T.ArrayType(T.IntegerType())).add(
        "values", T.ArrayType(T.DoubleType()))
    rows = counted.select(key, "words", "n").mapInArrow(place, kind)
    path = scratch_path(counted.sparkSession, "features")
    # a struct of these four fields is how a vector is stored: it is read back as one
    rows.select(key, F.struct("type", "size", "indices", "values").alias("features")).write.parquet(path)
    return counted.sparkSession.read.schema(own.add("features", VectorUDT())).parquet(path)


def embed_texts(df: DataFrame, key: str = "review_id", col: str = "text",
                encoder: Callable[[pd.Series], pd.Series] | None = None, max_features: int = 1024,
                dims: int = 384, counted: DataFrame | None = None) -> DataFrame:
    """Unit vectors ``(key, embedding)``, one per row: a given encoder in Arrow batches, else TF-IDF
    reduced to at most ``dims`` principal components.  A text without topic words is the zero vector.

    Words are counted once; the fits read the counts.  ``counted`` are those of `counted_words`, when they have been written before.
    """
    if encoder is not None:
        run = F.pandas_udf(encoder, "array<float>")
        return df.select(key, C.l2_normalize(run(F.col(col))).cast("array<float>").alias("embedding"))
    counted = materialize(counted_words(df, key, col), "counted") if counted is None else counted
    vocabulary = _vocabulary(counted, max_features)
    counts = _features(counted, key, vocabulary)
    stages = Pipeline(stages=[IDF(inputCol="features", outputCol="tfidf"),
                              PCA(k=min(dims, len(vocabulary)), inputCol="tfidf", outputCol="pc"),
                              Normalizer(inputCol="pc", outputCol="unit")])
    out = stages.fit(counts).transform(counts)
    return out.select(key, vector_to_array("unit", "float32").alias("embedding"))


def pca_2d(df: DataFrame, key: str = "vec_id", col: str = "embedding") -> DataFrame:
    """First two principal components for a scatter view."""
    v = df.select(key, array_to_vector(F.col(col).cast("array<double>")).alias("v"))
    xy = vector_to_array("pc")
    return PCA(k=2, inputCol="v", outputCol="pc").fit(v).transform(v).select(
        key, xy[0].alias("x"), xy[1].alias("y"))


def _filtered(mentions: DataFrame, sentiment: str | None, category: str | None) -> DataFrame:
    if sentiment:
        mentions = mentions.where(F.col("sentiment") == sentiment)
    if category:
        mentions = mentions.where(F.col("main_category") == category)
    return mentions


def _top_map(df: DataFrame, group: str, item: str, n: int, name: str) -> DataFrame:
    """The ``n`` most frequent items per group as a map with their counts."""
    counts = df.groupBy(group, item).agg(F.sum("k").alias("k"))
    top = top_per_group(counts, [group], [F.desc("k"), item], n)
    return top.groupBy(group).agg(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", item, "k"))),
        lambda s: F.struct(s[item], s["k"]))).alias(name))


def kmeans(vectors: DataFrame, k: int = 8, key: str = "review_id", col: str = "embedding",
           seed: int = 42) -> DataFrame:
    """``(key, cluster)`` of all vectors; no sample is taken.

    The vectors are written first: the fit reads them again and again, twice at once for their norms, and a join or an encoder
    behind them would run each time.
    """
    v = materialize(vectors.select(key, col), "vectors").select(key, array_to_vector(F.col(col).cast("array<double>")).alias("v"))
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(v)
    return model.transform(v).select(key, "cluster")


def kmeans_profile(mentions: DataFrame, texts: DataFrame, vectors: DataFrame, k: int = 8,
                   category: str | None = None, sentiment: str | None = "Negative",
                   seed: int = 42, counted: DataFrame | None = None) -> DataFrame:
    """Clusters of the matching reviews: size in mentions, mean score, most frequent
    aspects and words, three sample texts.  ``counted`` are the texts' `counted_words`, when they have been written before."""
    m = _filtered(mentions, sentiment, category)
    counts = materialize(m.groupBy("review_id", ASPECT).agg(F.count("*").alias("k"), F.sum("sentiment_score").alias("s")), "mentions")
    per_review = counts.groupBy("review_id").agg(F.sum("k").alias("k"), F.sum("s").alias("s"))
    chosen = kmeans(vectors.join(per_review, "review_id", "left_semi"), k, seed=seed)
    chosen = materialize(chosen.join(per_review, "review_id"), "clusters")
    base = chosen.groupBy("cluster").agg(F.sum("k").alias("size"),
                                         (F.sum("s") / F.sum("k")).alias("avg_sentiment"))
    aspects = counts.select("review_id", ASPECT, "k").join(chosen.select("review_id", "cluster"), "review_id")
    t = (counted_words(texts) if counted is None else counted).join(chosen.select("review_id", "cluster", "k"), "review_id")
    words = word_sums(t, "cluster", "k").select("cluster", F.col("n").alias("k"), "word")
    # the first ids of each cluster, then only their texts: a window over whole texts would sort all of them
    first = materialize(top_per_group(chosen.join(texts.select("review_id"), "review_id", "left_semi").select("cluster", "review_id"),
                                      ["cluster"], ["review_id"], 3).select("cluster", "review_id"), "first")
    shown = first.join(texts.select("review_id", "text"), "review_id")
    samples = top_per_group(shown, ["cluster"], ["review_id"], 3).groupBy("cluster").agg(
        F.array_sort(F.collect_list(F.substring("text", 1, 300))).alias("samples"))
    return (base.join(_top_map(aspects, "cluster", ASPECT, 5, "top_aspects"), "cluster", "left")
            .join(_top_map(words, "cluster", "word", 10, "top_words"), "cluster", "left")
            .join(samples, "cluster", "left"))


def mention_cells(mentions: DataFrame) -> DataFrame:
    """Mentions ``k`` per category, sentiment, review and aspect, as far as the table has these columns."""
    keys = [c for c in ("main_category", "sentiment", "review_id", ASPECT) if c in mentions.columns]
    return mentions.groupBy(*keys).agg(F.count("*").alias("k"))


def lda_topics(mentions: DataFrame, texts: DataFrame, k: int = 10, sentiment: str | None = "Negative",
               category: str | None = None, min_reviews: int = 20, max_iter: int = 20,
               vocab_size: int | None = 50_000, weight: float = 0.3, seed: int = 42,
               cells: DataFrame | None = None, counted: DataFrame | None = None,
               docs: DataFrame | None = None) -> DataFrame | None:
    """Topics of the matching reviews: words with weights, documents above ``weight`` and
    their most frequent aspects, joined by review id.  None with too few reviews.

    The vocabulary, at most the ``vocab_size`` most frequent words, is collected; None takes all words, however many.
    ``topics.category_topics`` is the way without a vocabulary on the driver.  ``cells`` are the counts of `mention_cells`, ``counted``
    the texts' `counted_words` and ``docs`` those of the matching reviews, when they have been written before.

    The fit samples the texts anew in each iteration, and every iteration reads all of them: they are turned into counts by word
    once and lie on the disks of their tasks, in the partitions and order in which they were read, since the sampler goes by these.
    """
    if docs is None:
        ids = _filtered(mentions, sentiment, category).select("review_id").distinct()
        # a text moves as its counted words
        docs = materialize((counted_words(texts) if counted is None else counted).join(ids, "review_id", "left_semi"), "docs")
    docs = docs.where(F.col("words") != "").select("review_id", "words", "n")
    size = docs.count()
    if size < min_reviews:
        return None
    vocabulary = _vocabulary(docs, vocab_size, 2, 0.5 * size)
    vectors = _features(docs, "review_id", vocabulary).persist(StorageLevel.DISK_ONLY)
    model = LDA(k=k, seed=seed, maxIter=max_iter, optimizer="online", optimizeDocConcentration=True).fit(vectors)
    spark = mentions.sparkSession
    vocab = spark.createDataFrame(list(enumerate(vocabulary)), "idx int, word string")
    terms = model.describeTopics(10).select(
        F.col("topic").alias("topic_id"),
        F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "t"))
    named = terms.join(vocab, F.col("t.termIndices") == F.col("idx")).groupBy("topic_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "word", F.col("t.termWeights").alias("p")))).alias("w"))
    shares = model.transform(vectors).select(
        "review_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic_id", "p"))
    strong = materialize(shares.where(F.col("p") > weight).select("review_id", "topic_id"), "topics")
    vectors.unpersist()
    aspects = (_filtered(mention_cells(mentions) if cells is None else cells, sentiment, category).select("review_id", ASPECT, "k")
               .join(strong, "review_id"))
    n = strong.groupBy("topic_id").agg(F.count("*").alias("document_count"))
    return (
        named.select("topic_id", F.transform("w", lambda s: s["word"]).alias("words"),
                     F.transform("w", lambda s: s["p"]).alias("probabilities"))
        .join(n, "topic_id", "left")
        .join(_top_map(aspects, "topic_id", ASPECT, 5, "top_aspects"), "topic_id", "left")
        .na.fill(0, ["document_count"])
    )


def category_topics(mentions: DataFrame, texts: DataFrame, k: int = 5, counted: DataFrame | None = None, **params) -> DataFrame:
    """Topics of every category.  One model per category, so the loop is over the few
    category names; each model is trained on the cluster.  Mentions are counted once for all of them, and the texts' words too:
    they meet their categories in one join."""
    cells = materialize(mention_cells(mentions), "cells")
    names = [r[0] for r in cells.where("main_category is not null").select("main_category")
             .distinct().orderBy("main_category").collect()]
    own = _filtered(cells, params.get("sentiment", "Negative"), None).where("main_category is not null").select(
        "review_id", "main_category").distinct()
    docs = materialize((counted_words(texts) if counted is None else counted).join(own, "review_id"), "docs")
    out = None
    for name in names:
        topics = lda_topics(mentions, texts, k, category=name, cells=cells, docs=docs.where(F.col("main_category") == name), **params)
        if topics is not None:
            topics = topics.withColumn("main_category", F.lit(name))
            out = topics if out is None else out.unionByName(topics)
    if out is None:
        raise ValueError("no category has enough reviews")
    return out


def classify_reviews(df: DataFrame, key: str = "review_id", col: str = "text", max_features: int = 5000,
                     max_iter: int = 200, seed: int = 42) -> DataFrame:
    """Rating class from text: hash split, TF-IDF, logistic regression; returns the test
    side's labels and predictions."""
    data = df.where("rating is not null").select(
        key, C.topic_tokens(col).alias("tokens"), C.rating_label().alias("label_text"))
    data = materialize(data, "labelled")
    train, test = split_train_test(data, key, seed=seed)
    index = StringIndexer(inputCol="label_text", outputCol="label", stringOrderType="alphabetAsc",
                          handleInvalid="keep")
    model = Pipeline(stages=[
        index, CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=max_features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(maxIter=max_iter, regParam=0.01)]).fit(train)
    names = model.stages[0].labels
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("prediction").cast("int"))
    return model.transform(test).select(key, F.col("label_text").alias("label"),
                                        label.alias("prediction"))


def classification_scores(df: DataFrame, **params) -> DataFrame:
    return classification_report(classify_reviews(df, **params))


def topic_report(mentions: DataFrame, texts: DataFrame, vectors: DataFrame, topics: int = 10,
                 clusters: int = 8, per_category: int = 5, counted: DataFrame | None = None, **params) -> dict[str, DataFrame]:
    """Topics, clusters and categories of the negative reviews, by table name.

    Mentions, which may come from an extraction, and the words of the texts are written once for all three; ``counted`` are the latter,
    when they have been written before.
    """
    mentions = materialize(mentions.select("review_id", ASPECT, "sentiment", "sentiment_score", "main_category"), "mentions")
    counted = materialize(counted_words(texts), "counted") if counted is None else counted
    tables = {"topics": lda_topics(mentions, texts, topics, counted=counted, **params),
              "clusters": kmeans_profile(mentions, texts, vectors, clusters, counted=counted),
              "categories": category_topics(mentions, texts, per_category, counted=counted, **params)}
    return {name: table for name, table in tables.items() if table is not None}
