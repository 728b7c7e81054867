"""Aspect extraction, polarity, JSON columns and term statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import lexicons as L
from ..schemas import ASPECTS
from ..session import materialize
from .quantiles import exact_quantiles

# Column names that are taken for the review text, best first.
TEXT_COLUMNS = ["review_body", "review_text", "content", "review", "text", "review_body_clean"]


# ---------------------------------------------------------------- schema helpers

def text_column_lengths(df: DataFrame) -> DataFrame:
    """Median text length of every string column, in column order."""
    strings = [c for c, t in df.dtypes if t == "string"]
    lengths = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.length(c).alias("len"))
        for i, c in enumerate(strings)
    ])).alias("s")).select("s.*")
    return exact_quantiles(lengths, ["ordinal", "column"], "len", {"median_length": 0.5})


def detect_text_column(df: DataFrame, min_length: int = 20) -> str | None:
    """A column with a known name, else the first string column of long texts."""
    for name in TEXT_COLUMNS:
        if name in df.columns:
            return name
    if "string" not in {t for _, t in df.dtypes}:
        return None
    hit = (text_column_lengths(df).where(F.col("median_length") > min_length)
           .orderBy("ordinal").limit(1).collect())
    return hit[0]["column"] if hit else None


def join_ground_truth(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Left join of reference labels on the review id."""
    return pred.join(truth.withColumnRenamed("aspects_json", "aspects_json_GT"), "review_id", "left")


def nfkc(df: DataFrame, col: str = "text") -> DataFrame:
    """Unicode compatibility normalisation, in Arrow batches (Spark has no such function)."""

    @F.pandas_udf("string")
    def normalize(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return df.withColumn(col, normalize(F.col(col)))


# ---------------------------------------------------------------- JSON and list columns

def _aspect_rows(df: DataFrame, aspects: Column, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(aspects).alias("pos", "a")).select(
        *keep, "pos", F.col("a.term").alias("aspect_term"),
        F.coalesce("a.sentiment", F.lit(C.NEUTRAL)).alias("sentiment"),
        F.coalesce("a.confidence", F.lit(1.0)).alias("confidence"))


def explode_aspects(scored: DataFrame, keep: Sequence[str] = ("review_id", "parent_asin"),
                    col: str = "aspects_json") -> DataFrame:
    """One row per aspect of the JSON column; rows with broken JSON yield nothing."""
    return _aspect_rows(scored, F.from_json(col, ASPECTS), keep)


def zip_aspects(df: DataFrame, keep: Sequence[str] = ("review_id",)) -> DataFrame:
    """One row per aspect of three parallel lists; short lists are filled up."""
    zipped = F.transform(
        F.arrays_zip(F.col("aspects"), F.col("sentiments"), F.col("confidence")),
        lambda z: F.struct(z["aspects"].alias("term"), z["sentiments"].alias("sentiment"),
                           z["confidence"].alias("confidence")))
    terms_only = F.filter(zipped, lambda z: z["term"].isNotNull())
    return _aspect_rows(df, terms_only, keep)


def aspects_to_json(col: Column | str = "aspects") -> Column:
    return F.to_json(col)


# ---------------------------------------------------------------- tokens

def tokens(c: Column | str) -> Column:
    """Lower-case ASCII words in order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")


def word_frequency(df: DataFrame, col: str = "text", n: int = 20,
                   stop_words: list[str] | None = None) -> DataFrame:
    """Most frequent topic words of all texts."""
    return (df.select(F.explode(C.topic_tokens(col, stop_words)).alias("word"))
            .groupBy("word").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "word").limit(n))


def vocabulary(df: DataFrame, col: str = "text", no_below: int = 2, no_above: float = 0.5) -> DataFrame:
    """Topic words by document frequency, the rare and the ubiquitous left out.

    Words are made distinct inside the row, so a plain count gives the documents.
    """
    toks = df.select(C.topic_tokens(col).alias("t")).where(F.size("t") > 0)
    docs = toks.agg(F.count("*")).scalar()
    return (toks.select(F.explode(F.array_distinct("t")).alias("term"))
            .groupBy("term").agg(F.count("*").alias("df"))
            .where((F.col("df") >= no_below) & (F.col("df") <= docs * no_above)))


def _grams(col: str, ngram: tuple[int, int], stop_words: list[str] | None) -> Column:
    low, high = ngram
    return C.let(
        C.topic_tokens(col, stop_words),
        lambda t: F.concat(*[t if n == 1 else C.ngrams(t, n) for n in range(low, high + 1)]),
    )


def term_counts(df: DataFrame, key: str, col: str = "text", ngram: tuple[int, int] = (1, 1),
                stop_words: list[str] | None = None) -> DataFrame:
    """``(key, term, tf)``.

    Texts stay where they are: only (key, term) rows move, counted before they do.
    """
    return (df.select(key, F.explode(_grams(col, ngram, stop_words)).alias("term"))
            .groupBy(key, "term").agg(F.count("*").alias("tf")))


def tfidf(df: DataFrame, key: str, col: str = "text", max_features: int = 5000,
          ngram: tuple[int, int] = (1, 1), stop_words: list[str] | None = None) -> DataFrame:
    """Sparse TF-IDF rows ``(key, term, tf, weight)``: smoothed idf, unit-length documents.

    The vocabulary is the ``max_features`` most frequent terms, so it may be broadcast,
    and no document holds more entries than that.  It is found from totals by term, combined map-side; counts by
    document are then taken of its terms alone.
    """
    each = df.select(key, F.explode(_grams(col, ngram, stop_words)).alias("term"))
    top = materialize(each.groupBy("term").agg(F.count("*").alias("_total"))
                      .orderBy(F.desc("_total"), "term").limit(max_features).select("term"), "vocabulary")
    tf = materialize(each.join(F.broadcast(top), "term").groupBy(key, "term").agg(F.count("*").alias("tf")), "counts")
    docs = df.agg(F.count("*")).scalar()
    vocab = tf.groupBy("term").agg((F.log((1 + docs) / (1 + F.count("*"))) + 1).alias("idf"))
    w = tf.join(F.broadcast(vocab), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", "tf", (F.col("w") / norm).alias("weight"))


# ---------------------------------------------------------------- lexicon scorers

def word_places(df: DataFrame, key: str, col: str, wanted: Sequence[str]) -> DataFrame:
    """``(key, i, word)``: the words of `tokens` that are wanted, with their number in the text, found by Arrow."""
    known = sorted(set(wanted))

    def find(batches):
        for batch in batches:
            split = pc.split_pattern_regex(batch.column("_text"), "[^a-z0-9]+")
            at, word = pc.list_parent_indices(split), pc.list_flatten(split)
            real = pc.not_equal(word, "")
            at, word = at.filter(real).to_numpy(zero_copy_only=False), word.filter(real)
            hit = pc.is_in(word, value_set=pa.array(known, pa.string()))
            place = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
            i = place - np.searchsorted(at, at[place])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at[place])), pa.array(i.astype("int32")), word.filter(hit)],
                                             [key, "i", "word"])

    kind = T.StructType([df.schema[key]]).add("i", "integer").add("word", "string")
    return df.select(key, F.lower(F.coalesce(col, F.lit(""))).alias("_text")).mapInArrow(find, kind)


def extract_aspects(reviews: DataFrame, aspects: Sequence[str] | None = None,
                    opinions: dict[str, float] | None = None, reach: int = 5,
                    key: str = "review_id", col: str = "text") -> DataFrame:
    """Aspect terms with the polarity of the nearest opinion word.

    A deterministic stand-in for a neural extractor.  Texts are split into words in full, by Arrow,
    but only lexicon hits leave their batch and are shuffled.  Confidence falls with the distance in words;
    without an opinion word in ``reach`` the mention is neutral with 0.5.
    """
    spark = reviews.sparkSession
    names = list(aspects or [v for vs in L.ASPECT_VARIANTS.values() for v in vs])
    weights = opinions or L.OPINION_WORDS
    terms = L.word_list(spark, names).withColumn("is_aspect", F.lit(True))
    polar = L.weight_table(spark, weights)
    hits = word_places(reviews, key, col, [*names, *weights]).join(F.broadcast(terms.join(polar, "word", "full")), "word")
    w = Window.partitionBy(key).orderBy("i")
    op = F.when(F.col("weight").isNotNull(), F.struct("i", "weight"))
    near = hits.withColumns({
        "_p": F.last(op, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_n": F.first(op, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    }).where("is_aspect")
    dp, dn = F.col("i") - F.col("_p.i"), F.col("_n.i") - F.col("i")
    far = reach + 1
    near = near.withColumns({"dp": F.coalesce(dp, F.lit(far)), "dn": F.coalesce(dn, F.lit(far))})
    dist = F.least("dp", "dn")
    weight = F.when(F.col("dp") <= F.col("dn"), F.col("_p.weight")).otherwise(F.col("_n.weight"))
    found = dist <= reach
    return near.select(
        key, F.col("i").alias("token_pos"), F.col("word").alias("term"),
        F.when(found & (weight > 0), C.POSITIVE).when(found & (weight < 0), C.NEGATIVE)
        .otherwise(C.NEUTRAL).alias("sentiment"),
        F.when(found, F.round(1 - (dist - 1) * 0.1, 2)).otherwise(0.5).alias("confidence"))


def score_reviews(reviews: DataFrame, key: str = "review_id", **lexicon) -> DataFrame:
    """Reviews with an ``aspects`` array; a review without aspects keeps an empty one."""
    found = extract_aspects(reviews, key=key, **lexicon).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("token_pos", "term", "sentiment",
                                                         "confidence"))),
                    lambda s: F.struct(s["term"].alias("term"), s["sentiment"].alias("sentiment"),
                                       s["confidence"].alias("confidence"))).alias("aspects"))
    return reviews.join(found, key, "left").withColumn(
        "aspects", F.coalesce("aspects", F.array().cast(ASPECTS)))


Scorer = Callable[[list[str]], list[list[dict]]]


def score_with_model(reviews: DataFrame, make_scorer: Callable[[], Scorer], batch_size: int = 32,
                     key: str = "review_id", col: str = "text") -> DataFrame:
    """Run a model over the texts, a batch at a time, one model per task.

    ``make_scorer`` builds the model inside the task.  Blank texts are skipped, and a
    batch that fails keeps its rows with an empty array and the error text.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            pdf = pdf[pdf[col].fillna("").str.strip() != ""]
            if pdf.empty:
                continue
            aspects, errors = [], []
            for start in range(0, len(pdf), batch_size):
                texts = pdf[col].iloc[start:start + batch_size].tolist()
                try:
                    aspects += scorer(texts)
                    errors += [None] * len(texts)
                except Exception as exc:  # the batch is kept and reported
                    aspects += [[] for _ in texts]
                    errors += [str(exc)] * len(texts)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "aspects": pd.Series(aspects, dtype=object),
                                "error": pd.Series(errors, dtype=object)})

    schema = (f"{key} string, aspects array<struct<term:string,sentiment:string,"
              "confidence:double>>, error string")
    return reviews.select(key, col).mapInPandas(score, schema)


def text_polarity(df: DataFrame, col: str = "text",
                  opinions: dict[str, float] | None = None,
                  negations: Sequence[str] | None = None) -> DataFrame:
    """Mean weight of the opinion words, sign flipped after a negation; 0 without any.

    A deterministic stand-in for a rule-based polarity library.  The lexicon is small and
    fixed, so everything happens inside the row: no token and no text is shuffled.
    """
    weights = dict(opinions or L.OPINION_WORDS)
    flips = list(negations or L.NEGATIONS)
    lexicon = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
    pairs = C.let(tokens(col), lambda t: F.filter(
        F.zip_with(t, F.concat(F.array(F.lit("")), t),
                   lambda w, p: F.struct(w.alias("word"), p.alias("prev"))),
        lambda s: s["word"].isin(list(weights))))
    signed = F.transform(pairs, lambda s: F.when(
        s["prev"].isin(flips), -lexicon[s["word"]]).otherwise(lexicon[s["word"]]))
    mean = C.let(signed, lambda a: F.try_divide(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x), F.size(a)))
    return df.withColumn("polarity", F.coalesce(mean, F.lit(0.0)))
