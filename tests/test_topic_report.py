"""The report extracts mentions once, splits texts once, and its counts are those of the column expressions."""

import struct
from collections import Counter

import pytest
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import functions as F

from opinara.functions import columns as C
from opinara.operators import mining, text

ODD = [("a", "Red apple, RED apple! the to x1y ab"), ("b", ""), ("c", None), (None, "red plum"), ("a", "red"), ("d", "İnk 10K 100K é-über-red  "),
       ("e", " ... "), ("f", "the and to"), ("g", "\x00red plum\nplum 東京 naïve 😀red")]


def odd(spark):
    return spark.createDataFrame(ODD, "review_id string, text string").repartition(2)


def test_counted_words_are_the_topic_tokens(spark):
    df = odd(spark)
    want = Counter((r["review_id"], frozenset(Counter(r["t"]).items())) for r in df.select("review_id", C.topic_tokens("text").alias("t")).collect())
    got = Counter((r["review_id"], frozenset(zip(r["words"].split(), struct.unpack(f"<{len(r['n']) // 4}i", r["n"]), strict=True))) for r in mining.counted_words(df).collect())
    assert got == want and sum(got.values()) == len(ODD)
    assert mining.counted_words(df.limit(0)).collect() == []


def test_word_places_are_those_of_the_tokens(spark):
    df, wanted = odd(spark), ["red", "plum", "k", "10k", "to"]
    every = df.select("review_id", F.posexplode(text.tokens("text")).alias("i", "word")).where(F.col("word").isin(wanted))
    got = text.word_places(df, "review_id", "text", wanted)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, every.collect())) and got.count() > 8


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_sums_by_word(spark, monkeypatch, most):
    monkeypatch.setattr(mining, "SUMS", most)
    df = odd(spark).withColumns({"c": F.length("text") % 2, "k": F.lit(3).cast("bigint")})
    got = Counter({(r["c"], r["word"]): r["n"] for r in mining.word_sums(mining.counted_words(df).join(
        df.select("review_id", "c", "k").where("review_id <> 'a'"), "review_id"), "c", "k").collect()})
    want = Counter((r["c"], r["w"]) for r in df.where("review_id <> 'a'").select("c", F.explode(C.topic_tokens("text")).alias("w")).collect())
    assert got == Counter({k: 3 * n for k, n in want.items()}) and got
    assert {r["word"]: r["texts"] for r in mining.word_sums(mining.counted_words(df)).collect()}["plum"] == 2


def test_features_are_those_of_the_count_vectorizer(spark):
    counted = mining.counted_words(odd(spark))
    words = mining._vocabulary(counted, None)
    assert words[0] == "red" and mining._vocabulary(counted, 2) == words[:2] and mining._vocabulary(counted, None, 2, 3.0) == ["plum"]
    fitted = CountVectorizer(inputCol="tokens", outputCol="features", minDF=2.0, maxDF=0.5).fit(
        odd(spark).select(C.topic_tokens("text").alias("tokens")))
    assert set(fitted.vocabulary) == set(mining._vocabulary(counted, None, 2, 0.5 * len(ODD)))
    model = CountVectorizerModel.from_vocabulary(words[:3], "tokens", "features")
    want = model.transform(odd(spark).select("review_id", C.topic_tokens("text").alias("tokens"))).select("review_id", "features")
    got = mining._features(counted, "review_id", words[:3])
    assert Counter((r[0], r[1]) for r in got.collect()) == Counter((r[0], r[1]) for r in want.collect())


def test_mentions_and_texts_are_read_once(spark):
    seen, split = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def noted(counter):
        def run(batches):
            for batch in batches:
                counter.add(batch.num_rows)
                yield batch
        return run

    rows = [(f"{c}{i}", f"{c}one {c}two word{i % 5} word{(i + 1) % 5}", c) for c in "xy" for i in range(24)]
    found = [(r[0], "taste", "Negative", -1.0, r[2]) for r in rows] + [("x0", "cap", "Positive", 1.0, "x")]
    kind = f"review_id string, {mining.ASPECT} string, sentiment string, sentiment_score double, main_category string"
    mentions = spark.createDataFrame(found, kind).mapInArrow(noted(seen), kind)
    plain = spark.createDataFrame([r[:2] for r in rows], "review_id string, text string")
    counted = mining.materialize(mining.counted_words(plain.mapInArrow(noted(split), plain.schema)), "counted")
    vectors = mining.embed_texts(plain, dims=2, counted=counted)
    tables = mining.topic_report(mentions, plain, vectors, 2, 2, 2, counted=counted, max_iter=1)
    assert {name: table.count() for name, table in tables.items()} == {"topics": 2, "clusters": 2, "categories": 4}
    words = Counter()
    for r in tables["clusters"].collect():
        words.update(r["top_words"])
    assert sum(n for w, n in words.items() if w.startswith("word")) == 96 and words["xone"] == words["ytwo"] == 24
    assert (seen.value, split.value) == (len(found), len(rows))


def test_a_category_without_a_vocabulary_leaves_the_others(spark):
    rows = [(f"x{i}", "same words here", "x") for i in range(24)] + [(f"y{i}", f"yone word{i % 5} word{(i + 1) % 5}", "y") for i in range(24)]
    mentions = spark.createDataFrame([(r[0], "taste", "Negative", r[2]) for r in rows],
                                     f"review_id string, {mining.ASPECT} string, sentiment string, main_category string")
    texts = spark.createDataFrame([r[:2] for r in rows], "review_id string, text string")
    assert {r["main_category"] for r in mining.category_topics(mentions, texts, 2, max_iter=1).collect()} == {"y"}
