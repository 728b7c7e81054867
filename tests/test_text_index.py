"""The blocked text index against the search that counts everything."""

import random

import pytest
from pyspark.sql import functions as F

from opinara.operators import retrieval, textindex

WORDS = ["battery", "screen", "cable", "noise", "sound", "button", "price", "weight", "colour", "smell"]
TEXTS = "review_id string, parent_asin string, text string"
ASKED = "question_id bigint, parent_asin string, question string"


def corpus(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [w for w in WORDS for _ in range(rng.choice([0, 0, 0, 1, 1, 4]))]
        rng.shuffle(words)
        rows.append((str(i), rng.choice(["p", "p", "p", "q", None]), " ".join(words)))
    rows += [("blank", "p", ""), ("none", "p", None), ("mail", "p", "battery joe.doe@mail.example.com")]
    asked = [(i, rng.choice("pqr"), " ".join(rng.sample(WORDS, rng.randrange(1, 5)))) for i in range(25)]
    asked += [(100, None, "battery"), (101, "p", "unknown"), (102, "p", None), (103, "p", "battery battery battery cable")]
    return spark.createDataFrame(rows, TEXTS).repartition(3), spark.createDataFrame(asked, ASKED)


@pytest.mark.parametrize("block,k", [(4, 3), (16, 10), (1000, 5)])
def test_equals_the_search_without_index(spark, tmp_path, monkeypatch, block, k):
    monkeypatch.setattr(textindex, "BLOCK", block)
    texts, asked = corpus(spark, 300, block)
    path = str(tmp_path / "ix")
    textindex.build_text_index(texts, path)
    want = sorted(map(tuple, retrieval.tfidf_search(asked, texts, k).collect()))
    assert sorted(map(tuple, textindex.search_text_index(spark, path, asked, k).collect())) == want
    assert {r[0] for r in want} <= {*range(25), 103}
    assert textindex.search_text_index(spark, path, asked.limit(0), k).collect() == []


def test_blocks_out_of_reach_are_not_read(spark, tmp_path, monkeypatch):
    """One text in a thousand has the asked word often: its block alone is read in full."""
    monkeypatch.setattr(textindex, "BLOCK", 20)
    rows = [(str(i), "p", "battery " * (30 if i == 7 else 1) + " ".join(WORDS[1:])) for i in range(1000)]
    texts = spark.createDataFrame(rows, TEXTS)
    asked = spark.createDataFrame([(1, "p", "battery")], ASKED)
    path, read = str(tmp_path / "ix"), []
    textindex.build_text_index(texts, path)
    scores = textindex._scores
    monkeypatch.setattr(textindex, "_scores", lambda rows, k: read.append(rows.select("block").distinct().count()) or scores(rows, k))
    best = textindex.search_text_index(spark, path, asked, 1).collect()
    assert [r["review_id"] for r in best] == ["7"] and read == [textindex.FIRST, 1]
    assert spark.read.parquet(f"{path}/postings").select("block").distinct().count() > 30
    assert spark.read.parquet(f"{path}/postings").where(F.col("most") > 1.0 + 1e-9).count() == 0


def test_a_products_words_go_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "TEXTS", 50)
    monkeypatch.setattr(textindex, "BLOCK", 16)
    texts, asked = corpus(spark, 300, 3)
    path = str(tmp_path / "ix")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        textindex.build_text_index(texts, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.parquet(f"{path}/postings").select("p", F.input_file_name().alias("f")).distinct().groupBy("p").agg(
        F.count("*").alias("n"))
    assert {r["p"] for r in files.where("n > 1").collect()} == {"p", "q"}
    want = sorted(map(tuple, retrieval.tfidf_search(asked, texts, 4).collect()))
    assert sorted(map(tuple, textindex.search_text_index(spark, path, asked, 4).collect())) == want
