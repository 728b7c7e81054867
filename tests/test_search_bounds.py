"""The text search takes norms of few texts and counts words as the tokens say."""

import random
from collections import Counter

from opinara.functions import columns as C
from opinara.operators import retrieval
from pyspark.sql import functions as F

REVIEWS = "review_id string, parent_asin string, text string"


def recorded(monkeypatch, module):
    tables = []
    plain = module.materialize

    def note(df, name="stage"):
        tables.append((name, plain(df, name)))
        return tables[-1][1]

    monkeypatch.setattr(module, "materialize", note)
    return tables


def test_only_texts_that_can_win_get_their_norm(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    rows = [(str(i), f"p{i % 2}", " ".join(rng.choices(words, range(60, 0, -1), k=rng.randint(3, 30)))) for i in range(120)]
    rows += [(str(i), "p0", rows[4][2]) for i in range(200, 206)] + [("4", "p1", "word1 word2"), (None, "p0", "word1"), ("n", None, "word1")]
    texts = spark.createDataFrame(rows, REVIEWS)
    asked = spark.createDataFrame([(1, "p0", rows[4][2]), (2, "p1", "word0 word7 word59"), (3, "p1", "unknown")],
                                  "question_id bigint, parent_asin string, question string")
    found = {}
    for common in (1, 20, 1000):
        tables = recorded(monkeypatch, retrieval)
        monkeypatch.setattr(retrieval, "COMMON", common)
        found[common] = sorted(tuple(r) for r in retrieval.tfidf_search(asked, texts, 5).collect())
        weights = dict(tables)["weights"]
    assert found[1] == found[20] == found[1000] and len(found[1]) == 10
    assert [r[1] for r in found[1] if r[0] == 1] == ["200", "201", "202", "203", "204"]
    assert weights.select("review_id").distinct().count() < 25      # of 125 texts of the asked products


def test_words_are_counted_as_the_tokens_say(spark, monkeypatch):
    rows = [("1", "p", "Red APPLE, red-apple the Kelvin İstanbul straße x1 abc123"), ("1", "p", "red\nplum"), ("1", "q", "red"),
            (None, "p", "null id"), (None, "p", "null id"), ("2", None, "no product"), ("3", "p", None), ("4", "p", ""), ("5", "p", "\U0001f600ab\U0001f600abc")]
    df = spark.createDataFrame(rows, "review_id string, _p string, text string")
    want = Counter((r[0], r[1], r[2]) for r in df.select("review_id", "_p", F.explode(C.topic_tokens("text"))).collect())
    for most in (4_000_000, 1):
        monkeypatch.setattr(retrieval, "POSTINGS", most)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        got = [tuple(r) for r in retrieval.text_counts(df, 2).collect()]
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        assert len(got) == len(want) and {r[:3]: r[3] for r in got} == want
