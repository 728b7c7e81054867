"""What is written and moved on the way: only what the result needs, with the same results."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinara.functions import columns as C
from opinara.operators import mining, retrieval, text

TEXTS = [(1, "red apple pie red apple"), (2, "green apple tart"), (3, "red plum"), (4, None), (3, "plum plum jam")]


@pytest.fixture
def written(monkeypatch):
    """Tables by name that the operators write."""
    tables = {}
    for module in (mining, retrieval, text):
        def record(df, name="stage", write=getattr(module, "materialize", None)):
            tables[name] = write(df, name)
            return tables[name]

        monkeypatch.setattr(module, "materialize", record)
    return tables


def grams(words):
    return words + [" ".join(p) for p in zip(words, words[1:])]


def test_counts_by_document_are_taken_of_the_vocabulary_alone(spark, written):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    found = {(r["doc_id"], r["term"]): (r["tf"], round(r["weight"], 9))
             for r in text.tfidf(df, "doc_id", max_features=3, ngram=(1, 2)).collect()}
    counts = Counter((k, g) for k, t in TEXTS for g in grams((t or "").split()))
    total = Counter()
    for (_, g), n in counts.items():
        total[g] += n
    top = sorted(total, key=lambda g: (-total[g], g))[:3]
    idf = {g: math.log((1 + len(TEXTS)) / (1 + sum(1 for _, x in counts if x == g))) + 1 for g in top}
    w = {(k, g): n * idf[g] for (k, g), n in counts.items() if g in idf}
    norm = {k: math.sqrt(sum(x * x for (j, _), x in w.items() if j == k)) for k, _ in w}
    assert found == {(k, g): (counts[k, g], round(x / norm[k], 9)) for (k, g), x in w.items()}
    assert {r["term"] for r in written["counts"].collect()} == set(top)


def test_only_texts_of_candidates_are_scrubbed(spark, written):
    texts = spark.createDataFrame([(str(i), f"mail a{i}@b.com now" if i != 3 else " ", None) for i in range(20)] + [("2", "again", None)],
                                  "review_id string, text string, date date")
    found = spark.createDataFrame([(1, "2", 0.5, 1), (1, "3", 0.4, 2), (2, "2", 0.3, 1)],
                                  "question_id bigint, review_id string, score double, rank int")
    out = sorted((r["question_id"], r["review_id"], r["text"]) for r in retrieval.snippets(found, texts).collect())
    assert out == [(q, "2", t) for q in (1, 2) for t in ("again", "mail [REDACTED_EMAIL] now")]
    assert sorted(r["review_id"] for r in written["texts"].collect()) == ["2", "2", "3"]


def test_texts_without_an_at_sign_skip_the_pattern_of_addresses(spark):
    rows = [("a.b-c@d.e, +49 170 1234567",), ("no address, 0170 1234567",), ("@ alone",), (None,), ("x" * 50,)]
    df = spark.createDataFrame(rows, "text string")
    plain = F.regexp_replace(F.regexp_replace("text", C.EMAIL_PATTERN, "[REDACTED_EMAIL]"), C.PHONE_PATTERN, "[REDACTED_PHONE]")
    assert all(r["a"] == r["b"] for r in df.select(C.scrub_pii("text").alias("a"), plain.alias("b")).collect())
    assert "contains(" in str(C.scrub_pii("text")).lower()


def test_a_search_counts_words_of_one_id_in_all_its_rows(spark, written):
    rows = [("1", "p", "red apple"), ("1", "p", "red plum"), ("2", "p", "green apple"), ("3", "q", "red"), (None, "p", "red")]
    texts = spark.createDataFrame(rows, "review_id string, parent_asin string, text string")
    asked = spark.createDataFrame([(7, "p", "red apple")], "question_id bigint, parent_asin string, question string")
    out = [(r["review_id"], r["rank"]) for r in retrieval.tfidf_search(asked, texts, 5).orderBy("rank").collect()]
    assert out == [("1", 1), ("2", 2)]
    tf = {(r["review_id"], r["term"]): r["tf"] for r in written["postings"].collect()}
    assert tf["1", "red"] == 2 and tf["2", "apple"] == 1


def test_clusters_are_fitted_on_written_vectors_and_show_their_first_texts(spark, written):
    ids = [f"{i:02d}" for i in range(12)]
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if int(i) % 2 else [0.0, 1.0]) for i in ids], "review_id string, embedding array<float>")
    texts = spark.createDataFrame([(i, f"text number{i}") for i in ids if i != "02"], "review_id string, text string")
    mentions = spark.createDataFrame([(i, "screen", "Negative", -1.0) for i in ids if i != "00"] + [("01", "cap", "Negative", -0.5)],
                                     "review_id string, aspect_term_normalized string, sentiment string, sentiment_score double")
    out = {tuple(r["samples"]): r for r in mining.kmeans_profile(mentions, texts, vectors, 2).collect()}
    assert set(out) == {tuple(f"text number{i}" for i in group) for group in (("01", "03", "05"), ("04", "06", "08"))}
    odd = out["text number01", "text number03", "text number05"]
    assert (odd["size"], odd["top_aspects"]) == (7, {"screen": 6, "cap": 1}) and abs(odd["avg_sentiment"] + 6.5 / 7) < 1e-9
    assert written["vectors"].count() == 11
