"""The fitted encoder against numpy's decomposition, and the cell table against brute force."""

import datetime as dt
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.functions import columns as C
from opinara.operators import embedder, vectorstore
from opinara.plans import catalog

SF = "/root/testdata/sf0.001"


def texts(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("review_id"), "text")


def dense(spark, df, max_features):
    """TF-IDF rows by hand, in order of key, from the same tokens."""
    rows = sorted(df.select("review_id", C.topic_tokens("text").alias("t")).collect(), key=lambda r: r["review_id"])
    total, held = Counter(), Counter()
    for r in rows:
        total.update(r["t"])
        held.update(set(r["t"]))
    words = sorted(sorted(total, key=lambda w: (-total[w], w))[:max_features])
    x = np.array([[r["t"].count(w) for w in words] for r in rows], float)
    x *= np.log((1 + len(rows)) / (1 + np.array([held[w] for w in words]))) + 1
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return [r["review_id"] for r in rows], words, x / np.where(norms == 0, 1, norms)


@pytest.mark.parametrize("max_features,dims,blocks", [(300, 24, 12), (300, 24, 3), (40, 384, 12)])
def test_directions_equal_numpy(spark, monkeypatch, max_features, dims, blocks):
    monkeypatch.setattr(embedder, "BLOCKS", blocks)
    df = texts(spark)
    ids, words, x = dense(spark, df, max_features)
    model = embedder.fit(df, max_features=max_features, dims=dims)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    k = min(dims, int((s > 1e-6 * s[0]).sum()))
    assert model.terms == words and len(model.singular_values) == k and model.left <= 1e-7
    assert model.singular_values == pytest.approx(s[:k], abs=1e-6)
    got = {r["review_id"]: r["embedding"] for r in model.transform(df).collect()}
    want = x @ vt[:k].T
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    ours = np.array([got[i] for i in ids])
    assert np.abs(ours @ ours.T - want @ want.T).max() < 1e-5      # the space is one, whatever its signs


def test_saved_models_encode_alike(spark, tmp_path):
    t = spark.createDataFrame([("a", "great battery life"), ("b", ""), ("c", None), ("d", "poor battery"), ("a", "great battery life"),
                               (None, "unknown words")], "review_id string, text string").selectExpr("*", "1 as tokens", "2 as embedding")
    model = embedder.fit(t.where("review_id <> 'z'"), dims=2)
    model.save(spark, str(tmp_path / "m"))
    again = embedder.Embedder.load(spark, str(tmp_path / "m"))
    got = [sorted((r["review_id"] or "", r["embedding"]) for r in m.transform(t).collect()) for m in (model, again)]
    assert got[0] == got[1] and len(got[0]) == 6
    by = dict(got[0])
    assert by["b"] == by["c"] == by[""] == [0.0, 0.0]
    assert np.linalg.norm(by["a"]) == pytest.approx(1) and np.dot(by["a"], by["d"]) > 0
    with pytest.raises(ValueError):
        embedder.fit(t.limit(0))


def points(spark, n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 6))
    v[: n // 3] = v[: n // 3] * 0.05 + v[0]
    rows = [(str(i), str(i % 4), f"text {i} call +1 555 123 4567", dt.date(2020, 1 + i % 12, 1), x) for i, x in enumerate(v.tolist())]
    schema = "review_id string, parent_asin string, text string, date date, embedding array<double>"
    return v / np.linalg.norm(v, axis=1, keepdims=True), spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("cells", [1, 7, 400])
def test_search_equals_brute_force(spark, tmp_path, cells):
    u, df = points(spark, 400, cells)
    path = str(tmp_path / "ix")
    first = F.month("date") <= 7
    vectorstore.build_index(df.where(first), path, cells=cells)
    vectorstore.add_rows(df.where(~first), path)
    q = df.where("cast(review_id as int) % 40 = 0").select(F.col("review_id").cast("long").alias("question_id"), "embedding")
    got = {}
    for r in vectorstore.search(spark, path, q, 9).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append(r["score"])
    assert len(got) == 10
    for i, scores in got.items():
        assert scores == pytest.approx(sorted(u @ u[i], reverse=True)[:9], abs=1e-8)
    assert vectorstore.search(spark, path, q, 1000).groupBy("question_id").count().where("count <> 400").count() == 0
    assert vectorstore.search(spark, path, q.limit(0), 5).collect() == []


def test_only_the_cells_in_reach_are_opened(spark, tmp_path):
    _, df = points(spark, 400, 3)
    path = str(tmp_path / "ix")
    vectorstore.build_index(df, path, cells=40)
    there = spark.read.parquet(f"{path}/vectors").select("cell").distinct().count()
    assert there > 20
    some = vectorstore.read_cells(spark, path, [1, 2])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    folders = {r[0].rsplit("/", 2)[1] for r in some.select(F.input_file_name()).collect()}
    assert folders == {"cell=1", "cell=2"}
    row = some.first()
    assert "555" not in row["text_preview"] and len(row["v"]) == 6


def test_text_questions_find_their_texts(spark):
    """Each benchmark text that is asked has eight answers; an index over the texts themselves finds the asked one first."""
    out = catalog.QUERIES["question_topk_text"](spark, SF)
    n = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert out.count() == 8 * n and out.where("score > 1.000001").count() == 0


def test_texts_are_scrubbed_once(spark, tmp_path, monkeypatch):
    """Vectors and preview come from one scrubbed copy of the text."""
    calls = []
    plain = vectorstore.C.scrub_pii
    monkeypatch.setattr(vectorstore.C, "scrub_pii", lambda c: calls.append(c) or plain(c))
    df = spark.createDataFrame([("a", "ask joe.doe@mail.example.com"), ("b", "call 0123 456 789 now"), ("c", "plain")],
                               "review_id string, text string")

    def encode(df, key, col):
        return df.select(key, F.array(F.length(col).cast("double"), F.lit(1.0)).alias("embedding"))

    vectorstore.build_index(df, str(tmp_path / "ix"), encode=encode)
    assert len(calls) == 1
    found = {r["review_id"]: r["text_preview"] for r in spark.read.parquet(str(tmp_path / "ix" / "vectors")).collect()}
    assert found == {"a": "ask [REDACTED_EMAIL]", "b": "call [REDACTED_PHONE] now", "c": "plain"}
