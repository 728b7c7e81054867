"""Extraction, retrieval, clusters, answers and sinks against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators import answers, mining, retrieval, similarity, text
from opinara.session import scratch_path
from opinara.sources import readers, sinks


def vectors(spark, n=120, dims=6, seed=1, copies=40):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) + rng.integers(0, 2, size=(n, 1)) * 4
    v[:copies] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)]
    return v, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def test_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CHUNK", 16)
    v, df = vectors(spark, copies=1)
    d = similarity.distances(v, v)
    np.fill_diagonal(d, np.inf)
    reps, _ = similarity.distinct_vectors(df, "vec_id", "embedding")
    got = {}
    for r in similarity.neighbours(reps, 5, cells=9).collect():
        got.setdefault(r["id"], []).append(r["dist"])
    for i in range(len(v)):
        assert sorted(got[i]) == pytest.approx(sorted(d[i])[:5], abs=1e-6)


def test_density_counts_copies(spark):
    v, df = vectors(spark, copies=40)
    out = {r["vec_id"]: r for r in similarity.density_outliers(df, k=5, cells=7).collect()}
    assert len(out) == 120
    d = similarity.distances(v, v)
    np.fill_diagonal(d, np.inf)
    for i in range(120):
        assert out[i]["core_distance"] == pytest.approx(sorted(d[i])[4], abs=1e-6)
    assert out[3]["core_distance"] == 0


def brute_dbscan(v, eps, k):
    near = (1 - v @ v.T).round(9) <= eps
    core = near.sum(1) >= k
    root = {i: i for i in np.nonzero(core)[0]}
    changed = True
    while changed:
        changed = False
        for i in root:
            m = min(root[j] for j in np.nonzero(near[i] & core)[0])
            if m < root[i]:
                root[i], changed = m, True
    return [root[i] if core[i] else min((root[j] for j in np.nonzero(near[i] & core)[0]), default=-1)
            for i in range(len(v))]


def test_dbscan_matches_brute_force(spark):
    v, df = vectors(spark, copies=30, seed=4)
    for eps in (0.02, 0.1):
        got = {r["vec_id"]: r["cluster"] for r in
               similarity.dbscan(df, eps=eps, min_points=4, cells=6).collect()}
        assert [got[i] for i in range(len(v))] == brute_dbscan(v, eps, 4)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 60), (60, 70), (99, 99)]
    got = {r["id"]: r["root"] for r in
           similarity.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[70] == 50


@pytest.mark.parametrize("slab", [4096, 3])
def test_retrieval_both_ways(spark, monkeypatch, slab):
    """Five questions in one slab, or in two."""
    monkeypatch.setattr(retrieval, "SLAB", slab)
    v, df = vectors(spark, copies=1, seed=2)
    corpus = df.select(F.col("vec_id").cast("string").alias("review_id"), "embedding",
                       (F.col("vec_id") % 4).cast("string").alias("parent_asin"))
    q = df.where("vec_id < 5").select(F.col("vec_id").alias("question_id"), "embedding",
                                      (F.col("vec_id") % 4).cast("string").alias("parent_asin"))
    got = {}
    for r in retrieval.retrieve_top_k(corpus, q, 6).orderBy("rank").collect():
        got.setdefault(r["question_id"], []).append(r["score"])
    for i in range(5):
        assert got[i] == pytest.approx(sorted(v @ v[i], reverse=True)[:6], abs=1e-8)
        assert got[i] == sorted(got[i], reverse=True)
    own = retrieval.retrieve_top_k(corpus, q, 6, same_product=True)
    assert own.join(corpus, "review_id").where(
        (F.col("question_id") % 4).cast("string") != F.col("parent_asin")).count() == 0
    assert own.count() == 30


def test_three_battery_reviews(spark):
    t = spark.createDataFrame(
        [("1", "p", "battery life is great and the battery lasts", dt.date(2020, 1, 1)),
         ("2", "p", "the battery died quickly, ask joe.doe@mail.example.com", dt.date(2020, 1, 2)),
         ("3", "p", "battery charging fast", dt.date(2020, 1, 3)),
         ("4", "other", "battery battery battery", dt.date(2020, 1, 3)), ("5", None, "battery", None)],
        "review_id string, parent_asin string, text string, date date")
    q = spark.createDataFrame([(1, "how is the battery", "p", "p")],
                              "question_id bigint, question string, asin string, parent_asin string")
    found = retrieval.snippets(retrieval.tfidf_search(q, t, 3), t)
    assert found.count() == 3
    best = retrieval.tfidf_rerank(found, q, 2)
    assert sorted(r["rank"] for r in best.collect()) == [1, 2]
    ctx = answers.prompt_context(best).first()["context"]
    assert ctx.startswith("[0] review_id=") and "\n[1] review_id=" in ctx
    cache = spark.createDataFrame([("p", "how is the battery", "fine", 100)],
                                  "asin string, question string, answer string, created_at bigint")
    hit = answers.qa_batch(q, t, cache, now=200).first()
    assert (hit["method"], hit["answer"]) == ("cached", "fine")
    miss = answers.qa_batch(q, t, cache, now=10**9).first()
    assert miss["method"] == "extractive_fallback" and "Top 3" in miss["answer"]
    assert sorted(miss["review_ids"].split(",")) == ["1", "2", "3"]  # its own product only
    for shown in (miss["answer"], miss["sources"]):
        assert "joe.doe" not in shown and "[REDACTED_EMAIL]" in shown
    rows = answers.cache_rows(q, answers.qa_batch(q, t, cache, now=10**9), 10**9)
    again = answers.qa_batch(q, t, rows, now=10**9 + 5).first()
    assert (again["method"], again["answer"]) == ("cached", miss["answer"])
    assert answers.cache_rows(q, answers.qa_batch(q, t, rows, now=10**9 + 5), 1).count() == 0
    plan = retrieval.tfidf_search(q, t, 3)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "text" in line]


def test_prompt_pack_steps(spark):
    long = "x" * 1000
    snips = spark.createDataFrame([(1, i, str(i), long, None, 0.5) for i in range(1, 9)],
                                  "question_id bigint, rank int, review_id string, text string, date date, score double")
    q = spark.createDataFrame([(1, "q")], "question_id bigint, question string")
    for allowed, want in ((600, (300, 6)), (350, (150, 6)), (240, (80, 6)), (10, (80, 2))):
        r = answers.prompt_pack(snips, q, allowed).first()
        assert (r["snippet_chars"], r["max_snippets"]) == want
        assert r["fits"] == (allowed != 10) and len(r["prompt"]) <= allowed * 4 or allowed == 10


def test_cache_miss_then_hit(spark):
    q = spark.createDataFrame([(1, "a", " Why? ")], "question_id bigint, asin string, question string")
    empty = spark.createDataFrame([], "asin string, question string, answer string, created_at bigint")
    full = spark.createDataFrame([("a", "why?", "old", 1), ("a", "why?", "new", 5)], empty.schema)
    first, second = (answers.answer_cache_lookup(q, c, now=10) for c in (empty, full))
    assert second.first()["answer"] == "new"
    events = first.unionByName(second).select("event_type", F.lit(10).cast("bigint").alias("ts"))
    m = answers.cache_metrics(events, full).first()
    assert (m["hit_count"], m["miss_count"], m["entry_count"], m["last_updated"]) == (1, 1, 2, 5)
    assert answers.answer_cache_lookup(q, full, now=10**7).first()["event_type"] == "miss"


def test_answer_forms(spark):
    a = spark.createDataFrame(
        [(1, '{"summary": "s"}'), (2, 'x {"summary": "t"} y'), (3, "no json"), (4, '{"summary": '),
         (5, "Answer: first\nsecond [1]")], "question_id bigint, answer string")
    got = {r["question_id"]: r["structured"] for r in answers.parse_answer_json(a).collect()}
    assert got[1]["summary"] == "s" and got[2]["summary"] == "t" and got[3] is None and got[4] is None
    snips = spark.createDataFrame([(5, 1, "r", "zero", None), (5, 2, "s", "one: more", None)],
                                  "question_id bigint, rank int, review_id string, text string, date date")
    e = answers.parse_answer_evidence(a, snips).first()
    assert e["summary"] == "first" and [(x["index"], x["excerpt"]) for x in e["evidence"]] == [(1, "one: more")]


def test_json_columns(spark):
    df = spark.createDataFrame(
        [("1", "p", '[{"term":"color"},{"term":"size","sentiment":"Positive","confidence":0.4}]'),
         ("2", "p", "[]"), ("3", "p", "broken [{")], "review_id string, parent_asin string, aspects_json string")
    got = [tuple(r) for r in text.explode_aspects(df).orderBy("pos").collect()]
    assert got == [("1", "p", 0, "color", "Neutral", 1.0), ("1", "p", 1, "size", "Positive", 0.4)]


def test_extraction_and_failing_scorer(spark):
    df = spark.createDataFrame([("1", "The color is great but the smell was awful"), ("2", "   "),
                                ("3", "price")], "review_id string, text string")
    got = {r["term"]: (r["sentiment"], r["confidence"]) for r in text.extract_aspects(df).collect()}
    assert got == {"color": ("Positive", 0.9), "smell": ("Negative", 0.9), "price": ("Neutral", 0.5)}
    scored = {r["review_id"]: len(r["aspects"]) for r in text.score_reviews(df).collect()}
    assert scored == {"1": 2, "2": 0, "3": 1}

    def broken():
        def score(texts):
            raise RuntimeError("model down")
        return score

    out = text.score_with_model(df, broken).collect()
    assert sorted(r["review_id"] for r in out) == ["1", "3"]
    assert all(r["aspects"] == [] and r["error"] == "model down" for r in out)
    pol = {r["review_id"]: r["polarity"] for r in text.text_polarity(
        spark.createDataFrame([("a", "not good"), ("b", "good"), ("c", "")], "review_id string, text string")).collect()}
    assert pol == {"a": -0.7, "b": 0.7, "c": 0.0}


def test_detect_text_column(spark):
    df = spark.createDataFrame([("a", "x" * 30), ("b", "y" * 40)], "id string, body string")
    assert text.detect_text_column(df) == "body"
    assert text.detect_text_column(df.withColumn("review", F.lit("z"))) == "review"
    assert text.detect_text_column(df.select("id")) is None


def test_incremental_append_is_idempotent(spark):
    path = scratch_path(spark, "inc")
    df = spark.createDataFrame([(str(i), dt.datetime(2020, 1 + i % 3, 1)) for i in range(9)],
                               "review_id string, timestamp timestamp")
    sinks.append_incremental(df.limit(4), path)
    for _ in range(2):
        sinks.append_incremental(df, path)
    assert spark.read.parquet(path).count() == 9


def test_incremental_append_knows_undated_moved_and_nameless_rows(spark):
    schema = "review_id string, timestamp timestamp, text string"
    jan, feb = dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 1)
    df = spark.createDataFrame([("a", jan, "x"), ("b", None, "x"), (None, jan, "x"), (None, None, "y")], schema)
    moved = spark.createDataFrame([("a", feb, "x"), ("b", jan, "x"), ("c", feb, "x"), (None, jan, "z")], schema)
    path = scratch_path(spark, "inc")
    for rows in (df, df, moved, moved, df):
        sinks.append_incremental(rows, path)
    got = sorted(str((r["review_id"], r["text"])) for r in spark.read.parquet(path).collect())
    assert got == sorted(map(str, [("a", "x"), ("b", "x"), ("c", "x"), (None, "x"), (None, "y"), (None, "z")]))
    path = scratch_path(spark, "inc")
    for _ in range(2):
        sinks.append_incremental(df, path, fixed_month=True)
    assert spark.read.parquet(path).count() == 4


def test_embeddings_are_not_overwritten(spark):
    path = scratch_path(spark, "emb")
    assert readers.load_embeddings(spark, path) is None
    df = spark.createDataFrame([("1", "p", dt.date(2020, 1, 1), "me@x.org " + "t" * 400, [1.0, 0.0])],
                               "review_id string, parent_asin string, date date, text string, embedding array<double>")
    assert sinks.persist_embeddings(df, path) == "written"
    assert sinks.persist_embeddings(df, path) == "exists"
    row = readers.load_embeddings(spark, path).first()
    assert len(row["text_preview"]) == 300 and row["text_preview"].startswith("[REDACTED_EMAIL]")


def test_seeded_sample_and_split_are_stable(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = {r["k"] for r in mining.seeded_sample(df, "k", 50).collect()}
    b = {r["k"] for r in mining.seeded_sample(df.repartition(7), "k", 50).collect()}
    assert a == b and len(a) == 50
    train, test = mining.split_train_test(df, "k")
    assert train.count() + test.count() == 500 and 350 < train.count() < 450


def test_random_block_join_covers_all_pairs(spark):
    random.seed(1)
    import pandas as pd

    left = spark.createDataFrame([(i, i % 2) for i in range(50)], "id bigint, cell int")
    right = spark.createDataFrame([(i, i % 2) for i in range(30)], "id bigint, cell int")

    def count(a, b):
        return pd.DataFrame({"id": b["id"], "n": len(a)})

    out = similarity.block_join(left, right, count, "id bigint, n bigint", chunk=7)
    assert {(r["id"], r["s"]) for r in out.groupBy("id").agg(F.sum("n").alias("s")).collect()} == {
        (i, 25) for i in range(30)}


def test_sinks_keep_other_months(spark):
    from opinara.session import scratch_path
    from opinara.sources import sinks

    def month(m, ids):
        return spark.createDataFrame([(i, dt.datetime(2024, m, 3)) for i in ids], "review_id string, timestamp timestamp")

    path = scratch_path(spark, "months")
    sinks.write_results(month(1, "ab"), path, "parquet")
    sinks.write_results(month(2, "cd"), path, "parquet")
    sinks.write_results(month(2, "e"), path, "parquet")
    assert sorted(r["review_id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "e"]
    path = scratch_path(spark, "increments")
    sinks.append_incremental(month(1, "aab"), path)
    sinks.append_incremental(month(1, "bcc").union(month(2, "d")), path)
    sinks.append_incremental(month(1, "bcc").union(month(2, "d")), path)
    assert sorted(r["review_id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "d"]


def test_backtest_scores_points_behind_gaps(spark):
    from opinara.operators import series

    days = [*range(0, 60), 67, 74, 81, 88, 95, 102]
    rows = [("gappy", dt.date(2024, 1, 1) + dt.timedelta(d), 0.1 * d, 9) for d in days]
    rows += [("short", dt.date(2024, 1, 1) + dt.timedelta(d), 1.0, 9) for d in range(8)]
    s = spark.createDataFrame(rows, "series_id string, ds date, y double, n bigint")
    got = {r["series_id"]: (r["held_out"], r["points"]) for r in series.forecast_backtest(s, 6, "D").collect()}
    assert got == {"gappy": (6, 6), "short": (6, 0)}


def test_arima_reports_series_it_cannot_fit(spark):
    import numpy as np

    from opinara.operators import arima

    wave = [float(np.sin(i * np.pi / 6) + 0.01 * i) for i in range(72)]
    rows = [("good", dt.date(2018, 1, 1) + dt.timedelta(30 * i), y) for i, y in enumerate(wave)]
    rows += [("short", dt.date(2018, 1, 1) + dt.timedelta(30 * i), 1.0) for i in range(5)]
    rows += [("season", dt.date(2018, 1, 1) + dt.timedelta(30 * i), float(i % 5)) for i in range(12)]
    s = spark.createDataFrame(rows, "series_id string, ds date, y double")
    out = arima.fit_arima(s, (1, 0, 1), (1, 1, 1, 12), 12, "M").collect()
    failed = {r["series_id"] for r in out if r["error"]}
    assert failed == {"short", "season"} and sum(r["series_id"] == "good" for r in out) == 12
    trend = {r["series_id"]: r for r in arima.arima_trend(arima.fit_arima(s, (1, 0, 1), (1, 1, 1, 12), 12, "M"), s).collect()}
    assert trend["short"]["error"] and trend["short"]["trend_direction"] is None and trend["good"]["error"] is None
    with_ma, without = (arima.forecast_values(np.array(wave) + np.random.default_rng(0).normal(0, .1, 72), (1, 0, 0), (0, 1, q, 12), 6)[0]
                        for q in (1, 0))
    assert not np.allclose(with_ma, without)
    assert arima._lag_set(1, 2, 12) == [1, 12, 13, 24, 25]


def test_every_text_has_a_vector(spark):
    from opinara.operators import mining

    t = spark.createDataFrame([("a", "great battery life"), ("b", ""), ("c", None), ("d", "poor battery")], "review_id string, text string")
    got = {r["review_id"]: r["embedding"] for r in mining.embed_texts(t, dims=2).collect()}
    assert set(got) == set("abcd") and set(got["b"]) == set(got["c"]) == {0.0}


def test_vectors_are_sent_by_region_not_by_cell(spark, monkeypatch):
    """Without a bound a query reaches all 60 cells, but is sent once to each of a few regions; points stay in chunks."""
    monkeypatch.setattr(similarity, "CHUNK", 16)
    v, df = vectors(spark, n=600, copies=1, seed=5)
    reps, _ = similarity.distinct_vectors(df, "vec_id", "embedding")
    index = similarity.build_index(reps, cells=60)
    queries = index.points.select("id", "v", F.lit(None).cast("double").alias("reach"))
    sent = similarity.visits(queries, index).groupBy("id").count().agg(F.max("count")).first()[0]
    assert sent == index.regions.max() + 1 <= similarity.GRID + 1
    assert index.chunk == 50
    near = similarity.neighbours(reps, 3, cells=60).groupBy("id").agg(F.max("dist").alias("d")).collect()
    d = similarity.distances(v, v)
    np.fill_diagonal(d, np.inf)
    for r in near:
        assert r["d"] == pytest.approx(sorted(d[r["id"]])[2], abs=1e-6)
