"""Preparation, aggregates, windows and alerts on small literal tables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.functions import columns as C
from opinara.operators import alerts, analytics, preprocess, quantiles, series, windows

SCHEMA = ("review_id string, parent_asin string, aspect_term string, sentiment string, "
          "confidence double, timestamp timestamp, pos int, rating double")


def day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def mentions(spark, rows):
    full = [(r, p, a, s, float(c), day(d), pos, 5.0) for r, p, a, s, c, d, pos in rows]
    return spark.createDataFrame(full, SCHEMA)


def products(spark, rows):
    return spark.createDataFrame(
        rows, "parent_asin string, title string, main_category string, average_rating double, price string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_normalisation_demo(spark):
    terms = [("color", "Positive"), ("colors", "Positive"), ("colour", "Negative"),
             ("smell", "Positive"), ("scent", "Negative"), ("fragrance", "Negative")]
    m = mentions(spark, [(str(i), "p", t, s, 0.9, 0, 0) for i, (t, s) in enumerate(terms)])
    out = {r["aspect_term_normalized"]: r for r in
           analytics.sentiment_ratio(preprocess.clean_mentions(m)).collect()}
    assert out["color"]["total"] == 3 and out["color"]["positive_ratio"] == pytest.approx(66.6667, abs=1e-3)
    assert out["smell"]["total"] == 3 and out["smell"]["positive_ratio"] == pytest.approx(33.3333, abs=1e-3)


def test_worked_example(spark):
    m = mentions(spark, [
        ("r1", "B1", "color", "Positive", 0.9, 0, 0), ("r2", "B1", "colours", "Positive", 0.7, 1, 0),
        ("r3", "B2", "smell", "Negative", 0.8, 2, 0), ("r4", "B2", "scent", "Negative", 0.6, 3, 0),
        ("r5", "B2", "price", "Positive", 0.5, 4, 0)])
    p = products(spark, [("B1", "Lipstick", "Beauty", 4.5, "9.99"), ("B2", "Cream", "Beauty", 3.5, "None")])
    clean = preprocess.preprocess(m, p)
    assert rows(clean, "sentiment_score") == [(-0.8,), (-0.6,), (0.5,), (0.7,), (0.9,)]
    counts = {r["value"]: r["n"] for r in analytics.value_counts(clean, "aspect_term_normalized").collect()}
    assert counts == {"color": 2, "smell": 2, "price": 1}
    means = {r["parent_asin"]: round(r["avg_sentiment_score"], 2)
             for r in analytics.product_stats(clean).collect()}
    assert means == {"B1": 0.8, "B2": -0.3}


def test_weak_first_mention_hides_a_strong_one(spark):
    m = mentions(spark, [("r", "p", "color", "Positive", 0.2, 0, 0), ("r", "p", "shade", "Negative", 0.9, 0, 1)])
    assert preprocess.clean_mentions(m).count() == 0


def test_duplicate_product_rows_and_null_keys(spark):
    m = mentions(spark, [("r1", "B1", "color", "Positive", 0.9, 0, 0), ("r2", None, "color", "Positive", 0.9, 0, 0)])
    p = products(spark, [("B1", "b", "x", 4.0, "1"), ("B1", "a", "x", 4.0, "1"), (None, "n", "x", 4.0, "1")])
    assert preprocess.merge_metadata(m, p).count() == 3
    one = preprocess.preprocess(m, p)
    assert rows(one, "review_id", "has_metadata") == [("r1", True), ("r2", False)]
    assert one.where("review_id = 'r1'").first()["title"] == "a"


def test_review_aggregate_edges(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 0.0, 3.0, "Positive"), ("a", 0.0, 0.0, 3.0, "Negative"), ("b", 0.5, 0.5, 5.0, "Positive"),
         ("b", -1.0, 1.0, 5.0, "Negative"), ("b", 0.7, 0.7, 5.0, "Positive")],
        "review_id string, sentiment_score double, confidence double, rating double, sentiment string")
    out = {r["review_id"]: r for r in analytics.review_aggregate(df).collect()}
    assert out["a"]["sentiment_score"] is None and out["a"]["sentiment"] == "Negative"
    assert out["b"]["sentiment_score"] == pytest.approx((0.25 - 1 + 0.49) / 2.2)
    assert out["b"]["sentiment"] == "Positive" and out["b"]["aspect_count"] == 3


def test_kpi_invariants(spark):
    m = mentions(spark, [(str(i), str(i % 3), "color", s, 0.8, i, 0)
                         for i, s in enumerate(["Positive", "Negative", "Neutral"] * 4)])
    k = analytics.kpis(preprocess.clean_mentions(m)).first()
    assert k["mention_count"] == 12 and k["product_count"] == 3
    assert k["pct_positive"] + k["pct_negative"] + k["pct_neutral"] == pytest.approx(100)


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(7)
    data = [("hot", rng.choice([rng.gauss(0, 1), 0.25])) for _ in range(3000)]
    data += [("cold", rng.random()) for _ in range(7)] + [("one", 2.5)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
    out = {r["g"]: r for r in quantiles.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in ("hot", "cold", "one"):
        v = [x for k, x in data if k == g]
        assert out[g]["n"] == len(v)
        for name, p in probs.items():
            assert out[g][name] == pytest.approx(np.quantile(v, p))
    whole = quantiles.exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert whole["m"] == pytest.approx(np.median([x for _, x in data]))


def brute_rolling(points, days):
    return {(k, d): np.mean([s for kk, dd, s in points if kk == k and d - days < dd <= d])
            for k, d, _ in points}


def test_rolling_previous_and_momentum_match_brute_force(spark):
    rng = random.Random(3)
    points = [(rng.choice("aab"), rng.randrange(40), rng.choice([-1, 1]) * rng.random()) for _ in range(120)]
    df = spark.createDataFrame(
        [(k, dt.date(2020, 1, 1) + dt.timedelta(days=d), s) for k, d, s in points],
        "parent_asin string, date date, sentiment_score double")
    want = brute_rolling(points, 7)
    for r in windows.rolling_sentiment(df, 7).collect():
        d = (r["date"] - dt.date(2020, 1, 1)).days
        assert r["rolling"] == pytest.approx(want[r["parent_asin"], d])
    ends = {r["parent_asin"]: r for r in windows.latest_and_previous(windows.daily_scores(df), 7, 7).collect()}
    slopes = {r["parent_asin"]: r["momentum"] for r in windows.momentum(df, 14).collect()}
    want14 = brute_rolling(points, 14)
    for key in "ab":
        days = sorted(d for k, d, _ in points if k == key)
        seq = [want[key, d] for d in days]
        assert ends[key]["recent"] == pytest.approx(seq[-1])
        assert ends[key]["previous"] == pytest.approx(seq[-8])
        assert slopes[key] == pytest.approx(np.polyfit(range(14), [want14[key, d] for d in days][-14:], 1)[0])


def test_rolling_count_is_half_open(spark):
    base = dt.datetime(2024, 1, 1)
    times = [base, base + dt.timedelta(days=7), base + dt.timedelta(days=7, microseconds=-1), base]
    df = spark.createDataFrame([(str(i), "u", t) for i, t in enumerate(times)],
                               "review_id string, user_id string, ts timestamp")
    got = {r["review_id"]: r["reviews_in_window"] for r in windows.user_activity(df).collect()}
    assert got == {"0": 2, "3": 2, "2": 3, "1": 2}


def test_sentiment_drop_alert(spark):
    data = [(f"r{i}", "p", "color", "Positive", 0.9, i, 0) for i in range(10)]
    data += [(f"s{i}", "p", "smell", "Negative", 0.9, 30 + i, 0) for i in range(10)]
    clean = preprocess.preprocess(mentions(spark, data), products(spark, [("p", "T", "C", 4.0, "1")]))
    alert = alerts.sentiment_drops(clean).collect()
    assert len(alert) == 0  # eight mentions back the rolling mean is already negative
    data = data[:13]
    clean = preprocess.preprocess(mentions(spark, data), products(spark, [("p", "T", "C", 4.0, "1")]))
    alert = alerts.sentiment_drops(clean).first()
    assert alert["severity"] == "High" and alert["top_negative_aspects"] == "smell"
    assert alert["mention_count_period"] == 3 and alert["product_title"] == "T"


def test_volume_filter_and_longest_segment(spark):
    counts = [8, 2, 6, 1, 12]
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1 + i), 0.1, n) for i, n in enumerate(counts)],
                               "series_id string, ds date, y double, n bigint")
    assert [r[0].day for r in series.volume_filter(df, 5, 3).select("ds").orderBy("ds").collect()] == [1, 3, 5]
    start, pts = dt.date(2020, 1, 1), []
    for length, offset in ((15, 0), (45, 40), (8, 120)):
        pts += [("a", start + dt.timedelta(days=offset + i), 0.1, 9) for i in range(length)]
    long = series.longest_segment(series.segments(
        spark.createDataFrame(pts, "series_id string, ds date, y double, n bigint"), "D"))
    assert long.count() == 45


def test_quality_formulas(spark):
    start = dt.date(2020, 1, 1)
    pts = [("a", start + dt.timedelta(days=2 * i), 0.0, 5) for i in range(45)] + [
        ("a", start + dt.timedelta(days=89), 0.0, 1)]
    q = series.series_quality(spark.createDataFrame(pts, "series_id string, ds date, y double, n bigint"), "D", 5).first()
    assert q["total_periods"] == 90 and q["coverage_pct"] == 50.0 and q["avg_volume"] == 5.0


def test_changepoints_match_the_recursion(spark):
    rng = random.Random(5)
    y = [rng.gauss(0, 0.1) for _ in range(30)] + [rng.gauss(1, 0.1) for _ in range(30)]
    start = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("a", start + dt.timedelta(days=i), v, 9) for i, v in enumerate(y)] +
                               [("flat", start + dt.timedelta(days=i), 1.0, 9) for i in range(20)],
                               "series_id string, ds date, y double, n bigint")
    z = (np.array(y) - np.mean(y)) / np.std(y)
    up = down = 0.0
    want = []
    for i in range(1, len(z)):
        up, down = max(0, up + z[i] - 0.5), max(0, down - z[i] - 0.5)
        if up > 3 or down > 3:
            want.append(start + dt.timedelta(days=i))
            up = down = 0.0
    got = rows(series.changepoints(df), "series_id", "ds")
    assert got == [("a", d) for d in want] and want


def test_decomposition_of_a_pure_pattern(spark):
    start = dt.date(2020, 1, 6)
    pattern = [1, 0, -1, 0]
    pts = [("a", start + dt.timedelta(days=i), 0.5 * i + pattern[i % 4], 9) for i in range(24)]
    out = series.decompose(spark.createDataFrame(pts, "series_id string, ds date, y double, n bigint"), 4)
    for r in out.collect():
        i = (r["ds"] - start).days
        assert r["trend"] == pytest.approx(0.5 * i)
        assert r["seasonal"] == pytest.approx(pattern[i % 4])
        assert r["residual"] == pytest.approx(0, abs=1e-9)


def test_arima_continues_a_line():
    from opinara.operators.arima import forecast_values

    mean, low, high = forecast_values(np.arange(40) * 0.5, (1, 1, 0), periods=5)
    assert mean == pytest.approx([20, 20.5, 21, 21.5, 22], abs=1e-6)
    assert (low <= mean).all() and (mean <= high).all()
    seasonal = np.tile([1.0, 2.0, 3.0, 4.0], 10)
    mean, _, _ = forecast_values(seasonal, (0, 0, 0), (0, 1, 0, 4), periods=4)
    assert mean == pytest.approx([1, 2, 3, 4], abs=1e-6)


def test_insufficient_data_is_a_row(spark):
    m = mentions(spark, [(str(i), "p", "color", "Positive", 0.9, i, 0) for i in range(50)])
    r = series.forecast_report(preprocess.clean_mentions(m), 5, "D", 5).first()
    assert r["success"] is False and "Insufficient data" in r["error"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a@b.co or +1 555-123-4567", "x " * 40, "ok ok no ok ok yes ok ok")],
                               "p string, l string, r string")
    out = df.select(C.scrub_pii("p").alias("p"), C.ellipsize("l", 10).alias("l"),
                    C.repeats_ngram("r").alias("yes"), C.repeats_ngram("r", 2, 4).alias("no")).first()
    assert out["p"] == "[REDACTED_EMAIL] or [REDACTED_PHONE]"
    assert out["l"] == "x x x x..." and out["yes"] and not out["no"]


def test_hot_plans_stay_in_the_jvm(spark):
    from opinara.plans import catalog

    for name in ("preprocess", "kpis", "rolling_sentiment", "user_activity_7d", "forecast_additive"):
        df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, (name, bad)


def test_dedup_limits_groups_before_the_shuffle(spark):
    m = mentions(spark, [("r", "p", "color", "Positive", 0.9, 0, 0)])
    plan = preprocess.dedup_mentions(preprocess.normalize_aspects(m))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_star_scale(spark):
    got = [r[0] for r in spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "s double")
           .select(F.round(C.to_star_scale("s"), 6)).collect()]
    assert got == [1.0, 3.0, 5.0]


def test_pipelines_on_repeats_nulls_and_compatibility_forms(spark):
    import datetime as dt

    from opinara.operators import pipelines

    d = dt.date(2024, 1, 1)
    rows = [("1", "p", 4.0, "A perfectly ﬁne ﬂask of ①", d), ("1", "p", 4.0, "A perfectly ﬁne ﬂask of ①", d),
            ("2", "p", None, "Another perfectly usual text", d), ("3", "p", 3.0, "No date on this one", None),
            ("4", "p", 3.0, None, d), ("5", "p", 1.0, "this is great, really great", d)]
    df = spark.createDataFrame(rows, "review_id string, parent_asin string, rating double, text string, date date")
    got = {r["review_id"]: r for r in pipelines.advanced_preprocess(df).collect()}
    assert set(got) == {"1", "2"} and pipelines.advanced_preprocess(df).count() == 2
    assert "fine flask 1" in got["1"]["text"] and got["2"]["rating"] == 3.0


def test_quantiles_with_a_far_outlier(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from opinara.operators import quantiles

    df = spark.range(200_000).select(F.when(F.col("id") == 0, 1e15).otherwise(F.col("id") * 1.0).alias("v"))
    got = quantiles.exact_quantiles(df, [], "v", {"q1": 0.25, "med": 0.5, "q3": 0.75}).first()
    values = np.array([1e15, *range(1, 200_000)], float)
    assert (got["q1"], got["med"], got["q3"]) == tuple(np.quantile(values, [0.25, 0.5, 0.75]))
    counts = quantiles.value_counts(df, [], "v")
    cuts = counts.agg(F.percentile_approx("v", F.array(*[F.lit(i / quantiles.BUCKETS) for i in range(1, quantiles.BUCKETS)]),
                                          10 * quantiles.BUCKETS).alias("cuts"))
    sizes = counts.crossJoin(cuts).groupBy(quantiles._range_of(F.col("v"), F.col("cuts")).alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] < 1_000
