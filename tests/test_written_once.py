"""Steps that wrote or shuffled more than their result needs."""

import datetime

import pytest
from opinara.operators import alerts, profiles, quantiles, retrieval


@pytest.fixture
def written(monkeypatch):
    """(name, table) of what an operator's module writes."""
    found = []

    def watch(module):
        real = module.materialize

        def keep(df, name="stage"):
            table = real(df, name)
            found.append((name, df, table))
            return table

        monkeypatch.setattr(module, "materialize", keep)
        return found

    return watch


def test_emerging_counts_products_of_new_aspects_only(spark, written):
    day = datetime.date(2024, 3, 1)
    rows = [(f"p{i}", "old", day - datetime.timedelta(days=i % 30), 1.0, "Positive") for i in range(60)]
    rows += [(p, "new", day - datetime.timedelta(days=1), s, kind) for p, s, kind in
             (("p1", -1.0, "Negative"), ("p1", 1.0, "Positive"), ("p2", None, None), (None, 1.0, "Positive"))]
    df = spark.createDataFrame(rows, "parent_asin string, aspect_term_normalized string, date date, sentiment_score double, sentiment string")
    titles = spark.createDataFrame([("p1", "One")], "parent_asin string, title string")
    tables = written(alerts)
    got = alerts.emerging_aspects(df, 3, 1, against="all", products=titles).collect()
    assert [tuple(r) for r in got] == [("new", 4, 0.25, 25.0, 3, "One, p2", day - datetime.timedelta(days=1))]
    again = alerts.emerging_aspects(alerts.alert_cells(df), 3, 1, against="all", products=titles).collect()
    assert again == got
    assert max(t.count() for name, _, t in tables if name not in ("mentions", "cells")) <= 3


def test_exact_profile_expands_rows_once(spark, written):
    df = spark.createDataFrame([(i % 7 if i else None, str(i % 3)) for i in range(50)], "a bigint, b string")
    tables = written(profiles)
    got = {r["column"]: r for r in profiles.profile_exact(df).collect()}
    assert [name for name, _, _ in tables] == ["counts"]
    assert (got["a"]["q50"], got["a"]["nulls"], got["a"]["distinct_values"], got["b"]["distinct_values"]) == (3.0, 1, 7, 3)
    weighted = spark.createDataFrame([(1.0, 3), (5.0, 1), (None, 9)], "v double, n bigint")
    assert quantiles.exact_quantiles(weighted, [], "v", {"m": 0.5, "top": 1.0}, weight="n").first().asDict() == {
        "n": 4, "m": 1.0, "top": 5.0}


def test_postings_meet_words_unsorted(spark, written):
    texts = spark.createDataFrame([("1", "p", "red apple"), ("2", "p", "red pear")], "review_id string, parent_asin string, text string")
    asked = spark.createDataFrame([(1, "p", "apple")], "question_id bigint, parent_asin string, question string")
    tables = written(retrieval)
    assert [r["review_id"] for r in retrieval.tfidf_search(asked, texts, 5).collect()] == ["1"]
    plan = next(df for name, df, _ in tables if name == "weights")._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan
