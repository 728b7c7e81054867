"""Column profiles on literal rows, and merged ones against the whole."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from opinara.operators import profiles

SCHEMA = "month string, tiny tinyint, amount decimal(10,2), day date, at timestamp, word string, nothing double, `odd.name` int"


def rows(n=400):
    out = []
    for i in range(n):
        out.append((f"m{i % 3}", i % 7, Decimal(i) / 4 if i % 5 else None, dt.date(2020, 1, 1) + dt.timedelta(days=i % 90),
                    dt.datetime(2020, 1, 1, i % 24), "often" if i % 2 else f"w{i}", None, -i))
    return out


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_all_types_are_summed_up(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = by_column(profiles.profile_exact(df))
    assert {c: got[c]["kind"] for c in df.columns} == {
        "month": "other", "tiny": "number", "amount": "number", "day": "time", "at": "time", "word": "other", "nothing": "number",
        "odd.name": "number"}
    amount = sorted(i / 4 for i in range(400) if i % 5)
    assert got["amount"]["nulls"] == 80 and got["amount"]["distinct_values"] == 320
    assert got["amount"]["q50"] == pytest.approx((amount[159] + amount[160]) / 2)
    mean = sum(amount) / 320
    assert got["amount"]["std"] == pytest.approx((sum((a - mean) ** 2 for a in amount) / 319) ** 0.5)
    assert got["day"]["first_time"] == dt.datetime(2020, 1, 1) and got["day"]["last_time"] == dt.datetime(2020, 3, 30)
    assert got["at"]["last_time"] == dt.datetime(2020, 1, 1, 23) and got["at"]["min"] is None
    assert got["nothing"]["nulls"] == 400 and got["nothing"]["mean"] is got["nothing"]["q25"] is None
    assert (got["odd.name"]["min"], got["odd.name"]["max"]) == (-399, 0) and got["word"]["distinct_values"] == 201


def test_merged_months_equal_the_whole(spark, tmp_path):
    df = spark.createDataFrame(rows(3000), SCHEMA)
    path = str(tmp_path / "p")
    profiles.profile_periods(df.where("month <> 'm2'"), "month").write.parquet(path)
    profiles.profile_periods(df.where("month = 'm2'"), "month").write.mode("append").parquet(path)    # a month later
    stored = spark.read.parquet(path)
    assert stored.count() == 3 * 7
    merged, exact = by_column(profiles.merge_profiles(stored)), by_column(profiles.profile_exact(df.drop("month")))
    assert set(merged) == set(exact)
    for name, want in exact.items():
        got = merged[name]
        for c in ("kind", "rows", "nulls", "min", "max", "first_time", "last_time"):
            assert got[c] == want[c], (name, c)
        for c in ("mean", "std"):
            assert got[c] == (None if want[c] is None else pytest.approx(want[c], rel=1e-9))
        assert got["distinct_values"] == pytest.approx(want["distinct_values"], rel=profiles.DISTINCT_ERROR, abs=1)
        for q, p in profiles.QUARTILES.items():
            if want[q] is not None:
                side = df.select(F.col(f"`{name}`").cast("double").alias("v")).where("v is not null")
                n = side.count()
                below, upto = side.where(F.col("v") < got[q]).count(), side.where(F.col("v") <= got[q]).count()
                assert below / n <= p + profiles.RANK_ERROR and upto / n >= p - profiles.RANK_ERROR
    assert merged["word"]["frequent"][0] == "often" and len(merged["tiny"]["frequent"]) == profiles.TOP
    two = by_column(profiles.merge_profiles(stored.where("month <> 'm0'")))
    assert two["tiny"]["rows"] == 2000


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert profiles.profile_periods(none, "month").collect() == []
    assert profiles.merge_profiles(profiles.profile_periods(none, "month")).collect() == []
    assert profiles.profile_exact(none).collect() == []
