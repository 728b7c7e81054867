"""Streams against their batch recursion, across restarts and repeated batches."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators.text import extract_aspects
from opinara.streaming import alerts, ingest, jobs

SCHEMA = "series_id string, ds timestamp, y double"
START = dt.datetime(2024, 1, 1)


def series():
    rng = np.random.default_rng(2)
    rows = []
    for s in range(6):
        day = 0
        for i in range(40):
            day += 1 if rng.random() < 0.9 else int(rng.integers(2, 9))
            rows.append((f"s{s}", START + dt.timedelta(days=day), float(rng.normal() * 0.2 - (1.5 if i > 25 and s % 2 else 0))))
    rows.append(("ended", START, 0.1))
    return rows


def walk(rows, **kw):
    """The rule applied to whole series, timers that stand at the end included."""
    p = alerts.AlertProcessor(int(3 * 86_400_000), 0.5, 3.0, 0.5, kw.get("warmup", 10))
    out, last = [], max(r[1] for r in rows)
    for name in sorted({r[0] for r in rows}):
        held = None
        for _, ds, y in sorted(r for r in rows if r[0] == name):
            held, found = p.step(held, int(ds.replace(tzinfo=dt.timezone.utc).timestamp() * 1000), y)
            out += [(name, ms, kind) for ms, kind, _ in found]
        end = held[5] + p.silence_ms
        if end <= last.replace(tzinfo=dt.timezone.utc).timestamp() * 1000:
            out.append((name, end, "silent"))
    return sorted(out)


def ran(spark, folder, checkpoint, path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    with alerts.timed_state(spark):
        out = jobs.run_to_table(alerts.alert_stream(stream), "alerts", checkpoint, path)
    return sorted((r["series_id"], int(r["ds"].replace(tzinfo=dt.timezone.utc).timestamp() * 1000), r["kind"]) for r in out.collect())


def test_alerts_across_a_restart(spark, tmp_path):
    """Half of the days, a stop, the other half from the same checkpoint: as if read at once."""
    rows = series()
    folder, cut = str(tmp_path / "in"), START + dt.timedelta(days=22)

    def feed(some):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    feed([r for r in rows if r[1] <= cut])
    first = ran(spark, folder, str(tmp_path / "cp"), str(tmp_path / "out"))
    assert first == walk([r for r in rows if r[1] <= cut]) and ("ended", "silent") in {(a, c) for a, _, c in first}
    feed([r for r in rows if r[1] > cut])
    want = walk(rows)
    assert ran(spark, folder, str(tmp_path / "cp"), str(tmp_path / "out")) == want
    assert {k for _, _, k in want} >= {"silent", "drop", "down"}
    assert spark.conf.get(alerts.PROVIDER, None) != alerts.ROCKS


def texts(spark, ids):
    words = {0: "great battery", 1: "the screen is awful", 2: "price was bad but quality good", 3: "", 4: None}
    return spark.createDataFrame([(str(i), words[i % 5]) for i in ids], "review_id string, text string")


def bag(df):
    return sorted(map(str, df.select("review_id", "token_pos", "term", "sentiment", "confidence").collect()))


def test_a_batch_sent_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "scored")
    ingest.ingest_batch(texts(spark, range(20)), 0, path)
    ingest.ingest_batch(texts(spark, range(20)), 0, path)           # the same batch again
    ingest.ingest_batch(texts(spark, [*range(10, 30), 11, 11]), 1, path)    # known reviews and repeats in a new batch
    assert bag(ingest.scored_mentions(spark, path)) == bag(extract_aspects(texts(spark, range(30))))
    assert sorted(map(tuple, spark.read.parquet(f"{path}/ledger").collect())) == [(0, 20), (1, 10)]


def test_a_batch_that_broke_off_is_done_again(spark, tmp_path):
    path = str(tmp_path / "scored")

    def broken(batch):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ingest.ingest_batch(texts(spark, range(5)), 0, path, broken)
    half = texts(spark, range(3))
    extract_aspects(half).write.parquet(f"{path}/mentions/batch=1")     # written, but not in the ledger
    half.select("review_id").write.parquet(f"{path}/ids/batch=1")
    ingest.ingest_batch(texts(spark, range(5)), 1, path)
    assert bag(ingest.scored_mentions(spark, path)) == bag(extract_aspects(texts(spark, range(5))))


def test_stream_equals_the_batch_scorer(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    texts(spark, range(15)).coalesce(1).write.parquet(folder)

    def run():
        stream = spark.readStream.schema("review_id string, text string").option("maxFilesPerTrigger", 1).parquet(folder)
        return bag(ingest.run_scored_ingest(stream, path, checkpoint))

    assert run() == bag(extract_aspects(texts(spark, range(15))))
    texts(spark, range(10, 40)).coalesce(1).write.mode("append").parquet(folder)
    assert run() == bag(extract_aspects(texts(spark, range(40)))) == run()
    assert spark.read.parquet(f"{path}/ledger").agg(F.sum("reviews")).first()[0] == 40


def test_streams_read_a_table_of_many_files(spark, tmp_path):
    rows = [(str(i), "battery great" if i % 2 else "screen bad") for i in range(10)]
    table = spark.createDataFrame(rows, "review_id string, text string")
    table.repartition(3).write.parquet(str(tmp_path / "many/documents.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one/documents.parquet")
    for folder in ("many", "one"):
        stream = jobs.read_stream(spark, str(tmp_path / folder), "documents.parquet", table.schema)
        read = jobs.run_to_table(stream, "read", path=str(tmp_path / f"read-{folder}"))
        assert sorted(map(tuple, read.collect())) == sorted(rows)
        out = ingest.run_scored_ingest(stream, str(tmp_path / f"out-{folder}"),
                                       score=lambda b: extract_aspects(b, ["battery", "screen"], {"great": 1.0, "bad": -1.0}))
        assert out.count() == len(rows)
