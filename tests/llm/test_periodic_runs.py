"""Runs and Lyndon arrays against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from opinara.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute_lyndon(x):
    out = []
    for i in range(len(x)):
        j = i + 1
        while j < len(x) and x[j:] > x[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(x, least=6, powers=4):
    """Every maximal stretch for each period; the smallest period of a stretch counts."""
    found, seen = [], set()
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i:
                length = j + q - i
                if length >= 2 * q and (i, length) not in seen:
                    seen.add((i, length))
                    if length >= max(least, powers * q):
                        found.append((i, length, q))
                i = j
            else:
                i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(count, longest=45):
    rng = random.Random(4)
    for _ in range(count):
        n, k = rng.randrange(1, longest), rng.choice([1, 2, 2, 3, 6])
        x = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3 + 1))
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        yield x


def test_lyndon_arrays_under_both_orders():
    for x in sequences(1500):
        ranks = np.unique(x, return_inverse=True)[1]
        for line in (ranks, ranks.max() - ranks):
            assert periodic.lyndon_array(line.tolist()) == brute_lyndon(line.tolist())
    assert periodic.lyndon_array([]) == []


@pytest.mark.parametrize("least,powers", [(6, 4), (2, 2), (3, 3), (1, 5)])
def test_runs(least, powers):
    for x in sequences(1200):
        assert periodic.runs_of(np.array(x), least, powers) == brute_runs(x, least, powers)


def test_nested_runs_and_long_texts():
    x = (["a"] * 6 + ["b"]) * 5
    ids = np.unique(x, return_inverse=True)[1]
    assert periodic.runs_of(ids) == brute_runs(x) and len(brute_runs(x)) == 6
    assert periodic.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic.runs_of(np.arange(300_000) % 50_000) == [(0, 300_000, 50_000)]


def test_collapse_drops_what_any_run_repeats():
    assert periodic.collapse([b"x", *[b"a", b"b"] * 4, b"y"], [(1, 8, 2)]) == [b"x", b"a", b"b", b"y"]
    assert periodic.collapse([b"a"] * 7, [(0, 7, 1)]) == [b"a"]


def expected(own, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 0 if own is None else zlib.crc32(str(own).encode())
    if own is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (own, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def test_every_kind_of_row(spark):
    tenth = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(1, "a b " * 9), (1, "a b " * 9), (None, "x x x x x x"), (2, None), (tenth, ""), (tenth, None), (tenth, "one two"),
            (tenth, "w1 w2 w3\tw4\nw5 w6 w7 w8 w9 " * 7), (3, "é é é é " * 8), (4, " \x0b "), (5, "k " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs", "2 as _h", "3 as _words")
    out = periodic.digests(periodic.find_runs(periodic.planted(docs)))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(
        str(expected(*r) if r[0] != 5 else (5, 1, 0, 100_000, 1, 100_000_000, hashlib.sha256(b"0,100000,1\n").hexdigest(),
                                            hashlib.sha256(b"k").hexdigest())) for r in rows)
    assert periodic.find_runs(docs.limit(0)).collect() == []
    spans = periodic.find_runs(docs.where("doc_id = 1")).first()
    assert [tuple(r) for r in spans["runs"]] == [(0, 18, 2)] and spans["collapsed"] == "a b" and spans["n_words"] == 18
    with pytest.raises(ValueError):
        periodic.find_runs(docs, powers=1)


def test_query_equals_brute_force(spark):
    """The documents of at most 700 words; brute force is quadratic."""
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    short = [r for r in docs if len((r["text"] or "").split()) <= 700]
    assert len(short) > len(docs) / 2
    for r in short:
        assert got[r["doc_id"]] == expected(r["doc_id"], r["text"])
