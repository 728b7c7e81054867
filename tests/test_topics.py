"""Expectation and maximisation over DataFrames against numpy."""

import hashlib

import numpy as np
import pytest

from opinara.operators import topics


def counts_frame(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for cat, words in (("x", ["aa", "bb", "cc", "dd", "ee"]), ("y", ["aa", "ff", "gg"])):
        for d in range(12):
            half = words[: len(words) // 2] if d % 2 else words[len(words) // 2:]
            rows += [(cat, f"{cat}{d}", w, int(n)) for w in half if (n := rng.integers(0, 6))]
    return rows, spark.createDataFrame(rows, "main_category string, review_id string, word string, n long").repartition(3)


def brute(rows, cat, k, rounds):
    own = [r for r in rows if r[0] == cat]
    docs, words = sorted({r[1] for r in own}), sorted({r[2] for r in own})
    n = np.zeros((len(docs), len(words)))
    for _, d, w, c in own:
        n[docs.index(d), words.index(w)] = c
    p = np.array([[1 + int(hashlib.md5(f"{d}:{z}".encode()).hexdigest()[:4], 16) / 65536 for z in range(k)] for d in docs])
    p /= p.sum(axis=1, keepdims=True)
    q = (n.T @ p + topics.BETA).T
    q /= q.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        r = p[:, :, None] * q[None]
        r = n[:, None, :] * r / r.sum(axis=1, keepdims=True)
        q = r.sum(axis=0) + topics.BETA
        q /= q.sum(axis=1, keepdims=True)
        p = r.sum(axis=2) + topics.ALPHA
        p /= p.sum(axis=1, keepdims=True)
    return docs, words, p, q


@pytest.mark.parametrize("k,rounds", [(2, 0), (3, 4)])
def test_rounds_equal_numpy(spark, k, rounds):
    rows, df = counts_frame(spark)
    words, docs = topics.em_topics(df, k, rounds)
    got_w = {(r["main_category"], r["word"]): [r[f"q{z}"] for z in range(k)] for r in words.collect()}
    got_d = {r["review_id"]: [r[f"p{z}"] for z in range(k)] for r in docs.collect()}
    for cat in "xy":
        d, w, p, q = brute(rows, cat, k, rounds)
        for j, word in enumerate(w):
            assert got_w[cat, word] == pytest.approx(list(q[:, j]), rel=1e-9)
        for i, doc in enumerate(d):
            assert got_d[doc] == pytest.approx(list(p[i]), rel=1e-9)
    assert len(got_w) == 8


def test_categories_find_their_themes(spark):
    """Two themes a category, each with an aspect of its own; one aspect is shared by both categories."""
    themes = {"x": (["apple", "pear", "plum", "fig"], ["train", "plane", "ship", "cart"]),
              "y": (["apple", "grape", "lime", "date"], ["stone", "sand", "clay", "iron"])}
    texts, mentions = [], []
    rng = np.random.default_rng(3)
    for cat, pair in themes.items():
        for i in range(40):
            theme = pair[i % 2]
            texts.append((f"{cat}{i}", " ".join(rng.choice(theme, 8))))
            mentions.append((f"{cat}{i}", "Negative", cat, "taste" if i % 2 == 0 else f"only {cat}"))
    texts.append(("few", "apple pear"))
    mentions += [("few", "Negative", "small", "taste"), ("x0", "Positive", "x", "happy"), ("none", "Negative", None, "taste")]
    m = spark.createDataFrame(mentions, "review_id string, sentiment string, main_category string, aspect_term_normalized string")
    t = spark.createDataFrame(texts, "review_id string, text string")
    found = topics.category_topics(m, t, 2, rounds=15, top_words=4)
    rows = found.collect()
    assert {(r["main_category"], frozenset(r["words"])) for r in rows} == {(c, frozenset(w)) for c, p in themes.items() for w in p}
    assert all(r["document_count"] == 20 and len(r["top_aspects"]) == 1 for r in rows)
    concerns = {r["aspect_term_normalized"]: (r["categories"], r["universal"], r["specific"]) for r in topics.topic_concerns(found).collect()}
    assert concerns == {"taste": (2, True, False), "only x": (1, False, True), "only y": (1, False, True)}
    assert topics.category_topics(m.limit(0), t, 2, rounds=1).collect() == []


def test_a_count_is_no_row_of_a_round(spark, monkeypatch):
    """Rounds write one row per text and per word of a block, several blocks give the same weights, numbers have no gaps."""
    rows, df = counts_frame(spark, 2)
    numbers = topics._numbered(df.select("main_category", "review_id", "word").repartition(5), "i", "numbers")
    assert sorted(r["i"] for r in numbers.collect()) == list(range(len(rows)))
    written = {}

    def note(df, name="stage"):
        out = plain(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    plain = topics.materialize
    monkeypatch.setattr(topics, "materialize", note)
    for block in (10 ** 6, 20):
        monkeypatch.setattr(topics, "BLOCK", block)
        monkeypatch.setattr(topics, "SLICE", 7)
        words, docs = topics.em_topics(df, 2, 3)
        got = {r["review_id"]: [r["p0"], r["p1"]] for r in docs.collect()}
        for cat in "xy":
            d, w, p, q = brute(rows, cat, 2, 3)
            for i, doc in enumerate(d):
                assert got[doc] == pytest.approx(list(p[i]), rel=1e-9)
        if block > 20:
            assert written["shares"] == len({r[:2] for r in rows}) + len({(r[0], r[2]) for r in rows}) < len(rows)
