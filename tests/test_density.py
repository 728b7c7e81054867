"""The density hierarchy against a brute-force one that looks at every threshold."""

import numpy as np
import pytest

from opinara.operators import density, similarity
from opinara.plans import catalog

SF = "/root/testdata/sf0.001"


def vectors(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 8))
    spread = rng.choice([0.05, 0.2, 0.6], size=n)
    v = centres[rng.integers(0, 5, n)] + rng.normal(size=(n, 8)) * spread[:, None]
    v[n - n // 8:] = rng.normal(size=(n // 8, 8))
    for i in range(copies):
        v[rng.integers(0, n)] = v[i % 3]
    return v


def reachability(v, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(0, 2 - 2 * u @ u.T)).round(9)
    d[(u[:, None, :] == u[None, :, :]).all(axis=2)] = 0
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, min(k, len(v) - 1) - 1]
    np.fill_diagonal(d, 0)
    return np.maximum(np.maximum(d, core[:, None]), core[None, :]), core


def parts(m, at):
    """Connected parts of the vectors whose distance is at most `at`."""
    label = np.arange(len(m))
    near = m <= at
    while True:
        new = np.minimum(np.where(near, label[None, :], len(m)).min(axis=1), label)
        new = new[new]
        if (new == label).all():
            return [np.flatnonzero(label == r) for r in np.unique(label)]
        label = new


def brute(v, min_size, k):
    """(label, density at leaving, outlier score) from the top: split at every threshold, one after another."""
    m, core = reachability(v, k)
    m[np.arange(len(v)), np.arange(len(v))] = core     # alone a vector is no denser than its core
    levels = sorted({*tree_weights(v, k), *core.tolist()}, reverse=True)   # nothing comes apart in between
    leaves, owner, tree = {}, {}, []

    def big(group, at):
        """Parts of at least min_size strictly below a threshold."""
        sub = m[np.ix_(group, group)].copy()
        np.fill_diagonal(sub, 0)
        return [group[p] for p in parts(np.where(sub < at, 0, 1), 0)]

    def split(group, birth, parent):
        number = len(tree)
        tree.append({"parent": parent, "birth": birth, "fall": 0.0, "children": [], "top": 0.0, "members": set(group.tolist())})
        if parent is not None:
            tree[parent]["children"].append(number)
        now = group
        for at in levels:
            found = big(now, at)
            if len(found) == 1 and len(found[0]) == len(now):
                continue
            lam = 1 / max(at, density.LEAST)
            heavy = [p for p in found if len(p) >= min_size]
            for p in found:
                if len(p) < min_size:
                    for i in p:
                        leaves[i], owner[i] = lam, number
                        tree[number]["fall"] += lam
                        tree[number]["top"] = max(tree[number]["top"], lam)
            if len(heavy) == 1:
                now = heavy[0]
                continue
            for p in heavy:
                tree[number]["fall"] += lam * len(p)
                child = split(p, lam, number)
                tree[number]["top"] = max(tree[number]["top"], lam, tree[child]["top"])
            return number
        # equal vectors of core 0 never part
        for i in now:
            if i not in leaves:
                leaves[i], owner[i] = 1 / density.LEAST, number
                tree[number]["fall"] += 1 / density.LEAST
                tree[number]["top"] = 1 / density.LEAST
        return number

    if len(v) < min_size:
        return [(-1, None, None)] * len(v), tree
    split(np.arange(len(v)), 0.0, None)

    def best(number):
        node = tree[number]
        below = sum(best(c) for c in node["children"])
        node["stability"] = node["fall"] - node["birth"] * len(node["members"])
        node["chosen"] = number > 0 and node["stability"] >= below - 1e-6
        return max(node["stability"], below)

    best(0)

    def pick(number):
        found = None
        while number is not None:
            found = number if tree[number]["chosen"] else found
            number = tree[number]["parent"]
        return found

    out = []
    for i in range(len(v)):
        p = pick(owner[i])
        out.append((-1 if p is None else min(tree[p]["members"]), leaves[i], 1 - leaves[i] / tree[owner[i]]["top"]))
    return out, tree


def tree_weights(v, k):
    m, _ = reachability(v, k)
    best, todo, out = m[0].copy(), set(range(1, len(v))), []
    while todo:
        i = min(todo, key=lambda x: best[x])
        out.append(best[i])
        todo.remove(i)
        best = np.minimum(best, m[i])
    return sorted(out)


def frame(spark, v):
    return spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("n,copies,cells,slice_edges", [(500, 60, 6, 200_000), (90, 40, 4, 20)])
def test_labels_and_scores_equal_brute_force(spark, n, copies, cells, slice_edges):
    v = vectors(n, n, copies)
    want, _ = brute(v, 10, 10)
    out = density.density_clusters(frame(spark, v), cells=cells, slice_edges=slice_edges)
    got = {r["vec_id"]: r for r in out.collect()}
    assert [got[i]["cluster"] for i in range(n)] == [w[0] for w in want]
    assert len({w[0] for w in want}) > 2
    for i, (_, lam, score) in enumerate(want):
        assert got[i]["leaves_at"] == pytest.approx(lam, rel=1e-6)
        assert got[i]["outlier_score"] == pytest.approx(score, abs=1e-6)


def test_spanning_tree_weights(spark):
    v = vectors(200, 3)
    reps, _ = similarity.distinct_vectors(frame(spark, v), "vec_id", "embedding")
    _, tree = density.spanning_tree(reps, 5, 5)
    assert sorted(r["dist"] for r in tree.collect()) == pytest.approx(tree_weights(v, 5), abs=1e-8)


def test_small_and_equal_tables(spark):
    few = density.density_clusters(frame(spark, vectors(6, 1)))
    assert {tuple(r)[1:] for r in few.collect()} == {(-1, None, None)}
    same = density.density_clusters(frame(spark, np.ones((30, 4))))
    assert {r["cluster"] for r in same.collect()} == {-1} and same.count() == 30      # the whole is never chosen
    assert density.density_clusters(frame(spark, vectors(6, 1)).limit(0)).collect() == []
    with pytest.raises(ValueError):
        density.hierarchy(None, None, 1)


def test_merging_takes_ties_at_once():
    """12 + 6 + 6 vectors meet at one distance: the cluster of 12 goes on, whatever the order of the edges."""
    for order in ([(0, 1), (1, 2)], [(1, 2), (0, 1)]):
        parts_ = {0: density._Part(0, (), 12, "0/12", 5.0, 0.0, 2.0), 1: density._Part(1, ((1, 6),), 6),
                  2: density._Part(2, ((2, 6),), 6)}
        rows, left = density.merge_edges([(a, b, 0.5) for a, b in order], parts_, 10)
        assert [(r[0], r[1], r[2]) for r in rows] == [(density.POINT, 1, "0/12"), (density.POINT, 2, "0/12")]
        assert left[0].points == 24 and left[0].fall == 5.0 + 24.0


def test_query_runs_on_all_vectors(spark):
    out = catalog.QUERIES["density_clusters"](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
