"""Large forests: trees that a task grows whole, held against a search over all splits and against Spark ML's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.operators import forest, importance, learn

FEATS = ["a", "b", "c"]


def table(spark, n=3000, seed=4):
    rnd = np.random.default_rng(seed)
    a, b, c = rnd.random(n), rnd.integers(0, 5, n).astype(float), rnd.random(n)
    y = (rnd.random(n) < 0.15 + 0.6 * (a > 0.5) * (b >= 2) + 0.1 * (c > 0.7)).astype(int)
    rows = [("d", i, None if i % 50 == 0 else float(a[i]), float(b[i]), float(c[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, row_id long, a double, b double, c double, y int")


def gini(w):
    n = w.sum()
    return 1 - ((w / n) ** 2).sum() if n > 0 else 0.0


def slow(cells, w, depth):
    """(feature, bin, left, right) or the leaf's class rows, by looking at every split; siblings of one class made one."""
    total = w.sum(1)
    best = None
    if depth and total.min() > 0:
        for f in range(cells.shape[1]):
            for b in range(int(cells.max()) + 1):
                left = cells[:, f] <= b
                l, r = w[:, left].sum(1), w[:, ~left].sum(1)
                if min(l.sum(), r.sum()) <= 0:
                    continue
                gain = gini(total) - l.sum() / total.sum() * gini(l) - r.sum() / total.sum() * gini(r)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, b, left)
    if best is None or best[0] <= 1e-12:
        return total
    _, f, b, left = best
    parts = [slow(cells[side], w[:, side], depth - 1) for side in (left, ~left)]
    if all(isinstance(p, np.ndarray) for p in parts) and (parts[0][1] > parts[0][0]) == (parts[1][1] > parts[1][0]):
        return total
    return f, b, parts


def held(tree, n=0):
    if tree.feature[n] < 0:
        return np.array([(1 - tree.share[n]) * tree.cover[n], tree.share[n] * tree.cover[n]])
    return int(tree.feature[n]), int(tree.bin[n]), [held(tree, tree.left[n]), held(tree, tree.left[n] + 1)]


def alike(s, t):
    if isinstance(s, np.ndarray) or isinstance(t, np.ndarray):
        return isinstance(s, np.ndarray) and isinstance(t, np.ndarray) and np.allclose(s, t)
    return s[:2] == t[:2] and all(alike(x, y) for x, y in zip(s[2], t[2], strict=True))


@pytest.mark.parametrize("depth", [0, 2, 30])
def test_a_tree_is_that_of_a_search_over_all_splits(depth, monkeypatch):
    monkeypatch.setattr(forest, "_NODES", 3)
    rnd = np.random.default_rng(depth)
    cells = rnd.integers(0, 6, (70, 3)).astype(np.uint8)
    w = rnd.poisson(1.0, (2, 70)).astype(float)
    tree = forest.grow(cells, w, 3, depth, rnd)
    assert alike(held(tree), slow(cells, w, depth))
    inner = tree.feature >= 0
    assert abs(forest.importance(tree, 3).sum() - (1.0 if inner.any() else 0.0)) < 1e-9
    assert np.allclose(tree.cover[inner], tree.cover[tree.left[inner]] + tree.cover[tree.left[inner] + 1])


def test_large_forests_score_and_rank_like_spark_ml(spark, monkeypatch):
    df, new = table(spark), table(spark, 2000, 5).repartition(3)
    for trainer, params in ((learn.train_rf, {"trees": 40, "max_depth": 6}), (learn.train_bagged_trees, {"n": 40, "max_depth": 6})):
        own = {}
        for large in (0, 10**9):
            monkeypatch.setattr(learn, "LARGE", large)
            sc = trainer(df, FEATS, **params)
            assert isinstance(sc.model, forest.Forest) == (large == 0)
            own[large] = {r.row_id: r.p for r in sc(new).select("row_id", "p").collect()}
        p, q = (np.array([own[k][i] for i in range(2000)]) for k in (0, 10**9))
        assert np.abs(p - q).mean() < 0.03 and np.corrcoef(p, q)[0, 1] > 0.98
    ranked = {}
    for large in (0, 10**9):
        monkeypatch.setattr(learn, "LARGE", large)
        ranked[large] = {r.feature: r.importance for r in importance.importance_rf(df, FEATS, trees=40, max_depth=6).collect()}
    assert abs(sum(ranked[0].values()) - 1) < 1e-9 and all(abs(ranked[0][f] - ranked[10**9][f]) < 0.05 for f in FEATS)


def test_large_forests_are_few_jobs_and_follow_no_partitions(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(learn, "LARGE", 0)
    monkeypatch.setattr(forest, "HELD", 1)  # a group a tree
    df, sc = table(spark), spark.sparkContext
    sc.setJobGroup("grown", "a forest")
    first = learn.train_rf(df, FEATS, trees=6)
    jobs = len(sc.statusTracker().getJobIdsForGroup("grown"))
    sc.setJobGroup("other", "")
    assert jobs <= 20  # whatever the depth
    again = learn.train_rf(df.repartition(5, "c"), FEATS, trees=6)
    twice = df.unionByName(df).select("row_id", *FEATS)  # rows that repeat stay
    got, want = (sorted((r.row_id, r.p) for r in s(twice).collect()) for s in (first, again))
    assert got == want and len(got) == 6000
    x = forest._matrix([bytes(r._cell) for r in forest.coded(df, FEATS, first.model.cuts, ["row_id"]).orderBy("row_id").collect()], 3)
    mean = np.mean([forest.shares(t, x) for t in first.model.tables()], axis=0)
    assert np.allclose([p for _, p in got[::2]], mean)
    assert learn.save_model(first, str(tmp_path), "d", "rf", "six").endswith("six")
    trees = first.trees()
    assert abs(trees.expected() - np.mean([t.share[0] for t in first.model.tables()])) < 1e-9


def test_a_forest_of_too_many_cells_is_spark_mls(spark, monkeypatch):
    monkeypatch.setattr(learn, "LARGE", 0)
    monkeypatch.setattr(forest, "CELLS", 1)
    assert not isinstance(learn.train_rf(table(spark, 200), FEATS, trees=2, max_depth=3).model, forest.Forest)
    assert learn.train_rf(table(spark, 200), FEATS, trees=2, max_depth=3)(table(spark, 50)).where(F.col("p").between(0, 1)).count() == 50
