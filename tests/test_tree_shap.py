"""Exact tree Shapley values against enumeration of all coalitions."""

import itertools
import math
import random

import numpy as np
import pytest

from scorelab.operators import explain, learn, newton, passes, tree_shap

FEATS = [f"f{i}" for i in range(6)]


def toy(spark, n=160, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rnd.gauss(0, 1) for _ in range(4)] + [float(rnd.randint(0, 2)), rnd.choice([0.0, 1.0])]
        rows.append(("a" if i % 3 else "b", i, *x, int(x[0] * x[1] + x[4] - x[5] + rnd.gauss(0, 0.5) > 0.5)))
    return spark.createDataFrame(rows, "dataset string, row_id long, " + ", ".join(f"{f} double" for f in FEATS) + ", y int")


def conditional(tree, x, known, node=0):
    """What the tree gives when only the features in ``known`` are known: covers weigh the rest."""
    f = int(tree.feature[node])
    if f < 0:
        return float(tree.value[node])
    left, right = int(tree.left[node]), int(tree.right[node])
    if f in known:
        return conditional(tree, x, known, left if x[f] <= tree.threshold[node] else right)
    share = tree.cover[left] / tree.cover[node]
    return share * conditional(tree, x, known, left) + (tree.cover[right] / tree.cover[node]) * conditional(tree, x, known, right)


def slow(trees, x, d):
    """(values, interactions) from all coalitions."""
    f = {s: sum(conditional(t, x, s) for t in trees) for r in range(d + 1) for s in map(frozenset, itertools.combinations(range(d), r))}
    phi, inter = np.zeros(d), np.zeros((d, d))
    for s, v in f.items():
        for j in range(d):
            if j not in s:
                phi[j] += math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) * (f[s | {j}] - v)
                for i in range(j):
                    if i not in s:
                        w = math.factorial(len(s)) * math.factorial(d - len(s) - 2) / (2 * math.factorial(d - 1))
                        gain = w * (f[s | {i, j}] - f[s | {i}] - f[s | {j}] + v)
                        inter[i, j] += gain
                        inter[j, i] += gain
    inter[np.arange(d), np.arange(d)] = phi - inter.sum(1)
    return phi, inter


@pytest.mark.parametrize("grow", [newton.BY_LEVEL, newton.BY_LEAF | {"least_rows": 3}])
def test_values_and_interactions_equal_enumeration(spark, grow):
    df = toy(spark)
    fits, cuts = newton.fit_trees(passes.model_rows(df, FEATS), [newton.Model(3, 0.5, **grow)])
    nodes = [tree_shap.newton_nodes(t, cuts[""]) for t in fits[""][0].trees]
    trees = tree_shap.trees_of(nodes, fits[""][0].start)
    x = np.array([[r[f] for f in FEATS] for r in df.orderBy("row_id").collect()])
    phi, inter = tree_shap.values(trees, x), tree_shap.interactions(trees, x)
    for i in range(0, len(x), 40):
        want, pairs = slow(nodes, x[i], 6)
        assert np.allclose(phi[i], want, atol=1e-9) and np.allclose(inter[i], pairs, atol=1e-9)
    out = newton.margins(passes.codes_of(x, cuts[""]), fits[""][0], [3])[:, 0]
    assert np.allclose(phi.sum(1) + trees.expected(), out, atol=1e-9)
    assert np.allclose(inter.sum(2), phi, atol=1e-9)


@pytest.mark.parametrize(("trainer", "kw", "scale"), [
    (learn.train_rf, {"trees": 5, "max_depth": 4}, "p"), (learn.train_sgb, {"n": 4}, "logit"), (learn.train_gbt_grid, {"n": 4, "lr": 0.3}, "logit")])
def test_table_sums_to_the_models_output(spark, trainer, kw, scale):
    df = toy(spark, 200, 2)
    sc = trainer(df, FEATS, **kw)
    phi = explain.shapley_rows(sc, df, df, FEATS, model="m")
    assert phi.columns == ["dataset", "model", "row_id", "feature", "feature_value", "phi", "base_value"]
    total = {r.row_id: r.s + r.b for r in phi.groupBy("row_id").agg({"phi": "sum", "base_value": "max"}).toDF("row_id", "s", "b").collect()}
    for r in sc(df).select("row_id", "p").collect():
        want = r.p if scale == "p" else math.log(r.p / (1 - r.p))
        assert abs(total[r.row_id] - want) < 1e-6
    assert phi.count() == 200 * 6


def test_table_of_interactions_finds_the_planted_pair(spark):
    df = toy(spark, 600, 3)
    sc = learn.train_gbt_grid(df, FEATS, n=15, lr=0.3)
    top = explain.pair_interactions(sc, df, df, FEATS, 3).collect()
    first = {r.dataset: (r.a, r.b) for r in sorted(top, key=lambda r: r.strength)}
    assert first == {"a": ("f0", "f1"), "b": ("f0", "f1")} and len(top) == 6


def test_a_tree_without_splits_and_unknown_covers(spark):
    stump = tree_shap.Nodes(*(np.array(c) for c in ([-1], [0.0], [0], [0], [0.25], [9.0])))
    trees = tree_shap.trees_of([stump], 1.0)
    assert trees.expected() == 1.25 and (tree_shap.values(trees, np.zeros((3, 2))) == 0).all()
    empty = tree_shap.Nodes(*(np.array(c) for c in ([0, -1, -1], [0.5, 0.0, 0.0], [1, 0, 0], [2, 0, 0], [0.0, 1.0, 2.0], [0.0, 0.0, 0.0])))
    assert np.isfinite(tree_shap.values(tree_shap.trees_of([empty]), np.zeros((2, 1)))).all()


def deep_tree(rnd, d, splits):
    tree, leaves = newton.Tree(), [0]
    for _ in range(splits):
        leaves += tree.grow(leaves.pop(0 if rnd.random() < 0.3 else -1), int(rnd.integers(d)), int(rnd.integers(0, 9)))
    cover = np.ones(len(tree.feature))
    for n in reversed(range(len(cover))):
        cover[n] = 1 + rnd.random() if tree.feature[n] < 0 else cover[tree.left[n]] + cover[tree.right[n]]
    return tree_shap.Nodes(np.array(tree.feature), np.array(tree.bin) / 3.0 - 1, np.array(tree.left), np.array(tree.right), rnd.normal(size=len(cover)), cover)


@pytest.mark.parametrize(("d", "pairs"), [(4, False), (13, False), (4, True), (13, True)])
def test_looked_up_values_are_those_of_each_block(monkeypatch, d, pairs):
    """Tables of all flags, in chunks, kept or not, against working out the flags that a block has."""
    rnd = np.random.default_rng(d)
    trees = tree_shap.trees_of([deep_tree(rnd, d, 40) for _ in range(3)], 0.5)
    x = rnd.normal(size=(200, d))
    x[0], x[1, 0], x[2, 0], x[3, 1] = np.nan, -np.inf, np.inf, trees.leaves[0].hi[0]
    make = lambda: tree_shap.Lookup(trees, d * (d - 1) // 2, tree_shap._pairs_part(d), 2) if pairs else tree_shap.Lookup(trees, d, tree_shap._values_part)
    monkeypatch.setattr(tree_shap.Lookup, "MOST", 0)
    want = make().sums(x)
    for most, chunk, kept in ((8, 1024, 1 << 26), (8, 7, 0), (3, 50, 1 << 26)):
        for name, v in (("MOST", most), ("CHUNK", chunk), ("KEPT", kept)):
            monkeypatch.setattr(tree_shap.Lookup, name, v)
        found = make()
        assert np.allclose(found.sums(x), want, atol=1e-12) and np.allclose(found.sums(x), want, atol=1e-12)
