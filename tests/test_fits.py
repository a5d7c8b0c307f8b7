"""Models fitted in shared passes: stumps, second-order trees, networks, grouped calibration."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.operators import boosting, learn, networks, newton, passes


def toy(spark, n=240, seed=1, dataset="a"):
    """Two informative features, one constant, one with ties and nulls; rows of one dataset."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, t = rnd.gauss(0, 1), rnd.randint(0, 6), rnd.choice([None, 1.0, 1.0, 2.5])
        y = int(a + 0.4 * b + rnd.gauss(0, 1.2) > 1.2)
        rows.append((dataset, i, a, float(b), 3.0, t, y))
    return spark.createDataFrame(rows, "dataset string, row_id long, a double, b double, c double, t double, y int")


FEATS = ["a", "b", "c", "t"]


def plain(df):
    rows = df.orderBy("row_id").collect()
    return np.array([[r[f] if r[f] is not None else 0.0 for f in FEATS] for r in rows], float), np.array([r.y for r in rows])


def slow_stumps(x, y, w, rounds, rate):
    """SAMME by looking at every midpoint of every feature."""
    path, w = [], w / w.sum()
    for _ in range(rounds):
        best = None
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            for t in (v[:-1] + v[1:]) / 2:
                left = x[:, j] <= t
                sums = [[w[side & (y == c)].sum() for c in (0, 1)] for side in (left, ~left)]
                if min(map(sum, sums)) <= 1e-12:
                    continue
                gini = round(sum(s[0] * s[1] / sum(s) for s in sums), 12)
                if best is None or gini < best[0]:
                    best = (gini, j, t, [int(s[1] > s[0]) for s in sums])
        _, j, t, (lo, hi) = best
        miss = np.where(x[:, j] <= t, lo, hi) != y
        err = w[miss].sum()
        if err >= 0.5:
            break
        alpha = rate * math.log((1 - err) / err)
        path.append((j, t, lo, hi, alpha))
        w = w * np.exp(alpha * miss)
        w /= w.sum()
    return path


def test_stumps_equal_a_search_over_all_midpoints(spark):
    df = toy(spark).unionByName(toy(spark, 150, 2, "b"))
    rows = passes.model_rows(df, FEATS, group="dataset", fold=F.col("row_id") % 3)
    models = [boosting.Model(12, 1.0), boosting.Model(7, 0.5, 1)]
    paths, cuts = boosting.fit_stumps(rows, models, rewrite=5)
    for g in ("a", "b"):
        x, y = plain(df.where(F.col("dataset") == g))
        fold = np.arange(len(y)) % 3
        for m, model in enumerate(models):
            got = [(s.feature, float(cuts[g][s.feature][s.bin]), s.left, s.right, s.alpha) for s in paths[g][m]]
            want = slow_stumps(x, y, (fold != model.held).astype(float), model.rounds, model.rate)
            assert [r[:4] for r in got] == [r[:4] for r in want]
            assert np.allclose([r[4] for r in got], [r[4] for r in want])


def test_one_pass_gives_what_single_fits_give(spark):
    df = toy(spark)
    rows = passes.model_rows(df, FEATS, fold=F.col("row_id") % 2)
    many, _ = boosting.fit_stumps(rows, [boosting.Model(8, 1.0), boosting.Model(6, 0.1, 0), boosting.Model(3, 0.5)], rewrite=3)
    for m, model in enumerate([boosting.Model(4, 1.0), boosting.Model(6, 0.1, 0), boosting.Model(2, 0.5)]):
        one, _ = boosting.fit_stumps(rows.repartition(3), [model])
        for s, t in zip(one[""][0], many[""][m], strict=False):
            assert s[1:] == t[1:] and math.isclose(s.alpha, t.alpha, rel_tol=1e-9)
        assert len(one[""][0]) == min(model.rounds, len(many[""][m]))


def test_stumps_on_one_class_and_on_separable_rows(spark):
    df = toy(spark, 40)
    one = passes.model_rows(df.withColumn("y", F.lit(1)), FEATS)
    paths, _ = boosting.fit_stumps(one, [boosting.Model(5, 1.0)])
    assert len(paths[""][0]) == 1  # no error: the fit is over
    clear = passes.model_rows(df.withColumn("y", (F.col("a") > 0).cast("int")), FEATS)
    sc = learn.family_scorer(learn.stump_family, df.withColumn("y", (F.col("a") > 0).cast("int")), FEATS, "y", {"n": 5})
    assert boosting.fit_stumps(clear, [boosting.Model(5, 1.0)])[0][""][0][0].feature == 0
    assert all((r.p > 0.5) == (r.a > 0) for r in sc(df).select("a", "p").collect())


def slow_tree(x, y, f, model, thresholds):
    """One tree by exhaustive search, one split at a time; returns each row's value and the split list."""
    p = 1 / (1 + np.exp(-f))
    g, h, c = p - y, p * (1 - p), model.penalty

    def best(at):
        top = None
        total = g[at].sum() ** 2 / (h[at].sum() + c)
        for j in range(x.shape[1]):
            for t in thresholds[j]:
                left, right = at[x[at, j] <= t], at[x[at, j] > t]
                if min(len(left), len(right)) < max(model.least_rows, 1) or min(h[left].sum(), h[right].sum()) < model.least_hessian:
                    continue
                gain = round(g[left].sum() ** 2 / (h[left].sum() + c) + g[right].sum() ** 2 / (h[right].sum() + c) - total, 9)
                if gain > 1e-9 and (top is None or gain > top[0]):
                    top = (gain, j, t, left, right)
        return top

    leaves, splits = [(np.arange(len(y)), 0)], []
    if model.leaves:
        while len(leaves) < model.leaves:
            options = [(best(at), i) for i, (at, _) in enumerate(leaves)]
            options = [(o, i) for o, i in options if o]
            if not options:
                break
            o, i = max(options, key=lambda v: v[0][0])
            d = leaves[i][1]
            leaves[i : i + 1] = [(o[3], d + 1), (o[4], d + 1)]
            splits.append(o[1:3])
    else:
        done = []
        while leaves:
            at, d = leaves.pop(0)
            o = best(at) if d < model.depth else None
            if o is None:
                done.append((at, d))
            else:
                leaves += [(o[3], d + 1), (o[4], d + 1)]
                splits.append(o[1:3])
        leaves = done
    value = np.zeros(len(y))
    for at, _ in leaves:
        value[at] = -model.rate * g[at].sum() / (h[at].sum() + c)
    return value, splits


@pytest.mark.parametrize("model", [newton.Model(3, 0.3, depth=3), newton.Model(2, 0.5, -2, 2, 0, 0.5, 0.1, 5), newton.Model(3, 0.3, -2, 0, 6, 0.1, 1e-3, 4)])
def test_trees_equal_exhaustive_search(spark, model):
    df = toy(spark, 200, 3)
    rows = passes.model_rows(df, FEATS)
    fits, cuts = newton.fit_trees(rows.repartition(3), [model], rewrite=2)
    x, y = plain(df)
    f = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    codes = passes.codes_of(x, cuts[""])
    for tree in fits[""][0].trees:
        value, splits = slow_tree(x, y, f, model, cuts[""])
        got = sorted((j, float(cuts[""][j][b])) for j, b in zip(tree.feature, tree.bin, strict=True) if j >= 0)
        assert got == sorted((j, float(t)) for j, t in splits)
        assert np.allclose(np.array(tree.value)[tree.ends(codes)], value, atol=1e-9)
        f = f + value
    assert np.allclose(newton.margins(codes, fits[""][0], [model.rounds])[:, 0], f)
    assert np.allclose(newton.margins(codes, fits[""][0], [0])[:, 0], fits[""][0].start)


def test_trees_of_models_at_different_speeds(spark):
    """By level and by leaf, held out and not, all in one run: each as if alone."""
    rows = passes.model_rows(toy(spark, 300, 5), FEATS, fold=F.col("row_id") % 2)
    models = [newton.Model(4, 0.3, -2, 4), newton.Model(2, 0.1, 1, 0, 9, 0.0, 1e-3, 5), newton.Model(1, 0.3, 0, 2)]
    many, _ = newton.fit_trees(rows, models)
    for m, model in enumerate(models):
        one, _ = newton.fit_trees(rows, [model])
        assert [(t.feature, t.bin, t.rows) for t in one[""][0].trees] == [(t.feature, t.bin, t.rows) for t in many[""][m].trees]
        assert len(many[""][m].trees) == model.rounds


def test_network_gradient_against_finite_differences():
    rnd = np.random.default_rng(1)
    x, y, w = rnd.normal(size=(30, 3)), rnd.integers(0, 2, 30), rnd.integers(0, 3, 30).astype(float)
    theta = networks.start(3, networks.Model(5, 7))
    got = networks.loss_and_gradient(x, y, w, theta, 5)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        up, down = (networks.loss_and_gradient(x, y, w, theta + s, 5)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - got[1 + i]) < 1e-4


def test_bag_weights_are_counts_of_mean_one():
    u = np.random.default_rng(2).integers(0, 1 << 63, 20000).astype(np.uint64)
    a, b = networks.bag_weights(u, 0), networks.bag_weights(u, 1)
    assert abs(a.mean() - 1) < 0.03 and abs(a.var() - 1) < 0.06 and abs(np.corrcoef(a, b)[0, 1]) < 0.03
    assert (networks.bag_weights(u, 0) == a).all() and (networks.bag_weights(u, -1) == 1).all()


def test_networks_together_learn_what_a_line_cannot(spark):
    rnd = random.Random(4)
    pts = [(i, rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for i in range(600)]
    df = spark.createDataFrame([(i, a, b, int(a * b > 0)) for i, a, b in pts], "row_id long, a double, b double, y int")
    rows = passes.model_rows(df, ["a", "b"], fold=F.col("row_id") % 3)
    models = [networks.Model(20, s, s, h, steps=200) for s in range(2) for h in (-2, 0)]
    thetas = networks.fit_networks(rows, models)
    alone = networks.fit_networks(rows.repartition(5), [models[3]])
    x, y = np.array([p[1:] for p in pts]), np.array([int(a * b > 0) for _, a, b in pts])
    for m, model in enumerate(models):
        assert ((networks.logits(x, thetas[""][m], model.hidden) > 0) == y).mean() > 0.9
    f, g = (networks.logits(x, t, 20) for t in (alone[""][0], thetas[""][3]))
    assert ((f > 0) == (g > 0)).mean() > 0.97  # sums in another order may end a step earlier


def test_grouped_sigmoids_equal_single_ones(spark):
    rnd = random.Random(5)
    rows = [(g, s, int(rnd.random() < 1 / (1 + math.exp(-k * s + k)))) for g, k in (("p", 1.0), ("q", 2.5)) for s in (rnd.gauss(0, 1) for _ in range(300))]
    rows += [("one class", 0.3, 1), ("one class", 0.7, 1)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r.g: (r.a, r.b) for r in learn.platt_many(df, ["g"]).collect()}
    for g in ("p", "q"):
        assert np.allclose(got[g], learn.platt_fit(df.where(F.col("g") == g)), atol=1e-7)
    assert len(got) == 3


@pytest.mark.parametrize("trainer", [learn.train_adaboost, learn.train_gbt_grid, learn.train_bagged_mlp])
def test_family_run_equals_calibrating_alone(spark, trainer):
    """Fitted with another dataset and job in the same passes, a model scores as if calibrated alone."""
    params = {"n": 3, "epochs": 4, "hidden": 6} if trainer is learn.train_bagged_mlp else {"n": 4, "lr": 0.5}
    more = params | {"n": params["n"] + 1}
    # on a coarse grid the bins are the same with and without a fold
    coarse = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.round("a")))
    a, b = (toy(spark, n, s, g).withColumn("a", coarse) for n, s, g in ((180, 6, "a"), (120, 7, "b")))
    tf = learn.folded(a, "y", 3, 42)
    other = learn.folded(b, "y", 3, 42)
    rows = [passes.model_rows(t, FEATS, group="dataset", fold=F.col("fold")) for t in (tf, other)]
    test = passes.model_rows(a, FEATS, group="dataset").unionByName(passes.model_rows(b, FEATS, group="dataset"))
    long = learn.family_scores(learn.FAMILIES[trainer], rows[0].unionByName(rows[1]), test, [("it", params), ("more", more)], 3)
    got = {r.row_id: r.p for r in long.where("g = 'a' and model = 'it'").collect()}
    alone = learn.calibrate_sigmoid(trainer, tf.drop("fold"), FEATS, tf=tf, **params)
    want = {r.row_id: r.p for r in alone(a).select("row_id", "p").collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-6
    assert long.count() == 2 * (180 + 120)


def test_grouped_logits_equal_single_ones(spark):
    from scorelab.operators.paired import univariate_logit

    rnd = random.Random(8)
    rows = [(g, s, int(rnd.random() < 1 / (1 + math.exp(-k * s))), 1) for g, k in (("p", 0.5), ("q", 2.0)) for s in (rnd.gauss(0, 1) for _ in range(250))]
    rows += [("flat", 0.5, int(i % 2), 1) for i in range(10)]  # one score: the slope can't be told
    df = spark.createDataFrame(rows, "g string, reliability_score double, pred_default int, actual_default int")
    got = {r.g: r for r in univariate_logit(df, ["g"]).collect()}
    for g in ("p", "q"):
        s, y = (np.array([r[i] for r in rows if r[0] == g], float) for i in (1, 2))
        x, b = np.stack([np.ones_like(s), s], axis=1), np.zeros(2)
        for _ in range(40):
            p = 1 / (1 + np.exp(-x @ b))
            b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
        p = 1 / (1 + np.exp(-x @ b))
        ll, m = (y * np.log(p) + (1 - y) * np.log(1 - p)).sum(), y.mean()
        ll0 = len(y) * (m * math.log(m) + (1 - m) * math.log(1 - m))
        se = math.sqrt(np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)[1, 1])
        want = (b[1], math.erfc(math.sqrt(ll - ll0)), 1 - ll / ll0, math.erfc(abs(b[1] / se) / math.sqrt(2)))
        r = got[g]
        assert np.allclose((r.logit_coef, r.logit_pvalue, r.logit_pseudo_r2, r.logit_pvalue_wald), want, atol=1e-6)
    assert got["flat"].logit_coef == 0.0 and got["flat"].logit_pvalue_wald is None
    alone = univariate_logit(df.where("g = 'p'")).first()
    assert math.isclose(alone.logit_coef, got["p"].logit_coef, rel_tol=1e-9)


def auc(y, s):
    above = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
    return above.mean()


def test_grid_search_holds_each_fold_out(spark):
    df = toy(spark, 210, 9).withColumn("a", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.round("a"))))
    tf = learn.folded(df.select("row_id", "y", *FEATS), "y", 3, 42)
    x, y = plain(df)
    fold = np.array([r.fold for r in tf.orderBy("row_id").collect()])
    got = {(r.n, r.lr): r.cv_auc for r in learn.grid_search_ada(df, FEATS, ns=(2, 5), lrs=(0.3, 1.0), folds=3).collect()}
    for lr in (0.3, 1.0):
        for n in (2, 5):
            want = []
            for f in range(3):
                path = slow_stumps(x[fold != f], y[fold != f], np.ones((fold != f).sum()), n, lr)
                votes = sum(s[4] * (2 * np.where(x[fold == f][:, s[0]] <= s[1], s[2], s[3]) - 1) for s in path)
                want.append(auc(y[fold == f], np.round(votes, 9)))
            assert abs(got[n, lr] - np.mean(want)) < 0.02, (n, lr)  # votes that only rounding parts are ties here


def test_tune_knn_prepares_inside_the_folds(spark):
    df = toy(spark, 120, 10)
    got = {(r.k, r.weights, r.p_norm): r.cv_auc for r in learn.tune_knn(df, ["a", "b"], ks=(3, 5), weights=("uniform",), ps=(2,), folds=3, prepare=True).collect()}
    tf = learn.folded(df.select("row_id", "y", "a", "b"), "y", 3, 42).orderBy("row_id").collect()
    x, y, fold = np.array([[r.a, r.b] for r in tf]), np.array([r.y for r in tf]), np.array([r.fold for r in tf])
    for k in (3, 5):
        want = []
        for f in range(3):
            tr, te = x[fold != f], x[fold == f]
            tr, te = ((v - tr.mean(0)) / tr.std(0) for v in (tr, te))
            near = np.argsort(np.linalg.norm(te[:, None] - tr, axis=2), axis=1, kind="stable")[:, :k]
            want.append(auc(y[fold == f], y[fold != f][near].mean(1)))
        assert abs(got[k, "uniform", 2] - np.mean(want)) < 1e-6
    both = learn.tune_knn(df, ["a", "b"], ks=(3,), ps=(1,), folds=2, prepare=True, balance=True)
    assert both.count() == 2 and both.where("best").count() == 1


def test_forests_keep_node_ids_and_grow_the_same_trees(spark):
    from pyspark.ml.classification import RandomForestClassifier

    rnd = random.Random(8)
    rows = [(i, rnd.random(), rnd.randint(0, 9) / 3.0, rnd.randint(0, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y int").repartition(2, "row_id").checkpoint()
    for fit, params in ((learn.train_rf, {"trees": 4}), (learn.train_bagged_trees, {"n": 4})):
        model = fit(df, ["a", "b"], **params).model
        assert model.getCacheNodeIds()
        strategy = "sqrt" if fit is learn.train_rf else "all"
        plain = learn._fit(RandomForestClassifier(numTrees=4, featureSubsetStrategy=strategy, maxDepth=learn.FULL_DEPTH, seed=42), df, ["a", "b"], "y")
        body = lambda m: m.toDebugString.split("\n", 1)[1]
        assert body(model) == body(plain)


def test_routing_by_words_is_the_walk_down():
    """Trees with one leaf, some, and more than a word of them; cuts at both ends of the codes."""
    rnd = np.random.default_rng(3)
    codes = np.concatenate([rnd.integers(0, 256, (2000, 5)), [[0] * 5, [255] * 5]]).astype(np.uint8)
    for splits in (0, 1, 20, 63, 64, 150):
        tree, leaves = newton.Tree(), [0]
        for _ in range(splits):
            leaves += tree.grow(leaves.pop(int(rnd.integers(len(leaves)))), int(rnd.integers(5)), int(rnd.choice([0, 255, *rnd.integers(0, 256, 6)])))

        def walk(row, tree=tree):
            n = 0
            while tree.feature[n] >= 0:
                n = tree.left[n] if row[tree.feature[n]] <= tree.bin[n] else tree.right[n]
            return n

        assert newton.Router(tree).ends(newton.columns_of(codes)).tolist() == [walk(r) for r in codes.tolist()]


def test_stumps_change_weights_as_one_row_at_a_time():
    rnd = np.random.default_rng(4)
    y, codes, w = rnd.integers(0, 2, 300), rnd.integers(0, 6, (300, 3)).astype(np.uint8), rnd.random((300, 2))
    rounds = [[(boosting.Stump(0.3 * k, k % 3, k, k % 2, k // 2 % 2), 1.0 + k), (None, 1.0)] for k in range(5)]
    want = w.copy()
    for (s, scale), _ in rounds:
        for i in range(300):
            said = s.left if codes[i, s.feature] <= s.bin else s.right
            want[i, 0] *= np.exp(s.alpha) * scale if said != y[i] else scale
    got = np.ascontiguousarray(w.T)
    boosting._apply(rounds, y, np.ascontiguousarray(codes.T), got)
    assert np.allclose(got.T, want, rtol=1e-12)


def test_network_sums_in_chunks_are_those_of_all_rows(monkeypatch):
    """Against the chain rule unit by unit, however many rows are worked out at a time."""
    rnd = np.random.default_rng(6)
    x, y, weight, theta = rnd.normal(size=(70, 3)), rnd.integers(0, 2, 70), rnd.integers(0, 3, 70).astype(float), rnd.normal(size=3 * 4 + 4 + 4 + 1)
    w, b, v, c = networks._layers(theta, 3, 4)
    z = x @ w + b
    f = np.maximum(z, 0) @ v + c
    r = weight * (1 / (1 + np.exp(-f)) - y)
    back = np.where(z > 0, r[:, None] * v, 0.0)
    want = np.concatenate([[(weight * (np.logaddexp(0, f) - y * f)).sum()], (x.T @ back).ravel(), back.sum(0), np.maximum(z, 0).T @ r, [r.sum()]])
    for chunk in (1, 32, 70, 512):
        monkeypatch.setattr(networks, "_CHUNK", chunk)
        assert np.allclose(networks.loss_and_gradient(x, y, weight, theta, 4), want, atol=1e-10)


def test_packed_features_give_the_sums_of_each():
    """Groups of few-bin features (one with a single bin), none of a joint size beyond the limit."""
    rnd = np.random.default_rng(7)
    layout = passes.Layout([np.arange(n, dtype=float) for n in (255, 1, 0, 6, 1, 1, 40)])
    codes = np.stack([rnd.integers(0, b, 500) for b in layout.bins]).astype(np.uint8)
    y, logs = rnd.integers(0, 2, 500), rnd.normal(size=2 * layout.width)
    logs[2 * layout.starts[0] : 2 * (layout.starts[0] + 256)] = 0
    packing = boosting.Packing(layout)
    assert len(packing.groups) < len(layout.bins) and max(packing.sizes) <= 2 * packing.MOST
    cells = packing.cells(codes, y)
    w = boosting._weights(packing.joint(logs), 0.3, cells)
    at = 2 * (layout.starts[:, None] + codes) + y
    assert np.allclose(w, np.exp(0.3 + logs[at].sum(0)), rtol=1e-12)
    got = packing.apart([np.bincount(c, w, n) for c, n in zip(cells, packing.sizes, strict=True)])
    assert np.allclose(got, np.bincount(at.ravel(), np.tile(w, len(at)), 2 * layout.width), rtol=1e-12)


def test_logistic_families_equal_single_fits(spark):
    """All strengths, folds and datasets in the same passes score as Spark ML's fits of each alone."""
    a, b = toy(spark, 240, 6, "a"), toy(spark, 150, 7, "b")
    tfs = [learn.folded(t, "y", 3, 42) for t in (a, b)]
    rows = [passes.model_rows(t, FEATS, group="dataset", fold=F.col("fold")) for t in tfs]
    test = passes.model_rows(a, FEATS, group="dataset").unionByName(passes.model_rows(b, FEATS, group="dataset"))
    for trainer, jobs in ((learn.train_lr, {"plain": {"C": 1e6}}), (learn.train_lr_reg, {"l1": {"C": 0.5, "l1_ratio": 1.0}, "half": {}, "l2": {"l1_ratio": 0.0}})):
        long = learn.family_scores(learn.FAMILIES[trainer], rows[0].unionByName(rows[1]), test, list(jobs.items()), 3)
        got = {(r.model, r.row_id): r.p for r in long.where("g = 'a'").collect()}
        for name in ("plain", "half"):
            if name in jobs:
                alone = learn.calibrate_sigmoid(trainer, tfs[0].drop("fold"), FEATS, tf=tfs[0], **jobs[name])
                assert all(abs(got[name, r.row_id] - r.p) < 2e-3 for r in alone(a).select("row_id", "p").collect())
        assert len(got) == 240 * len(jobs)


def test_logistic_steps_reach_the_optimum(spark):
    """Where no coefficient can move without loss: the penalty's slope meets that of the rows."""
    from scorelab.operators import logistic

    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(300, 3)) * [1, 1, 0.1]
    y = (x[:, 0] - 0.5 * x[:, 1] + rnd.normal(size=300) > 0).astype(int)
    rows = spark.createDataFrame([("", i, int(y[i]), i % 3, x[i].tolist()) for i in range(300)], "g string, row_id long, y int, fold int, x array<double>")
    models = [logistic.Model(1e6), logistic.Model(0.05, 1.0), logistic.Model(0.2, 0.5, 1), logistic.Model(1.0, 0.0, 2)]
    for m, theta in zip(models, logistic.fit_logits(rows, models)[""], strict=True):
        use = np.arange(300) % 3 != m.held
        slope = x[use].T @ (1 / (1 + np.exp(-x[use] @ theta[:-1] - theta[-1])) - y[use]) + (1 - m.l1_ratio) / m.C * theta[:-1]
        lasso = m.l1_ratio / m.C
        for w, s in zip(theta[:-1], slope, strict=True):
            assert abs(s + lasso * np.sign(w)) < 1e-3 if w else abs(s) <= lasso + 1e-3
    one = logistic.fit_logits(rows.withColumn("y", F.lit(1)), models[:1])[""][0]
    assert not one[:-1].any() and one[-1] == logistic.MOST


def test_blocks_are_dealt_evenly(spark):
    """Rows that come in one part are passed over by every core, and none is lost."""
    cores, n = spark.sparkContext.defaultParallelism, 3 * 8192
    rows = spark.range(n).coalesce(1).select(F.lit("").alias("g"), (F.col("id") % 2).cast("int").alias("y"), F.lit(-1).alias("fold"), F.array(F.col("id").cast("double")).alias("x"))
    table = passes.blocks(rows, lambda g, x: x, lambda g, fold: np.zeros((len(fold), 0)), spread=True)
    assert table.rdd.getNumPartitions() == cores
    assert sorted(v for r in table.select("data").collect() for v in np.frombuffer(r.data)) == list(range(n))
    sizes = [len(part) for part in table.select("n").rdd.glom().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_gbt_grid_query_asks_for_every_point(monkeypatch):
    from scorelab.plans import q_learn

    asked = []
    monkeypatch.setattr(q_learn, "prepared", lambda spark, d: (None, None, FEATS))
    monkeypatch.setattr(q_learn, "_grid", lambda scores: scores)
    monkeypatch.setattr(learn, "grid_scores", lambda family, tr, te, feats, jobs: asked.extend(jobs))
    q_learn.q_train_gbt_grid(None, "")
    points = {(name.split("_")[0], p["n"], p["lr"], p.get("by_leaf", False)) for name, p in asked}
    assert points == {(g, n, lr, g == "lgbm") for g in ("xgb", "lgbm") for n in (100, 200, 300) for lr in (0.1, 0.3)}
    assert len({name for name, _ in asked}) == len(asked) == 12


@pytest.mark.parametrize("by_leaf", [False, True])
def test_trees_of_one_task_are_those_of_the_passes(spark, monkeypatch, by_leaf):
    df = toy(spark, 300, 4).unionByName(toy(spark, 200, 5, "b"))
    rows = passes.model_rows(learn.folded(df, "y", 2, 42), FEATS, group="dataset", fold=F.col("fold")).checkpoint()
    way = newton.BY_LEAF if by_leaf else newton.BY_LEVEL
    models = [newton.Model(4, 0.3, **way), newton.Model(3, 0.1, 1, **way)]
    got, _ = newton.fit_trees(rows, models)
    monkeypatch.setattr(newton, "ONE_TASK", 0)
    want, _ = newton.fit_trees(rows, models)
    assert got.keys() == want.keys() == {"a", "b"}
    for g in got:
        for one, passed in zip(got[g], want[g], strict=True):
            assert one.start == passed.start and len(one.trees) == len(passed.trees) > 0
            for s, t in zip(one.trees, passed.trees, strict=True):
                assert (s.feature, s.bin, s.left, s.right, s.rows) == (t.feature, t.bin, t.left, t.right, t.rows)
                assert np.allclose(s.value, t.value, atol=1e-9) and np.allclose(s.cover, t.cover, atol=1e-9)
