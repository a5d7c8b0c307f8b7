"""Model training and scoring on Spark ML; every trainer takes a table and returns a
fitted scorer, and every scorer writes rows of the long ``scores`` table.

A trainer is ``fit(train, features, y, seed) -> Scorer`` where a Scorer maps a DataFrame with the
feature columns to the same rows plus ``p`` (probability of class 1). Registries of named grid
points mirror the reference's model groups; ``run_experiment`` loops over datasets x models on
the driver (each fit is a distributed Spark ML job) and unions metric rows, recording a failing
model as a row with its error instead of stopping.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.operators import boosting, forest, logistic, networks, newton, passes, tree_shap
from scorelab.operators.explain import Scorer
from scorelab.plans.ranks import SMALL
from scorelab.session import cut_lineage, ensure_checkpoint_dir, written_once

Trainer = Callable[..., Scorer]

#: Deepest trees Spark grows: the nearest to trees without a limit.
FULL_DEPTH = 30


def _assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    filled = df
    for c in features:
        filled = filled.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(filled)


def ml_scorer(model, features: Sequence[str]) -> Scorer:
    """Scorer of a fitted Spark ML classifier: p = probability of class 1."""
    feats = list(features)

    def score(df: DataFrame) -> DataFrame:
        cols = df.columns
        t = model.transform(_assemble(df, feats, "_features").withColumnRenamed("_features", model.getFeaturesCol()))
        p = vector_to_array(F.col(model.getProbabilityCol())).getItem(1)
        return t.select(*[F.col(f"`{c}`") for c in cols], p.alias("p"))

    score.model = model  # type: ignore[attr-defined]
    score.features = feats  # type: ignore[attr-defined]
    return score


def _margin(scorer: Scorer) -> Scorer:
    """Mark a scorer whose probability is a sigmoid of a decision value: that value is calibrated."""
    scorer.margin = True  # type: ignore[attr-defined]
    return scorer


def decision(scorer: Scorer) -> Column:
    """What calibration is fitted on: the decision value (log-odds, up to a factor) of a model that
    has one, else the probability."""
    if not getattr(scorer, "margin", False):
        return F.col("p")
    q = F.least(F.lit(1 - 1e-15), F.greatest(F.lit(1e-15), F.col("p")))
    return F.log(q / (1 - q))


def _fit(est, train: DataFrame, features: Sequence[str], y: str, weight: str | None = None):
    t = _assemble(train, features).withColumn("label", F.col(y).cast("double"))
    est = est.setFeaturesCol("features").setLabelCol("label")
    if weight is not None:
        est = est.setWeightCol(weight)
    return est.fit(t)


# ---------------------------------------------------------------- linear models

def train_lr(train: DataFrame, features: Sequence[str], y: str = "y", C: float = 1e6, seed: int = 42) -> Scorer:
    """Logistic regression with penalty 1/(2 C) ||w||^2 on the summed loss: Spark's regParam on
    the mean loss is 1 / (C n). The reference's three solvers reach this same optimum."""
    n = train.count()
    est = LogisticRegression(regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=200)
    return _margin(ml_scorer(_fit(est, train, features, y), features))


def train_lr_reg(train: DataFrame, features: Sequence[str], y: str = "y", C: float = 1.0, l1_ratio: float = 0.5,
                 seed: int = 42) -> Scorer:
    """Elastic-net (0.5), L2 (0) or L1 (1) logistic regression at strength C."""
    n = train.count()
    est = LogisticRegression(regParam=1.0 / (C * max(n, 1)), elasticNetParam=float(l1_ratio), standardization=False,
                             maxIter=200)
    return _margin(ml_scorer(_fit(est, train, features, y), features))


# ---------------------------------------------------------------- trees and ensembles

def _with_trees(scorer: Scorer, kind: str) -> Scorer:
    """A scorer that can tell its trees: a forest's add up to p, boosted ones to the log odds."""
    def trees():
        nodes, weights = tree_shap.saved_nodes(scorer.model, kind)  # type: ignore[attr-defined]
        return tree_shap.trees_of(nodes, 0.0, [1.0 / len(nodes) if kind == "forest" else 2.0 * w for w in weights])
    scorer.trees = trees  # type: ignore[attr-defined]
    return scorer


#: Rows beyond which a forest's trees are grown by a task each.
LARGE = 20_000


def fit_forest(train: DataFrame, features: Sequence[str], y: str = "y", **params):
    """A fitted forest: Spark ML's up to ``LARGE`` rows, else that of ``forest.fit``, the same but for the draws, whose trees
    grow by a task each and not by passes. (Spark ML's too where the rows' cells are too many for a task, or the
    classes are not 0 and 1.)

    In Spark ML's each row keeps the node it is at in every tree, so a pass over the rows need not
    carry all trees grown so far to every task; these numbers are checkpointed now and then. The trees are the same."""
    ensure_checkpoint_dir(train.sparkSession)
    label = F.col(y).cast("double")
    n, ones, zeros = train.agg(F.count(F.lit(1)), F.count(F.when(label == 1, 1)), F.count(F.when(label == 0, 1))).first()
    if n > LARGE and min(ones, zeros) > 0 and ones + zeros == n and params.get("numTrees", 20) > 1:
        grown = forest.fit(train, features, y, params.get("numTrees", 20), params.get("featureSubsetStrategy", "auto"), params["maxDepth"], params["seed"])
        if grown is not None:
            return grown
    return _fit(RandomForestClassifier(cacheNodeIds=True, **params), train, features, y)


def forest_scorer(model, features: Sequence[str]) -> Scorer:
    """Scorer of what ``fit_forest`` gives."""
    if not isinstance(model, forest.Forest):
        return _with_trees(ml_scorer(model, features), "forest")

    def score(df: DataFrame) -> DataFrame:
        return forest.scored(model, df)

    def trees():
        nodes = [tree_shap.forest_nodes(t, model.cuts) for t in model.tables()]
        return tree_shap.trees_of(nodes, 0.0, [1.0 / len(nodes)] * len(nodes))

    score.model, score.features, score.trees = model, list(features), trees  # type: ignore[attr-defined]
    return score


def train_rf(train: DataFrame, features: Sequence[str], y: str = "y", trees: int = 100, max_features="sqrt",
             seed: int = 42, max_depth: int = FULL_DEPTH) -> Scorer:
    """Random forest; trees grow to ``max_depth`` (by default the largest Spark allows)."""
    strategy = max_features if isinstance(max_features, str) else ("all" if float(max_features) >= 1 else str(max_features))
    model = fit_forest(train, features, y, numTrees=int(trees), featureSubsetStrategy=strategy, maxDepth=max_depth, seed=seed)
    return forest_scorer(model, features)


def train_bagged_trees(train: DataFrame, features: Sequence[str], y: str = "y", n: int = 10, seed: int = 42,
                       max_depth: int = FULL_DEPTH) -> Scorer:
    """Bagged CART: a forest that looks at every feature at every split (bootstrap rows only);
    trees grow to ``max_depth`` (by default the largest Spark allows)."""
    model = fit_forest(train, features, y, numTrees=int(n), featureSubsetStrategy="all", maxDepth=max_depth, seed=seed,
                       bootstrap=True, subsamplingRate=1.0)
    return forest_scorer(model, features)


def train_sgb(train: DataFrame, features: Sequence[str], y: str = "y", n: int = 10, subsample: float = 0.7,
              seed: int = 42, max_depth: int = 3) -> Scorer:
    """Stochastic gradient boosting: ``n`` trees of depth ``max_depth`` on row samples."""
    est = GBTClassifier(maxIter=int(n), subsamplingRate=subsample, stepSize=0.1, maxDepth=max_depth, seed=seed)
    return _with_trees(_margin(ml_scorer(_fit(est, train, features, y), features)), "boost")


def train_gbt_grid(train: DataFrame, features: Sequence[str], y: str = "y", n: int = 100, lr: float = 0.1,
                   seed: int = 42, by_leaf: bool = False) -> Scorer:
    """Second-order boosted trees: grown by level to depth 6 with a penalty of 1, or ``by_leaf`` to 31
    leaves of at least 20 rows. Nothing is drawn, so ``seed`` is not used."""
    return family_scorer(newton_family, train, features, y, {"n": n, "lr": lr, "by_leaf": by_leaf})


def train_mlp(train: DataFrame, features: Sequence[str], y: str = "y", hidden: Sequence[int] = (64, 32),
              epochs: int = 50, seed: int = 42) -> Scorer:
    est = MultilayerPerceptronClassifier(layers=[len(features), *hidden, 2], maxIter=epochs, seed=seed)
    return ml_scorer(_fit(est, train, features, y), features)


def _average(scorers: Sequence[Scorer]) -> Scorer:
    """Mean probability of several scorers, one output column each on the same rows: no join."""
    def score(df: DataFrame) -> DataFrame:
        t = df
        for i, s in enumerate(scorers):
            t = s(t).withColumnRenamed("p", f"_p{i}")
        mean = reduce(lambda a, b: a + b, [F.col(f"_p{i}") for i in range(len(scorers))]) / float(len(scorers))
        return t.select(*[F.col(f"`{c}`") for c in df.columns], mean.alias("p"))
    return score


# ---------------------------------------------------------------- families fitted in one pass

#: (rows, jobs, holds) -> evaluate: the log odds of every (job, hold), jobs first. ``rows`` is the form of
#: ``passes.model_rows``, a job is (name, params), a hold the fold that a model must not see.
Family = Callable[[DataFrame, Sequence[tuple[str, dict]], Sequence[int]], passes.Evaluate]


def stump_family(rows: DataFrame, jobs: Sequence[tuple[str, dict]], holds: Sequence[int]) -> passes.Evaluate:
    """SAMME with stumps: one long fit a rate and hold, every smaller n is a prefix of it."""
    specs = [(float(p.get("lr", 1.0)), h) for _, p in jobs for h in holds]
    ns = [int(p.get("n", 10)) for _, p in jobs for _ in holds]
    fits = sorted(set(specs))
    models = [boosting.Model(max(n for n, s in zip(ns, specs, strict=True) if s == f), *f) for f in fits]
    paths, cuts = boosting.fit_stumps(rows, models)
    return boosting.evaluator(paths, cuts, [(fits.index(s), n) for s, n in zip(specs, ns, strict=True)])


def newton_family(rows: DataFrame, jobs: Sequence[tuple[str, dict]], holds: Sequence[int]) -> passes.Evaluate:
    """Second-order trees: one long fit a rate, way of growing and hold."""
    specs = [(float(p.get("lr", 0.1)), bool(p.get("by_leaf", False)), h) for _, p in jobs for h in holds]
    ns = [int(p.get("n", 100)) for _, p in jobs for _ in holds]
    fits = sorted(set(specs))
    models = [newton.Model(max(n for n, s in zip(ns, specs, strict=True) if s == (lr, leaf, h)), lr, h, **(newton.BY_LEAF if leaf else newton.BY_LEVEL)) for lr, leaf, h in fits]
    grown, cuts = newton.fit_trees(rows, models)
    return newton.evaluator(grown, cuts, [(fits.index(s), n) for s, n in zip(specs, ns, strict=True)])


def network_family(rows: DataFrame, jobs: Sequence[tuple[str, dict]], holds: Sequence[int]) -> passes.Evaluate:
    """Bags of networks: a smaller number of bags is the first ones of a larger."""
    most = max(int(p.get("n", 5)) for _, p in jobs)
    seed, hidden, steps = jobs[0][1].get("seed", 42), jobs[0][1].get("hidden", 100), jobs[0][1].get("epochs", 1000)
    models = [networks.Model(hidden, seed + b, b, h, steps=steps) for h in holds for b in range(most)]
    thetas = networks.fit_networks(rows, models, seed)
    return networks.evaluator(thetas, models, [[k * most + b for b in range(int(p.get("n", 5)))] for _, p in jobs for k in range(len(holds))])


def _logits(rows: DataFrame, jobs: Sequence[tuple[str, dict]], holds: Sequence[int], C: float, l1_ratio: float) -> passes.Evaluate:
    specs = [logistic.Model(float(p.get("C", C)), float(p.get("l1_ratio", l1_ratio)), h) for _, p in jobs for h in holds]
    fits = sorted(set(specs))
    return logistic.evaluator(logistic.fit_logits(rows, fits), [fits.index(s) for s in specs])


def lr_family(rows: DataFrame, jobs: Sequence[tuple[str, dict]], holds: Sequence[int]) -> passes.Evaluate:
    """What ``train_lr`` fits: one fit a strength and hold."""
    return _logits(rows, jobs, holds, 1e6, 0.0)


def lr_reg_family(rows: DataFrame, jobs: Sequence[tuple[str, dict]], holds: Sequence[int]) -> passes.Evaluate:
    """What ``train_lr_reg`` fits: one fit a strength, L1 share and hold."""
    return _logits(rows, jobs, holds, 1.0, 0.5)


def family_scorer(family: Family, train: DataFrame, features: Sequence[str], y: str, params: dict) -> Scorer:
    """Scorer of one model of a family."""
    feats = list(features)
    rows = cut_lineage(passes.model_rows(train, feats, y))
    if rows.isEmpty():
        raise ValueError("no rows to fit")
    evaluate = family(rows, [("", params)], [-2])
    values = passes.value_column(evaluate, [-2])

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("p", 1.0 / (1.0 + F.exp(-values(F.lit(""), passes.vector(feats), F.lit(-1)).getItem(0))))
    if family is newton_family:
        m, n = evaluate.points[0]  # type: ignore[attr-defined]
        fit, cuts = evaluate.fits[""][m], evaluate.cuts[""]  # type: ignore[attr-defined]
        score.trees = lambda: tree_shap.trees_of([tree_shap.newton_nodes(t, cuts) for t in fit.trees[:n]], fit.start)  # type: ignore[attr-defined]
    return _margin(score)


def family_scores(family: Family, train: DataFrame, test: DataFrame, jobs: Sequence[tuple[str, dict]], folds: int = 0) -> DataFrame:
    """The ``test`` rows (without fold and x) with model and p, a row a job. ``train`` and ``test`` as from
    ``passes.model_rows``. With ``folds`` the train rows' fold column cuts them; each job is fitted without each
    fold, calibrated by a sigmoid on that fold, and the calibrated probabilities are averaged."""
    holds = list(range(folds)) or [-2]
    evaluate, per = family(train, jobs, holds), [h for _ in jobs for h in holds]
    kept = [c for c in test.columns if c not in ("fold", "x")]
    value = passes.value_column(evaluate, per)
    scored = test.withColumn("_v", value("g", "x", "fold"))
    if folds:
        own = passes.value_column(evaluate, per, own_fold=True)
        left = train.select("g", "y", F.posexplode(own("g", "x", "fold")).alias("point", "s")).where("s is not null")
        fitted = platt_many(cut_lineage(left), ["g", "point"])
        lines = fitted.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("point", "a", "b"))).alias("_lines"))  # one a point
        calibrated = F.transform("_v", lambda s, i: 1.0 / (1.0 + F.exp(F.col("_lines")[i]["a"] * s + F.col("_lines")[i]["b"])))
        total = lambda j: F.aggregate(F.slice("_c", j * folds + 1, folds), F.lit(0.0), lambda a, c: a + c)
        p = F.transform(F.sequence(F.lit(0), F.lit(len(jobs) - 1)), lambda j: total(j) / folds)
        scored = scored.join(lines, "g").withColumn("_c", calibrated)
    else:
        p = F.transform("_v", lambda v: 1.0 / (1.0 + F.exp(-v)))
    names = F.array(*[F.lit(n) for n, _ in jobs])
    return scored.select(*kept, F.posexplode(p).alias("_point", "p")).select(*kept, F.element_at(names, F.col("_point") + 1).alias("model"), "p")


def train_bagged_mlp(train: DataFrame, features: Sequence[str], y: str = "y", n: int = 5, seed: int = 42,
                     hidden: int = 100, epochs: int = 1000) -> Scorer:
    """n networks with one layer of ``hidden``, each on a bag of the rows (counts from the rows' hashes),
    probabilities averaged. A tenth of the rows is put aside; a network stops by itself when these get
    no better, after ``epochs`` steps at most. All bags are trained in the same passes."""
    return family_scorer(network_family, train, features, y, {"n": n, "seed": seed, "hidden": hidden, "epochs": epochs})


def train_adaboost(train: DataFrame, features: Sequence[str], y: str = "y", n: int = 10, lr: float = 1.0,
                   seed: int = 42) -> Scorer:
    """SAMME with n stumps; p = sigmoid(2 sum alpha h / sum alpha). Nothing is drawn, so ``seed`` is not used."""
    return family_scorer(stump_family, train, features, y, {"n": n, "lr": lr})


def grid_scores(family: Family, train: DataFrame, test: DataFrame, features: Sequence[str], jobs: Sequence[tuple[str, dict]], y: str = "y") -> DataFrame:
    """(dataset, model, row_id, y, p): every job of a family fitted on all of ``train`` and scored on ``test``."""
    rows = cut_lineage(passes.model_rows(train, features, y))
    return family_scores(family, rows, passes.model_rows(test, features, y, keep=("dataset", "row_id")), jobs).drop("g")


def boost_grid(ns: Sequence[int], lrs: Sequence[float]) -> list[tuple[str, dict]]:
    return [(f"boost_dt_{n}x{lr}".replace(".", "p"), {"n": n, "lr": lr}) for n in ns for lr in lrs]


def train_boost_grid(train: DataFrame, test: DataFrame, features: Sequence[str], y: str = "y",
                     ns: Sequence[int] = (10, 50, 100, 250, 500, 1000), lrs: Sequence[float] = (0.1, 0.5, 1.0)) -> DataFrame:
    """Scores of every point of the grid: one fit a rate, all rates in the same passes, and one pass over
    ``test`` for all points."""
    return grid_scores(stump_family, train, test, features, boost_grid(ns, lrs), y)


# ---------------------------------------------------------------- nearest neighbours

def train_knn(train: DataFrame, features: Sequence[str], y: str = "y", k: int = 5, weights: str = "uniform",
              p: int = 2, seed: int = 42) -> Scorer:
    """p = share of class 1 among the k nearest train rows (exact; inverse-distance weights with
    'distance'); neighbours by the pivot-partitioned ``knn_join``."""
    from scorelab.operators.neighbours import knn_join

    feats = list(features)
    ref = train.select("row_id", y, *feats)

    def score(df: DataFrame) -> DataFrame:
        q = df.select("row_id", *feats)
        nn = knn_join(q, ref, feats, k, p, seed=seed)
        lab = ref.select(F.col("row_id").alias("r_id"), F.col(y).cast("double").alias("_y"))
        j = nn.join(lab, "r_id")
        if weights == "distance":
            w = F.when(F.col("dist") == 0, F.lit(1e12)).otherwise(1.0 / F.col("dist"))
        else:
            w = F.lit(1.0)
        agg = j.groupBy("q_id").agg((F.sum(w * F.col("_y")) / F.sum(w)).alias("p"))
        return df.join(agg.withColumnRenamed("q_id", "row_id"), "row_id", "left")
    return score


# ---------------------------------------------------------------- calibration

def platt_fit(scores: DataFrame, s: str = "s", y: str = "y", iters: int = 50) -> tuple[float, float]:
    """Platt scaling: logistic fit of y on s with targets (N+ + 1)/(N+ + 2) and 1/(N- + 2).
    Newton steps are Spark aggregates; only the 2-parameter update runs on the driver."""
    cnt = scores.agg(F.sum(F.col(y)).alias("np"), F.count(F.lit(1)).alias("n")).first()
    n_pos, n = cnt["np"] or 0, cnt["n"]
    n_neg = n - n_pos
    hi, lo = (n_pos + 1.0) / (n_pos + 2.0), 1.0 / (n_neg + 2.0)
    t = F.when(F.col(y) == 1, F.lit(hi)).otherwise(F.lit(lo))
    a, b = 0.0, math.log((n_neg + 1.0) / (n_pos + 1.0))
    for _ in range(iters):
        f = F.lit(a) * F.col(s) + F.lit(b)
        pr = 1.0 / (1.0 + F.exp(f))  # P(y=1) = 1 / (1 + exp(a s + b))
        gdiff = t - pr
        w = pr * (1 - pr)
        r = scores.agg(F.sum(gdiff * F.col(s)).alias("ga"), F.sum(gdiff).alias("gb"),
                       F.sum(w * F.col(s) * F.col(s)).alias("haa"), F.sum(w * F.col(s)).alias("hab"),
                       F.sum(w).alias("hbb")).first()
        haa, hab, hbb = (r["haa"] or 0.0) + 1e-12, r["hab"] or 0.0, (r["hbb"] or 0.0) + 1e-12
        det = haa * hbb - hab * hab
        if det == 0:
            break
        da = (hbb * r["ga"] - hab * r["gb"]) / det
        db = (haa * r["gb"] - hab * r["ga"]) / det
        a, b = a - da, b - db
        if abs(da) < 1e-10 and abs(db) < 1e-10:
            break
    return a, b


def platt_many(scores: DataFrame, keys: Sequence[str], s: str = "s", y: str = "y", iters: int = 50) -> DataFrame:
    """(keys, a, b): the fit of ``platt_fit`` for every group of ``scores``, all groups in the same steps. The
    state is a table of one row a group; a step is one aggregate over the rows of the groups that still move."""
    keys = list(keys)
    counts = scores.groupBy(*keys).agg(F.sum(F.col(y).cast("double")).alias("np"), F.count(F.lit(1)).alias("n"))
    first = counts.select(*keys, ((F.col("np") + 1) / (F.col("np") + 2)).alias("hi"), (1 / (F.col("n") - F.col("np") + 2)).alias("lo"),
                          F.lit(0.0).alias("a"), F.log((F.col("n") - F.col("np") + 1) / (F.col("np") + 1)).alias("b"))
    state = cut_lineage(first.withColumn("moving", F.lit(True)))
    side = F.broadcast if state.count() <= SMALL else (lambda df: df)  # else every step would deal all rows
    for _ in range(iters):
        if state.where("moving").isEmpty():
            break
        at = F.col(s)
        pr = 1.0 / (1.0 + F.exp(F.col("a") * at + F.col("b")))
        diff, w = F.when(F.col(y) == 1, F.col("hi")).otherwise(F.col("lo")) - pr, pr * (1 - pr)
        sums = scores.join(side(state.where("moving")), keys).groupBy(*keys).agg(
            F.sum(diff * at).alias("ga"), F.sum(diff).alias("gb"), (F.sum(w * at * at) + 1e-12).alias("haa"),
            F.sum(w * at).alias("hab"), (F.sum(w) + 1e-12).alias("hbb"))
        det = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
        da = F.when(det == 0, 0.0).otherwise((F.col("hbb") * F.col("ga") - F.col("hab") * F.col("gb")) / F.when(det != 0, det))
        db = F.when(det == 0, 0.0).otherwise((F.col("haa") * F.col("gb") - F.col("hab") * F.col("ga")) / F.when(det != 0, det))
        steps = sums.select(*keys, da.alias("da"), db.alias("db"))
        moved = state.join(side(steps), keys, "left").na.fill(0.0, ["da", "db"])
        state = cut_lineage(moved.select(*keys, "hi", "lo", (F.col("a") - F.col("da")).alias("a"), (F.col("b") - F.col("db")).alias("b"),
                                         ((F.abs("da") >= 1e-10) | (F.abs("db") >= 1e-10)).alias("moving")))
    return state.select(*keys, "a", "b")


def folded(train: DataFrame, y: str, folds: int, seed: int) -> DataFrame:
    """``train`` with its calibration folds, written once for all models that read them."""
    from scorelab.operators.resample import stratified_kfold

    return cut_lineage(stratified_kfold(train, y, folds, seed))


def calibrate_sigmoid(trainer: Trainer, train: DataFrame, features: Sequence[str], y: str = "y", folds: int = 3,
                      seed: int = 42, tf: DataFrame | None = None, **kw) -> Scorer:
    """3 folds: the base model fits on 2/3, Platt scaling on the held-out third, on the decision
    value where the model has one; the calibrated probability is the mean of the 3 calibrated
    models. ``tf``: the train rows with their folds, where they are written already. The folds' sigmoids are
    fitted together."""
    tf = folded(train, y, folds, seed) if tf is None else tf
    bases, held = [], []
    for f in range(folds):
        base = trainer(tf.where(F.col("fold") != f).drop("fold"), features, y, seed=seed, **kw)
        bases.append(base)
        held.append(base(tf.where(F.col("fold") == f)).select("fold", decision(base).alias("s"), F.col(y).alias("y")))
    lines = {r["fold"]: (r["a"], r["b"]) for r in platt_many(cut_lineage(reduce(DataFrame.unionByName, held)), ["fold"]).collect()}

    def score(df: DataFrame) -> DataFrame:
        cal = []
        for f, base in enumerate(bases):
            def one(d, base=base, line=lines.get(f, (0.0, 0.0))):
                return base(d).withColumn("p", 1.0 / (1.0 + F.exp(F.lit(line[0]) * decision(base) + F.lit(line[1]))))
            cal.append(one)
        return _average(cal)(df)
    return score


def balanced(train: DataFrame, features: Sequence[str], y: str = "y", seed: int = 42) -> DataFrame:
    """The train rows topped up by SMOTE (5 neighbours), written once; so are the rows it starts from, which the
    neighbours, the draws and their features are all read from."""
    from scorelab.operators.resample import smote

    rows = written_once(train.select("row_id", y, *features))
    return cut_lineage(smote(rows, features, y, 5, seed).drop("synthetic"))


def balance_then_train(trainer: Trainer, train: DataFrame, features: Sequence[str], y: str = "y", seed: int = 42,
                       **kw) -> Scorer:
    """SMOTE on the train rows only, then fit."""
    return trainer(balanced(train, features, y, seed), features, y, seed=seed, **kw)


def score_rows(scorer: Scorer, df: DataFrame, threshold: float = 0.5, keep: Sequence[str] = ("dataset",),
               y: str = "y") -> DataFrame:
    """row_id, y, p, pred (p >= threshold)."""
    s = scorer(df)
    k = [c for c in keep if c in s.columns]
    return s.select(*k, "row_id", y, "p", (F.col("p") >= threshold).cast("int").alias("pred"))


# ---------------------------------------------------------------- resampling-based evaluation

def cross_val(trainer: Trainer, train: DataFrame, features: Sequence[str], y: str = "y", k: int = 5, seed: int = 42,
              **kw) -> DataFrame:
    """fold, accuracy (p >= 0.5) of k stratified folds, plus the mean as fold -1."""
    from scorelab.operators.resample import stratified_kfold

    spark = train.sparkSession
    tf = written_once(stratified_kfold(train, y, k, seed))  # every fold reads it several times
    rows = []
    for f in range(k):
        sc = trainer(tf.where(F.col("fold") != f).drop("fold"), features, y, seed=seed, **kw)
        acc = sc(tf.where(F.col("fold") == f)).agg(
            F.avg(((F.col("p") >= 0.5).cast("int") == F.col(y)).cast("double")).alias("a")).first()["a"]
        rows.append((f, float(acc)))
    rows.append((-1, sum(a for _, a in rows) / k))
    return spark.createDataFrame(rows, "fold int, accuracy double")


def _cv_auc(scored_by_setting: DataFrame, group: Sequence[str]) -> DataFrame:
    from scorelab.operators.metrics import metric_auc

    return metric_auc(scored_by_setting, list(group)).groupBy(*[g for g in group if g != "fold"]).agg(
        F.avg("AUC").alias("cv_auc"))


def tune_knn(train: DataFrame, features: Sequence[str], y: str = "y", ks: Sequence[int] = (3, 5, 7, 11, 15, 21),
             weights: Sequence[str] = ("uniform", "distance"), ps: Sequence[int] = (1, 2), folds: int = 5,
             seed: int = 42, prepare: bool = False, balance: bool = False) -> DataFrame:
    """5-fold AUC of every (k, weights, p): one neighbour table at max(k) per (fold, p); every
    smaller k and both weightings are aggregations of it. Best setting flagged. With ``prepare`` the
    preprocessing is learned on each fold's own train rows, with ``balance`` these are then topped up by
    SMOTE, so nothing of a held-out row is seen before it is scored."""
    from scorelab.operators.neighbours import knn_join
    from scorelab.operators.prep import fit_preprocessor

    tf = folded(train.select("row_id", y, *features), y, folds, seed)
    kmax = max(ks)
    parts = []
    for f in range(folds):
        feats = list(features)
        tr = tf.where(F.col("fold") != f).drop("fold")
        te = tf.where(F.col("fold") == f).drop("fold")
        if prepare:
            pre = fit_preprocessor(tr, y, keep=("row_id",))
            feats, tr, te = pre.feature_names(), pre.transform(tr), pre.transform(te)
        if balance:
            tr = balanced(tr, feats, y, seed)
        tr = cut_lineage(tr)
        lab = tr.select(F.col("row_id").alias("r_id"), F.col(y).cast("double").alias("_y"))
        truth = te.select(F.col("row_id").alias("q_id"), F.col(y).alias("y"))
        for p in ps:
            # one exact neighbour table at max(k), written once; every k and weighting derives from it
            nn = cut_lineage(knn_join(te, tr, feats, kmax, p, seed=seed).join(lab, "r_id"))
            wd = F.when(F.col("dist") == 0, F.lit(1e12)).otherwise(1.0 / F.col("dist"))
            per_k = nn.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where(
                F.col("nn_rank") <= F.col("k"))
            agg = per_k.groupBy("q_id", "k").agg(
                F.avg("_y").alias("uniform"), (F.sum(wd * F.col("_y")) / F.sum(wd)).alias("distance"))
            long = agg.unpivot(["q_id", "k"], [w for w in ("uniform", "distance") if w in weights], "weights", "p")
            parts.append(long.join(truth, "q_id").select(F.lit(f).alias("fold"), "k", "weights",
                                                         F.lit(p).alias("p_norm"), "y", "p"))
    allp = reduce(lambda a, b: a.unionByName(b), parts)
    res = _cv_auc(allp, ["fold", "k", "weights", "p_norm"])
    best = res.orderBy(F.col("cv_auc").desc(), "k", "weights", "p_norm").limit(1).withColumn("best", F.lit(True))
    return res.join(best.select("k", "weights", "p_norm", "best"), ["k", "weights", "p_norm"], "left").withColumn(
        "best", F.coalesce("best", F.lit(False)))


def grid_search_ada(train: DataFrame, features: Sequence[str], y: str = "y", ns: Sequence[int] = (50, 100, 200),
                    lrs: Sequence[float] = (0.01, 0.1, 1.0), folds: int = 5, seed: int = 42) -> DataFrame:
    """5-fold AUC of every (n, rate): one long SAMME fit a (fold, rate), all of them in the same passes, and
    one pass for the held-out scores of every n."""
    from scorelab.operators.resample import stratified_kfold

    feats = list(features)
    tf = stratified_kfold(train.select("row_id", y, *feats), y, folds, seed)
    rows = cut_lineage(passes.model_rows(tf, feats, y, fold=F.col("fold")))
    jobs, holds = [("", {"n": n, "lr": lr}) for n in ns for lr in lrs], list(range(folds))
    value = passes.value_column(stump_family(rows, jobs, holds), [h for _ in jobs for h in holds], own_fold=True)
    job = lambda k, t: F.element_at(F.array(*[F.lit(p[k]).cast(t) for _, p in jobs]), F.floor(F.col("point") / folds).cast("int") + 1).alias(k)
    scored = rows.select("fold", "y", F.posexplode(value("g", "x", "fold")).alias("point", "v")).where("v is not null")
    return _cv_auc(scored.select("fold", job("n", "int"), job("lr", "double"), "y", (1.0 / (1.0 + F.exp(-F.col("v")))).alias("p")), ["fold", "n", "lr"])


# ---------------------------------------------------------------- registry and the experiment runner

def train_knn_tuned(train: DataFrame, features: Sequence[str], y: str = "y", seed: int = 42) -> Scorer:
    """The nearest-neighbour model of the best cross-validated (k, weights, p)."""
    best = tune_knn(train, features, y, seed=seed).where("best").first()
    return train_knn(train, features, y, k=best["k"], weights=best["weights"], p=best["p_norm"], seed=seed)


# Names and points of the model groups.
LR_SOLVERS = ("lbfgs", "saga", "newton_cg")
LR_REG = {"lr_reg_saga": 0.5, "lr_reg_lbfgs": 0.0, "lr_reg_liblinear": 1.0}  # name -> L1 share
ADABOOST_N = (10, 20, 30)
BAG_CART_N = (10, 20, 50, 100, 250, 500, 1000)
BAGNN_N = (5, 10, 25, 100)
BOOST_N, BOOST_RATES = (10, 50, 100, 250, 500, 1000), (0.1, 0.5, 1.0)
RF_TREES, RF_SHARES = (100, 250, 500, 750, 1000), ("sqrt", 0.1, 0.25, 0.5, 1.0)
SGB_N = (10, 20, 50, 100, 250, 500, 1000)
KNN_K = (3, 5, 7, 11)
XGB_N, XGB_RATES = (100, 200, 300), (0.1, 0.3)
GROUPS = ("lr", "lr_reg", "adaboost", "Bag-CART", "BagNN", "Boost-DT", "RF", "SGB", "KNN", "XGB", "LGBM", "DL")


def default_registry(groups: Sequence[str] = GROUPS) -> dict[str, dict[str, tuple[Trainer, dict]]]:
    """Model groups -> {model name: (trainer, params)}. XGB and LGBM points run on second-order trees grown by
    level and by leaf; DL has the perceptron alone (its other two need a library that is not there)."""
    point = lambda x: str(x).replace(".", "p")
    every: dict[str, dict[str, tuple[Trainer, dict]]] = {
        "lr": {f"lr_{s}": (train_lr, {"C": 1e6}) for s in LR_SOLVERS},
        "lr_reg": {name: (train_lr_reg, {"C": 1.0, "l1_ratio": r}) for name, r in LR_REG.items()},
        "adaboost": {f"adaboost_{n}": (train_adaboost, {"n": n}) for n in ADABOOST_N},
        "Bag-CART": {f"bag_cart_{n}": (train_bagged_trees, {"n": n}) for n in BAG_CART_N},
        "BagNN": {f"bagnn_{n}": (train_bagged_mlp, {"n": n}) for n in BAGNN_N},
        "Boost-DT": {f"boost_dt_{n}x{point(r)}": (train_adaboost, {"n": n, "lr": r}) for n in BOOST_N for r in BOOST_RATES},
        "RF": {f"rf_{n}_mf_{point(mf)}": (train_rf, {"trees": n, "max_features": mf}) for n in RF_TREES for mf in RF_SHARES},
        "SGB": {f"sgb_{n}": (train_sgb, {"n": n}) for n in SGB_N},
        "KNN": {f"knn_{k}": (train_knn, {"k": k}) for k in KNN_K} | {"knn_tuned": (train_knn_tuned, {})},
        "XGB": {f"xgb_{n}x{point(r)}": (train_gbt_grid, {"n": n, "lr": r}) for n in XGB_N for r in XGB_RATES},
        "LGBM": {f"lgbm_{n}x{point(r)}": (train_gbt_grid, {"n": n, "lr": r, "by_leaf": True}) for n in XGB_N for r in XGB_RATES},
        "DL": {"torch_mlp": (train_mlp, {})},
    }
    return {g: every[g] for g in groups}


#: Groups whose models are not calibrated in a run.
UNCALIBRATED = ("DL",)


def gbt_grid() -> list[tuple[str, dict]]:
    """The points of the two groups of second-order trees, by level and by leaf."""
    return [(name, params) for models in default_registry(("XGB", "LGBM")).values() for name, (_, params) in models.items()]


#: Trainers whose models, of all datasets, folds and grid points, are fitted in the same passes.
FAMILIES: dict[Trainer, Family] = {
    train_adaboost: stump_family, train_gbt_grid: newton_family, train_bagged_mlp: network_family, train_lr: lr_family, train_lr_reg: lr_reg_family,
}

#: Families that a dataset takes part in only if its folds allow it, else its models are fitted one by one.
LOGISTIC = (train_lr, train_lr_reg)


def _alone(tf: DataFrame, features: Sequence[str], y: str, folds: int = 3) -> bool:
    """Whether a dataset's logistic models are left to Spark ML: too many features, or rows of one class without some fold."""
    if len(features) > logistic.WIDEST:
        return True
    seen = {(r["fold"], r["y"]) for r in tf.groupBy("fold", F.col(y).cast("int").alias("y")).agg(F.count("*")).collect()}
    return any({v for f, v in seen if f != hold} != {0, 1} for hold in range(folds))


def run_experiment(datasets: DataFrame, registry: dict, y: str = "y", test_size: float = 0.2, seed: int = 42,
                   balance: bool = False, calibrate: bool = True, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """datasets x groups x models -> (metrics wide rows with ``error``, scores).

    Per dataset: exact stratified split, preprocessing learned on train, optional SMOTE on train,
    3-fold sigmoid calibration (but for the groups in ``UNCALIBRATED``) on what SMOTE made, fit,
    score the test rows; metrics with tau / pi+ from the (unbalanced) train prevalence. Models of one of the
    ``FAMILIES`` are fitted together, those of all datasets, folds and grid points in the same passes;
    of the others ``at_once`` are fitted at a time, each by Spark jobs of its own. Folds are written once a
    dataset."""
    from concurrent.futures import ThreadPoolExecutor

    from scorelab.operators.metrics import metric_bundle
    from scorelab.operators.prep import fit_preprocessor
    from scorelab.operators.resample import stratified_split

    spark = datasets.sparkSession
    datasets = written_once(datasets)  # the names, the ranks and their counts are read from it
    names = [r["dataset"] for r in datasets.select("dataset").distinct().orderBy("dataset").collect()]
    split = cut_lineage(stratified_split(datasets, y, test_size, seed, by=["dataset"]))
    every = [(g, name, t, params) for g, models in registry.items() for name, (t, params) in models.items()]
    single, together, rows, asked = [], {}, {}, {}
    for g, name, t, params in every:
        if t in FAMILIES:
            together.setdefault((t, calibrate and g not in UNCALIBRATED), []).append((f"{g}\x1f{name}", params))
    for ds in names:
        d = split.where(F.col("dataset") == ds)
        tr = d.where(F.col("split") == "train").drop("split")
        te = d.where(F.col("split") == "test").drop("split")
        pre = fit_preprocessor(tr, y, keep=("dataset", "row_id"))
        feats, trx, tex = pre.feature_names(), cut_lineage(pre.transform(tr)), cut_lineage(pre.transform(te))
        if balance:
            trx = balanced(trx, feats, y, seed).withColumn("dataset", F.lit(ds))
        tf = folded(trx, y, 3, seed)
        alone = LOGISTIC if any(t in LOGISTIC for t, _ in together) and _alone(tf, feats, y) else ()
        single += [(ds, g, name, t, params, tf, tex, feats) for g, name, t, params in every if t not in FAMILIES or t in alone]
        for t in {t for t, _ in together} - set(alone):
            rows.setdefault(t, []).append(passes.model_rows(tf, feats, y, "dataset", F.col("fold")))
            asked.setdefault(t, []).append((ds, passes.model_rows(tex, feats, y, "dataset")))

    def fit_one(job):
        ds, group, name, trainer, params, tf, tex, feats = job
        try:
            if calibrate and group not in UNCALIBRATED:
                sc = calibrate_sigmoid(trainer, tf.drop("fold"), feats, y, seed=seed, tf=tf, **params)
            else:
                sc = trainer(tf.drop("fold"), feats, y, seed=seed, **params)
            part = sc(tex).select("dataset", F.lit(group).alias("model_group"), F.lit(name).alias("model"), "row_id", y, "p")
            return cut_lineage(part), None
        except Exception as e:  # noqa: BLE001 - recorded, the others go on
            return None, [(ds, group, name, f"{type(e).__name__}: {str(e).splitlines()[0][:300]}")]

    def fit_family(job):
        (trainer, cal), jobs = job
        try:
            test = reduce(DataFrame.unionByName, [te for _, te in asked[trainer]])
            long = family_scores(FAMILIES[trainer], all_rows[trainer], test, jobs, 3 if cal else 0)
            part = lambda i: F.element_at(F.split("model", "\x1f"), i)
            return cut_lineage(long.select(F.col("g").alias("dataset"), part(1).alias("model_group"), part(2).alias("model"), "row_id", F.col("y").alias(y), "p")), None
        except Exception as e:  # noqa: BLE001 - recorded, the others go on
            why = f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"
            return None, [(ds, *name.split("\x1f"), why) for ds, _ in asked[trainer] for name, _ in jobs]

    all_rows: dict[Trainer, DataFrame] = {}
    for t, some in rows.items():  # families that see the same datasets read the same rows
        like = next((u for u in all_rows if len(rows[u]) == len(some)), None)
        all_rows[t] = all_rows[like] if like else cut_lineage(reduce(DataFrame.unionByName, some))
    with ThreadPoolExecutor(at_once) as pool:
        families = [pool.submit(fit_family, job) for job in together.items() if job[0][0] in all_rows]
        done = list(pool.map(fit_one, single)) + [f.result() for f in families]
    score_parts, errors = [p for p, _ in done if p is not None], [e for _, es in done if es is not None for e in es]
    scores = reduce(lambda a, b: a.unionByName(b), score_parts) if score_parts else None
    tau = split.where(F.col("split") == "train").groupBy("dataset").agg(F.avg(F.col(y).cast("double")).alias("tau"))
    metrics = metric_bundle(scores, tau).withColumn("error", F.lit(None).cast("string")) if scores is not None else None
    err = spark.createDataFrame(errors, "dataset string, model_group string, model string, error string")
    if metrics is None:
        return err, scores
    return metrics.unionByName(err, allowMissingColumns=True), scores


def save_model(scorer: Scorer, root: str, dataset: str, group: str, name: str) -> str:
    """Persist the model behind a scorer under root/dataset/group/name: a Spark ML one with MLWriter, a large forest as tables."""
    model = getattr(scorer, "model", None)
    if model is None:
        raise ValueError("this scorer has no single Spark ML model to save")
    path = f"{root.rstrip('/')}/models/{dataset}/{group}/{name}"
    if isinstance(model, forest.Forest):
        model.save(path)
        return path
    model.write().overwrite().save(path)
    return path


def sanity_ratio(train: DataFrame, test: DataFrame, features: Sequence[str], y: str = "y", seed: int = 42,
                 C: float = 1.0, group: Sequence[str] = ("dataset",), trainer: Trainer | None = None, **kw) -> float:
    """Mean |phi| of a model over the mean |phi| of the same model refit on labels permuted against the rows
    (+1e-12). Without ``trainer`` the model is logistic, its values exact on the log-odds; a trainer of trees
    gives exact tree values, any other one sampled values."""
    from scorelab.operators.explain import shapley_linear, shapley_rows
    from scorelab.operators.resample import permute_labels

    def mass(tr: DataFrame) -> float:
        if trainer is None:
            m = train_lr_reg(tr, features, y, C=C, l1_ratio=0.0, seed=seed).model  # type: ignore[attr-defined]
            coefs = dict(zip(features, [float(v) for v in m.coefficients.toArray()]))
            ph = shapley_linear(test, tr.drop(*[g for g in group if g in tr.columns]), coefs, float(m.intercept), group)
        else:
            ph = shapley_rows(trainer(tr, features, y, seed=seed, **kw), test, tr, features, seed=seed, group=group)
        return float(ph.agg(F.avg(F.abs("phi"))).first()[0] or 0.0)

    real = mass(train)
    shuffled = mass(written_once(permute_labels(train, y, seed + 1, by=[g for g in group if g in train.columns])))
    return real / (shuffled + 1e-12)
