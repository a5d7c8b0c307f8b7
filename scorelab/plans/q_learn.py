"""Registered queries: training and scoring, feature importance (2.6), SMOTE (2.4)
and the sanity ratio (2.11).

Fits are randomised or iterative, so most keys are rows-only here; their invariants are pytest
properties. KNN scoring is exact and is checked against a brute-force SQL neighbour search; the
importance merge is checked on two deterministic rankings (|corr| with the target and mean |phi|).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelab.operators import explain as X
from scorelab.operators import importance as IM
from scorelab.operators import learn as L
from scorelab.operators.metrics import metric_auc
from scorelab.operators.prep import fit_preprocessor
from scorelab.operators.resample import smote, stratified_split
from scorelab.plans.catalog import query
from scorelab.session import cut_lineage, ensure_checkpoint_dir, written_once
from scorelab.sources.bindings import credit_customer, credit_orders

CUST_FEATS = ["n_orders", "sum_price", "avg_price", "c_nationkey"]


def prepared(spark, d, seed: int = 42):
    """Orders split 80/20 per dataset, preprocessing learned on train: (train, test, features)."""
    o = written_once(credit_orders(spark, d))  # the split and the fit read them many times
    s = written_once(stratified_split(o, "y", 0.2, seed, by=["dataset"]))
    tr = s.where(F.col("split") == "train").drop("split")
    te = s.where(F.col("split") == "test").drop("split")
    pre = fit_preprocessor(tr, "y")
    return cut_lineage(pre.transform(tr)), cut_lineage(pre.transform(te)), pre.feature_names()


def _eval(scorer, te, name):
    sc = scorer(te).select("dataset", F.lit("fit").alias("model_group"), F.lit(name).alias("model"), "row_id", "y", "p")
    return metric_auc(sc)


def _single(key, doc, make):
    @query(key)
    def q(spark, d):
        tr, te, feats = prepared(spark, d)
        return _eval(make(tr, feats), te, key)
    q.__doc__ = doc
    return q


_single("train_lr", "Logistic regression (C = 1e6) fitted on the orders train split; test AUC per dataset.",
        lambda tr, f: L.train_lr(tr, f))
_single("train_lr_reg", "Elastic-net logistic regression (C = 1, l1 ratio 0.5); test AUC per dataset.",
        lambda tr, f: L.train_lr_reg(tr, f, C=1.0, l1_ratio=0.5))
_single("train_rf", "Random forest, 100 trees, sqrt features; test AUC per dataset.",
        lambda tr, f: L.train_rf(tr, f, trees=100, max_features="sqrt"))
_single("train_bagged_trees", "Bagged CART, 10 trees over all features; test AUC per dataset.",
        lambda tr, f: L.train_bagged_trees(tr, f, n=10))
_single("train_sgb", "Stochastic gradient boosting, 10 rounds, subsample 0.7; test AUC per dataset.",
        lambda tr, f: L.train_sgb(tr, f, n=10))
_single("train_adaboost", "SAMME AdaBoost with 10 stumps; test AUC per dataset.",
        lambda tr, f: L.train_adaboost(tr, f, n=10))
_single("train_mlp", "64-32 multilayer perceptron; test AUC per dataset.", lambda tr, f: L.train_mlp(tr, f, epochs=50))
_single("calibrate_sigmoid", "Random forest (20 trees) calibrated by 3-fold Platt scaling; test AUC per dataset.",
        lambda tr, f: L.calibrate_sigmoid(L.train_rf, tr, f, trees=20))


def _grid(scores):
    """Test AUC of every model of a long score table."""
    return metric_auc(scores.withColumn("model_group", F.lit("fit")))


@query("train_boost_grid")
def q_train_boost_grid(spark, d):
    """SAMME grid, 10 to 1000 stumps x 3 rates: one fit of 1000 rounds gives all 18 points; test AUC of each."""
    tr, te, feats = prepared(spark, d)
    return _grid(L.train_boost_grid(tr, te, feats))


@query("train_gbt_grid")
def q_train_gbt_grid(spark, d):
    """Second-order trees, 100, 200 and 300 rounds x 2 rates, grown by level and by leaf: one fit of 300 rounds a rate
    and way gives all 12 points; test AUC of each."""
    tr, te, feats = prepared(spark, d)
    return _grid(L.grid_scores(L.newton_family, tr, te, feats, L.gbt_grid()))


@query("train_bagged_mlp")
def q_train_bagged_mlp(spark, d):
    """5, 10, 25 and 100 bagged networks (one layer of 100), all trained in the same passes; test AUC of each."""
    tr, te, feats = prepared(spark, d)
    return _grid(L.grid_scores(L.network_family, tr, te, feats, [(f"bagnn_{n}", {"n": n}) for n in L.BAGNN_N]))


KNN_SQL = f"""WITH c AS (SELECT row_id, y, {', '.join(f'coalesce({c}, 0) AS {c}' for c in CUST_FEATS)} FROM credit_customer),
pr AS (SELECT a.row_id AS q_id, b.row_id AS r_id, b.y,
  sqrt(0 + {' + '.join(f'(a.{c} - b.{c}) * (a.{c} - b.{c})' for c in CUST_FEATS)}) AS dist FROM c a, c b),
rk AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, r_id) AS r FROM pr)
SELECT q_id AS row_id, avg(y) AS p FROM rk WHERE r <= 5 GROUP BY q_id"""


@query("train_knn", KNN_SQL, views=("credit_customer",), rnd=["p"])
def q_train_knn(spark, d):
    """5-NN probability of every customer against all customers (exact neighbour search)."""
    c = written_once(credit_customer(spark, d))
    sc = L.train_knn(c, CUST_FEATS, k=5)
    return sc(c.select("row_id", *CUST_FEATS)).select("row_id", "p")


@query("tune_knn")
def q_tune_knn(spark, d):
    """5-fold AUC over k x weights x p for customers, best flagged; preprocessing and SMOTE in each fold."""
    return L.tune_knn(credit_customer(spark, d), CUST_FEATS, ks=(3, 5, 7, 11, 15, 21), prepare=True, balance=True)


@query("grid_search_ada")
def q_grid_search_ada(spark, d):
    """5-fold AUC of SAMME over n {50, 100, 200} x rate {0.01, 0.1, 1.0} for customers."""
    rows = written_once(credit_customer(spark, d))
    c = fit_preprocessor(rows, "y", keep=("row_id",))
    x = c.transform(rows)
    return L.grid_search_ada(x, c.feature_names())


@query("cross_val")
def q_cross_val(spark, d):
    """5-fold accuracy of logistic regression on customers (fold -1 = mean)."""
    rows = written_once(credit_customer(spark, d))
    pre = fit_preprocessor(rows, "y", keep=("row_id",))
    x = pre.transform(rows)
    return L.cross_val(L.train_lr, x, pre.feature_names(), k=5)


@query("balance_then_train")
def q_balance_then_train(spark, d):
    """SMOTE on the customer train split, then logistic regression; test AUC."""
    c = written_once(credit_customer(spark, d))
    s = written_once(stratified_split(c, "y", 0.2, 42))
    tr, te = s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")
    pre = fit_preprocessor(tr, "y", keep=("dataset", "row_id"))
    sc = L.balance_then_train(L.train_lr, pre.transform(tr), pre.feature_names())
    return _eval(sc, pre.transform(te), "lr_smote")


@query("score_rows")
def q_score_rows(spark, d):
    """Every test order scored by the fitted logistic regression (p and class at 0.5)."""
    tr, te, feats = prepared(spark, d)
    return L.score_rows(L.train_lr(tr, feats), te)


@query("run_experiment", """SELECT dataset, model_group, n_models, n_errors, all_scored FROM (VALUES ('lr', 3), ('lr_reg', 3), ('adaboost', 3), ('Boost-DT', 18)) AS g(model_group, n_models),
  (SELECT DISTINCT dataset FROM credit_orders), (SELECT 0 AS n_errors), (SELECT true AS all_scored)""", views=("credit_orders",))
def q_run_experiment(spark, d):
    """The lr, lr_reg, adaboost and Boost-DT groups, calibrated, over the three orders datasets: models and
    errors by group, and whether every model has an AUC and a Brier score in [0, 1]."""
    reg = L.default_registry(("lr", "lr_reg", "adaboost", "Boost-DT"))
    metrics, _ = L.run_experiment(credit_orders(spark, d), reg)
    good = F.col("AUC").between(0.0, 1.0) & F.col("BS").between(0.0, 1.0)
    return metrics.groupBy("dataset", "model_group").agg(
        F.count("*").cast("int").alias("n_models"), F.count("error").cast("int").alias("n_errors"), F.bool_and(good).alias("all_scored"))


@query("save_model")
def q_save_model(spark, d):
    """The fitted logistic regression written with MLWriter; its path and coefficient count."""
    import uuid

    tr, _, feats = prepared(spark, d)
    sc = L.train_lr(tr, feats)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scorelab_models/{uuid.uuid4().hex}"
    path = L.save_model(sc, root, "orders", "lr", "lr_lbfgs")
    from pyspark.ml.classification import LogisticRegressionModel

    m = LogisticRegressionModel.load(path)
    return spark.createDataFrame([(path, len(m.coefficients))], "path string, n_coefficients int")


@query("smote", """SELECT y, false AS synthetic, count(*) AS n FROM credit_customer GROUP BY y
UNION ALL SELECT 1, true, (SELECT count(*) FROM credit_customer WHERE y = 0) - (SELECT count(*) FROM credit_customer WHERE y = 1)""",
       views=("credit_customer",))
def q_smote(spark, d):
    """SMOTE (k = 5) of the rare-class customers: rows per class and origin after balancing."""
    c = credit_customer(spark, d).select("row_id", "y", *CUST_FEATS)
    return smote(c, CUST_FEATS, "y", 5, 42).groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("importance_rf")
def q_importance_rf(spark, d):
    """Random-forest impurity importance of the order features (100 trees)."""
    tr, _, feats = prepared(spark, d)
    return IM.importance_rf(tr, feats, trees=100)


@query("importance_l1")
def q_importance_l1(spark, d):
    """|coefficient| of L1 logistic regression on min-max inputs."""
    tr, _, feats = prepared(spark, d)
    return IM.importance_l1(tr, feats)


@query("importance_lr")
def q_importance_lr(spark, d):
    """|coefficient| of plain logistic regression (C = 1)."""
    tr, _, feats = prepared(spark, d)
    return IM.importance_lr(tr, feats)


def _det_rankings(spark, d):
    """Two deterministic rankings of the order features: |corr| with y, and mean |phi|."""
    from scorelab.operators.explain import shap_importance
    from scorelab.operators.profiling import target_correlation
    from scorelab.plans import q_explain as QX

    corr = target_correlation(credit_orders(spark, d), "y", QX.FEATS, n=10).select(
        "feature", F.abs("r").alias("importance"))
    sh = shap_importance(QX.phi(spark, d), group=["model"]).select("feature", "importance")
    return sh, corr


def _det_sql():
    from scorelab.plans import q_explain as QX

    corr = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS importance FROM credit_orders"
                              for c in QX.FEATS)
    return (f"{QX.PHI}, a AS (SELECT feature, avg(abs(phi)) AS importance FROM phi GROUP BY feature), "
            f"b AS (SELECT * FROM ({corr}) WHERE importance IS NOT NULL)")


@query("importance_merge", f"""WITH {_det_sql()},
j AS (SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.importance, 0) AS rf_importance,
      coalesce(b.importance, 0) AS lr_coef_abs FROM a FULL JOIN b ON a.feature = b.feature),
n AS (SELECT *, CASE WHEN max(rf_importance) OVER () - min(rf_importance) OVER () > 0 THEN
        (rf_importance - min(rf_importance) OVER ()) / (max(rf_importance) OVER () - min(rf_importance) OVER ()) ELSE 0 END AS rf_norm,
      CASE WHEN max(lr_coef_abs) OVER () - min(lr_coef_abs) OVER () > 0 THEN
        (lr_coef_abs - min(lr_coef_abs) OVER ()) / (max(lr_coef_abs) OVER () - min(lr_coef_abs) OVER ()) ELSE 0 END AS lr_norm FROM j)
SELECT CAST(row_number() OVER (ORDER BY (rf_norm + lr_norm) / 2 DESC, rf_importance DESC, lr_coef_abs DESC, feature) AS INTEGER) AS rank,
  feature, rf_importance, lr_coef_abs, rf_norm, lr_norm, (rf_norm + lr_norm) / 2 AS avg_score FROM n""",
       views=("credit_orders",), rnd=["rf_importance", "lr_coef_abs", "rf_norm", "lr_norm", "avg_score"])
def q_importance_merge(spark, d):
    """Merge of two rankings of the order features (mean |phi| and |corr| with y)."""
    a, b = _det_rankings(spark, d)
    return IM.importance_merge(a, b)


@query("importance_outer", f"""WITH {_det_sql()}
SELECT coalesce(a.feature, b.feature) AS feature, a.importance AS importance, b.importance AS coefficient
FROM a FULL JOIN b ON a.feature = b.feature""", views=("credit_orders",), rnd=["importance", "coefficient"])
def q_importance_outer(spark, d):
    """Plain outer join of the two rankings."""
    a, b = _det_rankings(spark, d)
    return IM.importance_outer(a, b)


@query("top_features", f"""WITH {_det_sql()}, r AS (SELECT feature, importance,
  CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM b)
SELECT 'corr' AS selector, feature, importance, rank FROM r ORDER BY rank LIMIT 2""", views=("credit_orders",),
       rnd=["importance"])
def q_top_features(spark, d):
    """The top 2 features of the |corr| ranking."""
    _, b = _det_rankings(spark, d)
    ranked = IM._ranked(spark, "corr", [(r["feature"], r["importance"]) for r in b.collect()])
    return IM.top_features(ranked, 2)


@query("importance_many")
def q_importance_many(spark, d):
    """Merged RF + L1 importance for each orders dataset with its column meta."""
    return IM.importance_many(credit_orders(spark, d), trees=50)


@query("sanity_ratio")
def q_sanity_ratio(spark, d):
    """Explanation mass of a fitted model over that of a refit on permuted labels: logistic, and boosted trees."""
    tr, te, feats = prepared(spark, d)
    r = [("lr", float(L.sanity_ratio(tr, te, feats))), ("xgb", float(L.sanity_ratio(tr, te, feats, trainer=L.train_gbt_grid, n=10)))]
    return spark.createDataFrame(r, "model string, sanity_ratio double")


def _boosted(spark, d):
    """20 second-order trees on the train split: (scorer, train and test rows, features)."""
    tr, te, feats = prepared(spark, d)
    return L.train_gbt_grid(tr, feats, n=20, lr=0.3), tr.unionByName(te), feats


@query("tree_shapley")
def q_tree_shapley(spark, d):
    """Exact Shapley values (log-odds) of 20 boosted trees for every order."""
    sc, rows, feats = _boosted(spark, d)
    return X.shapley_rows(sc, rows, rows, feats, model="xgb_20")


@query("tree_interactions")
def q_tree_interactions(spark, d):
    """The 10 feature pairs with the largest mean |Shapley interaction| of 20 boosted trees, by dataset."""
    sc, rows, feats = _boosted(spark, d)
    return X.pair_interactions(sc, rows, rows, feats, 10)


@query("trial_stability")
def q_trial_stability(spark, d):
    """Rank stability of 20 boosted trees' Shapley values over 3 trials of 100 rows each ("quick"), by dataset."""
    tr, te, feats = prepared(spark, d)
    trials, bg = X.PRESETS["quick"]
    sc = L.train_gbt_grid(tr, feats, n=20, lr=0.3)
    return X.rank_stability(X.trial_shapley(sc, tr, te, feats, trials, bg, 100, model="xgb_20"), group=("dataset", "model"))
