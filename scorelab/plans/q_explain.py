"""Registered queries: explanations and their reliability (2.12).

The exact checks run on a fixed-coefficient logistic scorer over the order features, whose
Shapley values have a closed form; the rank-stability "trials" are the three orders datasets
(each a full resample of the explained rows), so every number has an exact SQL statement.
Model-agnostic sampling Shapley, counterfactual search and bootstrap are rows-only here and
checked against their invariants in pytest.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelab.operators import explain as X
from scorelab.operators import reliability as RL
from scorelab.plans.catalog import query
from scorelab.session import written_once
from scorelab.sources.bindings import credit_orders

# Coefficients of the test scorer (log-odds) over the order features.
COEFS = {"o_totalprice": 5e-06, "n_lines": -0.25, "avg_discount": 10.0, "sum_qty": 0.01}
INTERCEPT = -0.5
FEATS = list(COEFS)
RATIO = 1.5  # sanity ratio used by the reliability queries (a parameter of the operators)
V = ("credit_orders",)


def _lit(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


LOGIT = _lit(INTERCEPT) + "".join(f" + coalesce({c}, 0) * {_lit(w)}" for c, w in COEFS.items())
MU = "mu AS (SELECT " + ", ".join(f"avg(coalesce({c}, 0)) AS m_{c}" for c in FEATS) + " FROM credit_orders)"
BASE = _lit(INTERCEPT) + "".join(f" + {_lit(w)} * m_{c}" for c, w in COEFS.items())
SC = f"sc AS (SELECT dataset, 'linear' AS model_group, 'linear_fixed' AS model, row_id, y, 1 / (1 + exp(-({LOGIT}))) AS p FROM credit_orders)"
PHI = f"{MU}, phi AS (" + " UNION ALL ".join(
    f"SELECT dataset, 'linear_fixed' AS model, row_id, '{c}' AS feature, {c} AS feature_value, "
    f"{_lit(w)} * (coalesce({c}, 0) - m_{c}) AS phi, {BASE} AS base_value FROM credit_orders, mu"
    for c, w in COEFS.items()) + ")"
RANKS = """tr AS (SELECT model, dataset AS trial, feature, avg(abs(phi)) AS abs_mean FROM phi GROUP BY ALL),
trr AS (SELECT *, row_number() OVER (PARTITION BY model, trial ORDER BY abs_mean DESC, feature) AS rank FROM tr),
rk AS (SELECT model, feature, avg(rank) AS avg_rank, stddev_pop(rank) AS std_rank FROM trr GROUP BY model, feature),
wt AS (SELECT *, coalesce(1 / (1 + avg_rank) * (1 / (1 + coalesce(std_rank, 0))), 0) AS W FROM rk)"""
# The reliability queries run on two models; the second has no weight for one of its features.
COEFS_B = {"o_totalprice": 3e-06, "n_lines": 0.15, "avg_discount": 4.0, "sum_qty": -0.02}
INTERCEPT_B = 0.1
UNRANKED_B = "sum_qty"
MODELS = (("linear_fixed", COEFS, INTERCEPT), ("linear_other", COEFS_B, INTERCEPT_B))
SC2 = "sc AS (" + " UNION ALL ".join(
    f"SELECT dataset, 'linear' AS model_group, '{m}' AS model, row_id, y, 1 / (1 + exp(-({_lit(b)}"
    + "".join(f" + coalesce({c}, 0) * {_lit(w)}" for c, w in ws.items()) + "))) AS p FROM credit_orders" for m, ws, b in MODELS) + ")"
PHI2 = f"{MU}, phi AS (" + " UNION ALL ".join(
    f"SELECT dataset, '{m}' AS model, row_id, '{c}' AS feature, {_lit(w)} * (coalesce({c}, 0) - m_{c}) AS phi FROM credit_orders, mu"
    for m, ws, _ in MODELS for c, w in ws.items()) + ")"
RANKS2 = RANKS.replace("SELECT *, coalesce(1 / (1 + avg_rank)", "SELECT * FROM (SELECT *, coalesce(1 / (1 + avg_rank)").replace(
    "AS W FROM rk)", f"AS W FROM rk) WHERE NOT (model = 'linear_other' AND feature = '{UNRANKED_B}'))")
ROWREL = f"""sh AS (SELECT phi.dataset, phi.model, phi.row_id, phi.feature, phi.phi, coalesce(wt.W, 0) AS W,
   CASE WHEN sum(abs(phi.phi)) OVER (PARTITION BY phi.dataset, phi.model, phi.row_id) = 0 THEN 0
        ELSE abs(phi.phi) / sum(abs(phi.phi)) OVER (PARTITION BY phi.dataset, phi.model, phi.row_id) END AS share
   FROM phi LEFT JOIN wt ON phi.model = wt.model AND string_split(phi.feature, '__')[-1] = string_split(wt.feature, '__')[-1]),
per AS (SELECT dataset, model, row_id, sum(W * share) AS GL_term, sum(share * share) AS C_concentration FROM sh GROUP BY ALL),
er AS (SELECT dataset, model, avg(W) AS ER FROM (SELECT DISTINCT dataset, model, feature, W FROM sh) GROUP BY ALL),
rr AS (SELECT per.dataset, per.model, per.row_id, sc.p AS pred_proba, CAST(sc.p >= 0.5 AS INTEGER) AS pred_default,
   coalesce({_lit(min(RATIO / 3, 1.0))} * GL_term * C_concentration * (4 * (sc.p - 0.5) * (sc.p - 0.5)), 0) AS reliability_score,
   er.ER AS ER_global, {_lit(min(RATIO / 3, 1.0))} AS W_signal, er.ER * {_lit(min(RATIO / 3, 1.0))} AS global_reliability,
   GL_term, C_concentration, 4 * (sc.p - 0.5) * (sc.p - 0.5) AS D_decisiveness, sc.y AS actual_default
   FROM per JOIN sc ON per.dataset = sc.dataset AND per.model = sc.model AND per.row_id = sc.row_id
   JOIN er ON per.dataset = er.dataset AND per.model = er.model),
qq AS (SELECT dataset, model, quantile_cont(reliability_score, 0.25) AS q1, quantile_cont(reliability_score, 0.5) AS q2,
   quantile_cont(reliability_score, 0.75) AS q3, min(reliability_score) AS smin, max(reliability_score) AS smax FROM rr GROUP BY ALL),
br AS (SELECT rr.*, CASE WHEN reliability_score IS NULL THEN 'Unknown' WHEN reliability_score >= q3 THEN 'Reliable'
   WHEN reliability_score >= q2 THEN 'Moderately Reliable' WHEN reliability_score >= q1 THEN 'Questionable'
   ELSE 'Unreliable' END AS reliability_bucket FROM rr JOIN qq USING (dataset, model))"""
RR_DBL = ["pred_proba", "reliability_score", "ER_global", "W_signal", "global_reliability", "GL_term",
          "C_concentration", "D_decisiveness"]


def orders(spark, d):
    return credit_orders(spark, d)


def kept(spark, d):
    """The orders, joined and written once: the reliability terms read them many times."""
    return written_once(orders(spark, d))


def scores(spark, d):
    return X.score_linear(orders(spark, d), COEFS, INTERCEPT)


def phi(spark, d):
    """Exact Shapley values of every order against the pooled orders table as background."""
    o = orders(spark, d)
    return X.shapley_linear(o, o.drop("dataset"), COEFS, INTERCEPT, ["dataset"])


def ranks(spark, d):
    return X.rank_stability(phi(spark, d), trial="dataset", group=["model"])


def weights(spark, d):
    return RL.feature_weights(ranks(spark, d))


def phi2(o):
    """Shapley values of both models of the reliability queries."""
    parts = [X.shapley_linear(o, o.drop("dataset"), ws, b, ["dataset"], m) for m, ws, b in MODELS]
    return parts[0].unionByName(parts[1])


def scores2(o):
    parts = [X.score_linear(o, ws, b, m) for m, ws, b in MODELS]
    return parts[0].unionByName(parts[1])


def ranks2(o):
    r = X.rank_stability(phi2(o), trial="dataset", group=["model"])
    return r.where(~((F.col("model") == "linear_other") & (F.col("feature") == UNRANKED_B)))


def weights2(o):
    return RL.feature_weights(ranks2(o))


def rowrel(o):
    return RL.row_reliability(phi2(o), scores2(o), weights2(o), RATIO)


@query("score_linear", f"WITH {SC} SELECT *, CAST(p >= 0.5 AS INTEGER) AS pred FROM sc", views=V, rnd=["p"])
def q_score_linear(spark, d):
    """Fixed logistic scorer over the order features: the scores table of the explanation checks."""
    return scores(spark, d)


@query("shapley_linear", f"WITH {PHI} SELECT * FROM phi", views=V, rnd=["feature_value", "phi", "base_value"])
def q_shapley_linear(spark, d):
    """Exact Shapley values (log-odds) of every order row against the pooled orders as background."""
    return phi(spark, d)


GLOBAL = """gl AS (SELECT dataset, model, feature, avg(abs(phi)) AS abs_mean_shap, avg(phi) AS mean_shap,
  stddev_pop(phi) AS std_shap FROM phi GROUP BY ALL)"""


@query("shap_global", f"""WITH {PHI}, {GLOBAL}
SELECT *, CAST(row_number() OVER (PARTITION BY dataset, model ORDER BY abs_mean_shap DESC, feature) AS INTEGER) AS rank FROM gl""",
       views=V, rnd=["abs_mean_shap", "mean_shap", "std_shap"])
def q_shap_global(spark, d):
    """Global importance per dataset: mean |phi|, mean phi, std, rank."""
    return X.shap_global(phi(spark, d))


@query("shap_importance", f"WITH {PHI} SELECT dataset, model, feature, avg(abs(phi)) AS importance FROM phi GROUP BY ALL",
       views=V, rnd=["importance"])
def q_shap_importance(spark, d):
    """Mean |phi| per (dataset, model, feature)."""
    return X.shap_importance(phi(spark, d))


@query("shap_wide", f"WITH {PHI} SELECT dataset, model, row_id, " + ", ".join(
    f"first(phi) FILTER (WHERE feature = '{c}') AS {c}_shap" for c in FEATS) + " FROM phi GROUP BY dataset, model, row_id",
       views=V, rnd=[f"{c}_shap" for c in FEATS])
def q_shap_wide(spark, d):
    """One phi column per feature, one row per explained order."""
    return X.shap_wide(phi(spark, d), FEATS)


@query("shap_direction", f"WITH {PHI}, {GLOBAL} SELECT dataset, model, feature, CAST(sign(mean_shap) AS INTEGER) AS sign FROM gl",
       views=V)
def q_shap_direction(spark, d):
    """Sign of the mean phi per feature."""
    return X.shap_direction(X.shap_global(phi(spark, d)))


@query("perturbation_sets", f"""WITH {PHI}, {GLOBAL}, dr AS (SELECT dataset, model, feature, sign(mean_shap) AS sign FROM gl
  WHERE feature IN ('o_totalprice', 'n_lines', 'avg_discount', 'sum_qty'))
SELECT dataset, model,
  list_sort(coalesce(list(feature) FILTER (WHERE feature <> 'n_lines' AND sign < 0), [])) AS s_up,
  list_sort(coalesce(list(feature) FILTER (WHERE feature <> 'n_lines' AND sign > 0), [])) AS s_down,
  list_sort(coalesce(list(feature) FILTER (WHERE feature = 'n_lines'), [])) AS s_immutable FROM dr GROUP BY ALL""",
       views=V)
def q_perturbation_sets(spark, d):
    """Features to raise / lower (by the sign of their mean phi), n_lines held immutable."""
    return X.perturbation_sets(X.shap_direction(X.shap_global(phi(spark, d))), FEATS, ["n_lines"])


@query("rank_stability", f"WITH {PHI}, {RANKS} SELECT model, feature, avg_rank, std_rank FROM rk", views=V,
       rnd=["avg_rank", "std_rank"])
def q_rank_stability(spark, d):
    """Feature ranks (from 1) across the three datasets as trials: average and population std."""
    return ranks(spark, d)


@query("shap_stable", f"""WITH {PHI},
tr AS (SELECT model, dataset AS trial, feature, avg(abs(phi)) AS abs_mean FROM phi GROUP BY ALL),
trr AS (SELECT *, row_number() OVER (PARTITION BY model, trial ORDER BY abs_mean DESC, feature) - 1 AS rank FROM tr),
r0 AS (SELECT model, feature, avg(rank) AS avg_rank, stddev_pop(rank) AS std_rank FROM trr GROUP BY ALL),
pl AS (SELECT model, feature, avg(abs(phi)) AS abs_mean_shap, avg(phi) AS mean_shap, stddev_pop(phi) AS std_shap FROM phi GROUP BY ALL)
SELECT * FROM pl JOIN r0 USING (model, feature)""", views=V,
       rnd=["abs_mean_shap", "mean_shap", "std_shap", "avg_rank", "std_rank"])
def q_shap_stable(spark, d):
    """Pooled importance over trials with 0-based per-trial rank statistics."""
    return X.shap_stable(phi(spark, d), trial="dataset", group=["model"])


@query("local_explanation", f"""WITH {PHI}, {SC}, m AS (SELECT dataset, model, row_id,
  map_from_entries(list(struct_pack(k := feature, v := feature_value))) AS feature_values,
  map_from_entries(list(struct_pack(k := feature, v := phi))) AS shap_values FROM phi WHERE row_id IN (1, 2, 3, 4, 5)
  GROUP BY ALL)
SELECT m.dataset, m.model, m.row_id AS instance_idx, sc.y AS true_label, CAST(sc.p > 0.5 AS INTEGER) AS pred_label,
  sc.p AS pred_proba, k.feature, feature_values[k.feature] AS feature_value, shap_values[k.feature] AS shap_value
FROM m JOIN sc USING (dataset, model, row_id), (SELECT unnest(['o_totalprice', 'n_lines', 'avg_discount', 'sum_qty']) AS feature) k
""", views=V, rnd=["pred_proba", "feature_value", "shap_value"])
def q_local_explanation(spark, d):
    """Local records (label, prediction, feature values and phi as maps) for orders 1-5, listed
    one map entry per row."""
    le = X.local_explanation(phi(spark, d), scores(spark, d), [1, 2, 3, 4, 5])
    return le.select("dataset", "model", "instance_idx", "true_label", "pred_label", "pred_proba",
                     F.explode("feature_values").alias("feature", "feature_value"), "shap_values").select(
        "dataset", "model", "instance_idx", "true_label", "pred_label", "pred_proba", "feature", "feature_value",
        F.element_at("shap_values", F.col("feature")).alias("shap_value"))


@query("explanation_payload", f"""WITH {PHI}, {SC}, t AS (SELECT *, row_number() OVER (PARTITION BY dataset, model, row_id
  ORDER BY abs(phi) DESC, feature) AS r FROM phi)
SELECT t.dataset, t.model, t.row_id, CAST(t.r AS INTEGER) AS pos, t.feature, t.feature_value AS value, t.phi,
  CAST(sc.p >= 0.5 AS INTEGER) AS predicted_class, greatest(sc.p, 1 - sc.p) AS confidence
FROM t JOIN sc USING (dataset, model, row_id) WHERE t.r <= 2""", views=V, rnd=["value", "phi", "confidence"])
def q_explanation_payload(spark, d):
    """Top-2 features by |phi| per order with the predicted class and confidence (one row per
    listed feature, in order)."""
    p = X.explanation_payload(phi(spark, d), scores(spark, d), 2)
    return p.select("dataset", "model", "row_id", F.posexplode("top_features").alias("pos", "f"),
                    "predicted_class", "confidence").select(
        "dataset", "model", "row_id", (F.col("pos") + 1).alias("pos"), "f.feature", "f.value", "f.phi",
        "predicted_class", "confidence")


MM = "mm AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in FEATS) + " FROM credit_orders)"
SCALED = f"{MM}, s AS (SELECT dataset, row_id, " + ", ".join(
    f"({c} - lo_{c}) / (hi_{c} - lo_{c}) AS {c}" for c in FEATS) + " FROM credit_orders, mm)"
GW = [3.0, 1.0, 2.0, 2.0]


@query("gower_distance", f"""WITH {SCALED}, ref AS (SELECT * FROM s WHERE row_id = 1)
SELECT s.dataset, s.row_id, """ + " + ".join(
    f"{_lit(w / (sum(GW) + 1e-12))} * least(1, abs(s.{c} - ref.{c}))" for c, w in zip(FEATS, GW))
       .replace(f"{_lit(GW[0] / (sum(GW) + 1e-12))} *", f"0 + {_lit(GW[0] / (sum(GW) + 1e-12))} *", 1)
       + """ AS gower FROM s, ref""", views=V, rnd=["gower"])
def q_gower_distance(spark, d):
    """Weighted Gower distance of every order (min-max scaled features) to order 1."""
    from scorelab.operators.prep import scale_minmax

    o = scale_minmax(orders(spark, d).select("dataset", "row_id", *FEATS), FEATS)
    ref = o.where(F.col("row_id") == 1).drop("dataset").withColumn("_k", F.lit(1))
    rows = o.withColumn("_k", F.lit(1))
    return X.gower_distance(rows, ref, FEATS, GW, on=["_k"]).select(
        F.col("row_id"), "gower").join(o.select("dataset", "row_id"), "row_id").select("dataset", "row_id", "gower")


@query("clip_bounds", "SELECT dataset, row_id, greatest(o_totalprice, 50000) AS o_totalprice, "
       "least(sum_qty, 200) AS sum_qty FROM credit_orders", views=V, rnd=["o_totalprice", "sum_qty"])
def q_clip_bounds(spark, d):
    """Order price floored at 50 000 and quantity capped at 200."""
    o = orders(spark, d).select("dataset", "row_id", "o_totalprice", "sum_qty")
    return X.clip_bounds(o, {"o_totalprice": 50000.0}, {"sum_qty": 200.0})


STEP_DIR = {"o_totalprice": -1, "n_lines": 1, "avg_discount": 1, "sum_qty": -1}


@query("step_candidates", f"""WITH q AS (SELECT """ + ", ".join(
    f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr_{c}, stddev_pop({c}) AS sd_{c}" for c in FEATS)
       + " FROM credit_orders), st AS (SELECT " + ", ".join(
    f"0.05 * CASE WHEN iqr_{c} > 0 THEN iqr_{c} ELSE sd_{c} + 1e-6 END AS st_{c}" for c in FEATS) + " FROM q)\n"
       + " UNION ALL ".join(
    f"SELECT dataset, row_id, '{m}' AS moved, " + ", ".join(
        (f"{c} + ({STEP_DIR[c]}) * st_{c} AS {c}" if c == m else c) for c in FEATS) + " FROM credit_orders, st"
    for m in FEATS if m != "n_lines"), views=V, rnd=FEATS)
def q_step_candidates(spark, d):
    """One neighbour per mutable feature: moved by 5 % of its IQR in its direction (n_lines immutable)."""
    o = orders(spark, d)
    steps = X.step_sizes(o, FEATS, 0.05)
    return X.step_candidates(o.select("dataset", "row_id", *FEATS), STEP_DIR, steps, ["n_lines"])


@query("partial_dependence", f"""WITH q AS (SELECT dataset, quantile_cont(sum_qty, 0.05) AS lo, quantile_cont(sum_qty, 0.95) AS hi
  FROM credit_orders GROUP BY dataset),
g AS (SELECT o.*, i, lo + (hi - lo) * i / 19 AS value FROM credit_orders o JOIN q USING (dataset), (SELECT range AS i FROM range(20)))
SELECT dataset, NULL::BIGINT AS row_id, value, avg(1 / (1 + exp(-({LOGIT.replace('coalesce(sum_qty, 0)', 'coalesce(value, 0)')})))) AS p
FROM g GROUP BY dataset, i, value""", views=V, rnd=["value", "p"])
def q_partial_dependence(spark, d):
    """Partial dependence of the scorer on sum_qty over 20 points between its 5 % and 95 % points
    (mean over all rows; the ICE rows of a hash sample are checked in pytest)."""
    pdp = X.partial_dependence(X.linear_scorer(COEFS, INTERCEPT), orders(spark, d), "sum_qty", 20, 0)
    return pdp


@query("pair_interactions")
def q_pair_interactions(spark, d):
    """Top feature pairs by mean absolute second difference of the scorer's probability."""
    o = kept(spark, d)
    return X.pair_interactions(X.linear_scorer(COEFS, INTERCEPT), o, o, FEATS, 5)


@query("shapley_rows")
def q_shapley_rows(spark, d):
    """Model-agnostic permutation Shapley (8 antithetic pairs) of the scorer's log-odds, every order."""
    o = kept(spark, d)
    sc = X.linear_scorer(COEFS, INTERCEPT)
    return X.shapley_rows(sc, o, o, FEATS, draws=8, seed=42, model="linear_fixed", output="logit")


@query("counterfactuals")
def q_counterfactuals(spark, d):
    """Beam search (width 20, <= 30 steps) for the nearest class flip of every predicted-default order."""
    o = kept(spark, d)
    sc = X.linear_scorer(COEFS, INTERCEPT)
    rows = sc(o).where(F.col("p") >= 0.5).select("dataset", "row_id", *FEATS)
    steps = X.step_sizes(o, FEATS, 0.05)
    return X.counterfactuals(sc, rows, STEP_DIR, steps, {c: 1.0 for c in FEATS}, immutable=["n_lines"],
                             lower={"o_totalprice": 0.0, "sum_qty": 0.0})


# ---------------------------------------------------------------- reliability (2.12)

@query("feature_weights", f"WITH {PHI}, {RANKS} SELECT model, feature, avg_rank, std_rank, W FROM wt", views=V,
       rnd=["avg_rank", "std_rank", "W"])
def q_feature_weights(spark, d):
    """W = 1/(1+avg_rank) * 1/(1+std_rank) per feature."""
    return weights(spark, d)


@query("explanatory_robustness", f"WITH {PHI}, {RANKS} SELECT model, coalesce(avg(W), 0) AS ER FROM wt GROUP BY model",
       views=V, rnd=["ER"])
def q_explanatory_robustness(spark, d):
    """ER = mean feature weight."""
    return RL.explanatory_robustness(weights(spark, d), ["model"])


SIG = f"""{PHI}, ms AS (SELECT dataset, avg(abs(phi)) AS mass FROM phi GROUP BY dataset),
ra AS (SELECT dataset, mass / (SELECT avg(abs(phi)) FROM phi) AS ratio FROM ms)"""


def _ratios(spark, d):
    p = phi(spark, d)
    allm = p.agg(F.avg(F.abs("phi")).alias("_all"))
    per = p.groupBy("dataset").agg(F.avg(F.abs("phi")).alias("mass"))
    return per.withColumn("_k", F.lit(1)).join(F.broadcast(allm.withColumn("_k", F.lit(1))), "_k").select(
        "dataset", (F.col("mass") / F.col("_all")).alias("ratio"))


@query("signal_weight", f"""WITH {SIG} SELECT dataset, ratio, CASE WHEN ratio IS NULL OR isnan(ratio) THEN 0
  ELSE least(ratio, 3) / 3 END AS W_signal FROM ra""", views=V, rnd=["ratio", "W_signal"])
def q_signal_weight(spark, d):
    """Signal weight of a per-dataset ratio (its mean |phi| against the pooled mean |phi|)."""
    r = _ratios(spark, d)
    return r.withColumn("W_signal", RL.signal_weight(F.col("ratio")))


@query("global_reliability", f"""WITH {SIG}, {RANKS}, er AS (SELECT coalesce(avg(W), 0) AS ER FROM wt)
SELECT dataset, ratio, least(1, greatest(0, ER * (CASE WHEN ratio IS NULL OR isnan(ratio) THEN 0 ELSE least(ratio, 3) / 3 END)))
  AS global_reliability FROM ra, er""", views=V, rnd=["ratio", "global_reliability"])
def q_global_reliability(spark, d):
    """ER x signal weight, clipped to [0, 1], per dataset ratio."""
    er = RL.explanatory_robustness(weights(spark, d))
    r = _ratios(spark, d).withColumn("_k", F.lit(1)).join(F.broadcast(er.withColumn("_k", F.lit(1))), "_k")
    return r.select("dataset", "ratio", RL.global_reliability(F.col("ER"), F.col("ratio")).alias("global_reliability"))


def _rr_sql(select: str) -> str:
    return f"WITH {PHI2}, {SC2}, {RANKS2}, {ROWREL} {select}"


@query("row_reliability", _rr_sql("SELECT * FROM rr"), views=V, rnd=RR_DBL)
def q_row_reliability(spark, d):
    """Per-row reliability R = W_signal * GL * C * D with all its terms, every order."""
    return rowrel(kept(spark, d))


@query("batch_reliability", _rr_sql("SELECT * FROM br"), views=V, rnd=RR_DBL)
def q_batch_reliability(spark, d):
    """Row reliability of the whole batch with actual labels and quantile buckets."""
    o = kept(spark, d)
    return RL.batch_reliability(phi2(o), scores2(o), weights2(o), RATIO)


@query("bucket_fixed", _rr_sql("""SELECT dataset, model, row_id, CASE WHEN reliability_score IS NULL THEN 'Unknown'
  WHEN reliability_score >= 0.6 THEN 'Reliable' WHEN reliability_score >= 0.4 THEN 'Moderately Reliable'
  WHEN reliability_score >= 0.2 THEN 'Questionable' ELSE 'Unreliable' END AS bucket FROM rr"""), views=V)
def q_bucket_fixed(spark, d):
    """Fixed-cut buckets (.60 / .40 / .20) of the row reliability scores."""
    return rowrel(kept(spark, d)).select("dataset", "model", "row_id", RL.bucket_fixed(F.col("reliability_score")).alias("bucket"))


@query("bucket_strict", _rr_sql("""SELECT dataset, model, row_id, CASE WHEN global_reliability IS NULL THEN 'Unknown'
  WHEN global_reliability >= 0.75 THEN 'Reliable' WHEN global_reliability >= 0.5 THEN 'Moderately Reliable'
  WHEN global_reliability >= 0.3 THEN 'Questionable' ELSE 'Unreliable' END AS bucket FROM rr"""), views=V)
def q_bucket_strict(spark, d):
    """Strict-cut buckets (.75 / .50 / .30) of the global reliability carried by each row."""
    return rowrel(kept(spark, d)).select("dataset", "model", "row_id", RL.bucket_strict(F.col("global_reliability")).alias("bucket"))


@query("bucket_quantile", _rr_sql("SELECT dataset, model, row_id, reliability_bucket FROM br"), views=V)
def q_bucket_quantile(spark, d):
    """Buckets by the batch's own quartiles of reliability, per dataset."""
    return RL.bucket_quantile(rowrel(kept(spark, d)), group=["dataset", "model"]).select(
        "dataset", "model", "row_id", "reliability_bucket")


@query("bucket_bounds", _rr_sql("""SELECT dataset, model, 'Unreliable' AS bucket, smin AS lower_bound, q1 AS upper_bound,
  'Bottom 25% of reliability scores (least reliable)' AS description FROM qq
UNION ALL SELECT dataset, model, 'Questionable', q1, q2, '25–50% quantile (questionable)' FROM qq
UNION ALL SELECT dataset, model, 'Moderately Reliable', q2, q3, '50–75% quantile (moderately reliable)' FROM qq
UNION ALL SELECT dataset, model, 'Reliable', q3, smax, 'Top 25% of reliability scores (most reliable)' FROM qq"""),
       views=V, rnd=["lower_bound", "upper_bound"])
def q_bucket_bounds(spark, d):
    """The four quantile buckets with their bounds per dataset."""
    return RL.bucket_bounds(rowrel(kept(spark, d)), group=["dataset", "model"])


@query("row_shares", _rr_sql("SELECT dataset, model, row_id, feature, phi, W, share, W * share AS weighted FROM sh"),
       views=V, rnd=["phi", "W", "share", "weighted"])
def q_row_shares(spark, d):
    """Local |phi| shares and weighted shares of every feature in every row."""
    o = kept(spark, d)
    return RL.row_shares(phi2(o), weights2(o))


@query("row_reliability_simple", _rr_sql(f"""SELECT *, CASE WHEN reliability_score >= 0.75 THEN 'Reliable'
  WHEN reliability_score >= 0.5 THEN 'Moderately Reliable' WHEN reliability_score >= 0.3 THEN 'Questionable'
  ELSE 'Unreliable' END AS reliability_bucket FROM (SELECT dataset, model, row_id,
  least(1, greatest(0, {_lit(min(RATIO, 3.0) / 3.0)} * sum(W * share))) AS reliability_score FROM sh GROUP BY ALL)"""),
       views=V, rnd=["reliability_score"])
def q_row_reliability_simple(spark, d):
    """R = clip(W_signal * sum W share) with the strict bucket, every order."""
    o = kept(spark, d)
    return RL.row_reliability_simple(phi2(o), ranks2(o), RATIO)


@query("reliability_summary_stats", _rr_sql("""SELECT dataset, model, CAST(count(reliability_score) AS DOUBLE) AS count,
  avg(reliability_score) AS mean, stddev_samp(reliability_score) AS std, min(reliability_score) AS min,
  quantile_cont(reliability_score, 0.25) AS q25, quantile_cont(reliability_score, 0.5) AS q50,
  quantile_cont(reliability_score, 0.75) AS q75, max(reliability_score) AS max FROM rr GROUP BY ALL"""), views=V,
       rnd=["count", "mean", "std", "min", "q25", "q50", "q75", "max"])
def q_reliability_summary_stats(spark, d):
    """count, mean, std, min, quartiles, max of the row reliability per dataset."""
    return RL.reliability_summary_stats(rowrel(kept(spark, d)), group=["dataset", "model"])


@query("bucket_counts", _rr_sql("SELECT dataset, model, reliability_bucket, count(*) AS n FROM br GROUP BY ALL"), views=V)
def q_bucket_counts(spark, d):
    """Rows per quantile bucket per dataset."""
    o = kept(spark, d)
    b = RL.batch_reliability(phi2(o), scores2(o), weights2(o), RATIO)
    return RL.bucket_counts(b, group=["dataset", "model"])


@query("stability_classes", f"""WITH {PHI}, {RANKS}, t AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY avg_rank, feature) <= 3 AS is_top FROM rk),
c AS (SELECT *, CASE WHEN is_top THEN 'top' WHEN std_rank IS NULL THEN 'unstable' WHEN std_rank < 0.5 THEN 'stable'
  WHEN std_rank < 1.0 THEN 'moderate' ELSE 'unstable' END AS class FROM t),
a AS (SELECT model, max(CASE WHEN is_top THEN coalesce(std_rank, 'inf'::DOUBLE) END) AS tm,
  sum(CASE WHEN class = 'unstable' THEN 1 ELSE 0 END) AS nu FROM c GROUP BY model)
SELECT feature, avg_rank, std_rank, is_top, class,
  CASE WHEN tm <= 0.05 THEN 'identical' WHEN tm <= 0.3 THEN 'very small variation' ELSE 'some variation' END AS top_label,
  '{'genuine' if RATIO >= 0.95 else ('useful' if RATIO >= 0.85 else 'noisy')}' AS ratio_band,
  CASE WHEN {str(RATIO >= 0.95).lower()} AND nu = 0 THEN 'stable' WHEN {str(RATIO >= 0.85).lower()} THEN 'caution'
  ELSE 'advise_more_trials' END AS conclusion FROM c JOIN a USING (model)""", views=V, rnd=["avg_rank", "std_rank"])
def q_stability_classes(spark, d):
    """Top-3 features, stability class of the rest, and the verdict codes."""
    return RL.stability_classes(ranks(spark, d).drop("model"), RATIO)


@query("bootstrap_auc")
def q_bootstrap_auc(spark, d):
    """50 bootstrap AUCs of the three orders scorers (rows resampled per dataset): mean, std, 95 % interval."""
    from scorelab.sources.bindings import scores_orders

    return RL.bootstrap_auc(scores_orders(spark, d), 50, 42)


@query("bootstrap_summary")
def q_bootstrap_summary(spark, d):
    """Bootstrap AUC of each dataset's benchmark (best-AUC) model."""
    from scorelab.operators.benchmark import best_per_dataset
    from scorelab.operators.metrics import metric_auc
    from scorelab.sources.bindings import scores_orders

    s = scores_orders(spark, d)
    best = best_per_dataset(metric_auc(s), "AUC")
    return RL.bootstrap_summary(RL.bootstrap_auc(s, 50, 42), best)
