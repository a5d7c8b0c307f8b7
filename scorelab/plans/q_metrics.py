"""Registered queries: scoring metrics on ``scores_orders``."""

from __future__ import annotations

from scorelab.operators import metrics as M
from scorelab.plans.catalog import query
from scorelab.sources.bindings import credit_orders, scores_orders

G = "dataset, model_group, model"

# DuckDB text of the score curve: histogram, inclusive running sums, group totals, train tau.
CURVE = f"""
t AS (SELECT dataset, avg(y) AS tau FROM credit_orders GROUP BY dataset),
h AS (SELECT {G}, p, sum(y) AS pos, sum(1 - y) AS neg FROM scores_orders GROUP BY {G}, p),
c AS (SELECT h.*, t.tau,
        sum(pos) OVER (PARTITION BY {G} ORDER BY p) AS cum_pos,
        sum(neg) OVER (PARTITION BY {G} ORDER BY p) AS cum_neg,
        sum(pos) OVER (PARTITION BY {G}) AS npos,
        sum(neg) OVER (PARTITION BY {G}) AS nneg
      FROM h JOIN t USING (dataset)),
b AS (SELECT {G}, any_value(npos) AS npos, any_value(nneg) AS nneg, any_value(tau) AS tau,
        sum(pos * (cum_neg - neg + neg / 2)) AS auc_num,
        max(abs(cum_pos / greatest(npos, 1) - cum_neg / greatest(nneg, 1))) AS KS,
        sum(pos * (1 - p) * (1 - p) + neg * p * p) AS sq,
        sum(CASE WHEN p > tau THEN pos ELSE 0 END) AS tp,
        sum(CASE WHEN p > tau THEN neg ELSE 0 END) AS fp,
        sum(CASE WHEN p <= 0.4 THEN pos * (cum_neg - neg + neg / 2) ELSE 0 END) AS pg_num,
        sum(CASE WHEN p <= 0.4 THEN pos ELSE 0 END) AS pg_p,
        sum(CASE WHEN p <= 0.4 THEN neg ELSE 0 END) AS pg_n,
        min(p) AS pmin, max(p) AS pmax
      FROM c GROUP BY {G}),
m AS (SELECT {G},
        CASE WHEN npos > 0 AND nneg > 0 THEN auc_num / (npos * nneg) END AS AUC,
        (tp + (nneg - fp)) / (npos + nneg) AS PCC,
        CASE WHEN 2 * tp + fp + (npos - tp) > 0 THEN 2 * tp / (2 * tp + fp + (npos - tp)) ELSE 0 END AS F1,
        CASE WHEN npos > 0 THEN tp / npos ELSE 0 END AS Recall,
        sq / (npos + nneg) AS BS, KS,
        CASE WHEN pg_p + pg_n >= 2 AND pg_p > 0 AND pg_n > 0 THEN 2 * (pg_num / (pg_p * pg_n)) - 1 END AS PG
      FROM b)"""

HSQL = f"""
grid AS (SELECT i AS cost_idx, c AS cost, 6 * c * (1 - c) / sum(6 * c * (1 - c)) OVER () AS w
         FROM (SELECT i, 0.5 - sin(asin(1 - 2 * (1e-6 + i * ((1 - 2e-6) / 999))) / 3) AS c
               FROM (SELECT range AS i FROM range(1000)))),
roc AS (SELECT {G}, tau, (nneg - cum_neg + neg) / nneg AS fpr, (cum_pos - pos) / npos AS fnr
        FROM c WHERE npos > 0 AND nneg > 0),
hl AS (SELECT {G}, cost_idx, any_value(cost) AS cost, any_value(w) AS w, any_value(tau) AS tau,
              min(cost * tau * fnr + (1 - cost) * (1 - tau) * fpr) AS loss
       FROM roc, grid GROUP BY {G}, cost_idx),
he AS (SELECT {G}, sum(w * least(loss, cost * tau)) AS emc,
              sum(w * least(cost * tau, (1 - cost) * (1 - tau))) AS emc0
       FROM hl GROUP BY {G}),
hm AS (SELECT b.dataset, b.model_group, b.model,
              CASE WHEN b.pmin = b.pmax OR he.emc0 <= 0 OR he.emc IS NULL THEN NULL
                   ELSE least(1, greatest(0, 1 - he.emc / he.emc0)) END AS H
       FROM b LEFT JOIN he USING ({G}))"""

ALL8 = ["AUC", "PCC", "F1", "Recall", "BS", "KS", "PG", "H"]


def _scores(spark, d):
    return scores_orders(spark, d)


def _tau(spark, d):
    return M.metric_prevalence(credit_orders(spark, d), ["dataset"])


@query("metric_bundle",
       f"WITH {CURVE}, {HSQL} SELECT {G}, AUC, PCC, F1, Recall, BS, KS, PG, H FROM m JOIN hm USING ({G})",
       views=("credit_orders", "scores_orders"), rnd=ALL8)
def q_metric_bundle(spark, d):
    """All 8 credit metrics per (dataset, group, model); tau and pi+ from the train base."""
    return M.metric_bundle(_scores(spark, d), _tau(spark, d))


@query("metric_bundle_selfbase",
       f"""WITH {CURVE.replace("h.*, t.tau,", "h.*, sum(pos) OVER (PARTITION BY " + G + ") / (sum(pos) OVER (PARTITION BY " + G + ") + sum(neg) OVER (PARTITION BY " + G + ")) AS tau,").replace("FROM h JOIN t USING (dataset)", "FROM h")}, {HSQL}
       SELECT {G}, AUC, PCC, F1, Recall, BS, KS, PG, H FROM m JOIN hm USING ({G})""",
       views=("credit_orders", "scores_orders"), rnd=ALL8)
def q_metric_bundle_selfbase(spark, d):
    """Bundle with the test prevalence of each model's rows as tau and pi+."""
    return M.metric_bundle_selfbase(_scores(spark, d))


def _single(key, col, fn, rnd=True):
    @query(key, f"WITH {CURVE} SELECT {G}, {col} FROM m", views=("credit_orders", "scores_orders"),
           rnd=[col] if rnd else [])
    def q(spark, d):
        return fn(spark, d)

    q.__doc__ = f"{col} per (dataset, group, model) over scores_orders."
    return q


_single("metric_auc", "AUC", lambda s, d: M.metric_auc(_scores(s, d)))
_single("metric_pcc", "PCC", lambda s, d: M.metric_pcc(_scores(s, d), _tau(s, d)))
_single("metric_f1", "F1", lambda s, d: M.metric_f1(_scores(s, d), _tau(s, d)))
_single("metric_recall", "Recall", lambda s, d: M.metric_recall(_scores(s, d), _tau(s, d)))
_single("metric_ks", "KS", lambda s, d: M.metric_ks(_scores(s, d)))
_single("metric_partial_gini", "PG", lambda s, d: M.metric_partial_gini(_scores(s, d), 0.4))


@query("metric_brier", f"SELECT {G}, avg((p - y) * (p - y)) AS BS FROM scores_orders GROUP BY {G}",
       views=("scores_orders",), rnd=["BS"])
def q_metric_brier(spark, d):
    """Brier score per model."""
    return M.metric_brier(_scores(spark, d))


@query("metric_gini", f"WITH {CURVE} SELECT {G}, 2 * AUC - 1 AS Gini FROM m",
       views=("credit_orders", "scores_orders"), rnd=["Gini"])
def q_metric_gini(spark, d):
    """Gini = 2 AUC - 1."""
    return M.metric_gini(_scores(spark, d))


@query("metric_h", f"WITH {CURVE}, {HSQL} SELECT {G}, H FROM hm",
       views=("credit_orders", "scores_orders"), rnd=["H"])
def q_metric_h(spark, d):
    """Hand's H-measure, Beta(2,2) costs on 1000 quantiles, pi+ from the train base."""
    return M.metric_h(_scores(spark, d), _tau(spark, d))


@query("metric_prevalence", "SELECT dataset, avg(y) AS tau FROM credit_orders GROUP BY dataset",
       views=("credit_orders",), rnd=["tau"])
def q_metric_prevalence(spark, d):
    """tau = share of class 1 in the base rows, per dataset."""
    return _tau(spark, d)


@query("roc_points", f"""WITH {CURVE}
SELECT {G}, p AS threshold, (nneg - cum_neg + neg) / nneg AS fpr, (npos - cum_pos + pos) / npos AS tpr FROM c
WHERE npos > 0 AND nneg > 0
UNION ALL SELECT DISTINCT {G}, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM c WHERE npos > 0 AND nneg > 0""",
       views=("credit_orders", "scores_orders"), rnd=["threshold", "fpr", "tpr"])
def q_roc_points(spark, d):
    """ROC curve points (threshold, fpr, tpr) per model, starting at (inf, 0, 0)."""
    return M.roc_points(_scores(spark, d))


CONF = f"""SELECT {G},
  CAST(sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN p >= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN p < 0.5 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN p < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
FROM scores_orders GROUP BY {G}"""


@query("confusion", CONF, views=("scores_orders",))
def q_confusion(spark, d):
    """tp, fp, tn, fn at threshold 0.5 (p >= t)."""
    return M.confusion(_scores(spark, d), 0.5)


@query("class_report", f"""WITH cm AS ({CONF}),
v AS (SELECT {G},
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1,
  CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0,
  CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0,
  CAST(tp + fn AS DOUBLE) AS s1, CAST(tn + fp AS DOUBLE) AS s0 FROM cm),
f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1,
             CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0 FROM v)
SELECT {G}, '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
UNION ALL SELECT {G}, '1', p1, r1, f1, s1 FROM f
UNION ALL SELECT {G}, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
UNION ALL SELECT {G}, 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
                 (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM f""",
       views=("scores_orders",), rnd=["precision", "recall", "f1", "support"])
def q_class_report(spark, d):
    """Precision, recall, F1, support per class and averaged, at 0.5."""
    return M.class_report(_scores(spark, d), 0.5)
