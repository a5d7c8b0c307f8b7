"""Registered queries: paired and two-sample tests on the orders scorers.

p-values need erfc, which neither SQL engine has; the registered outputs carry the statistics
(stat, z, chi2, variance) and the p-values are checked in the pytest suite against math.erfc.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelab.operators import paired as T
from scorelab.plans.catalog import query
from scorelab.plans.ranks import midrank
from scorelab.sources.bindings import scores_orders

V = ("scores_orders",)
PAIR = """pr AS (SELECT dataset, row_id, any_value(y) AS y, max(CASE WHEN model = 'lin_a' THEN p END) AS pa,
  max(CASE WHEN model = 'lin_b' THEN p END) AS pb FROM scores_orders WHERE model IN ('lin_a', 'lin_b')
  GROUP BY dataset, row_id)"""


def pairs(spark, d):
    return T.pair_scores(scores_orders(spark, d), "lin_a", "lin_b")


@query("pair_scores", f"WITH {PAIR} SELECT * FROM pr WHERE pa IS NOT NULL AND pb IS NOT NULL", views=V,
       rnd=["pa", "pb"])
def q_pair_scores(spark, d):
    """lin_a and lin_b aligned on the same rows per dataset."""
    return pairs(spark, d)


@query("midrank", """SELECT *, (rank() OVER w + rank() OVER w + count(*) OVER (PARTITION BY dataset, model, p) - 1) / 2
  AS midrank FROM scores_orders WINDOW w AS (PARTITION BY dataset, model ORDER BY p)""", views=V,
       rnd=["p", "midrank"])
def q_midrank(spark, d):
    """Average rank (ties share the mean rank) of every score within (dataset, model)."""
    s = scores_orders(spark, d)
    return midrank(s, ["dataset", "model"], "p")


WSQL = f"""WITH {PAIR}, dd AS (SELECT dataset, abs(pa - y) - abs(pb - y) AS d FROM pr),
nz AS (SELECT dataset, abs(d) AS ad, d > 0 AS plus FROM dd WHERE d <> 0),
r AS (SELECT dataset, ad, plus, (rank() OVER w + rank() OVER w + count(*) OVER (PARTITION BY dataset, ad) - 1) / 2 AS mr
      FROM nz WINDOW w AS (PARTITION BY dataset ORDER BY ad)),
tt AS (SELECT dataset, ad, count(*) AS t FROM nz GROUP BY ALL),
s AS (SELECT dataset, sum(CASE WHEN plus THEN mr ELSE 0 END) AS rp, sum(CASE WHEN NOT plus THEN mr ELSE 0 END) AS rm,
      count(*) AS n FROM r GROUP BY dataset),
tc AS (SELECT dataset, sum(t * t * t - t) AS ties FROM tt GROUP BY dataset),
md AS (SELECT dataset, quantile_cont(d, 0.5) AS median_diff FROM dd GROUP BY dataset),
j AS (SELECT md.dataset, md.median_diff, s.rp, s.rm, s.n, tc.ties FROM md LEFT JOIN s USING (dataset) LEFT JOIN tc USING (dataset))
SELECT dataset, coalesce(least(rp, rm), 0.0)::DOUBLE AS stat,
  CASE WHEN n * (n + 1) * (2 * n + 1) / 24 - ties / 48 > 0 THEN
    (least(rp, rm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) END AS z,
  coalesce(median_diff, 0.0) AS median_diff, CAST(coalesce(n, 0) AS BIGINT) AS n_nonzero FROM j"""


@query("wilcoxon_abs_error", WSQL, views=V, rnd=["stat", "z", "median_diff"])
def q_wilcoxon(spark, d):
    """Signed-rank test of |error| of lin_a vs lin_b: stat, z, median difference (p in pytest)."""
    return T.wilcoxon_abs_error(pairs(spark, d)).drop("p_value")


MSQL = f"""WITH {PAIR}, t AS (SELECT dataset,
  CAST(sum(CASE WHEN (CAST(pa > 0.5 AS INTEGER) = y) AND NOT (CAST(pb > 0.5 AS INTEGER) = y) THEN 1 ELSE 0 END) AS BIGINT) AS b,
  CAST(sum(CASE WHEN NOT (CAST(pa > 0.5 AS INTEGER) = y) AND (CAST(pb > 0.5 AS INTEGER) = y) THEN 1 ELSE 0 END) AS BIGINT) AS c
  FROM pr GROUP BY dataset)
SELECT dataset, b, c, CASE WHEN b + c > 0 THEN power(abs(b - c) - 1, 2) / (b + c) END AS chi2 FROM t"""


@query("mcnemar", MSQL, views=V, rnd=["chi2"])
def q_mcnemar(spark, d):
    """McNemar discordant counts and continuity-corrected chi2 of lin_a vs lin_b (p in pytest)."""
    return T.mcnemar(pairs(spark, d), 0.5).drop("p_value")


def _place(col):
    return f"""SELECT dataset, p AS {col}, (cum_neg - neg + neg / 2) / nn AS v10, 1 - (cum_pos - pos + pos / 2) / np AS v01
  FROM (SELECT *, sum(pos) OVER (PARTITION BY dataset ORDER BY p) AS cum_pos, sum(neg) OVER (PARTITION BY dataset ORDER BY p) AS cum_neg,
         sum(pos) OVER (PARTITION BY dataset) AS np, sum(neg) OVER (PARTITION BY dataset) AS nn
        FROM (SELECT dataset, {col} AS p, sum(y) AS pos, sum(1 - y) AS neg FROM pr GROUP BY dataset, {col}))"""


DSQL = f"""WITH {PAIR}, ca AS ({_place('pa')}), cb AS ({_place('pb')}),
rw AS (SELECT pr.dataset, pr.y, ca.v10 AS v10_a, ca.v01 AS v01_a, cb.v10 AS v10_b, cb.v01 AS v01_b
       FROM pr JOIN ca ON pr.dataset = ca.dataset AND pr.pa = ca.pa JOIN cb ON pr.dataset = cb.dataset AND pr.pb = cb.pb),
ps AS (SELECT dataset, avg(v10_a) AS auc1, avg(v10_b) AS auc2, var_samp(v10_a) AS s10_aa, var_samp(v10_b) AS s10_bb,
       covar_samp(v10_a, v10_b) AS s10_ab, count(*) AS m FROM rw WHERE y = 1 GROUP BY dataset),
ng AS (SELECT dataset, var_samp(v01_a) AS s01_aa, var_samp(v01_b) AS s01_bb, covar_samp(v01_a, v01_b) AS s01_ab,
       count(*) AS n FROM rw WHERE y = 0 GROUP BY dataset),
v AS (SELECT ps.dataset, auc1, auc2, auc1 - auc2 AS auc_diff,
       coalesce(s10_aa + s10_bb - 2 * s10_ab, 0) / m + coalesce(s01_aa + s01_bb - 2 * s01_ab, 0) / n AS var
      FROM ps JOIN ng USING (dataset))
SELECT *, CASE WHEN var > 1e-300 THEN auc_diff / sqrt(var) END AS z FROM v"""


@query("delong", DSQL, views=V, rnd=["auc1", "auc2", "auc_diff", "var", "z"])
def q_delong(spark, d):
    """DeLong test of lin_a vs lin_b per dataset: AUCs, difference, variance, z (p in pytest)."""
    return T.delong(pairs(spark, d)).drop("p_value")


@query("paired_comparison")
def q_paired_comparison(spark, d):
    """The three paired tests of lin_a vs lin_b per dataset as one nested record."""
    return T.paired_comparison(scores_orders(spark, d), "lin_a", "lin_b")


@query("paired_statistics", f"""SELECT dataset, w.stat AS wilcoxon_stat, w.median_diff, m.b, m.c, m.chi2, d.auc1, d.auc2, d.auc_diff, d.var, d.z
FROM ({WSQL}) w JOIN ({MSQL}) m USING (dataset) JOIN ({DSQL}) d USING (dataset)""", views=V,
       rnd=["wilcoxon_stat", "median_diff", "chi2", "auc1", "auc2", "auc_diff", "var", "z"])
def q_paired_statistics(spark, d):
    """The statistics of ``paired_comparison``'s record as columns (its p-values need erfc)."""
    r = T.paired_comparison(scores_orders(spark, d), "lin_a", "lin_b")
    return r.select("dataset", F.col("wilcoxon.statistic").alias("wilcoxon_stat"), F.col("wilcoxon.median_abs_error_diff").alias("median_diff"),
                    *[F.col(f"mcnemar.{c}") for c in ("b", "c", "chi2")], *[F.col(f"delong.{c}") for c in ("auc1", "auc2", "auc_diff", "var", "z")])


def rel(spark, d):
    """Reliability-style rows: coarse score as the reliability of lin_a's decisions at 0.5."""
    pr = T.pair_scores(scores_orders(spark, d), "lin_a", "coarse")
    return pr.select("dataset", F.col("pb").alias("reliability_score"),
                     (F.col("pa") > 0.5).cast("int").alias("pred_default"), F.col("y").alias("actual_default"))


REL = """rl AS (SELECT dataset, max(CASE WHEN model = 'coarse' THEN p END) AS score,
  CAST(CAST(max(CASE WHEN model = 'lin_a' THEN p END) > 0.5 AS INTEGER) = any_value(y) AS INTEGER) AS correct
  FROM scores_orders WHERE model IN ('lin_a', 'coarse') GROUP BY dataset, row_id),
h AS (SELECT dataset, score, sum(correct) AS pos, sum(1 - correct) AS neg FROM rl GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER (PARTITION BY dataset ORDER BY score) AS cp, sum(neg) OVER (PARTITION BY dataset ORDER BY score) AS cn,
      sum(pos) OVER (PARTITION BY dataset) AS n1, sum(neg) OVER (PARTITION BY dataset) AS n2 FROM h)"""


KS_SQL = f"""WITH {REL} SELECT dataset, max(abs(cp / n1 - cn / n2)) AS ks_stat,
  CAST(any_value(n1) AS BIGINT) AS n_correct, CAST(any_value(n2) AS BIGINT) AS n_wrong FROM c GROUP BY dataset"""


@query("two_sample_ks", KS_SQL, views=V, rnd=["ks_stat"])
def q_two_sample_ks(spark, d):
    """KS distance between scores of correct and wrong decisions (p in pytest)."""
    return T.two_sample_ks(rel(spark, d), ["dataset"]).drop("ks_pvalue")


MW_SQL = f"""WITH {REL}, s AS (SELECT dataset,
  sum(pos * (cp + cn - (pos + neg) + (pos + neg + 1) / 2)) AS r1, any_value(n1)::DOUBLE AS n1, any_value(n2)::DOUBLE AS n2,
  sum((pos + neg) * (pos + neg) * (pos + neg) - (pos + neg)) AS ties FROM c GROUP BY dataset)
SELECT dataset, r1 - n1 * (n1 + 1) / 2 AS mw_stat,
  (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS mw_z
FROM s"""


@query("mann_whitney", MW_SQL, views=V, rnd=["mw_stat", "mw_z"])
def q_mann_whitney(spark, d):
    """Mann-Whitney U (correct > wrong) and its z (p in pytest)."""
    return T.mann_whitney(rel(spark, d), ["dataset"]).drop("mw_pvalue")


AUC_SQL = f"""WITH {REL} SELECT dataset, CASE WHEN any_value(n1) > 0 AND any_value(n2) > 0 THEN
  sum(pos * (cn - neg / 2)) / (any_value(n1) * any_value(n2)) END AS roc_auc FROM c GROUP BY dataset"""


@query("correctness_auc", AUC_SQL, views=V, rnd=["roc_auc"])
def q_correctness_auc(spark, d):
    """AUC of the reliability score for correct vs wrong decisions."""
    return T.correctness_auc(rel(spark, d), ["dataset"])


@query("diagnostic_bands", f"""SELECT *, CASE WHEN roc_auc IS NULL THEN 'unknown' WHEN roc_auc >= 0.8 THEN 'strong'
  WHEN roc_auc >= 0.7 THEN 'moderate' WHEN roc_auc >= 0.6 THEN 'weak' ELSE 'none' END AS auc_band FROM ({AUC_SQL})""",
       views=V, rnd=["roc_auc"])
def q_diagnostic_bands(spark, d):
    """Separation band of the correctness AUC."""
    return T.diagnostic_bands(T.correctness_auc(rel(spark, d), ["dataset"]), p_col=None)


@query("univariate_logit")
def q_univariate_logit(spark, d):
    """correct ~ reliability score: unpenalised logit coefficient, LR-test p, McFadden R2, Wald p."""
    return T.univariate_logit(rel(spark, d), ["dataset"])


@query("reliability_diagnostics")
def q_reliability_diagnostics(spark, d):
    """KS, Mann-Whitney, AUC and logit test of the reliability score in one row per dataset."""
    return T.reliability_diagnostics(rel(spark, d), ["dataset"])


@query("diagnostic_statistics", f"""SELECT dataset, ks_stat, n_correct, n_wrong, mw_stat, roc_auc
FROM ({KS_SQL}) JOIN ({MW_SQL}) USING (dataset) JOIN ({AUC_SQL}) USING (dataset)""", views=V, rnd=["ks_stat", "mw_stat", "roc_auc"])
def q_diagnostic_statistics(spark, d):
    """The statistics of ``reliability_diagnostics`` (p-values and the logit fit are held by pytest)."""
    return T.reliability_diagnostics(rel(spark, d), ["dataset"], with_logit=False).select("dataset", "ks_stat", "n_correct", "n_wrong", "mw_stat", "roc_auc")
