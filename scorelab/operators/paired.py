"""Paired and two-sample tests.

All rank statistics come from one collapsed two-class histogram per group plus the bucketed
running totals (``metrics.score_curve``): the midrank of a value is ``before + (count + 1) / 2``,
so rank sums, DeLong placements and KS gaps are sums and maxima over distinct values. No row is
ever ranked inside one task, and no sample is kept in memory.

p-values need the normal / chi-square / Kolmogorov tails, which Spark SQL lacks (no ``erf``); they
are computed by a small pandas UDF over the one-row-per-group result, never over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelab.operators.metrics import score_curve
from scorelab.plans.ranks import SMALL, exact_quantiles, running_totals
from scorelab.session import cut_lineage


# ---------------------------------------------------------------- tails (vectorised, per result row)

def _norm_sf(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2.0)) if v == v else np.nan for v in z])


@F.pandas_udf(T.DoubleType())
def norm_two_sided_p(z: pd.Series) -> pd.Series:
    """2 * P(Z > |z|)."""
    return pd.Series(2.0 * _norm_sf(np.abs(z.to_numpy(dtype=float))))


@F.pandas_udf(T.DoubleType())
def norm_sf(z: pd.Series) -> pd.Series:
    """P(Z > z)."""
    return pd.Series(_norm_sf(z.to_numpy(dtype=float)))


@F.pandas_udf(T.DoubleType())
def chi2_1_sf(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom: erfc(sqrt(x / 2))."""
    return pd.Series([math.erfc(math.sqrt(v / 2.0)) if v == v and v >= 0 else np.nan
                      for v in x.to_numpy(dtype=float)])


def _kolmogorov_q(lam: float) -> float:
    if lam != lam:
        return float("nan")
    if lam < 1e-3:
        return 1.0
    s = 0.0
    for k in range(1, 101):
        term = 2.0 * (-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam)
        s += term
        if abs(term) < 1e-16:
            break
    return min(1.0, max(0.0, s))


@F.pandas_udf(T.DoubleType())
def ks_asymptotic_p(lam: pd.Series) -> pd.Series:
    """Kolmogorov limiting distribution Q(lambda) = 2 sum (-1)^(k-1) exp(-2 k^2 lambda^2)."""
    return pd.Series([_kolmogorov_q(v) for v in lam.to_numpy(dtype=float)])


# ---------------------------------------------------------------- aligning two models

def pair_scores(scores: DataFrame, model_a: str | tuple[str, str], model_b: str | tuple[str, str],
                group: Sequence[str] = ("dataset",)) -> DataFrame:
    """dataset, row_id, y, pa, pb: the two models on the same rows.

    A model is named by (model_group, model). A plain name will do while only one group has it;
    a row scored by two groups under a plain name raises an error instead of mixing them.

    One conditional aggregation by (dataset, row_id) instead of a self join: a single shuffle
    of the two models' rows; rows scored by only one model are dropped (inner semantics)."""
    g = list(group)

    def is_(m: str | tuple[str, str]) -> Column:
        return F.col("model") == m if isinstance(m, str) else (F.col("model_group") == m[0]) & (F.col("model") == m[1])

    two = scores.where(is_(model_a) | is_(model_b))
    only = lambda m: F.max(F.when(is_(m), F.col("p")))
    twice = F.raise_error(F.lit(f"rows scored more than once by {model_a} or {model_b}: name the model group")).cast("double")
    agg = two.groupBy(*g, "row_id").agg(
        F.first("y").alias("y"), only(model_a).alias("pa"), only(model_b).alias("pb"),
        F.greatest(F.count(F.when(is_(model_a), 1)), F.count(F.when(is_(model_b), 1))).alias("_n"),
    )
    agg = agg.where(F.col("pa").isNotNull() & F.col("pb").isNotNull())
    return agg.select(*g, "row_id", "y", F.when(F.col("_n") == 1, F.col("pa")).otherwise(twice).alias("pa"), "pb")


# ---------------------------------------------------------------- Wilcoxon signed rank on |error|

def wilcoxon_abs_error(pairs: DataFrame, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """stat = min(R+, R-) over d = |pa - y| - |pb - y| with zeros dropped (``wilcox``), normal
    approximation with tie correction for p, median of all d. All-zero d -> (0, 1, 0)."""
    g = list(group)
    diff = F.abs(F.col("pa") - F.col("y")) - F.abs(F.col("pb") - F.col("y"))
    d = cut_lineage(pairs.select(*g, diff.alias("d")))  # written once: the ranks, the median and the groups come from it
    signed = lambda plus: F.sum(((F.col("d") > 0) == F.lit(plus)).cast("long"))
    sizes = d.where("d <> 0 and d is not null").groupBy(*g, F.abs("d").alias("ad")).agg(signed(True).alias("pos"), signed(False).alias("neg"))
    curve = running_totals(sizes.withColumn("cnt", F.col("pos") + F.col("neg")), g, "ad", ["cnt"])
    cnt = F.col("cnt")
    mid = F.col("cum_cnt") - cnt + (cnt + 1) / 2.0
    stats = curve.groupBy(*g).agg(
        F.sum(F.col("pos") * mid).alias("r_plus"), F.sum(F.col("neg") * mid).alias("r_minus"),
        F.sum(cnt).alias("n"), F.sum(cnt * cnt * cnt - cnt).alias("ties"))
    med = exact_quantiles(d, ["d"], [0.5], group=g).select(*g, F.col("value").alias("median_diff"))
    allg = d.select(*g).distinct()
    j = allg.join(stats, g, "left").join(med, g, "left")
    n = F.col("n").cast("double")
    stat = F.least("r_plus", "r_minus")
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    z = F.when(var > 0, (stat - mean) / F.sqrt(var))
    out = j.select(*g, F.coalesce(stat, F.lit(0.0)).cast("double").alias("stat"), z.alias("z"),
                   F.coalesce(F.col("median_diff"), F.lit(0.0)).alias("median_diff"),
                   F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_nonzero"))
    return out.withColumn("p_value", F.when(F.col("n_nonzero") == 0, F.lit(1.0)).otherwise(norm_two_sided_p("z")))


# ---------------------------------------------------------------- McNemar

def mcnemar(pairs: DataFrame, threshold: float = 0.5, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """b = A right & B wrong, c = A wrong & B right (predicted 1 iff p > t); continuity-corrected
    chi2 = (|b - c| - 1)^2 / (b + c); null when b + c = 0."""
    g = list(group)
    ra = (F.col("pa") > threshold).cast("int") == F.col("y")
    rb = (F.col("pb") > threshold).cast("int") == F.col("y")
    t = pairs.groupBy(*g).agg(F.sum(F.when(ra & ~rb, 1).otherwise(0)).cast("long").alias("b"),
                              F.sum(F.when(~ra & rb, 1).otherwise(0)).cast("long").alias("c"))
    bc = F.col("b") + F.col("c")
    chi = F.when(bc > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / bc)
    return t.select(*g, "b", "c", chi.alias("chi2")).withColumn("p_value", chi2_1_sf("chi2"))


# ---------------------------------------------------------------- DeLong

def _placements(pairs: DataFrame, g: list[str], col: str, tag: str) -> DataFrame:
    side = lambda y: F.sum(F.when(F.col("y") == y, F.col("c")).otherwise(0))
    hist = pairs.groupBy(*g, col).agg(side(1).alias("pos"), side(0).alias("neg"))
    c = running_totals(hist, g, col, ["pos", "neg"])
    v10 = (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0) / F.col("tot_neg")  # for positives
    v01 = 1.0 - (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0) / F.col("tot_pos")  # for negatives
    return c.select(*g, col, v10.alias(f"v10_{tag}"), v01.alias(f"v01_{tag}"))


def delong(pairs: DataFrame, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """auc1, auc2, auc_diff, var, z, p_value by DeLong et al. (1988) with midrank placements
    (Sun & Xu 2014). A zero variance gives z = null and p = 1 when the AUCs are equal."""
    g = list(group)
    # (scores, class) counts, written once: totals, both curves and the moments read them
    both = cut_lineage(pairs.where(F.col("y").isNotNull()).groupBy(*g, "pa", "pb", "y").agg(F.count(F.lit(1)).alias("c")))
    ok = both.groupBy(*g).agg(F.sum(F.col("y") * F.col("c")).alias("_m"), F.sum((1 - F.col("y")) * F.col("c")).alias("_n"))
    rows = both.join(_placements(both, g, "pa", "a"), [*g, "pa"]).join(_placements(both, g, "pb", "b"), [*g, "pb"])
    c = F.col("c")
    moment = lambda y, x, z: F.sum(F.when(F.col("y") == y, c * F.col(x) * F.col(z)))
    total = lambda y, x: F.sum(F.when(F.col("y") == y, c * F.col(x)))
    kinds = {"s10_aa": (1, "v10_a", "v10_a"), "s10_bb": (1, "v10_b", "v10_b"), "s10_ab": (1, "v10_a", "v10_b"),
             "s01_aa": (0, "v01_a", "v01_a"), "s01_bb": (0, "v01_b", "v01_b"), "s01_ab": (0, "v01_a", "v01_b")}
    size = lambda y: F.sum(F.when(F.col("y") == y, c))
    cov = lambda y, x, z: F.when(size(y) > 1, (moment(y, x, z) - total(y, x) * total(y, z) / size(y)) / (size(y) - 1))
    sums = rows.groupBy(*g).agg((total(1, "v10_a") / size(1)).alias("auc1"), (total(1, "v10_b") / size(1)).alias("auc2"),
                                *[cov(*k).alias(n) for n, k in kinds.items()])
    j = ok.where((F.col("_m") > 0) & (F.col("_n") > 0)).join(sums, g)
    m, n = F.col("_m").cast("double"), F.col("_n").cast("double")
    s10 = F.coalesce(F.col("s10_aa") + F.col("s10_bb") - 2 * F.col("s10_ab"), F.lit(0.0))
    s01 = F.coalesce(F.col("s01_aa") + F.col("s01_bb") - 2 * F.col("s01_ab"), F.lit(0.0))
    var = s10 / m + s01 / n
    diff = F.col("auc1") - F.col("auc2")
    out = j.select(*g, "auc1", "auc2", diff.alias("auc_diff"), var.alias("var"))
    out = out.withColumn("z", F.when(F.col("var") > 1e-300, F.col("auc_diff") / F.sqrt("var")))
    return out.withColumn("p_value", F.when(F.col("z").isNull(),
                                            F.when(F.col("auc_diff") == 0, F.lit(1.0)))
                          .otherwise(norm_two_sided_p("z")))


def paired_comparison(scores: DataFrame, model_a: str, model_b: str, threshold: float = 0.5,
                      group: Sequence[str] = ("dataset",)) -> DataFrame:
    """One record per dataset: wilcoxon, mcnemar and delong structs for models A and B."""
    g = list(group)
    pairs = pair_scores(scores, model_a, model_b, g)
    w = wilcoxon_abs_error(pairs, g).select(*g, *[F.col(c).alias(f"w_{c}") for c in ["stat", "z", "median_diff", "p_value"]])
    m = mcnemar(pairs, threshold, g).select(*g, *[F.col(c).alias(f"m_{c}") for c in ["b", "c", "chi2", "p_value"]])
    d = delong(pairs, g).select(*g, *[F.col(c).alias(f"d_{c}") for c in ["auc1", "auc2", "auc_diff", "var", "z", "p_value"]])
    j = w.join(m, g, "full").join(d, g, "full")
    return j.select(
        *g, F.lit(model_a).alias("model_a"), F.lit(model_b).alias("model_b"),
        F.struct(F.col("w_stat").alias("statistic"), F.col("w_p_value").alias("p_value"),
                 F.col("w_median_diff").alias("median_abs_error_diff")).alias("wilcoxon"),
        F.struct(*[F.col(f"m_{c}").alias(c) for c in ["b", "c", "chi2", "p_value"]]).alias("mcnemar"),
        F.struct(*[F.col(f"d_{c}").alias(c) for c in ["auc1", "auc2", "auc_diff", "var", "z", "p_value"]]).alias("delong"),
    )


# ---------------------------------------------------------------- tests on reliability scores

def correctness_table(rel: DataFrame, score: str = "reliability_score", pred: str = "pred_default",
                      actual: str = "actual_default", group: Sequence[str] = ()) -> DataFrame:
    """Rows with all three present: group..., score, correct (pred == actual)."""
    g = list(group)
    t = rel.where(F.col(score).isNotNull() & F.col(pred).isNotNull() & F.col(actual).isNotNull())
    return t.select(*g, F.col(score).cast("double").alias("score"),
                    (F.col(pred) == F.col(actual)).cast("int").alias("correct"))


def two_sample_ks(rel: DataFrame, group: Sequence[str] = (), **kw) -> DataFrame:
    """KS distance between the score distributions of correct and wrong rows; asymptotic p."""
    g = list(group)
    t = correctness_table(rel, group=g, **kw)
    c = score_curve(t, g, p="score", y="correct")
    st = c.groupBy(*g).agg(
        F.max(F.abs(F.col("cum_pos") / F.col("tot_pos") - F.col("cum_neg") / F.col("tot_neg"))).alias("ks_stat"),
        F.first("tot_pos").alias("n_correct"), F.first("tot_neg").alias("n_wrong"))
    ne = F.col("n_correct") * F.col("n_wrong") / (F.col("n_correct") + F.col("n_wrong"))
    return st.withColumn("ks_pvalue", ks_asymptotic_p(F.sqrt(ne) * F.col("ks_stat")))


def mann_whitney(rel: DataFrame, group: Sequence[str] = (), **kw) -> DataFrame:
    """U of the correct rows against the wrong ones, one-sided 'greater'; normal p with tie and
    continuity correction."""
    g = list(group)
    t = correctness_table(rel, group=g, **kw)
    c = score_curve(t, g, p="score", y="correct")
    cnt = F.col("pos") + F.col("neg")
    mid = F.col("cum_pos") + F.col("cum_neg") - cnt + (cnt + 1) / 2.0
    st = c.groupBy(*g).agg(F.sum(F.col("pos") * mid).alias("_r1"), F.first("tot_pos").alias("_n1"),
                           F.first("tot_neg").alias("_n2"), F.sum(cnt * cnt * cnt - cnt).alias("_ties"))
    n1, n2 = F.col("_n1").cast("double"), F.col("_n2").cast("double")
    n = n1 + n2
    u = F.col("_r1") - n1 * (n1 + 1) / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = F.when(sigma > 0, (u - n1 * n2 / 2.0 - 0.5) / sigma)
    return st.select(*g, u.alias("mw_stat"), z.alias("mw_z")).withColumn("mw_pvalue", norm_sf("mw_z"))


def correctness_auc(rel: DataFrame, group: Sequence[str] = (), **kw) -> DataFrame:
    """AUC of the score for telling correct (1) from wrong (0) rows."""
    g = list(group)
    t = correctness_table(rel, group=g, **kw)
    c = score_curve(t, g, p="score", y="correct")
    return c.groupBy(*g).agg(
        F.when((F.first("tot_pos") > 0) & (F.first("tot_neg") > 0),
               F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
               / (F.first("tot_pos") * F.first("tot_neg"))).alias("roc_auc"))


def univariate_logit(rel: DataFrame, group: Sequence[str] = (), iters: int = 50, **kw) -> DataFrame:
    """correct ~ score by unpenalised logistic regression: coef, LR-test p, McFadden R2, Wald p.

    All groups' fits take their Newton steps together: the state is a table of one row a group, and a
    step is one aggregate over the rows of the groups that still move, so the number of jobs follows the
    steps, never the groups. A group whose Hessian is singular stays where it is."""
    g = list(group) or ["_g"]
    t = correctness_table(rel, group=list(group), **kw)
    t = cut_lineage(t if group else t.withColumn("_g", F.lit(0)))
    state = cut_lineage(t.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("ybar"))
                        .select(*g, "n", "ybar", F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1"), F.lit(True).alias("moving")))
    side = F.broadcast if state.count() <= SMALL else (lambda df: df)
    x = F.col("score")
    p = 1.0 / (1.0 + F.exp(-(F.col("b0") + F.col("b1") * x)))
    w = p * (1 - p)
    hessian = [F.sum(w).alias("h00"), F.sum(w * x).alias("h01"), F.sum(w * x * x).alias("h11")]
    det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
    some = lambda up: F.when(det > 0, up / F.when(det > 0, det)).otherwise(0.0)
    for _ in range(iters):
        if state.where("moving").isEmpty():
            break
        sums = t.join(side(state.where("moving")), g).groupBy(*g).agg(F.sum(F.col("correct") - p).alias("g0"), F.sum((F.col("correct") - p) * x).alias("g1"), *hessian)
        steps = sums.select(*g, some(F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1")).alias("d0"),
                            some(F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0")).alias("d1"))
        moved = state.join(side(steps), g, "left").na.fill(0.0, ["d0", "d1"])
        state = cut_lineage(moved.select(*g, "n", "ybar", (F.col("b0") + F.col("d0")).alias("b0"), (F.col("b1") + F.col("d1")).alias("b1"),
                                         (F.greatest(F.abs("d0"), F.abs("d1")) >= 1e-10).alias("moving")))
    eps = 1e-12
    sure = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    ll = F.sum(F.col("correct") * F.log(sure) + (1 - F.col("correct")) * F.log(1 - sure)).alias("ll")
    end = t.join(side(state), g).groupBy(*g, "n", "ybar", "b1").agg(ll, *hessian)
    mean = F.least(F.greatest("ybar", F.lit(eps)), F.lit(1 - eps))
    ll0 = F.col("n") * (mean * F.log(mean) + (1 - mean) * F.log(1 - mean))
    se = F.when(det > 0, F.sqrt(F.col("h00") / F.when(det > 0, det)))
    lr = F.greatest(2.0 * (F.col("ll") - ll0), F.lit(0.0))
    return end.select(*group, F.col("b1").alias("logit_coef"), chi2_1_sf(lr).alias("logit_pvalue"), F.when(ll0 != 0, 1.0 - F.col("ll") / ll0).alias("logit_pseudo_r2"),
                      F.when(se.isNotNull(), norm_two_sided_p(F.col("b1") / (se + 1e-18))).alias("logit_pvalue_wald"))


def reliability_diagnostics(rel: DataFrame, group: Sequence[str] = (), with_logit: bool = True, **kw) -> DataFrame:
    """One row (per group): n_correct, n_wrong, KS, Mann-Whitney, AUC and the logit test."""
    g = list(group)
    ks = two_sample_ks(rel, g, **kw)
    mw = mann_whitney(rel, g, **kw)
    au = correctness_auc(rel, g, **kw)
    if g:
        j = ks.join(mw, g).join(au, g)
    else:
        j = ks.withColumn("_k", F.lit(1)).join(mw.withColumn("_k", F.lit(1)), "_k").join(
            au.withColumn("_k", F.lit(1)), "_k").drop("_k")
    if with_logit:
        lg = univariate_logit(rel, g, **kw)
        j = j.join(lg, g) if g else j.withColumn("_k", F.lit(1)).join(lg.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return j


def diagnostic_bands(diag: DataFrame, auc_col: str = "roc_auc", p_col: str | None = "logit_pvalue") -> DataFrame:
    """AUC band (>= .8 strong, >= .7 moderate, >= .6 weak, else none) and the band of the
    logistic-test p-value (< .01 highly significant, < .05 significant)."""
    auc = F.col(auc_col)
    band = (F.when(auc.isNull(), "unknown").when(auc >= 0.8, "strong").when(auc >= 0.7, "moderate")
            .when(auc >= 0.6, "weak").otherwise("none"))
    if p_col is None:
        return diag.withColumn("auc_band", band)
    p = F.col(p_col)
    pb = (F.when(p.isNull(), "unknown").when(p < 0.01, "highly significant").when(p < 0.05, "significant")
          .otherwise("not significant"))
    return diag.withColumn("auc_band", band).withColumn("p_band", pb)
