"""Credit-scoring metrics over the long ``scores`` table.

Input: ``scores(dataset, model_group, model, row_id, y, p)``; output one row per group
``G`` (default dataset, model_group, model).

Everything starts from one collapsed histogram ``(G, p) -> pos, neg`` (a partial aggregate, so the
shuffle carries distinct scores, not rows), then the bucketed running totals of
``scorelab.plans.ranks``. AUC, KS, Brier, PCC/F1/Recall, partial Gini and H are all sums or maxima
over that one table.

Definitions (as the reference codes them):
  tau          share of 1 in the *train* rows (PCC / F1 / Recall threshold, predicted 1 iff p > tau)
  AUC          rank AUC, ties count one half
  KS           max |F+ - F-| evaluated after each distinct score
  BS           mean (p - y)^2
  PG           Gini (2 AUC - 1) of the rows with p <= 0.4; null with < 2 rows or one class
  H            Hand's H: 1 - EMC / EMC0 with a Beta(a, b) cost density on a grid of n costs at
               the quantiles linspace(1e-6, 1 - 1e-6, n), clipped to [0, 1]; null for constant
               scores or EMC0 <= 0; pi+ from train
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelab import DEFAULT_GROUP
from scorelab.plans.ranks import running_totals

METRIC_NAMES = ("AUC", "PCC", "F1", "Recall", "BS", "KS", "PG", "H")


# ---------------------------------------------------------------- shared pieces

def score_histogram(scores: DataFrame, group: Sequence[str] = DEFAULT_GROUP, p: str = "p",
                    y: str = "y") -> DataFrame:
    """(G, p) -> pos, neg counts; the only table the metrics read."""
    return scores.groupBy(*group, p).agg(
        F.sum(F.col(y).cast("long")).alias("pos"),
        F.sum((1 - F.col(y)).cast("long")).alias("neg"),
    ).withColumnRenamed(p, "p")


def score_curve(scores: DataFrame, group: Sequence[str] = DEFAULT_GROUP, buckets: int | None = None,
                p: str = "p", y: str = "y") -> DataFrame:
    """Histogram plus inclusive running totals in ascending score order.

    Columns: G, p, pos, neg, _bucket, cum_pos, cum_neg, tot_pos (P), tot_neg (N).
    """
    return running_totals(score_histogram(scores, group, p, y), list(group), "p", ["pos", "neg"], buckets)


def metric_prevalence(train: DataFrame, by: Sequence[str] = ("dataset",), y: str = "y") -> DataFrame:
    """tau = share of class 1 per ``by`` (the train rows the caller chooses as base)."""
    return train.groupBy(*by).agg(F.avg(F.col(y).cast("double")).alias("tau"))


def _attach_tau(table: DataFrame, group: Sequence[str], tau, scores: DataFrame | None = None) -> DataFrame:
    """Add a ``tau`` column: a number, a (keys..., tau) table, or None for test prevalence."""
    if tau is None:
        return table.withColumn("tau", F.col("tot_pos") / (F.col("tot_pos") + F.col("tot_neg")))
    if isinstance(tau, (int, float)):
        return table.withColumn("tau", F.lit(float(tau)))
    keys = [c for c in tau.columns if c != "tau" and c in group]
    return table.join(tau.select(*keys, "tau"), keys, "left")


# ---------------------------------------------------------------- Beta cost grid

def beta_quantiles(n_grid: int = 1000, severity: tuple[float, float] = (2.0, 2.0)) -> tuple[np.ndarray, np.ndarray]:
    """Costs c_i = Beta(a,b) quantile at linspace(1e-6, 1-1e-6, n) and normalised pdf weights."""
    a, b = severity
    u = np.linspace(1e-6, 1 - 1e-6, n_grid)
    if (a, b) == (2.0, 2.0):
        c = 0.5 - np.sin(np.arcsin(1.0 - 2.0 * u) / 3.0)
        pdf = 6.0 * c * (1.0 - c)
    else:
        # numeric inverse of the regularised incomplete beta on a fine grid (driver-side table)
        xs = np.linspace(0.0, 1.0, 200_001)
        logpdf = (a - 1) * np.log(np.clip(xs, 1e-300, None)) + (b - 1) * np.log(np.clip(1 - xs, 1e-300, None))
        dens = np.exp(logpdf - logpdf.max())
        cdf = np.concatenate([[0.0], np.cumsum((dens[1:] + dens[:-1]) / 2.0)])
        cdf /= cdf[-1]
        c = np.interp(u, cdf, xs)
        lb = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        pdf = np.exp(lb + (a - 1) * np.log(c) + (b - 1) * np.log(1 - c))
    w = pdf / pdf.sum()
    return c, w


def cost_grid(spark, n_grid: int = 1000, severity=(2.0, 2.0)) -> DataFrame:
    c, w = beta_quantiles(n_grid, severity)
    rows = [(i, float(c[i]), float(w[i])) for i in range(n_grid)]
    return spark.createDataFrame(rows, "cost_idx int, cost double, weight double")


def _lower_hull(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower convex hull (x ascending) of a point set; min of any positive linear cost lies on it."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    keep = np.concatenate([[True], x[1:] != x[:-1]])  # lowest y per x
    x, y = x[keep], y[keep]
    hx: list[float] = []
    hy: list[float] = []
    for xi, yi in zip(x.tolist(), y.tolist()):
        while len(hx) >= 2 and (hx[-1] - hx[-2]) * (yi - hy[-2]) - (hy[-1] - hy[-2]) * (xi - hx[-2]) <= 0:
            hx.pop()
            hy.pop()
        hx.append(xi)
        hy.append(yi)
    return np.asarray(hx), np.asarray(hy)


def _min_losses(hx: np.ndarray, hy: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """min_j c*hy_j + (1-c)*hx_j for every c, by a search on the hull's edge slopes."""
    if len(hx) == 1:
        return costs * hy[0] + (1 - costs) * hx[0]
    slopes = np.diff(hy) / np.diff(hx)
    k = np.searchsorted(slopes, -(1 - costs) / costs, side="left")
    best = np.full(len(costs), np.inf)
    for shift in (-1, 0, 1):
        j = np.clip(k + shift, 0, len(hx) - 1)
        best = np.minimum(best, costs * hy[j] + (1 - costs) * hx[j])
    return best


def h_measure_table(curve_tau: DataFrame, group: Sequence[str], n_grid: int = 1000,
                    severity=(2.0, 2.0)) -> DataFrame:
    """G -> H from a score curve that carries ``tau`` (used as pi+)."""
    group = list(group)
    spark = curve_tau.sparkSession
    costs, _ = beta_quantiles(n_grid, severity)
    pts = curve_tau.where((F.col("tot_pos") > 0) & (F.col("tot_neg") > 0)).select(
        *group,
        "_bucket",
        "tau",
        # ROC point of threshold p (predict 1 iff score >= p): fpr, and fnr = 1 - tpr
        ((F.col("tot_neg") - F.col("cum_neg") + F.col("neg")) / F.col("tot_neg")).alias("fpr"),
        ((F.col("cum_pos") - F.col("pos")) / F.col("tot_pos")).alias("fnr"),
    )
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pts.schema.fields if f.name in group)
    out_schema = f"{key_schema}, cost_idx int, loss double"

    def per_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pi = float(pdf["tau"].iloc[0])
        x = (1.0 - pi) * pdf["fpr"].to_numpy(dtype=float)
        yv = pi * pdf["fnr"].to_numpy(dtype=float)
        hx, hy = _lower_hull(x, yv)
        loss = _min_losses(hx, hy, costs)
        out = pd.DataFrame({"cost_idx": np.arange(len(costs), dtype=np.int32), "loss": loss})
        for g in group:
            out[g] = pdf[g].iloc[0]
        return out[[*group, "cost_idx", "loss"]]

    per = pts.groupBy(*group, "_bucket").applyInPandas(per_bucket, out_schema)
    mins = per.groupBy(*group, "cost_idx").agg(F.min("loss").alias("loss"))
    grid = F.broadcast(cost_grid(spark, n_grid, severity))  # fixed n_grid rows
    pi = curve_tau.groupBy(*group).agg(
        F.first("tau").alias("tau"), F.min("p").alias("_pmin"), F.max("p").alias("_pmax"),
        F.first("tot_pos").alias("_P"), F.first("tot_neg").alias("_N"))
    j = mins.join(grid, "cost_idx").join(pi, group)
    # (0, 0) ROC point (threshold above every score): loss c * pi+
    loss = F.least(F.col("loss"), F.col("cost") * F.col("tau"))
    base = F.least(F.col("cost") * F.col("tau"), (1 - F.col("cost")) * (1 - F.col("tau")))
    agg = j.groupBy(*group).agg(
        F.sum(F.col("weight") * loss).alias("_emc"),
        F.sum(F.col("weight") * base).alias("_emc0"),
    )
    res = pi.join(agg, group, "left").select(
        *group,
        F.when((F.col("_pmin") == F.col("_pmax")) | (F.col("_emc0") <= 0) | F.col("_emc").isNull(), F.lit(None))
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("_emc") / F.col("_emc0"))))
        .cast("double")
        .alias("H"),
    )
    return res


# ---------------------------------------------------------------- the metric bundle

def _sums(group: Sequence[str], pg_cut: float) -> list[Column]:
    P, N = F.col("tot_pos"), F.col("tot_neg")
    below = F.col("cum_neg") - F.col("neg")
    auc_term = F.col("pos") * (below + F.col("neg") / 2.0)
    pcut = F.col("p") <= F.lit(pg_cut)
    return [
        F.first(P).alias("_P"),
        F.first(N).alias("_N"),
        F.first("tau").alias("_tau"),
        F.sum(auc_term).alias("_auc_num"),
        F.max(F.abs(F.col("cum_pos") / F.greatest(P, F.lit(1)) - F.col("cum_neg") / F.greatest(N, F.lit(1)))).alias("KS"),
        F.sum(F.col("pos") * (1 - F.col("p")) * (1 - F.col("p")) + F.col("neg") * F.col("p") * F.col("p")).alias("_sq"),
        F.sum(F.when(F.col("p") > F.col("tau"), F.col("pos")).otherwise(0)).alias("_tp"),
        F.sum(F.when(F.col("p") > F.col("tau"), F.col("neg")).otherwise(0)).alias("_fp"),
        F.sum(F.when(pcut, auc_term).otherwise(0.0)).alias("_pg_num"),
        F.sum(F.when(pcut, F.col("pos")).otherwise(0)).alias("_pg_p"),
        F.sum(F.when(pcut, F.col("neg")).otherwise(0)).alias("_pg_n"),
    ]


def _finish(t: DataFrame, group: Sequence[str]) -> DataFrame:
    P, N = F.col("_P"), F.col("_N")
    n = P + N
    tp, fp = F.col("_tp"), F.col("_fp")
    fn = P - tp
    tn = N - fp
    auc = F.when((P > 0) & (N > 0), F.col("_auc_num") / (P * N))
    pg_auc = F.col("_pg_num") / (F.col("_pg_p") * F.col("_pg_n"))
    pg = F.when((F.col("_pg_p") + F.col("_pg_n") >= 2) & (F.col("_pg_p") > 0) & (F.col("_pg_n") > 0), 2 * pg_auc - 1)
    return t.select(
        *group,
        auc.cast("double").alias("AUC"),
        ((tp + tn) / n).cast("double").alias("PCC"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).cast("double").alias("F1"),
        F.when(P > 0, tp / P).otherwise(0.0).cast("double").alias("Recall"),
        (F.col("_sq") / n).cast("double").alias("BS"),
        F.col("KS").cast("double").alias("KS"),
        pg.cast("double").alias("PG"),
    )


def metric_bundle(scores: DataFrame, train=None, group: Sequence[str] = DEFAULT_GROUP, pg_cut: float = 0.4,
                  severity=(2.0, 2.0), n_grid: int = 1000, buckets: int | None = None,
                  with_h: bool = True) -> DataFrame:
    """G -> AUC, PCC, F1, Recall, BS, KS, PG, H.

    ``train``: None (test prevalence, the ``selfbase`` variant), a number, a ``(keys, tau)`` table
    from ``metric_prevalence``, or a train DataFrame with ``y`` (prevalence per ``dataset``).
    """
    group = list(group)
    if isinstance(train, DataFrame) and "tau" not in train.columns:
        keys = [c for c in group if c in train.columns]
        if keys:
            train = metric_prevalence(train, keys)
        else:  # one prevalence for everything: a single number
            train = float(train.agg(F.avg(F.col("y").cast("double"))).first()[0])
    curve_tau = _attach_tau(score_curve(scores, group, buckets), group, train)
    base = _finish(curve_tau.groupBy(*group).agg(*_sums(group, pg_cut)), group)
    if not with_h:
        return base
    h = h_measure_table(curve_tau, group, n_grid, severity)
    return base.join(h, group, "left")


def metric_bundle_selfbase(scores: DataFrame, group: Sequence[str] = DEFAULT_GROUP, **kw) -> DataFrame:
    """Same bundle with the test prevalence as tau and pi+."""
    return metric_bundle(scores, None, group, **kw)


def _one(scores, name, group=DEFAULT_GROUP, tau=None, buckets=None, pg_cut=0.4):
    curve_tau = _attach_tau(score_curve(scores, group, buckets), list(group), tau)
    return _finish(curve_tau.groupBy(*group).agg(*_sums(group, pg_cut)), group).select(*group, name)


def metric_auc(scores, group=DEFAULT_GROUP, buckets=None):
    return _one(scores, "AUC", group, buckets=buckets)


def metric_gini(scores, group=DEFAULT_GROUP, buckets=None):
    return metric_auc(scores, group, buckets).select(*group, (2 * F.col("AUC") - 1).alias("Gini"))


def metric_pcc(scores, tau=None, group=DEFAULT_GROUP):
    return _one(scores, "PCC", group, tau)


def metric_f1(scores, tau=None, group=DEFAULT_GROUP):
    return _one(scores, "F1", group, tau)


def metric_recall(scores, tau=None, group=DEFAULT_GROUP):
    return _one(scores, "Recall", group, tau)


def metric_brier(scores, group=DEFAULT_GROUP, p="p", y="y"):
    """Mean squared error of p against y; a plain aggregate (no ordering needed)."""
    d = F.col(p) - F.col(y)
    return scores.groupBy(*group).agg(F.avg(d * d).alias("BS"))


def metric_ks(scores, group=DEFAULT_GROUP, buckets=None):
    return _one(scores, "KS", group, buckets=buckets)


def metric_partial_gini(scores, cut: float = 0.4, group=DEFAULT_GROUP, buckets=None):
    return _one(scores, "PG", group, buckets=buckets, pg_cut=cut)


def metric_h(scores, pi_plus=None, severity=(2.0, 2.0), n_grid: int = 1000, group=DEFAULT_GROUP, buckets=None):
    curve_tau = _attach_tau(score_curve(scores, group, buckets), list(group), pi_plus)
    return h_measure_table(curve_tau, list(group), n_grid, severity)


def roc_points(scores: DataFrame, group=DEFAULT_GROUP, buckets=None) -> DataFrame:
    """G, threshold, fpr, tpr: one point per distinct score (predict 1 iff p >= threshold),
    plus the starting point (threshold +inf, 0, 0)."""
    group = list(group)
    c = score_curve(scores, group, buckets).where((F.col("tot_pos") > 0) & (F.col("tot_neg") > 0))
    pts = c.select(
        *group,
        F.col("p").alias("threshold"),
        ((F.col("tot_neg") - F.col("cum_neg") + F.col("neg")) / F.col("tot_neg")).alias("fpr"),
        ((F.col("tot_pos") - F.col("cum_pos") + F.col("pos")) / F.col("tot_pos")).alias("tpr"),
    )
    start = c.select(*group).distinct().select(
        *group, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def confusion(scores: DataFrame, threshold: float = 0.5, group=DEFAULT_GROUP, strict: bool = False,
              p: str = "p", y: str = "y") -> DataFrame:
    """tp, fp, tn, fn with predicted 1 iff p >= threshold (``strict``: p > threshold)."""
    pred = (F.col(p) > threshold) if strict else (F.col(p) >= threshold)
    yy = F.col(y) == 1
    cnt = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return scores.groupBy(*group).agg(
        cnt(pred & yy).alias("tp"), cnt(pred & ~yy).alias("fp"),
        cnt(~pred & ~yy).alias("tn"), cnt(~pred & yy).alias("fn"),
    )


def class_report(scores: DataFrame, threshold: float = 0.5, group=DEFAULT_GROUP) -> DataFrame:
    """Per class 0/1 plus macro and weighted averages: precision, recall, f1, support."""
    group = list(group)
    cm = confusion(scores, threshold, group)
    def prf(tp, fp, fn):
        prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
        rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
        return prec, rec, f1
    p1, r1, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    p0, r0, f0 = prf(F.col("tn"), F.col("fn"), F.col("fp"))
    s1 = (F.col("tp") + F.col("fn")).cast("double")
    s0 = (F.col("tn") + F.col("fp")).cast("double")
    wide = cm.select(*group, p1.alias("p1"), r1.alias("r1"), f1.alias("f1"), p0.alias("p0"),
                     r0.alias("r0"), f0.alias("f0"), s1.alias("s1"), s0.alias("s0"))
    tot = F.col("s0") + F.col("s1")
    rows = F.array(
        F.struct(F.lit("0").alias("label"), F.col("p0").alias("precision"), F.col("r0").alias("recall"),
                 F.col("f0").alias("f1"), F.col("s0").alias("support")),
        F.struct(F.lit("1").alias("label"), F.col("p1").alias("precision"), F.col("r1").alias("recall"),
                 F.col("f1").alias("f1"), F.col("s1").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((F.col("p0") + F.col("p1")) / 2).alias("precision"),
                 ((F.col("r0") + F.col("r1")) / 2).alias("recall"), ((F.col("f0") + F.col("f1")) / 2).alias("f1"),
                 tot.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"),
                 ((F.col("p0") * F.col("s0") + F.col("p1") * F.col("s1")) / tot).alias("precision"),
                 ((F.col("r0") * F.col("s0") + F.col("r1") * F.col("s1")) / tot).alias("recall"),
                 ((F.col("f0") * F.col("s0") + F.col("f1") * F.col("s1")) / tot).alias("f1"),
                 tot.alias("support")),
    )
    return wide.select(*group, F.inline(rows))
