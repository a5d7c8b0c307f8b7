"""Reliability of explanations.

Inputs: a rank-stability table ``(feature, avg_rank, std_rank)``, a sanity ratio, a Shapley
table ``(…, row_id, feature, phi)`` and scores ``(…, row_id, y, p)``. Every row score is a
``groupBy(row_id)`` over the Shapley rows joined with the (feature-sized) weight table; the batch
quantile buckets use exact distributed quantiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelab.plans.ranks import exact_quantiles, small_side
from scorelab.session import cut_lineage, ship_package, written_once

LABELS = ("Reliable", "Moderately Reliable", "Questionable", "Unreliable")
# Default cut points of the score buckets.
FIXED_CUTS = (0.60, 0.40, 0.20)
STRICT_CUTS = (0.75, 0.50, 0.30)
# Bucket descriptions of the quantile bucket table.
BUCKET_DESCRIPTIONS = {
    "Unreliable": "Bottom 25% of reliability scores (least reliable)",
    "Questionable": "25–50% quantile (questionable)",
    "Moderately Reliable": "50–75% quantile (moderately reliable)",
    "Reliable": "Top 25% of reliability scores (most reliable)",
}


def clean_feature(col: Column) -> Column:
    """Feature name after the last '__' (transformer prefix removed)."""
    return F.element_at(F.split(col, "__"), -1)


def feature_weights(rank_tbl: DataFrame) -> DataFrame:
    """W = 1/(1 + avg_rank) * 1/(1 + std_rank); null std -> 0; null avg_rank -> W = 0."""
    w = (1.0 / (1.0 + F.col("avg_rank"))) * (1.0 / (1.0 + F.coalesce(F.col("std_rank"), F.lit(0.0))))
    return rank_tbl.withColumn("W", F.coalesce(w, F.lit(0.0)))


def explanatory_robustness(weights: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """ER = mean W (0 when there is no feature)."""
    return weights.groupBy(*group).agg(F.coalesce(F.avg("W"), F.lit(0.0)).alias("ER"))


def signal_weight(ratio: Column) -> Column:
    """min(ratio, 3) / 3; null or NaN -> 0."""
    return F.when(ratio.isNull() | F.isnan(ratio), F.lit(0.0)).otherwise(F.least(ratio, F.lit(3.0)) / 3.0)


def global_reliability(er: Column, ratio: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), er * signal_weight(ratio)))


def _bucket(score: Column, cuts) -> Column:
    hi, mid, lo = cuts
    return (F.when(score.isNull() | F.isnan(score), "Unknown").when(score >= hi, LABELS[0])
            .when(score >= mid, LABELS[1]).when(score >= lo, LABELS[2]).otherwise(LABELS[3]))


def bucket_fixed(score: Column) -> Column:
    """>= .60 Reliable, >= .40 Moderately Reliable, >= .20 Questionable, else Unreliable; null Unknown."""
    return _bucket(score, FIXED_CUTS)


def bucket_strict(score: Column) -> Column:
    """The stricter cut: .75 / .50 / .30."""
    return _bucket(score, STRICT_CUTS)


def batch_quartiles(batch: DataFrame, score: str = "reliability_score", group: Sequence[str] = ()) -> DataFrame:
    """group..., q1, q2, q3, min, max of the batch scores (exact, linear interpolation)."""
    g = list(group)
    q = exact_quantiles(batch, [score], [0.25, 0.5, 0.75], group=g)
    wide = q.groupBy(*g).pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
    wide = wide.select(*g, F.col("`0.25`").alias("q1"), F.col("`0.5`").alias("q2"), F.col("`0.75`").alias("q3"))
    mm = batch.groupBy(*g).agg(F.min(score).alias("smin"), F.max(score).alias("smax"))
    return wide.join(mm, g) if g else wide.withColumn("_k", F.lit(1)).join(mm.withColumn("_k", F.lit(1)), "_k").drop("_k")


def bucket_quantile(batch: DataFrame, score: str = "reliability_score", group: Sequence[str] = ()) -> DataFrame:
    """Same labels by the batch's own 25/50/75 % points (>=).

    The batch is read twice (its quartiles, then every row), so it is written once to the shared
    checkpoint folder instead of being recomputed."""
    g = list(group)
    batch = cut_lineage(batch)
    q = small_side(batch_quartiles(batch, score, g))  # one row a group
    j = batch.join(q, g) if g else batch.withColumn("_k", F.lit(1)).join(q.withColumn("_k", F.lit(1)), "_k").drop("_k")
    s = F.col(score)
    b = (F.when(s.isNull(), "Unknown").when(s >= F.col("q3"), LABELS[0]).when(s >= F.col("q2"), LABELS[1])
         .when(s >= F.col("q1"), LABELS[2]).otherwise(LABELS[3]))
    return j.withColumn("reliability_bucket", b).drop("q1", "q2", "q3", "smin", "smax")


def bucket_bounds(batch: DataFrame, score: str = "reliability_score", group: Sequence[str] = ()) -> DataFrame:
    """bucket, lower_bound, upper_bound, description: the 4 quantile buckets of the batch. Its scores are read
    several times, so they are written once."""
    g = list(group)
    q = batch_quartiles(written_once(batch.select(*g, score)), score, g)
    rows = F.array(*[
        F.struct(F.lit(lab).alias("bucket"), lo.alias("lower_bound"), hi.alias("upper_bound"),
                 F.lit(BUCKET_DESCRIPTIONS[lab]).alias("description"))
        for lab, lo, hi in [("Unreliable", F.col("smin"), F.col("q1")), ("Questionable", F.col("q1"), F.col("q2")),
                            ("Moderately Reliable", F.col("q2"), F.col("q3")), ("Reliable", F.col("q3"), F.col("smax"))]
    ])
    return q.select(*g, F.inline(rows))


def _matched(weights: DataFrame, g: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One W a (shared group columns, clean feature name), and the columns to join on. A table
    with a model column holds weights by model; one without holds the same for all. A feature
    that occurs twice within a model is an error: the two can't both be right."""
    on = [c for c in g if c in weights.columns]
    w = weights.select(*on, clean_feature(F.col("feature")).alias("_fc"), "W").groupBy(*on, "_fc").agg(
        F.first("W").alias("W"), F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.concat(F.lit("feature occurs twice in the weights: "), F.col("_fc")))
    return w.select(*on, "_fc", F.when(F.col("_n") == 1, F.col("W")).otherwise(twice.cast("double")).alias("W")), [*on, "_fc"]


def _weighted(phi: DataFrame, weights: DataFrame, g: Sequence[str]) -> DataFrame:
    w, on = _matched(weights, g)
    return phi.withColumn("_fc", clean_feature(F.col("feature"))).join(w, on, "left").withColumn(
        "W", F.coalesce("W", F.lit(0.0)))


def row_shares(phi: DataFrame, weights: DataFrame, group: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Per row and feature: share = |phi| / sum |phi| (0 when the sum is 0), W, W * share. Weights
    are matched by feature and by the group columns they have."""
    g = list(group)
    t = _weighted(phi, weights, g)
    tot = F.sum(F.abs("phi")).over(Window.partitionBy(*g, "row_id"))
    t = t.withColumn("share", F.when(tot == 0, F.lit(0.0)).otherwise(F.abs("phi") / tot))
    return t.select(*g, "row_id", "feature", "phi", "W", "share", (F.col("W") * F.col("share")).alias("weighted"))


def _row_terms(phi: DataFrame, weights: DataFrame, g: Sequence[str]) -> DataFrame:
    """group..., row_id, GL_term = sum(W share), C_concentration = sum(share^2). One grouped pass:
    the sums of |phi|, W |phi| and phi^2 give both, so no row is windowed."""
    a = F.abs("phi")
    s = _weighted(phi, weights, g).groupBy(*g, "row_id").agg(
        F.sum(a).alias("_s"), F.sum(F.col("W") * a).alias("_w"), F.sum(a * a).alias("_q"))
    zero = F.col("_s") == 0
    return s.select(*g, "row_id", F.when(zero, F.lit(0.0)).otherwise(F.col("_w") / F.col("_s")).alias("GL_term"),
                    F.when(zero, F.lit(0.0)).otherwise(F.col("_q") / (F.col("_s") * F.col("_s"))).alias("C_concentration"))


def model_robustness(phi: DataFrame, weights: DataFrame, group: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """group..., ER: the mean W over the features that the model's phi table has; a feature
    without a weight counts as 0. No feature: 0."""
    g = list(group)
    feats = phi.select(*g, "feature").distinct()
    return _weighted(feats, weights, g).groupBy(*g).agg(F.coalesce(F.avg("W"), F.lit(0.0)).alias("ER"))


def row_reliability(phi: DataFrame, scores: DataFrame, weights: DataFrame, ratio: float | None,
                    threshold: float = 0.5, group: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """R = W_signal * sum(W share) * sum(share^2) * 4 (p - .5)^2 per row, with p, predicted class
    (p >= t), ER (mean W over the model's features), W_signal, global reliability, GL, C, D."""
    g = list(group)
    per = _row_terms(phi, weights, g).join(model_robustness(phi, weights, g), g)
    ws = 0.0 if ratio is None or ratio != ratio else min(float(ratio) / 3.0, 1.0)
    s = scores.select(*g, "row_id", F.col("y").alias("actual_default"), F.col("p").alias("pred_proba"))
    j = per.join(s, [*g, "row_id"])
    d = 4.0 * (F.col("pred_proba") - 0.5) * (F.col("pred_proba") - 0.5)
    r = F.lit(ws) * F.col("GL_term") * F.col("C_concentration") * d
    return j.select(
        *g, "row_id", "pred_proba", (F.col("pred_proba") >= threshold).cast("int").alias("pred_default"),
        F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0)).alias("reliability_score"),
        F.col("ER").alias("ER_global"), F.lit(ws).alias("W_signal"), (F.col("ER") * ws).alias("global_reliability"),
        "GL_term", "C_concentration", d.alias("D_decisiveness"), "actual_default")


def row_reliability_simple(phi: DataFrame, weights: DataFrame, ratio: float | None,
                           group: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """R = clip(W_signal * sum(W share), 0, 1) with the strict bucket. Here a null avg/std rank
    counts as 0 (W from the filled ranks)."""
    g = list(group)
    w0 = weights.withColumn("W", (1.0 / (1.0 + F.coalesce("avg_rank", F.lit(0.0))))
                            * (1.0 / (1.0 + F.coalesce("std_rank", F.lit(0.0)))))
    ws = 0.0 if ratio is None or ratio != ratio else min(float(ratio), 3.0) / 3.0
    r = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(ws) * F.col("GL_term")))
    return _row_terms(phi, w0, g).select(*g, "row_id", r.alias("reliability_score")).withColumn(
        "reliability_bucket", bucket_strict(F.col("reliability_score")))


def batch_reliability(phi: DataFrame, scores: DataFrame, weights: DataFrame, ratio: float | None,
                      threshold: float = 0.5, group: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Every row with its reliability, actual label and the batch's quantile bucket, in one plan."""
    rr = row_reliability(phi, scores, weights, ratio, threshold, group)
    return bucket_quantile(rr, "reliability_score", group)


def reliability_summary_stats(batch: DataFrame, score: str = "reliability_score",
                              group: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 %, max of the scores, which are written once."""
    g = list(group)
    batch = written_once(batch.select(*g, score))
    m = batch.groupBy(*g).agg(F.count(score).cast("double").alias("count"), F.avg(score).alias("mean"),
                              F.stddev_samp(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"))
    q = batch_quartiles(batch, score, g).select(*g, F.col("q1").alias("q25"), F.col("q2").alias("q50"),
                                                F.col("q3").alias("q75"))
    j = m.join(q, g) if g else m.withColumn("_k", F.lit(1)).join(q.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return j.select(*g, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def bucket_counts(batch: DataFrame, col: str = "reliability_bucket", group: Sequence[str] = ()) -> DataFrame:
    return batch.groupBy(*group, col).agg(F.count(F.lit(1)).alias("n"))


def stability_classes(rank_tbl: DataFrame, ratio: float, group: Sequence[str] = ()) -> DataFrame:
    """Per feature: top-3 flag (by avg_rank, ties by name) and the stability class of the rest
    (std < .5 stable, < 1 moderate, else / null unstable); per table: the top-3 label
    (all std <= .05, all <= .3, else), the ratio band (>= .95, >= .85, else) and a conclusion code."""
    g = list(group)
    w = Window.partitionBy(*g).orderBy("avg_rank", "feature") if g else Window.orderBy("avg_rank", "feature")
    t = rank_tbl.withColumn("_pos", F.row_number().over(w)).withColumn("is_top", F.col("_pos") <= 3)
    std = F.col("std_rank")
    cls = (F.when(F.col("is_top"), "top").when(std.isNull(), "unstable").when(std < 0.5, "stable")
           .when(std < 1.0, "moderate").otherwise("unstable"))
    t = t.withColumn("class", cls)
    wg = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    top_std = F.when(F.col("is_top"), F.coalesce(std, F.lit(float("inf"))))
    t = t.withColumn("_top_max", F.max(top_std).over(wg)).withColumn(
        "_n_unstable", F.sum(F.when(F.col("class") == "unstable", 1).otherwise(0)).over(wg))
    top_label = (F.when(F.col("_top_max") <= 0.05, "identical").when(F.col("_top_max") <= 0.3, "very small variation")
                 .otherwise("some variation"))
    rb = "genuine" if ratio >= 0.95 else ("useful" if ratio >= 0.85 else "noisy")
    concl = (F.when(F.lit(ratio >= 0.95) & (F.col("_n_unstable") == 0), "stable")
             .when(F.lit(ratio >= 0.85), "caution").otherwise("advise_more_trials"))
    return t.select(*g, "feature", "avg_rank", "std_rank", "is_top", "class", top_label.alias("top_label"),
                    F.lit(rb).alias("ratio_band"), concl.alias("conclusion"))


# ---------------------------------------------------------------- bootstrap AUC

def _poisson_weights(ids: np.ndarray, b: int, seed: int) -> np.ndarray:
    """(rows, b) Poisson(1) counts, a function of (row hash, replicate, seed) alone."""
    x = ids.astype(np.uint64)[:, None] + (np.arange(1, b + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    u = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    return np.searchsorted(cdf, u, side="right")


def _auc_parts(batches, keys: int, b: int, seed: int):
    """For rows in order of (group, p): each group's (positives, negatives, pairs in the right order) of every
    replicate over this range, ties counting half. Rows are weighed here, so only narrow rows were sorted."""
    import pyarrow as pa

    group, first, sums, tie, tie_p = None, None, None, None, None

    def settle():
        """Add the open tie to the group's sums."""
        nonlocal tie
        if tie is not None:
            sums[2] += tie[0] * (sums[1] + tie[1] / 2.0)
            sums[0] += tie[0]
            sums[1] += tie[1]
            tie = None

    def row():
        cols = [pa.array([v.as_py()], v.type) for v in first] + [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=[*[f"k{i}" for i in range(keys)], "part", "sums"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        p, y = batch.column(keys).to_numpy(zero_copy_only=False), batch.column(keys + 1).to_numpy(zero_copy_only=False)
        h = batch.column(keys + 2).to_numpy(zero_copy_only=False).view(np.uint64)
        new = np.zeros(n, bool)
        new[0] = True
        for i in range(keys):
            code = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        cuts = [*np.flatnonzero(new).tolist(), n]
        for a, e in zip(cuts, cuts[1:], strict=False):
            key = [batch.column(i)[a] for i in range(keys)]
            if group is None or [v.as_py() for v in key] != group:
                if group is not None:
                    settle()
                    yield row()
                group, first, sums, tie = [v.as_py() for v in key], key, np.zeros((3, b)), None
            starts = np.flatnonzero(np.concatenate([[True], p[a + 1 : e] != p[a : e - 1]]))
            w = _poisson_weights(h[a:e], b, seed)
            pos = np.add.reduceat(w * (y[a:e] == 1)[:, None], starts).astype(float)
            neg = np.add.reduceat(w * (y[a:e] != 1)[:, None], starts).astype(float)
            if tie is not None and tie_p == p[a]:
                pos[0] += tie[0]
                neg[0] += tie[1]
                tie = None
            settle()
            below = sums[1] + np.cumsum(neg[:-1], axis=0) - neg[:-1]
            sums[2] += (pos[:-1] * (below + neg[:-1] / 2.0)).sum(0)
            sums[0] += pos[:-1].sum(0)
            sums[1] += neg[:-1].sum(0)
            tie, tie_p = (pos[-1].copy(), neg[-1].copy()), p[e - 1]
    if group is not None:
        settle()
        yield row()


def bootstrap_auc(scores: DataFrame, b: int = 50, seed: int = 42, group: Sequence[str] = ("dataset", "model_group", "model"),
                  by: Sequence[str] = ("dataset",)) -> DataFrame:
    """B bootstrap AUCs per model (rows weighted per dataset, shared by all models): mean,
    population std, 2.5 / 97.5 % points, number of usable draws (one-class draws skipped).

    Each row's count in a replicate is a Poisson(1) variable of its (dataset, row id) hash, the
    usual bootstrap for data of any size: a replicate then has n rows on average, not exactly
    (``bootstrap_draws`` draws exactly n). What is shuffled is one narrow row a score, whatever B: the
    counts are worked out inside each range of scores, and a range gives one vector of (positives,
    negatives, ordered pairs) a model. Two ranges merge by adding the lower one's negatives times the upper
    one's positives, so a model's ranges, which are as many as the shuffle is wide, meet in one small group.
    """
    from scorelab.plans.ranks import hash_key

    g = list(group)
    rows = scores.select(*g, F.col("p").cast("double").alias("p"), F.col("y").cast("int").alias("y"), hash_key(seed, *by, "row_id").alias("_h"))
    rows = cut_lineage(rows.where("p is not null"))  # read twice: to find the ranges and to deal the rows
    dealt = rows.repartitionByRange(*g, "p").sortWithinPartitions(*g, "p")
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[: len(g)]]
    ship_package(rows.sparkSession)
    parts = dealt.mapInArrow(lambda batches: _auc_parts(batches, len(g), b, seed),
                             ", ".join([*[f"k{i} {t}" for i, t in enumerate(kinds)], "part int", "sums binary"]))
    parts = parts.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(g)], F.struct("part", "sums").alias("_p"))

    @F.pandas_udf("struct<mean: double, std: double, n_boot: long, ci_lower: double, ci_upper: double>")
    def merged(ranges: pd.Series) -> pd.DataFrame:
        out = []
        for some in ranges:
            total = np.zeros((3, b))
            for r in sorted(some, key=lambda r: r["part"]):
                pos, neg, pairs = np.frombuffer(r["sums"]).reshape(3, b)
                total += pos, neg, pairs + pos * total[1]
            use = (total[0] > 0) & (total[1] > 0)
            auc = total[2][use] / (total[0][use] * total[1][use])
            out.append((auc.mean(), auc.std(), len(auc), *np.quantile(auc, [0.025, 0.975])) if len(auc) else (None, None, 0, None, None))
        return pd.DataFrame(out, columns=["mean", "std", "n_boot", "ci_lower", "ci_upper"])

    stats = parts.groupBy(*g).agg(F.collect_list("_p").alias("_p")).select(*g, merged("_p").alias("_s"))
    return stats.where("_s.n_boot > 0").select(*g, "_s.*")


def bootstrap_summary(boot: DataFrame, best: DataFrame) -> DataFrame:
    """One row per dataset: the bootstrap of its benchmark model."""
    return boot.join(best.select("dataset", "model_group", "model"), ["dataset", "model_group", "model"])
