"""Benchmark and comparison tables over metric results.

Input is either the wide metric table ``(dataset, model_group, model, AUC, PCC, ..., H[, error])``
or the long ``metrics(dataset, model_group, model, metric, value)``. Everything here is a small
aggregate or window over one row per model and dataset; rankings use a full tie-break
(metric, model_group, model) so results do not depend on row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelab.operators.metrics import METRIC_NAMES

# Metrics where a lower value is better (the reference sorts all descending;
# ours sorts these ascending).
LOWER_IS_BETTER = ("BS",)

# Model family labels, tried in this order, first case-free substring match wins.
FAMILY_ORDER = ["lr_reg", "lr", "adaboost", "Bag-CART", "BagNN", "Boost-DT", "RF", "SGB", "KNN", "XGB", "LGBM", "DL"]


def _order(metric: str) -> Column:
    return F.col(metric).asc_nulls_last() if metric in LOWER_IS_BETTER else F.col(metric).desc_nulls_last()


def _ok(wide: DataFrame) -> DataFrame:
    return wide.where(F.col("error").isNull()) if "error" in wide.columns else wide


def training_summary(metrics_long: DataFrame, names: Sequence[str] = METRIC_NAMES) -> DataFrame:
    """Long metric rows -> one wide row per (dataset, group, model); failed models left out."""
    src = metrics_long
    if "error" in src.columns:
        src = src.where(F.col("error").isNull())
    return (src.groupBy("dataset", "model_group", "model")
            .pivot("metric", list(names)).agg(F.first("value")))


def summary_by_dataset(wide: DataFrame, dataset: str) -> DataFrame:
    return wide.where(F.col("dataset") == dataset)


def rank_models(wide: DataFrame, primary: str = "AUC", by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rank 1.. within dataset by the primary metric (best first; BS ascending)."""
    w = Window.partitionBy(*by).orderBy(_order(primary), "model_group", "model")
    return _ok(wide).withColumn("rank", F.row_number().over(w))


def top_k_models(wide: DataFrame, k: int = 5, primary: str = "AUC", secondary: Sequence[str] = ("F1", "KS")) -> DataFrame:
    """Top k per dataset with the secondary metrics (the rank filter becomes a per-group limit)."""
    r = rank_models(wide, primary)
    return r.where(F.col("rank") <= k).select("dataset", "rank", "model_group", "model", primary, *secondary)


def best_per_dataset(wide: DataFrame, metric: str = "AUC") -> DataFrame:
    """Best model per dataset by ``metric``; ties go to the first (group, model) by name."""
    return (rank_models(wide.where(F.col(metric).isNotNull()), metric).where(F.col("rank") == 1)
            .select("dataset", "model_group", "model", F.col(metric).alias(f"best_{metric}")))


def cross_dataset_best(wide: DataFrame, primary: str = "AUC", secondary: Sequence[str] = ("F1", "KS")) -> DataFrame:
    r = rank_models(wide.where(F.col(primary).isNotNull()), primary).where(F.col("rank") == 1)
    return r.select("dataset", "model_group", "model", primary, *secondary)


def comparison_pivot(wide: DataFrame, metric: str = "AUC", datasets: Sequence[str] | None = None) -> DataFrame:
    """Rows (group, model), one column per dataset holding ``metric``.

    Pass ``datasets`` to fix the column set (and avoid a distinct-values job)."""
    g = _ok(wide).groupBy("model_group", "model")
    g = g.pivot("dataset", list(datasets)) if datasets is not None else g.pivot("dataset")
    return g.agg(F.first(metric))


def group_mean_auc(wide: DataFrame, metric: str = "AUC") -> DataFrame:
    """Mean of the metric over datasets per (group, model), skipping null / failed runs."""
    return (_ok(wide).where(F.col(metric).isNotNull() & ~F.isnan(metric))
            .groupBy("model_group", "model").agg(F.avg(metric).alias("mean_auc"),
                                                 F.count(F.lit(1)).alias("n_datasets")))


def best_per_group(wide: DataFrame, metric: str = "AUC") -> DataFrame:
    """Benchmark model of each group: argmax of the mean metric (ties: model name)."""
    m = group_mean_auc(wide, metric)
    w = Window.partitionBy("model_group").orderBy(F.col("mean_auc").desc(), "model")
    return m.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "n_datasets")


def benchmark_table(wide: DataFrame, balanced: bool = False, metric: str = "AUC") -> DataFrame:
    """The benchmark model's metrics on every dataset, with the balancing flag, fixed column order."""
    best = best_per_group(wide, metric).select("model_group", F.col("model").alias("benchmark_model"))
    ok = _ok(wide)
    j = ok.join(best, (ok.model_group == best.model_group) & (ok.model == best.benchmark_model)).drop(best.model_group)
    present = [m for m in METRIC_NAMES if m in wide.columns]
    return j.select("dataset", "model_group", "benchmark_model",
                    F.lit("Yes" if balanced else "No").alias("smote"), *present)


def all_models_table(wide: DataFrame, balanced: bool = False) -> DataFrame:
    present = [m for m in METRIC_NAMES if m in wide.columns]
    return (_ok(wide).select("dataset", "model_group", "model", F.lit("Yes" if balanced else "No").alias("smote"),
                             *present)
            .orderBy("model_group", "model", "dataset"))


def metrics_long(wide: DataFrame, names: Sequence[str] = METRIC_NAMES) -> DataFrame:
    """Wide -> (dataset, model_group, model, metric, value) for the metrics present."""
    present = [m for m in names if m in wide.columns]
    return (_ok(wide).select("dataset", "model_group", "model", *[F.col(m).cast("double") for m in present])
            .unpivot(["dataset", "model_group", "model"], present, "metric", "value"))


def model_family(col: Column | str) -> Column:
    """Family label: first entry of FAMILY_ORDER contained (case-free) in the name, else the name."""
    c = F.col(col) if isinstance(col, str) else col
    low = F.lower(c.cast("string"))
    expr = None
    for g in FAMILY_ORDER:
        cond = low.contains(g.lower())
        expr = F.when(cond, F.lit(g)) if expr is None else expr.when(cond, F.lit(g))
    return expr.otherwise(c.cast("string"))


def metric_chart_data(wide: DataFrame, metric: str = "AUC") -> DataFrame:
    """Mean metric by group x dataset; '.csv' cut from the dataset label, null label -> 'Unknown'."""
    ds = F.coalesce(F.regexp_replace(F.col("dataset"), r"\.csv", ""), F.lit("Unknown"))
    grp = F.coalesce(F.col("model_group"), F.lit("Unknown"))
    return (_ok(wide).groupBy(grp.alias("model_group"), ds.alias("dataset"))
            .agg(F.avg(metric).alias(f"mean_{metric}")))


def model_frequency(benchmarks: DataFrame, col: str = "benchmark_model") -> DataFrame:
    """How often each model is the benchmark."""
    return benchmarks.groupBy(F.col(col).alias("model")).agg(F.count(F.lit(1)).alias("n"))


def model_avg_auc(wide: DataFrame, n: int = 15, metric: str = "AUC") -> DataFrame:
    """Mean and sample std of the metric per model across datasets, top n by mean."""
    m = (_ok(wide).where(F.col(metric).isNotNull()).groupBy("model")
         .agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std")))
    # n is the feature (a top-n report): distributed top-k (TakeOrderedAndProject)
    return m.orderBy(F.col("mean").desc(), "model").limit(n)
