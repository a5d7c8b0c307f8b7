"""Feature importance: model-based rankings and their merge.

Long tables ``(selector, feature, importance, rank)``; ranks use row_number with a full
tie-break (importance desc, feature asc), so ties never depend on row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelab.operators.forest import Forest
from scorelab.operators.learn import FULL_DEPTH, _assemble, _fit, fit_forest


def _ranked(spark, selector: str, pairs: Sequence[tuple[str, float]]) -> DataFrame:
    t = spark.createDataFrame([(selector, f, float(v)) for f, v in pairs],
                              "selector string, feature string, importance double")  # one row per feature
    w = Window.partitionBy("selector").orderBy(F.col("importance").desc(), "feature")
    return t.withColumn("rank", F.row_number().over(w))


def importance_rf(df: DataFrame, features: Sequence[str], y: str = "y", trees: int = 300, seed: int = 42,
                  max_depth: int = FULL_DEPTH) -> DataFrame:
    """Impurity importance of a random forest (features x 1 result); trees grow to ``max_depth``."""
    m = fit_forest(df, features, y, numTrees=trees, maxDepth=max_depth, seed=seed)
    gains = m.importances if isinstance(m, Forest) else m.featureImportances.toArray()
    return _ranked(df.sparkSession, "rf", list(zip(features, gains.tolist())))


def importance_l1(df: DataFrame, features: Sequence[str], y: str = "y", C: float = 1.0) -> DataFrame:
    """|coefficient| of an L1 logistic regression on min-max scaled inputs."""
    from scorelab.operators.prep import scale_minmax

    x = scale_minmax(df, features)
    n = x.count()
    m = _fit(LogisticRegression(regParam=1.0 / (C * max(n, 1)), elasticNetParam=1.0, standardization=False), x,
             features, y)
    return _ranked(df.sparkSession, "l1", [(f, abs(v)) for f, v in zip(features, m.coefficients.toArray().tolist())])


def importance_lr(df: DataFrame, features: Sequence[str], y: str = "y", C: float = 1.0) -> DataFrame:
    """|coefficient| of a plain (L2, C = 1) logistic regression."""
    n = df.count()
    m = _fit(LogisticRegression(regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0, standardization=False), df,
             features, y)
    return _ranked(df.sparkSession, "lr", [(f, abs(v)) for f, v in zip(features, m.coefficients.toArray().tolist())])


def importance_merge(rf: DataFrame, l1: DataFrame) -> DataFrame:
    """Outer join on feature (missing -> 0), each side min-max normalised (flat -> 0), their mean;
    ordered by mean, rf, lr (all descending) and ranked 1.."""
    a = rf.select("feature", F.col("importance").alias("rf_importance"))
    b = l1.select("feature", F.col("importance").alias("lr_coef_abs"))
    j = a.join(b, "feature", "full").fillna(0.0, ["rf_importance", "lr_coef_abs"])
    w = Window.partitionBy(F.lit(0))  # over the feature table only

    def norm(c):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi - lo > 0, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))

    j = j.withColumn("rf_norm", norm("rf_importance")).withColumn("lr_norm", norm("lr_coef_abs"))
    j = j.withColumn("avg_score", (F.col("rf_norm") + F.col("lr_norm")) / 2.0)
    wr = Window.orderBy(F.col("avg_score").desc(), F.col("rf_importance").desc(), F.col("lr_coef_abs").desc(), "feature")
    return j.withColumn("rank", F.row_number().over(wr)).select(
        "rank", "feature", "rf_importance", "lr_coef_abs", "rf_norm", "lr_norm", "avg_score")


def importance_outer(rf: DataFrame, lr: DataFrame) -> DataFrame:
    """Plain outer join: feature, importance (rf), coefficient (lr); no normalising."""
    a = rf.select("feature", F.col("importance").alias("importance"))
    b = lr.select("feature", F.col("importance").alias("coefficient"))
    return a.join(b, "feature", "full")


def top_features(table: DataFrame, n: int = 10, by: str = "rank", group: Sequence[str] = ()) -> DataFrame:
    """The first n rows by ``by`` (per group), a per-group limit."""
    g = list(group)
    if not g:
        return table.orderBy(by, "feature").limit(n)
    w = Window.partitionBy(*g).orderBy(by, "feature")
    return table.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def importance_many(datasets: DataFrame, y: str = "y", test_size: float = 0.25, max_missing: float = 0.90,
                    trees: int = 100, seed: int = 42) -> DataFrame:
    """Per dataset: drop sparse columns, split, mean + min-max preprocessing, RF and L1
    importance merged; with the kept column count and row / column meta."""
    from scorelab.operators.prep import fit_preprocessor
    from scorelab.operators.project import drop_sparse_columns
    from scorelab.operators.resample import stratified_split
    from scorelab.session import cut_lineage

    out, datasets = None, cut_lineage(datasets)  # the split, the preparation and every pass of the fits read them
    names = [r["dataset"] for r in datasets.select("dataset").distinct().orderBy("dataset").collect()]
    for ds in names:
        d = drop_sparse_columns(datasets.where(F.col("dataset") == ds), y, max_missing)
        tr = cut_lineage(stratified_split(d, y, test_size, seed).where(F.col("split") == "train").drop("split"))
        pre = fit_preprocessor(tr, y, numeric="mean+minmax")
        x = cut_lineage(pre.transform(tr))
        feats = pre.feature_names()
        m = importance_merge(importance_rf(x, feats, y, trees, seed), importance_l1(x, feats, y))
        meta = m.select(F.lit(ds).alias("dataset"), "*", F.lit(len(d.columns)).alias("n_cols_kept"),
                        F.lit(len(feats)).alias("n_features"))
        out = meta if out is None else out.unionByName(meta)
    return out
