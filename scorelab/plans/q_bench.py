"""Registered queries: benchmark and comparison tables over the metric bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelab.operators import benchmark as B
from scorelab.operators import metrics as M
from scorelab.plans.catalog import query
from scorelab.plans.q_metrics import CURVE, HSQL, G
from scorelab.sources.bindings import credit_orders, scores_orders

VIEWS = ("credit_orders", "scores_orders")
MB = f"{CURVE}, {HSQL},\nmb AS (SELECT {G}, AUC, PCC, F1, Recall, BS, KS, PG, H FROM m JOIN hm USING ({G}))"
ALL8 = ["AUC", "PCC", "F1", "Recall", "BS", "KS", "PG", "H"]


def wide(spark, d):
    """The metric bundle of the three scorers: the input of every benchmark table."""
    tau = M.metric_prevalence(credit_orders(spark, d), ["dataset"])
    return M.metric_bundle(scores_orders(spark, d), tau)


@query("rank_models", f"""WITH {MB}
SELECT *, CAST(row_number() OVER (PARTITION BY dataset ORDER BY AUC DESC NULLS LAST, model_group, model) AS INTEGER) AS rank
FROM mb""", views=VIEWS, rnd=ALL8)
def q_rank_models(spark, d):
    """Rank models within each dataset by AUC (1 = best)."""
    return B.rank_models(wide(spark, d), "AUC")


@query("top_k_models", f"""WITH {MB}, r AS (
SELECT *, CAST(row_number() OVER (PARTITION BY dataset ORDER BY AUC DESC NULLS LAST, model_group, model) AS INTEGER) AS rank
FROM mb) SELECT dataset, rank, model_group, model, AUC, F1, KS FROM r WHERE rank <= 2""",
       views=VIEWS, rnd=["AUC", "F1", "KS"])
def q_top_k_models(spark, d):
    """Top 2 models per dataset by AUC with F1 and KS."""
    return B.top_k_models(wide(spark, d), 2, "AUC", ("F1", "KS"))


@query("best_per_dataset", f"""WITH {MB}, r AS (
SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY KS DESC NULLS LAST, model_group, model) AS rk
FROM mb WHERE KS IS NOT NULL) SELECT dataset, model_group, model, KS AS best_KS FROM r WHERE rk = 1""",
       views=VIEWS, rnd=["best_KS"])
def q_best_per_dataset(spark, d):
    """Best model per dataset by KS."""
    return B.best_per_dataset(wide(spark, d), "KS")


@query("cross_dataset_best", f"""WITH {MB}, r AS (
SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY AUC DESC NULLS LAST, model_group, model) AS rk
FROM mb WHERE AUC IS NOT NULL) SELECT dataset, model_group, model, AUC, F1, KS FROM r WHERE rk = 1""",
       views=VIEWS, rnd=["AUC", "F1", "KS"])
def q_cross_dataset_best(spark, d):
    """Best model per dataset with primary (AUC) and secondary (F1, KS) metrics."""
    return B.cross_dataset_best(wide(spark, d), "AUC", ("F1", "KS"))


@query("comparison_pivot", f"""WITH {MB}
SELECT model_group, model,
  first(AUC) FILTER (WHERE dataset = 'orders_0') AS orders_0,
  first(AUC) FILTER (WHERE dataset = 'orders_1') AS orders_1,
  first(AUC) FILTER (WHERE dataset = 'orders_2') AS orders_2
FROM mb GROUP BY model_group, model""", views=VIEWS, rnd=["orders_0", "orders_1", "orders_2"])
def q_comparison_pivot(spark, d):
    """AUC of every (group, model) pivoted by dataset."""
    return B.comparison_pivot(wide(spark, d), "AUC")


@query("group_mean_auc", f"""WITH {MB}
SELECT model_group, model, avg(AUC) AS mean_auc, count(*) AS n_datasets FROM mb
WHERE AUC IS NOT NULL AND NOT isnan(AUC) GROUP BY model_group, model""", views=VIEWS, rnd=["mean_auc"])
def q_group_mean_auc(spark, d):
    """Mean AUC over datasets per (group, model)."""
    return B.group_mean_auc(wide(spark, d))


GM = f"""gm AS (SELECT model_group, model, avg(AUC) AS mean_auc FROM mb
WHERE AUC IS NOT NULL AND NOT isnan(AUC) GROUP BY model_group, model),
bg AS (SELECT model_group, model, mean_auc FROM (SELECT *, row_number() OVER (PARTITION BY model_group
       ORDER BY mean_auc DESC, model) AS r FROM gm) WHERE r = 1)"""


@query("best_per_group", f"WITH {MB}, {GM} SELECT * FROM bg", views=VIEWS, rnd=["mean_auc"])
def q_best_per_group(spark, d):
    """Benchmark model per group: argmax of mean AUC."""
    return B.best_per_group(wide(spark, d))


@query("benchmark_table", f"""WITH {MB}, {GM}
SELECT mb.dataset, mb.model_group, bg.model AS benchmark_model, 'No' AS smote,
       AUC, PCC, F1, Recall, BS, KS, PG, H
FROM mb JOIN bg ON mb.model_group = bg.model_group AND mb.model = bg.model""", views=VIEWS, rnd=ALL8)
def q_benchmark_table(spark, d):
    """The benchmark model's metrics on every dataset, with the balancing flag."""
    return B.benchmark_table(wide(spark, d), balanced=False)


@query("all_models_table", f"WITH {MB} SELECT {G}, 'No' AS smote, AUC, PCC, F1, Recall, BS, KS, PG, H FROM mb",
       views=VIEWS, rnd=ALL8)
def q_all_models_table(spark, d):
    """All models with their metrics, ordered by group, model."""
    return B.all_models_table(wide(spark, d))


@query("metrics_long", f"""WITH {MB}
UNPIVOT mb ON AUC, PCC, F1, Recall, BS, KS, PG, H INTO NAME metric VALUE value""", views=VIEWS, rnd=["value"])
def q_metrics_long(spark, d):
    """Wide metric rows -> (dataset, group, model, metric, value)."""
    return B.metrics_long(wide(spark, d))


@query("training_summary", f"""WITH {MB}, lg AS (UNPIVOT mb ON AUC, PCC, F1, Recall, BS, KS, PG, H
INTO NAME metric VALUE value)
SELECT {G}, first(value) FILTER (WHERE metric = 'AUC') AS AUC, first(value) FILTER (WHERE metric = 'PCC') AS PCC,
  first(value) FILTER (WHERE metric = 'F1') AS F1, first(value) FILTER (WHERE metric = 'Recall') AS Recall,
  first(value) FILTER (WHERE metric = 'BS') AS BS, first(value) FILTER (WHERE metric = 'KS') AS KS,
  first(value) FILTER (WHERE metric = 'PG') AS PG, first(value) FILTER (WHERE metric = 'H') AS H
FROM lg GROUP BY {G}""", views=VIEWS, rnd=ALL8)
def q_training_summary(spark, d):
    """Long metric rows back to one wide row per model (long -> wide pivot)."""
    return B.training_summary(B.metrics_long(wide(spark, d)))


@query("summary_by_dataset", f"WITH {MB} SELECT * FROM mb WHERE dataset = 'orders_1'", views=VIEWS, rnd=ALL8)
def q_summary_by_dataset(spark, d):
    """The slice of the summary for one dataset."""
    return B.summary_by_dataset(wide(spark, d), "orders_1")


FAMILY_SQL = "CASE " + " ".join(
    f"WHEN contains(lower(model), '{g.lower()}') THEN '{g}'" for g in B.FAMILY_ORDER) + " ELSE model END"


@query("model_family", f"""SELECT DISTINCT c_mktsegment AS model,
  {FAMILY_SQL} AS family
FROM (SELECT lower(c_mktsegment) || '_' || n_name AS c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def q_model_family(spark, d):
    """Family label of names by first matching fixed substring (run over customer x nation labels)."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    n = spark.read.parquet(f"{d}/nation.parquet")
    names = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lower("c_mktsegment"), F.lit("_"), F.col("n_name")).alias("model"))
    return names.select("model", B.model_family("model").alias("family")).distinct()


@query("metric_chart_data", f"""WITH {MB}
SELECT coalesce(model_group, 'Unknown') AS model_group, coalesce(replace(dataset, '.csv', ''), 'Unknown') AS dataset,
       avg(KS) AS mean_KS FROM mb GROUP BY 1, 2""", views=VIEWS, rnd=["mean_KS"])
def q_metric_chart_data(spark, d):
    """Mean KS by model group x dataset."""
    return B.metric_chart_data(wide(spark, d), "KS")


@query("model_frequency", f"""WITH {MB}, {GM}
SELECT bg.model AS model, count(*) AS n FROM mb JOIN bg ON mb.model_group = bg.model_group AND mb.model = bg.model
GROUP BY bg.model""", views=VIEWS)
def q_model_frequency(spark, d):
    """How often each model is the benchmark of its group across datasets."""
    return B.model_frequency(B.benchmark_table(wide(spark, d)))


@query("model_avg_auc", f"""WITH {MB}
SELECT model, avg(AUC) AS mean, stddev_samp(AUC) AS std FROM mb WHERE AUC IS NOT NULL
GROUP BY model ORDER BY mean DESC, model LIMIT 15""", views=VIEWS, rnd=["mean", "std"])
def q_model_avg_auc(spark, d):
    """Mean and sample std of AUC per model across datasets, top 15."""
    return B.model_avg_auc(wide(spark, d), 15)
