"""Registered queries: split, sample, resample.

Row choice is a seeded xxhash64 order that DuckDB cannot reproduce, so the oracles state the
exact sizes (per stratum and class) that the allocation rules must give; membership properties
(disjoint, stable under repartitioning, rows drawn from the right class) are pytest properties.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelab.operators import resample as S
from scorelab.plans.catalog import query
from scorelab.session import written_once
from scorelab.sources.bindings import credit_customer, credit_events, credit_orders


def alloc_sql(src: str, draws: str, by: str = "dataset") -> str:
    """CTE text: per (by, y) class count and its largest-remainder share of ``draws``."""
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""cc AS (SELECT {sel}y, count(*) AS n_class FROM {src} GROUP BY ALL),
t1 AS (SELECT *, sum(n_class) OVER ({part}) AS n_total FROM cc),
t2 AS (SELECT *, CAST({draws} AS BIGINT) AS draws FROM t1),
t3 AS (SELECT *, floor(n_class / n_total * draws) AS fl, n_class / n_total * draws - floor(n_class / n_total * draws) AS rem FROM t2),
t4 AS (SELECT *, draws - sum(fl) OVER ({part}) AS need, row_number() OVER ({part} ORDER BY rem DESC, y) AS r FROM t3),
al AS (SELECT {sel}y, n_class, CAST(fl + CASE WHEN r <= need THEN 1 ELSE 0 END AS BIGINT) AS alloc FROM t4)"""


@query("stratified_split", "WITH " + alloc_sql("credit_orders", "n_total - ceil(0.2::DOUBLE * n_total)") + """
SELECT * FROM (SELECT dataset, 'train' AS split, y, alloc AS n FROM al
               UNION ALL SELECT dataset, 'test', y, n_class - alloc FROM al) WHERE n > 0""",
       views=("credit_orders",))
def q_stratified_split(spark, d):
    """Exact 80/20 stratified split of each orders dataset: rows per (dataset, split, class)."""
    s = S.stratified_split(credit_orders(spark, d), "y", 0.2, 42, by=["dataset"])
    return s.groupBy("dataset", "split", "y").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_kfold", """WITH cc AS (SELECT y, count(*) AS c FROM credit_customer GROUP BY y)
SELECT * FROM (SELECT CAST(f AS INTEGER) AS fold, y, CAST(c // 5 + CASE WHEN f < c % 5 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM cc, (SELECT range AS f FROM range(5))) WHERE n > 0""", views=("credit_customer",))
def q_stratified_kfold(spark, d):
    """5 stratified folds of the customers: rows per (fold, class)."""
    k = S.stratified_kfold(credit_customer(spark, d), "y", 5, 42)
    return k.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_sample", "WITH " + alloc_sql("credit_orders", "least(1000, n_total)") + """
SELECT dataset, y, alloc AS n FROM al WHERE alloc > 0""", views=("credit_orders",))
def q_stratified_sample(spark, d):
    """1000 rows per orders dataset keeping class shares: rows per (dataset, class)."""
    s = S.stratified_sample(credit_orders(spark, d), "y", 1000, 42, by=["dataset"])
    return s.groupBy("dataset", "y").agg(F.count(F.lit(1)).alias("n"))


@query("uniform_sample", "SELECT least(200, count(*)) AS n, least(200, count(*)) AS n_distinct FROM events")
def q_uniform_sample(spark, d):
    """200 events drawn without replacement: size and distinct ids of the draw."""
    s = S.uniform_sample(credit_events(spark, d), 200, 42)
    return s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("n_distinct"))


@query("oversample_random", """SELECT y, max(n_class) OVER () AS n FROM (SELECT y, count(*) AS n_class
FROM credit_customer GROUP BY y)""", views=("credit_customer",))
def q_oversample_random(spark, d):
    """Customers with the rare class drawn with replacement up to the majority count."""
    o = S.oversample_random(credit_customer(spark, d), "y", 42)
    return o.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query("bootstrap_rows", """SELECT dataset, CAST(b AS INTEGER) AS b, c AS n FROM
(SELECT dataset, count(*) AS c FROM credit_orders GROUP BY dataset), (SELECT range AS b FROM range(20))""",
       views=("credit_orders",))
def q_bootstrap_rows(spark, d):
    """20 bootstrap resamples per orders dataset: every replicate holds exactly n draws."""
    bs = S.bootstrap_draws(written_once(credit_orders(spark, d).select("dataset", "row_id")), 20, 42, by=["dataset"])
    return bs.groupBy("dataset", "b").agg(F.sum("weight").alias("n"))


@query("permute_labels", "SELECT y, count(*) AS n FROM credit_orders GROUP BY y", views=("credit_orders",))
def q_permute_labels(spark, d):
    """Labels shuffled against rows within each dataset: class counts unchanged."""
    p = S.permute_labels(credit_orders(spark, d), "y", 42, by=["dataset"])
    return p.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


SPLIT_CUST = alloc_sql("credit_customer", "n_total - ceil(0.2::DOUBLE * n_total)", by="")


@query("smote_preview", f"""WITH {SPLIT_CUST}
SELECT y AS class, alloc AS n_before, CASE WHEN count(*) OVER () >= 2 THEN max(alloc) OVER () END AS n_after,
  CASE WHEN count(*) OVER () < 2 THEN 'SMOTE needs at least two classes' END AS error FROM al""",
       views=("credit_customer",))
def q_smote_preview(spark, d):
    """Class counts after an 80/20 split and balancing of the customers."""
    return S.smote_preview(credit_customer(spark, d), "y", 0.2, 42)


@query("smote_distribution", f"""WITH {SPLIT_CUST}, x AS (SELECT y AS class, alloc AS n0, max(alloc) OVER () AS n1 FROM al)
SELECT class, n0, n1, round_even(n0 * 100.0::DOUBLE / sum(n0) OVER (), 0) AS pct0,
  round_even(n1 * 100.0::DOUBLE / sum(n1) OVER (), 0) AS pct1 FROM x""", views=("credit_customer",),
       rnd=["pct0", "pct1"])
def q_smote_distribution(spark, d):
    """Class counts and shares before / after balancing the customer train split (random oversampling)."""
    tr = S.stratified_split(credit_customer(spark, d), "y", 0.2, 42).where(F.col("split") == "train")
    return S.smote_distribution(tr, S.oversample_random(tr, "y", 42))


@query("class_balance", f"""WITH {SPLIT_CUST}
SELECT 'raw' AS stage, y AS class, n_class AS n FROM al
UNION ALL SELECT 'train', y, alloc FROM al UNION ALL SELECT 'test', y, n_class - alloc FROM al""",
       views=("credit_customer",))
def q_class_balance(spark, d):
    """Class counts of the raw customers and of both sides of the split."""
    df = credit_customer(spark, d)
    s = S.stratified_split(df, "y", 0.2, 42)
    return S.class_balance({"raw": df, "train": s.where("split = 'train'"), "test": s.where("split = 'test'")})
