"""Registered queries: sources, sinks, result tables and streaming counters (2.13).

Sinks write below the session's checkpoint folder (a shared folder on a cluster), each query in
a fresh sub-folder; what they read back is data Spark derived from the test tables.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelab.operators import resample as S
from scorelab.plans.catalog import query
from scorelab.plans.q_resample import alloc_sql
from scorelab.session import ensure_checkpoint_dir
from scorelab.sources import io as IO
from scorelab.sources.bindings import credit_customer, credit_orders, table
from scorelab.streaming import stream as ST


def scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scorelab_io/{uuid.uuid4().hex}"


@query("read_dataset", "SELECT 'lineitem' AS dataset, count(*) AS n_rows, count(*) AS n_ids FROM lineitem")
def q_read_dataset(spark, d):
    """lineitem read as a dataset: its natural key is not unique, so row ids come from the row
    hash plus a tie counter; every row gets a distinct id."""
    df = IO.read_dataset(spark, f"{d}/lineitem.parquet", "lineitem", target=None, fmt="parquet")
    return df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("row_id").alias("n_ids"))


@query("read_many", """SELECT 'orders' AS dataset, count(*) AS n_rows FROM orders
UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'missing', NULL""")
def q_read_many(spark, d):
    """orders + customer (written as CSV first) + a missing file: two datasets loaded, the missing one
    recorded as an error."""
    csv = f"{scratch(spark)}/customer.csv"
    table(spark, d, "customer").write.option("header", True).csv(csv)
    specs = [{"path": f"{d}/orders.parquet", "name": "orders", "target": None, "fmt": "parquet", "key": "o_orderkey"},
             {"path": csv, "name": "customer", "target": None, "fmt": "csv", "key": "c_custkey"},
             {"path": f"{d}/no_such_table.parquet", "name": "missing", "target": None, "fmt": "parquet"}]
    out, errors = IO.read_many(spark, specs)
    counts = out.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.unionByName(errors.select("dataset", F.lit(None).cast("long").alias("n_rows")))


@query("head_sample", "SELECT * FROM credit_orders ORDER BY row_id LIMIT 5", views=("credit_orders",),
       rnd=["o_totalprice", "n_lines", "avg_discount", "sum_qty"])
def q_head_sample(spark, d):
    """The first five orders by id."""
    return IO.head_sample(credit_orders(spark, d), 5)


@query("save_split", "WITH " + alloc_sql("credit_customer", "n_total - ceil(0.2::DOUBLE * n_total)", by="") + """,
m AS (SELECT 'train' AS split, y AS class, alloc AS n FROM al UNION ALL SELECT 'test', y, n_class - alloc FROM al)
SELECT 'customer' AS dataset, split, CAST(sum(n) OVER (PARTITION BY split) AS BIGINT) AS n_rows, 8 AS n_cols, class, n,
  42 AS seed FROM m WHERE n > 0""", views=("credit_customer",))
def q_save_split(spark, d):
    """Customer split written partitioned by split; metadata read back from the written files."""
    s = S.stratified_split(credit_customer(spark, d), "y", 0.2, 42)
    return IO.save_split(s, scratch(spark), "customer", 42)


@query("result_table_io", """SELECT user_id, event_type, n, total FROM (SELECT user_id, event_type, count(*) AS n, NULL::DOUBLE AS total FROM events GROUP BY ALL
  UNION ALL SELECT user_id, NULL, NULL, sum(value) FROM events GROUP BY user_id)""", rnd=["total"])
def q_result_table_io(spark, d):
    """Two kinds of result tables with different columns, saved and loaded back; a missing table
    loads as None."""
    root, ev = scratch(spark), table(spark, d, "events")
    IO.result_table_io(ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")), root, "counts", "events")
    IO.result_table_io(ev.groupBy("user_id").agg(F.sum("value").alias("total")), root, "totals", "events")
    assert IO.result_table_io(None, root, "counts", "nope", spark) is None
    parts = [IO.result_table_io(None, root, kind, "events", spark) for kind in ("counts", "totals")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def _records_root(spark, d) -> str:
    from scorelab.operators.paired import paired_comparison
    from scorelab.sources.bindings import scores_orders

    root = scratch(spark)
    rec = paired_comparison(scores_orders(spark, d), "lin_a", "lin_b")
    IO.record_store(rec, root, "comparison")
    IO.record_store(rec, root, "comparison")  # a second batch continues the numbering
    return root


@query("record_store")
def q_record_store(spark, d):
    """Paired-comparison records appended twice: ids continue per dataset (1..2)."""
    root = _records_root(spark, d)
    return spark.read.schema(IO.RECORD_SCHEMA.replace("kind string, ", "")).json(f"{root}/records/kind=comparison")


@query("recent_records")
def q_recent_records(spark, d):
    """Newest stored comparison records of one dataset (at most 50)."""
    return IO.recent_records(spark, _records_root(spark, d), "comparison", "orders_1", 50)


def _artifacts(spark, d) -> str:
    from scorelab.plans.q_bench import wide
    from scorelab.operators.profiling import column_info

    root = _records_root(spark, d)
    IO.result_table_io(wide(spark, d), root, "benchmark", "orders")
    column_info(credit_orders(spark, d)).write.mode("overwrite").parquet(f"{root}/eda/dataset=orders/column_info")
    return root


@query("artifact_manifest")
def q_artifact_manifest(spark, d):
    """Which artifacts exist per dataset and kind (file metadata only)."""
    return IO.artifact_manifest(spark, _artifacts(spark, d))


@query("storage_summary")
def q_storage_summary(spark, d):
    """Files and MB per artifact category with a total row."""
    return IO.storage_summary(spark, _artifacts(spark, d))


@query("expired_artifacts")
def q_expired_artifacts(spark, d):
    """Artifacts older than 30 days as seen 31 days from now (all of them)."""
    return IO.expired_artifacts(spark, _artifacts(spark, d), 30, _dt.datetime.now() + _dt.timedelta(days=31))


@query("report_manifest", """WITH mb AS (SELECT DISTINCT dataset, model_group, model FROM scores_orders)
SELECT dataset, count(*) AS n_models, list(model ORDER BY model_group, model) AS models FROM mb GROUP BY dataset""",
       views=("scores_orders",))
def q_report_manifest(spark, d):
    """Completed models per dataset (names in group, model order)."""
    from scorelab.plans.q_bench import wide

    m = IO.report_manifest(wide(spark, d))
    return m.select("dataset", "n_models", F.transform("models", lambda s: s["model"]).alias("models"))


@query("sanitize_name", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(url, '.csv', ''),
  '[^\p{L}\p{N}_\-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM pages""")
def q_sanitize_name(spark, d):
    """Every page URL turned into a file-safe name."""
    p = table(spark, d, "pages")
    return p.select("page_id", IO.sanitize_name("url").alias("name"))


@query("dataset_fingerprint", """SELECT dataset, n_rows, stale FROM (SELECT dataset, count(*) AS n_rows, false AS stale FROM credit_orders GROUP BY dataset
  UNION ALL SELECT dataset || ' doubled', 2 * count(*), true FROM credit_orders GROUP BY dataset
  UNION ALL SELECT dataset || ' changed', count(*), true FROM credit_orders GROUP BY dataset)""", views=("credit_orders",))
def q_dataset_fingerprint(spark, d):
    """Signature of each orders dataset against the stored one: the same rows, every row twice, and
    one column changed by a null."""
    o = credit_orders(spark, d)
    stored = IO.dataset_fingerprint(o)
    first = F.col("row_id") == F.min("row_id").over(Window.partitionBy("dataset"))
    changed = o.withColumn("_f", first).withColumn("n_lines", F.when(~F.col("_f"), F.col("n_lines"))).drop("_f")
    same = IO.dataset_fingerprint(o, stored)
    twice = IO.dataset_fingerprint(o.unionAll(o), stored).withColumn("dataset", F.concat("dataset", F.lit(" doubled")))
    other = IO.dataset_fingerprint(changed, stored).withColumn("dataset", F.concat("dataset", F.lit(" changed")))
    return same.unionByName(twice).unionByName(other).select("dataset", "n_rows", "stale")


@query("stream_value_counts", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY event_type")
def q_stream_value_counts(spark, d):
    """Running event-type counts of the events file consumed as a stream."""
    ev = table(spark, d, "events")
    return ST.stream_value_counts(ST.file_stream(spark, f"{d}/events.parquet", ev), "event_type")


@query("stream_column_info", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) - count({c}) AS nulls FROM events"
    for c in ["event_id", "ts", "user_id", "event_type", "value", "props"]))
def q_stream_column_info(spark, d):
    """Running row and non-null counts per column of the events stream."""
    ev = table(spark, d, "events")
    return ST.stream_column_info(ST.file_stream(spark, f"{d}/events.parquet", ev))
