"""Registered queries: projection and preprocessing (2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelab.operators import prep as R
from scorelab.operators import project as J
from scorelab.operators import profiling as P
from scorelab.plans.catalog import query
from scorelab.sources.bindings import credit_customer, credit_orders, lineitem_gaps, table

NUM = ["o_totalprice", "n_lines", "avg_discount", "sum_qty"]
SMALL = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag"]
SMALL_SQL = "small AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag FROM lineitem_gaps)"
DBL = ["l_quantity", "l_discount", "l_tax"]
ORD_COLS = ["dataset", "row_id", "o_totalprice", "n_lines", "avg_discount", "sum_qty", "o_orderpriority", "y"]


def small(spark, d):
    return lineitem_gaps(spark, d).select(*SMALL)


@query("drop_null_rows", f"WITH {SMALL_SQL} SELECT * FROM small WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in SMALL), views=("lineitem_gaps",), rnd=DBL)
def q_drop_null_rows(spark, d):
    """Line rows without any null."""
    return R.drop_null_rows(small(spark, d))


@query("impute_median", f"""WITH {SMALL_SQL} SELECT * REPLACE (
  coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM small)) AS l_discount,
  coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM small)) AS l_tax) FROM small""",
       views=("lineitem_gaps",), rnd=DBL)
def q_impute_median(spark, d):
    """Nulls of discount and tax -> exact column median."""
    return R.impute_median(small(spark, d), ["l_discount", "l_tax"])


@query("impute_mean", f"""WITH {SMALL_SQL} SELECT * REPLACE (
  coalesce(l_discount, (SELECT avg(l_discount) FROM small)) AS l_discount,
  coalesce(l_tax, (SELECT avg(l_tax) FROM small)) AS l_tax) FROM small""", views=("lineitem_gaps",), rnd=DBL)
def q_impute_mean(spark, d):
    """Nulls of discount and tax -> column mean."""
    return R.impute_mean(small(spark, d), ["l_discount", "l_tax"])


@query("impute_mode", f"""WITH {SMALL_SQL} SELECT * REPLACE (coalesce(l_returnflag, (SELECT v FROM (
  SELECT l_returnflag AS v, count(*) AS n FROM small WHERE l_returnflag IS NOT NULL GROUP BY 1)
  ORDER BY n DESC, v LIMIT 1)) AS l_returnflag) FROM small""", views=("lineitem_gaps",), rnd=DBL)
def q_impute_mode(spark, d):
    """Null return flags -> most frequent flag (ties: smallest)."""
    return R.impute_mode(small(spark, d), ["l_returnflag"])


@query("cast_text", f"WITH {SMALL_SQL} SELECT * REPLACE (CAST(l_linenumber AS VARCHAR) AS l_linenumber) FROM small",
       views=("lineitem_gaps",), rnd=DBL)
def q_cast_text(spark, d):
    """Line number as text."""
    return R.cast_text(small(spark, d), ["l_linenumber"])


@query("scale_standard", "SELECT * REPLACE (" + ", ".join(
    f"({c} - (SELECT avg({c}) FROM credit_orders)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END "
    f"FROM credit_orders) AS {c}" for c in NUM) + ") FROM credit_orders", views=("credit_orders",), rnd=NUM)
def q_scale_standard(spark, d):
    """Order features standardised with the population std."""
    return R.scale_standard(credit_orders(spark, d), NUM)


@query("scale_minmax", "SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN (SELECT max({c}) - min({c}) FROM credit_orders) = 0 THEN CASE WHEN {c} IS NOT NULL THEN 0.0 END "
    f"ELSE ({c} - (SELECT min({c}) FROM credit_orders)) / (SELECT max({c}) - min({c}) FROM credit_orders) END AS {c}"
    for c in NUM) + ") FROM credit_orders", views=("credit_orders",), rnd=NUM)
def q_scale_minmax(spark, d):
    """Order features scaled to [0, 1]."""
    return R.scale_minmax(credit_orders(spark, d), NUM)


# The order priorities of the star schema.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _dummies(col: str, levels: list[str], one: str = "1", zero: str = "0") -> str:
    return ", ".join(f"""CASE WHEN {col} = '{v}' THEN {one} ELSE {zero} END AS "{col}={v}\"""" for v in levels)


@query("one_hot", f"""SELECT dataset, row_id, o_totalprice, n_lines, avg_discount, sum_qty, y, {_dummies("o_orderpriority", PRIORITIES)}
FROM credit_orders""", views=("credit_orders",), rnd=NUM)
def q_one_hot(spark, d):
    """Full one-hot of order priority (levels learned from the data)."""
    return R.one_hot(credit_orders(spark, d), ["o_orderpriority"])


SPARSE = ("event_type", "props", "user_id")


@query("sparse_one_hot", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c}::VARCHAR AS level, count(*)::DOUBLE AS n FROM events WHERE {c} IS NOT NULL GROUP BY {c}""" for c in SPARSE), rnd=["n"])
def q_sparse_one_hot(spark, d):
    """Text and id columns of all events as sparse one-hot vectors, levels of any number: the sum of each place."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    rows, names = R.sparse_one_hot(table(spark, d, "events").select(*SPARSE), SPARSE)
    total = rows.select(Summarizer.sum(F.col("features")).alias("s")).select(F.posexplode(vector_to_array("s")).alias("index", "n"))
    return names.join(total, "index").select("column", "level", "n")


@query("dummies_with_null", f"""SELECT l_orderkey, l_linenumber, l_quantity, coalesce(nullif(l_discount, 0.0::DOUBLE), 0) AS l_discount,
  coalesce(nullif(l_tax, 0.08::DOUBLE), 0) AS l_tax, {_dummies("l_returnflag", ["A", "R"])},
  CASE WHEN l_returnflag IS NULL OR l_returnflag = 'N' THEN 1 ELSE 0 END AS "l_returnflag=null"
FROM lineitem""", rnd=DBL)
def q_dummies_with_null(spark, d):
    """Return flag one-hot with a null indicator, numeric nulls -> 0."""
    return R.dummies_with_null(small(spark, d), ["l_returnflag"])


@query("label_encode", """SELECT * REPLACE (CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER)
  AS o_orderpriority) FROM credit_orders""", views=("credit_orders",), rnd=NUM)
def q_label_encode(spark, d):
    """Order priority -> 0..k-1 in lexicographic order."""
    return R.label_encode(credit_orders(spark, d), ["o_orderpriority"])


@query("factorize", """WITH f AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY min(row_id)) - 1 AS INTEGER) AS code
  FROM credit_customer GROUP BY c_mktsegment)
SELECT c.* REPLACE (f.code AS c_mktsegment) FROM credit_customer c JOIN f USING (c_mktsegment)""",
       views=("credit_customer",), rnd=["n_orders", "sum_price", "avg_price", "c_nationkey"])
def q_factorize(spark, d):
    """Market segment -> code by first appearance in row order."""
    return R.factorize(credit_customer(spark, d), ["c_mktsegment"])


@query("expanded_names", """SELECT * FROM (VALUES ('o_totalprice', 'o_totalprice', NULL), ('n_lines', 'n_lines', NULL),
  ('avg_discount', 'avg_discount', NULL), ('sum_qty', 'sum_qty', NULL)) AS t(expanded, raw, level)
UNION ALL SELECT DISTINCT 'o_orderpriority=' || o_orderpriority, 'o_orderpriority', o_orderpriority FROM credit_orders""",
       views=("credit_orders",))
def q_expanded_names(spark, d):
    """Expanded model input -> raw column and level, from a preprocessor fitted on orders."""
    return R.fit_preprocessor(credit_orders(spark, d), "y").expanded_names(spark)


PRE_SQL = ("imp AS (SELECT dataset, row_id, y, o_orderpriority, "
           + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM credit_orders)) AS {c}" for c in NUM)
           + " FROM credit_orders), sc AS (SELECT dataset, row_id, y, o_orderpriority, "
           + ", ".join(f"({c} - (SELECT avg({c}) FROM imp)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE "
                       f"stddev_pop({c}) END FROM imp) AS {c}" for c in NUM) + " FROM imp)")


@query("fit_preprocessor", f"""WITH {PRE_SQL}
SELECT dataset, row_id, y, {', '.join(NUM)}, {_dummies("o_orderpriority", PRIORITIES, "1.0::DOUBLE", "0.0::DOUBLE")}
FROM sc""", views=("credit_orders",), rnd=NUM + [f"o_orderpriority={p}" for p in PRIORITIES])
def q_fit_preprocessor(spark, d):
    """Median + standard scaling for numbers, mode + one-hot for text, learned on the rows, applied."""
    df = credit_orders(spark, d)
    return R.fit_preprocessor(df, "y").transform(df)


@query("select_features", "SELECT o_totalprice, sum_qty, y FROM credit_orders", views=("credit_orders",),
       rnd=["o_totalprice", "sum_qty"])
def q_select_features(spark, d):
    """Chosen features plus the target."""
    return J.select_features(credit_orders(spark, d), ["o_totalprice", "sum_qty"], "y")


def importance_by_corr(df):
    """Importance of every expanded input = |corr(input, y)| (one aggregate pass)."""
    oh = R.one_hot(df, ["o_orderpriority"])
    feats = NUM + [c for c in oh.columns if c.startswith("o_orderpriority=")]
    t = P.target_correlation(oh, "y", feats, n=len(feats))
    return t.select("feature", F.abs("r").alias("importance"))


@query("select_top_features", f"""WITH j AS (SELECT *, {_dummies("o_orderpriority", PRIORITIES)} FROM credit_orders),
imp AS (""" + " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS importance FROM j" for c in NUM]
    + [f"SELECT 'o_orderpriority={p}', abs(corr(\"o_orderpriority={p}\", y)) FROM j"
       for p in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]]) + """),
agg AS (SELECT regexp_extract(feature, '^([^=]*)', 1) AS raw, sum(importance) AS importance FROM imp
        WHERE importance IS NOT NULL GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY importance DESC, raw) AS INTEGER) AS rank, raw, importance FROM agg
ORDER BY importance DESC, raw LIMIT 3""", views=("credit_orders",), rnd=["importance"])
def q_select_top_features(spark, d):
    """Top 3 raw features by summed |corr| of their expanded parts (one-hot levels summed back)."""
    return J.top_raw_features(importance_by_corr(credit_orders(spark, d)), 3)


@query("drop_sparse_columns", f"""WITH {SMALL_SQL} SELECT *, missing_ratio <= 0.4 AS kept FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS missing_ratio FROM small"
    for c in SMALL) + ") AS small_report",
       views=("lineitem_gaps",), rnd=["missing_ratio"])
def q_drop_sparse_columns(spark, d):
    """Missing share per column and whether it stays at a 0.4 limit."""
    return J.sparse_column_report(small(spark, d), None, 0.4)


@query("coerce_numeric", """WITH e AS (SELECT event_id, event_type, props, CAST(value AS VARCHAR) AS value_txt FROM events),
ct AS (SELECT event_type AS v, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM e)),
cp AS (SELECT props AS v, dense_rank() OVER (ORDER BY props) - 1 AS code FROM (SELECT DISTINCT props FROM e))
SELECT e.event_id, CAST(ct.code AS DOUBLE) AS event_type, CAST(cp.code AS DOUBLE) AS props,
       coalesce(TRY_CAST(e.value_txt AS DOUBLE), (SELECT quantile_cont(TRY_CAST(value_txt AS DOUBLE), 0.5) FROM e)) AS value_txt
FROM e JOIN ct ON e.event_type = ct.v JOIN cp ON e.props = cp.v""", rnd=["event_type", "props", "value_txt"])
def q_coerce_numeric(spark, d):
    """Text columns -> numbers when they parse, else sorted category codes; nulls -> median."""
    ev = table(spark, d, "events").select("event_id", "event_type", "props",
                                          F.col("value").cast("string").alias("value_txt"))
    return J.coerce_numeric(ev, ["event_type", "props", "value_txt"])


@query("row_lookup", "SELECT * FROM credit_orders WHERE row_id = 1", views=("credit_orders",), rnd=NUM)
def q_row_lookup(spark, d):
    """The order row with id 1."""
    return J.row_lookup(credit_orders(spark, d), 1)


@query("pick_instances", "SELECT * FROM credit_orders WHERE row_id IN (1, 2, 3, 7, 999999999)",
       views=("credit_orders",), rnd=NUM)
def q_pick_instances(spark, d):
    """Explicit instance list (invalid ids ignored)."""
    return J.pick_instances(credit_orders(spark, d), [1, 2, 3, 7, 999999999])
