"""Registered queries: profiling."""

from __future__ import annotations

from scorelab.operators import profiling as P
from scorelab.plans.catalog import query
from scorelab.sources.bindings import credit_customer, credit_orders, lineitem_gaps, table

GAP_COLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
            ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
            ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
NUM = ["o_totalprice", "n_lines", "avg_discount", "sum_qty"]


@query("table_shape", """SELECT 'rows' AS metric, count(*) AS value FROM lineitem
UNION ALL SELECT 'columns', 11""")
def q_table_shape(spark, d):
    """Rows and columns of lineitem."""
    return P.table_shape(table(spark, d, "lineitem"))


INFO = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) - count({c}) AS nulls, "
    f"count({c}) * 100.0::DOUBLE / count(*) AS pct_non_null, '{t}' AS dtype FROM lineitem_gaps"
    for c, t in GAP_COLS)


@query("column_info", INFO, views=("lineitem_gaps",), rnd=["pct_non_null"])
def q_column_info(spark, d):
    """Non-null / null counts, share and type of every lineitem column (nulls by rule)."""
    return P.column_info(lineitem_gaps(spark, d))


@query("missing_summary", f"SELECT \"column\", nulls AS missing_count, pct_non_null AS percent_non_null FROM ({INFO})",
       views=("lineitem_gaps",), rnd=["percent_non_null"])
def q_missing_summary(spark, d):
    """Missing count and non-null share per column."""
    return P.missing_summary(lineitem_gaps(spark, d))


@query("null_total", "SELECT " + " + ".join(f"(count(*) - count({c}))" for c, _ in GAP_COLS)
       + " AS null_cells FROM lineitem_gaps", views=("lineitem_gaps",))
def q_null_total(spark, d):
    """Total null cells."""
    return P.null_total(lineitem_gaps(spark, d))


def _desc_sql(cols, digits=None):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", CAST(count({c}) AS DOUBLE) AS count, avg({c}) AS mean,
  stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
  quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM credit_orders""")
    return " UNION ALL ".join(parts)


@query("describe_numeric", f"""WITH lg AS ({_desc_sql(NUM)}),
tall AS (UNPIVOT lg ON count, mean, std, min, q25, q50, q75, max INTO NAME stat VALUE value)
SELECT CASE stat WHEN 'q25' THEN '25%' WHEN 'q50' THEN '50%' WHEN 'q75' THEN '75%' ELSE stat END AS stat,
""" + ",\n".join(f"first(round_even(value, 2)) FILTER (WHERE \"column\" = '{c}') AS {c}" for c in NUM)
       + "\nFROM tall GROUP BY 1", views=("credit_orders",), rnd=NUM)
def q_describe_numeric(spark, d):
    """count, mean, std, min, quartiles, max of the order features, half-even to 2 dp."""
    return P.describe_numeric(credit_orders(spark, d), NUM, 2)


@query("describe_all", f"""WITH lg AS ({_desc_sql(NUM + ['row_id', 'y'])})
SELECT "column", CAST(count AS BIGINT) AS count, NULL::BIGINT AS unique, NULL::VARCHAR AS top, NULL::BIGINT AS freq,
       mean, std, min, q25, q50, q75, max,
       CASE WHEN "column" IN ('row_id') THEN 'bigint' WHEN "column" = 'y' THEN 'int' ELSE 'double' END AS dtype FROM lg
UNION ALL
SELECT "column", sum(n) AS count, count(*) AS unique, arg_min(v, (-n, v)) AS top, max(n) AS freq,
       NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'string' FROM (
  SELECT 'dataset' AS "column", dataset AS v, count(*) AS n FROM credit_orders GROUP BY 2
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM credit_orders GROUP BY 2) GROUP BY 1""",
       views=("credit_orders",), rnd=["mean", "std", "min", "q25", "q50", "q75", "max"])
def q_describe_all(spark, d):
    """Per column: count, unique, top, freq, numeric stats and dtype."""
    return P.describe_all(credit_orders(spark, d))


@query("target_distribution", """SELECT y AS value, count(*) AS count,
  round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM credit_customer), 2) AS percentage
FROM credit_customer WHERE y IS NOT NULL GROUP BY y""", views=("credit_customer",), rnd=["percentage"])
def q_target_distribution(spark, d):
    """Class counts and share of the rare-class customer target."""
    return P.target_distribution(credit_customer(spark, d), "y")


@query("value_counts", """SELECT l_returnflag AS value, count(*) AS count,
  count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem_gaps) AS percent
FROM lineitem_gaps GROUP BY l_returnflag""", views=("lineitem_gaps",), rnd=["percent"])
def q_value_counts(spark, d):
    """Counts per return flag including the null value."""
    return P.value_counts(lineitem_gaps(spark, d), "l_returnflag")


CORR_COLS = NUM + ["y"]


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM credit_orders" for a in CORR_COLS for b in CORR_COLS),
       views=("credit_orders",), rnd=["r"])
def q_correlation_matrix(spark, d):
    """Pearson correlation of every pair of order features and the target."""
    return P.correlation_matrix(credit_orders(spark, d), CORR_COLS)


@query("target_correlation", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, y) AS r FROM credit_orders" for c in NUM)
       + ") WHERE r IS NOT NULL ORDER BY abs(r) DESC, feature LIMIT 10", views=("credit_orders",), rnd=["r"])
def q_target_correlation(spark, d):
    """Features by absolute correlation with the target, top 10."""
    return P.target_correlation(credit_orders(spark, d), "y", NUM, 10)


def _profile_sql(cols):
    parts = []
    for c in cols:
        m = f"avg({c})"
        parts.append(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct",
  CAST(sum(CASE WHEN {c} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, avg({c}) AS mean, stddev_samp({c}) AS std,
  (SELECT avg(power({c} - mu, 3)) / power(avg(power({c} - mu, 2)), 1.5) FROM credit_orders, (SELECT {m} AS mu FROM credit_orders)) AS skew,
  (SELECT avg(power({c} - mu, 4)) / power(avg(power({c} - mu, 2)), 2) - 3 FROM credit_orders, (SELECT {m} AS mu FROM credit_orders)) AS kurtosis,
  quantile_cont({c}, 0.05) AS q05, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
  quantile_cont({c}, 0.75) AS q75, quantile_cont({c}, 0.95) AS q95, 'double' AS dtype FROM credit_orders""")
    return " UNION ALL ".join(parts)


@query("profile", _profile_sql(NUM), views=("credit_orders",),
       rnd=["mean", "std", "skew", "kurtosis", "q05", "q25", "q50", "q75", "q95"])
def q_profile(spark, d):
    """Per-column profile: missing, distinct, zeros, moments, quantiles, skew and kurtosis."""
    return P.profile(credit_orders(spark, d), NUM)


def _bin_sql(c, bins=10):
    return (f"CASE WHEN mx_{c} = mn_{c} THEN 0 ELSE CAST(least(floor(({c} - mn_{c}) / (mx_{c} - mn_{c}) * {bins}), "
            f"{bins - 1}) AS INTEGER) END")


MM = "mm AS (SELECT " + ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in NUM) + " FROM credit_orders)"


@query("histogram", f"""WITH {MM}, b AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_bin_sql(c)} AS bin FROM credit_orders, mm WHERE {c} IS NOT NULL" for c in NUM) + """),
e AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", mn_{c} AS lo0, mx_{c} AS hi0 FROM mm WHERE mn_{c} IS NOT NULL" for c in NUM) + """),
g AS (SELECT "column", bin::INTEGER AS bin, lo0, hi0 FROM e, range(10) r(bin) WHERE bin = 0 OR lo0 <> hi0)
SELECT "column", bin, any_value(lo0) + bin * ((any_value(hi0) - any_value(lo0)) / 10) AS lo,
       any_value(lo0) + (bin + 1) * ((any_value(hi0) - any_value(lo0)) / 10) AS hi, count(b.bin) AS n
FROM g LEFT JOIN b USING ("column", bin) GROUP BY "column", bin""", views=("credit_orders",), rnd=["lo", "hi"])
def q_histogram(spark, d):
    """Equal-width 10-bin histograms of the order features."""
    return P.histogram(credit_orders(spark, d), NUM, 10)


@query("pair_bins", f"""WITH {MM}, b AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {_bin_sql(a)} AS bin_a, {_bin_sql(b)} AS bin_b FROM credit_orders, mm "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for i, a in enumerate(NUM) for b in NUM[i + 1:]) + """)
SELECT a, b, bin_a, bin_b, count(*) AS n FROM b GROUP BY ALL""", views=("credit_orders",))
def q_pair_bins(spark, d):
    """2-D binned counts for every pair of order features."""
    return P.pair_bins(credit_orders(spark, d), NUM, 10)


def _top_sql(table, col, cast=""):
    return (f"SELECT '{col}' AS \"column\", {col}{cast} AS value, count(*) AS count FROM {table} WHERE {col} IS NOT NULL GROUP BY {col}")


TOP = [("events", "event_type", ""), ("events", "props", ""), ("events", "user_id", "::VARCHAR"), ("pages", "url", ""), ("documents", "source", "")]


@query("frequent_values", f"""WITH c AS ({" UNION ALL ".join(_top_sql(*t) for t in TOP)}),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, encode(value)) AS rank FROM c)
SELECT "column", value, count, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def q_frequent_values(spark, d):
    """The 5 most frequent values of text and id columns, skewed and all different ones."""
    parts = [P.frequent_values(table(spark, d, t), [c for u, c, _ in TOP if u == t], 5) for t in ("events", "pages", "documents")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
