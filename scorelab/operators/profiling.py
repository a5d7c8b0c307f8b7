"""Profiling (EDA) operators.

Everything is one or two passes of aggregates that Spark combines map-side; per-column results
are turned into rows with ``unpivot``/``inline`` on the one-row aggregate. Quantiles are exact
(``scorelab.plans.ranks.exact_quantiles``), never a whole column in one buffer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelab.plans.ranks import exact_quantiles, small_side
from scorelab.session import cut_lineage

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def present(df: DataFrame, c: str):
    """The column with NaN as null: both are missing values."""
    x = F.col(f"`{c}`")
    return F.when(~F.isnan(x), x) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else x


def _dtype(f: T.StructField) -> str:
    return f.dataType.simpleString()


def table_shape(df: DataFrame) -> DataFrame:
    """metric, value: rows and columns."""
    n = df.agg(F.count(F.lit(1)).alias("rows"))
    return n.select(F.inline(F.array(
        F.struct(F.lit("rows").alias("metric"), F.col("rows").alias("value")),
        F.struct(F.lit("columns").alias("metric"), F.lit(len(df.columns)).cast("long").alias("value")),
    )))


def column_info(df: DataFrame) -> DataFrame:
    """column, non_null, nulls, pct_non_null, dtype from one aggregate pass; NaN counts as null."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(present(df, c)).alias(f"nn_{i}") for i, c in enumerate(cols)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"nn_{i}").alias("non_null"),
                 F.lit(_dtype(df.schema[c])).alias("dtype"))
        for i, c in enumerate(cols)
    ])
    t = one.select("_n", F.inline(rows))
    return t.select(
        "column", "non_null", (F.col("_n") - F.col("non_null")).alias("nulls"),
        F.when(F.col("_n") > 0, F.col("non_null") * 100.0 / F.col("_n")).alias("pct_non_null"), "dtype",
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """column, missing_count, percent_non_null (projection of ``column_info``)."""
    return column_info(df).select("column", F.col("nulls").alias("missing_count"),
                                  F.col("pct_non_null").alias("percent_non_null"))


def null_total(df: DataFrame) -> DataFrame:
    """Total missing (null or NaN) cells of the table."""
    return df.agg(sum((F.count(F.lit(1)) - F.count(present(df, c)) for c in df.columns), F.lit(0)).alias("null_cells"))


STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def _moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column -> count, mean, std (sample), min, max; one pass."""
    aggs = []
    for i, c in enumerate(cols):
        x = present(df, c).cast("double")
        aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").cast("double").alias("count"), F.col(f"m{i}").alias("mean"),
                 F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)
    ])))


def describe_long(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, count, mean, std, min, q25, q50, q75, max."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    m = _moments(df, cols)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    qw = q.groupBy("column").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
    qw = qw.select("column", *[F.col(f"`{p}`").alias(n) for p, n in zip(["0.25", "0.5", "0.75"], ["q25", "q50", "q75"])])
    return m.join(qw, "column", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, digits: int | None = 2) -> DataFrame:
    """stat, <one column per numeric feature>: count, mean, std, min, 25%, 50%, 75%, max.

    Rounded half-to-even to ``digits`` (None keeps full precision)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    lg = describe_long(df, cols)
    stat_cols = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    tall = lg.unpivot("column", stat_cols, "stat", "value")
    tall = tall.withColumn("stat", F.when(F.col("stat") == "q25", "25%").when(F.col("stat") == "q50", "50%")
                           .when(F.col("stat") == "q75", "75%").otherwise(F.col("stat")))
    val = F.bround("value", digits) if digits is not None else F.col("value")
    return tall.groupBy("stat").pivot("column", cols).agg(F.first(val))


def describe_all(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: count, unique, top, freq (text columns), numeric stats, dtype."""
    cols = list(cols) if cols is not None else df.columns
    num = [c for c in cols if isinstance(df.schema[c].dataType, NUMERIC)]
    txt = [c for c in cols if c not in num]
    parts = []
    if num:
        d = describe_long(df, num).select(
            "column", F.col("count").cast("long").alias("count"), F.lit(None).cast("long").alias("unique"),
            F.lit(None).cast("string").alias("top"), F.lit(None).cast("long").alias("freq"),
            "mean", "std", "min", "q25", "q50", "q75", "max")
        parts.append(d)
    if txt:
        vc = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in txt
        ])).alias("kv")).select("kv.column", "kv.v").where(F.col("v").isNotNull())
        cnt = vc.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        # top: most frequent, ties -> smallest value
        t = cnt.groupBy("column").agg(
            F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
            F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"),
            F.max("n").alias("freq"),
        )
        parts.append(t.select("column", "count", "unique", "top", "freq",
                              *[F.lit(None).cast("double").alias(c) for c in
                                ["mean", "std", "min", "q25", "q50", "q75", "max"]]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    dt = df.sparkSession.createDataFrame([(c, _dtype(df.schema[c])) for c in cols], "column string, dtype string")
    return out.join(F.broadcast(dt), "column")  # one row per column: bounded by the schema


def target_distribution(df: DataFrame, y: str = "y", digits: int = 2) -> DataFrame:
    """value, count, percentage (of all rows, nulls in the denominator only), half-even rounding."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    vc = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    j = _with_one_row(vc, n)
    return j.select("value", "count", F.bround(F.col("count") * 100.0 / F.col("_n"), digits).alias("percentage"))


def _with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row (broadcast of exactly one row)."""
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(one.withColumn("_k", F.lit(1))), "_k").drop("_k")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """value (null kept), count, percent of all rows."""
    vc = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    j = _with_one_row(vc, n)
    return j.select("value", "count", (F.col("count") * 100.0 / F.col("_n")).alias("percent"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long Pearson matrix (a, b, r) for every ordered pair, one aggregate pass."""
    cols = list(cols)
    aggs = []
    names = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r_{i}_{j}"))
            names.append((i, j))
    one = df.agg(*aggs)
    structs = []
    for i, j in names:
        structs.append(F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.col(f"r_{i}_{j}").alias("r")))
        if i != j:
            structs.append(F.struct(F.lit(cols[j]).alias("a"), F.lit(cols[i]).alias("b"), F.col(f"r_{i}_{j}").alias("r")))
    return one.select(F.inline(F.array(*structs)))


def target_correlation(df: DataFrame, y: str, cols: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """Correlation of each feature with the target, largest absolute first, top n."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[y, "row_id"])
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(y).cast("double")).alias(f"r{i}") for i, c in enumerate(cols)])
    t = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"))
                                       for i, c in enumerate(cols)])))
    return t.where(F.col("r").isNotNull()).orderBy(F.abs("r").desc(), "feature").limit(n)


def frequent_values(df: DataFrame, cols: Sequence[str], top: int = 5, buckets: int = 1 << 16, probe: int = 64) -> DataFrame:
    """column, value (as text), count, rank: the ``top`` most frequent non-null values of each column, ties
    to the smaller value; exact, for columns of any type and any number of distinct values.

    Values are not shuffled to find the few that matter: counts by hash bucket, which tasks add up first, are
    upper bounds for the values inside. The values of the ``probe`` largest buckets are counted exactly; the
    ``top``-th of those counts is a bound that a value of any other bucket must reach, so only the
    values of buckets at or above it are counted too (of a column whose values are all rare: all)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])).alias("_v"))
    long = long.select("_v.column", "_v.value").where("value is not null").withColumn("_b", F.pmod(F.xxhash64("value"), F.lit(buckets)))
    sizes = long.groupBy("column", "_b").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("column").orderBy(F.desc("_n"), "_b")  # at most ``buckets`` rows
    sizes = cut_lineage(sizes.withColumn("_place", F.row_number().over(order)))
    best = Window.partitionBy("column").orderBy(F.desc("count"), "value")

    def counted(some: DataFrame) -> DataFrame:
        values = long.join(small_side(some.select("column", "_b")), ["column", "_b"], "left_semi").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
        return cut_lineage(values.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))

    first = counted(sizes.where(F.col("_place") <= probe))
    bound = first.where(F.col("rank") == top).select("column", F.col("count").alias("_least"))
    others = sizes.where(F.col("_place") > probe).join(F.broadcast(bound), "column", "left")  # a row a column
    more = counted(others.where(F.col("_n") >= F.coalesce("_least", F.lit(0))))
    return first.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def profile(df: DataFrame, cols: Sequence[str] | None = None,
            probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Per numeric column: missing, distinct, zeros, mean, std, quantiles, skew, kurtosis (population).
    ``frequent_values`` has the top values, of text columns too."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = present(df, c).cast("double")
        aggs += [
            (F.count(F.lit(1)) - F.count(x)).alias(f"miss{i}"),
            F.count_distinct(x).alias(f"dist{i}"),
            F.sum(F.when(x == 0, 1).otherwise(0)).cast("long").alias(f"zero{i}"),
            F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
            F.skewness(x).alias(f"skew{i}"), F.kurtosis(x).alias(f"kurt{i}"),
        ]
    one = df.agg(*aggs)
    base = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"miss{i}").alias("missing"), F.col(f"dist{i}").alias("distinct"),
                 F.col(f"zero{i}").alias("zeros"), F.col(f"mean{i}").alias("mean"), F.col(f"std{i}").alias("std"),
                 F.col(f"skew{i}").alias("skew"), F.col(f"kurt{i}").alias("kurtosis"))
        for i, c in enumerate(cols)
    ])))
    q = exact_quantiles(df, cols, probs)
    names = [f"q{int(round(p * 100)):02d}" for p in probs]
    qw = q.groupBy("column").pivot("prob", list(probs)).agg(F.first("value"))
    qw = qw.select("column", *[F.col(f"`{p}`").alias(n) for p, n in zip(probs, names)])
    dt = df.sparkSession.createDataFrame([(c, _dtype(df.schema[c])) for c in cols], "column string, dtype string")
    return base.join(qw, "column", "left").join(F.broadcast(dt), "column")


def _min_max(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Per-column min / max: one aggregate, a fixed-size row brought to the driver."""
    row = df.agg(*[F.min(present(df, c).cast("double")).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(present(df, c).cast("double")).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def _bin(col: str, lo: float, hi: float, bins: int):
    x = F.col(f"`{col}`").cast("double")
    x = F.when(~F.isnan(x), x)
    if lo is None or hi is None or hi == lo:
        return F.when(x.isNotNull(), F.lit(0))
    # least() skips nulls in Spark, so keep null values out explicitly
    return F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)),
                                         F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """column, bin, lo, hi, n: equal-width bins over [min, max], empty ones with n = 0; the max falls in the
    last bin. A constant column has one bin, a column without values none."""
    cols = list(cols)
    mm = _min_max(df, cols)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _bin(c, *mm[c], bins).alias("bin")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.bin").where(F.col("bin").isNotNull())
    h = long.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.createDataFrame(
        [(c, float(mm[c][0]), float(mm[c][1]), i) for c in cols if mm[c][0] is not None for i in range(bins if mm[c][0] != mm[c][1] else 1)],
        "column string, _lo double, _hi double, bin int")
    w = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    return edges.join(h, ["column", "bin"], "left").select(
        "column", "bin", (F.col("_lo") + F.col("bin") * w).alias("lo"), (F.col("_lo") + (F.col("bin") + 1) * w).alias("hi"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def pair_bins(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """a, b, bin_a, bin_b, n: 2-D binned counts for every pair of the columns."""
    cols = list(cols)
    mm = _min_max(df, cols)
    binned = df.select(*[_bin(c, *mm[c], bins).alias(f"b{i}") for i, c in enumerate(cols)])
    pairs = [F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.col(f"b{i}").alias("bin_a"),
                      F.col(f"b{j}").alias("bin_b"))
             for i in range(len(cols)) for j in range(i + 1, len(cols))]
    long = binned.select(F.inline(F.array(*pairs))).where(F.col("bin_a").isNotNull() & F.col("bin_b").isNotNull())
    return long.groupBy("a", "b", "bin_a", "bin_b").agg(F.count(F.lit(1)).alias("n"))
