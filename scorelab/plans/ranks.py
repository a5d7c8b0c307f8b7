"""Global orders without one partition.

Many credit metrics need running totals along the score (AUC, KS, ROC, H, midranks). A plain
``Window.partitionBy(group).orderBy(score)`` pushes every row of a group through one task, and
one group may hold a third of all rows. ``running_totals`` instead:

1. writes its (already collapsed) input and deals it by range of (group, order value), so equal values meet in one
   range, ranges are as many as the shuffle is wide, and any sortable type works,
2. writes it once with the range's number as its bucket (a retried stage sees the same ranges),
3. sums each bucket (partial aggregation) and turns those sums into per-bucket offsets with a
   window over the small ``(group, bucket)`` table,
4. runs the ordered window inside ``(group, bucket)`` only and adds the offset.

The only data that meets on one task is one range.

``hash_rank`` gives an exact, seeded, partition-independent rank of rows within a stratum
with the same bucket idea: the bucket is the top bits of a 64-bit hash, so no sampling is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelab.session import cut_lineage


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names]


def default_buckets(df: DataFrame) -> int:
    """Hash buckets of a stratum: twice the shuffle width."""
    return max(16, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order_col: str,
    sum_cols: Sequence[str],
    buckets: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` along ``order_col`` within ``group``.

    ``df`` should have one row per (group, order value) (collapse first; ties then share a row).
    Adds ``_bucket`` (the range), ``cum_<c>`` (inclusive) and ``tot_<c>`` (group total) for every c
    in ``sum_cols``. ``buckets`` fixes the number of ranges; by default it is the shuffle width,
    and adaptive execution joins small ranges.
    """
    group = list(group)
    if not group:
        out = running_totals(df.withColumn("_g", F.lit(0)), ["_g"], order_col, sum_cols, buckets, descending)
        return out.drop("_g")
    key = F.col(order_col).desc() if descending else F.col(order_col).asc()
    along = [*_cols(group), F.col(order_col)]
    df = cut_lineage(df)  # read twice below: once to find the ranges, once to deal the rows
    dealt = df.repartitionByRange(buckets, *along) if buckets else df.repartitionByRange(*along)
    tagged = cut_lineage(dealt.withColumn("_bucket", F.spark_partition_id()))
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()

    per_bucket = tagged.groupBy(*group, "_bucket").agg(*[F.sum(c).alias(f"_b_{c}") for c in sum_cols])
    wb = Window.partitionBy(*_cols(group)).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*_cols(group))
    offsets = per_bucket.select(
        *group,
        "_bucket",
        *[F.coalesce(F.sum(f"_b_{c}").over(wb), F.lit(0)).alias(f"_off_{c}") for c in sum_cols],
        *[F.sum(f"_b_{c}").over(wt).alias(f"tot_{c}") for c in sum_cols],
    )
    w = Window.partitionBy(*_cols(group), F.col("_bucket")).orderBy(key).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = tagged.join(offsets, [*group, "_bucket"], "inner")
    return out.select(
        *[c for c in tagged.columns],
        *[(F.col(f"_off_{c}") + F.sum(c).over(w)).alias(f"cum_{c}") for c in sum_cols],
        *[F.col(f"tot_{c}") for c in sum_cols],
    )


def hash_key(seed: int, *cols: str | Column) -> Column:
    """Seeded 64-bit hash used for every random order in the library."""
    return F.xxhash64(F.lit(int(seed)), *[F.col(c) if isinstance(c, str) else c for c in cols])


def hash_rank(
    df: DataFrame,
    strata: Sequence[str],
    seed: int,
    id_col: str = "row_id",
    buckets: int | None = None,
    rank_col: str = "_rank",
) -> DataFrame:
    """Exact 0-based rank of rows inside each stratum by (hash(seed, id), id).

    The bucket is the top bits of the hash, so sorting never needs one task per stratum:
    the window runs inside (stratum, bucket) and per-bucket counts give the offsets.
    Adds ``rank_col`` and ``_n`` (stratum size).
    """
    strata = list(strata)
    if not strata:
        out = hash_rank(df.withColumn("_g", F.lit(0)), ["_g"], seed, id_col, buckets, rank_col)
        return out.drop("_g")
    h = hash_key(seed, id_col)
    buckets = buckets or default_buckets(df)
    bits = max(1, (buckets - 1).bit_length())
    t = df.withColumn("_h", h).withColumn("_hb", F.shiftrightunsigned(F.col("_h"), 64 - bits).cast("int"))
    # signed order of the hash must match the bucket order: flip the sign bit.
    t = t.withColumn("_hs", F.col("_h").bitwiseXOR(F.lit(-(2**63)).cast("long")))
    per = t.groupBy(*strata, "_hb").agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(*_cols(strata)).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select(
        *strata,
        "_hb",
        F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_off"),
        F.sum("_bn").over(Window.partitionBy(*_cols(strata))).alias("_n"),
    )
    w = Window.partitionBy(*_cols(strata), F.col("_hb")).orderBy("_hs", id_col)
    out = t.join(offs, [*strata, "_hb"], "inner")
    return out.withColumn(rank_col, F.col("_off") + F.row_number().over(w) - 1).drop(
        "_h", "_hb", "_hs", "_off"
    )


def midrank(df: DataFrame, group: Sequence[str], value_col: str, out_col: str = "midrank",
            buckets: int | None = None) -> DataFrame:
    """Average rank (1-based, ties share the mean rank) of ``value_col`` within ``group``.

    Works on the collapsed (group, value) -> count table, then joins back on the value.
    """
    group = list(group)
    hist = df.groupBy(*group, value_col).agg(F.count(F.lit(1)).alias("_cnt"))
    rt = running_totals(hist, group, value_col, ["_cnt"], buckets)
    ranks = rt.select(*group, value_col,
                      (F.col("cum__cnt") - F.col("_cnt") + (F.col("_cnt") + 1) / 2.0).alias(out_col))
    return df.join(ranks, [*group, value_col], "left")


#: Rank error of the sketch that brackets a quantile, as a share of the rows: 1 / SKETCH.
SKETCH = 10_000

#: Rows of a small table that may be broadcast.
SMALL = 100_000


def small_side(df: DataFrame) -> DataFrame:
    """``df``, written, as the side of a join that is broadcast if it has at most ``SMALL`` rows. Left to
    itself the plan would deal all rows of the other side before it knows."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    group: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (DuckDB ``quantile_cont``, numpy 'linear').

    Returns ``(group..., column, prob, value)``. Two passes over the rows, neither of which shuffles
    them: a sketch brackets each quantile between two values, then the rows below the bracket are counted
    and those inside it, about 4 in ``SKETCH``, are collapsed to counts. The order statistics around
    h = (n - 1) q lie inside, or are the value next to the bracket. Nulls and NaN are ignored.
    """
    group = list(group)
    long = df.select(*group, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("_kv")).select(*group, "_kv.column", "_kv.value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    keys = [*group, "column"]
    margin = 2.0 / SKETCH
    edges = [F.lit(float(e)) for q in probs for e in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = long.groupBy(*keys).agg(F.percentile_approx("value", F.array(*edges), SKETCH).alias("_e"), F.count(F.lit(1)).alias("_n"))
    bracket = [F.struct(F.lit(float(q)).alias("prob"), F.col("_e")[2 * i].alias("lo"), F.col("_e")[2 * i + 1].alias("hi")) for i, q in enumerate(probs)]
    brackets = small_side(sketch.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n", F.array(*bracket).alias("_q")))
    same = reduce(lambda a, b: a & b, [long[k].eqNullSafe(brackets[f"_k_{k}"]) for k in keys])
    each = long.join(brackets, same).select(*keys, "value", "_n", F.explode("_q").alias("_q"))
    side = F.when(F.col("value") < F.col("_q.lo"), -1).when(F.col("value") > F.col("_q.hi"), 1).otherwise(0)
    at = each.select(*keys, "_n", F.col("_q.prob").alias("prob"), "value", side.alias("_side"))
    hist = at.groupBy(*keys, "_n", "prob", "_side", F.when(F.col("_side") == 0, F.col("value")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("value").alias("_min"), F.max("value").alias("_max"))
    w = Window.partitionBy(*_cols(keys), F.col("prob")).orderBy("_side", "_v")  # the bracket and two rows
    run = hist.withColumn("_end", F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - F.col("_cnt"))
    h = (F.col("_n") - 1) * F.col("prob")
    lo = F.floor(h)
    # a rank below or above the bracket is the one next to it
    one = lambda r: F.max(F.when((F.col("_start") <= r) & (r < F.col("_end")), F.when(F.col("_side") > 0, F.col("_min")).otherwise(F.col("_max"))))
    out = run.groupBy(*keys, "prob").agg(one(lo).alias("_vlo"), one(F.least(lo + 1, F.col("_n") - 1)).alias("_vhi"), F.first(h - lo).alias("_frac"))
    return out.select(*keys, "prob", (F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias("value"))


def dense_codes(df: DataFrame, col: str, order_col: str | None = None, group: Sequence[str] = (),
                code_col: str = "code") -> DataFrame:
    """Code 0..k-1 for the distinct values of ``col`` (per ``group``), in the order of ``order_col``.

    ``order_col`` defaults to the value itself (lexicographic for text). Built on the distinct
    values only, with running counts by range.
    Returns ``(group..., col, code)``.
    """
    group = list(group)
    order_col = order_col or col
    vals = df.where(F.col(col).isNotNull())
    if order_col == col:
        levels = vals.select(*group, col).distinct()
    else:
        levels = vals.groupBy(*group, col).agg(F.min(order_col).alias(order_col))
    levels = levels.withColumn("_one", F.lit(1))
    rt = running_totals(levels, group, order_col, ["_one"])
    return rt.select(*group, col, (F.col("cum__one") - 1).cast("int").alias(code_col))
