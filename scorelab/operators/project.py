"""Validation, projection and row selection."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.operators.prep import raw_feature
from scorelab.operators.profiling import NUMERIC
from scorelab.plans.ranks import hash_key


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """column, present, available: a schema check, no job over the rows."""
    have = list(df.columns)
    rows = [(n, n in have, have) for n in names]
    return df.sparkSession.createDataFrame(rows, "column string, present boolean, available array<string>")


def split_by_type(df: DataFrame, target: str | None = None) -> DataFrame:
    """column, kind ('num' | 'cat') for every column but the target."""
    rows = [(f.name, "num" if isinstance(f.dataType, NUMERIC) else "cat") for f in df.schema.fields if f.name != target]
    return df.sparkSession.createDataFrame(rows, "column string, kind string")


_UNNAMED = re.compile(r"^Unnamed:")


def candidate_features(df: DataFrame, target: str) -> DataFrame:
    """position, column: every column but the target and ``Unnamed:*``, first occurrence kept."""
    seen: list[str] = []
    for c in df.columns:
        if c == target or _UNNAMED.match(c) or c in seen:
            continue
        seen.append(c)
    return df.sparkSession.createDataFrame(list(enumerate(seen)), "position int, column string")


def select_features(df: DataFrame, features: Sequence[str] | None, target: str) -> DataFrame:
    """Keep the chosen features (all when empty), target always appended last."""
    feats = [c for c in (features or [c for c in df.columns if c != target]) if c != target]
    return df.select(*[F.col(f"`{c}`") for c in feats], F.col(f"`{target}`"))


def top_raw_features(importance: DataFrame, n: int = 10, score_col: str = "importance",
                     name_col: str = "feature") -> DataFrame:
    """rank, raw, importance: expanded parts (``col=level``) summed back to the raw column, top n."""
    agg = importance.groupBy(raw_feature(F.col(name_col)).alias("raw")).agg(F.sum(score_col).alias("importance"))
    top = agg.orderBy(F.col("importance").desc(), "raw").limit(n)  # top-n is the feature
    return top.select(F.row_number().over(_w_rank()).alias("rank"), "raw", "importance")


def _w_rank():
    from pyspark.sql import Window

    return Window.orderBy(F.col("importance").desc(), "raw")  # over at most n rows


def select_top_features(df: DataFrame, importance: DataFrame, n: int = 10, target: str = "y",
                        score_col: str = "importance", name_col: str = "feature") -> DataFrame:
    """Keep the top n raw features of an importance ranking plus the target."""
    names = [r["raw"] for r in top_raw_features(importance, n, score_col, name_col).collect()]  # n names
    return select_features(df, [c for c in names if c in df.columns], target)


def sparse_column_report(df: DataFrame, target: str | None = None, max_missing: float = 0.90) -> DataFrame:
    """column, missing_ratio, kept: one aggregate pass."""
    cols = [c for c in df.columns if c != target]
    one = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])
    t = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_ratio"))
                                       for i, c in enumerate(cols)])))
    return t.withColumn("kept", F.col("missing_ratio") <= F.lit(float(max_missing)))


def drop_sparse_columns(df: DataFrame, target: str | None = None, max_missing: float = 0.90) -> DataFrame:
    """Drop columns whose missing share is above ``max_missing`` (the target always stays)."""
    rep = sparse_column_report(df, target, max_missing).where(~F.col("kept")).collect()  # one row per column
    drop = {r["column"] for r in rep}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in drop])


def coerce_numeric(df: DataFrame, cols: Sequence[str], min_parsed: float = 0.10) -> DataFrame:
    """Per column: numbers if at least max(1, int(min_parsed * n)) values parse, else category
    codes (sorted levels, null -> -1); then remaining nulls -> median of the column (0 if none)."""
    from scorelab.operators.prep import fit_median
    from scorelab.plans.ranks import dense_codes

    cols = list(cols)
    stats = df.agg(F.count(F.lit(1)).alias("_n"),
                   *[F.count(F.col(f"`{c}`").cast("string").try_cast("double")).alias(f"p{i}")
                     for i, c in enumerate(cols)]).first()
    n = stats["_n"]
    parsed = {c: stats[f"p{i}"] >= max(1, int(min_parsed * n)) for i, c in enumerate(cols)}
    out = df
    for c in cols:
        if parsed[c]:
            out = out.withColumn(c, F.col(f"`{c}`").cast("string").try_cast("double"))
        else:
            codes = dense_codes(df.select(F.col(f"`{c}`").cast("string").alias(c)), c, code_col="_code")
            out = (out.withColumn("_k", F.col(f"`{c}`").cast("string"))
                   .join(codes.withColumnRenamed(c, "_k"), "_k", "left")
                   .withColumn(c, F.coalesce(F.col("_code"), F.lit(-1)).cast("double")).drop("_k", "_code"))
    med = fit_median(out, [c for c in cols if parsed[c]]) if any(parsed.values()) else {}
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(med.get(c) if med.get(c) is not None else 0.0)).alias(c)
                        if c in cols else F.col(f"`{c}`") for c in df.columns])


def row_lookup(df: DataFrame, row_id, key: str = "row_id") -> DataFrame:
    """The row with this id (0 or 1 rows); a filter the scan can push down."""
    return df.where(F.col(key) == F.lit(row_id))


def pick_instances(df: DataFrame, ids: Sequence | None = None, n_random: int = 5, seed: int = 42,
                   key: str = "row_id") -> DataFrame:
    """Rows for the given ids (invalid ids ignored), else n rows in seeded hash order."""
    if ids:
        return df.where(F.col(key).isin(list(ids)))
    return df.orderBy(hash_key(seed, key), key).limit(n_random)  # a sampling operator: the limit is the feature
