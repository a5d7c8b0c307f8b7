"""Preprocessing: learn small parameter tables on ``fit_on`` (train), apply as projections.

Every ``fit`` is one aggregate pass whose result has one row per column (or per level), so
bringing it to the driver to build literal column expressions is bounded by the schema, the way
Spark ML's own estimators work. Applying is then a single ``select`` that stays inside
whole-stage codegen. Exact medians come from ``exact_quantiles``; level codes from ``dense_codes``
(joined back, AQE picks broadcast when the level table is small).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.operators.profiling import NUMERIC
from scorelab.plans.ranks import SMALL, dense_codes, exact_quantiles
from scorelab.session import cut_lineage


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _num(c: str) -> Column:
    """The column as double, NaN as null: both are missing values."""
    x = _q(c).cast("double")
    return F.when(~F.isnan(x), x)


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace/insert columns keeping the column order."""
    cols = [new[c].alias(c) if c in new else _q(c) for c in df.columns]
    cols += [e.alias(c) for c, e in new.items() if c not in df.columns]
    return df.select(*cols)


# ---------------------------------------------------------------- rows with nulls

def drop_null_rows(df: DataFrame) -> DataFrame:
    """Rows without any null or NaN (``na.drop('any')``); ``null_total`` reports the cells."""
    return df.na.drop("any")


# ---------------------------------------------------------------- imputers

def fit_median(fit_on: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    q = exact_quantiles(fit_on, cols, [0.5]).collect()  # one row per column
    got = {r["column"]: r["value"] for r in q}
    return {c: got.get(c) for c in cols}


def impute_median(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Nulls -> exact median of the fit rows (linear interpolation between the middle values)."""
    med = fit_median(fit_on if fit_on is not None else df, cols)
    return _replace(df, {c: F.coalesce(_num(c), F.lit(med[c]).cast("double")) for c in cols})


def fit_mean(fit_on: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    row = fit_on.agg(*[F.avg(_num(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def impute_mean(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    mean = fit_mean(fit_on if fit_on is not None else df, cols)
    return _replace(df, {c: F.coalesce(_num(c), F.lit(mean[c]).cast("double")) for c in cols})


def fit_mode(fit_on: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column; ties -> smallest value."""
    out = {}
    for c in cols:
        r = (fit_on.where(_q(c).isNotNull()).groupBy(_q(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
             .agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode")).first())
        out[c] = r["mode"] if r else None
    return out


def impute_mode(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    mode = fit_mode(fit_on if fit_on is not None else df, cols)
    return _replace(df, {c: F.coalesce(_q(c), F.lit(mode[c]).cast(df.schema[c].dataType)) for c in cols})


def cast_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _replace(df, {c: _q(c).cast("string") for c in cols})


# ---------------------------------------------------------------- scalers

def fit_standard(fit_on: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = fit_on.agg(*[F.avg(_num(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(_num(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def _standard_expr(c: str, mean, std) -> Column:
    scale = std if (std is not None and std != 0) else 1.0
    return (_num(c) - F.lit(mean if mean is not None else 0.0)) / F.lit(scale)


def scale_standard(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std; a zero std divides by 1."""
    p = fit_standard(fit_on if fit_on is not None else df, cols)
    return _replace(df, {c: _standard_expr(c, *p[c]) for c in cols})


def fit_minmax(fit_on: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = fit_on.agg(*[F.min(_num(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                     *[F.max(_num(c)).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def _minmax_expr(c: str, lo, hi) -> Column:
    x = _num(c)
    if lo is None or hi is None or hi == lo:
        return F.when(x.isNotNull(), F.lit(0.0))  # constant column -> 0
    return (x - F.lit(float(lo))) / F.lit(float(hi) - float(lo))


def scale_minmax(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min); a constant column maps to 0."""
    p = fit_minmax(fit_on if fit_on is not None else df, cols)
    return _replace(df, {c: _minmax_expr(c, *p[c]) for c in cols})


# ---------------------------------------------------------------- encoders

def fit_levels(fit_on: DataFrame, cols: Sequence[str], max_levels: int = 10_000) -> dict[str, list[str]]:
    """Sorted distinct text levels per column (the width of a one-hot is the level count).

    A column with more than ``max_levels`` levels can't become that many columns: it raises an
    error that names it (use ``label_encode`` or ``factorize``), so nothing is cut silently."""
    out = {}
    for c in cols:
        rows = fit_on.where(_q(c).isNotNull()).select(_q(c).cast("string").alias("v")).distinct().limit(max_levels + 1).collect()
        if len(rows) > max_levels:
            raise ValueError(f"column '{c}' has more than {max_levels} levels: too many to one-hot")
        out[c] = sorted(r["v"] for r in rows)
    return out


def _one_hot_cols(c: str, levels: Sequence[str], sep: str = "=") -> dict[str, Column]:
    v = _q(c).cast("string")
    return {f"{c}{sep}{lv}": F.when(v == F.lit(lv), 1).otherwise(0) for lv in levels}


def one_hot(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Full one-hot (no dropped level); unseen or null -> all zeros. Columns named ``col=level``."""
    lv = fit_levels(fit_on if fit_on is not None else df, cols)
    keep = [_q(c) for c in df.columns if c not in cols]
    new = []
    for c in cols:
        new += [e.alias(n) for n, e in _one_hot_cols(c, lv[c]).items()]
    return df.select(*keep, *new)


def sparse_one_hot(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None, out: str = "features") -> tuple[DataFrame, DataFrame]:
    """(rows, names) for columns with any number of levels: the rows with one sparse vector ``out`` in place of
    ``cols``, and the table (index, column, level) of what its places mean, columns as given, levels in
    order of their text. Unseen or null: no entry. Levels are numbered by range and joined to the rows; they
    are neither collected nor made columns."""
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    spark, fit_on = df.sparkSession, fit_on if fit_on is not None else df
    rows, names, sizes, start = df, [], [], 0
    for i, c in enumerate(cols):
        levels = fit_on.select(_q(c).cast("string").alias("level"))
        codes = cut_lineage(dense_codes(levels, "level", code_col="code"))
        n = codes.count()
        names.append(codes.select((F.col("code") + start).cast("long").alias("index"), F.lit(c).alias("column"), "level"))
        sizes.append(n)
        start += n
        level = codes.select(F.col("level").alias(f"_level{i}"), F.col("code").alias(f"_code{i}"))
        level = F.broadcast(level) if n <= SMALL else level
        rows = rows.join(level, _q(c).cast("string") == F.col(f"_level{i}"), "left").withColumn(f"_code{i}", F.coalesce(f"_code{i}", F.lit(n)).cast("double")).drop(f"_level{i}")
    some = [i for i, n in enumerate(sizes) if n]  # a column without any level has no place
    largest = spark.createDataFrame([tuple(float(sizes[i] - 1) for i in some)], ", ".join(f"_code{i} double" for i in some)) if some else None
    empty = spark.createDataFrame([], "index long, column string, level string")
    if not some:
        return df.drop(*cols), empty
    # the place beyond a column's levels stands for unseen ones and is dropped
    encoder = OneHotEncoder(inputCols=[f"_code{i}" for i in some], outputCols=[f"_hot{i}" for i in some], handleInvalid="keep", dropLast=True).fit(largest)
    done = VectorAssembler(inputCols=[f"_hot{i}" for i in some], outputCol=out).transform(encoder.transform(rows))
    return done.select(*[_q(c) for c in df.columns if c not in cols], out), reduce(DataFrame.unionByName, names)


def dummies_with_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One-hot text columns with a ``col=null`` indicator; booleans -> 0/1; other columns numeric;
    remaining nulls -> 0."""
    cols = list(cols) if cols is not None else [f.name for f in df.schema.fields
                                                 if f.dataType.simpleString() == "string"]
    lv = fit_levels(df, cols)
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in cols:
            for n, e in _one_hot_cols(c, lv[c]).items():
                out.append(e.alias(n))
            out.append(F.when(_q(c).isNull(), 1).otherwise(0).alias(f"{c}=null"))
        elif f.dataType.simpleString() == "boolean":
            out.append(F.coalesce(_q(c).cast("int"), F.lit(0)).alias(c))
        elif isinstance(f.dataType, NUMERIC):
            out.append(F.coalesce(_q(c), F.lit(0).cast(f.dataType)).alias(c))
        else:
            out.append(F.coalesce(_q(c).try_cast("double"), F.lit(0.0)).alias(c))
    return df.select(*out)


def label_encode(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Text -> 0..k-1 in lexicographic order of the fit rows' levels; unseen -> null."""
    base = fit_on if fit_on is not None else df
    out = df
    for c in cols:
        codes = dense_codes(base.select(_q(c).cast("string").alias(c)), c, code_col=f"_code_{c}")
        out = out.withColumn(f"_k_{c}", _q(c).cast("string")).join(
            codes.withColumnRenamed(c, f"_k_{c}"), f"_k_{c}", "left")
        out = _replace(out.drop(f"_k_{c}"), {c: F.col(f"_code_{c}")}).drop(f"_code_{c}")
    return out


def factorize(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
              order_col: str = "row_id") -> DataFrame:
    """Text -> code by first appearance (smallest ``order_col``) in the fit rows.

    One dictionary learned on the fit rows and reused (so a single scored row keeps its code)."""
    base = fit_on if fit_on is not None else df
    out = df
    for c in cols:
        codes = dense_codes(base.select(_q(c).cast("string").alias(c), order_col), c, order_col=order_col,
                            code_col=f"_code_{c}")
        out = out.withColumn(f"_k_{c}", _q(c).cast("string")).join(
            codes.withColumnRenamed(c, f"_k_{c}"), f"_k_{c}", "left")
        out = _replace(out.drop(f"_k_{c}"), {c: F.col(f"_code_{c}")}).drop(f"_code_{c}")
    return out


# ---------------------------------------------------------------- the composed preprocessor

@dataclass
class FittedPreprocessor:
    """Learned parameters of ``fit_preprocessor``; ``transform`` is one projection."""

    numeric: list[str]
    categorical: list[str]
    keep: list[str]
    fill: dict[str, float | None] = field(default_factory=dict)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    mode: dict[str, object] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    numeric_mode: str = "median+standard"

    def feature_names(self) -> list[str]:
        names = list(self.numeric)
        for c in self.categorical:
            names += [f"{c}={lv}" for lv in self.levels[c]]
        return names

    def transform(self, df: DataFrame) -> DataFrame:
        cols = [_q(c) for c in self.keep if c in df.columns]
        for c in self.numeric:
            filled = F.coalesce(_num(c), F.lit(self.fill[c]).cast("double"))
            if self.numeric_mode == "median+standard":
                mean, std = self.scale[c]
                s = std if (std is not None and std != 0) else 1.0
                cols.append(((filled - F.lit(mean if mean is not None else 0.0)) / F.lit(s)).alias(c))
            else:
                lo, hi = self.scale[c]
                cols.append((F.when(filled.isNotNull(), F.lit(0.0)) if lo is None or hi == lo
                             else (filled - F.lit(lo)) / F.lit(hi - lo)).alias(c))
        for c in self.categorical:
            v = F.coalesce(_q(c).cast("string"), F.lit(None if self.mode[c] is None else str(self.mode[c])))
            for lv in self.levels[c]:
                cols.append(F.when(v == F.lit(lv), 1.0).otherwise(0.0).alias(f"{c}={lv}"))
        return df.select(*cols)

    def expanded_names(self, spark) -> DataFrame:
        return expanded_names(self, spark)


def split_types(df: DataFrame, exclude: Sequence[str]) -> tuple[list[str], list[str]]:
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]
    cat = [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC) and f.name not in exclude]
    return num, cat


def fit_preprocessor(train: DataFrame, target: str = "y", numeric: str = "median+standard",
                     keep: Sequence[str] = ("dataset", "row_id"), exclude: Sequence[str] = ()) -> FittedPreprocessor:
    """Numeric: median (or mean) impute then standard (or min-max) scale; text: mode impute, text,
    one-hot with unseen -> zeros. Everything learned on ``train`` only."""
    skip = set(keep) | {target} | set(exclude)
    num, cat = split_types(train, list(skip))
    train = train.persist()  # read by several fit passes; released when the fit is done
    try:
        return _fit_preprocessor(train, target, numeric, keep, num, cat)
    finally:
        train.unpersist()


def _fit_preprocessor(train: DataFrame, target: str, numeric: str, keep: Sequence[str], num: list[str],
                      cat: list[str]) -> FittedPreprocessor:
    if numeric == "median+standard":
        fill = fit_median(train, num) if num else {}
    else:
        fill = fit_mean(train, num) if num else {}
    filled = train.select(*[F.coalesce(_num(c), F.lit(fill[c]).cast("double")).alias(c) for c in num],
                          *[_q(c) for c in cat])
    if numeric == "median+standard":
        scale = fit_standard(filled, num) if num else {}
    else:
        scale = fit_minmax(filled, num) if num else {}
    mode = fit_mode(train, cat) if cat else {}
    imputed = filled.select(*[F.coalesce(_q(c).cast("string"), F.lit(None if mode[c] is None else str(mode[c])))
                              .alias(c) for c in cat])
    levels = fit_levels(imputed, cat) if cat else {}
    return FittedPreprocessor(num, cat, [*keep, target], fill, scale, mode, levels, numeric)


def expanded_names(pre: FittedPreprocessor, spark) -> DataFrame:
    """(expanded, raw, level): which raw column every model input came from."""
    rows = [(c, c, None) for c in pre.numeric]
    for c in pre.categorical:
        rows += [(f"{c}={lv}", c, lv) for lv in pre.levels[c]]
    return spark.createDataFrame(rows, "expanded string, raw string, level string")


def raw_feature(expanded: Column) -> Column:
    """Expanded name -> raw column: strip a ``transformer__`` prefix and a ``=level`` suffix."""
    no_prefix = F.element_at(F.split(expanded, "__"), -1)
    return F.regexp_extract(no_prefix, r"^([^=]*)", 1)
