"""Catalog of registered queries: one Spark plan per operator key, plus the DuckDB oracle text.

Every registered query reads the given tables (through ``scorelab.sources.bindings``) and runs
over them whole. Double columns are rounded to 6 decimals on both sides so the value hash does not
depend on the summation order of either engine.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelab.sources.bindings import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DOCS: dict[str, str] = {}

CHECK_MODULES = (
    "scorelab.plans.q_metrics",
    "scorelab.plans.q_bench",
    "scorelab.plans.q_profile",
    "scorelab.plans.q_prep",
    "scorelab.plans.q_paired",
    "scorelab.plans.q_resample",
    "scorelab.plans.q_explain",
    "scorelab.plans.q_io",
    "scorelab.plans.q_learn",
)

DIGITS = 6


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def round_sql(sql: str, rnd: Sequence[str], digits: int = DIGITS) -> str:
    if not rnd:
        return sql
    rep = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in rnd)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"


def query(key: str, sql: str | None = None, views: Sequence[str] = (), rnd: Sequence[str] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` with its oracle SQL."""

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))

        run.__doc__ = fn.__doc__
        run.__name__ = fn.__name__
        QUERIES[key] = run
        DOCS[key] = (fn.__doc__ or "").strip()
        if sql is not None:
            ORACLE[key] = round_sql(with_views(sql, *views), rnd)
        return fn

    return deco


def load_all() -> None:
    for m in CHECK_MODULES:
        importlib.import_module(m)
