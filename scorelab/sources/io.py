"""Sources, sinks and result tables.

Readers return DataFrames with an explicit ``row_id``; writers are partitioned Parquet / JSON
tables under a root folder (on a cluster: a shared folder). Artifact listings read only file
metadata through the ``binaryFile`` source (path, length, modificationTime), never contents.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelab.plans.ranks import hash_key, small_side
from scorelab.session import cut_lineage


# ---------------------------------------------------------------- names

def sanitize_name(col: Column | str) -> Column:
    """Drop '.csv' anywhere, every char other than letters, digits, '_' and '-' -> '_', squeeze
    runs of '_', strip '_' at both ends."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.replace(c, F.lit(".csv"), F.lit(""))
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_\-]", "_")
    c = F.regexp_replace(c, r"_+", "_")
    return F.regexp_replace(c, r"^_+|_+$", "")


def file_stem(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).stem


# ---------------------------------------------------------------- readers

def with_row_id(df: DataFrame, key: str | Sequence[str] | None = None, seed: int = 0,
                chunk: int = 100_000, wide: bool = False) -> DataFrame:
    """Add ``row_id``: the natural key when given (a single column used as is), else a hash of
    the whole row plus a tie counter among identical rows (never a positional id).

    Only hashes are shuffled: rows are counted by a 128-bit hash, and rows whose hash occurs once, as most do,
    are number 1 where they are. The others are grouped by all columns and counted (tasks add up
    first), each count is cut into chunks of ``chunk`` copies that are spread over the cluster, and the
    copies are numbered inside their chunk, so even one row repeated a billion times never meets in a
    single task.

    A 64-bit id is expected to collide beyond some 10^9 rows; ``wide`` gives a text id of two
    hashes and the copy's number instead (128 bits, for tables of any size)."""
    if isinstance(key, str):
        return df.withColumn("row_id", F.col(key).cast("long"))
    cols = list(key) if key else df.columns
    allc = [F.col(f"`{c}`") for c in df.columns]
    hashes = [row_hash(df.columns, seed + 3).alias("_r"), row_hash(df.columns, seed + 4).alias("_r2")]
    own = [row_hash(cols, seed).alias("_h"), row_hash(cols, seed + 1).alias("_h2")]
    rows = df.select(*allc, *hashes)
    again = small_side(rows.groupBy("_r", "_r2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_r", "_r2"))
    once = rows.join(again, ["_r", "_r2"], "left_anti").select(*allc, *own, F.lit(1).cast("long").alias("_tie"))
    counted = rows.join(again, ["_r", "_r2"], "left_semi").groupBy(*allc).agg(F.count(F.lit(1)).alias("_copies")).select(*allc, "_copies", *own)
    chunks = counted.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / chunk)))
                            .alias("_chunk"))
    chunks = chunks.repartition("_h", "_chunk")
    ties = chunks.select("*", F.explode(F.sequence(F.col("_chunk") * chunk + 1,
                                                   F.least((F.col("_chunk") + 1) * chunk, F.col("_copies"))))
                         .alias("_tie")).select(*allc, "_h", "_h2", "_tie")
    ties = once.unionByName(ties)
    if wide:
        text = F.concat_ws("-", F.lower(F.lpad(F.hex("_h"), 16, "0")), F.lower(F.lpad(F.hex("_h2"), 16, "0")), F.col("_tie"))
        return ties.select(*allc, text.alias("row_id"))
    return ties.select(*allc, hash_key(seed + 2, F.col("_h"), F.col("_h2"), F.col("_tie")).alias("row_id"))


def row_hash(cols: Sequence[str], seed: int) -> Column:
    """64-bit hash of a row that tells nulls apart: Spark's hash leaves a null out, so each column
    goes in with a flag."""
    return hash_key(seed, *[x for c in cols for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def read_dataset(spark: SparkSession, path: str, name: str | None = None, target: str | None = "target",
                 schema: T.StructType | str | None = None, fmt: str = "csv", key: str | Sequence[str] | None = None,
                 target_as: str = "y") -> DataFrame:
    """Read one dataset (CSV with header by default), tag it with its name (config name or file
    stem), rename the target to ``y`` (int) and add ``row_id``. Explicit schema first; CSV type
    inference only as the fallback."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    elif schema is not None:
        r = r.schema(schema)
    df = r.load(path)
    if target and target not in df.columns:
        raise ValueError(f"target column '{target}' not found; available: {df.columns}")
    if target and target != target_as:
        df = df.withColumnRenamed(target, target_as).withColumn(target_as, F.col(target_as).cast("int"))
    df = with_row_id(df, key)
    return df.select(F.lit(name or file_stem(path)).alias("dataset"), "*")


def read_many(spark: SparkSession, specs: Sequence[dict]) -> tuple[DataFrame | None, DataFrame]:
    """Read several datasets; a failing one becomes a row of ``errors(dataset, error)`` and the
    rest are unioned by name (missing columns become null)."""
    out, errs = None, []
    for s in specs:
        name = s.get("name") or file_stem(s["path"])
        try:
            df = read_dataset(spark, s["path"], name, s.get("target", "target"), s.get("schema"), s.get("fmt", "csv"),
                              s.get("key"))
            df.schema  # resolve now so a bad path fails here  # noqa: B018
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        except Exception as e:  # noqa: BLE001 - the error is the result
            errs.append((name, f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"))
    errors = spark.createDataFrame(errs, "dataset string, error string")
    return out, errors


def head_sample(df: DataFrame, n: int = 5, cols: Sequence[str] | None = None, key: str = "row_id") -> DataFrame:
    """First n rows by key (a distributed top-n, TakeOrderedAndProject)."""
    d = df.select(*cols) if cols else df
    if key not in d.columns:
        d = d.withColumn(key, F.col(key))
    return d.orderBy(key).limit(n)


# ---------------------------------------------------------------- split files

def save_split(df: DataFrame, root: str, name: str, seed: int, y: str = "y") -> DataFrame:
    """Write the split table partitioned by ``split`` and return its metadata rows
    (dataset, split, n_rows, n_cols, class, n) computed from what was written."""
    path = f"{root.rstrip('/')}/splits/dataset={name}"
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    back = df.sparkSession.read.parquet(path)
    n_cols = len([c for c in df.columns if c != "split"])
    per = back.groupBy("split", F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    tot = back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    return per.join(tot, "split").select(F.lit(name).alias("dataset"), "split", "n_rows",
                                         F.lit(n_cols).alias("n_cols"), "class", "n", F.lit(seed).alias("seed"))


# ---------------------------------------------------------------- result tables

def result_table_io(df: DataFrame | None, root: str, kind: str, dataset: str,
                    spark: SparkSession | None = None) -> DataFrame | None:
    """Save (df given) or load (df None) the result table ``kind`` of ``dataset``.

    Saving an empty table is an error; loading a missing one returns None."""
    base = f"{root.rstrip('/')}/results"
    if df is not None:
        if df.isEmpty():
            raise ValueError(f"refusing to save an empty {kind} table for {dataset}")
        df.write.mode("overwrite").parquet(f"{base}/kind={kind}/dataset_key={dataset}")
        return df
    spark = spark or SparkSession.getActiveSession()
    # the folder of this kind and dataset alone: other kinds have other columns
    return _read_if_there(lambda: spark.read.parquet(f"{base}/kind={kind}/dataset_key={dataset}"))


def _read_if_there(read) -> DataFrame | None:
    """The table, or None if its path does not exist; every other error is the caller's."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


RECORD_SCHEMA = "dataset string, kind string, record_id long, ts timestamp, payload string"


def record_store(records: DataFrame, root: str, kind: str) -> DataFrame:
    """Append JSON records; each new record gets the next number within its dataset
    (max stored id + row_number of the new ones)."""
    spark = records.sparkSession
    path = f"{root.rstrip('/')}/records/kind={kind}"
    old = _read_if_there(lambda: spark.read.schema(RECORD_SCHEMA.replace("kind string, ", "")).json(path))
    old = old if old is not None else spark.createDataFrame([], RECORD_SCHEMA.replace("kind string, ", ""))
    last = cut_lineage(old.groupBy("dataset").agg(F.max("record_id").alias("_last")))  # read before the append
    payload_cols = [c for c in records.columns if c not in ("dataset", "ts")]
    new = records.select("dataset", F.coalesce(F.col("ts") if "ts" in records.columns else F.lit(None).cast("timestamp"),
                                               F.current_timestamp()).alias("ts"),
                         F.to_json(F.struct(*payload_cols)).alias("payload"))
    w = Window.partitionBy("dataset").orderBy("ts", "payload")
    out = new.join(last, "dataset", "left").withColumn(
        "record_id", F.coalesce("_last", F.lit(0)) + F.row_number().over(w)).drop("_last")
    out = cut_lineage(out.select("dataset", "record_id", "ts", "payload"))  # what is returned is what is stored
    out.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)  # to the microsecond
    return out


def recent_records(spark: SparkSession, root: str, kind: str, dataset: str | None = None, limit: int = 50) -> DataFrame:
    """Stored records, optionally for one dataset, newest first, at most ``limit``."""
    path = f"{root.rstrip('/')}/records/kind={kind}"
    t = spark.read.schema(RECORD_SCHEMA.replace("kind string, ", "")).json(path)
    if dataset is not None:
        t = t.where(F.col("dataset") == dataset)
    return t.orderBy(F.col("ts").desc(), F.col("record_id").desc()).limit(limit)


# ---------------------------------------------------------------- artifact listings

def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime of every file under root (contents never read)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select("path", "length", "modificationTime"))


# Artifact kinds by file-name pattern, tried in this order.
ARTIFACT_PATTERNS = [
    ("benchmark", r"benchmark"), ("all_models", r"all_model"), ("rank", r"rank"), ("batch", r"batch"),
    ("importance", r"importance"), ("eda", r"/eda/|column_info|missing|describe|target_distribution"),
    ("local_analysis", r"local_anal|_row[0-9]+_"), ("comparison", r"comparison"), ("figure", r"\.(png|svg|pdf)$"),
]


def artifact_kind(path: Column) -> Column:
    e = None
    for kind, pat in ARTIFACT_PATTERNS:
        cond = path.rlike(pat)
        e = F.when(cond, F.lit(kind)) if e is None else e.when(cond, F.lit(kind))
    return e.otherwise(F.lit("other"))


def artifact_manifest(spark: SparkSession, root: str) -> DataFrame:
    """dataset x kind -> number of files and newest path, from the ``dataset=`` path segment."""
    f = list_files(spark, root)
    f = f.withColumn("kind", artifact_kind(F.col("path"))).withColumn(
        "dataset", F.coalesce(F.nullif(F.regexp_extract("path", r"dataset(?:_key)?=([^/]+)", 1), F.lit("")), F.lit("_")))
    return f.groupBy("dataset", "kind").agg(F.count(F.lit(1)).alias("n_files"),
                                            F.max_by("path", "modificationTime").alias("latest"))


def storage_summary(spark: SparkSession, root: str) -> DataFrame:
    """category, n_files, size_mb (2 dp) per artifact kind plus a 'total' row (rollup)."""
    f = list_files(spark, root).withColumn("category", artifact_kind(F.col("path")))
    r = f.rollup("category").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("_bytes"))
    return r.select(F.coalesce("category", F.lit("total")).alias("category"), "n_files",
                    F.round(F.col("_bytes") / (1024.0 * 1024.0), 2).alias("size_mb"))


def expired_artifacts(spark: SparkSession, root: str, max_age_days: int = 30, now: _dt.datetime | None = None) -> DataFrame:
    """Files older than ``max_age_days`` (selection only; deleting is the caller's business)."""
    now = now or _dt.datetime.now()
    cutoff = now - _dt.timedelta(days=max_age_days)
    f = list_files(spark, root).where(F.col("modificationTime") < F.lit(cutoff))
    return f.select(artifact_kind(F.col("path")).alias("category"), "path", F.col("modificationTime").alias("modified"))


# ---------------------------------------------------------------- summaries of results

def report_manifest(wide: DataFrame, names: Sequence[str] = ("AUC", "PCC", "F1", "Recall", "BS", "KS", "PG", "H")) -> DataFrame:
    """dataset -> n_models and the sorted list of completed models (group, model, metrics)."""
    present = [m for m in names if m in wide.columns]
    ok = wide.where(F.col("error").isNull()) if "error" in wide.columns else wide
    return ok.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_models"),
        F.array_sort(F.collect_list(F.struct("model_group", "model", *present))).alias("models"))


def dataset_fingerprint(df: DataFrame, stored: DataFrame | None = None, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Order-free content signature: n_rows and two sums of differently seeded, null-safe row
    hashes, so that equal rows add up instead of cancelling; ``stale`` when a stored one differs."""
    cols = [c for c in df.columns if c not in by]
    total = lambda seed: F.sum(row_hash(cols, seed).cast("decimal(20,0)"))
    sig = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("/", total(0), total(1)).alias("sig"))
    if stored is None:
        return sig.withColumn("stale", F.lit(None).cast("boolean"))
    s = stored.select(*by, F.col("n_rows").alias("_n0"), F.col("sig").alias("_s0"))
    j = sig.join(s, list(by), "left")
    return j.select(*by, "n_rows", "sig", ((F.col("_n0") != F.col("n_rows")) | (F.col("_s0") != F.col("sig"))
                                           | F.col("_s0").isNull()).alias("stale"))
