"""Incremental counters with Structured Streaming.

The reference folds running totals over 100k-row chunks of a large CSV. Here the file source is
read as a stream (``maxFilesPerTrigger`` bounds each micro-batch), the running totals are
streaming aggregates kept in the state store, and ``availableNow`` processes what is there and
stops. The checkpoint of every stream lives in the session's shared checkpoint folder, so a
restarted query resumes where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, path: str, like: DataFrame | None = None, fmt: str = "parquet",
                max_files: int = 1) -> DataFrame:
    """Streaming read of a file source with the schema of ``like`` (or of the files)."""
    schema = like.schema if like is not None else spark.read.format(fmt).load(path).schema
    r = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    p = path.rstrip("/")
    if p.endswith(f".{fmt}"):  # the file source watches folders / globs: a one-file glob
        p = f"{p[:-1]}[{p[-1]}]"
    return r.load(p)


def running_value_counts(stream: DataFrame, col: str) -> DataFrame:
    """Streaming plan: running count per value of ``col`` (null kept)."""
    return stream.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def running_column_info(stream: DataFrame) -> DataFrame:
    """Streaming plan: running row count and non-null count of every column (one state row)."""
    cols = stream.columns
    return stream.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(f"`{c}`")).alias(f"nn_{i}")
                                                          for i, c in enumerate(cols)])


def run_to_table(agg: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a streaming aggregate over everything available (``availableNow``) and return its complete
    result.

    ``folder`` (on a cluster: a shared one) holds the state, so a later call with the same folder goes on where
    this one stopped; without one a fresh folder is taken. Every batch writes a table of its own, and its
    number among the finished ones only once that is written: what is read is the last finished table,
    which no later or failed batch touches. The result is never held by the driver.
    """
    spark = agg.sparkSession
    folder = (folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex[:12]}").rstrip("/")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("append").parquet(f"{folder}/finished")

    q = (agg.writeStream.outputMode("complete").foreachBatch(keep)
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    last = spark.read.schema("number long").parquet(f"{folder}/finished").agg(F.max("number")).first()[0]
    return spark.read.schema(agg.schema).parquet(f"{folder}/batch-{last}")


def stream_value_counts(stream: DataFrame, col: str, folder: str | None = None) -> DataFrame:
    """value, count after consuming the stream."""
    return run_to_table(running_value_counts(stream, col), folder)


def stream_column_info(stream: DataFrame, cols: Sequence[str] | None = None, folder: str | None = None) -> DataFrame:
    """column, non_null, nulls after consuming the stream."""
    cols = list(cols) if cols is not None else stream.columns
    t = run_to_table(running_column_info(stream.select(*cols)), folder)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"nn_{i}").alias("non_null")) for i, c in enumerate(cols)])
    return t.select("n_rows", F.inline(rows)).select("column", "non_null", (F.col("n_rows") - F.col("non_null")).alias("nulls"))
