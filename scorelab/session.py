"""Session helpers.

The library never creates its own cluster settings beyond what a test needs: it reads
``spark.checkpoint.dir`` from the running session and only sets one when it is unset
(local tests), so on a cluster the shared folder named there is always used.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench: AQE on, UI off, UTC, Arrow on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scorelab")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SCORELAB_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context: they need not have it on their
    path. Spark's own file server carries it."""
    sc = spark.sparkContext
    if getattr(sc, "_scorelab_shipped", False):
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="scorelab-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(name)
    atexit.register(Path(name).unlink, missing_ok=True)
    # rows may be whole documents: smaller Arrow batches bound what a Python worker holds (settings
    # of the caller's own are left as they are)
    for key, default, ours in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "4m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", ours)
    sc._scorelab_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder in use: the context's, else ``spark.checkpoint.dir``; a scratch
    folder is made only in a single-process local session with neither set (tests); on a cluster
    that is an error. Never re-set once set, because
    every ``setCheckpointDir`` call adds a new sub-folder."""
    ship_package(spark)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="scorelab-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def written_once(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again: for a table that several
    passes read, each only the columns it needs."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/once/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
