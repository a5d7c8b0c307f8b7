"""Helpers shared by the corpus operators: shared tables, Arrow tasks, components."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.session import ensure_checkpoint_dir, ship_package


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name inside the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: cuts the lineage, and a
    lost executor only costs the tasks that were reading."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_view(docs: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """Only the columns a job needs, under the names it uses: clashing extra columns stay out.
    A null text is the empty text."""
    cols = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")]
    return docs.select(*cols, *[F.col(f"`{c}`").cast("string").alias(k) for k, c in more.items()])


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str, keep=None) -> DataFrame:
    """``fn`` over the Arrow batches of each partition. ``keep``: the key of the large object (see
    ``held``) that the job uses; what other jobs left in the worker is let go first."""
    ship_package(df.sparkSession)

    def job(batches: Iterator[pa.RecordBatch]):
        release(keep)
        yield from fn(batches)

    return df.mapInArrow(job, schema)


def map_texts(docs: DataFrame, text_col: str, fn: Callable[[list], tuple[list, list | None]], keep=None, chars: int = 1_000_000) -> DataFrame:
    """``docs`` with new texts: ``fn(texts)`` gives them and, where rows go, whether each row stays.
    All columns pass as Arrow columns, some ``chars`` characters at a time, so a worker never holds a
    batch of whole texts as Python objects."""
    at, schema = docs.columns.index(text_col), docs.schema

    def job(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            lengths = pc.fill_null(pc.utf8_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff(np.cumsum(lengths, dtype=np.int64) // chars)) + 1
            for first, last in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                part = b.slice(first, last - first)
                new, stays = fn(part.column(at).to_pylist())
                texts = pa.array(new, part.column(at).type)
                out = pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(part.columns)], names=schema.names)
                yield out if stays is None else out.filter(pa.array(stays, pa.bool_()))

    return arrow_map(docs, job, schema, keep)


def record(schema: Sequence[tuple[str, pa.DataType]], columns: Sequence) -> pa.RecordBatch:
    """A record batch from Python lists, numpy or Arrow arrays."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for (_, t), c in zip(schema, columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in schema])


def list_of_int32(parts: Sequence[bytes]) -> pa.Array:
    """list<int32> from little-endian 32-bit runs, without a Python object per value."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def int32_lists(col: pa.Array) -> Iterator[bytes]:
    """The runs of a list<int32> column as little-endian bytes; null is the empty run."""
    values = np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))
    offsets = col.offsets.to_numpy()
    valid = col.is_valid().to_pylist()
    for i, ok in enumerate(valid):
        yield values[offsets[i] : offsets[i + 1]].tobytes() if ok else b""


def join_side(rows: DataFrame, side: DataFrame, key: str, bound: int = 100_000, salts: int = 32) -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row a value of ``key`` (null is a value).
    A side of at most ``bound`` rows is broadcast; beyond that both are dealt by (key, salt), so a
    value that a third of all rows have is spread over ``salts`` tasks. The result is the same."""
    other = side.withColumnRenamed(key, "_side_key")
    if other.count() <= bound:
        return rows.join(F.broadcast(other), rows[key].eqNullSafe(other["_side_key"]), "left").drop("_side_key")
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    right = other.withColumn("_side_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = left[key].eqNullSafe(right["_side_key"]) & (left["_salt"] == right["_side_salt"])
    return left.join(right, same, "left").drop("_side_key", "_salt", "_side_salt")


def require_at_most(n: int, bound: int, what: str) -> None:
    """The size check in front of every broadcast."""
    if n > bound:
        raise ValueError(f"{what}: {n} exceeds the bound of {bound}")


_HELD: dict = {}


def held(key, make: Callable):
    """One large object a worker process, kept between tasks (an encoder, a cache). Asking for
    another key lets the last one go, so the memories of different jobs don't add up."""
    if key not in _HELD:
        release(key)
        _HELD[key] = make()
    return _HELD[key]


def release(keep=None) -> None:
    """Let go of what is held under any other key, and give the memory that earlier tasks of this
    worker freed back to the machine: a worker lives through many stages."""
    for key in [k for k in _HELD if k != keep]:
        del _HELD[key]
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Nodes of ``edges`` with the smallest node reachable: (node, component).

    Alternating large-star and small-star steps (Kiveris et al. 2014), each a grouped minimum
    (partial aggregation) and an equi-join that adaptive execution can split for a hot centre.
    Each round is written to the shared folder. Links never reach the driver; two numbers do.
    """
    spark = edges.sparkSession
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )

    def fingerprint(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = fingerprint(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # large star: every larger neighbour of u is hung on the smallest neighbour of u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are hung on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = fingerprint(nxt)
        now = nxt
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
