"""Token ids as Parquet: list<int32> columns with dictionary coding, chosen row group and page
sizes and the page index, so that readers fetch only the documents and columns they ask for.

Layout of a folder, one row a document, ascending by doc_id over the files:
``doc_id`` long, ``n_tokens`` long, ``part`` int (the range a row belongs to, ascending),
``local_start`` long (ids of the rows before it in its range), ``token_ids`` list<int32>.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm.common import arrow_map, doc_view, int32_lists, list_of_int32, record, shared_path, table
from scorelab.llm.token_ids import encoder, encoder_key, in_slices

FILE_SCHEMA = "doc_id long, n_tokens long, part int, local_start long, token_ids array<int>"
_FILE = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("token_ids", pa.list_(pa.int32()))]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, kind: str = "word", end_id: int | None = 1,
                      id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = 32 << 20,
                      page_rows: int = 2_000, page_bytes: int = 256 << 10) -> None:
    """Encode every whole text and write the folder ``path``.

    One range shuffle by (doc_id, input partition) orders the files; equal or null ids (first) are
    spread by the partition they come from. Ids are bit-packed through a dictionary (Parquet falls back to
    plain pages where a dictionary grows too large). ``row_group_bytes``, ``page_rows`` and
    ``page_bytes`` set the grain of selective reads. A null text is the empty text: one end id.
    """
    view = doc_view(docs, id_col, text_col).withColumn("origin", F.spark_partition_id())
    ordered = view.repartitionByRange("doc_id", "origin").sortWithinPartitions("doc_id", "origin").drop("origin")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]):
        enc, part, start = encoder(vocabulary, kind), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for a, b in in_slices(texts):
                runs = [r + end for r in enc.encode(texts[a:b])]
                n = np.array([len(r) // 4 for r in runs], np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield record(_FILE, [ids.slice(a, b - a), n, np.full(b - a, part, np.int32), starts, list_of_int32(runs)])

    options = {
        "compression": "zstd", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows), "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20),
        "parquet.column.index.enabled": "true",
    }
    arrow_map(ordered, encode, FILE_SCHEMA, encoder_key(vocabulary, kind)).write.mode("overwrite").options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of the folder; ``low`` and ``high`` (inclusive doc_id) are pushed into the scan, which
    skips files, row groups and pages by their statistics. Select columns to read only them."""
    df = spark.read.schema(FILE_SCHEMA).parquet(path)
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    return df if high is None else df.where(F.col("doc_id") <= high)


def range_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, part_start): ids before each range. Reads two metadata columns, no token page. The
    ordered sum runs over one row a range."""
    from pyspark.sql import Window

    sizes = read_token_files(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: counts and checksums come from the id
    lists read back, ``start`` from the ranges' totals (one row a range, broadcast)."""
    out = [("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def digest(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            runs = list(int32_lists(b.column(3)))
            yield record(out, [b.column(0), b.column(1), b.column(2), [len(r) // 4 for r in runs], [zlib.crc32(r) for r in runs]])

    rows = read_token_files(spark, path).select("doc_id", "part", "local_start", "token_ids")
    rows = arrow_map(rows, digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(range_starts(spark, path)), "part").select(
        "doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of all documents (word_bpe_49k, end id 1) and read them back:
    doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = shared_path(spark, "token_files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(spark, path)
