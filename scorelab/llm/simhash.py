"""SimHash near copies by pigeonhole blocks.

Fingerprints of 64 bits are cut into 6 blocks. Two that differ in at most 4 bits agree in at
least 2 blocks, so every close pair meets under one of the 15 pairs of blocks (about 21 bits
each). Equal fingerprints are merged first, so a group of copies is one fingerprint. The members
of a block pair are checked by Hamming distance, and only a spanning forest of the links found
there is passed on: the components are those of all links, without listing all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm.common import arrow_map, connected_components, doc_view, record, table, written

_WIDTH = (11, 11, 11, 11, 10, 10)


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; no word: 0."""
    words = text.encode().lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(line[a : b - 1], 42) for a, b in zip(starts[:n], ends[shingle - 1 :], strict=True)]), np.uint8)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[8 * at : 8 * (at + (1 << 16))].reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every whole text; null: no word."""
    out = [("doc_id", pa.int64()), ("fp", pa.int64())]

    def job(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield record(out, [b.column(0), fp.view(np.int64)])

    return arrow_map(doc_view(docs, id_col, text_col), job, "doc_id long, fp long")


def _masks(max_bits: int) -> tuple[list[int], int]:
    """Masks of all sets of blocks that a close pair may agree in; block count follows max_bits."""
    widths = _WIDTH if max_bits == 4 else tuple(64 // (max_bits + 2) + (i < 64 % (max_bits + 2)) for i in range(max_bits + 2))
    at, blocks = 0, []
    for w in widths:
        blocks.append(((1 << w) - 1) << at)
        at += w
    keep = len(widths) - max_bits
    return [sum(c) for c in itertools.combinations(blocks, keep)], keep


def _forest(fps: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """(member, smallest member) for the components of the close pairs among distinct ``fps``."""
    n = len(fps)
    label = np.arange(n)
    rows = [np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= max_bits) for i in range(n)] if n <= 4096 else None
    while True:
        new = label.copy()
        for i in range(n):
            near = rows[i] if rows is not None else np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= max_bits)
            new[i] = new[near].min()
        new = new[new]
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(label != np.arange(n)):
        yield int(fps[i]), int(fps[label[i]])


def close_links(fps: DataFrame, max_bits: int = 4, tile: int = 1024) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp`` whose components are those of all pairs that
    differ in at most ``max_bits`` bits.

    Rows are (block set, block value, fp). A block value with more than ``tile`` fingerprints is
    dealt to tiles, one task run for each pair of its parts, so that no run holds more than about
    two parts however hot the value is.
    """
    masks, _ = _masks(max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(signed)])).alias("b")).select("fp", "b.k", "b.v")
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    parts = F.ceil(F.col("n") / tile)
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))
    dealt = (
        keyed.join(sizes, ["k", "v"]).withColumn("mine", mine).withColumn("other", other)
        .select("fp", "k", "v", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )
    runs = dealt.repartition("k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j", "fp")
    out = [("a", pa.int64()), ("b", pa.int64())]

    def check(batches: Iterator[pa.RecordBatch]):
        held: list[np.ndarray] = []  # rows of the last, still open run
        for b in _with_end(batches):
            if b is not None:
                rows = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2, 3, 4, 0)])
                held.append(rows)
                rows = np.concatenate(held) if len(held) > 1 else rows
                last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(1))
                done = last[-1] + 1 if len(last) else 0
                held, rows = [rows[done:]], rows[:done]
            else:
                rows = np.concatenate(held) if held else np.zeros((0, 5), np.int64)
            if not len(rows):
                continue
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
            bounds = np.concatenate([[0], cuts, [len(rows)]])
            size = np.diff(bounds)
            fp = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
            two = bounds[:-1][size == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            a, c = [fp[near + 1].view(np.int64)], [fp[near].view(np.int64)]
            for s, n in zip(bounds[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                found = list(_forest(fp[s : s + n], max_bits))
                if found:
                    pairs = np.array(found, np.uint64).view(np.int64)
                    a.append(pairs[:, 0])
                    c.append(pairs[:, 1])
            a, c = np.concatenate(a), np.concatenate(c)
            if len(a):
                yield record(out, [a, c])

    return arrow_map(runs, check, "a long, b long")


def _with_end(batches):
    """The batches, then None: the last open run is due."""
    yield from batches
    yield None


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that chains of links
    reach, itself included), for every row of ``docs``.

    A null or blank text has fingerprint zero and links like any other. Repeated doc_ids stay
    repeated rows. A null doc_id is kept and counts as larger than any other in its group.
    """
    rows = written(fingerprints(docs, shingle, id_col, text_col), "simhash")
    one = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash_fp")
    nodes = connected_components(close_links(one.select("fp"), max_bits))
    own = one.join(nodes, one.fp == nodes.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    own = written(own, "simhash_own")
    lows = own.groupBy("component").agg(F.min("low").alias("component_id"))
    final = own.join(lows, "component").select("fp", "component_id")
    return rows.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of all documents: 4-word shingles, at most 4 differing bits."""
    return simhash_groups(table(spark, sf_dir, "documents"))
