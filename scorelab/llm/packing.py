"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents in doc_id order. A round deals one window (1024 ids): a
queue with weight w is owed w * 1024 ids a round, is served in whole grains of ``grain`` ids, and
what it is still owed is its deficit, carried into the next round. With the default weights (the
queues' shares of all ids) every window holds the corpus' proportions and all queues run dry
together; with other weights a dry queue simply stops and the others go on.

The schedule needs no simulation: after r rounds a queue has been served
``c(r) = grain * floor(r * quota / (grain * 2**16))`` ids (quota: w * 1024 in 2**-16 ids), or all
it has. So the place of any id follows from its queue's place and the totals of all queues, and
each document is cut on its own, in any task; deficits carry across windows, tasks and files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm.common import arrow_map, doc_view, list_of_int32, record, require_at_most, table, written
from scorelab.llm.token_ids import encoder, encoder_key, in_slices

#: Fraction bits of the quota.
_BITS = 16


class Schedule:
    """Places of ids under the deficit round-robin. ``totals`` and ``weights``: by queue."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, window: int, grain: int):
        self.totals, self.window, self.grain = totals.astype(np.int64), window, grain
        share = weights / max(weights.sum(), 1e-300)
        self.quota = np.maximum(1, np.ceil(share * window * (1 << _BITS))).astype(np.int64)
        self.unit = grain << _BITS
        self.all = int(self.totals.sum())
        self.full = self.all // window
        rest, cuts, at = self.all - self.full * window, [], self.full * window
        for bit in reversed(range(window.bit_length())):  # the rest goes to sequences of a power of two: no padding
            if rest >> bit & 1:
                cuts.append(at)
                at += 1 << bit
        self.tail = np.array(cuts, np.int64)

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """(rounds, queues) ids served after so many rounds."""
        return np.minimum(self.totals, rounds[:, None] * self.quota // self.unit * self.grain)

    def runs(self, queue: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (in the queue) and global places of the runs that ids first..last-1 fall into."""
        q = int(self.quota[queue])
        grains = np.arange(first // self.grain, (last - 1) // self.grain + 1, dtype=np.int64)
        rounds = ((grains + 1) * self.unit + q - 1) // q - 1
        new = np.flatnonzero(np.diff(rounds, prepend=-1))
        starts, rounds = np.maximum(grains[new] * self.grain, first), rounds[new]
        places, step = starts.copy(), max(1, (1 << 21) // len(self.totals))
        for a in range(0, len(rounds), step):  # some rounds at a time, however many queues there are
            some = rounds[a : a + step]
            places[a : a + step] += self.served(some + 1)[:, :queue].sum(1) + self.served(some)[:, queue + 1 :].sum(1)
        return starts, places

    def pieces(self, queue: int, first: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids first..cuts[-1]-1 of a queue, cut at every place in ``cuts`` (ascending ends), at every
        round and at every end of a sequence: (start in the queue, length, sequence, offset)."""
        starts, places = self.runs(queue, first, int(cuts[-1]))
        extra = np.setdiff1d(cuts[:-1], starts, assume_unique=True)  # ends of documents within a run
        extra = extra[extra > first]
        at = np.searchsorted(starts, extra, "right") - 1
        places = np.concatenate([places, places[at] + extra - starts[at]])
        starts = np.concatenate([starts, extra])
        order = np.argsort(starts, kind="stable")
        starts, places = starts[order], places[order]
        sizes = np.diff(np.append(starts, cuts[-1]))
        w = self.window
        if places.size and int((places + sizes).max()) > self.full * w:
            return self._tail_pieces(starts, places, sizes)
        parts = (places + sizes - 1) // w - places // w + 1
        of = np.repeat(np.arange(len(starts)), parts)
        seq = places[of] // w + np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        low, high = np.maximum(places[of], seq * w), np.minimum(places[of] + sizes[of], (seq + 1) * w)
        return starts[of] + low - places[of], high - low, seq, low - seq * w

    def _tail_pieces(self, starts, places, sizes):
        """The same where the last, shorter sequences are met: run by run."""
        out = []
        for a, place, n in zip(starts.tolist(), places.tolist(), sizes.tolist(), strict=True):
            while n:
                seq, base, room = self.sequence(place)
                k = min(n, base + room - place)
                out.append((a, k, seq, place - base))
                a, place, n = a + k, place + k, n - k
        return tuple(np.array(x, np.int64) for x in zip(*out, strict=True))

    def sequence(self, place: int) -> tuple[int, int, int]:
        """(sequence, its first place, its length) at a global place."""
        if place < self.full * self.window:
            return place // self.window, place // self.window * self.window, self.window
        k = int(np.searchsorted(self.tail, place, "right")) - 1
        end = int(self.tail[k + 1]) if k + 1 < len(self.tail) else self.all
        return self.full + k, int(self.tail[k]), end - int(self.tail[k])


def pack(docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 0, window: int = 1024, grain: int = 32,
         weights: dict[str, float] | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue,
    and with ``with_ids`` ids (list<int>). ``window`` must be a power of two.

    A range shuffle by (source, doc_id) puts the queues in order; ids are written once with their
    running place. Totals by (range, source) give each range's start in its queue. Null sources
    are a queue of their own; a null text is the empty text (one end id). Every source is a queue,
    however many there are; the time to place a run grows with their number. The driver holds one number a (range, queue), checked before it is
    broadcast.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    view = doc_view(docs, id_col, text_col, source=source_col).withColumn("origin", F.spark_partition_id())
    ordered = view.repartitionByRange("source", "doc_id", "origin").sortWithinPartitions("source", "doc_id", "origin").drop("origin")
    stored = [("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int32()), ("local_start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]):
        enc, part, at = encoder(vocabulary, kind), TaskContext.get().partitionId(), {}
        for batch in batches:
            texts, ids, sources = batch.column(1).to_pylist(), batch.column(0), batch.column(2)
            for a, b in in_slices(texts):
                runs, starts = [r + end for r in enc.encode(texts[a:b])], []
                n = [len(r) // 4 for r in runs]
                for s, k in zip(sources.slice(a, b - a).to_pylist(), n, strict=True):
                    starts.append(at.get(s, 0))
                    at[s] = starts[-1] + k
                held = [narrow(r) for r in runs]
                yield record(stored, [ids.slice(a, b - a), sources.slice(a, b - a), [part] * (b - a), starts, n, held])

    columns = "doc_id long, source string, part int, local_start long, n long, ids binary"
    rows = written(arrow_map(ordered, encode, columns, encoder_key(vocabulary, kind)), "pack_ids", **{"parquet.enable.dictionary": "false"})
    ranges = rows.groupBy("source", "part").agg(F.sum("n").alias("n"))
    n_ranges = ranges.count()
    require_at_most(n_ranges, 4_000_000, "ranges of the packing")
    sizes = sorted(ranges.collect(), key=lambda r: (r.source is not None, r.source or "", r.part))
    totals: dict[str | None, int] = {}
    start: dict[tuple[str | None, int], int] = {}
    for r in sizes:
        start[r.source, r.part] = totals.get(r.source, 0)
        totals[r.source] = start[r.source, r.part] + r.n
    queue = {s: i for i, s in enumerate(totals)}
    total = np.array(list(totals.values()), np.int64)
    weight = total.astype(float) if weights is None else np.array([float(weights.get(s, 0.0)) for s in totals])
    plan = spark.sparkContext.broadcast((Schedule(total, weight, window, grain), queue, start))
    out = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
           ("sequence_id", pa.int64()), ("offset", pa.int64()), ("queue", pa.string())]
    out += [("ids", pa.list_(pa.int32()))] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]):
        schedule, queues, starts = plan.value
        for batch in batches:
            doc, src, part, local, n = (batch.column(i).to_pylist() for i in range(5))
            begin = np.array([starts[s, p] + a for s, p, a in zip(src, part, local, strict=True)], np.int64)
            end = begin + np.array(n, np.int64)
            new = [0, *[i for i in range(1, len(doc)) if src[i] != src[i - 1] or begin[i] != end[i - 1]], len(doc)]
            for lo, hi in zip(new, new[1:], strict=False):  # documents that follow each other in a queue
                for a in range(lo, hi, 2000):
                    b = min(hi, a + 2000)
                    first, size, seq, off = schedule.pieces(queues[src[a]], int(begin[a]), end[a:b])
                    of = np.searchsorted(end[a:b], first, "right") + a
                    at = first - begin[of]
                    held, ids, last = [], b"", -1
                    for i, s, k in zip(of.tolist(), at.tolist(), size.tolist(), strict=True):
                        if i != last:
                            ids, last = widen(batch.column(5)[i].as_py(), n[i]), i
                        held.append(ids[4 * s : 4 * (s + k)])
                    cols = [pa.array([doc[i] for i in of.tolist()], pa.int64()), at, size, [zlib.crc32(x) for x in held], np.array(n, np.int64)[of], seq, off, [src[a]] * len(of)]
                    yield record(out, cols + [list_of_int32(held)] * with_ids)

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
    return arrow_map(rows, cut, columns + ", ids array<int>" * with_ids)


def narrow(run: bytes) -> bytes:
    """A run of 32-bit ids in 16 bits each where all fit: half the bytes to keep."""
    ids = np.frombuffer(run, "<u4")
    return ids.astype("<u2").tobytes() if len(ids) and int(ids.max()) < 1 << 16 else run


def widen(run: bytes, n: int) -> bytes:
    return np.frombuffer(run, "<u2").astype("<u4").tobytes() if len(run) == 2 * n else run


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (gapless), n."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most a window of ids a group
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), ordered.alias("p")).select(
        "sequence_id", "n", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")
    )


DIGEST = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed to 1024 ids (byte_bpe_50k, end id 0), sources in the
    corpus' proportions in every window."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).select(*DIGEST)
