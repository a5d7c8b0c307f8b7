"""Repeated passages by a distributed merge sort of sorted suffix runs.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
doc_id. Sorting every suffix would move ``length`` bytes for each byte of text, so suffixes are
taken at anchors: in each string of ``length`` bytes the place of its smallest hashed gram. Equal
strings have their anchor at the same place, so they meet under it. The steps:

1. Texts are written once as chunks of a few megabytes.
2. Each chunk sends the hashes of its anchors' grams as sorted runs; what one task receives is
   bounded by the number of buckets. The answer, one bit a gram, says which occur in two or more
   documents.
3. For those, each chunk sorts the suffixes that start at the anchors and sends them as
   front-coded runs (each suffix without the prefix it shares with the one before), each with the
   few bytes left of the anchor that its strings reach. Equal suffixes with equal left parts are
   sent once a chunk: those of later documents are answered on the spot, the places of the same
   document's wait for the answer.
4. A loser tree merges the runs of a slice. It keeps for each run the length of the prefix shared
   with the last winner; longer ones win without a look at the text, and equal ones are compared
   from there on. Suffixes with one gram come out together, and their strings are compared whole.
   Grams with very many anchors go another, equally exact way: their strings are grouped by Spark
   with partial minima, so no task holds all their places.
5. The spans found go back to the chunks, which cut them.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm.common import arrow_map, doc_view, record, table, written

#: Stands for a null doc_id: larger than any other, so such a text cuts no other.
NO_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k bytes, never 0; built by doubling."""
    power, h, size, out, done = _BASE, data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, done = h, size
            else:  # the part so far, then ``size`` bytes more
                n = len(data) - done - size + 1
                out = out[:n] * np.uint64(power) + h[done : done + n]
                done += size
        size *= 2
        if size > k:
            break
        n = len(h) - size // 2
        h = h[:n] * np.uint64(power) + h[size // 2 : size // 2 + n]
        power = power * power & _M64
    out = out ^ (out >> np.uint64(29))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out | np.uint64(1)


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = pick(x[: len(x) - size], x[size:])
        size *= 2
    return pick(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(data: np.ndarray, valid: np.ndarray, length: int, k: int, chosen: bool = False, step: int = 1 << 18):
    """Places and hashes of the anchors of all valid strings (``valid``: by string start). With
    ``chosen`` also the first and last start of the strings that have each as their anchor."""
    w = length - k + 1
    places, hashes, firsts, lasts = [], [], [], []
    for a in range(0, len(valid), step):
        ok = valid[a : a + step]
        n = len(ok)
        h = gram_hashes(data[a : a + n - 1 + length], k)
        low = np.where(ok, _sliding(h, w, np.minimum), np.uint64(0))
        edge = np.zeros(w - 1, np.uint64)
        padded = np.concatenate([edge, low, edge])
        hit = np.flatnonzero(_sliding(padded, w, np.maximum) == h)
        places.append(hit + a)
        hashes.append(h[hit])
        if chosen:
            first, last = np.full(len(hit), 1 << 62), np.full(len(hit), -1)
            for back in range(w):  # the string that starts ``back`` before the anchor
                mine = padded[hit + w - 1 - back] == hashes[-1]
                start = hit + a - back
                first = np.where(mine, np.minimum(first, start), first)
                last = np.where(mine, np.maximum(last, start), last)
            firsts.append(first)
            lasts.append(last)
    if not places:
        empty = np.zeros(0, np.int64)
        return empty, empty.astype(np.uint64), empty, empty
    place, at, back = np.unique(np.concatenate(places), return_index=True, return_inverse=True)
    h = np.concatenate(hashes)[at]
    if not chosen:
        return place, h, None, None
    first, last = np.full(len(place), 1 << 62), np.full(len(place), -1)
    np.minimum.at(first, back, np.concatenate(firsts))  # an anchor at the border of two steps
    np.maximum.at(last, back, np.concatenate(lasts))
    return place, h, first, last


class Chunk:
    """Texts of one chunk as one byte array."""

    def __init__(self, ids: Sequence[int | None], sizes: Sequence[int], blob: bytes):
        raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, sum(sizes)))
        self.data = np.frombuffer(raw, np.uint8)
        self.raw, self.ids = raw, np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.ends = np.cumsum(np.array(sizes, np.int64))
        self.starts = self.ends - np.array(sizes, np.int64)

    def valid(self, length: int) -> np.ndarray:
        """Whether a string of ``length`` bytes that starts here stays in its document."""
        ok = np.zeros(max(0, len(self.data) - length + 1), bool)
        for a, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            ok[a : max(a, e - length + 1)] = True
        return ok

    def rows(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")


class Grams:
    """The distinct grams of a chunk's anchors in the order (bucket, value)."""

    def __init__(self, h: np.ndarray, buckets: int):
        bucket, value = (h % np.uint64(buckets)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64)
        self.key, self.of = np.unique(bucket << 32 | value, return_inverse=True)
        self.bucket = self.key >> 32

    def counts(self) -> np.ndarray:
        """Anchors of each gram."""
        return np.bincount(self.of, minlength=len(self.key))

    def several(self, ids: np.ndarray) -> np.ndarray:
        """Which grams occur under two or more doc_ids of the chunk."""
        low, high = np.full(len(self.key), NO_ID), np.full(len(self.key), -(1 << 63))
        np.minimum.at(low, self.of, ids)
        np.maximum.at(high, self.of, ids)
        return low < high


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, ids, sizes, blob) of all texts as UTF-8; a chunk holds whole documents."""
    out = [("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("blob", pa.binary())]

    def job(batches: Iterator[pa.RecordBatch]):
        part, n = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0
        packer = zstandard.ZstdCompressor(level=3)

        def row():
            return record(out, [[part << 32 | n], [ids], [[len(t) for t in texts]], [packer.compress(b"".join(texts))]])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = t.encode()
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held >= chunk_bytes:
                    yield row()
                    ids, texts, held, n = [], [], 0, n + 1
        if ids:
            yield row()

    return arrow_map(docs, job, "chunk long, ids array<long>, sizes array<long>, blob binary")


def _open(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple]:
    """Rows of a batch, one at a time: blobs are not held twice."""
    cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in cols)


def _runs_of_grams(chunks: DataFrame, buckets: int, length: int, k: int) -> DataFrame:
    out = [("bucket", pa.int32()), ("chunk", pa.int64()), ("grams", pa.binary()), ("several", pa.binary()), ("counts", pa.binary()), ("more", pa.binary())]

    def job(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for chunk, ids, sizes, blob in _open(b, ("chunk", "ids", "sizes", "blob")):
                c = Chunk(ids, sizes, blob)
                place, h, _, _ = anchors(c.data, c.valid(length), length, k)
                g = Grams(h, buckets)
                if not len(g.key):
                    continue
                several, counts, packer = g.several(c.ids[c.rows(place)]), g.counts(), zstandard.ZstdCompressor(level=1)
                cut = np.flatnonzero(np.diff(g.bucket, prepend=-1))
                ends = np.append(cut[1:], len(g.key))
                values, low = (g.key & 0xFFFFFFFF).astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
                yield record(out, [
                    g.bucket[cut].astype(np.int32), [chunk] * len(cut), [values[a:e].tobytes() for a, e in zip(cut, ends, strict=True)],
                    [np.packbits(several[a:e]).tobytes() for a, e in zip(cut, ends, strict=True)],
                    [packer.compress(low[a:e].tobytes()) for a, e in zip(cut, ends, strict=True)],
                    [counts[a:e][low[a:e] == 255].astype(np.int64).tobytes() for a, e in zip(cut, ends, strict=True)],  # whole counts of the few with many
                ])

    return arrow_map(chunks, job, "bucket int, chunk long, grams binary, several binary, counts binary, more binary")


def _groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[int, list[tuple]]]:
    """(key, rows) for runs of equal first column, over batch borders."""
    key, held = None, []
    for b in batches:
        for row in _open(b, names):
            if row[0] != key and held:
                yield key, held
                held = []
            key = row[0]
            held.append(row[1:])
    if held:
        yield key, held


def _answers(runs: DataFrame, heavy: int) -> DataFrame:
    """(chunk, bucket, n, repeated, heavy): for each run, which grams occur in two or more
    documents, and which of those at ``heavy`` or more anchors."""
    out = [("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("repeated", pa.binary()), ("heavy", pa.binary())]

    def job(batches: Iterator[pa.RecordBatch]):
        for bucket, rows in _groups(batches, ("bucket", "chunk", "grams", "several", "counts", "more")):
            values = [np.frombuffer(r[1], np.uint32) for r in rows]
            several = [np.unpackbits(np.frombuffer(r[2], np.uint8), count=len(v)) for r, v in zip(rows, values, strict=True)]
            counts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(r[3]), np.uint8).astype(np.int64) for r in rows]
            for n, r in zip(counts, rows, strict=True):
                n[n == 255] = np.frombuffer(r[4], np.int64)
            _, of, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
            total = np.bincount(of, np.concatenate(counts), len(n))
            marked = np.zeros(len(n), bool)
            marked[of[np.concatenate(several) > 0]] = True
            again, many = ((n > 1) | marked)[of], (total >= heavy)[of]
            at = np.cumsum([0, *map(len, values)])
            cols: list[list] = [[] for _ in out]
            for (chunk, *_), a, e in zip(rows, at, at[1:], strict=False):
                many_bits = np.packbits(many[a:e]).tobytes() if many[a:e].any() else b""
                for c, v in zip(cols, (chunk, bucket, int(again[a:e].sum()), np.packbits(again[a:e]).tobytes(), many_bits), strict=True):
                    c.append(v)
            yield record(out, cols)

    dealt = runs.repartition("bucket").sortWithinPartitions("bucket")
    return arrow_map(dealt, job, "chunk long, bucket int, n long, repeated binary, heavy binary")


def _beside(big: DataFrame, small: DataFrame) -> DataFrame:
    """Left join by chunk, one row of either a chunk. Both grow with the data: never broadcast by a
    hint, so the plan is the same at every size."""
    return big.join(small, "chunk", "left")


#: Left part, suffix, doc_id, chunk, row in the chunk, place of the first byte in the document.
Entry = tuple[bytes, bytes, int, int, int, int]


class Run:
    """One front-coded run. Entries: suffix, left part, doc_id, row in its chunk, first place."""

    def __init__(self, chunk: int, blob: bytes):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int.from_bytes(raw[:8], "little")
        at = 8

        def take(kind, count):
            nonlocal at
            x = np.frombuffer(raw, kind, count, at)
            at += x.nbytes
            return x.tolist()

        self.chunk, self.n = chunk, n
        self.shared, self.right, self.left = take(np.uint8, n), take(np.uint8, n), take(np.uint8, n)
        self.ids, self.rows, self.places = take(np.int64, n), take(np.int64, n), take(np.int64, n)
        lefts = int(sum(self.left))
        self.lefts, self.rest = raw[at : at + lefts], raw[at + lefts :]
        self.i, self.at, self.at_left, self.suffix = -1, 0, 0, b""

    @staticmethod
    def pack(suffixes: Sequence[bytes], lefts: Sequence[bytes], ids, rows, places) -> bytes:
        shared, before = [], b""
        for s in suffixes:
            shared.append(common(before, s, 0))
            before = s
        parts = [len(suffixes).to_bytes(8, "little")]
        parts += [np.array(x, np.uint8).tobytes() for x in (shared, list(map(len, suffixes)), list(map(len, lefts)))]
        parts += [np.asarray(x, np.int64).tobytes() for x in (ids, rows, places)]
        parts += [b"".join(lefts), b"".join([s[n:] for s, n in zip(suffixes, shared, strict=True)])]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    def advance(self) -> int:
        """Go to the next entry; the prefix it shares with the one before, or -1 at the end."""
        if self.i >= 0:
            self.at_left += self.left[self.i]
        self.i += 1
        if self.i == self.n:
            return -1
        shared = self.shared[self.i]
        more = self.right[self.i] - shared
        self.suffix = self.suffix[:shared] + self.rest[self.at : self.at + more]
        self.at += more
        return shared

    def entry(self) -> Entry:
        i, at = self.i, self.at_left
        return self.lefts[at : at + self.left[i]], self.suffix, self.ids[i], self.chunk, self.rows[i], self.places[i]


def common(a: bytes, b: bytes, start: int) -> int:
    """The length of the common prefix, known to be at least ``start``."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - 1 - (diff.bit_length() - 1) // 8


def merge(runs: Sequence[Run]) -> Iterator[tuple[int, Run]]:
    """(prefix shared with the entry before, run standing at the entry) in order of the suffixes.

    A loser tree over the runs. ``shared`` is, for each run's entry, the prefix it shares with the
    last winner: the larger wins without a comparison, and text is compared only beyond it.
    """
    k = 1
    while k < len(runs):
        k *= 2
    done = -1  # no entry left
    shared = [done] * k
    for i, r in enumerate(runs):
        shared[i] = 0 if r.advance() >= 0 else done

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix is then that with the winner."""
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x == done:
            return a, b
        s, t = runs[a].suffix, runs[b].suffix
        n = common(s, t, x)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    tree = [0] * k
    level = list(range(k))
    at = k
    while len(level) > 1:  # the first games, from the leaves up
        at //= 2
        nxt = []
        for j in range(0, len(level), 2):
            win, lose = play(level[j], level[j + 1])
            tree[at + j // 2] = lose
            nxt.append(win)
        level = nxt
    win = level[0]
    while shared[win] != done:
        yield shared[win], runs[win]
        mine = runs[win].advance()
        node = (win + k) // 2
        while node:  # the games on the way up, as in ``play``, with the riser's prefix at hand
            other = tree[node]
            theirs = shared[other]
            if mine < theirs:
                shared[win] = mine
                tree[node], win, mine = win, other, theirs
            elif mine == theirs and mine != done:
                s, t = runs[win].suffix, runs[other].suffix
                n = common(s, t, mine)
                if n == len(s) or (n < len(t) and s[n] < t[n]):
                    shared[other] = n
                else:
                    shared[win] = n
                    tree[node], win, mine = win, other, theirs
            node //= 2
        shared[win] = mine


def covered(group: Sequence[Entry], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(chunk, row, start, end) of the strings that an entry with a smaller doc_id has too."""
    for part in _by_pairs(group, length) if len(group) <= 4 else _by_strings(group, length):
        yield part


def _by_pairs(group: Sequence[Entry], length: int) -> Iterator[tuple[int, int, int, int]]:
    """For a few entries: what two have in common around the anchor, to either side."""
    for left, right, doc, chunk, row, place in group:
        spans = []
        for left2, right2, doc2, *_ in group:
            if doc2 < doc:
                n = min(len(left), len(left2))
                if left[len(left) - n :] == left2[len(left2) - n :]:
                    before = n
                else:
                    diff = int.from_bytes(left[len(left) - n :], "big") ^ int.from_bytes(left2[len(left2) - n :], "big")
                    before = ((diff & -diff).bit_length() - 1) // 8
                after = common(right, right2, 0)
                if before + after >= length:
                    spans.append((len(left) - before, len(left) + after))
        if len(spans) > 1:
            spans.sort()
        end = -1
        for a, b in spans:
            if b > end:
                yield chunk, row, place + max(a, end), place + b
                end = b


def _by_strings(group: Sequence[Entry], length: int) -> Iterator[tuple[int, int, int, int]]:
    """For many: the smallest document of each string. Equal strings have the anchor at equal places, so
    strings are held against each other one place of the anchor at a time."""
    hits = [0] * len(group)  # a bit for each start, counted from the entry's first byte
    rows = [(j, len(e[0]), e[0] + e[1], e[2]) for j, e in enumerate(group)]
    for before in range(max(r[1] for r in rows) + 1):  # bytes in front of the anchor
        low: dict[bytes, int] = {}
        get, mine = low.get, []
        for j, left, text, doc in rows:
            s = left - before
            if s >= 0 and s + length <= len(text):
                w = text[s : s + length]
                mine.append((j, s, w, doc))
                if get(w, NO_ID) >= doc:
                    low[w] = doc
        if len(low) < len(mine):
            for j, s, w, doc in mine:
                if low[w] < doc:
                    hits[j] |= 1 << s
    for bits, (_, _, _, chunk, row, place) in zip(hits, group, strict=True):
        start = end = -1
        while bits:
            s = (bits & -bits).bit_length() - 1
            bits &= bits - 1
            if s > end or end < 0:
                if end >= 0:
                    yield chunk, row, place + start, place + end
                start = s
            end = s + length
        if end >= 0:
            yield chunk, row, place + start, place + end


#: Kinds of rows that a chunk sends on: a sorted run, spans found on the spot, strings of heavy
#: grams, places of entries that the same document repeats.
RUN, SPANS, HEAVY, COPIES = 0, 1, 2, 3


def _runs_of_suffixes(chunks: DataFrame, buckets: int, slices: int, length: int, k: int) -> DataFrame:
    out = [("slice", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())]

    def job(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for chunk, ids, sizes, blob, answer in _open(b, ("chunk", "ids", "sizes", "blob", "answer")):
                if answer:
                    yield record(out, list(zip(*_send(Chunk(ids, sizes, blob), chunk, answer, buckets, slices, length, k), strict=True)) or [[]] * 4)

    return arrow_map(chunks, job, "slice int, kind int, chunk long, blob binary")


def _send(c: Chunk, chunk: int, answer: list[dict], buckets: int, slices: int, length: int, k: int) -> list[tuple[int, int, int, bytes]]:
    place, h, first, last = anchors(c.data, c.valid(length), length, k, chosen=True)
    g = Grams(h, buckets)
    repeated, heavy = np.zeros(len(g.key), bool), np.zeros(len(g.key), bool)
    for a in answer:
        lo, hi = np.searchsorted(g.bucket, [a["bucket"], a["bucket"] + 1])
        repeated[lo:hi] = np.unpackbits(np.frombuffer(a["repeated"], np.uint8), count=hi - lo) > 0
        if a["heavy"]:
            heavy[lo:hi] = np.unpackbits(np.frombuffer(a["heavy"], np.uint8), count=hi - lo) > 0
    at = np.flatnonzero(repeated[g.of])
    if not len(at):
        return []
    place, first, last, hot = place[at], first[at], last[at], heavy[g.of[at]]
    where = (h[at] >> np.uint64(8)) % np.uint64(slices)
    row = c.rows(place)
    doc, origin = c.ids[row], c.starts[row]
    raw, found, spans, copies = c.raw, {}, array("q"), {}
    # entries in order of doc_id: of equal ones the first goes on, later documents' are answered,
    # and the same document's stand or fall with it: their places wait in the chunk's own rows
    order = np.argsort(doc, kind="stable")
    for a in range(0, len(order), 1 << 16):
        for j in order[a : a + (1 << 16)].tolist():
            f, p, e = int(first[j]), int(place[j]), int(last[j]) + length
            key = (raw[p:e], raw[f:p])
            old = found.get(key)
            if old is None:
                found[key] = j
            elif doc[old] < doc[j]:
                r, f, e = int(row[j]), f - int(origin[j]), e - int(origin[j])
                if spans and spans[-3] == r and spans[-2] <= f <= spans[-1]:
                    spans[-1] = max(spans[-1], e)
                else:
                    spans.extend((r, f, e))
            else:
                copies.setdefault(old, array("q")).append(f)
    by_slice: dict[int, list[tuple]] = {}
    strings: list[tuple[bytes, int, int, int]] = []
    for key, j in found.items():
        f = int(first[j]) - int(origin[j])
        if hot[j]:
            text = key[1] + key[0]
            strings += [(text[s : s + length], int(doc[j]), int(row[j]), f + s) for s in range(len(text) - length + 1)]
        else:
            by_slice.setdefault(int(where[j]), []).append((key[0], key[1], int(doc[j]), int(row[j]), f))
    rows = []
    for s, entries in by_slice.items():
        entries.sort()
        rows.append((s, RUN, chunk, Run.pack(*zip(*entries, strict=True))))
    for n in range(0, len(spans), 900_000):
        rows.append(((chunk + n) % slices, SPANS, *_packed({chunk: spans[n : n + 900_000]})[0]))
    flat = array("q")
    for n, (j, places) in enumerate(copies.items(), 1):
        for i in range(0, len(places), 500_000):
            part = places[i : i + 500_000]
            flat.extend((int(first[j]), int(last[j]) + length, len(part)))
            flat.extend(part)
            if len(flat) >= 500_000:
                rows.append(((chunk + n) % slices, COPIES, *_packed({chunk: flat})[0]))
                flat = array("q")
    if flat:
        rows.append((chunk % slices, COPIES, *_packed({chunk: flat})[0]))
    for n in range(0, len(strings), 50_000):
        part = strings[n : n + 50_000]
        numbers = np.array([x[1:] for x in part], np.int64).tobytes()
        rows.append(((chunk + n) % slices, HEAVY, chunk, zstandard.ZstdCompressor(level=1).compress(numbers + b"".join([x[0] for x in part]))))
    return rows


def _copied(copies: Sequence[np.ndarray], starts: np.ndarray, stops: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, stops) of the spans that copies have because the entry they repeat has them. All
    places count from the start of the chunk; what lies within the entry holds for its copies."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], stops[order]
    for flat in copies:
        at = 0
        while at < len(flat):
            f, e, n = flat[at : at + 3].tolist()
            places = flat[at + 3 : at + 3 + n]
            at += 3 + n
            lo, hi = np.searchsorted(starts, [f, e - length + 1])
            for a, b in set(zip(starts[lo:hi].tolist(), stops[lo:hi].tolist(), strict=True)):
                if b <= e:
                    yield places + (a - f), places + (b - f)


def _packed(found: dict[int, Sequence[int]]) -> list[tuple[int, bytes]]:
    """(chunk, blob) of flat lists of numbers by chunk."""
    return [(c, zstandard.ZstdCompressor(level=1).compress(np.array(x, np.int64).tobytes())) for c, x in found.items()]


def _merged(runs: DataFrame, length: int, k: int) -> DataFrame:
    """(chunk, spans, copies, row, start, doc, string): blobs of spans found by the merges (``spans``
    set), those of repeated entries as they came (``copies``), and the strings of heavy grams with
    their document for the grouping (``string`` set)."""
    names = [("chunk", pa.int64()), ("spans", pa.binary()), ("copies", pa.binary()), ("row", pa.int64()), ("start", pa.int64()), ("doc", pa.int64()), ("string", pa.binary())]

    def flush(found: dict[int, list[int]]):
        rows = _packed(found)
        none = [None] * len(rows)
        return record(names, [[r[0] for r in rows], [r[1] for r in rows], none, none, none, none, none])

    def job(batches: Iterator[pa.RecordBatch]):
        for _, rows in _groups(batches, ("slice", "kind", "chunk", "blob")):
            found: dict[int, list[int]] = {}
            held = 0
            for kind, chunk, blob in rows:
                if kind == SPANS:
                    yield record(names, [[chunk], [blob], [None], [None], [None], [None], [None]])
                elif kind == COPIES:
                    yield record(names, [[chunk], [None], [blob], [None], [None], [None], [None]])
                elif kind == HEAVY:
                    raw = zstandard.ZstdDecompressor().decompress(blob)
                    n = len(raw) // (24 + length)
                    x = np.frombuffer(raw, np.int64, 3 * n).reshape(-1, 3)
                    text = raw[24 * n :]
                    yield record(names, [np.full(n, chunk), [None] * n, [None] * n, x[:, 1], x[:, 2], x[:, 0], [text[length * i : length * (i + 1)] for i in range(n)]])
            group: list[tuple] = []
            merged = merge([Run(chunk, blob) for kind, chunk, blob in rows if kind == RUN])
            for shared, run in itertools.chain(merged, [(0, None)]):
                if shared < k:
                    if len(group) > 1:
                        for chunk, row, start, stop in covered(group, length):
                            found.setdefault(chunk, []).extend((row, start, stop))
                            held += 1
                        if held > 300_000:
                            yield flush(found)
                            found, held = {}, 0
                    group = []
                if run is not None:
                    group.append(run.entry())
            if found:
                yield flush(found)

    dealt = runs.repartition("slice").sortWithinPartitions("slice")
    return arrow_map(dealt, job, "chunk long, spans binary, copies binary, row long, start long, doc long, string binary")


def cut_repeats(docs: DataFrame, length: int = 50, gram: int = 24, chunk_bytes: int = 8 << 20, bucket_grams: int = 1_500_000,
                slice_entries: int = 150_000, heavy: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), one row a row of ``docs``.

    A null text is empty. A text under a null doc_id loses what any document with an id has too,
    and cuts no other. Rows with the same doc_id are one document: they don't cut each other.
    Matches never cross rows. ``length`` is at most 255.
    """
    chunks = written(_chunks(doc_view(docs, id_col, text_col), chunk_bytes), "repeat_chunks")
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    expected = 2 * total // (length - gram + 2)  # anchors: two in a window and one
    buckets = max(1, -(-expected // bucket_grams), min(64, total >> 20))
    answers = written(_answers(_runs_of_grams(chunks, buckets, length, gram), heavy).where("n > 0"), "repeat_answers")
    grams = answers.agg(F.sum("n")).first()[0] or 0
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "repeated", "heavy")).alias("answer"))  # one bit a gram of the chunk
    slices = max(1, -(-grams // slice_entries), min(64, grams >> 10))
    sent = _runs_of_suffixes(_beside(chunks, by_chunk), buckets, slices, length, gram)
    out = written(_merged(sent, length, gram), "repeat_spans")
    strings = out.where("string is not null")
    low = strings.groupBy("string").agg(F.min("doc").alias("low"))
    heavy_cuts = strings.join(low, "string").where("doc > low").groupBy("chunk").agg(F.collect_list(F.struct("row", "start")).alias("starts"))
    packed = out.where("string is null").groupBy("chunk").agg(F.collect_list("spans").alias("spans"), F.collect_list("copies").alias("copies"))  # those of one chunk
    cuts = written(packed.join(heavy_cuts, "chunk", "full"), "repeat_cuts")
    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]

    def job(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for ids, sizes, blob, spans, copies, starts in _open(b, ("ids", "sizes", "blob", "spans", "copies", "starts")):
                c = Chunk(ids, sizes, blob)
                step = np.zeros(len(c.data) + 1, np.int32)
                parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64).reshape(-1, 3) for x in spans or ()]
                if starts:
                    parts.append(np.array([(x["row"], x["start"], x["start"] + length) for x in starts], np.int64))
                held = [(c.starts[at[:, 0]] + at[:, 1], c.starts[at[:, 0]] + at[:, 2]) for at in parts]
                for first, last in held:
                    np.add.at(step, first, 1)
                    np.add.at(step, last, -1)
                if copies and held:
                    first, last = (np.concatenate(x) for x in zip(*held, strict=True))
                    flats = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64) for x in copies]
                    for first, last in _copied(flats, first, last, length):  # distinct places
                        step[first] += 1
                        step[last] -= 1
                np.cumsum(step, out=step)  # in place: a wider sum would be most of what the task holds
                gone = step[:-1] > 0
                del step
                rows = []
                for i, a, e in zip(ids, c.starts.tolist(), c.ends.tolist(), strict=True):
                    mask = gone[a:e]
                    n = int(mask.sum())
                    runs = int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum()) if n else 0
                    rows.append((i, e - a, n, runs, c.data[a:e][~mask].tobytes() if n else c.raw[a:e]))
                    if len(rows) == 1000:
                        yield record(names, list(zip(*rows, strict=True)))
                        rows = []
                if rows:
                    yield record(names, list(zip(*rows, strict=True)))

    joined = _beside(chunks, cuts)
    return arrow_map(joined, job, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that a 50-byte string shared with an earlier one covers."""
    cut = cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
