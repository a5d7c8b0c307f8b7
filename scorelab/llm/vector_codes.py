"""Product codes of vectors: exact rounds of codebook fitting, pruned by norm-of-sum bounds.

A vector's components become integers and are cut into equal consecutive parts; each part position
has a codebook whose entries move for a fixed number of rounds. All codebooks of all rounds are kept
(the history, small whatever the table). For each row, part and group of entries a lower bound on
the distance to the group's entries is kept with the round it was computed in, its stamp. Later the
bound falls by the net displacement of the group's entries since that round, the norm of the sum of
their moves, taken from the history; that is never more than the sum of the norms of the moves. A
group is scanned again, exactly, only if its bound does not exceed the exact distance to the row's
own entry. The result is that of scanning everything, ties included.

A round is one pass: each task reads rows with their bounds, writes them with new ones, and adds its
rows' sums for every entry at the end; the sums are added up by entry and the new codebooks, a few
thousand numbers, are worked out on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelab.llm.common import arrow_map, join_side, table, written

#: Larger integers could not be squared and added in 64 bits.
LARGEST = 1 << 28


def integer_vectors(vectors: DataFrame, parts: int, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of vectors without null or non-finite components: floor(scale * x) of each,
    filled with zeros to the widest vector's width, rounded up to a multiple of ``parts``."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"), finite.alias("finite"))
    rows = rows.where("v is not null and finite").select("id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    width, largest = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    width = -(-(width or 0) // parts) * parts
    if (largest or 0) > LARGEST:
        raise ValueError(f"components beyond {LARGEST / scale} don't fit the integer arithmetic")
    filled = F.concat(F.col("v"), F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    return rows.select("id", "label", filled.cast("array<int>").alias("v"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to the rows of ``c``: float64 where that is
    exact, else int64."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def net_moves(books: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(stamp, group): the largest net displacement of a group's entries from each round to the last."""
    gone = ((books[-1].astype(float) - books.astype(float)) ** 2).sum(2)
    return np.sqrt(np.maximum.reduceat(gone, starts, axis=1)) * (1 + 1e-9)


def reassign(x, own, low, stamp, books, starts):
    """New (own, low, stamp, squared distance, scans) of one part of a batch. ``own`` None: no bounds
    yet. ``books`` is the part's history (rounds so far, entries, width); group g has the entries
    from ``starts[g]`` on."""
    now, c, n, k = len(books) - 1, books[-1], len(x), books.shape[1]
    every, ends = np.arange(n), [*starts[1:].tolist(), k]
    far = np.inf if x.dtype.kind == "f" else np.iinfo(np.int64).max
    if own is None:
        scan, bound, dist = np.ones((n, len(starts)), bool), None, squares(x, c)
    else:
        mine = ((x - c[own]) ** 2).sum(1)
        bound = low - net_moves(books, starts)[stamp, np.arange(len(starts))]
        scan = bound <= (np.sqrt(mine) * (1 + 1e-9))[:, None]
        dist = np.full((n, k), far, x.dtype)
        for g, (a, b) in enumerate(zip(starts.tolist(), ends, strict=True)):
            hit = np.flatnonzero(scan[:, g])
            if len(hit):
                dist[hit, a:b] = squares(x[hit], c[a:b])
        dist[every, own] = mine
    new = dist.argmin(1)  # of equal distances the first
    best = dist[every, new].astype(np.int64)
    dist[every, new] = far
    other = np.minimum.reduceat(dist, starts, axis=1)  # nearest of each group but the row's own entry
    fresh = np.where(other == far, np.inf, np.sqrt(other.astype(float))) * (1 - 1e-6)
    if own is None:
        return new, fresh.astype(np.float32), np.full(scan.shape, now, np.uint8), best, scan.sum()
    left = ~scan & (other != far)  # a group not scanned, which the row's old entry now counts in
    low = np.where(scan, fresh, np.where(left, np.minimum(bound * (1 - 1e-6), fresh), low))
    return new, low.astype(np.float32), np.where(scan | left, now, stamp).astype(np.uint8), best, scan.sum()


def _pass(state: DataFrame, history: list[np.ndarray], groups: int) -> DataFrame:
    """One round: rows (kind 0) with new codes and bounds, and sums by part and entry (kind 1)."""
    books = np.stack(history, axis=1)  # (part, round, entry, width)
    parts, rounds, entries, width = books.shape
    starts = np.unique(np.linspace(0, entries, min(groups, entries), endpoint=False).astype(int))
    largest = int(np.abs(books).max(initial=0))
    schema = T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("id", T.LongType()), state.schema["label"],
        T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("code", T.BinaryType()),
        T.StructField("low", T.BinaryType()), T.StructField("stamp", T.BinaryType()), T.StructField("error", T.LongType()),
        T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("scans", T.LongType()),
    ])
    kinds = {"kind": pa.int32(), "part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "scans": pa.int64(), "error": pa.int64(),
             "id": pa.int64(), "code": pa.binary(), "low": pa.binary(), "stamp": pa.binary(), "v": pa.list_(pa.int32()), "sums": pa.list_(pa.int64())}

    def job(batches: Iterator[pa.RecordBatch]):
        sums, counts, scans = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), 0
        kind_of_label = None

        def rows(height: int, **have) -> pa.RecordBatch:
            types = kinds | {"label": kind_of_label}
            cols = [have[f.name] if f.name in have else pa.nulls(height, types[f.name]) for f in schema]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        for b in batches:
            n = b.num_rows
            kind_of_label = b.schema.field("label").type
            if not n:
                continue
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width)
            top = max(largest, int(np.abs(flat).max(initial=0)))
            exact = np.float64 if 4 * top * top * max(width, 1) < 1 << 53 else np.int64
            have = rounds > 1
            raw = {c: b"".join(b.column(c).to_pylist()) for c in ("code", "low", "stamp")} if have else {}
            own = np.frombuffer(raw["code"], "<i4").reshape(n, parts) if have else None
            low = np.frombuffer(raw["low"], "<f4").reshape(n, parts, -1) if have else None
            stamp = np.frombuffer(raw["stamp"], np.uint8).reshape(n, parts, -1) if have else None
            code, error = np.empty((n, parts), "<i4"), np.zeros(n, np.int64)
            lows, stamps = np.empty((n, parts, len(starts)), "<f4"), np.empty((n, parts, len(starts)), np.uint8)
            for p in range(parts):
                old = (own[:, p], low[:, p].astype(float), stamp[:, p]) if have else (None, None, None)
                code[:, p], lows[:, p], stamps[:, p], d, s = reassign(flat[:, p].astype(exact), *old, books[p].astype(exact), starts)
                error += d
                scans += int(s)
                np.add.at(sums[p], code[:, p], flat[:, p])
                counts[p] += np.bincount(code[:, p], minlength=entries)
            binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield rows(n, kind=pa.array(np.zeros(n, np.int32)), id=b.column("id"), label=b.column("label"), v=b.column("v"),
                       code=binary(code), low=binary(lows), stamp=binary(stamps), error=pa.array(error))
        if kind_of_label is not None:
            p, e = np.nonzero(counts)
            if len(p):
                spent = np.zeros(len(p), np.int64)
                spent[0] = scans
                yield rows(len(p), kind=pa.array(np.ones(len(p), np.int32)), part=pa.array(p.astype(np.int32)), entry=pa.array(e.astype(np.int32)),
                           n=pa.array(counts[p, e]), sums=pa.array(list(sums[p, e]), pa.list_(pa.int64())), scans=pa.array(spent))

    return arrow_map(state, job, schema)


def fit(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, groups: int = 16, scale: int = 1024,
        id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"):
    """(rows, history, scans): coded rows (id, label, v, code as little-endian 32-bit indexes, error),
    the codebooks of every round as arrays (part, entry, position), and the number of (row, part,
    group of entries) scanned in each pass.

    The first entries are the parts of the ``entries`` smallest ids (null ids last, rows of equal id
    by vector); with fewer rows there are fewer entries. Rows with a null vector, or null or
    non-finite components, are left out. Repeated rows count each. Shorter vectors are filled with
    zeros. No row at all: no codebook."""
    base = written(integer_vectors(vectors, parts, scale, id_col, vec_col, label_col), "codes")
    first = base.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return base.select("id", "label", "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), [], []
    book = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    history, scans, state = [book], [], base
    for step in range(rounds + 1):
        state = written(_pass(state, history, groups), "codes")
        sums = state.where("kind = 1").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.sum("scans").alias("scans"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(book.shape[2])])
        moved, spent = history[-1].copy(), 0
        for r in sums.collect():  # a row an entry
            spent += r.scans
            moved[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(book.shape[2])]
        scans.append(spent)
        state = state.where("kind = 0").select("id", "label", "v", "code", "low", "stamp", "error")
        if step < rounds:
            history.append(moved)
    return state.select("id", "label", "v", "code", "error"), history, scans


def codes(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, scale: int = 1024,
          id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (hex indexes in part order), error, label_error (over rows of equal label, nulls
    together), codebooks_sha256: a row for each vector ``fit`` keeps. No rows, no result rows."""
    rows, history, _ = fit(vectors, entries, parts, rounds, scale=scale, id_col=id_col, vec_col=vec_col, label_col=label_col)
    digest = hashlib.sha256(",".join(map(str, history[-1].ravel().tolist())).encode()).hexdigest() if history else None
    digits = max(2, len(f"{max(entries - 1, 0):x}"))
    index = lambda p: F.conv(F.hex(F.reverse(F.substring("code", 4 * p + 1, 4))), 16, 16)
    rows = rows.select("id", "label", "error", "code")
    by_label = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "codes")
    text = F.concat(*[F.lower(F.lpad(index(p), digits, "0")) for p in range(parts)])
    out = join_side(rows, by_label, "label")
    return out.select(F.col("id").alias("vec_id"), text.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-part, 256-entry codes of all vectors after 4 rounds."""
    return codes(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = 4, entries: int = 256, parts: int = 4, scale: int = 1024) -> str:
    """The same by scanning every entry (all vectors of one width)."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT x.rid, x.p, b.e, (x.xx - 2 * list_inner_product(x.x, b.x) + list_inner_product(b.x, b.x))::BIGINT AS d
         FROM parts x JOIN b{r} b USING (p)),
a{r} AS MATERIALIZED (SELECT rid, p, m[2] AS e, m[1] AS d FROM (SELECT rid, p, min([d, e]) AS m FROM d{r} GROUP BY rid, p))""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT p, e, list(floor(s / n)::DOUBLE ORDER BY j) AS x FROM (
           SELECT x.p, a.e, j, sum(x.x[j]) AS s, count(*) AS n
           FROM parts x JOIN a{r} a USING (rid, p), unnest(range(1, len(x.x) + 1)) u(j) GROUP BY x.p, a.e, j) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (p, e))""")
    return f"""
WITH k AS (SELECT vec_id, label, [floor({scale} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid FROM k),
c AS (SELECT rid, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM n, unnest(range({parts})) u(p)),
parts AS MATERIALIZED (SELECT rid, p, x, list_inner_product(x, x) AS xx FROM c),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM parts WHERE rid <= {entries}),{",".join(steps)},
r AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid),
h AS (SELECT sha256(string_agg(x, ',' ORDER BY p, e)) AS codebooks_sha256
      FROM (SELECT p, e, array_to_string([z::BIGINT FOR z IN x], ',') AS x FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM n JOIN r USING (rid), h
"""


OP11_SQL = _sql()
