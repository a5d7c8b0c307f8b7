"""Fitting many models in one pass over the rows.

Iterative fits (boosting, networks) need sums over all rows again and again. Here the rows of all
datasets are one table (g, row_id, y, fold, x), every model of every dataset takes part in the same
pass, and a pass is two stages: each task adds up its rows' arrays, one packed array a key, and
arrays of equal key are added up along a tree of at most ``FAN`` at a time. So the number of jobs
follows the number of rounds, never the number of models or datasets, and what reaches the driver is a
row a key. A model held out of fold f sees rows of the other folds only, so the fits of a
cross-validation are models like any other.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.session import cut_lineage, ship_package

FAN = 64

#: Bytes of all tasks' sums that the driver may add up itself.
GATHERED = 16 << 20

PARTS = "g string, model int, node int, slot int, sums binary"


def arrow_job(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def model_rows(df: DataFrame, features: Sequence[str], y: str = "y", group: str | None = None, fold: Column | None = None,
               keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """(g, kept columns, y, fold, x): the form all passes read. A null feature counts as 0, as in the other
    trainers; without ``group`` all rows are one dataset, without ``fold`` all are in fold -1."""
    g = F.col(f"`{group}`").cast("string") if group else F.lit("")
    held = (F.lit(-1) if fold is None else fold).cast("int")
    return df.select(g.alias("g"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{y}`").cast("int").alias("y"), held.alias("fold"), vector(features).alias("x"))


def vector(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])


def summed(parts: DataFrame, keys: int, width: int, tasks: int, finish: Callable[[str, int, int, np.ndarray], list[tuple]]) -> list[tuple]:
    """``parts`` (g, model, node, slot, sums: packed doubles) with the arrays of equal (g, model, node)
    added up and turned into the rows that ``finish(g, model, node, sums)`` gives. There are at most
    ``keys`` keys of ``width`` numbers from each of ``tasks`` tasks: where all that is at most ``GATHERED`` bytes
    the driver adds it up, else tasks do, along a tree, and the driver gets the sums' rows alone."""
    if 8 * keys * width * tasks <= GATHERED:
        return _added(sorted(((r.g, r.model, r.node), r.slot, r.sums) for r in parts.collect()), finish)

    def job(last: bool):
        def run(batches: Iterator[pa.RecordBatch]):
            key, total = None, None

            def out():
                if last:
                    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(finish(*key[:3], total))], pa.binary())], names=["rows"])
                return part_rows({key[:3]: total}, key[3])

            for b in batches:
                cols = [b.column(i).to_pylist() for i in range(4)]
                for i, k in enumerate(zip(*cols, strict=True)):
                    if k != key:
                        if key is not None:
                            yield out()
                        key, total = k, np.zeros(len(b.column(4)[i].as_buffer()) // 8)
                    total += np.frombuffer(b.column(4)[i].as_buffer())
            if key is not None:
                yield out()

        return run

    names = ["g", "model", "node"]
    while True:
        last = tasks <= FAN
        slot = F.lit(0) if last else F.floor(F.col("slot") / FAN).cast("int")
        dealt = parts.withColumn("slot", slot).repartition(*names, "slot").sortWithinPartitions(*names, "slot").select(*names, "slot", "sums")
        if last:
            return [row for r in arrow_job(dealt, job(True), "rows binary").collect() for row in pickle.loads(r.rows)]
        parts, tasks = arrow_job(dealt, job(False), PARTS), -(-tasks // FAN)


def _added(rows: list[tuple[tuple, int, bytes]], finish) -> list[tuple]:
    sums: dict[tuple, np.ndarray] = {}
    for key, _, blob in rows:
        part = np.frombuffer(blob)
        sums[key] = sums[key] + part if key in sums else part
    return [row for key, total in sums.items() for row in finish(*key, total)]


def part_rows(sums: dict[tuple[str, int, int], np.ndarray], slot: int) -> pa.RecordBatch:
    """What one task passes on to ``summed``."""
    keys = list(sums)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()),
         pa.array([slot] * len(keys), pa.int32()), pa.array([np.ascontiguousarray(v, np.float64).tobytes() for v in sums.values()], pa.binary())],
        names=["g", "model", "node", "slot", "sums"])


# ---------------------------------------------------------------- binned features

MOST_BINS = 256


def cut_points(rows: DataFrame, most: int = MOST_BINS) -> dict[str, list[np.ndarray]]:
    """Thresholds of each feature of each dataset: midways between neighbouring distinct values, or, with
    more than ``most`` of them, between values at even ranks. One pass with partial aggregation; a
    value rarer than a quarter of a bin may share one with its neighbour."""
    probs = [i / (4.0 * most) for i in range(4 * most + 1)]
    long = rows.select("g", F.posexplode("x").alias("pos", "v")).where(~F.isnan("v"))
    got = long.groupBy("g", "pos").agg(F.percentile_approx("v", F.array(*map(F.lit, probs)), F.lit(100_000)).alias("q"))
    cuts: dict[str, list[np.ndarray]] = {}
    width = {r["g"]: r["d"] for r in rows.groupBy("g").agg(F.max(F.size("x")).alias("d")).collect()}
    for g, d in width.items():
        cuts[g] = [np.zeros(0) for _ in range(d)]
    for r in got.collect():  # a row a feature
        values = np.unique(np.array(r["q"], float))
        if len(values) > most:
            values = np.unique(np.array(r["q"], float)[np.linspace(0, 4 * most, most).astype(int)])
        cuts[r["g"]][r["pos"]] = (values[:-1] + values[1:]) / 2
    return cuts


class Layout:
    """The cells (feature, bin) of a dataset, one after the other, each feature with the bins it has."""

    def __init__(self, cuts: Sequence[np.ndarray]):
        bins = np.array([len(c) + 1 for c in cuts], np.int64)
        self.bins = bins
        self.starts = np.cumsum(bins) - bins
        self.feature = np.repeat(np.arange(len(bins)), bins)
        self.bin = np.arange(len(self.feature)) - self.starts[self.feature]
        self.width = len(self.feature)

    def sides(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, total) of a split after each cell, for (cell, channel) sums."""
        run = sums.cumsum(0)
        before = run[self.starts] - sums[self.starts]
        left = run - before[self.feature]
        total = left[self.starts[1] - 1] if len(self.starts) > 1 else left[-1]
        return left, total - left, total


def codes_of(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers: how many thresholds lie below each value (x <= threshold goes left)."""
    out = np.zeros(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], "left")
    return out


# ---------------------------------------------------------------- blocks of rows

BLOCK_ROWS = 8192
_BLOCK = "g string, n int, y binary, fold binary, u binary, data binary, state binary"
_NAMES = [f.split()[0] for f in _BLOCK.split(", ")]


class Block(NamedTuple):
    """Some rows of one dataset as arrays: classes, folds, hashes, data (codes or x) and state."""

    g: str
    y: np.ndarray
    fold: np.ndarray
    u: np.ndarray
    data: np.ndarray
    state: np.ndarray

    def packed(self) -> pa.RecordBatch:
        cells = [self.y.astype(np.int8), self.fold.astype(np.int32), self.u, self.data, self.state]
        cols = [pa.array([self.g], pa.string()), pa.array([len(self.y)], pa.int32()), *[pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells]]
        return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def blocks(rows: DataFrame, data: Callable[[str, np.ndarray], np.ndarray], state: Callable[[str, np.ndarray], np.ndarray], u: Column | None = None,
           spread: bool = False) -> DataFrame:
    """The rows as written blocks, which passes read without a Python object a row. ``data(g, x)`` is what is
    kept of x, ``state(g, fold)`` the first numbers of each row (a column a model), ``u`` a hash of the row. With
    ``spread`` the blocks are dealt evenly, a part a core, as a pass lasts as long as its longest task."""

    def block(g: str, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        n = t.num_rows
        fold = t["fold"].to_numpy()
        x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        return Block(g, t["y"].to_numpy(), fold, t["u"].to_numpy(), data(g, x), np.asarray(state(g, fold), np.float64)).packed()

    def job(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list[pa.RecordBatch]] = {}
        for b in batches:
            names = b.column("g").dictionary_encode()
            for i, g in enumerate(names.dictionary.to_pylist()):
                mine = b if len(names.dictionary) == 1 else b.filter(pc.equal(names.indices, i))
                held.setdefault(g, []).append(mine)
                if sum(p.num_rows for p in held[g]) >= BLOCK_ROWS:
                    yield block(g, held.pop(g))
        for g, parts in held.items():
            yield block(g, parts)

    made = arrow_job(rows.select("g", "y", "fold", "x", (F.lit(0).cast("long") if u is None else u).alias("u")), job, _BLOCK)
    return cut_lineage(made.repartition(rows.sparkSession.sparkContext.defaultParallelism) if spread else made)


def opened(batch: pa.RecordBatch, kind: str = "u1") -> Iterator[Block]:
    """The blocks of a batch; ``kind``: the type of their data."""
    for i in range(batch.num_rows):
        g, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
        y, fold, u, data, state = (np.frombuffer(batch.column(j)[i].as_buffer(), t) for j, t in ((2, "i1"), (3, "<i4"), (4, "<i8"), (5, kind), (6, "<f8")))
        yield Block(g, y.astype(np.int64), fold, u.view(np.uint64), data.reshape(n, -1), state.reshape(n, -1).copy())


def restated(table: DataFrame, step: Callable[[Block], None]) -> DataFrame:
    """The blocks with ``step(block)`` applied to their state in place, written."""

    def job(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for block in opened(b):
                step(block)
                yield block.packed()

    return cut_lineage(arrow_job(table, job, _BLOCK))


# ---------------------------------------------------------------- scoring

#: (dataset, x, which points) -> log odds, a column a point.
Evaluate = Callable[[str, np.ndarray, Sequence[int]], np.ndarray]


def value_column(evaluate: Evaluate, holds: Sequence[int], own_fold: bool = False):
    """A column function (g, x, fold) -> array<double>: the log odds of every point. ``holds``: the fold each
    point's model was held out of; with ``own_fold`` only the points held out of the row's own fold are
    worked out, the others are null."""

    @F.pandas_udf("array<double>")
    def values(g: pd.Series, x: pd.Series, fold: pd.Series) -> pd.Series:
        out = np.full((len(x), len(holds)), np.nan)
        for (name, f), at in pd.DataFrame({"g": g.to_numpy(), "f": fold.to_numpy() if own_fold else 0}).groupby(["g", "f"], sort=False).indices.items():
            which = [i for i, h in enumerate(holds) if not own_fold or h == f]
            if which:
                out[np.ix_(at, which)] = evaluate(name, np.stack(x.iloc[at].to_list()).astype(float), which)
        return pd.Series(np.where(np.isnan(out), None, out).tolist() if own_fold else list(out))

    return values
