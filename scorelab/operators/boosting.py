"""Boosted stumps (SAMME with trees of depth 1) of many models in one pass.

Features are binned once to one byte. Every round one aggregate gives, for every dataset and every
model (rate, held-out fold), the weighted class sums of each feature's bins; from them come the best
stump (smallest weighted Gini impurity, ties to the first feature and bin), its error and its weight, so a
round is one job however many models there are. A stump asks one feature, so the log of a row's weight is a sum
over its features of what all stumps gave its bin there: a model's state is one number a bin and class, which travels
with the pass, and nothing is written between rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from scorelab.operators import passes


class Model(NamedTuple):
    rounds: int
    rate: float
    held: int = -2  # rows of this fold are not used


class Stump(NamedTuple):
    alpha: float
    feature: int
    bin: int  # codes up to this one go left
    left: int  # the class of the left side
    right: int


def best_stump(sums: np.ndarray, layout: passes.Layout) -> tuple[int, int, float, float, float, float]:
    """(feature, bin, left class sums, right class sums) of the split of (cell, class) sums with the least
    weighted Gini impurity. Without a split that parts the weight, all goes left."""
    left, right, total = layout.sides(sums)
    lw, rw = left.sum(1), right.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        impurity = left.prod(1) / lw + right.prod(1) / rw
    weight = max(float(total.sum()), 1e-300)
    impurity[(lw <= 1e-12 * weight) | (rw <= 1e-12 * weight)] = np.inf
    best = int(np.argmin(np.round(impurity / weight, 12)))  # sums in another order may differ in the last digits
    if not np.isfinite(impurity[best]):
        return 0, 255, float(total[0]), float(total[1]), 0.0, 0.0
    return int(layout.feature[best]), int(layout.bin[best]), *left[best].tolist(), *right[best].tolist()


def _learn(stump: Stump, layout: passes.Layout, logs: np.ndarray) -> None:
    """Adds a stump to the log weights of one model: a number a (cell, class)."""
    by, first, bins = logs.reshape(-1, 2), int(layout.starts[stump.feature]), int(layout.bins[stump.feature])
    cut = first + min(stump.bin + 1, bins)
    by[first:cut, 1 - stump.left] += stump.alpha
    by[cut : first + bins, 1 - stump.right] += stump.alpha


class Packing:
    """Features of few bins taken together: a row has one place for all features of a group, whose joint bins are at
    most ``MOST``."""

    MOST, AXES = 512, 16

    def __init__(self, layout: passes.Layout):
        self.layout, self.groups, size = layout, [], 0
        for j in np.argsort(layout.bins, kind="stable").tolist():
            bins = int(layout.bins[j])
            if self.groups and size * bins <= self.MOST and len(self.groups[-1]) < self.AXES:
                self.groups[-1].append(j)
                size *= bins
            else:
                self.groups.append([j])
                size = bins
        self.shapes = [[int(layout.bins[j]) for j in group] for group in self.groups]
        self.sizes = [2 * int(np.prod(shape)) for shape in self.shapes]

    def cells(self, codes: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """The rows' places (joint bin, class) in every group, for (feature, row) codes."""
        out = []
        for group, shape in zip(self.groups, self.shapes, strict=True):
            at = codes[group[0]].astype(np.intp)
            for j, bins in zip(group[1:], shape[1:], strict=True):
                at = at * bins + codes[j]
            out.append(at * 2 + y)
        return out

    def _own(self, flat: np.ndarray, j: int) -> np.ndarray:
        return flat.reshape(-1, 2)[self.layout.starts[j] : self.layout.starts[j] + self.layout.bins[j]]

    def joint(self, logs: np.ndarray) -> list[np.ndarray | None]:
        """A model's log weights by the places of every group; None where they are all 0."""
        out: list[np.ndarray | None] = []
        for group, shape in zip(self.groups, self.shapes, strict=True):
            table = np.zeros([*shape, 2])
            for axis, j in enumerate(group):
                table += self._own(logs, j).reshape([n if a == axis else 1 for a, n in enumerate(shape)] + [2])
            out.append(table.ravel() if table.any() else None)
        return out

    def apart(self, sums: Sequence[np.ndarray]) -> np.ndarray:
        """Sums by the places of every group as those of every feature's (bin, class)."""
        out = np.zeros(2 * self.layout.width)
        for group, shape, s in zip(self.groups, self.shapes, sums, strict=True):
            for axis, j in enumerate(group):
                self._own(out, j)[:] = s.reshape([*shape, 2]).sum(axis=tuple(a for a in range(len(shape)) if a != axis))
        return out


def _weights(tables: Sequence[np.ndarray | None], scale: float, cells: Sequence[np.ndarray]) -> np.ndarray:
    """The rows' weights: the log of a row's is ``scale`` and what each group has at its place, whatever the number of stumps."""
    total = np.full(len(cells[0]), scale)
    got = np.empty(len(total))
    for table, cell in zip(tables, cells, strict=True):
        if table is not None:
            total += table.take(cell, mode="clip", out=got)
    return np.exp(total, out=total)


def _apply(rounds: Sequence[Sequence[tuple[Stump | None, float]]], y: np.ndarray, codes: np.ndarray, w: np.ndarray) -> None:
    """The rounds' stumps (and scales) on the weights, in place. ``codes``: (feature, row), ``w``: (model, row)."""
    layout = passes.Layout([np.zeros(passes.MOST_BINS - 1)] * len(codes))
    packing = Packing(layout)
    for m in range(len(w)):
        logs, scale = np.zeros(2 * layout.width), 0.0
        for stumps in rounds:
            if stumps[m][0] is not None:
                _learn(stumps[m][0], layout, logs)
                scale += math.log(stumps[m][1])
        w[m] *= _weights(packing.joint(logs), scale, packing.cells(codes, y))


def fit_stumps(rows: DataFrame, models: Sequence[Model], rewrite: int = 0) -> tuple[dict[str, list[list[Stump]]], dict[str, list[np.ndarray]]]:
    """(paths, cuts): for each dataset and model its stumps in order, and the datasets' thresholds. The
    first n stumps are the fit with n rounds. A fit ends early when a stump errs on half the
    weight or more (it is left out) or on none. ``rows`` as from ``passes.model_rows``. Nothing is written between
    rounds, so ``rewrite`` is not used."""
    cuts = passes.cut_points(rows)
    names = sorted(cuts)
    held = [m.held for m in models]
    table = passes.blocks(rows, lambda g, x: passes.codes_of(x, cuts[g]), lambda g, fold: np.zeros((len(fold), 0)), spread=True)
    paths: dict[str, list[list[Stump]]] = {g: [[] for _ in models] for g in names}
    open_ = {(g, m) for g in names for m in range(len(models)) if models[m].rounds > 0}
    tasks, layouts = table.rdd.getNumPartitions(), {g: passes.Layout(cuts[g]) for g in names}
    logs = {k: np.zeros(2 * layouts[k[0]].width) for k in open_}  # log weights of each model's (cell, class)
    scale = dict.fromkeys(open_, 0.0)  # what makes the weights sum to about 1, as a log
    while open_:
        parts = table.mapInArrow(_sums({k: logs[k] for k in open_}, {k: scale[k] for k in open_}, held, layouts), passes.PARTS)
        best = passes.summed(parts, len(open_), 2 * max(x.width for x in layouts.values()), tasks, _finish(layouts))
        for g, m, feature, cut, l0, l1, r0, r1 in best:  # a row a model
            left, right = int(l1 > l0), int(r1 > r0)
            total, wrong = l0 + l1 + r0 + r1, (l0 if left else l1) + (r0 if right else r1)
            error = wrong / total if total > 0 else 1.0
            if error >= 0.5:
                open_.discard((g, m))
                continue
            alpha = models[m].rate * math.log((1.0 - max(error, 1e-12)) / max(error, 1e-12))
            stump = Stump(alpha, feature, cut, left, right)
            paths[g][m].append(stump)
            _learn(stump, layouts[g], logs[g, m])
            scale[g, m] -= math.log(total)
            if error <= 1e-12 or len(paths[g][m]) >= models[m].rounds:
                open_.discard((g, m))
    return paths, cuts


def _finish(layouts: dict[str, passes.Layout]):
    return lambda g, model, node, sums: [(g, model, *best_stump(sums.reshape(-1, 2), layouts[g]))]


def _sums(logs: dict[tuple[str, int], np.ndarray], scale: dict[tuple[str, int], float], held: Sequence[int], layouts: dict[str, passes.Layout]):
    def job(batches: Iterator[pa.RecordBatch]):
        packed = {g: Packing(layouts[g]) for g in {g for g, _ in logs}}
        tables = {k: packed[k[0]].joint(v) for k, v in logs.items()}
        sums: dict[tuple[str, int], list[np.ndarray]] = {}
        for b in batches:
            for block in passes.opened(b):
                g = block.g
                if g not in packed:
                    continue
                cells = packed[g].cells(np.ascontiguousarray(block.data.T), block.y)
                for m in range(len(held)):
                    if (g, m) not in logs:
                        continue
                    w = _weights(tables[g, m], scale[g, m], cells)
                    w *= block.fold != held[m]
                    into = sums.setdefault((g, m), [np.zeros(size) for size in packed[g].sizes])
                    for total, cell in zip(into, cells, strict=True):
                        total += np.bincount(cell, w, len(total))
        if sums:
            yield passes.part_rows({(g, m, 0): packed[g].apart(s) for (g, m), s in sums.items()}, TaskContext.get().partitionId())

    return job


def margins(codes: np.ndarray, path: Sequence[Stump], ns: Sequence[int]) -> np.ndarray:
    """(row, n): sum alpha h / sum alpha over the first n stumps, h in {-1, +1}; 0 without stumps."""
    out = np.zeros((len(codes), len(ns)))
    if path:
        feature, cut = np.array([s.feature for s in path]), np.array([s.bin for s in path])
        alpha, left, right = np.array([s.alpha for s in path]), np.array([s.left for s in path]), np.array([s.right for s in path])
        total = np.cumsum(alpha)
        at = np.minimum(np.array(ns), len(path)) - 1
        for a in range(0, len(codes), 500):
            side = codes[a : a + 500][:, feature] <= cut
            votes = np.cumsum(alpha * (2 * np.where(side, left, right) - 1), axis=1)
            out[a : a + 500] = np.where(at >= 0, votes[:, at] / total[at], 0.0)
    return out


def evaluator(paths: dict[str, list[list[Stump]]], cuts: dict[str, list[np.ndarray]], points: Sequence[tuple[int, int]]) -> passes.Evaluate:
    """Log odds (twice the decision value) of the (model, n) of ``points``."""

    def evaluate(g: str, x: np.ndarray, which: Sequence[int]) -> np.ndarray:
        codes, out = passes.codes_of(x, cuts[g]), np.zeros((len(x), len(which)))
        for m in {points[i][0] for i in which}:
            cols = [k for k, i in enumerate(which) if points[i][0] == m]
            out[:, cols] = 2.0 * margins(codes, paths[g][m], [points[which[k]][1] for k in cols])
        return out

    return evaluate
