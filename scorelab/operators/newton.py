"""Second-order boosted trees of many models in one pass.

Each tree is grown on the gradients and Hessians of the log loss. A pass gives, for every dataset and
every model, the sums of gradient, Hessian and rows by (node, feature, bin) of the nodes that model
wants to know next; models need not be at the same tree or level. A split gains
GL^2/(HL+c) + GR^2/(HR+c) - G^2/(H+c) and a leaf is worth -G/(H+c) times the rate.

Two ways to grow: by level to a depth (every node with a gain is split), or by leaf, where the open leaf
with the largest gain is split next until there are enough leaves. By leaf, a pass looks at the children of all
leaves that can still be chosen, at most as many as splits are left, so a tree takes about as many passes
as it is deep and still is the tree of one split at a time.

A dataset whose codes are at most ``ONE_TASK`` bytes needs no passes: a task a model holds its rows and grows all trees by
the same steps, a node's sums taken over its own rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.operators import passes


class Model(NamedTuple):
    rounds: int
    rate: float
    held: int = -2  # rows of this fold are not used
    depth: int = 6  # 0: no limit
    leaves: int = 0  # 0: by level, else by leaf
    penalty: float = 1.0
    least_hessian: float = 1.0
    least_rows: int = 1


#: The defaults of the two learners that the groups are named after.
BY_LEVEL = {"depth": 6, "leaves": 0, "penalty": 1.0, "least_hessian": 1.0, "least_rows": 1}
BY_LEAF = {"depth": 0, "leaves": 31, "penalty": 0.0, "least_hessian": 1e-3, "least_rows": 20}


@dataclass
class Tree:
    """Nodes as columns; ``feature`` -1 is a leaf. ``value`` is what a row that ends there gets; ``cover``
    its Hessian sum, ``rows`` its row count."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def grow(self, node: int, feature: int, bin_: int) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, bin_, a, a + 1
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.cover, 0.0), (self.rows, 0)):
            column += [empty, empty]
        return a, a + 1

    def ends(self, codes: np.ndarray) -> np.ndarray:
        """The node where each row ends."""
        return Router(self).ends(columns_of(codes))


def columns_of(codes: np.ndarray) -> np.ndarray:
    """(feature, row) of (row, feature) codes, each feature's in one piece and fit to look up."""
    return np.ascontiguousarray(codes.T).astype(np.intp)


#: Multiplied by a power of two, the top six bits tell which power it was.
_PROBE = np.uint64(0x03F79D71B4CB0A89)
_POWER = np.zeros(64, np.intp)
_POWER[((np.uint64(1) << np.arange(64, dtype=np.uint64)) * _PROBE >> np.uint64(58)).astype(np.intp)] = np.arange(64)


class Router:
    """Where rows end, without a walk: each code of a feature has a word of the leaves it may lead to, a bit a
    leaf, and the words of a row's codes have one bit in common. 64 leaves a word, as many words as it takes."""

    def __init__(self, tree: Tree):
        leaves, ranges, todo = [], [], [(0, {})]
        while todo:
            n, inside = todo.pop()
            f = tree.feature[n]
            if f < 0:
                leaves.append(n)
                ranges.append(inside)
                continue
            lo, hi = inside.get(f, (-1, 255))  # codes above lo, up to hi
            todo.append((tree.left[n], inside | {f: (lo, min(hi, tree.bin[n]))}))
            todo.append((tree.right[n], inside | {f: (max(lo, tree.bin[n]), hi)}))
        self.words = []
        for first in range(0, len(leaves), 64):
            some = ranges[first : first + 64]
            tables = {f: np.full(256, (1 << len(some)) - 1, np.uint64) for f in {f for r in some for f in r}}
            for i, r in enumerate(some):
                for f, (lo, hi) in r.items():
                    without = ~(np.uint64(1) << np.uint64(i))
                    tables[f][: lo + 1] &= without
                    tables[f][hi + 1 :] &= without
            place = np.zeros(64, np.int64)
            place[: len(some)] = leaves[first : first + 64]
            self.words.append((tables, place[_POWER]))

    def ends(self, columns: np.ndarray) -> np.ndarray:
        """The node where each row ends, for codes as from ``columns_of``."""
        node = np.zeros(columns.shape[1], np.int64)
        for tables, place in self.words:
            word = None
            for f, table in tables.items():
                got = table.take(columns[f], mode="clip")  # within the table anyway, and faster than a check
                word = got if word is None else np.bitwise_and(word, got, out=word)
            if word is None:  # one leaf
                continue
            at = place.take((word * _PROBE >> np.uint64(58)).astype(np.intp), mode="clip")
            node = at if len(self.words) == 1 else np.where(word != 0, at, node)
        return node


class Split(NamedTuple):
    gain: float
    feature: int
    bin: int
    left: tuple[float, float, float]  # gradient, Hessian, rows
    right: tuple[float, float, float]


def best_split(sums: np.ndarray, layout: passes.Layout, model: Model) -> Split | None:
    """The split of (cell, 3) sums with the largest gain above 0; ties to the first feature and bin."""
    left, right, total = layout.sides(sums)
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + model.penalty)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = worth(left) + worth(right) - worth(total)
    bad = ~np.isfinite(gain)
    for side in (left, right):
        bad |= (side[:, 2] < max(model.least_rows, 1) - 1e-6) | (side[:, 1] < model.least_hessian - 1e-12)
    gain[bad] = -np.inf
    best = int(np.argmax(np.round(gain, 9)))  # sums in another order may differ in the last digits
    if not gain[best] > 1e-9:
        return None
    return Split(float(gain[best]), int(layout.feature[best]), int(layout.bin[best]), tuple(left[best].tolist()), tuple(right[best].tolist()))


#: Bytes of a dataset's codes, with what a row takes beside them, that one task holds.
ONE_TASK, _ROW = 64 << 20, 32


class Grower:
    """One model's next tree. ``wanted()``: the nodes whose sums it needs next, as the node numbers of
    ``tree``; ``learn`` takes their best splits; ``done`` when the tree stands.

    By leaf, ``tree`` holds every node looked at so far, chosen or not, and is cut back to the chosen ones
    at the end."""

    def __init__(self, model: Model):
        self.model, self.tree = model, Tree()
        self.stats: dict[int, tuple[float, float, float]] = {}
        self.splits: dict[int, Split | None] = {}
        self.depth_of = {0: 0}
        self.next = [0]
        self.chosen: set[int] = set()
        self.done = False

    def wanted(self) -> list[int]:
        return self.next

    def learn(self, found: dict[int, tuple[tuple[float, float, float], Split | None]]) -> None:
        for node in self.next:
            stats, split = found.get(node, ((0.0, 0.0, 0.0), None))
            self.stats[node] = stats
            self.splits[node] = None if self.model.depth and self.depth_of[node] >= self.model.depth else split
        if self.model.leaves:
            self._by_leaf()
        else:
            self._open([n for n in self.next if self.splits[n]])
            if self.model.depth and self.next and self.depth_of[self.next[0]] >= self.model.depth:
                self.next = []  # the last level's sums are known from its parents' splits
            self.done = not self.next
        if self.done:
            self._finish()

    def _open(self, nodes: list[int]) -> None:
        self.next = []
        for n in nodes:
            s = self.splits[n]
            a, b = self.tree.grow(n, s.feature, s.bin)
            self.depth_of[a] = self.depth_of[b] = self.depth_of[n] + 1
            self.stats[a], self.stats[b] = s.left, s.right
            self.next += [a, b]
            self.chosen.add(n)

    def _by_leaf(self) -> None:
        """Split the best open leaf while all open leaves are known; else look at more children."""
        chosen, leaves = set(), 1
        heap = [(-self.splits[0].gain, 0)] if self.splits[0] else []
        unknown = False
        while heap and leaves < self.model.leaves:
            _, n = heapq.heappop(heap)
            chosen.add(n)
            leaves += 1
            if self.tree.feature[n] < 0 and leaves == self.model.leaves:
                self._open([n])  # the last split: nobody asks for its children
            elif self.tree.feature[n] < 0:  # its children were never looked at
                unknown = True
                heapq.heappush(heap, (-self.splits[n].gain, n))
                chosen.discard(n)
                leaves -= 1
                break
            for child in (self.tree.left[n], self.tree.right[n]):
                if self.splits.get(child):
                    heapq.heappush(heap, (-self.splits[child].gain, child))
        if not unknown:
            self.chosen, self.done, self.next = chosen, True, []
            return
        # of the open leaves only as many as splits are left can still be chosen
        ahead = [n for _, n in heapq.nsmallest(self.model.leaves - leaves, heap) if self.tree.feature[n] < 0]
        self._open(ahead)

    def _finish(self) -> None:
        t, c = self.tree, self.model.penalty
        if self.model.leaves:  # keep the chosen splits only
            new, at = Tree(), {0: 0}
            todo = [0]
            while todo:
                n = todo.pop()
                if n in self.chosen:
                    a, b = new.grow(at[n], t.feature[n], t.bin[n])
                    for child, place in ((t.left[n], a), (t.right[n], b)):
                        at[child] = place
                        todo.append(child)
            stats = {at[n]: s for n, s in self.stats.items() if n in at}
            self.tree = t = new
        else:
            stats = self.stats
        for n, (g, h, k) in stats.items():
            t.cover[n], t.rows[n] = h, int(round(k))
            t.value[n] = -self.model.rate * g / (h + c) if t.feature[n] < 0 and h + c > 0 else 0.0


class Fit(NamedTuple):
    start: float  # the log odds all rows begin with
    trees: list[Tree]


def fit_trees(rows: DataFrame, models: Sequence[Model], rewrite: int = 10) -> tuple[dict[str, list[Fit]], dict[str, list[np.ndarray]]]:
    """(fits, cuts): the boosted trees of every dataset and model. The first n trees are the fit with n
    rounds. Rows as from ``passes.model_rows``; the start is the log odds of the rows a model sees."""
    cuts = passes.cut_points(rows)
    counts = {(r.g, r.fold): (r.n, r.p) for r in rows.groupBy("g", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()}
    names = sorted(cuts)
    start = {g: np.array([_log_odds([v for (name, f), v in counts.items() if name == g and f != m.held]) for m in models]) for g in names}
    table = passes.blocks(rows, lambda g, x: passes.codes_of(x, cuts[g]), lambda g, fold: np.repeat(start[g][None], len(fold), axis=0), spread=True)
    tasks, layouts = table.rdd.getNumPartitions(), {g: passes.Layout(cuts[g]) for g in names}
    fits = {g: [Fit(float(start[g][m]), []) for m in range(len(models))] for g in names}
    sizes = {g: sum(n for (name, _), (n, _) in counts.items() if name == g) * (len(cuts[g]) + _ROW) for g in names}
    alone = [(g, m) for g in names for m in range(len(models)) if sizes[g] <= ONE_TASK and models[m].rounds > 0]
    for (g, m), trees in _in_one_task(table, alone, list(models), start, layouts):
        fits[g][m].trees.extend(trees)
    growing = {(g, m): Grower(models[m]) for g in names for m in range(len(models)) if sizes[g] > ONE_TASK and models[m].rounds > 0}
    pending: dict[tuple[str, int], list[Tree]] = {}
    while growing:
        if max(map(len, pending.values()), default=0) >= rewrite:
            table = passes.restated(table, _steps(pending))
            pending = {}
        wanted = {k: (w.tree, w.wanted()) for k, w in growing.items()}
        parts = table.mapInArrow(_sums(dict(pending), wanted, [m.held for m in models], layouts), passes.PARTS)
        asked = sum(len(nodes) for _, nodes in wanted.values())
        found: dict[tuple[str, int], dict] = {}
        for g, m, node, total, split in passes.summed(parts, asked, 3 * max(x.width for x in layouts.values()), tasks, _finish(list(models), layouts)):
            found.setdefault((g, m), {})[node] = (total, split)  # a row a node that was asked for
        for key, grower in list(growing.items()):
            grower.learn(found.get(key, {}))
            if grower.done:
                g, m = key
                fits[g][m].trees.append(grower.tree)
                pending.setdefault(key, []).append(grower.tree)
                if len(fits[g][m].trees) >= models[m].rounds:
                    del growing[key]
                else:
                    growing[key] = Grower(models[m])
    return fits, cuts


def _in_one_task(table: DataFrame, keys: list[tuple[str, int]], models: list[Model], start: dict[str, np.ndarray], layouts: dict[str, passes.Layout]) -> list[tuple[tuple[str, int], list[Tree]]]:
    """The trees of the (dataset, model) ``keys``, each grown by a task that holds the dataset's rows."""
    if not keys:
        return []

    def job(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list[passes.Block]] = {}
        for b in batches:
            at = b.schema.get_field_index("k")
            for i, block in enumerate(passes.opened(b)):
                held.setdefault(b.column(at)[i].as_py(), []).append(block)
        for k in sorted(held):
            (g, m), some = keys[k], held.pop(k)
            use = [block.fold != models[m].held for block in some]
            codes = np.concatenate([block.data[u] for block, u in zip(some, use, strict=True)])
            y = np.concatenate([block.y[u] for block, u in zip(some, use, strict=True)])
            del some
            trees = boosted(codes, y, float(start[g][m]), models[m], layouts[g])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps(trees)], pa.binary())], names=["k", "trees"])

    number = [F.lit(k) for k in range(len(keys))]
    of = {g: F.array(*[n for (name, _), n in zip(keys, number, strict=True) if name == g]) for g in {g for g, _ in keys}}
    bare = table.where(F.col("g").isin(list(of))).withColumn("state", F.lit(b""))
    dealt = bare.withColumn("k", F.explode(F.coalesce(*[F.when(F.col("g") == g, some) for g, some in of.items()]))).repartitionByRange(len(keys), "k")
    return [(keys[r.k], pickle.loads(r.trees)) for r in passes.arrow_job(dealt, job, "k int, trees binary").collect()]  # a row a model


def boosted(codes: np.ndarray, y: np.ndarray, start: float, model: Model, layout: passes.Layout) -> list[Tree]:
    """The trees of one model over (row, feature) ``codes`` that are all at hand."""
    columns, narrow = columns_of(codes), np.ascontiguousarray(codes.T)
    f, trees, every = np.full(len(y), start), [], np.arange(len(y), dtype=np.int32)
    while len(trees) < model.rounds:
        p = 1.0 / (1.0 + np.exp(-f))
        gradient, hessian = p - y, p * (1 - p)
        grower, rows = Grower(model), {0: every}
        while not grower.done:
            tree, found = grower.tree, {}
            for n in [n for n, feature in enumerate(tree.feature) if feature >= 0 and n in rows]:
                mine = rows.pop(n)
                left = narrow[tree.feature[n]].take(mine) <= tree.bin[n]
                rows[tree.left[n]], rows[tree.right[n]] = mine[left], mine[~left]
            for n in grower.wanted():
                mine, sums = rows[n], np.empty((layout.width, 3))
                if not len(mine):
                    continue
                whole = len(mine) == len(y)
                g, h = (gradient, hessian) if whole else (gradient.take(mine), hessian.take(mine))
                for first, bins, column in zip(layout.starts, layout.bins, columns, strict=True):
                    at = column if whole else column.take(mine)
                    for channel, v in enumerate((g, h, None)):
                        sums[first : first + bins, channel] = np.bincount(at, v, bins)
                found[n] = (tuple(layout.sides(sums)[2].tolist()), best_split(sums, layout, model))
            grower.learn(found)
        trees.append(grower.tree)
        f += np.array(grower.tree.value).take(Router(grower.tree).ends(columns), mode="clip")
    return trees


def _log_odds(counts: list[tuple[int, int]]) -> float:
    n, p = sum(c[0] for c in counts), sum(c[1] for c in counts)
    return float(np.log((p + 1e-9) / (n - p + 1e-9))) if n else 0.0


def _finish(models: list[Model], layouts: dict[str, passes.Layout]):
    def finish(g: str, m: int, node: int, sums: np.ndarray) -> list[tuple]:
        sums = sums.reshape(-1, 3)
        return [(g, m, node, tuple(layouts[g].sides(sums)[2].tolist()), best_split(sums, layouts[g], models[m]))]

    return finish


def _steps(pending: dict[tuple[str, int], list[Tree]]):
    routers: dict[tuple[str, int], list[tuple[Router, np.ndarray]]] = {}  # made by the task that needs them

    def step(block: passes.Block, columns: np.ndarray | None = None) -> None:
        for m in range(block.state.shape[1]):
            key = (block.g, m)
            if key not in pending:
                continue
            if key not in routers:
                routers[key] = [(Router(t), np.array(t.value)) for t in pending[key]]
            columns = columns_of(block.data) if columns is None else columns
            for router, value in routers[key]:
                block.state[:, m] += value.take(router.ends(columns), mode="clip")

    return step


def _sums(pending: dict, wanted: dict[tuple[str, int], tuple[Tree, list[int]]], held: list[int], layouts: dict[str, passes.Layout]):
    step = _steps(pending)

    def job(batches: Iterator[pa.RecordBatch]):
        routers = {k: Router(tree) for k, (tree, _) in wanted.items()}
        sums: dict[tuple[str, int], np.ndarray] = {}  # (gradient, Hessian, rows) of (node, cell)
        for b in batches:
            for block in passes.opened(b):
                g, y, fold, f, layout = block.g, block.y, block.fold, block.state, layouts[block.g]
                columns = columns_of(block.data)
                step(block, columns)
                for m in range(f.shape[1]):
                    if (g, m) not in wanted:
                        continue
                    tree, nodes = wanted[g, m]
                    k = len(nodes)
                    place = np.full(len(tree.feature), -1)
                    place[nodes] = np.arange(k)
                    at = place.take(routers[g, m].ends(columns))
                    use = np.flatnonzero((at >= 0) & (fold != held[m]))
                    if not len(use):
                        continue
                    every = len(use) == len(at)
                    only = lambda v, use=use, every=every: v if every else v.take(use)
                    at, truth = only(at), only(y)
                    p = 1.0 / (1.0 + np.exp(-only(f[:, m])))
                    channels = (p - truth, p * (1 - p), None)
                    if (g, m) not in sums:
                        sums[g, m] = np.zeros((3, k, layout.width))
                    for j, (first, bins) in enumerate(zip(layout.starts, layout.bins, strict=True)):
                        where = at * bins + only(columns[j])
                        for channel, v in enumerate(channels):
                            sums[g, m][channel, :, first : first + bins] += np.bincount(where, v, k * bins).reshape(k, bins)
        met = {(g, m, wanted[g, m][1][i]): s[:, i].T.ravel() for (g, m), s in sums.items() for i in np.flatnonzero(s[2].any(axis=1))}
        if met:
            yield passes.part_rows(met, TaskContext.get().partitionId())

    return job


def margins(codes: np.ndarray, fit: Fit, ns: Sequence[int]) -> np.ndarray:
    """(row, n): log odds after the first n trees."""
    out, f, columns = np.zeros((len(codes), len(ns))), np.full(len(codes), fit.start), columns_of(codes)
    for k in range(max([0, *ns]) + 1):
        for i, n in enumerate(ns):
            if min(n, len(fit.trees)) == k:
                out[:, i] = f
        if k < len(fit.trees):
            f = f + np.array(fit.trees[k].value)[Router(fit.trees[k]).ends(columns)]
    return out


def evaluator(fits: dict[str, list[Fit]], cuts: dict[str, list[np.ndarray]], points: Sequence[tuple[int, int]]) -> passes.Evaluate:
    """Log odds of the (model, n) of ``points``."""

    def evaluate(g: str, x: np.ndarray, which: Sequence[int]) -> np.ndarray:
        codes, out = passes.codes_of(x, cuts[g]), np.zeros((len(x), len(which)))
        for m in {points[i][0] for i in which}:
            cols = [k for k, i in enumerate(which) if points[i][0] == m]
            out[:, cols] = margins(codes, fits[g][m], [points[which[k]][1] for k in cols])
        return out

    evaluate.fits, evaluate.cuts, evaluate.points = fits, cuts, list(points)  # type: ignore[attr-defined]
    return evaluate
