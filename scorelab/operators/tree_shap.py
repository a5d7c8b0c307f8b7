"""Exact Shapley values and interactions of fitted trees.

A tree is a sum over its leaves. On the way to a leaf each feature that was asked has an interval
(lo, hi], a share z of the training rows that pass its splits (the product of the children's covers over
their parents'), and for a row a flag o, whether its value lies in the interval. With m features on
the way and a leaf worth v, the path-dependent Shapley value of feature j is

    v (o_j - z_j) * integral over t in [0, 1] of prod_{i != j} ((1 - t) z_i + t o_i),

as the integral of t^k (1 - t)^(m-1-k) is k! (m-1-k)! / m!. The integrand is a polynomial of degree m - 1,
so Gauss-Legendre nodes give it exactly; leaving out two features gives the interaction of the two. What a
row gets depends on its flags alone, so each leaf is worked out once for all flags there can be (``Lookup``), or
for the distinct flags of a block of rows where it has many features, and rows look it up.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.operators import passes


class Nodes(NamedTuple):
    """A tree as columns: ``feature`` -1 is a leaf, x <= ``threshold`` goes left; node 0 is the root."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray


class Leaf(NamedTuple):
    value: float
    features: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    share: np.ndarray


class Trees(NamedTuple):
    """Output = base + sum of the trees' leaf values."""

    base: float
    leaves: list[Leaf]

    def expected(self) -> float:
        return self.base + sum(leaf.value * float(np.prod(leaf.share)) for leaf in self.leaves)


def leaves_of(tree: Nodes, scale: float = 1.0) -> list[Leaf]:
    out, todo = [], [(0, {})]
    while todo:
        n, way = todo.pop()
        f = int(tree.feature[n])
        if f < 0:
            names = sorted(way)
            lo, hi, share = (np.array([way[j][i] for j in names], float) for i in range(3))
            out.append(Leaf(scale * float(tree.value[n]), np.array(names, int), lo, hi, share))
            continue
        t, cover = float(tree.threshold[n]), float(tree.cover[n])
        for child, left in ((int(tree.left[n]), True), (int(tree.right[n]), False)):
            lo, hi, share = way.get(f, (-np.inf, np.inf, 1.0))
            part = float(tree.cover[child]) / cover if cover > 0 else 0.0
            todo.append((child, way | {f: (lo, min(hi, t), share * part) if left else (max(lo, t), hi, share * part)}))
    return out


def trees_of(nodes: Sequence[Nodes], base: float = 0.0, scales: Sequence[float] | None = None) -> Trees:
    return Trees(base, [leaf for i, t in enumerate(nodes) for leaf in leaves_of(t, 1.0 if scales is None else scales[i])])


def newton_nodes(tree, cuts: Sequence[np.ndarray]) -> Nodes:
    """A tree of ``newton.fit_trees`` with thresholds in place of bins; the cover is the Hessian sum."""
    threshold = [float(cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bin, strict=True)]
    return Nodes(*(np.array(c) for c in (tree.feature, threshold, tree.left, tree.right, tree.value, tree.cover)))


def forest_nodes(tree, cuts: Sequence[np.ndarray]) -> Nodes:
    """A tree of ``forest.fit`` with thresholds in place of bins; the cover is the bag's row count."""
    threshold = np.array([float(cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(tree.feature.tolist(), tree.bin.tolist(), strict=True)])
    return Nodes(tree.feature.astype(int), threshold, tree.left, tree.left + 1, tree.share, tree.cover)


def saved_nodes(model, kind: str) -> tuple[list[Nodes], list[float]]:
    """The node tables and weights of a fitted Spark ML forest (``kind`` "forest": leaves are worth the share of
    class 1) or boosted trees ("boost": leaves are worth their prediction), from the table its writer saves.
    The cover is the row count."""
    from pyspark.sql import SparkSession

    from scorelab.session import ensure_checkpoint_dir

    spark = SparkSession.getActiveSession()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees/{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").toPandas()  # a row a node: the model itself
    out = []
    for _, t in rows.groupby("treeID", sort=True):
        place = {int(i): k for k, i in enumerate(t["id"])}
        leaf = (t["leftChild"] < 0).to_numpy()
        stats = t["impurityStats"].to_list()
        worth = [s[1] / max(sum(s), 1e-300) for s in stats] if kind == "forest" else t["prediction"].to_list()
        out.append(Nodes(
            np.array([-1 if e else s["featureIndex"] for e, s in zip(leaf, t["split"], strict=True)]),
            np.array([0.0 if e else s["leftCategoriesOrThreshold"][0] for e, s in zip(leaf, t["split"], strict=True)]),
            np.array([place.get(int(c), 0) for c in t["leftChild"]]), np.array([place.get(int(c), 0) for c in t["rightChild"]]),
            np.array(worth, float), t["rawCount"].to_numpy(float)))
    return out, [float(w) for w in model.treeWeights]


def _patterns(leaf: Leaf, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct flags, the rows' number among them)."""
    v = x[:, leaf.features]
    inside = (v > leaf.lo) & (v <= leaf.hi)
    bits = np.packbits(inside, axis=1)
    _, first, of = np.unique(bits, axis=0, return_index=True, return_inverse=True)
    return inside[first].astype(float), of.ravel()


def _factors(leaf: Leaf, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes' weights, factors (pattern, feature, node) of the integrand)."""
    t, w = np.polynomial.legendre.leggauss(max(1, (len(leaf.features) + 1) // 2))
    t, w = (t + 1) / 2, w / 2
    return w, leaf.share[None, :, None] * (1 - t) + flags[:, :, None] * t


#: (leaf, flags) -> (places, (pattern, place) numbers): what rows with these flags get, and where it is added.
Part = Callable[[Leaf, np.ndarray], tuple[Sequence[int], np.ndarray]]


def _values_part(leaf: Leaf, flags: np.ndarray) -> tuple[Sequence[int], np.ndarray]:
    w, f = _factors(leaf, flags)
    before, after = np.ones_like(f), np.ones_like(f)
    before[:, 1:] = np.cumprod(f[:, :-1], axis=1)
    after[:, :-1] = np.cumprod(f[:, :0:-1], axis=1)[:, ::-1]
    return leaf.features.tolist(), leaf.value * (flags - leaf.share) * ((before * after) @ w)


def _pairs_part(d: int) -> Part:
    """Half the interaction of every pair (i, j), i < j, of ``d`` features, in the order of the pairs."""
    place = {p: n for n, p in enumerate((i, j) for i in range(d) for j in range(i + 1, d))}

    def part(leaf: Leaf, flags: np.ndarray) -> tuple[Sequence[int], np.ndarray]:
        w, f = _factors(leaf, flags)
        gain, m = flags - leaf.share, len(leaf.features)
        two = [(a, b) for a in range(m) for b in range(a + 1, m)]
        rest = [np.delete(f, ab, axis=1).prod(1) @ w for ab in two]
        got = [0.5 * leaf.value * gain[:, a] * gain[:, b] * r for (a, b), r in zip(two, rest, strict=True)]
        return [place[int(leaf.features[a]), int(leaf.features[b])] for a, b in two], np.stack(got, axis=1)

    return part


class Lookup:
    """The sums over leaves of what ``part`` gives, ``width`` numbers a row. A feature's value is first its number among
    all thresholds of the trees; that number has a byte of flags for every leaf, and a leaf's bytes of all features
    add up to the row's place in the leaf's table. Leaves with fewer than ``least`` features give nothing."""

    MOST = 8  # features of a leaf that has a table
    CHUNK = 1024  # leaves at a time
    KEPT = 64 << 20  # bytes of tables that are kept between blocks of rows

    def __init__(self, trees: Trees, width: int, part: Part, least: int = 1):
        self.leaves = [leaf for leaf in trees.leaves if len(leaf.features) >= least]
        self.width, self.part = width, part
        ends: dict[int, set[float]] = {}
        for leaf in self.leaves:
            for j, lo, hi in zip(leaf.features.tolist(), leaf.lo.tolist(), leaf.hi.tolist(), strict=True):
                ends.setdefault(j, set()).update(v for v in (lo, hi) if np.isfinite(v))
        self.cuts = {j: np.array(sorted(v)) for j, v in ends.items()}
        self.kept: list | None = None

    def _tables(self) -> Iterator[tuple[list[Leaf], dict[int, np.ndarray], list]]:
        """Chunks of leaves with (number, leaf) bytes of each feature and each leaf's places and (place, flags) table."""
        for first in range(0, len(self.leaves), self.CHUNK):
            some = self.leaves[first : first + self.CHUNK]
            # the last number is that of values that lie in no interval: NaN and minus infinity
            flags = {j: np.zeros((len(c) + 2, len(some)), np.uint8) for j, c in self.cuts.items()}
            tables: list = []
            for n, leaf in enumerate(some):
                m = len(leaf.features)
                if m > self.MOST:
                    tables.append(None)
                    continue
                for k, (j, lo, hi) in enumerate(zip(leaf.features.tolist(), leaf.lo.tolist(), leaf.hi.tolist(), strict=True)):
                    cuts = self.cuts[j]
                    above = 0 if lo == -np.inf else int(np.searchsorted(cuts, lo)) + 1
                    upto = len(cuts) if hi == np.inf else int(np.searchsorted(cuts, hi))
                    flags[j][above : upto + 1, n] = 1 << k
                patterns = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
                places, numbers = self.part(leaf, patterns)
                tables.append((places, np.ascontiguousarray(numbers.T)))
            yield some, flags, tables

    def _chunks(self):
        if self.kept is not None:
            return self.kept
        size = sum(8 * len(leaf.features) ** 2 << min(len(leaf.features), self.MOST) for leaf in self.leaves) + len(self.leaves) * sum(len(c) + 2 for c in self.cuts.values())
        if size <= self.KEPT:
            self.kept = list(self._tables())
            return self.kept
        return self._tables()

    def sums(self, x: np.ndarray) -> np.ndarray:
        """(place, row)."""
        out, got = np.zeros((self.width, len(x))), np.empty(len(x))
        number = {j: np.where(x[:, j] > -np.inf, np.searchsorted(c, x[:, j]), len(c) + 1) for j, c in self.cuts.items()}
        for leaves, flags, tables in self._chunks():
            code = np.zeros((len(x), len(leaves)), np.uint8)
            for j, table in flags.items():
                code += table.take(number[j], axis=0, mode="clip")  # within the table anyway
            code = np.ascontiguousarray(code.T)
            for leaf, at, table in zip(leaves, code, tables, strict=True):
                if table is None:
                    inside, of = _patterns(leaf, x)
                    places, numbers = self.part(leaf, inside)
                    numbers = numbers.T
                else:
                    (places, numbers), of = table, at.astype(np.intp)
                for k, place in enumerate(places):
                    out[place] += numbers[k].take(of, mode="clip", out=got)
        return out


def values(trees: Trees, x: np.ndarray) -> np.ndarray:
    """(row, feature) Shapley values; they sum to the output less ``trees.expected()``."""
    return Lookup(trees, x.shape[1], _values_part).sums(x).T


def interactions(trees: Trees, x: np.ndarray) -> np.ndarray:
    """(row, feature, feature): half the Shapley interaction of two features off the diagonal, and on it what
    is left of the feature's value, so that rows of the matrix sum to ``values``."""
    n, d = x.shape
    out = np.zeros((n, d, d))
    i, j = np.triu_indices(d, 1)
    out[:, i, j] = out[:, j, i] = Lookup(trees, len(i), _pairs_part(d), 2).sums(x).T
    every = np.arange(d)
    out[:, every, every] = values(trees, x) - out.sum(2)
    return out


_MADE: dict[str, Lookup] = {}


def made(key: str, make: Callable[[], Lookup]) -> Lookup:
    """The look-up of one job, kept between the tasks of a worker; another job's is let go."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def tree_shapley(trees: Trees, rows: DataFrame, features: Sequence[str], group: Sequence[str] = ("dataset",), model: str = "model") -> DataFrame:
    """group..., model, row_id, feature, feature_value, phi, base_value: every row of ``rows``. One pass, no
    shuffle; the trees travel with the code. A null feature counts as 0, as the trainers have it."""
    feats, key = list(features), uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def phi(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        found = made(key, lambda: Lookup(trees, len(feats), _values_part))
        return pd.Series(list(found.sums(np.stack(x.to_list()).astype(float)).T))

    scored = rows.select(*group, "row_id", *[F.col(f"`{c}`").cast("double").alias(f"_f{i}") for i, c in enumerate(feats)], phi(passes.vector(feats)).alias("_phi"))
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_f{i}").alias("feature_value"), F.col("_phi")[i].alias("phi")) for i, c in enumerate(feats)]))
    return scored.select(*group, F.lit(model).alias("model"), "row_id", each, F.lit(trees.expected()).alias("base_value"))


def tree_interactions(trees: Trees, rows: DataFrame, features: Sequence[str], k: int = 10, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """group..., a, b, strength: the ``k`` pairs with the largest mean |interaction| (both halves), each
    group's rows summed inside the tasks before anything is shuffled."""
    feats, key = list(features), uuid.uuid4().hex
    pairs = [(i, j) for i in range(len(feats)) for j in range(i + 1, len(feats))]

    @F.pandas_udf("array<double>")
    def strength(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        found = made(key, lambda: Lookup(trees, len(pairs), _pairs_part(len(feats)), 2))
        return pd.Series(list(2 * np.abs(found.sums(np.stack(x.to_list()).astype(float)).T)))

    from pyspark.sql import Window

    scored = rows.select(*group, strength(passes.vector(feats)).alias("_s"))
    sums = scored.groupBy(*group).agg(*[F.avg(F.col("_s")[i]).alias(f"_s{i}") for i in range(len(pairs))])
    long = sums.select(*group, F.inline(F.array(*[F.struct(F.lit(feats[i]).alias("a"), F.lit(feats[j]).alias("b"), F.col(f"_s{n}").alias("strength")) for n, (i, j) in enumerate(pairs)])))
    best = Window.partitionBy(*group).orderBy(F.desc("strength"), "a", "b")
    return long.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
