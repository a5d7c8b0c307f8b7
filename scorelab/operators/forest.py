"""Random forests whose trees grow to the ground, a task a tree.

Features are binned (at most ``BINS`` bins each). Rows with the same bins are one cell with its rows by class, so the
table that trees grow from is no larger than the number of different cells; it travels to every task once. A tree's bag
is a Poisson number a row, drawn for a cell and class as one Poisson number of that mean. A task grows a whole tree, level
by level: every node looks at features of its own drawing, takes the split with the largest gain in Gini impurity, and
is a leaf where no split gains, at ``depth``, or where it is pure. Siblings that predict the same class are one leaf, as in
Spark ML, whose forest this is in all but the draws.

Trees stay in the shared folder, in pieces. To score rows, their different cells are dealt to groups of trees; a group adds up
its trees' shares of class 1, and the groups' sums meet by block of cells.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelab.operators import passes
from scorelab.session import written_once

BINS = 32

#: Bytes of cells that travel to every task.
CELLS = 96 << 20

#: Bytes of trees that a task holds while it scores, cells of a block, bytes of a piece of a tree.
HELD, BLOCK, PIECE = 64 << 20, 1 << 16, 1 << 20


class Tree(NamedTuple):
    """Nodes as columns, level by level; ``feature`` -1 is a leaf, the right child is the one after the left one.
    ``share`` is the share of class 1, ``cover`` the rows of the bag, ``gain`` that of the node's split."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    share: np.ndarray
    cover: np.ndarray
    gain: np.ndarray


_TYPES = ("<i2", "u1", "<i4", "<f8", "<f8", "<f8")


def per_node(strategy: str, d: int) -> int:
    """How many of ``d`` features a node looks at."""
    if strategy in ("auto", "sqrt"):
        return math.ceil(math.sqrt(d))
    return d if strategy == "all" else max(1, min(d, math.ceil(float(strategy) * d)))


#: Nodes worked out at a time: what they make of the rows stays in cache.
_NODES = 2048


def _chosen(rnd: np.random.Generator, nodes: int, d: int, k: int) -> np.ndarray:
    """(node, k) features of each node's own drawing, in order."""
    if k >= d:
        return np.broadcast_to(np.arange(d), (nodes, d))
    return np.sort(np.argpartition(rnd.random((nodes, d)), k - 1, axis=1)[:, :k], axis=1)


def _best(cells: np.ndarray, w: np.ndarray, size: np.ndarray, total: np.ndarray, some: np.ndarray, bins: int):
    """(gain, feature, bin) of the best split of nodes whose rows, ``size`` each, come one after the other."""
    k, per = some.shape
    node = np.repeat(np.arange(k), size)
    left = np.empty((2, k, per, bins))
    for s in range(per):
        at = node * bins + cells[np.arange(len(node)), some[:, s].take(node)]
        for c in (0, 1):
            left[c, :, s] = np.bincount(at, w[c], k * bins).reshape(k, bins)
    np.cumsum(left, axis=3, out=left)
    n, both = total.sum(0), left.sum(0)
    right = total[:, :, None, None] - left
    other = n[:, None, None] - both
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left[0] ** 2 + left[1] ** 2) / both + (right[0] ** 2 + right[1] ** 2) / other
    score[(both <= 0) | (other <= 0)] = -np.inf
    flat = score.reshape(k, -1)
    best = flat.argmax(1)
    gain = flat[np.arange(k), best] / n - (total**2).sum(0) / n**2
    return gain, some[np.arange(k), best // bins], best % bins


def grow(cells: np.ndarray, w: np.ndarray, look: int, depth: int, rnd: np.random.Generator) -> Tree:
    """One tree over (cell, feature) codes and (class, cell) rows of its bag."""
    d, bins = cells.shape[1], int(cells.max(initial=0)) + 1
    rows = np.flatnonzero(w.sum(0) > 0)
    size, total = np.array([len(rows)]), w[:, rows].sum(1).reshape(2, 1)
    levels: list[dict[str, np.ndarray]] = []
    made = 1
    for level in range(depth + 1):
        count = len(size)
        feature, bin_ = np.full(count, -1, np.int16), np.zeros(count, np.uint8)
        gains = np.zeros(count)
        if level < depth:
            open_ = np.flatnonzero((total > 0).all(0))  # pure nodes are leaves
            if len(open_) < count:
                keep = np.repeat((total > 0).all(0), size)
                rows = rows[keep]
            sizes = size[open_]
            begins = np.cumsum(sizes) - sizes
            for a in range(0, len(open_), _NODES):
                part = slice(a, a + _NODES)
                lo, hi = begins[part][0], begins[part][-1] + sizes[part][-1]
                mine = rows[lo:hi]
                got = _best(cells[mine], w[:, mine], sizes[part], total[:, open_[part]], _chosen(rnd, len(sizes[part]), d, look), bins)
                split = got[0] > 1e-12
                at = open_[part][split]
                gains[at], feature[at], bin_[at] = got[0][split], got[1][split], got[2][split]
        parents = np.flatnonzero(feature >= 0)
        left = np.zeros(count, np.int32)
        left[parents] = made + 2 * np.arange(len(parents))
        levels.append({"feature": feature, "bin": bin_, "left": left, "total": total, "gain": gains})
        if not len(parents):
            break
        of = np.repeat(open_, sizes)  # the rows' nodes
        keep = feature[of] >= 0
        rows, of = rows[keep], of[keep]
        goes = (cells[rows, feature[of]] > bin_[of]).astype(np.int64)
        child = 2 * np.searchsorted(parents, of) + goes
        size = np.bincount(child, minlength=2 * len(parents))
        total = np.stack([np.bincount(child, v.take(rows), 2 * len(parents)) for v in w])
        starts = np.cumsum(size) - size
        first = starts[child - goes]  # where the parent's rows begin
        before = np.cumsum(goes) - goes
        rights = before - before[first]  # rows of the parent that went right before this one
        moved = np.empty_like(rows)
        moved[np.where(goes == 1, starts[child] + rights, np.arange(len(rows)) - rights)] = rows
        rows = moved
        made += 2 * len(parents)
    return _pruned(levels)


def _pruned(levels: list[dict[str, np.ndarray]]) -> Tree:
    """The tree of the levels, siblings that are leaves and predict the same class made one."""
    begin = np.cumsum([0, *[len(x["feature"]) for x in levels]])
    for i in range(len(levels) - 2, -1, -1):
        here, below = levels[i], levels[i + 1]
        at = np.flatnonzero(here["feature"] >= 0)
        a = here["left"][at] - begin[i + 1]
        leaf, one = below["feature"] < 0, below["total"][1] > below["total"][0]
        here["feature"][at[leaf[a] & leaf[a + 1] & (one[a] == one[a + 1])]] = -1
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("feature", "bin", "left", "total", "gain")}
    kept, made = np.array([0]), 1
    for i, here in enumerate(levels):
        feature = here["feature"][kept]
        parents = np.flatnonzero(feature >= 0)
        left = np.zeros(len(kept), np.int32)
        left[parents] = made + 2 * np.arange(len(parents))
        for k, v in (("feature", feature), ("bin", here["bin"][kept]), ("left", left), ("total", here["total"][:, kept]), ("gain", np.where(feature >= 0, here["gain"][kept], 0.0))):
            out[k].append(v)
        if not len(parents):
            break
        a = here["left"][kept[parents]] - begin[i + 1]
        kept, made = np.column_stack([a, a + 1]).ravel(), made + 2 * len(parents)
    feature, bin_, left, gain = (np.concatenate(out[k]) for k in ("feature", "bin", "left", "gain"))
    total = np.concatenate(out["total"], axis=1)
    cover = total.sum(0)
    return Tree(feature, bin_, left, total[1] / np.maximum(cover, 1e-300), cover, gain)


def importance(tree: Tree, d: int) -> np.ndarray:
    """Gains by feature, weighted by rows; they sum to 1, or are 0 without a split."""
    inner = tree.feature >= 0
    out = np.bincount(tree.feature[inner], (tree.gain * tree.cover)[inner], d)
    return out / out.sum() if out.sum() > 0 else out


def shares(tree: Tree, cells: np.ndarray) -> np.ndarray:
    """The share of class 1 where each of the (cell, feature) codes ends."""
    at, open_ = np.zeros(len(cells), np.int64), np.arange(len(cells))
    while len(open_):
        node = at[open_]
        feature = tree.feature[node]
        inner = feature >= 0
        open_, node, feature = open_[inner], node[inner], feature[inner]
        at[open_] = tree.left[node] + (cells[open_, feature] > tree.bin[node])
    return tree.share[at]


# ---------------------------------------------------------------- tables

def coded(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray], keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns and ``_cell``, the bins of a row, a byte a feature."""
    def job(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            data = np.ascontiguousarray(passes.codes_of(x, cuts))
            cell = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(cuts)), b.num_rows, [None, pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], cell], names=[*keep, "_cell"])

    picked = df.select(*[F.col(f"`{c}`") for c in keep], passes.vector(features).alias("_x"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("_cell", T.BinaryType())])
    return passes.arrow_job(picked, job, schema)


def _matrix(cells: Sequence[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), d)


class Forest(NamedTuple):
    trees: DataFrame  # (tree, column, piece, data): the pieces of every tree's columns
    sizes: list[int]  # bytes of each tree
    importances: np.ndarray
    cuts: list[np.ndarray]
    features: list[str]

    def save(self, path: str) -> None:
        """The trees' pieces and what reads them, as tables."""
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        spark = self.trees.sparkSession
        about = [(f, c.tolist(), float(v)) for f, c, v in zip(self.features, self.cuts, self.importances, strict=True)]
        spark.createDataFrame(about, "feature string, cuts array<double>, importance double").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")  # a row a feature

    def tables(self) -> list[Tree]:
        """All trees: the model itself."""
        pieces: dict[tuple[int, int], list[bytes]] = {}
        for r in self.trees.orderBy("tree", "column", "piece").collect():
            pieces.setdefault((r.tree, r.column), []).append(bytes(r.data))
        return [_tree([b"".join(pieces[t, c]) for c in range(len(_TYPES))]) for t in range(len(self.sizes))]


def _tree(columns: Sequence[bytes]) -> Tree:
    return Tree(*[np.frombuffer(c, t) for c, t in zip(columns, _TYPES, strict=True)])


def fit(train: DataFrame, features: Sequence[str], y: str, trees: int, strategy: str, depth: int, seed: int) -> Forest | None:
    """A forest of rows of classes 0 and 1, or None where its cells are more than ``CELLS`` bytes."""
    spark, feats, d = train.sparkSession, list(features), len(features)
    rows = passes.model_rows(train, feats, y, keep=())
    cuts = passes.cut_points(rows, BINS).get("", [np.zeros(0)] * d)
    one = coded(train.select(*feats, F.col(f"`{y}`").cast("double").alias("_y")), feats, cuts, ["_y"])
    table = written_once(one.groupBy("_cell").agg(F.sum(1 - F.col("_y")).alias("n0"), F.sum("_y").alias("n1")))
    if table.count() * (d + 16) > CELLS:
        return None
    got = table.orderBy("_cell").toArrow()  # at most CELLS bytes
    cells = _matrix(got["_cell"].to_pylist(), d)
    sent = spark.sparkContext.broadcast((cells, np.stack([got["n0"].to_numpy(), got["n1"].to_numpy()])))
    look = per_node(strategy, d)

    def job(batches: Iterator[pa.RecordBatch]):
        codes, rows_of = sent.value
        for b in batches:
            for t in b.column(0).to_pylist():
                rnd = np.random.default_rng([seed & 0xFFFFFFFF, t])
                tree = grow(codes, rnd.poisson(rows_of).astype(float), look, depth, rnd)
                gains = importance(tree, d).tobytes()
                for column, (values, kind) in enumerate(zip(tree, _TYPES, strict=True)):
                    data = np.ascontiguousarray(values, kind).tobytes()
                    for piece, at in enumerate(range(0, len(data), PIECE)):
                        part = data[at : at + PIECE]
                        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([column], pa.int32()), pa.array([piece], pa.int32()), pa.array([part], pa.binary())], names=["tree", "column", "piece", "data"])
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([gains], pa.binary())], names=["tree", "column", "piece", "data"])

    numbers = spark.range(0, trees, 1, trees).select(F.col("id").cast("int").alias("tree"))
    grown = written_once(passes.arrow_job(numbers, job, "tree int, column int, piece int, data binary"))
    sent.unpersist()
    summary = grown.groupBy("tree").agg(F.sum(F.length("data")).alias("bytes"), F.max(F.when(F.col("column") < 0, F.col("data"))).alias("gains")).orderBy("tree").collect()  # a row a tree
    gains = np.sum([np.frombuffer(r.gains) for r in summary], axis=0)
    return Forest(grown.where("column >= 0"), [int(r.bytes) for r in summary], gains / gains.sum() if gains.sum() > 0 else gains, cuts, feats)


def scored(forest: Forest, df: DataFrame) -> DataFrame:
    """``df`` with ``p``, the mean share of class 1 over the trees."""
    spark, d = df.sparkSession, len(forest.features)
    rows = written_once(coded(df, forest.features, forest.cuts, df.columns))
    group, of, held = 0, [], 0
    for size in forest.sizes:
        if held and held + size > HELD:
            group, held = group + 1, 0
        held += size
        of.append(group)
    cores = spark.sparkContext.defaultParallelism
    if group + 1 < min(cores, len(of)):  # small trees: every core has some
        of = [t * min(cores, len(of)) // len(of) for t in range(len(of))]
    groups = max(of) + 1

    def blocks(batches: Iterator[pa.RecordBatch]):
        part = uuid.uuid4().hex
        for n, b in enumerate(batches):
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{n}"]), pa.array([b"".join(b.column(0).to_pylist())], pa.binary())], names=["block", "data"])

    cells = written_once(passes.arrow_job(rows.select("_cell").distinct(), blocks, "block string, data binary"))
    belongs = F.element_at(F.array(*[F.lit(g) for g in of]), F.col("tree") + 1)
    trees = forest.trees.select(belongs.alias("group"), "tree", "column", "piece", F.lit("").alias("block"), "data")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    dealt = cells.select(every, F.lit(len(of)).alias("tree"), F.lit(0).alias("column"), F.lit(0).alias("piece"), "block", "data")
    order = ["group", "tree", "column", "piece", "block"]
    both = trees.unionByName(dealt).repartitionByRange(groups, "group").sortWithinPartitions(*order)

    def add(batches: Iterator[pa.RecordBatch]):
        now, pieces, ready = None, {}, []
        for b in batches:
            for g, t, column, block, data in zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 4, 5)], strict=True):
                if g != now:
                    now, pieces, ready = g, {}, []
                if t < len(of):
                    pieces.setdefault((t, column), []).append(data)
                    continue
                if pieces:
                    ready = [_tree([b"".join(pieces[k, c]) for c in range(len(_TYPES))]) for k in sorted({k for k, _ in pieces})]
                    pieces = {}
                matrix = np.frombuffer(data, np.uint8).reshape(-1, d)
                total = np.zeros(len(matrix))
                for tree in ready:
                    total += shares(tree, matrix)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([g], pa.int32()), pa.array([data], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["block", "group", "data", "sums"])

    def meet(batches: Iterator[pa.RecordBatch]):
        now, codes, total = None, b"", None

        def out():
            n = len(total)
            cell = pa.FixedSizeBinaryArray.from_buffers(pa.binary(d), n, [None, pa.py_buffer(codes)]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([cell, pa.array(total / len(of))], names=["_known", "p"])

        for b in batches:
            for block, data, sums in zip(*[b.column(i).to_pylist() for i in (0, 2, 3)], strict=True):
                part = np.frombuffer(sums)
                if block != now:
                    if now is not None:
                        yield out()
                    now, codes, total = block, data, part
                else:
                    total = total + part
        if now is not None:
            yield out()

    parts = passes.arrow_job(both, add, "block string, group int, data binary, sums binary")
    known = passes.arrow_job(parts.repartition("block").sortWithinPartitions("block", "group"), meet, "_known binary, p double")
    joined = rows.join(written_once(known).hint("merge"), F.col("_cell") == F.col("_known"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], "p")
