"""Nearest neighbours by a block matrix join over int8 products.

Queries and candidates are dealt into blocks; every pair of blocks is one task group of bounded
size. Within it, vectors are coded as int8 with a scale each. The product of two codes is exact and
gives the inner product within a known bound; only pairs whose upper bound reaches the k-th best
lower bound are computed again from the original vectors in double precision, and go through a heap
for each query. The blocks' winners are merged by rank. The result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelab.llm.common import table, written


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of vectors that can take part: an id, and finite components that aren't all zero."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), finite.alias("finite"))
        .where("id is not null and v is not null and finite").where(F.exists("v", lambda x: x != 0)).select("id", "v")
    )


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of equal width; a shorter vector is filled with zeros, which leaves products as they are."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


class Coded:
    """int8 codes, scales, and norms of the coded part, the rest and the whole."""

    def __init__(self, m: np.ndarray):
        self.scale = np.abs(m).max(1) / 127
        code = np.rint(m / self.scale[:, None])
        self.code = code.astype(np.int8)
        self.part = np.linalg.norm(code * self.scale[:, None], axis=1)
        self.rest = np.linalg.norm(m - code * self.scale[:, None], axis=1)
        self.norm = np.linalg.norm(m, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows: sums below 2**24 are exact in float32."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.float64)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, added from the first component on."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def block_search(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, q_tile: int = 512, c_tile: int = 4096) -> list[tuple[int, int, float]]:
    """(query, candidate, score): each query's k best of the block, exactly."""
    # Of equal vectors, sorted by id, a row is needed only if fewer than k rows of ids other than a
    # query's stand before it. The query that has most of them is the id (below the row's own)
    # with the most rows, so each id's copies are counted apart; about 3k rows are kept at most.
    order = np.lexsort((cid, *c.T[::-1]))
    c, cid = c[order], cid[order]
    same = np.concatenate([[False], (c[1:] == c[:-1]).all(1)])
    place = np.arange(len(c)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(c))))
    starts = np.flatnonzero(~same | np.concatenate([[True], cid[1:] != cid[:-1]]))  # of equal vector and id
    sizes, group = np.diff(np.append(starts, len(c))), np.cumsum(~same)[starts] * (len(c) + 1)
    most = np.maximum.accumulate(group + sizes) - group  # rows of the largest id of the group so far
    below = np.where(place[starts] == 0, 0, np.concatenate([[0], most[:-1]]))
    keep = place - np.repeat(below, sizes) < k
    c, cid = c[keep], cid[keep]
    cq, cc = Coded(q), Coded(c)
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    floor = np.full(len(qid), -np.inf)
    for a in range(0, len(c), c_tile):
        cs = slice(a, a + c_tile)
        for b in range(0, len(q), q_tile):
            qs = slice(b, b + q_tile)
            near = products(cq.code[qs], cc.code[cs]) * cq.scale[qs, None] * cc.scale[cs]
            bound = cq.part[qs, None] * cc.rest[cs] + cq.rest[qs, None] * cc.norm[cs]
            bound += 1e-9 * cq.norm[qs, None] * cc.norm[cs] + 1e-300
            own = qid[qs, None] == cid[cs]
            low = np.where(own, -np.inf, near - bound)
            if low.shape[1] >= k:
                floor[qs] = np.maximum(floor[qs], np.partition(low, low.shape[1] - k, axis=1)[:, -k])
            i, j = np.nonzero((near + bound >= floor[qs, None]) & ~own)
            for at in range(0, len(i), 1 << 18):
                ii, jj = i[at : at + (1 << 18)] + b, j[at : at + (1 << 18)] + a
                for r, s, v in zip(ii.tolist(), exact(q[ii], c[jj]).tolist(), cid[jj].tolist(), strict=True):
                    heap = heaps[r]
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -v))
                    elif (s, -v) > heap[0]:
                        heapq.heapreplace(heap, (s, -v))
            for r in range(b, min(b + q_tile, len(q))):
                if len(heaps[r]) == k:
                    floor[r] = max(floor[r], heaps[r][0][0])
    return [(int(qid[r]), -v, s) for r, heap in enumerate(heaps) for s, v in heap]


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           q_block: int = 4096, c_block: int = 16384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest by inner product of every row whose
    id is divisible by ``every``, ties to the smaller id.

    Rows without id or with a null, zero or non-finite vector take no part. Of repeated ids the
    smallest vector asks; repeated rows are candidates each, but never of their own id. Vectors of
    different widths are filled with zeros. Blocks hold about ``q_block`` queries and ``c_block``
    candidates, so their number follows the table and what a group holds doesn't; queries go to
    every candidate block and candidates to every query block, no pair is emitted but winners.
    """
    rows = written(usable(vectors, id_col, vec_col), "vectors")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    n_c, n_q, width = rows.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1)), F.max(F.size("v"))).first()
    g_q, g_c = max(1, -(-n_q // q_block)), max(1, -(-n_c // c_block))
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    all_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # copies of one row are dealt like any other rows: by id and place
    place = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(g_c)).cast("int")
    left = asked.withColumn("qb", block(g_q, 1)).withColumn("cb", all_blocks(g_c))
    right = rows.withColumn("cb", place).withColumn("qb", all_blocks(g_q))
    width = int(width or 0)

    def job(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(q) and len(c):
            got = block_search(q["id"].to_numpy(), matrix(q["v"], width), c["id"].to_numpy(), matrix(c["v"], width), k)
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(job, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all vectors."""
    return search(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, v FROM e
      WHERE len([x FOR x IN v IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
      FROM u q JOIN u c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 20
"""
