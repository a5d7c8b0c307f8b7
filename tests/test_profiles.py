"""Quantiles by bracketing, frequent values, histograms, mergeable AUC partials."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.operators import profiling
from scorelab.operators.reliability import _poisson_weights, bootstrap_auc
from scorelab.plans import ranks


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 3000])
def test_quantiles_equal_numpy(spark, n, monkeypatch):
    monkeypatch.setattr(ranks, "SKETCH", 100)  # wide brackets: many ranks lie inside, some next to them
    rnd = random.Random(n)
    rows = [(g, rnd.gauss(0, 1), float(rnd.randint(0, 3)), 7.0) for g in ("a", "b", None) for _ in range(n)]
    rows += [("a", None, float("nan"), None), ("b", float("nan"), None, 1e300)]
    df = spark.createDataFrame(rows, "g string, x double, ties double, big double").repartition(3)
    probs = [0.0, 0.05, 0.25, 0.5, 0.731, 0.99, 1.0]
    got = {(r.g, r.column, r.prob): r.value for r in ranks.exact_quantiles(df, ["x", "ties", "big"], probs, group=["g"]).collect()}
    for g in ("a", "b", None):
        for i, c in enumerate(("x", "ties", "big"), 1):
            v = np.array([r[i] for r in rows if r[0] == g and r[i] is not None and r[i] == r[i]])
            for q in probs:
                assert np.isclose(got[g, c, q], np.quantile(v, q), rtol=1e-9), (g, c, q)
    assert len(got) == 3 * 3 * len(probs)


def test_quantiles_shuffle_counts_alone(spark):
    """What the last pass exchanges are counts of few values, not the rows."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    out = ranks.exact_quantiles(df, ["x"], [0.25, 0.5])
    assert out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize(("buckets", "probe"), [(1 << 16, 64), (8, 1), (3, 1)])
def test_frequent_values(spark, buckets, probe):
    rnd = random.Random(buckets)
    rows = [(f"v{int(rnd.paretovariate(0.7))}", i, None if i % 3 else "x", None) for i in range(2000)] + [("", 5, "é", None)]
    df = spark.createDataFrame(rows, "skewed string, unique long, few string, nothing string")
    got = Counter((r.column, r.value, r["count"], r["rank"]) for r in profiling.frequent_values(df, ["skewed", "unique", "few", "nothing"], 5, buckets, probe).collect())
    want = Counter()
    for i, c in enumerate(("skewed", "unique", "few")):
        n = Counter(str(r[i]) for r in rows if r[i] is not None)
        want.update((c, v, k, p + 1) for p, (k, v) in enumerate(sorted(((k, v) for v, k in n.items()), key=lambda t: (-t[0], t[1].encode()))[:5]))
    assert got == want


def test_histograms_have_empty_bins(spark):
    df = spark.createDataFrame([(0.0, 3.0, None), (1.0, 3.0, None), (10.0, None, None)], "x double, same double, none double")
    got = [(r.column, r.bin, r.n) for r in profiling.histogram(df, ["x", "same", "none"], 5).orderBy("column", "bin").collect()]
    assert got == [("same", 0, 2), ("x", 0, 2), ("x", 1, 0), ("x", 2, 0), ("x", 3, 0), ("x", 4, 1)]


def test_bootstrap_equals_a_weighted_brute_force(spark):
    rnd = random.Random(3)
    rows = [("d", m, m, i, int(rnd.random() < 0.4), round(rnd.random(), 1 if m == "ties" else 9)) for m in ("smooth", "ties") for i in range(400)]
    rows += [("d", "one", "one", i, 1, 0.5) for i in range(20)]
    df = spark.createDataFrame(rows, "dataset string, model_group string, model string, row_id long, y int, p double")
    got = {r.model: r for r in bootstrap_auc(df.repartition(5), 20, 7).collect()}
    h = {r.row_id: r.h for r in df.select("row_id", ranks.hash_key(7, "dataset", "row_id").alias("h")).distinct().collect()}
    for m in ("smooth", "ties"):
        mine = [r for r in rows if r[2] == m]
        w = _poisson_weights(np.array([h[r[3]] for r in mine], np.int64).view(np.uint64), 20, 7)
        y, p = np.array([r[4] for r in mine]), np.array([r[5] for r in mine])
        above = (p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])
        auc = [w[y == 1, b] @ above @ w[y == 0, b] / (w[y == 1, b].sum() * w[y == 0, b].sum()) for b in range(20)]
        want = (np.mean(auc), np.std(auc), 20, *np.quantile(auc, [0.025, 0.975]))
        r = got[m]
        assert np.allclose((r["mean"], r["std"], r.n_boot, r.ci_lower, r.ci_upper), want)
    assert set(got) == {"smooth", "ties"}  # a model whose rows have one class has no AUC


@pytest.mark.parametrize(("kind", "p"), [("clustered", 2), ("clustered", 1), ("constant", 2), ("grid", 2)])
def test_neighbours_on_awkward_data(spark, kind, p, monkeypatch):
    from scorelab.operators import neighbours

    rnd = random.Random(5)
    if kind == "clustered":  # a third of all rows in one tiny cluster, the rest far apart
        pts = [(rnd.gauss(0, 1e-3), rnd.gauss(0, 1e-3)) if i % 3 else (rnd.uniform(-1e3, 1e3), rnd.gauss(0, 1)) for i in range(400)]
    elif kind == "constant":
        pts = [(1.0, 2.0)] * 300 + [(1.0, 2.5)] * 2
    else:
        pts = [(float(rnd.randint(0, 4)), float(rnd.randint(0, 4))) for _ in range(300)]
    df = spark.createDataFrame([(i, a, b if i != 7 else None) for i, (a, b) in enumerate(pts)], "row_id long, a double, b double").repartition(3)
    pts[7] = (pts[7][0], 0.0)
    asked = df.where("row_id % 5 = 0")
    for own in (False, True):
        got = {}
        for r in neighbours.knn_join(asked, df, ["a", "b"], 4, p, exclude_self=own, bound=40, fan=4).collect():
            got.setdefault(r.q_id, []).append((r.nn_rank, r.r_id, r.dist))
        for q in range(0, len(pts), 5):
            dist = lambda i, q=q: abs(pts[q][0] - pts[i][0]) + abs(pts[q][1] - pts[i][1]) if p == 1 else ((pts[q][0] - pts[i][0]) ** 2 + (pts[q][1] - pts[i][1]) ** 2) ** 0.5
            want = sorted((dist(i), i) for i in range(len(pts)) if not own or i != q)[:4]
            assert [(k + 1, i) for k, (_, i) in enumerate(want)] == [(k, i) for k, i, _ in sorted(got[q])]
            assert np.allclose([d for d, _ in want], [d for *_, d in sorted(got[q])])
    _, cells, levels = neighbours.pivot_tree(df.select(F.col("row_id").alias("r_id"), F.array("a", F.coalesce("b", F.lit(0.0))).alias("x")).dropDuplicates(["x"]), p, 40, 4, 1)
    assert max(r["count"] for r in cells.groupBy("cell").count().collect()) <= 40
    assert neighbours.knn_join(asked, df.limit(0), ["a", "b"], 4).count() == 0 and neighbours.knn_join(asked.limit(0), df, ["a", "b"], 4).count() == 0
    few = neighbours.knn_join(asked.where("row_id = 0"), df.where("row_id < 3"), ["a", "b"], 4).collect()
    assert [r.nn_rank for r in sorted(few, key=lambda r: r.nn_rank)] == [1, 2, 3][: len(few)] and len(few) == 3


def test_sparse_one_hot_equals_the_wide_one(spark):
    from pyspark.ml.functions import vector_to_array

    from scorelab.operators import prep

    rnd = random.Random(6)
    train = spark.createDataFrame([(i, rnd.choice(["b", "a", "ä", None]), f"id{i % 40}", None) for i in range(120)], "row_id long, few string, many string, nothing string")
    test = spark.createDataFrame([(1, "a", "id3", "x"), (2, "unseen", "id39", None), (3, None, "id40", None), (3, None, "id40", None)], train.schema)
    rows, names = prep.sparse_one_hot(test, ["few", "many", "nothing"], train)
    wide = prep.one_hot(test, ["few", "many", "nothing"], train)
    place = {r["index"]: f"{r.column}={r.level}" for r in names.collect()}
    assert sorted(place) == list(range(43)) and [place[i] for i in (0, 1, 2)] == ["few=a", "few=b", "few=ä"] and rows.columns == ["row_id", "features"]
    got = Counter((r.row_id, tuple(sorted(place[i] for i, v in enumerate(r.v) if v))) for r in rows.select("row_id", vector_to_array("features").alias("v")).collect())
    want = Counter((r.row_id, tuple(sorted(c for c in wide.columns[1:] if r[c]))) for r in wide.collect())
    assert got == want


def test_sparse_one_hot_of_very_many_levels(spark):
    from scorelab.operators import prep

    df = spark.range(120_000).select(F.concat(F.lit("u"), "id").alias("u"))
    rows, names = prep.sparse_one_hot(df, ["u"])
    assert names.count() == 120_000
    first = rows.first().features
    assert first.size == 120_000 and len(first.indices) == 1
    assert prep.sparse_one_hot(df.limit(0), ["u"])[0].count() == 0


def test_row_ids_shuffle_hashes_alone(spark):
    from scorelab.sources.io import with_row_id

    rows = [(i, None if i % 7 else "x", float(i % 3)) for i in range(200)] + [(500, "same", None)] * 30 + [(501, None, float("nan"))] * 2
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(4)
    for kw in ({}, {"wide": True}, {"chunk": 4}):
        got = with_row_id(df, **kw)
        ids = [r.row_id for r in got.collect()]
        assert len(ids) == len(set(ids)) == 232
        assert Counter((r.a, r.b, str(r.c)) for r in got.collect()) == Counter((a, b, str(c)) for a, b, c in rows)
        again = {(r.a, r.row_id) for r in with_row_id(df.repartition(7), **kw).collect()}
        assert again == {(r.a, r.row_id) for r in got.collect()}
    plan = with_row_id(df.where("a < 500"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert with_row_id(df.limit(0)).count() == 0


@pytest.mark.parametrize("p", [1, 2])
def test_a_distance_written_out_is_the_aggregate(spark, p):
    from scorelab.operators import neighbours

    rnd = random.Random(p)
    rows = [([rnd.gauss(0, 1) for _ in range(5)], [rnd.choice([0.0, rnd.gauss(0, 9)]) for _ in range(5)]) for _ in range(50)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(neighbours._dist(F.col("a"), F.col("b"), p).alias("one"), neighbours._dist(F.col("a"), F.col("b"), p, 5).alias("two")).collect()
    assert all(r.one == r.two for r in got)


def test_neighbours_are_searched_on_every_core(spark):
    from scorelab.operators import neighbours

    df = spark.range(40).coalesce(1)
    got = neighbours.on_every_core(df)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in got.collect()) == list(range(40))
