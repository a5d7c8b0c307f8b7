"""Trials on a fitted scorer, oversampling by dataset, streams whose last batch failed."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scorelab.operators import explain
from scorelab.operators.resample import smote
from scorelab.streaming import stream


def rows_of(spark, n=90):
    rnd = random.Random(1)
    return spark.createDataFrame([("a" if i % 3 else "b", i, rnd.random(), rnd.random(), int(i % 5 == 0)) for i in range(n)], "dataset string, row_id long, u double, v double, y int")


@pytest.mark.parametrize(("trials", "bg", "rows"), [(3, 10, 7), (4, 20, 25), (1, 1000, 1000)])
def test_trials_are_ranges_of_one_order(spark, trials, bg, rows):
    df = rows_of(spark)
    back, asked = explain.trial_samples(df, df, trials, bg, rows)
    sizes = Counter(r.dataset for r in df.collect())
    got = [(r.dataset, r.trial, r.row_id) for r in asked.collect()]
    for ds, n in sizes.items():
        seen = []
        for t in range(trials):
            mine = [i for d, k, i in got if (d, k) == (ds, t)]
            assert len(mine) == len(set(mine)) == min(rows, n)
            seen += mine
        assert max(Counter(seen).values()) - min([Counter(seen).get(i, 0) for i in set(seen)]) <= 1  # a row comes again only when all were used
        if trials * rows <= n:
            assert len(set(seen)) == trials * rows
    for (ds, t), n in Counter((r.dataset, r.trial) for r in back.collect()).items():
        mine = [r for r in back.collect() if (r.dataset, r.trial) == (ds, t)]
        share = sum(r.y for r in df.collect() if r.dataset == ds) / sizes[ds]
        assert n == min(bg, sizes[ds]) and abs(sum(r.y for r in mine) - share * n) <= 1
    again = explain.trial_samples(df.repartition(7), df.repartition(3), trials, bg, rows)
    assert sorted((r.dataset, r.trial, r.row_id) for r in again[1].collect()) == sorted(got)
    assert sorted(map(str, again[0].select(*back.columns).collect())) == sorted(map(str, back.collect()))


def test_trial_values_of_a_linear_scorer(spark):
    """Sampled values of a linear scorer add up in every trial, and the larger weight ranks first."""
    df = rows_of(spark)
    sc = explain.linear_scorer({"u": 3.0, "v": 0.1}, 0.0)
    phi = explain.trial_shapley(lambda d: sc(d), df, df, ["u", "v"], 3, 10, 6, draws=2)
    assert phi.groupBy("dataset", "trial").agg(F.countDistinct("row_id").alias("n")).where("n = 6").count() == 6
    first = explain.rank_stability(phi, group=("dataset", "model")).where("feature = 'u'").collect()
    assert [(r.avg_rank, r.std_rank) for r in first] == [(1.0, 0.0)] * 2


def test_smote_by_dataset_balances_each(spark):
    df = rows_of(spark)
    got = smote(df, ["u", "v"], "y", 3, 5, by=["dataset"])
    counts = {(r.dataset, r.y): r.n for r in got.groupBy("dataset", "y").agg(F.count("*").alias("n")).collect()}
    assert counts["a", 0] == counts["a", 1] and counts["b", 0] == counts["b", 1]
    alone = smote(df.where("dataset = 'a'"), ["u", "v"], "y", 3, 5)
    one = lambda d: sorted((r.row_id, r.u, r.v) for r in d.where("synthetic").collect())
    assert one(got.where("dataset = 'a'")) == one(alone)
    assert smote(df.limit(0), ["u", "v"], by=["dataset"]).count() == 0


def test_an_unfinished_batch_is_never_read(spark, tmp_path):
    src, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([("x",), ("y",), ("x",)], "c string").write.parquet(src)
    read = lambda: {r.value: r["count"] for r in stream.stream_value_counts(stream.file_stream(spark, src), "c", folder).collect()}
    assert read() == {"x": 2, "y": 1}
    spark.createDataFrame([("broken", 9)], "value string, count long").write.parquet(f"{folder}/batch-7")  # written, never among the finished
    assert read() == {"x": 2, "y": 1}
    spark.createDataFrame([("y",)], "c string").write.mode("append").parquet(src)
    assert read() == {"x": 2, "y": 2}
