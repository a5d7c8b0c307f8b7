"""Answers that once were wrong: several models, missing values, identity, stores, samples."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_pair_bins_of_nine_columns(spark):
    from scorelab.operators.profiling import pair_bins

    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 7).cast("double").alias(f"c{i}") for i in range(9)])
    pairs = pair_bins(df, df.columns).select("a", "b").distinct().collect()
    assert len(pairs) == 36 and {"c8"} <= {r.b for r in pairs}


def test_missing_is_null_or_nan(spark):
    from scorelab.operators import prep, profiling

    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert sorted(r.x for r in prep.impute_mean(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]
    assert sorted(r.x for r in prep.impute_median(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]
    info = profiling.column_info(df).first()
    assert (info.non_null, info.nulls) == (2, 2) and profiling.null_total(df).first()[0] == 2
    d = profiling.describe_long(df, ["x"]).first()
    assert (d["count"], d["mean"], d["q50"], d["max"]) == (2.0, 2.0, 2.0, 3.0)
    assert sum(r.n for r in profiling.histogram(df, ["x"], 4).collect()) == 2
    assert sorted(str(r.x) for r in prep.scale_standard(df, ["x"]).collect()) == ["-1.0", "1.0", "None", "None"]


def test_row_ids_tell_nulls_apart(spark):
    from scorelab.sources.io import dataset_fingerprint, with_row_id

    df = spark.createDataFrame([(None, "x"), ("x", None), ("x", None), (None, None)], "a string, b string")
    for wide in (False, True):
        assert len({r.row_id for r in with_row_id(df, wide=wide, chunk=1).collect()}) == 4
    one = spark.createDataFrame([("d", "x", None), ("d", "y", None)], "dataset string, a string, b string")
    two = spark.createDataFrame([("d", None, "x"), ("d", "y", None)], "dataset string, a string, b string")
    stored = dataset_fingerprint(one)
    assert not dataset_fingerprint(one.repartition(5), stored).first().stale
    assert dataset_fingerprint(two, stored).first().stale and dataset_fingerprint(one.unionAll(one).unionAll(one), stored).first().stale


def test_result_tables_keep_their_columns_and_errors_are_raised(spark, tmp_path):
    from scorelab.sources import io

    root = str(tmp_path)
    io.result_table_io(spark.createDataFrame([("m", 0.5)], "model string, AUC double"), root, "bench", "d")
    io.result_table_io(spark.createDataFrame([("f", 1)], "feature string, rank int"), root, "ranks", "d")
    assert io.result_table_io(None, root, "ranks", "d", spark).columns == ["feature", "rank"]
    assert io.result_table_io(None, root, "bench", "d", spark).first().AUC == 0.5
    assert io.result_table_io(None, root, "bench", "other", spark) is None
    (tmp_path / "results/kind=bench/dataset_key=bad").mkdir()
    (tmp_path / "results/kind=bench/dataset_key=bad/part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="[Pp]arquet"):  # not "no such table"
        io.result_table_io(None, root, "bench", "bad", spark).collect()


def test_records_number_on_and_return_what_is_stored(spark, tmp_path):
    from scorelab.sources import io

    rec = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "c")], "dataset string, note string")
    first, second = io.record_store(rec, str(tmp_path), "notes"), io.record_store(rec, str(tmp_path), "notes")
    assert sorted((r.dataset, r.record_id) for r in first.unionAll(second).collect()) == [("d", 1), ("d", 2), ("d", 3), ("d", 4), ("e", 1), ("e", 2)]
    stored = io.recent_records(spark, str(tmp_path), "notes").collect()
    assert {(r.dataset, r.record_id, r.ts) for r in stored} == {(r.dataset, r.record_id, r.ts) for r in first.unionAll(second).collect()}


def test_pairs_are_by_group_and_model(spark):
    from scorelab.operators.paired import pair_scores

    rows = [("d", g, m, i, i % 2, p) for i in range(4) for g, m, p in (("g1", "a", 0.1), ("g2", "a", 0.9), ("g1", "b", 0.5))]
    s = spark.createDataFrame(rows, "dataset string, model_group string, model string, row_id long, y int, p double")
    got = pair_scores(s, ("g1", "a"), ("g1", "b")).collect()
    assert len(got) == 4 and {(r.pa, r.pb) for r in got} == {(0.1, 0.5)}
    assert {(r.pa, r.pb) for r in pair_scores(s, ("g2", "a"), "b").collect()} == {(0.9, 0.5)}
    with pytest.raises(PySparkException):
        pair_scores(s, "a", "b").collect()


def test_reliability_of_two_models(spark):
    from scorelab.operators.reliability import model_robustness, row_reliability, row_shares

    phi = spark.createDataFrame([("d", m, 1, f, v) for m in ("a", "b") for f, v in (("x", 1.0), ("y", 1.0))], "dataset string, model string, row_id long, feature string, phi double")
    w = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.5), ("b", "x", 0.5)], "model string, feature string, W double")
    got = {(r.model, r.feature): (r.W, r.share) for r in row_shares(phi, w).collect()}
    assert got == {("a", "x"): (1.0, 0.5), ("a", "y"): (0.5, 0.5), ("b", "x"): (0.5, 0.5), ("b", "y"): (0.0, 0.5)}
    assert {r.model: r.ER for r in model_robustness(phi, w).collect()} == {"a": 0.75, "b": 0.25}
    s = spark.createDataFrame([("d", m, 1, 1, 0.9) for m in ("a", "b")], "dataset string, model string, row_id long, y int, p double")
    rel = {r.model: (r.GL_term, r.C_concentration, r.ER_global) for r in row_reliability(phi, s, w, 1.5).collect()}
    assert rel == {"a": (0.75, 0.5, 0.75), "b": (0.25, 0.5, 0.25)}
    with pytest.raises(PySparkException):
        row_shares(phi, w.unionAll(w)).collect()


def test_codes_of_text_with_a_shared_prefix(spark):
    from scorelab.plans.ranks import dense_codes, running_totals

    urls = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url")
    want = {u: i for i, u in enumerate(sorted({r.url for r in urls.collect()}))}
    assert {r.url: r.code for r in dense_codes(urls, "url").collect()} == want
    ranged = running_totals(urls.distinct().withColumn("n", F.lit(1)), [], "url", ["n"], buckets=8)
    assert ranged.select("_bucket").distinct().count() == 8 and ranged.agg(F.max("cum_n")).first()[0] == len(want)


def test_bootstrap_weights(spark):
    import numpy as np

    from scorelab.operators.reliability import _poisson_weights, bootstrap_auc

    w = _poisson_weights(np.arange(20_000, dtype=np.uint64) * np.uint64(977), 5, 1)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs(np.corrcoef(w.T)[0, 1]) < 0.03
    rows = [("d", "g", m, i, int(i % 3 == 0), (i * k % 101) / 101) for i in range(600) for m, k in (("a", 7), ("b", 13))]
    s = spark.createDataFrame(rows, "dataset string, model_group string, model string, row_id long, y int, p double")
    a, b = bootstrap_auc(s, 20).orderBy("model").collect(), bootstrap_auc(s.repartition(7), 20).orderBy("model").collect()
    assert a == b and all(r.n_boot == 20 and r.ci_lower <= r["mean"] <= r.ci_upper and 0 < r["std"] < 0.1 for r in a)


def test_numbered_copies(spark):
    from scorelab.operators.resample import numbered

    df = spark.createDataFrame([("a", 7), ("b", 0), ("c", 3)], "k string, n long")
    got = sorted((r.k, r.i) for r in numbered(df, "n", "i", chunk=2).collect())
    assert got == [("a", i) for i in range(7)] + [("c", i) for i in range(3)]


def test_no_nested_loop_in_samples(spark):
    from scorelab.operators.resample import bootstrap_draws, oversample_random
    from scorelab.sources.bindings import credit_orders

    o = credit_orders(spark, SF)
    for df in (oversample_random(o), bootstrap_draws(o, 3)):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_too_many_levels_is_an_error(spark):
    from scorelab.operators.prep import fit_levels

    df = spark.range(30).select(F.col("id").cast("string").alias("c"))
    assert len(fit_levels(df, ["c"])["c"]) == 30
    with pytest.raises(ValueError, match="'c'"):
        fit_levels(df, ["c"], max_levels=29)


def test_stream_goes_on_from_its_folder(spark, tmp_path):
    from scorelab.streaming.stream import file_stream, stream_value_counts

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a",), ("b",), ("a",)], "v string").write.parquet(src)
    like = spark.read.parquet(src)
    assert {r.value: r["count"] for r in stream_value_counts(file_stream(spark, src, like), "v", out).collect()} == {"a": 2, "b": 1}
    spark.createDataFrame([("b",), (None,)], "v string").write.mode("append").parquet(src)
    assert {r.value: r["count"] for r in stream_value_counts(file_stream(spark, src, like), "v", out).collect()} == {"a": 2, "b": 2, None: 1}


def test_quantiles_are_those_of_numpy(spark):
    import numpy as np

    from scorelab.plans.ranks import exact_quantiles

    x = [float((i * 37) % 101) for i in range(333)]
    df = spark.createDataFrame([("g" if i % 3 else "h", v) for i, v in enumerate(x)], "g string, x double")
    probs = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r.value for r in exact_quantiles(df, ["x"], probs, ["g"], buckets=5).collect()}
    for g in "gh":
        mine = [v for i, v in enumerate(x) if ("g" if i % 3 else "h") == g]
        assert all(math.isclose(got[g, q], np.quantile(mine, q)) for q in probs)
