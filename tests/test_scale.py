"""Work that must not grow with the number of passes, coalitions, pairs or replicates."""

from pyspark.sql import functions as F

from scorelab.operators import explain, learn, reliability, resample

COEFS = {"u": 1.0, "v": -2.0, "w": 0.5}


def small(spark, n: int = 300):
    return spark.range(n).select(
        F.lit("a").alias("dataset"), F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("u"), (F.col("id") % 5).cast("double").alias("v"),
        F.when(F.col("id") % 11 > 0, (F.col("id") % 3).cast("double")).alias("w"), (F.col("id") % 4 == 0).cast("int").alias("y"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def counted(spark, df, column: str):
    """(``df`` with a column that goes through a counter, the counter of the rows that were worked out)."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def count(v):
        seen.add(1)
        return v

    return df.withColumn(column, count.asNondeterministic()(F.col(column).cast("double"))), seen


def test_shapley_rows_has_no_row_a_coalition_in_a_shuffle(spark):
    df = small(spark)
    got = explain.shapley_rows(explain.linear_scorer(COEFS, 0.1), df, df, list(COEFS), draws=3, output="logit")
    assert "lag(" not in plan(got)  # steps between coalitions are sums, not a window over all of them
    f = {r["row_id"]: r["logit"] for r in explain.linear_scorer(COEFS, 0.1)(df).collect()}
    total, base = {}, {}
    for r in got.collect():
        total[r["row_id"]] = total.get(r["row_id"], 0.0) + r["phi"]
        base[r["row_id"]] = r["base_value"]
    assert len(total) == 300 and all(abs(total[i] + base[i] - f[i]) < 1e-9 for i in f)


def test_pair_interactions_shuffles_a_row_an_id(spark):
    df = small(spark)
    scorer = explain.linear_scorer(COEFS, 0.1)
    got = explain.pair_interactions(scorer, df, df, list(COEFS), 10)
    dealt = [s.split(")")[0] for s in plan(got).split("hashpartitioning(")[1:]]
    assert not any(" b#" in f" {s}" for s in dealt)
    rows = [r.asDict() for r in df.collect()]
    mean = {c: sum(r[c] for r in rows if r[c] is not None) / sum(r[c] is not None for r in rows) for c in COEFS}
    p = lambda r: scorer_value(r)
    for r in got.collect():
        a, b = r["a"], r["b"]
        second = [abs(p({**x, a: mean[a], b: mean[b]}) - p({**x, a: mean[a]}) - p({**x, b: mean[b]}) + p(x)) for x in rows]
        assert abs(r["strength"] - sum(second) / len(second)) < 1e-12
    assert got.count() == 3


def scorer_value(r) -> float:
    import math

    return 1 / (1 + math.exp(-(0.1 + sum(w * (r[c] or 0.0) for c, w in COEFS.items()))))


def test_bootstrap_draws_are_dealt_once(spark):
    df = small(spark).select("dataset", "row_id")
    got = resample.bootstrap_draws(df, 5, 3)
    dealt = [s.split(")")[0] for s in plan(got).split("hashpartitioning(")[1:]]
    assert not any(" b#" in f" {s}" and "_chunk#" not in s for s in dealt)
    assert {r["b"]: r["n"] for r in got.groupBy("b").agg(F.sum("weight").alias("n")).collect()} == {i: 300 for i in range(5)}


def test_counterfactual_states_are_held_once(spark):
    """As many moves as in a search that keeps every order of the same moves: the beam's places are counted."""
    rows = small(spark, 40).where("u > 2")
    scorer = explain.linear_scorer({"u": 1.0, "v": -1.0}, 0.0)
    got = {r["row_id"]: r for r in explain.counterfactuals(scorer, rows, {"u": -1, "v": 1}, {"u": 0.5, "v": 0.5}, {"u": 1.0, "v": 1.0}, beam=3, max_steps=9).collect()}
    for r in rows.collect():
        default, beam, hit = scorer_p(r["u"], r["v"]) >= 0.5, [(r["u"], r["v"])], None
        for step in range(1, 10):
            cand = [s for u, v in beam for s in ((u - 0.5, v), (u, v + 0.5))]
            cost = lambda s: sum(min(1.0, abs(a - b)) * (1 / (2 + 1e-12)) for a, b in zip(s, (r["u"], r["v"]), strict=True)) + 0.01 * step  # noqa: B023, E731
            cand.sort(key=lambda s: (cost(s), *s))
            flips = [s for s in cand if (scorer_p(*s) >= 0.5) != default]
            if flips:
                hit = (*flips[0], step)
                break
            beam = cand[:3]
        one = got[r["row_id"]]
        assert (one["u"], one["v"], one["changes"]) == hit if hit else not one["found"]
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def never(u):
        scored.add(1)
        return 1.0

    explain.counterfactuals(lambda df: df.withColumn("p", never.asNondeterministic()("u")), rows, {"u": -1, "v": 1}, {"u": 0.5, "v": 0.5},
                            {"u": 1.0, "v": 1.0}, beam=3, max_steps=4).count()
    assert scored.value <= rows.count() * (1 + 2 + 3 + 4 + 4)  # with every order of the moves: 1 + 2 + 4 + 6 + 6


def scorer_p(u: float, v: float) -> float:
    import math

    return 1 / (1 + math.exp(-(u - v)))


def test_reliability_scores_are_worked_out_once(spark):
    for of in (reliability.bucket_bounds, reliability.reliability_summary_stats):
        batch, seen = counted(spark, small(spark).select("dataset", F.col("u").alias("reliability_score")), "reliability_score")
        assert of(batch, group=["dataset"]).count() and seen.value == 300


def test_cross_val_rows_are_worked_out_once(spark):
    df, seen = counted(spark, small(spark), "u")
    assert learn.cross_val(learn.train_lr, df, ["u", "v"], k=2).count() == 3
    assert seen.value <= 2 * 300  # the fold ranks read the rows twice; the folds read what was written


def test_bootstrap_draws_send_no_side_through_the_driver(spark):
    draws = resample.bootstrap_draws(small(spark), 4, 42, by=["dataset"])
    total = draws.groupBy("dataset", "b").agg(F.sum("weight").alias("n"))
    assert sorted((r["b"], r["n"]) for r in total.collect()) == [(b, 300) for b in range(4)]
    join = [line for line in plan(total).splitlines() if "Join [" in line and "_rank" in line]
    assert join and not any("Broadcast" in line for line in join)
