"""Split, sample and resample.

Every random choice is a seeded 64-bit hash of the row id, so results do not depend on the
partitioning or on task retries. Exact stratified sizes come from ``hash_rank`` (exact rank
inside a stratum without a single-task sort) plus a largest-remainder allocation computed on the
tiny class-count table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelab.plans.ranks import hash_key, hash_rank
from scorelab.session import cut_lineage


def _c(names):
    return [F.col(c) for c in names]


def class_counts(df: DataFrame, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, y).agg(F.count(F.lit(1)).alias("n_class"))


def allocate(counts: DataFrame, draws: Column, y: str = "y", by: Sequence[str] = (), out: str = "alloc") -> DataFrame:
    """Largest-remainder split of ``draws`` over classes in proportion to ``n_class``.

    ``draws`` is an expression over ``n_total`` (the stratum size). Ties in the remainder go to
    the smaller class value. The table has one row per (by, class): small."""
    by = list(by)
    w_by = Window.partitionBy(*_c(by)) if by else Window.partitionBy(F.lit(0))
    t = counts.withColumn("n_total", F.sum("n_class").over(w_by)).withColumn("_draws", draws.cast("long"))
    cont = F.col("n_class") / F.col("n_total") * F.col("_draws")
    t = t.withColumn("_fl", F.floor(cont)).withColumn("_rem", cont - F.floor(cont))
    t = t.withColumn("_need", F.col("_draws") - F.sum("_fl").over(w_by))
    w_rank = (Window.partitionBy(*_c(by)) if by else Window.partitionBy(F.lit(0))).orderBy(F.col("_rem").desc(), F.col(y))
    t = t.withColumn("_r", F.row_number().over(w_rank))
    t = t.withColumn(out, (F.col("_fl") + F.when(F.col("_r") <= F.col("_need"), 1).otherwise(0)).cast("long"))
    return t.drop("_draws", "_fl", "_rem", "_need", "_r")


def stratified_split(df: DataFrame, y: str = "y", test_size: float = 0.2, seed: int = 42,
                     by: Sequence[str] = (), id_col: str = "row_id") -> DataFrame:
    """Adds ``split`` ('train' / 'test'): n_test = ceil(n * test_size) per stratum ``by``; the
    train share of every class by largest remainder, the test gets the rest of each class.
    With one class it is a plain split of the same sizes."""
    by = list(by)
    counts = class_counts(df, y, by)
    n_test = F.ceil(F.lit(float(test_size)) * F.col("n_total"))
    alloc = allocate(counts, F.col("n_total") - n_test, y, by, "n_train")
    ranked = hash_rank(df, [*by, y], seed, id_col)
    j = ranked.join(alloc.select(*by, y, "n_train"), [*by, y])
    return j.withColumn("split", F.when(F.col("_rank") < F.col("n_train"), "train").otherwise("test")).drop(
        "_rank", "_n", "n_train")


def stratified_kfold(df: DataFrame, y: str = "y", k: int = 5, seed: int = 42, by: Sequence[str] = (),
                     id_col: str = "row_id") -> DataFrame:
    """Adds ``fold`` 0..k-1: the hash rank within the class modulo k (class shares per fold
    differ by at most one row)."""
    ranked = hash_rank(df, [*by, y], seed, id_col)
    return ranked.withColumn("fold", F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop("_rank", "_n")


def stratified_sample(df: DataFrame, y: str = "y", n: int = 1000, seed: int = 42, by: Sequence[str] = (),
                      id_col: str = "row_id") -> DataFrame:
    """At most n rows per stratum keeping class shares (largest remainder); all rows when n >= size."""
    by = list(by)
    counts = class_counts(df, y, by)
    alloc = allocate(counts, F.least(F.lit(int(n)), F.col("n_total")), y, by, "n_take")
    ranked = hash_rank(df, [*by, y], seed, id_col)
    j = ranked.join(alloc.select(*by, y, "n_take"), [*by, y])
    return j.where(F.col("_rank") < F.col("n_take")).drop("_rank", "_n", "n_take")


def uniform_sample(df: DataFrame, n: int, seed: int = 42, by: Sequence[str] = (), id_col: str = "row_id") -> DataFrame:
    """n rows without replacement per stratum, by seeded hash order (exact size, no driver sort)."""
    ranked = hash_rank(df, list(by), seed, id_col)
    return ranked.where(F.col("_rank") < n).drop("_rank", "_n")


def oversample_random(df: DataFrame, y: str = "y", seed: int = 42, by: Sequence[str] = (),
                      id_col: str = "row_id") -> DataFrame:
    """Every class topped up to the majority count by drawing its own rows with replacement.

    Adds ``copy_no`` (0 for the original rows). The extra draws are numbered in chunks (distributed)
    and resolved to rows by an equi-join on (class, hash rank)."""
    by = list(by)
    counts = class_counts(df, y, by)
    w_by = Window.partitionBy(*_c(by)) if by else Window.partitionBy(F.lit(0))  # over the class table only
    need = counts.withColumn("n_extra", F.max("n_class").over(w_by) - F.col("n_class")).where(F.col("n_extra") > 0)
    ranked = hash_rank(df, [*by, y], seed, id_col)
    base = ranked.drop("_rank", "_n").withColumn("copy_no", F.lit(0))
    d = numbered(need.select(*by, y, "n_class", "n_extra"), "n_extra", "_j")
    d = d.withColumn("_rank", F.pmod(hash_key(seed + 1, *by, y, "_j"), F.col("n_class")))
    d = d.withColumn("copy_no", (F.col("_j") + 1).cast("int"))
    extra = d.select(*by, y, "_rank", "copy_no").join(ranked.drop("_n"), [*by, y, "_rank"]).drop("_rank")
    return base.unionByName(extra.select(*base.columns))


def numbered(df: DataFrame, count_col: str, number_col: str, chunk: int = 100_000) -> DataFrame:
    """Each row repeated ``count_col`` times with a number from 0. Counts are first cut into chunks
    that are spread over the cluster, so one row with a huge count is no single task."""
    last = F.floor((F.col(count_col) - 1) / chunk)
    chunks = df.where(F.col(count_col) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    chunks = chunks.repartition(*[c for c in chunks.columns])
    upto = F.least((F.col("_chunk") + 1) * chunk, F.col(count_col)) - 1
    return chunks.withColumn(number_col, F.explode(F.sequence(F.col("_chunk") * chunk, upto))).drop("_chunk", count_col)


def bootstrap_draws(df: DataFrame, b: int = 50, seed: int = 42, by: Sequence[str] = ("dataset",),
                    id_col: str = "row_id") -> DataFrame:
    """(by..., b, row_id, weight): B resamples of size n with replacement per stratum.

    Draw i of replicate b picks rank pmod(hash(seed, stratum, b, i), n); the B*n draws are numbered
    in chunks, counted, and resolved by an equi-join on the exact hash rank. The draws are dealt once, by
    what the join needs: the counts of all replicates of a row are made where the row is."""
    by = list(by)
    ranked = hash_rank(df.select(*by, id_col), by, seed, id_col)
    # not ``small_side``: its hint would pass through to the join, and the driver would hold every drawn row
    sizes = cut_lineage(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    draws = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).withColumn("_count", F.col("_n"))
    d = numbered(draws, "_count", "_i")
    d = d.withColumn("_rank", F.pmod(hash_key(seed, *by, "b", "_i"), F.col("_n")))
    d = d.select(*by, "b", "_rank").repartition(*by, "_rank")
    picks = d.groupBy(*by, "b", "_rank").agg(F.count(F.lit(1)).alias("weight"))
    # numbers pack so well that either side may pass for a small table, whose every row the driver would hold
    return picks.join(ranked.select(*by, "_rank", id_col).hint("merge"), [*by, "_rank"]).select(*by, "b", id_col, "weight")


def permute_labels(df: DataFrame, y: str = "y", seed: int = 42, by: Sequence[str] = (), id_col: str = "row_id") -> DataFrame:
    """Shuffle y against the features: the row at hash rank r (seed) takes the label of the row
    at rank r under a second seed. Class counts stay the same."""
    by = list(by)
    a = hash_rank(df.drop(y), by, seed, id_col).drop("_n")
    lab = hash_rank(df.select(*by, id_col, y), by, seed + 7919, id_col).select(*by, "_rank", y)
    return a.join(lab, [*by, "_rank"]).drop("_rank")


# ---------------------------------------------------------------- class balance reporting

def class_balance(stages: dict[str, DataFrame], y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """stage, class, n for each named table (e.g. raw, train, train_balanced)."""
    out = None
    for name, df in stages.items():
        t = df.groupBy(*by, F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out.select("stage", *by, "class", "n")


def smote_preview(df: DataFrame, y: str = "y", test_size: float = 0.2, seed: int = 42,
                  by: Sequence[str] = ()) -> DataFrame:
    """Class counts the model would see after the split and SMOTE: every class raised to the
    majority count of the train split; an error text instead when there are fewer than 2 classes."""
    by = list(by)
    train = stratified_split(df, y, test_size, seed, by).where(F.col("split") == "train")
    c = train.groupBy(*by, F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n_before"))
    w = Window.partitionBy(*_c(by)) if by else Window.partitionBy(F.lit(0))
    c = c.withColumn("_k", F.count(F.lit(1)).over(w)).withColumn("_max", F.max("n_before").over(w))
    return c.select(*by, "class", "n_before",
                    F.when(F.col("_k") >= 2, F.col("_max")).alias("n_after"),
                    F.when(F.col("_k") < 2, F.lit("SMOTE needs at least two classes")).alias("error"))


def smote_distribution(before: DataFrame, after: DataFrame, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """class, n0, n1, pct0, pct1 (half-even to 0 dp); classes joined by value, not by position."""
    by = list(by)
    b = before.groupBy(*by, F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n0"))
    a = after.groupBy(*by, F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n1"))
    j = b.join(a, [*by, "class"], "full")
    w = Window.partitionBy(*_c(by)) if by else Window.partitionBy(F.lit(0))
    j = j.withColumn("n0", F.coalesce("n0", F.lit(0))).withColumn("n1", F.coalesce("n1", F.lit(0)))
    return j.select(*by, "class", "n0", "n1",
                    F.bround(F.col("n0") * 100.0 / F.sum("n0").over(w), 0).alias("pct0"),
                    F.bround(F.col("n1") * 100.0 / F.sum("n1").over(w), 0).alias("pct1"))


def split_sizes(n: int, test_size: float) -> tuple[int, int]:
    """(n_train, n_test) of a split: n_test = ceil(n * test_size)."""
    t = math.ceil(test_size * n)
    return n - t, t


def smote(df: DataFrame, features: Sequence[str], y: str = "y", k: int = 5, seed: int = 42,
          id_col: str = "row_id", by: Sequence[str] = ()) -> DataFrame:
    """SMOTE: every smaller class is topped up to the majority count with points x + u (nn - x),
    nn one of the k nearest same-class neighbours of x (k reduced to class size - 1 when small).

    Adds ``synthetic`` (false for the input rows). Neighbours come from the exact ``knn_join``;
    the base row, the neighbour and u are seeded hashes of the synthetic index. With ``by`` each dataset is
    topped up on its own (ids of synthetic rows are unique within a dataset). With one class,
    or a class of a single row, the input is returned unchanged (as the reference does on failure).
    """
    from scorelab.operators.neighbours import knn_join

    if by:  # a dataset at a time: neighbours and class sizes are its own
        keys = [tuple(r) for r in df.select(*by).distinct().orderBy(*by).collect()]  # a row a dataset
        own = lambda key: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, key, strict=True)])
        parts = []
        for key in keys:
            part = smote(df.where(own(key)), features, y, k, seed, id_col)
            for c, v in zip(by, key, strict=True):  # synthetic rows belong to the dataset too
                part = part.withColumn(c, F.lit(v).cast(df.schema[c].dataType))
            parts.append(part)
        return reduce(DataFrame.unionByName, parts) if parts else df.withColumn("synthetic", F.lit(False))
    feats = list(features)
    base = df.withColumn("synthetic", F.lit(False))
    counts = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    if len(counts) < 2:
        return base
    n_max = max(counts.values())
    spark = df.sparkSession
    out = base
    for cls, n_c in sorted(counts.items()):
        need = n_max - n_c
        if need <= 0 or n_c < 2:
            continue
        kk = min(k, n_c - 1)
        members = df.where(F.col(y) == F.lit(cls))
        nn = knn_join(members, members, feats, kk, qid=id_col, rid=id_col, exclude_self=True, seed=seed)
        ranked = hash_rank(members, [], seed, id_col).drop("_n")
        draws = spark.range(need).withColumnRenamed("id", "_j")
        draws = draws.withColumn("_rank", F.pmod(hash_key(seed, F.lit(cls), F.col("_j")), F.lit(n_c))).withColumn(
            "nn_rank", (F.pmod(hash_key(seed + 1, F.lit(cls), F.col("_j")), F.lit(kk)) + 1).cast("int")).withColumn(
            "_u", (F.pmod(hash_key(seed + 2, F.lit(cls), F.col("_j")), F.lit(1 << 53)) / float(1 << 53)))
        x = draws.join(ranked.select("_rank", F.col(id_col).alias("q_id"), *feats), "_rank")
        x = x.join(nn.select("q_id", "nn_rank", "r_id"), ["q_id", "nn_rank"])
        z = members.select(F.col(id_col).alias("r_id"), *[F.col(c).alias(f"_z_{c}") for c in feats])
        x = x.join(z, "r_id")
        syn = x.select(*[(F.col(c) + F.col("_u") * (F.col(f"_z_{c}") - F.col(c))).alias(c) for c in feats],
                       (-(F.col("_j") + 1) - F.lit(int(cls)) * F.lit(1 << 40)).alias(id_col))
        syn = syn.withColumn(y, F.lit(cls).cast(df.schema[y].dataType)).withColumn("synthetic", F.lit(True))
        for c in df.columns:
            if c not in syn.columns:
                syn = syn.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
        out = out.unionByName(syn.select(*base.columns))
    return out
