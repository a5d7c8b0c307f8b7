"""Explanations: Shapley tables, their summaries, local records, perturbations.

The central table is long: ``shap(dataset, model, row_id, feature, feature_value, phi, base_value)``.
Summaries are ``groupBy`` aggregates over it; rankings use a full tie-break (value, feature).

Scorers are plain functions ``DataFrame -> DataFrame`` that add ``p`` (probability of class 1)
and optionally ``logit``; ``linear_scorer`` builds one from fixed coefficients and
``scorelab.operators.learn.ml_scorer`` wraps any fitted Spark ML model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelab.operators.tree_shap import tree_interactions, tree_shapley
from scorelab.plans.ranks import exact_quantiles, hash_key, hash_rank, small_side
from scorelab.session import cut_lineage

Scorer = Callable[[DataFrame], DataFrame]


# ---------------------------------------------------------------- linear scorer

def linear_logit(coefs: dict[str, float], intercept: float) -> Column:
    """b + sum w_j x_j, a null feature counting as 0."""
    e = F.lit(float(intercept))
    for c, w in coefs.items():
        e = e + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w))
    return e


def linear_scorer(coefs: dict[str, float], intercept: float) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        lg = linear_logit(coefs, intercept)
        return df.withColumn("logit", lg).withColumn("p", 1.0 / (1.0 + F.exp(-F.col("logit"))))
    return score


def score_linear(df: DataFrame, coefs: dict[str, float], intercept: float, model: str = "linear_fixed",
                 model_group: str = "linear", threshold: float = 0.5) -> DataFrame:
    """scores rows (dataset, model_group, model, row_id, y, p, pred) of a fixed logistic scorer."""
    s = linear_scorer(coefs, intercept)(df)
    return s.select("dataset", F.lit(model_group).alias("model_group"), F.lit(model).alias("model"), "row_id", "y",
                    "p", (F.col("p") >= threshold).cast("int").alias("pred"))


# ---------------------------------------------------------------- exact Shapley of a linear scorer

def shapley_linear(rows: DataFrame, background: DataFrame, coefs: dict[str, float], intercept: float,
                   group: Sequence[str] = ("dataset",), model: str = "linear_fixed") -> DataFrame:
    """phi_j = w_j (x_j - E_bg[x_j]) on the log-odds, base = b + sum w_j E_bg[x_j] (exact for
    independent features). Background means are one aggregate per group (features x groups)."""
    g = list(group)
    feats = list(coefs)
    bg_keys = [c for c in g if c in background.columns]  # no shared key: one pooled background
    means = background.groupBy(*bg_keys).agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_m_{c}")
                                               for c in feats])
    base = F.lit(float(intercept))
    for c in feats:
        base = base + F.lit(float(coefs[c])) * F.col(f"_m_{c}")
    if bg_keys:
        j = rows.join(means, bg_keys)
    else:  # one row of means (features wide), broadcast
        j = rows.withColumn("_k", F.lit(1)).join(F.broadcast(means.withColumn("_k", F.lit(1))), "_k").drop("_k")
    parts = F.array(*[F.struct(F.lit(c).alias("feature"),
                               F.col(c).cast("double").alias("feature_value"),
                               (F.lit(float(coefs[c])) * (F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                                                          - F.col(f"_m_{c}"))).alias("phi"))
                      for c in feats])
    return j.select(*g, F.lit(model).alias("model"), "row_id", base.alias("base_value"), F.inline(parts)).select(
        *g, "model", "row_id", "feature", "feature_value", "phi", "base_value")


# ---------------------------------------------------------------- model-agnostic sampling Shapley

def shapley_rows(scorer: Scorer, rows: DataFrame, background: DataFrame, features: Sequence[str],
                 draws: int = 16, seed: int = 42, group: Sequence[str] = ("dataset",), model: str = "model",
                 output: str = "p") -> DataFrame:
    """Permutation-sampling Shapley values of ``scorer`` for every row.

    For each (row, draw): one background row z (hash pick), one feature order (hash ranks), and
    its reverse (antithetic pair). The d+1 coalition rows x[S] + z[not S] along the order are scored
    in one ``scorer`` call; phi_j of the draw is f(after j) - f(before j); the average over draws
    is the estimate. sum_j phi_j = f(x) - f(z) holds exactly for every draw.

    A scorer of trees is not sampled: its values are exact, on the scale its trees add up on (log-odds of
    boosted trees, p of a forest), and need no background.
    """
    g = list(group)
    if getattr(scorer, "trees", None) is not None:
        return tree_shapley(scorer.trees(), rows, features, g, model)
    feats = list(features)
    d = len(feats)
    bg = hash_rank(background.select(*g, *feats, "row_id"), g, seed + 11)
    sizes = small_side(background.groupBy(*g).agg(F.count(F.lit(1)).alias("_nbg")))
    r = rows.select(*g, "row_id", *feats).join(sizes, g)
    # both orders of a pair meet the same background row: one row a pair is dealt to it
    r = r.withColumn("_pair", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    r = r.withColumn("_rank", F.pmod(hash_key(seed, F.col("row_id"), F.col("_pair")), F.col("_nbg"))).drop("_nbg")
    z = bg.select(*g, "_rank", *[F.col(c).alias(f"_z_{c}") for c in feats])
    r = r.join(z, [*g, "_rank"]).drop("_rank")
    # feature order: rank of hash(seed, row, pair, j); odd draws walk it backwards
    keys = [hash_key(seed + 3, F.col("row_id"), F.col("_pair"), F.lit(j)) for j in range(d)]
    order_arr = F.array_sort(F.array(*[F.struct(keys[j].alias("k"), F.lit(j).alias("j")) for j in range(d)]))
    r = r.withColumn("_ord", F.transform(order_arr, lambda s: s["j"]))
    r = r.withColumn("_ord", F.explode(F.array(F.col("_ord"), F.reverse("_ord"))))
    # coalition k = first k features of the order taken from x
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_k"))
    mixed = []
    for j, c in enumerate(feats):
        in_s = F.array_position(F.slice(F.concat(F.col("_ord"), F.array(F.lit(-1))), 1, F.col("_k")), j) > 0
        mixed.append(F.when(in_s, F.col(c)).otherwise(F.col(f"_z_{c}")).alias(c))
    # a coalition's value counts for the feature that came in last and against the one that comes next, so the
    # steps of all draws are one sum a feature: coalitions are added up where they are made
    at = lambda k: F.get(F.col("_ord"), k)
    coal = r.select(*g, "row_id", "_k", at(F.col("_k") - 1).alias("_in"), at(F.col("_k")).alias("_out"), *mixed)
    scored = scorer(coal).select(*g, "row_id", "_k", "_in", "_out", F.col(output).alias("_f"))
    step = lambda j: F.when(F.col("_in") == j, F.col("_f")).when(F.col("_out") == j, -F.col("_f"))
    start = F.when(F.col("_k") == 0, F.col("_f"))
    per = scored.groupBy(*g, "row_id").agg(*[F.sum(step(j)).alias(f"_s{j}") for j in range(d)], F.avg(start).alias("base_value"),
                                           F.count(F.when(F.col("_k") == 0, 1)).alias("_walks"))
    # rows that share an id share its steps: the id's mean goes over the walks of all of them
    shared = F.col("_walks") * F.col("_walks") / F.lit(2.0 * draws)
    each = rows.select(*g, "row_id", *[F.col(c).alias(f"_x{j}") for j, c in enumerate(feats)]).join(per, [*g, "row_id"])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_x{j}").cast("double").alias("feature_value"), (F.col(f"_s{j}") / shared).alias("phi"))
                      for j, c in enumerate(feats)])
    return each.select(*g, F.lit(model).alias("model"), "row_id", "base_value", F.inline(parts)).select(
        *g, "model", "row_id", "feature", "feature_value", "phi", "base_value")


# ---------------------------------------------------------------- summaries of a Shapley table

def shap_global(phi: DataFrame, group: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """rank, feature, abs_mean_shap, mean_shap, std_shap (population) per group; rank by
    abs_mean_shap descending, ties by feature name."""
    g = list(group)
    t = phi.groupBy(*g, "feature").agg(F.avg(F.abs("phi")).alias("abs_mean_shap"), F.avg("phi").alias("mean_shap"),
                                       F.stddev_pop("phi").alias("std_shap"))
    w = Window.partitionBy(*g).orderBy(F.col("abs_mean_shap").desc(), "feature")
    return t.withColumn("rank", F.row_number().over(w))


def shap_importance(phi: DataFrame, group: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """dataset, model, feature, importance = mean |phi|."""
    return phi.groupBy(*group, "feature").agg(F.avg(F.abs("phi")).alias("importance"))


def shap_wide(phi: DataFrame, features: Sequence[str], group: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """One ``{feature}_shap`` column per feature, one row per explained row."""
    g = list(group)
    p = phi.groupBy(*g, "row_id").pivot("feature", list(features)).agg(F.first("phi"))
    return p.select(*g, "row_id", *[F.col(f"`{c}`").alias(f"{c}_shap") for c in features])


def shap_direction(global_tbl: DataFrame, group: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """feature, sign of the mean phi in {-1, 0, 1}."""
    return global_tbl.select(*group, "feature", F.signum("mean_shap").cast("int").alias("sign"))


def perturbation_sets(direction: DataFrame, numeric: Sequence[str], immutable: Sequence[str] = (),
                      group: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Mutable numeric features to raise (sign < 0), to lower (sign > 0), and the immutable ones;
    each list sorted."""
    g = list(group)
    d = direction.where(F.col("feature").isin(list(numeric)))
    mut = ~F.col("feature").isin(list(immutable)) if immutable else F.lit(True)
    return d.groupBy(*g).agg(
        F.sort_array(F.collect_list(F.when(mut & (F.col("sign") < 0), F.col("feature")))).alias("s_up"),
        F.sort_array(F.collect_list(F.when(mut & (F.col("sign") > 0), F.col("feature")))).alias("s_down"),
        F.sort_array(F.collect_list(F.when(~mut, F.col("feature")))).alias("s_immutable"),
    )


def trial_ranks(phi: DataFrame, trial: str = "trial", group: Sequence[str] = ("model",), base: int = 1) -> DataFrame:
    """Rank of every feature inside each trial by mean |phi| (descending, ties by name)."""
    g = list(group)
    t = phi.groupBy(*g, trial, "feature").agg(F.avg(F.abs("phi")).alias("abs_mean"))
    w = Window.partitionBy(*g, trial).orderBy(F.col("abs_mean").desc(), "feature")
    return t.withColumn("rank", F.row_number().over(w) - 1 + base)


def rank_stability(phi: DataFrame, trial: str = "trial", group: Sequence[str] = ("model",)) -> DataFrame:
    """feature, avg_rank, std_rank (population) over trials; ranks from 1."""
    r = trial_ranks(phi, trial, group, base=1)
    return r.groupBy(*group, "feature").agg(F.avg("rank").alias("avg_rank"), F.stddev_pop("rank").alias("std_rank"))


def shap_stable(phi: DataFrame, trial: str = "trial", group: Sequence[str] = ("model",)) -> DataFrame:
    """Pooled over trials: mean |phi|, mean phi, std phi (population); per-trial ranks from 0
    averaged (avg_rank, std_rank)."""
    g = list(group)
    pooled = phi.groupBy(*g, "feature").agg(F.avg(F.abs("phi")).alias("abs_mean_shap"), F.avg("phi").alias("mean_shap"),
                                            F.stddev_pop("phi").alias("std_shap"))
    r = trial_ranks(phi, trial, g, base=0).groupBy(*g, "feature").agg(
        F.avg("rank").alias("avg_rank"), F.stddev_pop("rank").alias("std_rank"))
    return pooled.join(r, [*g, "feature"])


#: Fixed values: (trials, background rows) of the stability runs, from a quick look to a thorough one.
PRESETS = {"minimal": (1, 20), "quick": (3, 50), "balanced": (10, 200), "thorough": (30, 500)}


def _windows(df: DataFrame, size: Column, trials: int) -> DataFrame:
    """Rows with ``_rank`` in a cycle of ``_n`` rows, once for each trial (column ``trial``) whose window of
    ``size`` ranks they fall into; windows follow each other and start again at the end."""
    inside = F.filter(F.sequence(F.lit(0), F.lit(trials - 1)), lambda t: F.pmod(F.col("_rank") - t * size, F.col("_n")) < F.least(size, F.col("_n")))
    return df.withColumn("trial", F.explode(inside)).drop("_rank", "_n")


def trial_samples(train: DataFrame, test: DataFrame, trials: int, bg: int, explain: int, seed: int = 42,
                  y: str = "y", group: Sequence[str] = ("dataset",)) -> tuple[DataFrame, DataFrame]:
    """(background, explain) tables with a ``trial`` column: in every trial a background of ``bg`` train rows
    with the classes in proportion (largest remainders) and ``explain`` test rows. Rows are ranked by hash once;
    a trial is a range of ranks, so rows repeat only when all have been used, and the numbers are the
    same under any partitioning."""
    g = list(group)
    sizes = train.groupBy(*g, y).agg(F.count(F.lit(1)).alias("_c"))
    exact = F.lit(bg) * F.col("_c") / F.sum("_c").over(Window.partitionBy(*g))
    order = Window.partitionBy(*g).orderBy(F.desc(F.col("_x") - F.floor("_x")), y)
    spare = F.lit(bg) - F.sum(F.floor("_x")).over(Window.partitionBy(*g))
    quota = sizes.withColumn("_x", exact).withColumn("_q", F.floor("_x") + F.when(F.row_number().over(order) <= spare, 1).otherwise(0))
    ranked = hash_rank(train, [*g, y], seed).join(small_side(quota.select(*g, y, "_q")), [*g, y])
    return _windows(ranked, F.col("_q"), trials).drop("_q"), _windows(hash_rank(test, g, seed + 7), F.lit(explain).cast("long"), trials)


def trial_shapley(scorer: Scorer, train: DataFrame, test: DataFrame, features: Sequence[str], trials: int = 10, bg: int = 200, explain: int = 100,
                  draws: int = 8, seed: int = 42, y: str = "y", group: Sequence[str] = ("dataset",), model: str = "model") -> DataFrame:
    """The Shapley table of every trial of a fitted scorer, with a ``trial`` column, in one scoring plan."""
    g = [*group, "trial"]
    back, rows = trial_samples(train, test, trials, bg, explain, seed, y, group)
    return shapley_rows(scorer, cut_lineage(rows), cut_lineage(back), features, draws, seed, g, model)



# ---------------------------------------------------------------- local records

def local_explanation(phi: DataFrame, scores: DataFrame, ids: Sequence | None = None,
                      group: Sequence[str] = ("dataset", "model"), threshold: float = 0.5) -> DataFrame:
    """For chosen rows: true label, predicted class (p > t), p, feature values and phi as maps."""
    g = list(group)
    ph = phi if not ids else phi.where(F.col("row_id").isin(list(ids)))
    maps = ph.groupBy(*g, "row_id").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "feature_value"))).alias("feature_values"),
        F.map_from_entries(F.collect_list(F.struct("feature", "phi"))).alias("shap_values"))
    s = scores.select(*g, "row_id", "y", "p")
    j = maps.join(s, [*g, "row_id"])
    return j.select(*g, F.col("row_id").alias("instance_idx"), F.col("y").alias("true_label"),
                    (F.col("p") > threshold).cast("int").alias("pred_label"), F.col("p").alias("pred_proba"),
                    "feature_values", "shap_values")


def explanation_payload(phi: DataFrame, scores: DataFrame, n: int = 10, group: Sequence[str] = ("dataset", "model"),
                        threshold: float = 0.5) -> DataFrame:
    """Per row: the n largest |phi| features (feature, value, phi) in order, class at 0.5, confidence."""
    g = list(group)
    w = Window.partitionBy(*g, "row_id").orderBy(F.abs("phi").desc(), "feature")
    top = phi.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    arr = top.groupBy(*g, "row_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("_r").alias("pos"), "feature", F.col("feature_value").alias("value"), "phi"))).alias("_t"))
    arr = arr.select(*g, "row_id", F.transform("_t", lambda s: F.struct(s["feature"].alias("feature"),
                                                                        s["value"].alias("value"),
                                                                        s["phi"].alias("phi"))).alias("top_features"))
    s = scores.select(*g, "row_id", "p")
    return arr.join(s, [*g, "row_id"]).select(
        *g, "row_id", "top_features", (F.col("p") >= threshold).cast("int").alias("predicted_class"),
        F.greatest(F.col("p"), 1 - F.col("p")).alias("confidence"))


# ---------------------------------------------------------------- perturbation helpers

def clip_bounds(df: DataFrame, lower: dict[str, float] | None = None, upper: dict[str, float] | None = None) -> DataFrame:
    lower, upper = lower or {}, upper or {}
    cols = []
    for c in df.columns:
        e = F.col(c)
        if c in lower:
            e = F.greatest(e, F.lit(float(lower[c])))
        if c in upper:
            e = F.least(e, F.lit(float(upper[c])))
        cols.append(e.alias(c) if (c in lower or c in upper) else F.col(c))
    return df.select(*cols)


def gower_expr(a: Sequence[Column], b: Sequence[Column], weights: Sequence[float], is_cat: Sequence[bool]) -> Column:
    """Weighted Gower distance: numeric min(1, |a - b|), categorical mismatch 0/1, weights
    normalised by (sum + 1e-12)."""
    tot = float(sum(weights)) + 1e-12
    e = F.lit(0.0)
    for x, z, w, cat in zip(a, b, weights, is_cat):
        d = F.when(x != z, 1.0).otherwise(0.0) if cat else F.least(F.lit(1.0), F.abs(x - z))
        e = e + F.lit(float(w) / tot) * d
    return e


def gower_distance(rows: DataFrame, ref: DataFrame, features: Sequence[str], weights: Sequence[float],
                   cat_cols: Sequence[str] = (), on: Sequence[str] = ("dataset",)) -> DataFrame:
    """Distance of every row to its reference row (one reference per ``on`` key)."""
    on = list(on)
    r = ref.select(*on, *[F.col(c).alias(f"_r_{c}") for c in features])
    j = rows.join(r, on)
    d = gower_expr([F.col(c) for c in features], [F.col(f"_r_{c}") for c in features], weights,
                   [c in cat_cols for c in features])
    return j.select(*on, "row_id", d.alias("gower"))


def step_sizes(train: DataFrame, features: Sequence[str], step: float = 0.05) -> dict[str, float]:
    """step * IQR per feature (population std + 1e-6 when the IQR is 0). Bounded by features."""
    q = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(train, features, [0.25, 0.75]).collect()}
    sd = train.agg(*[F.stddev_pop(c).alias(c) for c in features]).first()
    out = {}
    for c in features:
        iqr = (q.get((c, 0.75)) or 0.0) - (q.get((c, 0.25)) or 0.0)
        out[c] = step * (iqr if iqr > 0 else ((sd[c] or 0.0) + 1e-6))
    return out


def step_candidates(rows: DataFrame, directions: dict[str, int], steps: dict[str, float],
                    immutable: Sequence[str] = (), keep: Sequence[str] = ("dataset", "row_id")) -> DataFrame:
    """One neighbour per mutable feature with a direction: that feature moved by sign * step."""
    moves = [(f, s * steps.get(f, 0.0)) for f, s in directions.items()
             if f not in immutable and s != 0 and steps.get(f, 0.0) != 0.0]
    feats = list(dict.fromkeys([*directions]))
    arr = F.array(*[F.struct(F.lit(f).alias("moved"), F.lit(float(d)).alias("delta")) for f, d in moves])
    t = rows.select(*keep, *feats, F.inline(arr))
    return t.select(*keep, "moved", *[F.when(F.col("moved") == f, F.col(f) + F.col("delta")).otherwise(F.col(f)).alias(f)
                                      for f in feats])


def partial_dependence(scorer: Scorer, rows: DataFrame, feature: str, grid: int = 20, n_ice: int = 50,
                       seed: int = 42, group: Sequence[str] = ("dataset",), probs=(0.05, 0.95)) -> DataFrame:
    """(group, row_id | null, value, p): ICE curves of n_ice hash-chosen rows and the PD mean
    over all rows, on ``grid`` points evenly spaced between the 5th and 95th percentiles."""
    g = list(group)
    q = exact_quantiles(rows, [feature], list(probs), group=g)
    lo = q.where(F.col("prob") == probs[0]).select(*g, F.col("value").alias("_lo"))
    hi = q.where(F.col("prob") == probs[1]).select(*g, F.col("value").alias("_hi"))
    j = rows.join(lo, g).join(hi, g)
    pts = F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("_i")
    j = j.select("*", pts)
    val = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_i") / F.lit(max(grid - 1, 1))
    j = j.withColumn(feature, val).withColumn("value", val)
    s = scorer(j)
    pd_mean = s.groupBy(*g, "_i", "value").agg(F.avg("p").alias("p")).select(
        *g, F.lit(None).cast("long").alias("row_id"), "value", "p")
    ice_ids = hash_rank(rows.select(*g, "row_id"), g, seed).where(F.col("_rank") < n_ice).select(*g, "row_id")
    ice = s.join(ice_ids, [*g, "row_id"]).select(*g, "row_id", "value", "p")
    return pd_mean.unionByName(ice)


def pair_interactions(scorer: Scorer, rows: DataFrame, background: DataFrame, features: Sequence[str], k: int = 10,
                      group: Sequence[str] = ("dataset",)) -> DataFrame:
    """Top-k unordered feature pairs by mean |f(x_ab) - f(x_a) - f(x_b) + f(x)| where x_S puts
    the background mean in the features of S (a second difference; zero for additive scorers). For a
    scorer of trees the strength is the mean |Shapley interaction| of the pair, exact."""
    g = list(group)
    if getattr(scorer, "trees", None) is not None:
        return tree_interactions(scorer.trees(), rows, features, k, g)
    feats = list(features)
    bg_keys = [c for c in g if c in background.columns]
    means = small_side(background.groupBy(*bg_keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in feats]).withColumn("_k", F.lit(1)))
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i + 1:]]
    variants = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(m).alias("mask")) for i in range(len(pairs)) for m in range(4)])
    j = rows.select(*g, "row_id", *feats).withColumn("_k", F.lit(1)).join(means, [*bg_keys, "_k"]).drop("_k").select(
        "*", F.inline(variants))
    cols = []
    for c in feats:
        first, second = ([i for i, p in enumerate(pairs) if p[side] == c] for side in (0, 1))
        put = (F.col("pair").isin(first) & (F.col("mask").bitwiseAND(1) == 1)) | (F.col("pair").isin(second) & (F.col("mask").bitwiseAND(2) == 2))
        cols.append(F.when(put, F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c))
    v = scorer(j.select(*g, "row_id", "pair", "mask", *cols)).select(*g, "row_id", "pair", "mask", "p")
    signed = F.when(F.col("mask").isin(0, 3), F.col("p")).otherwise(-F.col("p"))
    # one row an id is shuffled, whatever the number of pairs
    second = v.groupBy(*g, "row_id").agg(*[F.sum(F.when(F.col("pair") == i, signed)).alias(f"_d{i}") for i in range(len(pairs))])
    mean = second.groupBy(*g).agg(*[F.avg(F.abs(f"_d{i}")).alias(f"_d{i}") for i in range(len(pairs))])
    strength = mean.select(*g, F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_d{i}").alias("strength"))
                                                  for i, (a, b) in enumerate(pairs)])))
    w = Window.partitionBy(*g).orderBy(F.col("strength").desc(), "a", "b")
    return strength.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def counterfactuals(scorer: Scorer, rows: DataFrame, directions: dict[str, int], steps: dict[str, float],
                    weights: dict[str, float], immutable: Sequence[str] = (), lower: dict | None = None,
                    upper: dict | None = None, beam: int = 20, max_steps: int = 30, alpha: float = 1.0,
                    beta: float = 0.01, group: Sequence[str] = ("dataset",), threshold: float = 0.5) -> DataFrame:
    """Beam search for the nearest class flip of many rows at once.

    State rows (instance, features, changes) expand to one neighbour per mutable feature,
    are clipped to bounds, scored, and the ``beam`` lowest objectives alpha * Gower + beta *
    changes are kept per instance (a per-instance window). A state whose class at 0.5 differs
    from the instance's original class ends the search for that instance. Lineage is cut with
    a reliable checkpoint every step.

    One row per instance: ``found`` tells whether a flip was met within ``max_steps``; without one
    the features, changes, objective and proba are null.
    """
    g = list(group)
    feats = list(directions)
    wts = [weights.get(f, 0.0) for f in feats]
    orig = scorer(rows.select(*g, "row_id", *feats)).select(
        *g, "row_id", (F.col("p") >= threshold).cast("int").alias("_c0"),
        *[F.col(f).alias(f"_x0_{f}") for f in feats])
    orig = cut_lineage(orig)  # read in every step
    key, start = [*g, "row_id"], [f"_x0_{f}" for f in feats]
    own = cut_lineage(orig.groupBy(*key, "_c0", *start).agg(F.count(F.lit(1)).alias("_copies")))
    state = own.select(*key, *[F.col(f"_x0_{f}").alias(f) for f in feats], F.lit(0).alias("changes"), F.col("_copies").alias("_times"))
    found = None
    for _ in range(max_steps):
        cand = step_candidates(state, directions, steps, immutable, keep=[*key, "changes", "_times"]).drop("moved")
        cand = clip_bounds(cand, lower, upper).withColumn("changes", F.col("changes") + 1).join(own, key)
        # the same moves in another order lead to the same state: it is held once, with the places it takes
        cand = cand.groupBy(*key, *feats, "changes", "_c0", *start).agg(F.sum(F.col("_times") * F.col("_copies")).alias("_times"))
        dist = gower_expr([F.col(f) for f in feats], [F.col(f"_x0_{f}") for f in feats], wts, [False] * len(feats))
        sc = scorer(cand).withColumn("objective", F.lit(alpha) * dist + F.lit(beta) * F.col("changes"))
        # one pass per step: the beam of the next step and the flips found in this one are both
        # derived from the step's scored candidates, written once (the hits then read that file); all
        # windows share one order
        inside = Window.partitionBy(*key)
        wk = inside.orderBy("objective", *feats)
        upto = wk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        flips = F.col("_flip").cast("int")
        step_tbl = cut_lineage(sc.withColumn("_flip", (F.col("p") >= threshold).cast("int") != F.col("_c0"))
                               .withColumn("_rf", F.sum(flips).over(upto)).withColumn("_any", F.max(flips).over(inside))
                               .withColumn("_room", F.lit(beam) - F.sum("_times").over(upto) + F.col("_times"))
                               .where((F.col("_flip") & (F.col("_rf") == 1)) | ((F.col("_any") == 0) & (F.col("_room") > 0)))
                               .withColumn("_times", F.least("_times", "_room")))
        hit = step_tbl.where(F.col("_flip")).select(*key, *feats, "changes", "objective", F.col("p").alias("proba"))
        found = hit if found is None else found.unionByName(hit)
        state = step_tbl.where(F.col("_any") == 0).select(*key, *feats, "changes", "_times")
        if state.isEmpty():
            break
    if found is None:  # no step allowed
        found = orig.select(*g, "row_id", *[F.col(f"_x0_{f}").alias(f) for f in feats]).withColumns(
            {"changes": F.lit(0), "objective": F.lit(0.0), "proba": F.lit(0.0)}).limit(0)
    every = orig.select(*g, "row_id")
    hits = found.withColumn("found", F.lit(True))
    return every.join(hits, [*g, "row_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
