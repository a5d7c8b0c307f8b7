"""Vector codes against scanning everything."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from scorelab.llm import vector_codes
from scorelab.llm.common import join_side

VECS = "vec_id long, embedding array<double>, label string, error int, code string, part int"


def slow_codes(rows, entries, parts, rounds, scale):
    """Plain Python integers, every entry scanned."""
    good = [(i, [float(x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not good:
        return Counter(), []
    width = -(-max(len(v) for _, v, _ in good) // parts) * parts
    whole = [(i, [int(np.floor(scale * x)) for x in v] + [0] * (width - len(v)), lab) for i, v, lab in good]
    w = width // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    book = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((dist(x, e), k) for k, e in enumerate(book[p])) for p, x in enumerate(cut(v))] for _, v, _ in whole]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            members = defaultdict(list)
            for (_, v, _), a in zip(whole, got, strict=True):
                members[a[p][1]].append(cut(v)[p])
            for k, xs in members.items():
                book[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    got = assign()
    sha = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    by_label = defaultdict(int)
    for (_, _, lab), a in zip(whole, got, strict=True):
        by_label[lab] += sum(d for d, _ in a)
    return Counter((i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), by_label[lab], sha) for (i, _, lab), a in zip(whole, got, strict=True)), book


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", 2) for i, v, lab in rows], VECS)


def as_counter(df):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_codes_equal_a_full_scan(spark):
    rnd = random.Random(1)
    draw = lambda n=8: [rnd.gauss(0, 0.2) for _ in range(n)]
    rows = [(i, draw(), rnd.choice(["a", "b", None])) for i in range(300)]
    hot = draw()
    rows += [(500 + i, hot, "a") for i in range(150)]  # a group of copies
    rows += [(3, draw(), "b"), (3, draw(), None), (None, draw(), "c"), (None, hot, None)]  # repeated and null ids
    rows += [(900, None, "a"), (901, [None] + draw(7), "a"), (902, [float("nan")] + draw(7), "a"), (903, [float("inf")] + draw(7), "b"), (904, [0.0] * 8, "z"), (905, [], "z"), (906, draw(5), "z")]
    df = vectors(spark, rows)
    for entries, parts, rounds, scale in ((16, 4, 4, 1024), (7, 2, 3, 8), (256, 4, 2, 3), (1, 1, 1, 1024)):
        want, _ = slow_codes(rows, entries, parts, rounds, scale)
        assert as_counter(vector_codes.codes(df, entries, parts, rounds, scale)) == want, (entries, parts, rounds, scale)


def test_codes_of_ties_large_values_and_nothing(spark):
    rnd = random.Random(2)
    coarse = [(i, [float(rnd.randint(-2, 2)) for _ in range(4)], "a") for i in range(200)]  # many equal distances
    large = [(i, [rnd.uniform(-2e5, 2e5) for _ in range(4)], "a") for i in range(60)]  # squares beyond 2**53
    for rows, scale in ((coarse, 1), (large, 1024)):
        assert as_counter(vector_codes.codes(vectors(spark, rows), 12, 2, 4, scale)) == slow_codes(rows, 12, 2, 4, scale)[0]
    assert vector_codes.codes(vectors(spark, coarse).limit(0)).count() == 0
    assert vector_codes.codes(vectors(spark, [(1, None, "a")])).count() == 0


def test_net_bounds_spare_scans(spark):
    """Well separated clusters: after the first pass nearly every group is left alone."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(16, 8)) * 20
    rows = [(i, [float(x) for x in centres[i % 16] + rnd.normal(size=8) * 0.05], None) for i in range(800)]
    _, history, scans = vector_codes.fit(vectors(spark, rows), 16, 2, 4)
    assert scans[0] == 800 * 2 * 16 and len(history) == 5
    assert max(scans[1:]) < scans[0] / 10


def test_net_moves_are_at_most_the_added_moves():
    rnd = np.random.default_rng(4)
    books = rnd.normal(size=(5, 12, 3)).cumsum(0)
    starts = np.array([0, 4, 8])
    net = vector_codes.net_moves(books, starts)
    step = np.linalg.norm(np.diff(books, axis=0), axis=2)
    for s in range(5):
        added = np.maximum.reduceat(step[s:].sum(0), starts)
        assert (net[s] <= added + 1e-6).all()
        assert np.allclose(net[s], np.maximum.reduceat(np.linalg.norm(books[-1] - books[s], axis=1), starts))


def test_join_side_is_the_same_when_salted(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(90)] + [(100, "b"), (101, "c")], "i int, k string")
    side = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    got = [Counter(tuple(r) for r in join_side(rows, side, "k", bound=b, salts=4).select("i", "k", "v").collect()) for b in (100, 1)]
    assert got[0] == got[1] and sum(got[0].values()) == 92
