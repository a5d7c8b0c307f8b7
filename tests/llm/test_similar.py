"""SimHash groups, nearest neighbours and repeated passages against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from scorelab.llm import neighbours, repeats, simhash
from scorelab.llm.common import connected_components

from .helpers import DOCS, awkward, frame


def slow_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_groups(spark):
    rnd = random.Random(2)
    base = " ".join(rnd.choices([f"w{i}" for i in range(300)], k=120))
    near = [(1000 + i, base.replace("w7 ", f"x{i} ", 1) + (" tail" if i % 2 else ""), "en", "s1") for i in range(30)]
    rows = awkward(1) + near
    got = simhash.simhash_groups(frame(spark, rows)).collect()
    fps = {t: slow_fingerprint(t) for _, t, *_ in rows}
    comp = components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    low = defaultdict(list)
    for i, t, *_ in rows:
        if i is not None:
            low[comp[fps[t]]].append(i)
    want = Counter((i, f"{fps[t]:016x}", min(low[comp[fps[t]]], default=None)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("bits", "tile"), [(4, 5), (4, 1000), (2, 7), (1, 1000)])
def test_close_links_keep_every_component(spark, bits, tile):
    rnd = random.Random(bits)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for _ in range(200):  # chains of close fingerprints, many of them in one block
        fps.add(rnd.choice(sorted(fps)) ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(1, bits + 1))) & (1 << 64) - 1)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.close_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits, tile)
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= bits)
    assert {n: got.get(n, n) for n in signed} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(500, 499), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 499: 499, 500: 499}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours_are_exact(spark):
    rnd = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rnd.normal(size=16)]) for i in range(400)]
    vecs += [(1000 + i, vecs[20][1]) for i in range(60)]  # one common vector
    vecs += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (2100, [0.5, 0.25])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in vecs], "vec_id long, embedding array<double>, id int, rank int, score string")
    for k, q, c in ((20, 4096, 16384), (5, 7, 50)):
        got = neighbours.search(df, k=k, q_block=q, c_block=c).collect()
        good = {i: np.array(v + [0.0] * (16 - len(v))) for i, v in vecs if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
        want = {}
        for a in [i for i in good if i % 20 == 0]:
            near = sorted(((-neighbours.exact(good[a][None], good[b][None])[0], b) for b in good if b != a))[:k]
            want.update({(a, r + 1): (b, -s) for r, (s, b) in enumerate(near)})
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want
    assert neighbours.search(df.limit(0)).count() == 0


def test_neighbours_of_repeated_ids(spark):
    rnd = np.random.default_rng(4)
    draw = lambda: [float(x) for x in rnd.normal(size=4)]
    one, two, three = draw(), draw(), draw()
    vecs = [(i, draw()) for i in range(1, 30)]
    vecs += [(40, one)] * 25 + [(60, one), (80, one)]  # the smallest id has more rows than k
    vecs += [(100, two)] + [(120, two)] * 25 + [(140, two)] * 3  # the second one has
    vecs += [(i, three) for i in (160, 180, 180, 200, 200, 200) for _ in range(8)]
    good = [(i, np.array(v)) for i, v in vecs]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    asked = {i: v for i, v in good if i % 20 == 0}  # repeated rows of an id are equal here
    for k, q, c in ((20, 4096, 16384), (5, 7, 30)):
        got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df, k=k, q_block=q, c_block=c).collect())
        want = Counter()
        for a, v in asked.items():
            near = sorted((-neighbours.exact(v[None], w[None])[0], b) for b, w in good if b != a)[:k]
            want.update((a, r + 1, b, -s) for r, (s, b) in enumerate(near))
        assert got == want


def slow_cut(rows, length):
    raw = [(repeats.NO_ID if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    low = {}
    for i, t in raw:
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            low[w] = min(low.get(w, repeats.NO_ID), i)
    out = []
    for (i, t), (doc, *_) in zip(raw, rows, strict=True):
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            if low[t[s : s + length]] < i:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize(("length", "gram", "chunk", "heavy"), [(50, 24, 1 << 20, 64), (12, 5, 300, 2), (12, 5, 2000, 1000), (8, 8, 500, 3)])
def test_repeats_against_brute_force(spark, length, gram, chunk, heavy):
    rnd = random.Random(length)
    letters = "abé \n"
    shared = ["".join(rnd.choices(letters, k=rnd.randint(5, 150))) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = ["".join(rnd.choices(letters if i % 3 else "xy", k=rnd.randint(0, 60))) if rnd.random() < 0.6 else rnd.choice(shared) for _ in range(rnd.randint(0, 5))]
        rows.append((1000 - 7 * i, "".join(parts), "en", "s"))
    rows += awkward(9, 20) + [(2, "ab" * 200, "en", "s"), (3, "ba" * 150, "en", "s"), (4, "\x00" * 90, "en", "s"), (5, "\x00" * 70, "en", "s")]
    got = repeats.cut_repeats(frame(spark, rows).repartition(3), length, gram, chunk, bucket_grams=200, slice_entries=50, heavy=heavy).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == slow_cut(rows, length)


@pytest.mark.parametrize("heavy", [1000, 1_000_000])
def test_repeats_of_long_runs_within_few_documents(spark, heavy):
    runs = [" " * 1500, "=" * 700 + "x" + "=" * 700, "ab" * 600, "\x00" * 400 + " " * 400]
    rnd = random.Random(8)
    rows = [(i, "".join(f"{rnd.random()}{rnd.choice(runs)[rnd.randint(0, 99):]}" for _ in range(3)), "en", "s") for i in range(6)] + [(3, " " * 900, "en", "s"), (9, " " * 49, "en", "s"), (-1, "=" * 60, "en", "s")]
    got = repeats.cut_repeats(frame(spark, rows).repartition(2), 50, 24, 9000, bucket_grams=200, slice_entries=50, heavy=heavy).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == slow_cut(rows, 50)


def test_long_runs_are_counted_whole_and_sent_once(spark):
    docs = spark.createDataFrame([(1, " " * 3000), (2, " " * 2500)], "doc_id long, text string").coalesce(1)
    chunks = repeats._chunks(docs, 1 << 20)
    answers = repeats._answers(repeats._runs_of_grams(chunks, 1, 50, 24), heavy=2000).collect()
    assert [bool(a.heavy) for a in answers] == [True]
    (row,) = chunks.collect()
    sent = repeats._send(repeats.Chunk(row.ids, row.sizes, bytes(row.blob)), row.chunk, [{"bucket": 0, "repeated": b"\xff", "heavy": b""}], 1, 1, 50, 24)
    assert sum(repeats.Run(row.chunk, blob).n for _, kind, _, blob in sent if kind == repeats.RUN) < 100


def test_repeats_of_no_rows(spark):
    assert repeats.cut_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_merge_keeps_order_and_prefixes():
    rnd = random.Random(4)
    runs, everything = [], []
    for c in range(11):
        entries = sorted("".join(rnd.choices("ab", k=rnd.randint(4, 9))).encode() for _ in range(rnd.randint(0, 60)))
        everything += entries
        runs.append(repeats.Run(c, repeats.Run.pack(entries, [b"l"] * len(entries), range(len(entries)), range(len(entries)), range(len(entries)))))
    before, got = b"", []
    for shared, run in repeats.merge(runs):
        assert shared == repeats.common(before, run.suffix, 0)
        before = run.suffix
        got.append(run.suffix)
    assert got == sorted(everything)


def test_hash_of_grams_depends_on_the_gram_alone():
    data = np.frombuffer(b"hello world, hello world again and again", np.uint8)
    for k in (1, 3, 5, 8, 11, 24):
        h = repeats.gram_hashes(data, k)
        by = defaultdict(set)
        for i in range(len(data) - k + 1):
            by[data[i : i + k].tobytes()].add(int(h[i]))
        assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)
