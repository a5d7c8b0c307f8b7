"""Divergence audit and source mixing against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from scorelab.llm import divergence, mixture

from .helpers import DOCS, awkward, frame

LOWER = {c: c + 32 for c in range(65, 91)}


def slow_audit(rows, min_docs, most):
    docs, count, groups = defaultdict(int), defaultdict(int), set()
    for _, t, lang, src in rows:
        lang, src = lang or "", src or ""
        groups.add((lang, src))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        for w in words:
            count[lang, src, w] += 1
        for w in set(words):
            docs[lang, w] += 1
    out = Counter()
    for lang in {g for g, _ in groups}:
        kept = sorted(w for (g, w), n in docs.items() if g == lang and n >= min_docs)
        mine = sorted(s for g, s in groups if g == lang)

        def shares(n_of, kept=kept):
            n = {w: n_of(w) for w in kept}
            return {w: 1 + 1_000_000_000 * (n[w] + 5) // (sum(n.values()) + 5 * len(kept)) for w in kept}

        p = {s: shares(lambda w, s=s: count.get((lang, s, w), 0)) for s in mine}
        q = shares(lambda w: sum(count.get((lang, s, w), 0) for s in mine))
        for s in mine:
            pair = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in mine if o != s))
            term = sorted(((q[w] - p[s][w], w.encode(), w) for w in kept if count.get((lang, s, w), 0) and p[s][w] > q[w]))[:most]
            for part, items in (("pair", pair), ("term", term)):
                out.update((lang, s, part, i, -v, r + 1) for r, (v, _, i) in enumerate(items))
    return out


@pytest.mark.parametrize(("min_docs", "most", "group_block", "term_block"), [(1, 5, 2, 3), (4, 50, 128, 2048), (10_000, 5, 1, 1)])
def test_audit_against_brute_force(spark, min_docs, most, group_block, term_block):
    rnd = random.Random(min_docs)
    rows = awkward(3, 120)
    rows += [(2000 + i, " ".join(rnd.choices(["Alpha", "beta", "été", "a1b", "x"], k=rnd.randint(0, 9))), rnd.choice(["en", "de"]), f"s{rnd.randint(0, 9)}") for i in range(200)]
    rows += [(3000, "one two", "fr", "only"), (3001, "1 2 3", "fr", "no terms"), (3002, "solo", "it", "s1")]
    got = divergence.audit(frame(spark, rows), min_docs, most, group_block, term_block).collect()
    assert Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == slow_audit(rows, min_docs, most)


def test_a_pair_is_one_row_however_the_rows_of_its_cells_arrive():
    rows = [{"lang": "en", "source": s, "gb": 0, "p0": 1, "width": 2, "a": 0, "b": 0, "t": [0], "p": [p]} for s, p in (("x", 5), ("y", 9), ("z", 2))]
    one, other = (divergence.cell(pa.Table.from_pylist(r)).to_pylist() for r in (rows, rows[::-1]))
    assert one == other and [(r["one"], r["two"], r["part"]) for r in one] == [("x", "y", 4), ("x", "z", 3), ("y", "z", 7)]


def test_audit_where_the_cells_of_a_pair_meet_its_rows_in_other_orders(spark, monkeypatch):
    rows = [(i, f"term{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}", "en", f"s{i % 7}") for i in range(900)]
    cell = divergence.cell

    def shuffled(table):  # as a shuffle may leave them: each cell in an order of its own
        return cell(table.take(np.random.default_rng(len(table) + table["width"][0].as_py()).permutation(len(table))))

    monkeypatch.setattr(divergence, "cell", shuffled)
    got = divergence.audit(frame(spark, rows), 1, 50, 128, 20).collect()
    assert Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == slow_audit(rows, 1, 50)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_terms_of_long_texts_are_the_same_in_pieces():
    text = "Ab cdé 1x-Y\x00z " * 500
    want = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
    for piece in (1, 7, 1 << 20):
        assert [w.decode() for ws in divergence.terms_of(text, piece) for w in ws] == want


def slow_targets(sizes, weights, most):
    """By raising the level until the next source stops, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    out, open_, rest = {}, set(names), Fraction(sum(sizes.values()))
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * level > most * sizes[s]]
        if not over:
            out |= {s: w[s] * level for s in open_}
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
            rest -= out[s]
            open_.discard(s)
    return out


def slow_taken(rows, targets, sizes):
    """Words of each source's stream, one after the other, until the target is met."""
    out = Counter()
    for s in sizes:
        mine = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, src in rows if src == s]
        mine.sort(key=lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest())
        words = [k for k, (_, n) in enumerate(mine) for _ in range(n)]
        goal = int(targets[s])
        got = Counter(words[x % len(words)] for x in range(goal)) if words else Counter()
        for k, (i, n) in enumerate(mine):
            out[i, n, sizes[s], round(float(targets[s]), 6), got[k]] += 1
    return out


@pytest.mark.parametrize(("weights", "most", "block"), [((5, 2, 1), 3, 256), ((5, 2, 1), 3, 7), ((1, 50), 2, 3), ((1,), 3, 1)])
def test_mixture_against_brute_force(spark, weights, most, block):
    rnd = random.Random(block)
    rows = awkward(5, 100) + [(4000 + i, "a b\x0bc", "en", "tiny") for i in range(3)] + [(4100, None, "en", "nothing")]
    rows += [(5000, "same row here", "en", "s2")] * 40 + [(6000 + i, " ".join(["w"] * rnd.randint(0, 30)), "en", f"s{rnd.randint(1, 9)}") for i in range(300)]
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = slow_taken(rows, slow_targets(sizes, weights, most), sizes)
    mix, summary = mixture.mixture(frame(spark, rows), weights, most, block)
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in summary.collect()) == want
    # the mix itself: a slot has one source, its places don't overlap and hold at most a block
    source = {i: s for i, _, _, s in rows if i is not None and i >= 4000}
    held = defaultdict(list)
    for r in mix.collect():
        held[r.slot].append((r.place, r.n_words, r.doc_id, r.first_word))
    for pieces in held.values():
        pieces.sort()
        assert all(a + n == b for (a, n, *_), (b, *_) in zip(pieces, pieces[1:], strict=False)) and pieces[0][0] == 0
        assert sum(n for _, n, *_ in pieces) <= block and len({source[i] for *_, i, _ in pieces if i in source}) <= 1
    assert sum(n for ps in held.values() for _, n, *_ in ps) == sum(t * c for (*_, t), c in want.items())


def test_first_slots_are_near_the_targets(spark):
    sizes = {"a": 4000, "b": 3000, "c": 500, "d": 9000}
    docs = frame(spark, [(k * 100 + i, "w " * (n // 100), "en", s) for k, (s, n) in enumerate(sizes.items()) for i in range(100)])
    goal = {s: float(t) for s, t in slow_targets(sizes, (5, 2, 1), 3).items()}
    mix, _ = mixture.mixture(docs, block=10)
    got = sorted((r.slot, list(sizes)[r.doc_id // 100], r.n_words) for r in mix.collect())
    total, run = sum(n for *_, n in got), Counter()
    done = 0
    for _, s, n in got:
        run[s] += n
        done += n
        if done < total * 0.95:
            assert all(abs(run[k] - goal[k] * done / sum(goal.values())) <= 10 * 14 for k in goal)  # blocks of 10 words


def test_slot_ranks_by_sorting():
    rnd = random.Random(6)
    for bits in (0, 1, 5, 9):
        for _ in range(10):
            lo, hi = sorted(rnd.randint(0, 1 << bits) for _ in range(2))
            points = np.arange(lo, hi, dtype=np.int64)
            slot, rank = mixture.slot_ranks(points, np.int64(lo), np.int64(hi), bits)
            want = [int(f"{p:0{bits}b}"[::-1], 2) if bits else 0 for p in points.tolist()]
            assert slot.tolist() == want and rank.tolist() == [sorted(want).index(s) for s in want]


def test_words_of_long_texts_are_the_same_in_pieces():
    text = "ab  c\tdé \x0b\x1c x\n" * 300
    assert {mixture.n_words(text, p) for p in (1, 2, 7, 1 << 20)} == {len(re.findall(r"[^\x20\x09-\x0D]+", text))}


def test_mixture_of_nothing(spark):
    mix, summary = mixture.mixture(spark.createDataFrame([], DOCS))
    assert mix.count() == 0 and summary.count() == 0
    only_empty = mixture.mixture(frame(spark, [(1, None, "en", None), (2, " ", "en", "a")]))[1]
    assert sorted(tuple(r) for r in only_empty.collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mixture_targets_of_more_words_than_an_int(spark):
    sizes = {"0a": 700_000_000, "0b": 600_000_000, "0c": 400_000_000}  # each product by weight is beyond 2^31, their sum is not
    rows = spark.createDataFrame(list(sizes.items()), "skey string, size long")
    got = {r.skey: r for r in mixture.targets(rows, (5, 2, 1), 3).collect()}
    total = sum(sizes.values())
    assert {k: r.words for k, r in got.items()} == {k: total * w // 8 for k, w in zip(sizes, (5, 2, 1), strict=True)}
    assert all(abs(got[k].target - total * w / 8) < 1e-3 for k, w in zip(sizes, (5, 2, 1), strict=True))
