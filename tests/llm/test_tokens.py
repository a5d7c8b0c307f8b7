"""Token counts, token files and packing against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from scorelab.llm import packing, token_count, token_files, token_ids
from scorelab.llm.common import shared_path

from .helpers import DOCS, awkward, frame

ODD = list("ab'sStTrRe  \n\t!.,19²½éÉßĳſK日本́̈ ​\x1d<|endoftext|>٣ǅªºµİΣς_-") + ["<|endoftext|>", "'s", "'re", "'LL", " "]


def texts(seed, n=4000):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ODD, k=rnd.randint(0, 30))) for _ in range(n)] + ["".join(rnd.choices("abéE's \n.,!1", k=rnd.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize(("kind", "name"), [("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")])
def test_ids_are_those_of_the_library(kind, name):
    enc, lib = token_ids.PieceEncoder(P.path(name), kind, most=500), Tokenizer.from_file(P.path(name))
    some = texts(1)
    got = [x for k in range(0, len(some), 300) for x in enc.encode(some[k : k + 300])]
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(some, add_special_tokens=False)]
    assert [t for t, a, b in zip(some, got, want, strict=True) if a != b] == []


def unigram():
    lib = Tokenizer(models.Unigram(token_count.vocabulary(P.path("piece_bpe_32k.model")), unk_id=0, byte_fallback=True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lib


def test_counts_are_those_of_the_library(spark):
    lib, count = unigram(), token_count.WordCounter(P.path("piece_bpe_32k.model"), most=50)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").orderBy("doc_id").limit(150).collect()]
    some = texts(2, 1500) + docs + ["▁▁ ▁a", "a ▁", " ", "  a"]
    want = [len(e.ids) for e in lib.encode_batch(some, add_special_tokens=False)]
    assert [(t, count.text(t)[0], n) for t, n in zip(some, want, strict=True) if count.text(t)[0] != n] == []


def test_count_table(spark):
    rows = awkward()
    got = token_count.token_counts(frame(spark, rows), P.path("piece_bpe_32k.model")).collect()
    lib = unigram()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert token_count.token_counts(spark.createDataFrame([], DOCS), P.path("piece_bpe_32k.model")).count() == 0


def test_token_files_round_trip(spark):
    rows = awkward(3)
    path = shared_path(spark, "test_files")
    token_files.write_token_files(frame(spark, rows).repartition(3), path, P.path("word_bpe_49k.json"), row_group_bytes=4096, page_rows=10)
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter((i, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in token_files.read_token_files(spark, path).collect()) == want
    got = sorted(token_files.token_digests(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r in got:  # gapless, ascending, and the checksum of some row of that id
        assert r.start == at
        at += r.n_tokens
        assert any(i == r.doc_id and len(ids) == r.n_tokens and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 for i, ids in want)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sorted(r.doc_id for r in token_files.read_token_files(spark, path, 10, 12).select("doc_id").collect()) == [10, 11, 12]


def test_token_files_of_no_rows(spark):
    path = shared_path(spark, "test_files")
    token_files.write_token_files(spark.createDataFrame([], DOCS), path, P.path("word_bpe_49k.json"))
    assert token_files.token_digests(spark, path).count() == 0


def packed(spark, rows, **options):
    pieces = packing.pack(frame(spark, rows).repartition(4), P.path("byte_bpe_50k.json"), **options).collect()
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter((i, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, *_ in rows)
    return pieces, want


@pytest.mark.parametrize("options", [{"window": 64, "grain": 4}, {"window": 64, "grain": 4, "weights": {"s1": 3.0, "s2": 1.0}}, {"window": 128}, {}])
def test_packing_holds_every_id_once(spark, options):
    pieces, want = packed(spark, awkward(5), **options)
    window = options.get("window", 1024)
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append(p)
        assert p.length == len(p.ids) > 0 and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
    for s, ps in seqs.items():
        ps.sort(key=lambda p: p.offset)
        size = sum(p.length for p in ps)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
        assert size == window or size & (size - 1) == 0
    assert sorted(seqs) == list(range(len(seqs)))
    docs = {}
    for p in pieces:
        docs.setdefault(p.doc_id, []).append(p)
    total = Counter()
    for i, ids in want.elements():
        total[i] += len(ids)
    assert {i: sum(p.length for p in ps) for i, ps in docs.items()} == dict(total)
    once = [i for i in docs if sum(n for (j, _), n in want.items() if j == i) == 1]
    for i in once:  # documents with an id of their own are whole again
        ps = sorted(docs[i], key=lambda p: p.start)
        assert tuple(x for p in ps for x in p.ids) in {ids for j, ids in want if j == i}
        assert all(p.doc_tokens == sum(q.length for q in ps) for p in ps)


def test_every_window_has_the_mixture(spark):
    rows = [(i, "word " * 200, "en", f"s{i % 4 if i % 3 else 0}") for i in range(120)]
    pieces, _ = packed(spark, rows)
    total, by = Counter(), {}
    for p in pieces:
        total[p.queue] += p.length
        by.setdefault(p.sequence_id, Counter())[p.queue] += p.length
    share = {q: n / sum(total.values()) for q, n in total.items()}
    full = [c for c in by.values() if sum(c.values()) == 1024]
    assert all(abs(c[q] - 1024 * share[q]) <= 2 * 32 + 2 * len(share) for c in full[:-1] for q in share)


def test_every_source_is_a_queue_however_many(spark):
    rows = [(i, "word " * (i % 5), "en", f"s{i}") for i in range(4500)] + [(5000 + i, "word " * 300, "en", "large") for i in range(6)]
    pieces = packing.pack(frame(spark, rows), P.path("byte_bpe_50k.json"), with_ids=False).collect()
    assert len({p.queue for p in pieces}) == 4501
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in by.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[0][0] == 0


def test_sequences_and_empty(spark):
    pieces = packing.pack(frame(spark, awkward(6)), P.path("byte_bpe_50k.json"), window=64)
    for r in packing.sequences(pieces).collect():
        assert len(r.ids) == r.n
    assert packing.pack(spark.createDataFrame([], DOCS), P.path("byte_bpe_50k.json")).count() == 0
    assert pieces.agg(F.sum("length")).first()[0] == pieces.select("doc_id", "start", "length", "sequence_id", "offset").distinct().agg(F.sum("length")).first()[0]
