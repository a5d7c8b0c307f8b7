"""The pipeline's stages, each against its own rule on its own input."""

from collections import Counter

import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from scorelab.llm import decontaminate, language_id, secret_scan
from scorelab.llm.common import written

from .helpers import DOCS, awkward, frame
from .test_similar import components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    kept = written(pipeline.language(spark, docs, SF), "t")
    assert kept.columns == docs.columns and kept.count() >= 0.9 * docs.count()
    docs, kept = kept, written(pipeline.near_copies(spark, kept, SF), "t")
    rows = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows.items()}
    comp = components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    low = {}
    for i, f in fps.items():
        low[comp[f]] = min(low.get(comp[f], i), i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(low.values())
    docs, kept = kept, written(pipeline.benchmark(spark, kept, SF), "t")
    items = [(r.item_id, decontaminate.words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 10]) for _, w in items for k in range(max(1, len(w) - 9))}
    before = {r.doc_id: r.text for r in docs.collect()}
    has = lambda t: any(tuple(w[k : k + 10]) in grams for w in [decontaminate.words(t)] for k in range(len(w) - 9))
    after = {r.doc_id: r.text for r in kept.collect()}
    assert all(after.get(i) == t for i, t in before.items() if not has(t))
    assert all(i not in after or after[i] != t for i, t in before.items() if has(t))
    docs, kept = kept, written(pipeline.secrets(spark, kept, SF), "t")
    assert kept.columns == first.columns and kept.count() == docs.count()
    for r in kept.collect():
        assert secret_scan.base_spans(r.text) == []
        if not secret_scan.base_spans(after[r.doc_id]) and "[SECRET]" not in r.text:
            assert r.text == after[r.doc_id]
    packed = pipeline.packing(spark, kept, SF).collect()
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = Counter()
    for p in packed:
        size[p.doc_id] += p.length
    assert size == {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept.collect()}


def test_stages_on_awkward_and_empty_tables(spark):
    for rows in (awkward(11), []):
        docs = frame(spark, rows) if rows else spark.createDataFrame([], DOCS)
        for _, stage in pipeline.STAGES:
            out = written(stage(spark, docs, SF), "t")
            if stage is not pipeline.packing:
                assert out.columns == docs.columns
            docs = out
        assert (docs.count() > 0) == bool(rows)


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train_text(docs)
    nothing = F.lit(None).cast("string")
    found = language_id.identify(docs, model, F.col("text"), F.col("lang"), nothing, F.col("source"), nothing)
    assert found.where(language_id.rejected(model, F.col("lang"))).where("lang_text = lang").count() == 0
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "simhash_near_copies", "decontamination", "secret_scan", "packing"]
