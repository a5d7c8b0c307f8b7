"""The corpus pipeline: language, near copies, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm.common import table, written
from scorelab.llm.decontaminate import decontaminated
from scorelab.llm.language_id import identify, rejected, train_text
from scorelab.llm.packing import DIGEST, pack
from scorelab.llm.secret_scan import redacted, train_on
from scorelab.llm.simhash import simhash_groups


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is surely not in the language declared for them, or in none that the
    corpus has, go. The source stands for the host; documents carry no address."""
    model = train_text(docs)
    nothing = F.lit(None).cast("string")
    found = identify(docs, model, F.col("text"), F.col("lang"), nothing, F.col("source"), nothing)
    return found.where(~rejected(model, F.col("lang"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group (4-word shingles, at most 4 bits) the document with the smallest
    doc_id stays. Rows that repeat that doc_id are copies too: one of them stays. A row without
    doc_id can't be named by its group and stays."""
    named = docs.where("doc_id is not null")
    groups = written(simhash_groups(named).select("doc_id", "component_id"), "pipeline_groups")
    keep = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = named.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])  # by the join's own partitions
    return kept.unionByName(docs.where("doc_id is null"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 10 or more benchmark words are cut; documents mostly made of them go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return redacted(docs, train_on(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-id sequences, sources in the corpus' proportions."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).select(*DIGEST)


STAGES = [
    ("language_id", language),
    ("simhash_near_copies", near_copies),
    ("decontamination", benchmark),
    ("secret_scan", secrets),
    ("packing", packing),
]

#: Tokenizers, hashes of shingles and trained models have no SQL form: tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
