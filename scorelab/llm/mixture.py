"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end, and that stream is cut into
blocks of equal numbers of words. A mix is a sequence of slots; slot i has the van der Corput point
of i (its bits reversed), and the source whose stretch of the cumulative weights holds the point owns
the slot. Any first part of the sequence is close to the targets. A source's slots are ranked, and its
r-th slot takes block r of its stream, going through the stream again where the target needs it.

With 2^k slots the points are the multiples of 2^-k, so a source's slots are listed from its own stretch,
without a search, and the rank of a slot is a count of multiples with given low bits: nothing is
sorted, and a source that owns a third of all slots is listed by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm.common import arrow_map, join_side, record, table, written
from scorelab.plans.ranks import dense_codes, running_totals

WEIGHTS = (5, 2, 1)


def n_words(text: str, piece: int = 1 << 20) -> int:
    """Number of runs of characters other than ASCII white space; long texts piece by piece."""
    line = text.encode()
    count = len(line[:piece].split())
    for at in range(piece, len(line), piece):
        joined = not line[at - 1 : at].isspace() and not line[at : at + 1].isspace()
        count += len(line[at : at + piece].split()) - joined
    return count


def word_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, doc_id, source, skey, size): a number for each row, and ``skey``, the source as a key that
    sorts by code point with null last."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), text.alias("text"))
    out = [("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64())]

    def job(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield record(out, [b.column(0), b.column(1), [n_words(t) for t in b.column(2).to_pylist()]])

    sized = arrow_map(rows, job, "doc_id long, source string, size long")
    key = F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))
    return written(sized.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", key.alias("skey"), "size"), "mix_rows")


def targets(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(skey, code, source_size, target, words): a row a source. ``weights`` repeat along the sources;
    the sum of all sizes is shared by weight, a target stops at ``most`` times its source's size, and
    what is over is shared by weight among the others until none is above. ``words`` is the target
    rounded down."""
    sizes = written(rows.groupBy("skey").agg(F.sum("size").alias("source_size")), "mix_sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("code") % len(weights) + 1)
    sources = written(sizes.join(dense_codes(sizes, "skey"), "skey").withColumn("weight", weight), "mix_sources")
    stop = F.lit(most).cast("decimal(10,0)") * F.col("source_size")
    # a source is at its stop if stop <= weight * rest / left: rest and left only make that share grow
    first = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, left = int(first[0] or 0), int(first[1] or 0)
    total = rest
    while True:
        full = stop * F.lit(left) <= F.col("weight") * F.lit(rest).cast("decimal(20,0)")
        stopped, free = sources.agg(F.sum(F.when(full, stop)), F.sum(F.when(~full, F.col("weight")))).first()
        now = (total - int(stopped or 0), int(free or 0))
        if now in ((rest, left), (0, 0)) or not now[1]:
            break
        rest, left = now
    part = F.col("weight") * F.lit(rest).cast("long")  # a literal below 2^31 is an int, and so would be the product
    return written(
        sources.withColumn("full", full)
        .select("skey", "code", "source_size",
                F.when(F.col("full"), stop.cast("double")).otherwise(part.cast("double") / F.lit(float(max(left, 1)))).alias("target"),
                F.when(F.col("full"), stop.cast("long")).otherwise(F.expr(f"(weight * cast({rest} as decimal(20,0))) div {max(left, 1)}")).alias("words")), "mix_targets"
    )


def reversed_bits(x: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(x)
    for b in range(bits):
        out |= (x >> b & 1) << (bits - 1 - b)
    return out


def slot_ranks(points: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, rank) of points in [lo, hi): the slot is the point with its bits reversed, its rank the
    number of points of [lo, hi) whose slot is smaller. A smaller slot agrees in some of the slot's
    leading bits, which are the point's low bits, and has 0 where the slot has its next 1: such
    points are those with one remainder by a power of two."""
    rank = np.zeros_like(points)
    for b in range(bits):  # the first b bits agree
        remainder = points & ((1 << b) - 1)
        below = lambda x, r=remainder, step=b + 1: (x - r + (1 << step) - 1) >> step  # noqa: E731 - multiples + r below x
        rank += np.where(points >> b & 1, below(hi) - below(lo), 0)
    return reversed_bits(points, bits), rank


def schedule(sources: DataFrame, block: int, chunk: int = 1 << 14) -> DataFrame:
    """(slot, skey, round, block, words): every slot of the mix, the pass through its source's stream,
    the block, and how many words of the block it takes (fewer than all only where the target ends)."""
    size, words = F.col("source_size"), F.col("words")
    per_pass = F.when(size > 0, F.expr(f"(source_size + {block - 1}) div {block}")).otherwise(F.lit(0).cast("long"))
    full = F.when(size > 0, F.expr("words div nullif(source_size, 0)")).otherwise(F.lit(0).cast("long"))
    needs = sources.select("skey", "code", size, words, per_pass.alias("per_pass"), full.alias("full"))
    needs = needs.withColumn("tail", words - F.col("full") * size)
    needs = needs.withColumn("slots", F.col("full") * F.col("per_pass") + F.expr(f"(tail + {block - 1}) div {block}"))
    needs = written(running_totals(needs, [], "code", ["slots"]).where("slots > 0"), "mix_needs")
    m = int(needs.agg(F.max("tot_slots")).first()[0] or 1)
    bits = max(0, (m - 1).bit_length())  # 2^bits points, at least one for each slot that is needed
    edge = lambda c: F.expr(f"({c} * cast({1 << bits} as decimal(20,0)) + {m - 1}) div {m}")
    spans = needs.withColumn("lo", edge("(cum_slots - slots)")).withColumn("hi", edge("cum_slots"))
    spans = spans.withColumn("at", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(chunk).cast("long"))))
    spans = spans.select("skey", "source_size", "per_pass", "full", "tail", "slots", "lo", "hi", "at").repartition("skey", "at")
    out = [("slot", pa.int64()), ("skey", pa.string()), ("round", pa.int64()), ("block", pa.int64()), ("words", pa.int64())]

    def job(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for r in b.to_pylist():
                points = np.arange(r["at"], min(r["at"] + chunk, r["hi"]), dtype=np.int64)
                slot, rank = slot_ranks(points, np.int64(r["lo"]), np.int64(r["hi"]), bits)
                used = rank < r["slots"]  # up to twice as many points as slots fall in the stretch
                slot, rank = slot[used], rank[used]
                turn, no = rank // r["per_pass"], rank % r["per_pass"]
                limit = np.where(turn < r["full"], r["source_size"], r["tail"])
                yield record(out, [slot, [r["skey"]] * len(slot), turn, no, np.minimum(block, limit - no * block)])

    return arrow_map(spans, job, "slot long, skey string, round long, block long, words long")


def streams(rows: DataFrame, block: int) -> DataFrame:
    """(row, doc_id, skey, block, lo, hi, first): the pieces of documents in the blocks of their source's
    shuffled stream, as ranges of the block's words; ``first`` is the document's word at ``lo``."""
    dealt = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    keyed = rows.where("size > 0").select("row", "doc_id", "skey", "size", F.concat(dealt, F.lpad(F.hex("row"), 16, "0")).alias("place"))
    laid = running_totals(keyed, ["skey"], "place", ["size"]).withColumn("start", F.col("cum_size") - F.col("size"))
    cut = laid.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(cum_size - 1) div {block}"))))
    base = F.col("block") * block
    lo, hi = F.greatest(F.col("start"), base), F.least(F.col("cum_size"), base + block)
    return cut.select("row", "doc_id", "skey", "block", (lo - base).alias("lo"), (hi - base).alias("hi"), (lo - F.col("start")).alias("first"))


def mixed(rows: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """The mix: (slot, place, row, doc_id, first_word, n_words), in order of (slot, place). A key holds one
    block's pieces and the few slots that take it."""
    # both sides grow with the documents: well packed files must not pass for small tables
    found = streams(rows, block).join(schedule(sources, block).hint("merge"), ["skey", "block"])
    taken = F.least("hi", "words") - F.col("lo")
    return found.select("slot", F.col("lo").alias("place"), "row", "doc_id", F.col("first").alias("first_word"), taken.alias("n_words")).where("n_words > 0")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = 256,
            id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(mix, summary): the mix as ``mixed`` gives it, and a row a document with doc_id, size, source_size,
    target (its source's) and taken (its words in the mix, repeats counted).

    A source takes its target rounded down to a whole word, so no document is taken more than ``most``
    times. A null text is empty; a null source is a source, the last; empty documents and sources of
    no words take nothing. Repeated rows are documents each. The shuffle follows doc_id and size
    only, so reruns agree (rows that agree in both may trade places). No documents, no rows."""
    rows = word_sizes(docs, id_col, text_col, source_col)
    sources = targets(rows, weights, most)
    mix = written(mixed(rows, sources, block), "mix")
    taken = mix.groupBy("row").agg(F.sum("n_words").alias("taken"))
    out = rows.select("row", "doc_id", "skey", "size").join(taken.hint("merge"), "row", "left")
    out = join_side(out, sources.select("skey", "source_size", "target"), "skey")
    return mix.drop("row"), out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 5, 2, 1 along the sources, each source at most three times."""
    return mixture(table(spark, sf_dir, "documents"))[1]


#: The words taken from a source are the first ones of its repeated stream, so SQL needs no slots.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
g AS (SELECT source, sum(size) AS s FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM g),
f AS (SELECT *, sum(s) OVER () - 3 * coalesce(sum(s) OVER (ORDER BY s * 10 // w GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER (ORDER BY s * 10 // w GROUPS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
u AS (SELECT *, 3 * s * free <= w * rest AS stop FROM f),
r AS (SELECT sum(s) - coalesce(sum(3 * s) FILTER (WHERE stop), 0) AS rest, coalesce(sum(w) FILTER (WHERE NOT stop), 1) AS free FROM u),
t AS (SELECT source, s, CASE WHEN stop THEN (3 * s)::DOUBLE ELSE (w * r.rest)::DOUBLE / r.free::DOUBLE END AS target,
             CASE WHEN stop THEN 3 * s ELSE (w * r.rest) // r.free END AS words FROM u, r),
p AS (SELECT d.*, t.s, t.target, t.words // greatest(t.s, 1) AS passes, t.words % greatest(t.s, 1) AS tail,
             sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat(coalesce(doc_id::VARCHAR, ''), ':', size)) ROWS UNBOUNDED PRECEDING) AS fin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target,
       (passes * size + greatest(0, least(fin, tail) - (fin - size)))::BIGINT AS taken FROM p
"""
