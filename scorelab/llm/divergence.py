"""Divergence of sources' word use, by cube partitioning.

Every language has groups (its sources) and kept terms. Groups are dealt to blocks of groups and
terms to blocks of terms; a slice is one group's terms in one term block. A task owns a cell
(group block, group block, term block) of the cube: each slice is sent to the cells of its term
block that its group block takes part in, the cell works out the partial divergence of every pair of its
groups over its terms, and the partial sums are added along the term axis. What a cell holds is
bounded by the two group blocks and the term block, however frequent a source or a term is; how many
cells there are follows the table.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelab.llm.common import arrow_map, record, table, written

#: A-Z lower-cased, a-z and bytes of other scripts kept, everything else a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: str, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, A-Z lower-cased, as lists for about ``piece`` bytes each."""
    line = text.encode().translate(_WORDS)
    at = 0
    while at < len(line):
        end = line.find(b" ", at + piece) if at + piece < len(line) else -1
        end = len(line) if end < 0 else end
        yield line[at:end].split()
        at = end


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, at_most: int = 200_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group. Tasks
    add up before anything is shuffled, and pass on what they have at ``at_most`` entries."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    out = [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]

    def passed_on(total, seen):
        for (lang, source), counts in total.items():
            here = seen[lang, source]
            yield record(out, [[lang] * len(counts), [source] * len(counts), [t.decode() for t in counts], list(counts.values()), [here[t] for t in counts]])

    def job(batches: Iterator[pa.RecordBatch]):
        total, seen = defaultdict(Counter), defaultdict(Counter)
        for b in batches:
            for t, lang, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                mine: set[bytes] = set()
                for words in terms_of(t):
                    total[lang, source].update(words)
                    mine.update(words)
                seen[lang, source].update(mine)
            if sum(map(len, total.values())) > at_most:
                yield from passed_on(total, seen)
                total, seen = defaultdict(Counter), defaultdict(Counter)
        yield from passed_on(total, seen)

    rows = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    found = arrow_map(rows, job, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, size: str, smooth: int = 5, unit: int = 1_000_000_000) -> F.Column:
    """1 + floor(unit (n + smooth) / (total + smooth size)) in whole numbers."""
    return F.expr(f"1 + (cast({unit} as decimal(10,0)) * ({n} + {smooth})) div ({total} + {smooth} * {size})")


class Audit:
    """The tables of one audit: ``groups`` (a row a group), ``kept`` (a row a group and kept term it has)
    and, from them, ``pairs()`` and ``top_terms()``."""

    def __init__(self, docs: DataFrame, min_docs: int = 30, group_block: int = 128, term_block: int = 2048,
                 text_col: str = "text", lang_col: str = "lang", source_col: str = "source"):
        text = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
        counts = written(term_counts(docs, text_col, lang_col, source_col), "divergence_counts")
        vocab = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        vocab = written(vocab.select("lang", "term", "total"), "divergence_vocab")
        groups = written(docs.select(text(lang_col, "lang"), text(source_col, "source")).distinct(), "divergence_groups")
        size = vocab.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
        blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
        langs = written(
            groups.groupBy("lang").agg(F.count("*").alias("g")).join(size, "lang", "left").na.fill(0, ["v", "lang_n"])
            .select("lang", "v", "lang_n", blocks("g", group_block).alias("group_blocks"), blocks("v", term_block).alias("term_blocks")), "divergence_langs"
        )
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        inside = Window.partitionBy("lang", "tb")
        terms = vocab.join(langs, "lang").withColumn("tb", dealt("term", "term_blocks"))
        terms = terms.select("lang", "term", "tb", (F.row_number().over(inside.orderBy("term")) - 1).alias("t"), share("total", "lang_n", "v").alias("q"))
        self.terms = written(terms, "divergence_terms")
        held = written(counts.join(self.terms, ["lang", "term"]).select("lang", "source", "term", "tb", "t", "n", "q"), "divergence_held")
        own = held.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        self.groups = written(
            groups.join(langs, "lang").join(own, ["lang", "source"], "left").na.fill(0, ["group_n"]).withColumn("zero", F.lit(0))
            .select("lang", "source", "v", "group_n", "group_blocks", "term_blocks", dealt("source", "group_blocks").alias("gb"),
                    F.when(F.col("v") > 0, share("zero", "group_n", "greatest(v, 1)")).otherwise(F.lit(0)).alias("p0")), "divergence_groups"
        )
        self.kept = held.join(self.groups.select("lang", "source", "group_n", "v"), ["lang", "source"]).withColumn("p", share("n", "group_n", "v"))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): every ordered pair of a language's groups."""
        slices = self.kept.groupBy("lang", "source", "tb").agg(F.collect_list(F.struct("t", "p")).alias("slice"))
        sizes = self.terms.groupBy("lang", "tb").agg(F.count("*").alias("width"))
        every = self.groups.withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)))
        every = every.join(sizes, ["lang", "tb"], "left").join(slices, ["lang", "source", "tb"], "left")
        sent = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
        sent = sent.select("lang", "source", "gb", "p0", F.coalesce("width", F.lit(0).cast("long")).alias("width"), F.least("gb", "other").alias("a"),
                           F.greatest("gb", "other").alias("b"), "tb", F.col("slice.t").alias("t"), F.col("slice.p").alias("p"))
        parts = sent.groupBy("lang", "a", "b", "tb").applyInArrow(cell, "lang string, one string, two string, part long")
        whole = parts.groupBy("lang", "one", "two").agg(F.sum("part").alias("value"))
        way = lambda s, i: F.struct(F.col(s).alias("source"), F.col(i).alias("item"))
        both = whole.select("lang", F.explode(F.array(way("one", "two"), way("two", "one"))).alias("w"), "value")
        return both.select("lang", "w.source", "w.item", "value")

    def top_terms(self, most: int = 50) -> DataFrame:
        """(lang, source, item, value, rank): the terms a group has more of than its language, the
        ``most`` largest differences of each group."""
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        over = self.kept.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        return over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def cell(rows: pa.Table) -> pa.Table:
    """(lang, one, two, part): one cell's sums for every pair of a group of its first and a group of its second
    block. A term of the block that neither group has counts with the groups' shares of nothing. Rows come in
    any order, so they are sorted: a pair must go the same way round in every cell that it meets in."""
    rows = rows.sort_by("source")
    lang, width = rows["lang"][0].as_py(), rows["width"][0].as_py()
    gb, a, b = rows["gb"].to_numpy(), rows["a"][0].as_py(), rows["b"][0].as_py()
    names, p0 = rows["source"].to_pylist(), rows["p0"].to_numpy()
    lengths = rows["t"].combine_chunks().value_lengths().fill_null(0).to_numpy()
    t, p = (rows[c].combine_chunks().flatten().to_numpy() for c in ("t", "p"))
    some, column = np.unique(t, return_inverse=True)
    shares = np.repeat(p0[:, None], len(some), axis=1)
    shares[np.repeat(np.arange(len(names)), lengths), column] = p
    first, second = np.flatnonzero(gb == a), np.flatnonzero(gb == b)
    one, two, part = [], [], []
    for i in first:
        js = second[second > i] if a == b else second
        sums = np.abs(shares[js] - shares[i]).sum(1) + (width - len(some)) * np.abs(p0[js] - p0[i])
        one += [names[i]] * len(js)
        two += [names[j] for j in js]
        part += sums.tolist()
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "one": pa.array(one, pa.string()), "two": pa.array(two, pa.string()), "part": pa.array(part, pa.int64())})


def audit(docs: DataFrame, min_docs: int = 30, most: int = 50, group_block: int = 128, term_block: int = 2048, **columns) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: how far each other source of the language is
    from this one, the sum over the language's kept terms of the difference of shares, all ranks. Part
    ``term``: kept terms that the source has more of than its language, the ``most`` first.

    A null text, language or source is the empty one. A language without kept terms has pairs of
    value 0; a language with one source has none. Repeated rows count each. Ties go to the item
    that is smaller in UTF-8. Texts are read whole; no documents, no rows."""
    found = Audit(docs, min_docs, group_block, term_block, **columns)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.pairs().withColumn("rank", F.row_number().over(order))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(cols).unionByName(found.top_terms(most).withColumn("part", F.lit("term")).select(cols))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of all documents against each other and against their language."""
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, r, unnest(w) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM o GROUP BY ALL),
vocab AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM vocab GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (WHERE vocab.term IS NOT NULL), 0) AS n
       FROM g LEFT JOIN c USING (lang, source) LEFT JOIN vocab ON vocab.lang = c.lang AND vocab.term = c.term GROUP BY ALL),
k AS MATERIALIZED (
  SELECT gn.lang, gn.source, vocab.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gn.n + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (vocab.total + 5)) // (l.n + 5 * l.v) AS q
  FROM gn JOIN l USING (lang) JOIN vocab USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = vocab.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM k a JOIN k b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL SELECT lang, source, 'term', term, p - q FROM k WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
