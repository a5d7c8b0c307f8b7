"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

The automaton accepts every run of consecutive words of any item. A document's words are streamed
through it; at each word it knows the longest run ending there that some item contains. Where that
run reaches the window length, the window ending there occurs in an item, and the automaton's
state tells which items. Items shorter than a window count when they occur whole.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm.common import arrow_map, doc_view, map_texts, record, release, require_at_most, table, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = re.compile(WORD)


def lower_ascii(text: str) -> str:
    return text.encode().lower().decode()  # bytes lower-case A-Z only


def words(text: str) -> list[str]:
    return _WORDS.findall(lower_ascii(text))


class Automaton:
    """Generalised suffix automaton of word sequences. ``items``: (item id, words)."""

    def __init__(self, items: Sequence[tuple[int, list[str]]], window: int):
        self.window, self.ids = window, {}
        self.length, self.link, self.step = [0], [-1], [{}]
        ends: list[tuple[int, int]] = []  # (state, item) of each prefix
        whole: dict[int, set[int]] = {}  # state of a whole short item -> items
        for item, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                ends.append((last, item))
            if 0 < len(ws) < window:
                whole.setdefault(last, set()).add(item)
        # items of the window that a state of length >= window stands for: those of its subtree,
        # gathered at the highest state that still is as long as a window
        top = [0] * len(self.length)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                top[s] = top[up] if self.length[up] >= window else s
        items_of: dict[int, set[int]] = {}
        for s, item in ends:
            if top[s]:
                items_of.setdefault(top[s], set()).add(item)
        # whole short items that are a suffix of the state's runs: the chain of links that has any.
        # A state's short item is a suffix of the current match if that is at least as long.
        short = [0] * len(self.length)
        for s in order:
            short[s] = s if s in whole else short[self.link[s]]
        self.top, self.short = top, short
        self.items_of = {k: tuple(v) for k, v in items_of.items()}
        self.whole = {k: tuple(v) for k, v in whole.items()}
        self.whole_length = {s: self.length[s] for s in whole}

    def _extend(self, last: int, c: int) -> int:
        length, link, step = self.length, self.link, self.step
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        cur = self._state(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = step[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return cur

    def _state(self, n: int) -> int:
        self.length.append(n)
        self.link.append(0)
        self.step.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        length, link, step = self.length, self.link, self.step
        new = self._state(length[p] + 1)
        step[new] = dict(step[q])
        link[new], link[q] = link[q], new
        while p != -1 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new

    def scan(self, ws: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word spans (start, end) in order of their end, not merged, and the items found."""
        ids = list(map(self.ids.get, ws))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if not any(x is not None for x in ids):
            return spans, items
        step, link, length, top, short, w = self.step, self.link, self.length, self.top, self.short, self.window
        s = n = 0
        for i, c in enumerate(ids):
            if c is None:
                s = n = 0
                continue
            if c in step[s]:
                s, n = step[s][c], n + 1
            else:
                while s and c not in step[s]:
                    s = link[s]
                if c in step[s]:
                    s, n = step[s][c], length[s] + 1
                else:
                    n = 0
            if n >= w:
                spans.append((i + 1 - w, i + 1))
                items.update(self.items_of[top[s]])
            t = short[s]
            while t:
                k = length[t]
                if k <= n:
                    spans.append((i + 1 - k, i + 1))
                    items.update(self.whole[t])
                t = short[link[t]]
        return spans, items


def merged(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(items: DataFrame, window: int, block_words: int, id_col: str, text_col: str) -> DataFrame:
    """(block, automaton): items dealt by hash into blocks of about ``block_words`` words, each
    block's automaton built in one task and written to the shared folder."""
    view = doc_view(items, id_col, text_col)
    size = view.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        pairs = [(int(i), words(t)) for i, t in zip(group["doc_id"], group["text"], strict=True)]
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "automaton": [pickle.dumps(Automaton(pairs, window), 5)]})

    dealt = view.where("doc_id is not null").distinct().withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("block").applyInPandas(build, "block int, automaton binary"), "automata")


def scan_documents(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text", block_words: int = 250_000, block_bytes: int = 100 << 20) -> DataFrame:
    """doc_id, row (a number of the input row), n_words, spans (merged hit word spans), items.

    One pass over the documents a block of items: the block's automaton is broadcast after its
    size is checked, so a benchmark of any size is handled without growing what a task holds.
    With several blocks the spans and items of a row are united. A null or wordless text has no
    words; items without words or id never match; repeated items count once.
    """
    rows = doc_view(docs, id_col, text_col)
    built = automata(items, window, block_words, item_id, item_text)
    names = sorted(r.block for r in built.select("block").collect())  # one small number a block
    if len(names) <= 1:
        return _block_scan(names[0] if names else None, rows, built, block_bytes, keyed=False)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate_rows")
    return _all_blocks(rows, built, names, block_bytes).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), _unite(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    ).drop("row")  # a group is one row's findings in each block


def _automaton(built: DataFrame, block: int, most: int) -> Automaton:
    """A block's automaton; its size is looked at before it is gathered."""
    one = built.where(F.col("block") == block)
    require_at_most(one.select(F.length("automaton")).first()[0], most, "bytes of an automaton")
    return pickle.loads(one.first().automaton)


def _block_scan(block: int | None, rows: DataFrame, built: DataFrame, block_bytes: int, keyed: bool) -> DataFrame:
    """Findings of one block's automaton in each row of (doc_id, text) or, ``keyed``, (doc_id, text, row)."""
    sent = rows.sparkSession.sparkContext.broadcast(Automaton([], 1) if block is None else _automaton(built, block, block_bytes))
    out = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.int64()))]
    schema = "doc_id long, n_words long, spans array<array<long>>, items array<long>"

    def job(batches: Iterator[pa.RecordBatch]):
        automaton = sent.value
        for b in batches:
            got = [_scanned(automaton, t) for t in b.column(1).to_pylist()]
            cols = [b.column(0), [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]]
            yield record([*out, ("row", pa.int64())], [*cols, b.column(2)]) if keyed else record(out, cols)

    return arrow_map(rows, job, schema + ", row long" if keyed else schema)


def _all_blocks(rows: DataFrame, built: DataFrame, names: Sequence[int], block_bytes: int) -> DataFrame:
    """Each block's findings in each row of the written table (doc_id, text, row)."""
    parts = [_block_scan(n, rows, built, block_bytes, keyed=True) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _unite(spans: Column) -> Column:
    return F.udf(lambda xs: [list(x) for x in merged([tuple(s) for part in xs for s in part])], "array<array<long>>")(spans)


def _scanned(automaton: Automaton, text: str) -> tuple[int, list[list[int]], list[int]]:
    ws = words(text)
    spans, found = automaton.scan(ws)
    return len(ws), [list(x) for x in merged(spans)], list(found)


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, coverage, longest: one row a
    row of ``docs``. Options are those of scan_documents."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    longest = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: F.greatest(n, s[1] - s[0]))
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return scan_documents(docs, items, **options).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(named.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.when(F.col("n_words") > 0, hit / F.col("n_words")).otherwise(F.lit(0.0)).alias("coverage"), longest.alias("longest"),
    )


def clean_text(automaton: Automaton, text: str | None, max_coverage: float) -> str | None:
    """The text without its hit spans; None if they cover more than ``max_coverage`` of its words.
    A text without hits is returned as it is."""
    if not text:
        return text
    return without(text, merged(automaton.scan(words(text))[0]), max_coverage)


def without(text: str, spans: Sequence[tuple[int, int]], max_coverage: float) -> str | None:
    """The text without the merged word spans; None if they cover more than ``max_coverage`` of its words."""
    if not spans:
        return text
    at = [m.span() for m in _WORDS.finditer(lower_ascii(text))]
    if sum(b - a for a, b in spans) > max_coverage * len(at):
        return None
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*kept, text[last:]])


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text", block_words: int = 250_000, block_bytes: int = 100 << 20) -> DataFrame:
    """``docs`` with hit spans cut from the texts; rows of which more than ``max_coverage`` of the
    words are hit go. All columns stay as they are but the text. A null text stays null. With
    several blocks of items each is held against the whole text as it came; a row's spans are
    united, then judged and cut once, so the result does not depend on the blocks."""
    built = automata(items, window, block_words, item_id, item_text)
    names = sorted(r.block for r in built.select("block").collect())  # one small number a block
    if not names:
        return docs
    key, found = "__row", "__spans"

    def outcome(texts: list[str | None], new: list[str | None]) -> tuple[list, list]:
        return new, [t is None or n is not None for t, n in zip(texts, new, strict=True)]

    if len(names) == 1:
        sent = docs.sparkSession.sparkContext.broadcast(_automaton(built, names[0], block_bytes))
        return map_texts(docs, text_col, lambda texts: outcome(texts, [clean_text(sent.value, t, max_coverage) for t in texts]))
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "decontaminate_rows")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    view = rows.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), F.col(key).alias("row"))
    hits = _all_blocks(view, built, names, block_bytes).where(F.size("spans") > 0).groupBy(F.col("row").alias(key)).agg(_unite(F.collect_list("spans")).alias(found))

    @F.pandas_udf(_CUT)
    def cut_spans(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        release()
        new = [t if s is None else without(t, [tuple(x) for x in s], max_coverage) for t, s in zip(texts, spans, strict=True)]
        return pd.DataFrame({"stays": outcome(texts.tolist(), new)[1], "text": new})

    cut = rows.join(hits, key, "left").withColumn("__cut", cut_spans(F.col(f"`{text_col}`"), F.col(found))).where("__cut.stays")
    return cut.withColumn(text_col, F.col("__cut.text")).select(*[F.col(f"`{c}`") for c in docs.columns])


_CUT = "struct<stays: boolean, text: string>"


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of 10 words."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[p : p + least(len(w), 10) - 1] AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, w[p : p + n - 1] AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id),
runs AS (SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, grp, count(*) AS c FROM (
          SELECT doc_id, q, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS grp FROM
            (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits)) GROUP BY doc_id, grp) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its.names, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated,
       CASE WHEN len(d.w) > 0 THEN coalesce(pos.n_hit, 0)::DOUBLE / len(d.w) ELSE 0.0 END AS coverage, coalesce(runs.longest, 0)::BIGINT AS longest
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN runs USING (doc_id)
"""
