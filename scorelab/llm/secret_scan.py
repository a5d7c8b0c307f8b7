"""Secrets by pattern and by a linear-chain conditional random field.

The patterns are fixed. The field tags tokens as B(egin), I(nside) or O(utside) from the shape of
the token, the words around it and features of the whole text, and is decoded by Viterbi. It is
trained on a bounded sample of the corpus whose tags come from the patterns, so that it learns what
secrets look like and where they stand, and finds those that the patterns do not cover.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm.common import arrow_map, doc_view, held, map_texts, record, table

# The base patterns, in their order, with the group and least length that count.
KINDS = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # the runs of [0-9a-f]+ that have 16 or more
)
METHOD_KIND = "crf"
TOKENS_KEY = "secret tokens"

Span = tuple[int, int, int]  # start, kind number, end


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, ordered by start, then kind. A span is the whole match."""
    found: list[Span] = []
    for k, (name, rx, group, least) in enumerate(KINDS):
        if name == "assign" and "=" not in text and ":" not in text:
            continue
        found += [(m.start(), k, m.end()) for m in rx.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def _secret_part(text: str, span: Span) -> tuple[int, int]:
    """The secret itself within a base span: without an assignment's name."""
    start, k, end = span
    return (KINDS[k][1].match(text, start).span(2) if KINDS[k][0] == "assign" else (start, end))


_TOKEN = re.compile(r"[\w+/=-]+|[^\s\w+/=-]+")
_SHAPES = 4096
_WORDS = 4096
_FILE = 8
B, I, O = 0, 1, 2  # noqa: E741


_DIGITS = frozenset("0123456789")
_HEX = frozenset("0123456789abcdefABCDEF")


def shape(token: str) -> int:
    """A number below 4096 for length, character classes, switches between them and variety."""
    n, kinds = len(token), set(token)
    size = min(7, n.bit_length() - 1) if n < 12 else min(7, 3 + (n >= 16) + (n >= 20) + (n >= 32) + (n >= 48))
    far, hexa = not token.isascii(), n >= 8 and kinds <= _HEX
    variety = min(1, len(kinds) * 2 // min(n, 32)) if n >= 8 else 0
    if token.isalpha() and token.islower():
        lower, upper, other, share, switches = 1, 0, 0, 0, 0
    else:
        lower, upper = any("a" <= c <= "z" for c in kinds), any("A" <= c <= "Z" for c in kinds)
        other, digit = not token.isalnum(), sum(map(token.count, kinds & _DIGITS))
        share = 0 if not digit else 1 if 4 * digit < n else 2 if digit < n else 3
        row = [0 if c.isdigit() else 1 if c.islower() else 2 for c in token[:64]]
        switches = min(3, sum(a != b for a, b in zip(row, row[1:], strict=False)) * 8 // n)
    bits = (size, 8), (lower, 2), (upper, 2), (other, 2), (far, 2), (hexa, 2), (share, 4), (switches, 4), (variety, 2)
    code = 0
    for v, base in bits:
        code = code * base + int(v)
    return code % _SHAPES


def word_number(token: str) -> int:
    """Neighbouring words: short tokens by themselves, long or odd ones as one class."""
    w = token.lower()
    return 1 if len(w) > 12 else 2 + zlib.crc32(w.encode()) % (_WORDS - 2)


def file_number(text: str, tokens: int) -> int:
    """Features of the whole text: its size and how much of it is code-like punctuation."""
    marks = sum(map(text.count, "=:{}\"'_")) * 50 // max(tokens, 1)
    return (tokens > 200) * 4 + min(3, marks.bit_length())


class Field:
    """Weights of the chain: shapes, the two words before and the one after, file, transitions."""

    def __init__(self):
        self.shape = np.zeros((_SHAPES, 3))
        self.near = np.zeros((3, _WORDS, 3))  # offsets -1, -2, +1
        self.file = np.zeros((_FILE, 3))
        self.move = np.zeros((3, 3))
        self.first = np.zeros(3)

    def lead(self, sh: np.ndarray, wd: np.ndarray, file: int) -> np.ndarray:
        """How much better B and I fit each token than O does, its neighbours being as they are."""
        d = self.d_shape[sh] + self.d_file[file]
        d[1:] += self.d_near[0, wd[:-1]]
        d[2:] += self.d_near[1, wd[:-2]]
        d[:-1] += self.d_near[2, wd[1:]]
        return d

    def allowed(self) -> np.ndarray:
        m = self.move.copy()
        m[O, I] = -1e9  # inside needs a beginning
        return m

    def prepare(self) -> None:
        """Scores relative to O, and the bounds that let ``tag`` leave out what can't be a secret."""
        self.d_shape = self.shape[:, :2] - self.shape[:, 2:]
        self.d_near = self.near[:, :, :2] - self.near[:, :, 2:]
        self.d_file = self.file[:, :2] - self.file[:, 2:]
        m = self.allowed()
        # the most that a step to B or I, and the step out again, can win over staying at O
        self.gain = np.array([max(m[a, x] for a in range(3) if m[a, x] > -1e8) for x in (B, I)]) - m[O, O]
        self.leave = max(0.0, max(m[B, O], m[I, O]) - m[O, O])
        self.slack = 1.0
        # what a path can win by staying in a secret over leaving it and entering again
        bridge = max(0.0, max(m[x, y] for x in (B, I) for y in (B, I)) - m[O, O]) + max(0.0, m[O, O] - min(m[O, B], m[B, O], m[I, O])) * 2
        self.pad = 2 + math.ceil(bridge / self.slack)

    def viterbi(self, e: np.ndarray, first: np.ndarray) -> list[int]:
        m = self.allowed().tolist()
        score, back = (e[0] + first).tolist(), []
        for row in e[1:].tolist():
            choice, new = [], []
            for y in range(3):
                x = max(range(3), key=lambda x: score[x] + m[x][y])
                choice.append(x)
                new.append(score[x] + m[x][y] + row[y])
            score = new
            back.append(choice)
        tag = max(range(3), key=score.__getitem__)
        tags = [tag]
        for choice in reversed(back):
            tag = choice[tag]
            tags.append(tag)
        return tags[::-1]

    def start(self) -> np.ndarray:
        s = self.first.copy()
        s[I] = -1e9
        return s

    def tag(self, sh: np.ndarray, wd: np.ndarray, file: int, whole: bool = False) -> list[tuple[int, int]]:
        """Token spans (first, last + 1) tagged as secrets, by Viterbi.

        A token is cold if B and I lose more than ``slack`` there, whatever steps lead to it and
        away. A path through cold tokens loses ``slack`` at each, so a secret can only reach
        ``pad`` tokens beyond a hot one; elsewhere the best tag is O. Only those stretches are
        decoded (``whole``: everything, for tests).
        """
        n = len(sh)
        d = self.lead(sh, wd, file)
        hot = np.arange(n) if whole else np.flatnonzero((d + self.gain).max(1) + self.leave > -self.slack)
        spans: list[tuple[int, int]] = []
        at = 0
        while at < len(hot):
            a, b = max(0, hot[at] - self.pad), hot[at] + self.pad + 1
            at += 1
            while at < len(hot) and hot[at] - self.pad <= b:
                b = hot[at] + self.pad + 1
                at += 1
            b = min(n, b)
            e = np.zeros((b - a, 3))
            e[:, :2] = d[a:b]
            tags = self.viterbi(e, self.start() if a == 0 else self.allowed()[O])
            open_at = None
            for i, t in enumerate([*tags, O]):
                if t != I and open_at is not None:
                    spans.append((a + open_at, a + i))
                    open_at = None
                if t == B:
                    open_at = i
        return spans


class _Codes(dict):
    """shape * 4096 + word number by token, worked out when first met."""

    def __missing__(self, token: str) -> int:
        self[token] = code = shape(token) * _WORDS + word_number(token)
        return code


class Tokens:
    """Shape and word numbers by token, kept between texts up to a bound."""

    def __init__(self, most: int = 500_000):
        self.known, self.most = _Codes(), most

    def numbers(self, tokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most:
            self.known.clear()
        codes = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        return codes // _WORDS, codes % _WORDS


def field_spans(field: Field, seen: Tokens, text: str, whole: bool = False) -> list[tuple[int, int]]:
    """Character spans that the field tags as secrets."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return []
    sh, wd = seen.numbers(tokens)
    spans = field.tag(sh, wd, file_number(text, len(tokens)), whole)
    if not spans:
        return []
    at = [m.span() for m in _TOKEN.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def united(spans: Sequence[Span]) -> list[tuple[int, int]]:
    """Disjoint stretches covered by spans that are sorted by start."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def all_spans(field: Field, seen: Tokens, text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): the field adds what base spans don't cover entirely. A field span
    that goes beyond a base span stays whole, so the two may overlap."""
    base = base_spans(text)
    known = united(base)
    extra = []
    for a, b in field_spans(field, seen, text):
        at = bisect.bisect_right(known, a, key=lambda s: s[0]) - 1  # the last stretch that starts by a
        if at < 0 or known[at][1] < b:
            extra.append((a, len(KINDS), b))
    return base, sorted(base + extra)


def shown(spans: Sequence[Span]) -> str:
    names = [k[0] for k in KINDS] + [METHOD_KIND]
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def train(texts: Sequence[str], rounds: int = 40, l2: float = 2.0, context: int = 40, plain: int = 2) -> Field:
    """Maximum likelihood by gradient steps on windows around pattern secrets and on plain
    stretches. A token is tagged from the patterns: B where a secret begins, I inside, else O.

    Words next to a secret are weighted by how often they are seen, with an L2 prior, so a
    word met once hardly counts.
    """
    seqs, seen_tokens = [], Tokens()
    for text in texts:
        at = [m.span() for m in _TOKEN.finditer(text)]
        if not at:
            continue
        toks = [text[a:b] for a, b in at]
        tags = np.full(len(toks), O)
        for span in base_spans(text):
            s, e = _secret_part(text, span)
            inside = [i for i, (a, b) in enumerate(at) if a < e and s < b]
            if inside and (tags[inside] == O).all():
                tags[inside] = I
                tags[inside[0]] = B
        file, (shapes, words) = file_number(text, len(toks)), seen_tokens.numbers(toks)
        marks = np.flatnonzero(tags == B)
        starts = {max(0, int(m) - context // 2) for m in marks} | set(range(0, len(toks), max(context, len(toks) // max(1, plain))))
        for s in sorted(starts):
            part = slice(s, s + context)
            if len(toks[part]) >= 2:
                seqs.append((shapes[part], words[part], file, tags[part]))
    field = Field()
    if not seqs:
        field.shape[:, O] = 5.0
        field.prepare()
        return field
    n, width = len(seqs), max(len(s[0]) for s in seqs)
    sh, wd, y, mask = np.zeros((n, width), int), np.zeros((n, width), int), np.full((n, width), O), np.zeros((n, width), bool)
    fl = np.array([s[2] for s in seqs])
    for i, (a, b, _, t) in enumerate(seqs):
        sh[i, : len(a)], wd[i, : len(a)], y[i, : len(a)], mask[i, : len(a)] = a, b, t, True
    onehot = np.eye(3)[y] * mask[..., None]
    params = ("shape", "near", "file", "move", "first")
    mean = {p: np.zeros_like(getattr(field, p)) for p in params}
    square = {p: np.zeros_like(getattr(field, p)) for p in params}
    for step in range(1, rounds + 1):
        e = field.shape[sh] + field.file[fl][:, None]
        e[:, 1:] += field.near[0][wd[:, :-1]]
        e[:, 2:] += field.near[1][wd[:, :-2]]
        e[:, :-1] += field.near[2][wd[:, 1:]] * mask[:, 1:, None]
        m, first = field.allowed(), field.start()
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + first
        for t in range(1, width):  # sequences of different lengths: padding repeats the last sum
            new = _logsum(alpha[:, t - 1, :, None] + m, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            new = _logsum(m + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        z = _logsum(alpha[:, -1], 1)
        p = np.exp(np.clip(alpha + beta - z[:, None, None], -700, 0)) * mask[..., None]
        diff = onehot - p
        pair = np.exp(np.clip(alpha[:, :-1, :, None] + m + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None], -700, 0)) * mask[:, 1:, None, None]
        true = onehot[:, :-1, :, None] * onehot[:, 1:, None, :]
        grad = {p_: np.zeros_like(getattr(field, p_)) for p_ in params}
        np.add.at(grad["shape"], sh, diff)
        np.add.at(grad["near"][0], wd[:, :-1], diff[:, 1:])
        np.add.at(grad["near"][1], wd[:, :-2], diff[:, 2:])
        np.add.at(grad["near"][2], wd[:, 1:], diff[:, :-1] * mask[:, 1:, None])
        np.add.at(grad["file"], fl, diff.sum(1))
        grad["move"] = (true - pair).sum((0, 1))
        grad["move"][O, I] = 0
        grad["first"] = diff[:, 0].sum(0)
        for p_ in params:  # Adam with a prior
            g = grad[p_] - l2 * getattr(field, p_)
            mean[p_] = 0.9 * mean[p_] + 0.1 * g
            square[p_] = 0.99 * square[p_] + 0.01 * g * g
            new = getattr(field, p_) + 0.3 * (mean[p_] / (1 - 0.9**step)) / (np.sqrt(square[p_] / (1 - 0.99**step)) + 1e-8)
            setattr(field, p_, new)
    seen = np.zeros(_SHAPES, bool)
    seen[sh[mask]] = True
    field.shape[~seen] = [-4.0, -4.0, 4.0]  # a shape never met is no evidence of a secret
    field.prepare()
    return field


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train_on(docs: DataFrame, sample: int = 1000, most_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Train on a bounded sample: the ``sample`` texts of at most ``most_chars`` characters with
    the smallest hashes. Tagging reads every whole text."""
    view = doc_view(docs, id_col, text_col).where(F.length("text") <= most_chars).withColumn("h", F.xxhash64("text", F.lit(7)))
    last = [r.h for r in view.select("h").orderBy("h").limit(sample).collect()][-1:]  # hashes alone are gathered
    if not last:
        return train([])
    drawn = view.where(F.col("h") <= last[0]).groupBy("h").agg(F.min("text").alias("text"))  # copies count once
    return train(sorted(r.text for r in drawn.collect()))


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf: one row a row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    out = [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_crf", pa.int64())]

    def job(batches: Iterator[pa.RecordBatch]):
        chain, seen = sent.value, _tokens()
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base, spans = all_spans(chain, seen, t)
                n = Counter(k for _, k, _ in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), len(spans) - len(base)))
            yield record(out, [b.column(0), *([r[i] for r in rows] for i in range(6))])

    return arrow_map(doc_view(docs, id_col, text_col), job, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long", TOKENS_KEY)


def _tokens() -> Tokens:
    """The worker process' own numbers, kept between tasks."""
    return held(TOKENS_KEY, Tokens)


def redact(text: str | None, spans: Sequence[Span], mark: str = "[SECRET]") -> str | None:
    if not spans:
        return text
    kept, last = [], 0
    for a, _, b in spans:
        if a >= last:
            kept += [text[last:a], mark]
        last = max(last, b)
    return "".join([*kept, text[last:]])


def redacted(docs: DataFrame, field: Field, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span replaced by ``mark``; all rows and columns stay. Texts
    without secrets, and null texts, are returned as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def job(texts: list[str | None]) -> tuple[list, None]:
        return [None if t is None else redact(t, all_spans(sent.value, _tokens(), t)[1], mark) for t in texts], None

    return map_texts(docs, text_col, job, TOKENS_KEY)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: the base patterns and the field trained on this corpus."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train_on(docs))
