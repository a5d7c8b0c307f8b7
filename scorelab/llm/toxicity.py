"""Toxicity by a noisy channel: obfuscated words are restored, then the restored text is scored.

Writers hide words by look-alike characters (1d10t), spacing (i d i o t, i.d.i.o.t) and repetition
(idiooot). Such a token is a lattice: each run of a character may stand for the letters it looks
like, for itself once or twice, or for nothing. The likeliest reading under a character trigram
model of the corpus, with a cost for each change, is found by Viterbi and stands beside the plain
reading. The model's counts are those of the plain words of all documents. Restored words that mark toxic documents are learned from
labelled rows by grouped counts over all of them, and a logistic curve on them gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm.common import arrow_map, doc_view, record, require_at_most, table, written

# Letters that other characters are read as.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Log costs of the channel: a look-alike, a collapsed run, a dropped symbol or digit.
LOOK_COST, RUN_COST, DROP_COST, DROP_DIGIT_COST = -0.7, -0.7, -6.0, -10.0
#: Log cost of a gap between spaced-out characters that ends a word. A run is read twice, for it may be one word
#: or a whole sentence spelled out.
GAP_COSTS = (-4.0, -0.5)
#: Punctuation that may stand at either end of a spaced-out character.
_ENDS = ".,;:?!\"'()[]{}*#%&-_~…“”‘’«»„"

_PLAIN = re.compile(r"[^\W\d_]+")
_EDGE = re.compile(r"^[^\w@$|+(€£]*|[^\w@$|+)€£]*$")
_TAIL = re.compile(r"([^\w\s])\1+$|^([^\w\s])\2+|[.,;:!?\"')\]}*#%&]+$|^[\"'(\[{*#%&]+")
_RUN = re.compile(r"(.)\1*", re.S)
_DOUBLE = re.compile(r"([^\W\d_])\1")
_DOTTED = re.compile(r"[^\W_](?:([.\-_*~])[^\W_])(?:\1[^\W_])+")
#: Longer tokens and runs of single characters are read in stretches of so many, each starting ``OVERLAP``
#: before the end of the last, so a word of up to that length lies whole in one of them.
STRETCH, OVERLAP = 4096, 256
#: Grams of their own counter; rarer ones beyond that many share ``REST`` counters.
EXACT, REST = 4_000_000, 1_048_573


def _keys(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the trigrams and of their first two characters, how many of either each word has). A word
    stands between two spaces and one; a key holds the characters' numbers, 21 bits each."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    c = np.frombuffer("".join([f"  {w} " for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at = np.arange(int(sizes.sum())) + np.repeat(2 * np.arange(len(words)), sizes)  # a word has two characters more than trigrams
    return np.stack([c[at] << 42 | c[at + 1] << 21 | c[at + 2], 1 << 62 | c[at] << 21 | c[at + 1]]), sizes


class CharModel:
    """Smoothed P(next character | the two before) from counts by gram: sorted ``keys`` with their counts,
    and shared counts of the rare grams of a corpus that has very many (none else)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, rest: np.ndarray | None = None):
        self.keys, self.counts, self.rest = keys, counts.astype(np.float32), rest
        self.known: dict[str, float] = {}

    def __reduce__(self):
        return CharModel, (self.keys, self.counts, self.rest)

    def count(self, key: int) -> float:
        i = int(np.searchsorted(self.keys, key))
        if i < len(self.keys) and self.keys[i] == key:
            return float(self.counts[i])
        return float(self.rest[key % REST]) if self.rest is not None else 0.0

    def logp(self, before: str, c: str) -> float:
        gram = before + c
        got = self.known.get(gram)
        if got is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            x, y, z = map(ord, gram)
            t, b = self.count(x << 42 | y << 21 | z), self.count(1 << 62 | x << 21 | y)
            got = self.known[gram] = math.log((t + 0.02) / (max(b, t) + 1.0))
        return got

    def read(self, parts: Sequence[str], spaced: bool) -> list[str]:
        """Words of the likeliest reading; one lattice up to ``STRETCH`` characters or parts."""
        whole = parts if spaced else parts[0]
        out: list[str] = []
        for a in range(0, max(1, len(whole) - OVERLAP), STRETCH - OVERLAP):
            some = whole[a : a + STRETCH]
            for gap in GAP_COSTS if spaced else GAP_COSTS[:1]:
                out += self.restore(some if spaced else [some], spaced, gap).split()
        return out

    def restore(self, parts: Sequence[str], spaced: bool, gap: float = GAP_COSTS[0]) -> str:
        """The likeliest reading of a token (one part) or of spaced-out characters (many)."""
        states: dict[str, tuple[float, tuple]] = {"  ": (0.0, ())}
        for k, part in enumerate(parts):
            if spaced and k:
                grown = dict(states)
                for s, (score, path) in states.items():
                    if s[1] != " ":
                        self._offer(grown, s, score + gap, path, " ")
                states = grown
            for m in _RUN.finditer(part):
                c, n = m[1], m.end() - m.start()
                new: dict[str, tuple[float, tuple]] = {}
                for s, (score, path) in states.items():
                    for text, cost in _readings(c, n):
                        self._offer(new, s, score + cost, path, text)
                states = new
        best = None
        for s, (score, path) in states.items():
            total = score + (self.logp(s, " ") if s[1] != " " else 0.0)
            if best is None or total > best[0]:
                best = (total, path)
        out: list[str] = []
        path = best[1]
        while path:
            path, text = path
            out.append(text)
        return "".join(reversed(out))

    def _offer(self, states: dict, s: str, score: float, path: tuple, text: str) -> None:
        for c in text:
            score += self.logp(s, c)
            s = s[1] + c
        old = states.get(s)
        if old is None or score > old[0]:
            states[s] = (score, (path, text) if text else path)


def _readings(c: str, n: int) -> list[tuple[str, float]]:
    if c.isalpha():
        out = [(c, RUN_COST if n > 1 else 0.0)]
        if n > 1:
            out.append((c + c, RUN_COST if n > 2 else 0.0))
        return out
    out = [("", DROP_DIGIT_COST if c.isdigit() else DROP_COST)]
    for x in LOOKS_LIKE.get(c, ""):
        cost = LOOK_COST + (RUN_COST if n > 1 else 0.0)
        out.append((x, cost))
        if n > 1:
            out.append((x + x, cost))
    return out


class _Met(dict):
    """What a function gives, kept by argument."""

    def __init__(self, fn):
        self.fn = fn

    def __missing__(self, key):
        self[key] = got = self.fn(key)
        return got


class Restorer:
    """Words of a text after restoring what was obfuscated; met tokens are kept. With ``only``, some words, just
    those of them that occur: a token of letters alone can be read as one of them only if the two are equal
    once every run of a letter is one letter, so the others need no lattice."""

    def __init__(self, model: CharModel, only: frozenset[str] | None = None, most: int = 500_000):
        self.model, self.only, self.most = model, only, most
        self.squeezed = None if only is None else {_squeezed(w) for w in only}
        self.known, self.short = _Met(self._token), _Met(self.single)

    def __reduce__(self):
        return Restorer, (self.model, self.only, self.most)

    def _token(self, token: str) -> tuple[str, ...]:
        got = self.token(token)
        return got if self.only is None else tuple(w for w in got if w in self.only)

    def token(self, token: str) -> tuple[str, ...]:
        """A token's words: the plain ones and, where it has a doubled letter, a digit or a symbol inside, those
        of its lattice beside them."""
        core = token
        if not token.isalpha():
            while core and (m := _TAIL.search(core)) and m.end() > m.start():
                core = core[: m.start()] if m.end() == len(core) else core[m.end() :]
            core = _EDGE.sub("", core)
        if core.isalpha():
            if _DOUBLE.search(core) and (self.squeezed is None or _squeezed(core) in self.squeezed):
                return (core, *self.model.read([core], False))
            return (core,)
        if not any(c.isalpha() for c in core):
            return ()
        if _DOTTED.fullmatch(core):
            return tuple(self.model.read([c for c in core if c.isalnum()], True))
        out = self.model.read([core], False)
        if any(not c.isalpha() and c not in LOOKS_LIKE for c in core):  # a hyphenated word, an address: its parts too
            for part in re.split(r"[^\w@$!|+(€£]+|_", core):
                out += [part] if part.isalpha() else self.model.read([part], False) if any(c.isalpha() for c in part) else []
        return tuple(out)

    def single(self, token: str) -> str:
        """The one character a token has but for punctuation at its ends, or nothing."""
        if len(token) > 1:
            token = token.strip(_ENDS)
        return token if len(token) == 1 and (token.isalnum() or token in LOOKS_LIKE) else ""

    def words(self, text: str) -> set[str]:
        tokens = text.lower().split()
        distinct = set(tokens)
        if len(self.known) > self.most:
            self.known.clear()
            self.short.clear()
        out = set().union(*filter(None, map(self.known.__getitem__, distinct)))
        short = [t for t in distinct if len(t) < 5]
        singles = {t: c for t, c in zip(short, map(self.short.__getitem__, short), strict=True) if c}
        if len(set(singles.values())) > 1 and any(c.isalpha() for c in singles.values()):  # runs of three or more single characters
            at = 0
            while at < len(tokens):
                if tokens[at] not in singles:
                    at += 1
                    continue
                end = at
                while end < len(tokens) and tokens[end] in singles:
                    end += 1
                run = "".join([singles[t] for t in tokens[at:end]])
                if end - at >= 3 and any(c.isalpha() for c in run):
                    out.update(self.model.read([m[0] for m in _RUN.finditer(run)], True))
                at = end
        return out


def _squeezed(word: str) -> str:
    return _RUN.sub(r"\1", word)


def train_chars(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: int = EXACT) -> CharModel:
    """Trigram and context counts of the plain words of all documents: words are counted first, then the grams of
    each distinct word, so the work on grams grows with the vocabulary. Every gram has its own counter, and
    their number grows with the corpus; in one with more than ``exact`` distinct grams the rarest share
    ``REST`` counters, so that what is broadcast stays below 100 MB."""
    out = [("word", pa.string()), ("n", pa.int64())]

    def job(batches: Iterator[pa.RecordBatch]):
        words: Counter = Counter()
        for b in batches:
            for t in b.column(1).to_pylist():
                words.update(_PLAIN.findall(t.lower()))
            if len(words) > 300_000:
                yield record(out, [list(words), list(words.values())])
                words = Counter()
        yield record(out, [list(words), list(words.values())])

    def grams(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                keys, sizes = _keys(b.column(0).to_pylist())
                n = np.repeat(b.column(1).to_numpy(), sizes)
                for k in keys:
                    distinct, of = np.unique(k, return_inverse=True)
                    yield record([("key", pa.int64()), ("n", pa.int64())], [distinct, np.bincount(of, n, len(distinct)).astype(np.int64)])

    words = arrow_map(doc_view(docs, id_col, text_col), job, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(arrow_map(words, grams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "toxicity_grams")
    least, rest = 0, None
    if counted.count() > exact:
        sizes = counted.groupBy("n").count().orderBy(F.desc("n"))  # a row a distinct count
        kept = 0
        for r in sizes.toLocalIterator():
            kept += r["count"]
            if kept > exact:
                least = r.n
                break
        rest = np.zeros(REST, np.float32)
        for r in counted.where(F.col("n") <= least).groupBy((F.col("key") % REST).alias("at")).agg(F.sum("n").alias("n")).toLocalIterator():
            rest[r["at"]] = r["n"]
    found = counted.where(F.col("n") > least).orderBy("key").toPandas()
    return CharModel(found["key"].to_numpy(np.int64), found["n"].to_numpy(float), rest)


def labelled(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, text, label (0/1) of the rows that ``train`` (over doc_id) admits. Labels are
    broadcast while there are at most ``most_broadcast`` of them; beyond it the join is shuffled.
    Of several labels of one doc_id the largest counts; null labels don't."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(train)
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    few = marks.limit(most_broadcast + 1).count() <= most_broadcast
    return doc_view(docs, id_col, text_col).join(F.broadcast(marks) if few else marks, "doc_id")


class Lexicon:
    """Weights of toxic words and the logistic curve over (strongest, sum) of those in a text."""

    def __init__(self, weights: dict[str, float], curve: Sequence[float] = (0.0, 0.0, 0.0)):
        self.weights, self.curve = weights, tuple(curve)

    def features(self, words: set[str]) -> tuple[float, float]:
        found = [self.weights[w] for w in words & self.weights.keys()] if len(words) < len(self.weights) else [v for w, v in self.weights.items() if w in words]
        return (max(found), sum(found)) if found else (0.0, 0.0)

    def score(self, words: set[str]) -> float:
        a, b = self.features(words)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def toxic_words(rows: DataFrame, model: CharModel, least: int = 5, sure: float = 6.0, most: int = 2_000_000) -> dict[str, float]:
    """Words whose share of toxic labelled documents is beyond chance: in at least ``least`` toxic
    documents, and ``sure`` standard errors above the share of all. Counts cover every labelled
    row; tasks add up before the shuffle."""
    sent = rows.sparkSession.sparkContext.broadcast(Restorer(model))
    out = [("word", pa.string()), ("toxic", pa.int64()), ("n", pa.int64())]

    def flush(n: Counter, toxic: Counter):
        words = list(n)
        yield record(out, [words, [toxic[w] for w in words], [n[w] for w in words]])

    def job(batches: Iterator[pa.RecordBatch]):
        n, toxic = Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = sent.value.words(text)
                n.update(words)
                if label:
                    toxic.update(words)
            if len(n) > 300_000:
                yield from flush(n, toxic)
                n, toxic = Counter(), Counter()
        yield from flush(n, toxic)

    counted = arrow_map(rows.select("text", "label"), job, "word string, toxic long, n long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    total = rows.agg(F.sum("label"), F.count("*")).first()
    bad, all_ = float(total[0] or 0), float(total[1])
    if not bad or bad == all_:
        return {}
    share = bad / all_
    z = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    kept = written(counted.where(F.col("toxic") >= least).where(z > sure), "toxicity_words")  # significant words only
    require_at_most(kept.count(), most, "significant words")
    kept = kept.orderBy(F.desc("toxic"), "word").collect()
    return {r.word: math.log((r.toxic + 0.5) / (r.n - r.toxic + 0.5) * (1 - share) / share) for r in kept}


def fit_curve(rows: DataFrame, model: CharModel, weights: dict[str, float], steps: int = 50, l2: float = 1.0) -> Lexicon:
    """Logistic regression on the two features, from counts by (features, label) of all labelled
    rows. Features are rounded to 0.1, so their number is bounded by the lexicon's range."""
    lexicon = Lexicon(weights)
    sent = rows.sparkSession.sparkContext.broadcast((Restorer(model, frozenset(weights)), lexicon))
    out = [("a", pa.int64()), ("b", pa.int64()), ("label", pa.int64()), ("n", pa.int64())]

    def job(batches: Iterator[pa.RecordBatch]):
        restorer, lex = sent.value
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = lex.features(restorer.words(text))
                seen[round(10 * a), round(10 * b), label] += 1
        keys = list(seen)
        yield record(out, [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], [seen[k] for k in keys]])

    got = arrow_map(rows.select("text", "label"), job, "a long, b long, label long, n long").groupBy("a", "b", "label").agg(F.sum("n").alias("n")).orderBy("a", "b", "label").collect()
    if not got:
        return lexicon
    x = np.array([(1.0, r.a / 10, r.b / 10) for r in got])
    y, n = np.array([r.label for r in got], float), np.array([r.n for r in got], float)
    w = np.zeros(3)
    prior = np.diag([1e-6, l2, l2])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (y - p)) - prior @ w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + prior
        w = w + np.clip(np.linalg.solve(h + 1e-9 * np.eye(3), g), -2, 2)
    return Lexicon(weights, w.tolist())


def score(docs: DataFrame, model: CharModel, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row, from the text alone; null is the empty text, which
    gets the curve's value for no toxic word."""
    sent = docs.sparkSession.sparkContext.broadcast((Restorer(model, frozenset(lexicon.weights)), lexicon))
    out = [("doc_id", pa.int64()), ("score", pa.float64())]

    def job(batches: Iterator[pa.RecordBatch]):
        restorer, lex = sent.value
        for b in batches:
            yield record(out, [b.column(0), [lex.score(restorer.words(t)) for t in b.column(1).to_pylist()]])

    return arrow_map(doc_view(docs, id_col, text_col), job, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, admitted: Column) -> tuple[CharModel, Lexicon]:
    model = train_chars(docs)
    rows = labelled(docs, labels, admitted)
    return model, fit_curve(rows, model, toxic_words(rows, model))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted. Learned from labels not held out."""
    docs = table(spark, sf_dir, "documents")
    model, lexicon = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = score(docs, model, lexicon)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
