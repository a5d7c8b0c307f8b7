"""Token counts without tokens: a count-only Viterbi over unigram pieces.

An Aho-Corasick automaton of the vocabulary lists the pieces that end at each character; dynamic
programming carries the best score and the number of pieces to each position. Ties follow the
tokenizer's rule: of equally good ways to reach a position, the one whose last piece starts first
wins. Words are counted on their own, as the tokenizer cuts at each word, and met words are kept.

The tokenizer is ``tokenizers.models.Unigram`` over the pieces and scores of a public vocabulary
file, with byte fallback, cut at white space by Metaspace.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scorelab.llm.common import arrow_map, doc_view, held, record, table

#: Taken off the lowest score for a character that no piece covers: the library's fixed value.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
_WORD = re.compile(f"{SPACE}?[^{SPACE}]+|{SPACE}")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of their ids."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


class WordCounter:
    """Piece counts and best scores of words."""

    def __init__(self, path: str, most: int = 600_000):
        import ahocorasick

        pieces = vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.most = most
        self.known: dict[str, tuple[int, float, int]] = {}

    def word(self, word: str) -> tuple[int, float, int]:
        """(pieces, best score, characters that fall back to bytes)."""
        n = len(word)
        score, count, bad = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        for end, matches in enumerate(ends):
            best, at, single = None, -1, False
            for size, s in matches:
                start = end + 1 - size
                total = score[start] + s
                single = single or size == 1
                if best is None or total > best or (total == best and start < at):
                    best, at = total, start
            if not single:  # the character by itself, as bytes
                total = score[end] + self.unknown
                if best is None or total > best:
                    score[end + 1], count[end + 1], bad[end + 1] = total, count[end] + len(word[end].encode()), bad[end] + 1
                    continue
            score[end + 1], count[end + 1], bad[end + 1] = best, count[at] + 1, bad[at]
        return count[n], score[n], bad[n]

    def text(self, text: str) -> tuple[int, float, int, int]:
        """(pieces, score, byte characters, words)."""
        if not text:
            return 0, 0.0, 0, 0
        text = text.replace(" ", SPACE)
        if text[0] != SPACE:
            text = SPACE + text
        known = self.known
        if len(known) > self.most:
            known.clear()
        words = _WORD.findall(text)
        n, s, b = 0, 0.0, 0
        for w, times in Counter(words).items():
            got = known.get(w)
            if got is None:
                got = self.word(w)
                if len(w) <= 64:
                    known[w] = got
            n, s, b = n + times * got[0], s + times * got[1], b + times * got[2]
        return n, s, b, len(words)


def counter(path: str) -> WordCounter:
    """One counter a worker process, kept between tasks."""
    return held(("counter", path), lambda: WordCounter(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score (of the best segmentation), n_byte_chars, n_words of every whole
    text; no shuffle. A null or empty text has no tokens."""
    out = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("n_byte_chars", pa.int64()), ("n_words", pa.int64())]

    def job(batches: Iterator[pa.RecordBatch]):
        count = counter(path)
        for b in batches:
            rows = [count.text(t) for t in b.column(1).to_pylist()]
            yield record(out, [b.column(0), *([r[i] for r in rows] for i in range(4))])

    return arrow_map(doc_view(docs, id_col, text_col), job, "doc_id long, n_tokens long, score double, n_byte_chars long, n_words long", ("counter", path))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents over the pieces of piece_bpe_32k."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
