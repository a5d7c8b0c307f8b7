"""Exact token ids of whole texts by a public tokenizer file, with a bounded memory of pieces.

Both word-level and byte-level BPE files split a text into pieces that are encoded on their own,
so a piece met before need not be encoded again. Texts are cut only where the tokenizer itself
always cuts; each cut rule below says why. Texts on which a rule can't be relied on go to the
library whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import numpy as np

from scorelab.llm.common import held

#: Latin letters (all of them \\p{L}); a run of them must not touch a non-ASCII character, as
#: that may be a letter or a mark too.
_L = "A-Za-zÀ-ÖØ-öø-įı-ž"  # not U+0130, whose lower case is two characters
_WS = r" \t\n\r\x0b\x0c"
#: White space on which the two regex engines may differ.
_CONTROL = re.compile("[\x1c-\x1f]")
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　᠎​﻿]")

#: word files: white space separates; a leading run of letters is one pre-token.
_WORD = re.compile(rf"[{_L}]++(?![^\x00-\x7f])|[^{_WS}]+")
#: byte files: one space joins the word that follows it; a run of white space gives up its last one.
_BYTE = re.compile(rf" ?[{_L}]++(?![^\x00-\x7f])| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")

#: Pieces that can be encoded many at a time: words alone, and for byte files any run without
#: inner white space (joined by line feeds, which such a file always encodes as one id each).
_ALONE = re.compile(rf"[{_L}]+")
_SPACED = re.compile(r" ?[^\s]+")


class _Numbers(dict):
    """Numbers of pieces; a new piece gets the next one and is put on the list to encode."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class PieceEncoder:
    """ids of texts as little-endian 32-bit runs. ``kind``: "word" or "byte"."""

    def __init__(self, path: str, kind: str, most: int = 700_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.split = _WORD.findall if kind == "word" else _BYTE.findall
        self.kind, self.most = kind, most
        self.numbers, self.runs = _Numbers(), []
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for piece, n in vocab.items():
            self.ends[n] = piece.endswith("</w>") if kind == "word" else piece == "\u010a"  # the byte form of a line feed
        self.bare = Tokenizer.from_file(path)
        if kind == "word":  # for lower-case words alone: the same model without the cutting they don't need
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str], at_once: int = 256) -> list[bytes]:
        """As ``_encode``, with short pieces joined and their ids cut apart again."""
        word = self.kind == "word"
        fits = (_ALONE if word else _SPACED).fullmatch
        joint = [i for i, p in enumerate(pieces) if len(p) < 100 and fits(p)]
        out: list[bytes] = [b""] * len(pieces)
        plain = [i for i in joint if pieces[i].islower()] if word else []
        other = [i for i in joint if not pieces[i].islower()] if word else joint
        for tokenizer, some in ((self.bare, plain), (self.tokenizer, other)):
            groups = [some[k : k + at_once] for k in range(0, len(some), at_once)]
            texts = [(" " if word else "\n").join([pieces[i] for i in g]) for g in groups]
            for g, e in zip(groups, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                cut = np.flatnonzero(self.ends[ids])
                last = (cut + 1 if word else np.append(cut, len(ids))).tolist()
                if len(last) != len(g):  # can't happen for these pieces; they would be encoded one by one
                    for i, run in zip(g, self._encode([pieces[i] for i in g]), strict=True):
                        out[i] = run
                    continue
                raw, a, gap = ids.tobytes(), 0, 0 if word else 4
                for i, b in zip(g, last, strict=True):
                    out[i] = raw[a : 4 * b]
                    a = 4 * b + gap
        single = set(joint)
        rest = [i for i in range(len(pieces)) if i not in single]
        for i, run in zip(rest, self._encode([pieces[i] for i in rest]), strict=True):
            out[i] = run
        return out

    def _whole(self, text: str) -> bool:
        """Whether the cut rules can't be relied on."""
        if text.isascii():
            odd = bool(_CONTROL.search(text))
        else:
            odd = bool(_ODD.search(text)) or not unicodedata.is_normalized("NFC", text)
        return odd or any(s in text for s in self.special)

    def _forget(self, short: int = 8) -> None:
        """Drop the long pieces, which are the rare ones; all of them if that frees too little."""
        old, runs = self.numbers, self.runs
        short += self.kind == "byte"  # the space in front
        keep = [p for p in old if len(p) <= short]
        if 2 * len(keep) > self.most:
            keep = []
        self.runs = [runs[old[p]] for p in keep]
        self.numbers = _Numbers()
        self.numbers.update(zip(keep, range(len(keep)), strict=True))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if len(self.numbers) > self.most:
            self._forget()
        number, plan = self.numbers.__getitem__, []
        whole = [i for i, t in enumerate(texts) if self._whole(t)]
        alone = set(whole)
        for i, t in enumerate(texts):
            if i in alone:
                plan.append(None)
            else:  # lower case first where that is plain: the tokenizer does the same
                plan.append(list(map(number, self.split(t.lower() if self.kind == "word" and t.isascii() else t))))
        if self.numbers.new:
            self.runs += self._encode_pieces(self.numbers.new)
            self.numbers.new = []
        done = dict(zip(whole, self._encode([texts[i] for i in whole]), strict=True)) if whole else {}
        get = self.runs.__getitem__
        return [done[i] if p is None else b"".join(map(get, p)) for i, p in enumerate(plan)]


def encoder_key(path: str, kind: str) -> tuple[str, str, str]:
    return "encoder", path, kind


def encoder(path: str, kind: str) -> PieceEncoder:
    """One encoder a worker process, kept between tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(encoder_key(path, kind), lambda: PieceEncoder(path, kind))


def in_slices(texts: Sequence[str], chars: int = 1_000_000):
    """(first, last) ranges of at most about ``chars`` characters: bounds what a task holds."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
