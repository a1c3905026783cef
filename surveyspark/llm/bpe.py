"""Ids of a public byte-level BPE vocabulary for whole columns of texts.

The pre-tokenizer of that vocabulary cuts a text into words that never merge with each
other. They are found for all texts of a batch at once with array operations, and every
distinct word is encoded once. Texts that hold a special token go through the tokenizer
itself. Results equal ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np
import pandas as pd

from surveyspark.llm.common import BASE, SubHashes, mix

_U = np.uint64
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# fixed values: contractions that the vocabulary's pre-tokenizer splits off, in its order
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# the word pattern of that pre-tokenizer (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_KEPT_WORDS = 400_000


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = _LETTER
        elif kind == "N":
            table[c] = _NUMBER
    table[list(_SPACES)] = _SPACE
    return table


def word_starts(codes: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a word starts at each character; ``offs`` are the bounds of the texts."""
    kind = classes[codes]
    first = np.zeros(len(codes) + 1, bool)
    first[offs] = True
    run = first.copy()
    run[1:-1] |= kind[1:] != kind[:-1]
    run[-1] = True
    start = run[:-1].copy()
    # the last white space before other characters leaves its run: a space joins what follows
    at = np.flatnonzero(run[1:] & (kind == _SPACE) & ~first[1:])
    start[at] = True
    start[at[codes[at] == 0x20] + 1] = False
    for i in np.flatnonzero((codes == 0x27) & start).tolist():
        end = offs[np.searchsorted(offs, i, side="right")]
        after = "".join(map(chr, codes[i + 1 : min(i + 3, end)]))
        for c in _CONTRACTIONS:
            if after.startswith(c):
                start[i + 1] = False
                if i + 1 + len(c) < end:
                    start[i + 1 + len(c)] = True
                if len(c) == 2:
                    start[i + 2] = False
                break
    return start


class Vocabulary:
    """A byte-level BPE vocabulary file; kept per process with the words met so far."""

    _loaded: dict[str, Vocabulary] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        # byte-level vocabularies write a byte as itself if printable, else as the next free sign from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        signs = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        ranks = {bytes(signs[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.classes = path, _classes()
        self._tokenizer = None
        self._forget()

    def _forget(self) -> None:
        self.words: dict[int, int] = {}  # hash of a word to its number
        self.ids, self.ends = array("I"), array("q", [0])  # ids of all words known, and where each ends

    def _whole(self, text: str) -> np.ndarray:
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        special = {i: self._whole(t) for i, t in enumerate(texts) if any(s in t for s in self.special)}
        plain = ["" if i in special else t for i, t in enumerate(texts)]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in plain])]).astype(np.int64)
        joined = "".join(plain)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        s = np.flatnonzero(word_starts(codes, offs, self.classes)) if len(codes) else np.zeros(0, np.int64)
        e = np.append(s[1:], len(codes))[: len(s)]
        which, h = pd.factorize(SubHashes(mix(codes.astype(_U) * _U(BASE) + _U(1))).of(s, e))
        if len(self.words) > _KEPT_WORDS:
            self._forget()
        known, encode = self.words, self.encoding.encode_ordinary
        number = np.array([known.get(x, -1) for x in h.tolist()], np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            seen = np.maximum.accumulate(which)
            first = np.flatnonzero(np.append(True, seen[1:] > seen[:-1]))[new]
            for i, x, a, b in zip(new.tolist(), h[new].tolist(), s[first].tolist(), e[first].tolist()):
                self.ids.extend(encode(joined[a:b]))
                number[i] = known[x] = len(self.ends) - 1
                self.ends.append(len(self.ids))
        flat, limits = np.array(self.ids, np.uint32), np.array(self.ends, np.int64)
        word = number[which]
        from_, count = limits[word], limits[word + 1] - limits[word]
        ends = np.cumsum(count)
        take = np.arange(int(count.sum())) + np.repeat(from_ - (ends - count), count)
        ids = flat[take]
        bounds = np.concatenate([[0], ends])[np.searchsorted(s, offs)]
        return [special[i] if i in special else ids[a:b] for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
