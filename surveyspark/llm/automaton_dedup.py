"""Substring dedup on words: suffix automata of reference shards, documents streamed through.

The reference of a document is every document with a smaller id, so the shards are cut by
content instead of by file: a shard holds the contested stretches of one bucket of anchors
(see ``spans``). Its automaton grows in order of document id; each document's stretches run
through it before they are added, and matching statistics of at least the window length mark
windows that began in a smaller document. An automaton of the whole corpus, sent to every
executor, would have no size bound, and documents times shards would be quadratic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import edge_bytes, small_join
from surveyspark.llm.spans import Contested, Rule, cut_lineage, read_spans, repeated_spans, spans_width


class SuffixAutomaton:
    """Generalised suffix automaton over hashable symbols."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """State for the strings of ``q`` that reach it through ``p``."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, symbols: list) -> None:
        at = 0
        for x in symbols:
            q = self.next[at].get(x)
            if q is not None:
                at = q if self.length[q] == self.length[at] + 1 else self._split(at, x, q)
                continue
            new = self._state(self.length[at] + 1, 0, {})
            p = at
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][x]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, x, q)
            at = new

    def statistics(self, symbols: list) -> list[int]:
        """Length of the longest match that ends at each symbol."""
        at, length, out = 0, 0, []
        following, link, longest = self.next, self.link, self.length
        for x in symbols:
            while at and x not in following[at]:
                at = link[at]
                length = longest[at]
            q = following[at].get(x)
            if q is not None:
                at, length = q, length + 1
            out.append(length)
        return out


def automaton_method(width: int):
    def method(c: Contested) -> np.ndarray:
        automaton = SuffixAutomaton()
        found = np.zeros(int(c.n.sum()), bool)
        first = np.cumsum(c.n) - c.n
        symbols = c.symbols.tolist()
        own: list[list] = []
        before = None
        for i, (k1, ask) in enumerate(zip(c.k1.tolist(), c.ask.tolist())):
            if k1 != before:  # stretches of one document don't see each other
                for x in own:
                    automaton.add(x)
                own, before = [], k1
            part = symbols[c.offs[i] : c.offs[i + 1]]
            if ask:
                stats = automaton.statistics(part)
                found[first[i] : first[i] + c.n[i]] = np.array(stats[width - 1 :]) >= width
                if stats and stats[-1] == len(part):
                    continue  # it is in the automaton as a whole
            own.append(part)
        return found

    return method


def _remove(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = edge_bytes(batch.column("text"))
            n_words, n_removed, sha, kept = [], [], [], []
            raw = data.tobytes()
            for i, lists in enumerate(batch.column("spans").to_pylist()):
                words = raw[offs[i] : offs[i + 1]].split()
                n_words.append(len(words))
                spans = read_spans(lists).tolist()
                for s, e in reversed(spans):
                    del words[s:e]
                rest = b" ".join(words)
                n_removed.append(n_words[-1] - len(words))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
                + ([pa.array(kept, pa.binary()).cast(pa.string())] if "kept" in names else []), names=names)

    return run


def remove_seen(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, k: int = 5, with_text: bool = False) -> DataFrame:
    """Words covered by a ``width``-word window that also starts in a document with a smaller id are cut out.

    Returns doc_id, n_words, n_removed, kept_sha256, and ``kept`` (words joined by one space)
    if asked for. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null texts have none. Repeated
    rows of one id don't see each other (no id is smaller); a row with a null id has no
    place in the order: it keeps all words and causes no removal. Other columns are not read.
    Words are compared by 64-bit hashes of their bytes.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    src = src.withColumns({"k1": F.col("doc_id"), "k2": F.xxhash64("doc_id", "text")})
    found = repeated_spans(src.filter(F.col("doc_id").isNotNull()), Rule(width, k, words=True, smaller=True), automaton_method(width))
    spans = cut_lineage(found)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return small_join(src, spans, ["k1", "k2"], "left", spans_width()).select("doc_id", "text", "spans").mapInArrow(_remove(names), schema)
