"""Suffix-array dedup: longest-previous-factor arrays over stretches that may repeat.

A suffix array of 100 TB in one piece can't be; equal windows are brought together first
(see ``spans``). In each bucket the suffixes of all contested stretches are ranked by prefix
doubling up to the window length. In that order, suffixes that share a whole window stand
together, by position: the previous smaller position of an entry is then its left neighbour
if it has one in the run, so its longest previous factor reaches the window length unless it
is first in its run, and its longest next factor does unless it is last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import BYTE_WORDS, SubHashes, edge_bytes, small_join
from surveyspark.llm.spans import Contested, Rule, cut_lineage, read_spans, repeated_spans, spans_width


def window_ranks(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Rank of the ``width`` bytes from each start among all of them, by prefix doubling."""
    padded = np.concatenate([text, np.zeros(width + 8, np.uint8)])
    step, rank = 1, padded[: len(text) + width].astype(np.int64)
    while step < width:
        to = min(2 * step, width)
        here = starts if to == width else np.arange(len(rank) - (to - step))
        pair = rank[here] * (int(rank.max()) + 1) + rank[here + (to - step)]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        step = to
    return rank


def factor_flags(rank: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous, and the longest next, factor of each entry reaches the window.

    Suffix order with ties by position: inside a run of equal windows the left neighbour is
    the previous smaller position, the right neighbour the next greater one.
    """
    order = np.lexsort((position, rank))
    equal = rank[order][1:] == rank[order][:-1]
    previous, following = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    previous[order[1:]] = equal
    following[order[:-1]] = equal
    return previous, following


def lpf_method(width: int):
    def method(c: Contested) -> np.ndarray:
        which = np.repeat(np.arange(len(c.n)), c.n)
        starts = np.arange(int(c.n.sum())) - np.repeat(np.cumsum(c.n) - c.n, c.n) + c.offs[which]
        # windows whose hash is alone can't repeat and stay out of the sort
        h = SubHashes(BYTE_WORDS[c.symbols]).of(starts, starts + width)
        _, group, count = np.unique(h, return_inverse=True, return_counts=True)
        some = count[group] > 1
        found = np.zeros(len(starts), bool)
        if some.any():
            used = np.flatnonzero(some)
            keep = np.unique(which[used])  # contexts that take part
            lens = np.diff(c.offs)[keep]
            take = np.repeat(c.offs[keep], lens) + np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
            moved = np.zeros(len(c.n), np.int64)
            moved[keep] = np.cumsum(lens) - lens
            at = starts[used] - c.offs[which[used]] + moved[which[used]]
            previous, following = factor_flags(window_ranks(c.symbols[take], at, width), used)
            found[used] = previous | following
        return found

    return method


def _remove(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = edge_bytes(batch.column("text"))
            n_removed, n_spans, sha, kept = [], [], [], []
            for i, lists in enumerate(batch.column("spans").to_pylist()):
                own = data[offs[i] : offs[i + 1]]
                spans = read_spans(lists)
                keep = np.ones(len(own), bool)
                for s, e in spans.tolist():
                    keep[s:e] = False
                rest = own[keep].tobytes() if len(spans) else own.tobytes()
                n_removed.append(len(own) - len(rest))
                n_spans.append(len(spans))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
                + ([pa.array(kept, pa.binary())] if "kept" in names else []), names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400, k: int = 64, keep_first: bool = False, with_bytes: bool = False) -> DataFrame:
    """Bytes covered by a ``width``-byte string that also starts elsewhere are cut out.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (the bytes) if
    asked for. Null and shorter texts lose nothing; repeated rows are copies of each other;
    rows with a null id are judged like others. Other columns are not read.
    ``keep_first`` keeps the copy in the document with the smallest id (by the first factor
    array alone) and cuts the later ones.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    src = src.withColumns({"k1": F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), "k2": F.xxhash64("doc_id", "text")})
    rule = Rule(width, k, words=False, smaller=keep_first)
    spans = cut_lineage(repeated_spans(src, rule, first_method(width) if keep_first else lpf_method(width)))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return small_join(src, spans, ["k1", "k2"], "left", spans_width()).select("doc_id", "text", "spans").mapInArrow(_remove(names), schema)


def first_method(width: int):
    """Windows that have a previous factor in a document with a smaller id."""

    def method(c: Contested) -> np.ndarray:
        which = np.repeat(np.arange(len(c.n)), c.n)
        starts = np.arange(int(c.n.sum())) - np.repeat(np.cumsum(c.n) - c.n, c.n) + c.offs[which]
        rank = window_ranks(c.symbols, starts, width)
        previous, _ = factor_flags(rank, np.arange(len(starts)))
        # contexts stand in order of their documents: the head of a run is its first document
        low = np.full(int(rank.max()) + 1 if len(rank) else 0, np.iinfo(np.int64).max)
        np.minimum.at(low, rank, c.k1[which])
        return previous & (c.k1[which] > low[rank])

    return method
