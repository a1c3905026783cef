"""Hierarchical multi-length packing of documents into training sequences.

Each task packs the documents it reads. Whole windows of the longest context are cut off a
document first; what is left goes to the tier of the smallest context that holds it. A tier
is packed longest first: a window takes one document of its tier, its gap is filled with the
longest waiting pieces of its own and the shorter tiers that fit, and what then is missing
is cut from the next one, so windows are exactly full. What a task has left at its end
goes into windows of descending tiers; only the very last is padded. Windows of a tier form
step groups of the same number of tokens.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.bpe import Vocabulary
from surveyspark.llm.common import batches_of, released

TIERS = (2048, 1024, 512, 256)
END = 1
STEP_TOKENS = 1 << 16
FLUSH_TOKENS = 1 << 21
#: Characters that are encoded at a time; a longer text alone, whole.
PART_CHARS = 1 << 18

Piece = tuple[int, int, int]  # document, start, length


class Packer:
    """Pieces of documents that wait for a window, shortest first."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.waiting: list[tuple[int, int, int]] = []  # length, document, start
        self.tokens = 0

    def add(self, document: int, length: int) -> Iterator[tuple[int, list[Piece]]]:
        """Whole windows of the longest tier; the rest of the document waits."""
        top, start = self.tiers[0], 0
        while length - start >= top:
            yield top, [(document, start, top)]
            start += top
        if length > start:
            self._wait(length - start, document, start)

    def _wait(self, length: int, document: int, start: int) -> None:
        insort(self.waiting, (length, document, start))
        self.tokens += length

    def _take(self, at: int) -> tuple[int, int, int]:
        piece = self.waiting.pop(at)
        self.tokens -= piece[0]
        return piece

    def window(self, size: int) -> list[Piece]:
        """One full window: the longest fitting pieces, then a cut. Needs ``size`` waiting tokens."""
        out, room = [], size
        while room:
            at = bisect_right(self.waiting, (room, np.inf, np.inf)) - 1
            if at >= 0 and (self.waiting[at][0] == room or len(out) < 8):
                length, document, start = self._take(at)
                out.append((document, start, length))
                room -= length
            else:  # the shortest piece that is too long (or the longest at all) gives its head
                at = min(at + 1, len(self.waiting) - 1)
                length, document, start = self._take(at)
                cut = min(length, room)
                out.append((document, start, cut))
                if length > cut:
                    self._wait(length - cut, document, start + cut)
                room -= cut
        return out

    def full(self) -> Iterator[tuple[int, list[Piece]]]:
        """Windows while there are tokens for one of the longest tier: each in the tier of its longest piece."""
        while self.tokens >= self.tiers[0]:
            longest = self.waiting[-1][0]
            size = min(t for t in self.tiers if t >= min(longest, self.tiers[0]))
            yield size, self.window(size)

    def rest(self) -> Iterator[tuple[int, list[Piece]]]:
        yield from self.full()
        for size in self.tiers:
            while self.tokens >= size:
                yield size, self.window(size)
        if self.tokens:
            yield self.tiers[0], [(d, s, n) for n, d, s in (self._take(0) for _ in range(len(self.waiting)))]


COLUMNS = (("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
           ("offset", pa.int64()), ("context", pa.int32()), ("step_group", pa.int64()))


def _pack(path: str, tiers: tuple[int, ...], step_tokens: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, packer = Vocabulary.load(path), Packer(tiers)
        task = TaskContext.get().partitionId() << 32
        ids: dict[int, np.ndarray] = {}
        doc_ids: dict[int, int | None] = {}
        sequences, groups, in_group = 0, 0, {t: [0, 0] for t in tiers}
        documents = size = 0
        windows: list[tuple[int, list[Piece]]] = []
        kind = None

        def emit() -> pa.RecordBatch:
            nonlocal sequences, groups
            cols: list[list] = [[] for _ in range(len(COLUMNS) + 1 + with_ids)]
            for context, pieces in windows:
                state = in_group[context]  # group, windows it still takes
                if not state[1]:
                    state[0], state[1] = task + groups, max(step_tokens // context, 1)
                    groups += 1
                state[1] -= 1
                offset = 0
                for d, s, n in pieces:
                    own = ids[d][s : s + n]
                    row = (doc_ids[d], s, n, zlib.crc32(own.tobytes()), len(ids[d]), task + sequences, offset, context, state[0])
                    for c, v in zip(cols, row + ((own.tolist(),) if with_ids else ())):
                        c.append(v)
                    offset += n
                sequences += 1
            windows.clear()
            alive = {d for _, d, _ in packer.waiting}
            for d in [d for d in ids if d not in alive]:
                del ids[d], doc_ids[d]
            types = [kind, *(t for _, t in COLUMNS)] + [pa.list_(pa.int64())] * with_ids
            names = ["doc_id", *(n for n, _ in COLUMNS)] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= PART_CHARS):
                    chars += len(texts[to])
                    to += 1
                for key, own in zip(keys[at:to], vocabulary.encode(texts[at:to])):
                    own = np.append(own, END).astype("<u4")
                    ids[documents], doc_ids[documents] = own, key
                    windows += packer.add(documents, len(own))
                    documents += 1
                    size += len(own)
                at = to
                if size >= FLUSH_TOKENS:
                    windows += packer.full()
                    yield emit()
                    size = 0
        if documents:
            windows += packer.rest()
            yield emit()

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group (and ids).

    A document is its token ids by the vocabulary file ``path`` and the end id; a null text is
    empty and has the end id alone. Rows are packed each for itself, repeated rows and null
    ids included. Sequence ids hold the number of the task that packed them; a task that is
    run again gives the same ones. Other columns are not read.
    """
    batches_of(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, step_group long"
    return src.mapInArrow(released(_pack(path, tiers, step_tokens, with_ids)), schema + ", ids array<long>" * with_ids)
