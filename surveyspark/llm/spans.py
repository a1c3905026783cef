"""Stretches that repeat across a corpus, found through content-defined anchors.

Every window of ``width`` symbols (bytes or words) has an anchor: the smallest-hashed k-mer
inside it. Equal windows have the same anchor at the same place, so a window can only meet
its copies among the stretches around equal anchors. Consecutive windows of one anchor make
one stretch (its *context*), and 17 bytes stand for it in the shuffle (88 bits of hashes, to
which the bucket adds some, place and length):

1. While texts are read, equal contexts met in the same task are settled at once and one of
   them goes on, so a passage with many copies sends a row per task. An anchor with many
   different contexts in a task sends two of them, and the mark that it holds some back; the
   others are known to need a look.
2. Per anchor, equal contexts are settled by their hashes; contexts whose anchor has other
   contexts too are *contested*: parts of them may still repeat.
3. Contested contexts are cut from their texts and given, in buckets of anchors, to the
   method at hand (suffix array or suffix automaton). Anchors with more contexts than one
   task should hold go another, exact way: their windows are counted by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import BYTE_WORDS, SubHashes, batches_of, cut_lineage, mix, partitions, small_join, text_parts, word_hashes

_U = np.uint64
ROW = np.dtype([("anchor", "<u8"), ("ctx", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("s", "<i4"), ("n", "<i4"), ("c", "<i4")])
ASK = np.dtype([("anchor", "<u8"), ("s", "<i4"), ("n", "<u2")])  # the highest bit of n: must be looked at
ASKS = 1 << 15
OUT = "bucket int, kind int, k1 long, k2 long, data binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("data", pa.binary())])
BLOB, SPANS, ASKED = 0, 1, 2
FLUSH = 1 << 20
LOCAL_CONTEXTS = 64
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Rule:
    """``width`` symbols make a window, ``k`` an anchor; ``words`` or bytes; ``smaller``: only copies with a smaller id count."""

    width: int
    k: int
    words: bool
    smaller: bool

    def symbols(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return word_hashes(data, offs) if self.words else (BYTE_WORDS[data], offs)


def contexts(symbols: np.ndarray, offs: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """Row, start (in the row), number of windows, anchor hash and context hash of every context."""
    width, k = rule.width, rule.k
    windows = np.maximum(np.diff(offs) - width + 1, 0)
    total = int(windows.sum())
    if not total:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(_U), empty.astype(_U)
    sub = SubHashes(symbols)
    at = np.arange(len(symbols) - k + 1)
    h = sub.of(at, at + k)
    # the smallest hash and then the leftmost place of each run of ``span`` k-mers
    key = (h & _U(0xFFFFFFFF00000000)) | at.astype(_U)
    span = width - k + 1
    rows = -(-len(key) // span)
    padded = np.full(rows * span, np.iinfo(np.uint64).max, dtype=_U)
    padded[: len(key)] = key
    padded = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    row = np.repeat(np.arange(len(windows)), windows)
    start = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(offs[:-1], windows)
    place = (np.minimum(back[start], ahead[start + span - 1]) & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(total, dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, total))
    s, p, d = start[first], place[first], row[first]
    ctx = mix(sub.of(s, s + n - 1 + width) + (p - s).astype(_U) * _U(0x9FB21C651E98DF25))
    return d, s - offs[d], n, h[p], ctx


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching ``[s, e)`` rows joined, in order."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), dtype=bool)
    new[1:] = spans[1:, 0] > far[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], far[np.append(first[1:], len(spans)) - 1]], axis=1)


def _by_document(kind: int, rows: np.ndarray, width: int, buckets: int) -> dict[str, list]:
    """One output row per document: its merged spans, or its contexts to look at."""
    out: dict[str, list] = {n: [] for n in SCHEMA.names}
    if not len(rows):
        return out
    rows = rows[np.lexsort((rows["k2"], rows["k1"]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows["k1"][1:] != rows["k1"][:-1]) | (rows["k2"][1:] != rows["k2"][:-1])
    first = np.flatnonzero(new)
    for a, b in zip(first, np.append(first[1:], len(rows))):
        part = rows[a:b]
        if kind == SPANS:
            s = part["s"].astype(np.int32)
            data = merged(np.stack([s, s + part["n"] - 1 + width], axis=1)).astype("<i4").tobytes()
        else:
            asked = np.zeros(len(part), ASK)
            asked["anchor"], asked["s"] = part["anchor"], part["s"]
            asked["n"] = part["n"] | np.where(part["c"] < 2, ASKS, 0)
            data = asked.tobytes()
        out["bucket"].append(int(mix(part["k2"][:1].astype(_U))[0] % _U(buckets)))
        out["kind"].append(kind)
        out["k1"].append(int(part["k1"][0]))
        out["k2"].append(int(part["k2"][0]))
        out["data"].append(data)
    return out


def _batch(cols: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in SCHEMA], schema=SCHEMA)


def _write(rows: np.ndarray, held: np.ndarray) -> bytes:
    """Contexts of one bucket as bytes: documents with their number of contexts, columns, then anchors with contexts held back."""
    rows = rows[np.lexsort((rows["s"], rows["k2"], rows["k1"]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows["k1"][1:] != rows["k1"][:-1]) | (rows["k2"][1:] != rows["k2"][:-1])
    first = np.flatnonzero(new)
    columns = [rows["k1"][first], rows["k2"][first], np.diff(np.append(first, len(rows))).astype("<u4"), rows["s"], (rows["n"] | np.where(rows["c"] > 1, ASKS, 0)).astype("<u2"),
               rows["anchor"].copy().view(np.uint8).reshape(-1, 8)[:, :5], rows["ctx"].copy().view(np.uint8).reshape(-1, 8)[:, :6], held.astype("<u8")]
    return np.array([len(first), len(rows)], "<u4").tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _read_blob(data: bytes, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    docs, n = np.frombuffer(data, "<u4", 2).tolist()
    at = 8

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    rows = np.zeros(n, ROW)
    k1, k2, counts = take("<i8", docs), take("<i8", docs), take("<u4", docs)
    rows["k1"], rows["k2"] = np.repeat(k1, counts), np.repeat(k2, counts)
    rows["s"] = take("<i4", n)
    flags = take("<u2", n)
    rows["n"], rows["c"] = flags & (ASKS - 1), 1 + (flags >= ASKS)
    for name, width in (("anchor", 5), ("ctx", 6)):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = take("u1", n * width).reshape(n, width)
        rows[name] = wide.view("<u8").ravel()
    rows["anchor"] |= _U(bucket << 40)
    return rows, np.frombuffer(data, "<u8", offset=at)


def settle(rows: np.ndarray, smaller: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (anchor, context), and which of them are copies by their hashes alone.

    ``c`` of a row becomes 2 where it needs no look of its own.
    """
    rows = rows[np.lexsort((rows["s"], rows["k2"], rows["k1"], rows["ctx"], rows["anchor"]))]
    same = np.zeros(len(rows), dtype=bool)
    same[1:] = (rows["anchor"][1:] == rows["anchor"][:-1]) & (rows["ctx"][1:] == rows["ctx"][:-1])
    head = np.flatnonzero(~same)
    group = np.cumsum(~same) - 1
    if smaller:
        done = rows["k1"] > rows["k1"][head][group]
    else:
        many = np.add.reduceat(np.maximum(rows["c"], 1), head) >= 2
        done = many[group]
    rows["c"][done] = 2
    return rows, done


def _forward(rows: np.ndarray, done: np.ndarray, smaller: bool) -> np.ndarray:
    """Rows that must be seen by others: one per context, and under ``smaller`` all of the smallest document."""
    if smaller:
        return ~done
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["ctx"][1:] != rows["ctx"][:-1])
    return keep


def _context_count(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a sorted array: number of contexts of its anchor, and the rank of its own."""
    anchor_new = np.ones(len(rows), dtype=bool)
    anchor_new[1:] = rows["anchor"][1:] != rows["anchor"][:-1]
    ctx_new = anchor_new.copy()
    ctx_new[1:] |= rows["ctx"][1:] != rows["ctx"][:-1]
    group = np.cumsum(anchor_new) - 1
    count = np.add.reduceat(ctx_new.astype(np.int64), np.flatnonzero(anchor_new)) if len(rows) else np.zeros(0, np.int64)
    rank = np.cumsum(ctx_new) - 1
    return count[group], rank - rank[np.flatnonzero(anchor_new)][group]


def _read(rule: Rule, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """First pass over the texts; see the module text, step 1."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, done = settle(np.concatenate(held), rule.smaller)
        yield _batch(_by_document(SPANS, rows[done], rule.width, buckets))
        rows = rows[_forward(rows, done, rule.smaller)]
        count, rank = _context_count(rows)
        crowded = count > LOCAL_CONTEXTS
        yield _batch(_by_document(ASKED, rows[crowded], rule.width, buckets))
        held = np.unique(rows["anchor"][crowded])
        held_cut = np.searchsorted(held >> _U(40), np.arange(buckets + 1, dtype=_U))
        rows = rows[~crowded | (rank < 2)]
        place = (rows["anchor"] >> _U(40)).astype(np.int64)
        rows, place = rows[np.argsort(place, kind="stable")], np.sort(place)
        cut = np.searchsorted(place, np.arange(buckets + 1))
        full = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        yield _batch({"bucket": full, "kind": [BLOB] * len(full), "k1": [0] * len(full), "k2": [0] * len(full),
                      "data": [_write(rows[cut[b] : cut[b + 1]], held[held_cut[b] : held_cut[b + 1]]) for b in full]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part, data, offs in text_parts(batches, "text"):
            d, s, n, anchor, ctx = contexts(*rule.symbols(data, offs), rule)
            rows = np.zeros(len(d), ROW)
            rows["anchor"] = ((anchor % _U(buckets)) << _U(40)) | (anchor >> _U(24))
            rows["ctx"], rows["s"], rows["n"], rows["c"] = ctx >> _U(16), s, n, 1
            rows["k1"] = part.column("k1").to_numpy(zero_copy_only=False)[d]
            rows["k2"] = part.column("k2").to_numpy(zero_copy_only=False)[d]
            held.append(rows)
            size += len(rows)
            if size >= FLUSH:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _meet(rule: Rule, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Second step: contexts of one bucket of anchors; other rows pass through."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        blobs = table.filter(pa.array(kind == BLOB)).select(["bucket", "data"]).to_pylist()
        out = [table.filter(pa.array(kind != BLOB)).select(SCHEMA.names).cast(SCHEMA)]
        if len(blobs):
            read = [_read_blob(b["data"], b["bucket"]) for b in blobs]
            held = np.unique(np.concatenate([h for _, h in read]))
            rows, done = settle(np.concatenate([r for r, _ in read]), rule.smaller)
            count, _ = _context_count(rows)
            look = _forward(rows, done, rule.smaller) & (count > 1)
            if rule.smaller:  # the smallest document of an anchor has nothing before it, if all of them are here
                new = np.ones(len(rows), dtype=bool)
                new[1:] = rows["anchor"][1:] != rows["anchor"][:-1]
                low = np.minimum.reduceat(rows["k1"], np.flatnonzero(new))
                rows["c"][(rows["k1"] == low[np.cumsum(new) - 1]) & ~np.isin(rows["anchor"], held)] = 2
            # an anchor all of whose contexts are settled needs no look; contexts held back are open
            anchors = np.union1d(rows["anchor"][look & (rows["c"] < 2)], held)
            look &= np.isin(rows["anchor"], anchors)
            out.append(pa.Table.from_batches([_batch(_by_document(SPANS, rows[done], rule.width, buckets))]))
            out.append(pa.Table.from_batches([_batch(_by_document(ASKED, rows[look], rule.width, buckets))]))
        return pa.concat_tables(out)

    return run


def _cut(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contested contexts of each text with their symbols: bytes, or word hashes of 8 bytes."""
    names = ["anchor", "k1", "k2", "s", "n", "ask", "symbols"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_parts(batches, "text"):
            symbols, at = word_hashes(data, offs) if rule.words else (data, offs)
            cols: list[list] = [[] for _ in names]
            for i, (k1, k2, lists) in enumerate(zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "asked")))):
                asked = np.sort(np.concatenate([np.frombuffer(x, ASK) for x in lists]), order=["anchor", "s", "n"])
                last = np.ones(len(asked), dtype=bool)  # asked twice: the need for a look wins
                last[:-1] = (asked["anchor"][1:] != asked["anchor"][:-1]) | (asked["s"][1:] != asked["s"][:-1])
                asked = asked[last]
                own = symbols[at[i] : at[i + 1]]
                for a, s, n in asked.tolist():
                    n, ask = n % ASKS, n // ASKS
                    for col, v in zip(cols, (a, k1, k2, s, n, ask, own[s : s + n - 1 + rule.width].tobytes())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=names)

    return run


CONTEXT = "anchor long, k1 long, k2 long, s int, n int, ask int, symbols binary"
FOUND = "k1 long, k2 long, data binary"
FOUND_SCHEMA = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("data", pa.binary())])


@dataclass
class Contested:
    """Contexts of one bucket of anchors as the methods get them, in order of document id."""

    symbols: np.ndarray  # of all contexts, one after the other
    offs: np.ndarray
    k1: np.ndarray
    n: np.ndarray
    ask: np.ndarray


#: For each context a boolean per window, all contexts one after the other: does it repeat?
Method = Callable[[Contested], np.ndarray]


def _solve(rule: Rule, method: Method) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.select(["k1", "k2", "s", "n", "ask", "symbols"]).combine_chunks()
        k1, k2, s, n, ask = (table.column(c).to_numpy() for c in ("k1", "k2", "s", "n", "ask"))
        order = np.lexsort((s, k2, k1))
        fresh = np.ones(len(order), dtype=bool)  # a repeated row of the table gives its contexts again
        o = order
        fresh[1:] = (k1[o][1:] != k1[o][:-1]) | (k2[o][1:] != k2[o][:-1]) | (s[o][1:] != s[o][:-1])
        copies = np.diff(np.append(np.flatnonzero(fresh), len(o)))
        order = order[fresh]
        raw = table.column("symbols").take(pa.array(order)).to_pylist()
        size = 8 if rule.words else 1
        symbols = np.frombuffer(b"".join(raw), dtype="<u8" if rule.words else np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(x) // size for x in raw])])
        k1, k2, s, n, ask = (x[order] for x in (k1, k2, s, n, ask))
        found = method(Contested(symbols, offs, k1, n, ask))
        which = np.repeat(np.arange(len(n)), n)
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)
        if not rule.smaller:
            found |= np.repeat(copies, n) > 1
        found &= np.repeat(ask, n) > 0
        which, start = which[found], start[found]
        rows = np.zeros(len(which), ROW)
        rows["k1"], rows["k2"], rows["s"], rows["n"] = k1[which], k2[which], start, 1
        out = _by_document(SPANS, rows, rule.width, 1)
        return pa.Table.from_arrays([pa.array(out[f.name], type=f.type) for f in FOUND_SCHEMA], schema=FOUND_SCHEMA)

    return run


def _windows(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows of each context with two hashes of their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for k1, k2, s, n, ask, raw in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "s", "n", "ask", "symbols"))):
                symbols = np.frombuffer(raw, "<u8") if rule.words else BYTE_WORDS[np.frombuffer(raw, np.uint8)]
                at = np.arange(n)
                cols = (SubHashes(symbols).of(at, at + rule.width).view(np.int64), SubHashes(mix(symbols)).of(at, at + rule.width).view(np.int64),
                        np.full(n, k1), np.full(n, k2), (at + s).astype(np.int32), np.full(n, ask, np.int32))
                for o, c in zip(out, cols):
                    o.append(c)
            arrays = [pa.array(np.concatenate(o) if o else np.zeros(0, t), type=p) for o, t, p in
                      zip(out, (np.int64,) * 4 + (np.int32,) * 2, (pa.int64(),) * 4 + (pa.int32(),) * 2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "k1", "k2", "s", "ask"])

    return run


def _window_spans(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros(batch.num_rows, ROW)
            for c in ("k1", "k2", "s"):
                rows[c] = batch.column(c).to_numpy()
            rows["n"] = 1
            out = _by_document(SPANS, rows, rule.width, 1)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in FOUND_SCHEMA], schema=FOUND_SCHEMA)

    return run


def repeated_spans(df: DataFrame, rule: Rule, method: Method, crowd: int = 4096) -> DataFrame:
    """Merged repeated stretches per document: k1, k2, spans (array of binary with int pairs).

    ``df`` has k1 (document id), k2 (hash of the row's text) and text. ``crowd``: anchors
    with more contested contexts are settled by counting windows instead of in one task.
    """
    spark = df.sparkSession
    batches_of(spark)
    buckets = 2 * partitions(spark)  # fewer buckets repeat a document's keys less often
    src = df.select("k1", "k2", "text")
    read = src.mapInArrow(_read(rule, buckets), OUT)
    met = cut_lineage(read.groupBy("bucket").applyInArrow(_meet(rule, buckets), OUT))

    asked = cut_lineage(met.filter(F.col("kind") == ASKED).groupBy("k1", "k2").agg(F.collect_list("data").alias("asked")))
    width = F.lit(48) + F.aggregate("asked", F.lit(0), lambda a, x: a + F.octet_length(x))
    contested = small_join(src, asked, ["k1", "k2"], "inner", width).mapInArrow(_cut(rule), CONTEXT)
    contested = cut_lineage(contested)
    hot = cut_lineage(contested.groupBy("anchor").count().filter(F.col("count") > crowd).select("anchor"))
    calm = small_join(contested, hot, ["anchor"], "left_anti", 16)
    solved = calm.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInArrow(_solve(rule, method), FOUND)

    wide = small_join(contested, hot, ["anchor"], "left_semi", 16).mapInArrow(_windows(rule), "h1 long, h2 long, k1 long, k2 long, s int, ask int")
    if rule.smaller:
        counted = wide.groupBy("h1", "h2").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low < high")
        again = wide.filter("ask > 0").join(counted, ["h1", "h2"]).filter("k1 > low")
    else:
        counted = wide.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        again = wide.filter("ask > 0").join(counted, ["h1", "h2"])
    crowded = again.select("k1", "k2", "s").mapInArrow(_window_spans(rule), FOUND)

    spans = met.filter(F.col("kind") == SPANS).select("k1", "k2", "data").unionByName(solved).unionByName(crowded)
    return spans.groupBy("k1", "k2").agg(F.collect_list("data").alias("spans"))


def read_spans(lists: list[bytes] | None) -> np.ndarray:
    if not lists:
        return np.zeros((0, 2), np.int64)
    return merged(np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in lists]).astype(np.int64))


def spans_width() -> Column:
    return F.lit(48) + F.aggregate("spans", F.lit(0), lambda a, x: a + F.octet_length(x))
