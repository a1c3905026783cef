"""Benchmark decontamination by a prefix-filtered join of word shingles.

A window is ten consecutive words of a benchmark item (a shorter item is one window). Its set
holds its shingles of three words (shorter windows: one shingle). A document that contains the
window contains all of them, so a prefix of one shingle is enough to join on, and the rarest
one in the corpus is taken; windows whose rarest shingle never occurs are done. A place of
that shingle in a document fixes the only start the window can have there; the length bound
asks that it ends inside the document, the positional bound that it starts there. What is
left is compared word by word, first by hashes, then by the words themselves.

The benchmark side is spread over parts of bounded size (one part, as a rule). Documents are
read against each part where they lie: with one part, nothing but counts is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import ASCII_LOWER, BASE, BYTE_WORDS, SubHashes, batches_of, cut_lineage, text_parts

WINDOW, SHINGLE = 10, 3
#: Bytes of windows (words, hashes, shingles) that a part of the benchmark may have.
PART_BYTES = 16 << 20

_U = np.uint64
_ROLES = np.array([pow(BASE, 2 * i + 3, 1 << 64) for i in range(SHINGLE)], dtype=_U)
#: Bytes of words: digits, a-z and all of longer UTF-8 sequences, after A-Z are lower-cased.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


class Words:
    """Words of some texts: edges in the lower-cased bytes, hashes, and the text each belongs to."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data = ASCII_LOWER[data]
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = _IN_WORD[self.data]
        turns = inside[1:] != inside[:-1]
        start, end = turns & inside[1:], turns & inside[:-1]
        cut = offs[1:-1]  # words end with their text
        cut = cut[inside[cut] & inside[cut + 1]]
        start[cut] = end[cut] = True
        self.s, self.e = np.flatnonzero(start), np.flatnonzero(end)
        self.of = np.searchsorted(offs, self.s, side="right") - 1
        self.counts = np.bincount(self.of, minlength=len(offs) - 1)
        self.hashes = SubHashes(BYTE_WORDS[self.data]).of(self.s, self.e) if len(self.s) else np.zeros(0, _U)

    def text(self, start: int, n: int) -> bytes:
        return b" ".join(self.data[self.s[i] : self.e[i]].tobytes() for i in range(start, start + n))

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each place on; places too near the end of a text hold nothing useful."""
        return shingle_hashes(self.hashes, k)

    def fits(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Whether n words from a place on lie in one text."""
        last = at + n - 1
        ok = (at >= 0) & (last < len(self.of))
        ok[ok] = self.of[at[ok]] == self.of[last[ok]]
        return ok


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, _U)
    for i in range(k):
        out += words[i : i + n] * _ROLES[i]
    return out


class Lookup:
    """Places of 64-bit keys in a sorted array, behind a bitmap that most misses end at."""

    BITS = 22

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.map = np.zeros(1 << self.BITS, dtype=bool)
        self.map[self.keys >> _U(64 - self.BITS)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in x that hold a key, places of these keys)."""
        at = np.flatnonzero(self.map[x >> _U(64 - self.BITS)])
        if not len(self.keys):
            return at[:0], at[:0]
        to = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
        same = self.keys[to] == x[at]
        return at[same], to[same]


WINDOWS = pa.schema([("item", pa.string()), ("window", pa.binary()), ("n", pa.int32()), ("shingles", pa.list_(pa.int64()))])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of benchmark items with their shingles."""
    for part, data, offs in text_parts(batches, "text"):
        w = Words(data, offs)
        items, at = part.column("item").to_pylist(), 0
        out: list[list] = [[] for _ in WINDOWS]
        for item, count in zip(items, w.counts.tolist()):
            size = min(WINDOW, count)
            for s in range(at, at + count - size + 1) if count else ():
                own = shingle_hashes(w.hashes[s : s + size], min(SHINGLE, size))
                for o, x in zip(out, (item, w.text(s, size), size, own.view(np.int64).tolist())):
                    o.append(x)
            at += count
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, WINDOWS.types)], schema=WINDOWS)


def _tally(keys: dict[int, np.ndarray]):
    """How often each shingle of the benchmark occurs in the texts of a task."""
    schema = pa.schema([("k", pa.int32()), ("shingle", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = {k: Lookup(x) for k, x in keys.items()}
        counts = {k: np.zeros(len(x.keys), np.int64) for k, x in looks.items()}
        for _, data, offs in text_parts(batches, "text", 1 << 18):
            w = Words(data, offs)
            for k, look in looks.items():
                at, to = look.find(w.shingles(k))
                counts[k] += np.bincount(to[w.fits(at, k)], minlength=len(look.keys))
        for k, look in looks.items():
            held = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), k, np.int32)), pa.array(look.keys[held].view(np.int64)), pa.array(counts[k][held])], schema=schema)

    return run


HITS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
HITS_DDL = "key long, doc_id long, n_words long, runs array<long>, items array<string>"


class Index:
    """Distinct windows by their rarest shingle, and the items of each."""

    def __init__(self, rows: pa.Table):
        self.texts = rows.column("window").to_pylist()
        self.items = [[x for x in i if x is not None] for i in rows.column("items").to_pylist()]
        n, k = rows.column("n").to_numpy(), rows.column("k").to_numpy()
        self.n, self.place = n.astype(np.int64), rows.column("place").to_numpy().astype(np.int64)
        rare = rows.column("shingle").to_numpy().view(_U)
        self.hashes = [Words(b, np.array([0, len(b)])).hashes for b in (np.frombuffer(t, np.uint8) for t in self.texts)]
        self.by: dict[int, tuple[Lookup, np.ndarray, np.ndarray]] = {}
        for size in np.unique(k).tolist():
            own = np.flatnonzero(k == size)
            own = own[np.argsort(rare[own], kind="stable")]
            look = Lookup(rare[own])
            self.by[size] = look, own, np.searchsorted(rare[own], look.keys)

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of all windows in some texts."""
        starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (look, own, first) in self.by.items():
            at, to = look.find(w.shingles(k))
            until = np.append(first[1:], len(own))
            many = until[to] - first[to]  # windows that share this rarest shingle
            each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            window = own[np.repeat(first[to], many) + each]
            start = np.repeat(at, many) - self.place[window]
            ok = w.fits(start, self.n[window])
            starts.append(start[ok])
            windows.append(window[ok])
        start, window = np.concatenate(starts), np.concatenate(windows)
        ok = np.fromiter(
            (np.array_equal(w.hashes[s : s + self.n[x]], self.hashes[x]) and w.text(s, self.n[x]) == self.texts[x] for s, x in zip(start.tolist(), window.tolist())),
            dtype=bool, count=len(start),
        )
        return start[ok], window[ok]


def _scan(index_rows: pa.Table):
    """Runs of hit words [start, end, start, end, ...] and items of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(index_rows)
        for part, data, offs in text_parts(batches, "text", 1 << 18):
            w = Words(data, offs)
            start, window = index.occurrences(w)
            n = part.num_rows
            runs: list[list[int]] = [[] for _ in range(n)]
            items: list[set[str]] = [set() for _ in range(n)]
            first = np.cumsum(w.counts) - w.counts
            for s, x in sorted(zip(start.tolist(), window.tolist())):
                row = int(w.of[s])
                a, own = s - int(first[row]), runs[row]
                b = a + int(index.n[x])
                if own and a <= own[-1]:
                    own[-1] = max(own[-1], b)
                else:
                    own += [a, b]
                items[row].update(index.items[x])
            arrays = [part.column("key"), part.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(runs, HITS.types[3]), pa.array([sorted(i) for i in items], HITS.types[4])]
            yield pa.RecordBatch.from_arrays(arrays, schema=HITS)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs and items of the parts of the benchmark, put together."""
    for batch in batches:
        runs: list[list[int]] = []
        for parts in batch.column("runs").to_pylist():
            own: list[int] = []
            for a, b in sorted(pair for part in parts for pair in zip(part[::2], part[1::2])):
                if own and a <= own[-1]:
                    own[-1] = max(own[-1], b)
                else:
                    own += [a, b]
            runs.append(own)
        items = [sorted({x for part in parts for x in part}) for parts in batch.column("items").to_pylist()]
        arrays = [batch.column("key"), batch.column("doc_id"), batch.column("n_words"), pa.array(runs, HITS.types[3]), pa.array(items, HITS.types[4])]
        yield pa.RecordBatch.from_arrays(arrays, schema=HITS)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """key (of id and text), doc_id, n_words, runs of hit words and items of every document.

    ``runs`` holds [start, end, start, end, ...] in words, end exclusive, sorted and apart;
    ``items`` the ids, as sorted strings, of the items with a window in the document. Null
    texts have no words. Every row gets a row, null and repeated ids too. Items without words
    have no windows; windows of an item with a null id are hit, but name no item; items that
    repeat an id count once. With an empty benchmark nothing is hit.
    """
    spark = docs.sparkSession
    batches_of(spark)
    text = F.col(f"`{text_col}`")
    d = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    wins = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    wins = wins.mapInArrow(_windows, "item string, window binary, n int, shingles array<long>")
    wins = cut_lineage(wins.withColumn("k", F.least("n", F.lit(SHINGLE))).distinct())
    width = F.octet_length("window") + 8 * F.size("shingles") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64
    parts = max(1, -(-(wins.agg(F.sum(width).alias("b")).first()["b"] or 0) // part_bytes))
    found = None
    for i in range(parts):
        own = wins.filter(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == i)
        keys = own.select("k", F.explode("shingles").alias("shingle")).distinct().toArrow()
        by = {k: keys.filter(pc.equal(keys.column("k"), k)).column("shingle").to_numpy().view(_U) for k in set(keys.column("k").to_pylist())}
        counts = cut_lineage(d.select("text").mapInArrow(_tally(by), "k int, shingle long, c long").groupBy("k", "shingle").agg(F.sum("c").alias("c")))
        places = own.select("window", "n", "k", F.posexplode("shingles").alias("place", "shingle")).distinct()
        rarest = places.join(counts, ["k", "shingle"], "left").groupBy("window", "n", "k").agg(F.min(F.struct(F.coalesce("c", F.lit(0).cast("long")).alias("c"), "place", "shingle")).alias("r"))
        items = own.groupBy("window").agg(F.collect_set("item").alias("items"))
        index = rarest.filter("r.c > 0").join(items, "window").select("window", "n", "k", "r.place", "r.shingle", "items").toArrow()
        hits = d.mapInArrow(_scan(index), HITS_DDL)
        if parts == 1:
            return hits
        once = hits.groupBy("key", "n_words").agg(F.first("doc_id").alias("doc_id"), F.first("runs").alias("runs"), F.first("items").alias("items"), F.count(F.lit(1)).alias("copies"))
        found = once if found is None else found.unionByName(once)
    whole = found.groupBy("key", "n_words").agg(F.first("doc_id").alias("doc_id"), F.collect_list("runs").alias("runs"), F.collect_list("items").alias("items"), F.max("copies").alias("copies"))
    every = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return every.select("key", "doc_id", "n_words", "runs", "items").mapInArrow(_merged, HITS_DDL)


def digest(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated from ``find_leaks``."""
    ends = F.transform("runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.sha2(F.array_join("items", ","), 256)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))
