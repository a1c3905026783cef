"""Spelling variants by a trie of letter-group counts.

Letters are dealt into sixteen groups of about the same share of all letters, and a word is
the vector of its counts in them. One inserted letter is a surplus of one in one group, a
deleted one a deficit of one, a replaced one at most one of each; so words one edit apart lie
within a budget of one surplus and one deficit. The top of the trie is cut into subtrees by
the counts of four unions of groups; crowded subtrees are cut again by eight unions, then by
all sixteen groups, then into blocks. Each word is kept in one subtree and sent to the others
that its budget reaches, only to those that come later in order, so a pair meets once. Inside
a subtree the words stand in the order of their counts, and a depth-first search takes the
visitors down: a child goes on with the visitors whose budget allows its count. At a leaf,
words and visitors are compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.core.bounded import collect_bounded
from surveyspark.llm.common import batches_of, cut_lineage, edge_bytes, mix, partitions, small_join

GROUPS = 16
#: Unions of groups by which subtrees are cut, coarse to fine.
CUTS = (4, 8, 16)
#: Rows of a subtree (words that live in it or visit it) before it is cut again, words of a leaf, pairs compared at once.
CROWD, LEAF, PAIRS = 200_000, 12, 1 << 18
#: Words up to this length are compared in a matrix, longer ones pair by pair.
LONG = 64

#: Names of crowded subtrees that may come to the driver (8 bytes each): one for each CROWD routed words.
MOST_CROWDED = 4_000_000

_U = np.uint64
WORD_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def altered(run: str, h: int, every: int) -> str:
    """The run without one code point if ``every`` divides h."""
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(shortest: int, every: int, held: int = 400_000):
    """Words of documents with their number, counted in the task; at most ``held`` words are kept at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile("[a-zA-ZÀ-ÿ]{%d,}" % shortest).findall
        tally: Counter = Counter()
        for batch in batches:
            data, offs = edge_bytes(batch.column("text"))
            raw = data.tobytes()
            for doc, s, e in zip(batch.column("doc").to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                words = Counter(find(raw[s:e].lower().decode()))  # bytes.lower changes A-Z only
                start = zlib.crc32(f"{doc}:".encode())
                for w in [w for w in words if not zlib.crc32(w.encode(), start) % every]:
                    n = words.pop(w)
                    short = altered(w, zlib.crc32(w.encode(), start), every)
                    if len(short) >= shortest:
                        tally[short] += n
                tally.update(words)
                if len(tally) >= held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], schema=WORD_COUNTS)
                    tally = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], schema=WORD_COUNTS)

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """word and n: lower-cased (A-Z) runs of letters with at least ``least`` occurrences and ``shortest`` code points.

    With h the crc32 of ``<id>:<run>``, runs whose h ``every`` divides lose code point
    ``h % length``. Null texts have no words; a null id counts as an empty one.
    """
    batches_of(docs.sparkSession)
    d = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc"), F.col(f"`{text_col}`").alias("text")).filter(F.length("text") >= shortest)
    counted = d.mapInArrow(_count(shortest, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def letter_groups(words: DataFrame) -> np.ndarray:
    """Group of every letter code below 256: most frequent letter first, each to the group with the least so far."""
    shares = words.select(F.explode(F.split("word", "")).alias("x")).groupBy(F.ascii("x").alias("x")).count()
    found = sorted(((r["count"], r["x"]) for r in shares.collect() if r["x"]), key=lambda r: (-r[0], r[1]))  # at most 90 letters
    out, load = np.zeros(256, np.int64), [0] * GROUPS
    for n, x in found:
        g = load.index(min(load))
        out[x] = g
        load[g] += n
    return out


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words (each below 256) and the offsets of the words."""
    data, offs = edge_bytes(words)
    lead = data != 0xC3  # of two-byte letters C3 xx, xx + 0x40 is the code point
    codes = data.copy()
    codes[data >= 0x80] += 0x40
    return codes[lead], np.concatenate([[0], np.cumsum(lead)])[offs]


def vectors_of(codes: np.ndarray, offs: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Letters of each word in each group."""
    n = len(offs) - 1
    word = np.repeat(np.arange(n), np.diff(offs))
    return np.bincount(word * GROUPS + groups[codes], minlength=n * GROUPS).reshape(n, GROUPS)


def unions(counts: np.ndarray, cut: int) -> np.ndarray:
    """Counts in ``cut`` unions of neighbouring groups."""
    return counts.reshape(len(counts), cut, counts.shape[1] // cut).sum(axis=2)


def prefix_key(counts: np.ndarray, cut: int) -> np.ndarray:
    """64-bit name of the subtree of each row of counts."""
    key = np.full(len(counts), cut, dtype=_U)
    for i in range(counts.shape[1]):
        key = mix(key * _U(0x9E3779B97F4A7C15) + counts[:, i].astype(_U))
    return key.view(np.int64)


def moves(cut: int) -> np.ndarray:
    """Changes of counts within the budget whose result comes later than the start: by the coarsest union that differs."""
    out = []
    for up in range(-1, cut):
        for down in range(-1, cut):
            d = np.zeros((1, cut), np.int64)
            if up >= 0:
                d[0, up] += 1
            if down >= 0:
                d[0, down] -= 1
            order = np.concatenate([d.reshape(c, cut // c).sum(axis=1) for c in CUTS if c <= cut])
            turns = order[order != 0]
            if up != down and turns[0] > 0:
                out.append(d[0])
    return np.array(out)


class Trie:
    """Which subtrees of the top a word lives in and visits; ``crowded[i]`` are the names of those cut again after cut i."""

    def __init__(self, groups: np.ndarray, crowded: list[np.ndarray]):
        self.groups, self.crowded = groups, crowded

    def _open(self, counts: np.ndarray, level: int) -> np.ndarray:
        """Whether subtrees of this level exist: all above them are crowded."""
        ok = np.ones(len(counts), bool)
        for i in range(level):
            ok[ok] = np.isin(prefix_key(unions(counts[ok], CUTS[i]), CUTS[i]), self.crowded[i])
        return ok

    def routes(self, vectors: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(words, names of subtrees, whether they live there) at one level."""
        cut = CUTS[level]
        own = unions(vectors, cut)
        for i, d in enumerate([np.zeros(cut, np.int64), *moves(cut)]):
            at = np.flatnonzero((own >= -d)[:, d < 0].all(axis=1)) if i else np.arange(len(own))
            to = own[at] + d
            there = self._open(to, level)
            yield at[there], prefix_key(to[there], cut), not i


def _loads(trie: Trie, level: int):
    """Rows that each subtree of a level gets, and words that live there."""
    schema = pa.schema([("key", pa.int64()), ("load", pa.int64()), ("homes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors_of(*letters_of(batch.column("word")), trie.groups)
            got = [(k, np.full(len(k), home)) for _, k, home in trie.routes(v, level)]
            keys, homes = (np.concatenate([g[i] for g in got]) for i in (0, 1))
            names, to = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(to)), pa.array(np.bincount(to, homes).astype(np.int64))], schema=schema)

    return run


ROUTED = pa.schema([("word", pa.string()), ("n", pa.int64()), ("key", pa.int64()), ("block", pa.int32()), ("home", pa.bool_())])


def _routed(trie: Trie, blocks: dict[int, int]):
    """Words at the subtrees they live in and visit; ``blocks``: of crowded subtrees of the last level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            v = vectors_of(*letters_of(words), trie.groups)
            for level in range(len(trie.crowded) + 1):
                for at, keys, home in trie.routes(v, level):
                    if level < len(trie.crowded):
                        calm = ~np.isin(keys, trie.crowded[level])
                        at, keys = at[calm], keys[calm]
                    block, mine = np.zeros(len(at), np.int32), np.full(len(at), home)
                    if blocks and level == len(CUTS) - 1:
                        rows = []
                        for i, (a, k) in enumerate(zip(at.tolist(), keys.tolist())):
                            many = blocks.get(k, 1)
                            own = zlib.crc32(words[a].as_py().encode()) % many
                            rows += [(i, own, True), *((i, b, False) for b in range(own + 1, many))] if home else [(i, b, False) for b in range(many)]
                        pick = np.array([r[0] for r in rows], np.int64)
                        at, keys = at[pick], keys[pick]
                        block, mine = np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows], bool)
                    if len(at):
                        to = pa.array(at)
                        yield pa.RecordBatch.from_arrays([words.take(to), batch.column("n").take(to), pa.array(keys), pa.array(block), pa.array(mine)], schema=ROUTED)

    return run


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    if len(x) == len(y):
        return int((x != y).sum()) == 1
    differ = np.flatnonzero(x != y[:-1])
    at = differ[0] if len(differ) else len(x)
    return bool((x[at:] == y[at + 1 :]).all())


class Letters:
    """Words as rows of letters, from the left and from the right, to compare many pairs at once."""

    def __init__(self, codes: np.ndarray, offs: np.ndarray, words: list[str]):
        self.n, self.words = np.diff(offs), words
        width = int(min(LONG, self.n.max(initial=1)))
        row = np.repeat(np.arange(len(self.n)), self.n)
        at = np.arange(len(codes)) - offs[:-1][row]
        back = self.n[row] - 1 - at
        self.left = np.zeros((len(self.n), width), np.uint8)
        self.right = np.zeros((len(self.n), width), np.uint8)
        self.left[row[at < width], at[at < width]] = codes[at < width]
        self.right[row[back < width], back[back < width]] = codes[back < width]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words of each pair are exactly one edit apart."""
        out = np.zeros(len(a), bool)
        gap = np.abs(self.n[a] - self.n[b])
        long = np.maximum(self.n[a], self.n[b]) > LONG
        for i in np.flatnonzero(long & (gap <= 1)):
            out[i] = one_edit(self.words[a[i]], self.words[b[i]])
        same = np.flatnonzero(~long & (gap == 0))
        out[same] = (self.left[a[same]] != self.left[b[same]]).sum(axis=1) == 1
        other = np.flatnonzero(~long & (gap == 1))
        differ = self.left[a[other]] != self.left[b[other]]  # padding ends the shorter word
        front = differ.argmax(axis=1)
        differ = self.right[a[other]] != self.right[b[other]]
        out[other] = front + differ.argmax(axis=1) >= np.minimum(self.n[a[other]], self.n[b[other]])
        return out


def descend(homes: np.ndarray, visitors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first home, end of homes, visitors) at each leaf of a depth-first search.

    ``homes`` are count vectors in lexicographic order, the ranges that share their first
    counts being the nodes. A visitor goes on to a child whose count is its own, or one more
    or one less as long as its surplus or its deficit isn't spent.
    """
    free = np.zeros(len(visitors), bool)
    stack = [(0, len(homes), 0, np.arange(len(visitors)), free, free)]
    while stack:
        lo, hi, level, who, more, less = stack.pop()
        if hi - lo <= LEAF or level == GROUPS:
            yield lo, hi, who
            continue
        counts = homes[lo:hi, level]
        cuts = np.flatnonzero(counts[1:] != counts[:-1]) + 1
        mine = visitors[who, level]
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), hi - lo]):
            d = counts[s] - mine
            ok = (d == 0) | ((d == 1) & ~more) | ((d == -1) & ~less)
            if ok.any():
                stack.append((lo + s, lo + e, level + 1, who[ok], more[ok] | (d[ok] == 1), less[ok] | (d[ok] == -1)))


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _search(groups: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("key", "ascending"), ("block", "ascending"), ("word", "ascending")])  # words in code-point order inside a subtree
        column = table.column("word").combine_chunks()
        codes, offs = letters_of(column)
        vectors = vectors_of(codes, offs, groups).astype(np.int32)
        names = column.to_pylist()
        n = table.column("n").to_numpy()
        letters = Letters(codes, offs, names)
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        held, waiting = 0, []

        def settle() -> None:
            nonlocal held, waiting
            if waiting:
                a, b = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
                ok = letters.near(a, b)
                pairs.append((a[ok], b[ok]))
            held, waiting = 0, []

        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
            own = lo + np.flatnonzero(home[lo:hi])
            if not len(own) or hi - lo < 2:
                continue
            own = own[np.lexsort(vectors[own].T[::-1])]
            for first in range(lo, hi, 1 << 16):
                who = np.arange(first, min(hi, first + (1 << 16)))
                for s, e, at in descend(vectors[own], vectors[who]):
                    asks = who[at]
                    step = max(1, PAIRS // max(1, e - s))
                    for i in range(0, len(asks), step):
                        a = np.tile(own[s:e], len(asks[i : i + step]))
                        b = np.repeat(asks[i : i + step], e - s)
                        ok = (~home[b] | (b > a)) & (np.abs(letters.n[a] - letters.n[b]) <= 1)  # of two that live here, one asks
                        waiting.append((a[ok], b[ok]))
                        held += int(ok.sum())
                        if held >= PAIRS:
                            settle()
        settle()
        a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(column).to_numpy()] = np.arange(len(names))
        order = np.lexsort((rank[dst], -n[dst], rank[src]))
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.concatenate([[True], rank[src[1:]] != rank[src[:-1]]])) if len(src) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(src)))
        arrays = [column.take(pa.array(src[first])), pa.array(count), pa.array(n[dst[first]]), column.take(pa.array(dst[first]))]
        return pa.Table.from_arrays(arrays, schema=NEAR)

    return run


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """word, n_near, best_n and best (near word of largest n, ties: the smallest) from distinct (word, n).

    A word may come several times, with some of its near words each time, no pair twice.
    """
    spark = words.sparkSession
    groups, crowded, blocks, rows = letter_groups(words), [], {}, 0
    for level in range(len(CUTS)):
        loads = cut_lineage(words.select("word").mapInArrow(_loads(Trie(groups, crowded), level), "key long, load long, homes long").groupBy("key").agg(F.sum("load").alias("load"), F.sum("homes").alias("homes")))
        total = loads.filter(F.col("load") <= crowd).agg(F.sum("load").alias("l")).first()["l"] or 0
        rows += total
        many = loads.filter(F.col("load") > crowd)
        if level == len(CUTS) - 1:
            rows += loads.agg(F.sum("load").alias("l")).first()["l"] or 0
            blocks = {r["key"]: -(-r["homes"] // crowd) for r in collect_bounded(many.filter(F.col("homes") > crowd), MOST_CROWDED, "crowded subtrees")}
            break
        names = np.array([r["key"] for r in collect_bounded(many.select("key"), MOST_CROWDED, "crowded subtrees")], np.int64)
        if not len(names):
            break
        crowded.append(names)
    buckets = max(partitions(spark), -(-rows // crowd))
    routed = words.select("word", "n").mapInArrow(_routed(Trie(groups, crowded), blocks), "word string, n long, key long, block int, home boolean")
    routed = routed.withColumn("bucket", F.pmod(F.xxhash64("key", "block"), F.lit(buckets)))
    return routed.groupBy("bucket").applyInArrow(_search(groups), "word string, n_near long, best_n long, best string")


def roots(links: DataFrame) -> DataFrame:
    """word and root from (word, form): forms followed to the last, each round doubling the way already gone."""
    ways = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        width = F.octet_length("root") + F.octet_length("further") + 48
        stepped = cut_lineage(small_join(ways, on, ["root"], "left", width).select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")))
        ways = stepped.select("word", "root")
        if stepped.filter("went").isEmpty():
            return ways


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, every: int = 97, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words (``word_counts``) of a corpus.

    Near words are exactly one inserted, deleted or replaced code point apart. A word's form
    is its near word of largest n (ties: smallest in code-point order) if that is at least
    twice its own n, else null; its root is where forms lead in the end, itself without one.
    Words of any length take part; an empty table and texts without words give no rows.
    """
    words = cut_lineage(word_counts(docs, id_col, text_col, shortest, least, every))
    batches_of(docs.sparkSession, 20_000)
    none = [F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")]
    rows = words.select("word", "n", *none).unionByName(near_words(words, crowd).withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best")))
    met = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    is_form = -F.col("b.m") >= 2 * F.col("n")
    met = cut_lineage(met.select("word", "n", "n_near", F.when(is_form, F.col("b.best")).alias("form"), F.when(is_form, -F.col("b.m")).alias("form_n")))
    width = F.octet_length("word") + F.octet_length("root") + 48
    whole = small_join(met, roots(met.filter("form IS NOT NULL")), ["word"], "left", width)
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
