"""Near-duplicate documents by an LSH forest over MinHash signatures.

A signature of ``TREES * DEPTH`` minima is read in several orders, one per tree. In each
order, documents that share their first ``DEPTH`` values form a region; inside it they are
sorted by the values that follow, so that neighbours have the longest common prefixes: in a
crowded region they agree much deeper than in a thin one. Documents are compared with
their neighbours first, the best partners are confirmed on full shingle sets, and components
are formed. Then every region that still holds several components is searched for all pairs
between them, so nothing depends on how many neighbours were looked at: the signature rules
out most, a sketch of the smallest ``LOW`` hashes (the whole set, if it has no more) the
others, and links between components are given on. All links are confirmed on full sets.
Equal shingle sets are one node from the start.

A pair of similarity 0.8 shares no region with probability (1 - 0.8^4)^20 < 0.00003; a
signature of 80 values rules out a pair of 0.8 (estimate below 0.62) with about the same,
and so does a sketch of a larger set (estimate below 0.69).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.common import ASCII_LOWER, batches_of, cut_lineage, edge_bytes, mix, partitions, released, small_join, text_parts, word_hashes
from surveyspark.operators.clustering import connected_components

_U = np.uint64
TREES, DEPTH, MORE = 20, 4, 8
SIZE = TREES * DEPTH
BLOCK = 1024
NEIGHBOURS, PARTNERS = 4, 2
LEAST = 0.62
LOW, LOW_LEAST = 192, 0.69
#: Bytes of text that are hashed at a time; a longer text alone, whole.
PART_BYTES = 1 << 18

_rng = np.random.default_rng(20)
_MUL = (_rng.integers(0, 1 << 31, SIZE, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SIZE, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's word shingles; fewer words make one shingle, none an empty set."""
    h, at = word_hashes(ASCII_LOWER[data], offs)
    count = np.diff(at)
    joined = h.copy()
    for i in range(1, words):
        joined[: len(h) - i] = mix(joined[: len(h) - i] * _U(0x9E3779B97F4A7C15) + h[i:])
    out = []
    for i, n in enumerate(count.tolist()):
        if n >= words:
            out.append(np.unique(joined[at[i] : at[i + 1] - words + 1]))
        elif n:
            whole = h[at[i] : at[i] + 1]
            for j in range(at[i] + 1, at[i + 1]):
                whole = mix(whole * _U(0x9E3779B97F4A7C15) + h[j : j + 1])
            out.append(mix(whole + _U(n)))
        else:
            out.append(np.zeros(0, _U))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    if not len(shingles):
        return np.zeros(SIZE, np.uint32)
    low = np.full(SIZE, np.iinfo(np.uint32).max, np.uint32)
    x = (shingles >> _U(32)).astype(np.uint32)
    for s in range(0, len(x), 4096):
        v = x[s : s + 4096, None] * _MUL
        v += _ADD
        np.minimum(low, v.min(axis=0), out=low)
    return low


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_parts(batches, "text", PART_BYTES):
            sets = shingle_sets(data, offs, words)
            h1 = np.array([x.sum(dtype=_U) for x in sets], dtype=_U)
            h2 = np.array([np.bitwise_xor.reduce(mix(x)) if len(x) else 0 for x in sets], dtype=_U)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                 pa.array([signature(x).astype(">u2").tobytes() for x in sets], pa.binary()),
                 pa.array([(x[:LOW] >> _U(32)).astype("<u4").tobytes() for x in sets], pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "sig", "low"])

    return run


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, ">u2").reshape(-1, SIZE)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("est", pa.float64())])


def _pairs(a: np.ndarray, b: np.ndarray, est: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(est)], schema=PAIR)


def _neighbours(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        region, tree, rep, n = (table.column(c).to_numpy() for c in ("region", "tree", "rep", "n"))
        sig = _signatures(table.column("sig"))
        # values that follow the shared ones in the order of the tree, as sortable bytes
        cols = (tree[:, None] * DEPTH + DEPTH + np.arange(MORE)) % SIZE
        after = np.ascontiguousarray(np.take_along_axis(sig, cols, axis=1)).view(f"S{2 * MORE}").ravel()
        order = np.lexsort((rep, after, region))
        region, rep, n, sig = region[order], rep[order], n[order], sig[order]
        out = []
        for step in range(1, NEIGHBOURS + 1):
            i = np.flatnonzero((region[step:] == region[:-step]) & (rep[step:] != rep[:-step]))
            if not len(i):
                continue
            j = i + step
            est = (sig[i] == sig[j]).mean(axis=1)
            ok = (est >= LEAST) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
            out.append(_pairs(rep[i][ok], rep[j][ok], est[ok]))
        return pa.concat_tables(out).group_by(["a", "b"]).aggregate([("est", "max")]).rename_columns(["a", "b", "est"]).cast(PAIR) if out else PAIR.empty_table()

    return run


def sketch_similarity(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> tuple[float, bool]:
    """Similarity of two sets by their smallest hashes, and whether that is exact."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    if nx <= LOW and ny <= LOW:
        return both / (nx + ny - both), True
    union = np.union1d(x, y)[:LOW]
    return len(np.intersect1d(np.intersect1d(x, union, True), y, True)) / len(union), False


def _between(threshold: float):
    """Links between components of a block of a region: rows outside the main one against all."""

    def run(table: pa.Table) -> pa.Table:
        region, tree, rep, n, comp, probe = (table.column(c).to_numpy() for c in ("region", "tree", "rep", "n", "comp", "probe"))
        sig = _signatures(table.column("sig"))
        low = [np.frombuffer(x, "<u4") for x in table.column("low").to_pylist()]
        a, b, ests = [], [], []
        order = np.argsort(region, kind="stable")
        cut = np.flatnonzero(np.append(True, region[order][1:] != region[order][:-1]))
        for group in np.split(order, cut[1:]):
            t = int(tree[group[0]])
            asks, own = group[probe[group] == 1], group[probe[group] != 1]
            root = {int(c): int(c) for c in comp[group]}

            def find(c: int) -> int:
                while root[c] != c:
                    c = root[c]
                return c

            earlier = sig[:, : t * DEPTH]
            for i in asks:
                j = own[(comp[own] != comp[i]) & (np.minimum(n[own], n[i]) >= threshold * np.maximum(n[own], n[i]))]
                j = j[(probe[j] == 0) | (rep[j] > rep[i])]  # two rows that both ask meet once
                est = (sig[j] == sig[i]).mean(axis=1)
                j, est = j[est >= LEAST], est[est >= LEAST]
                if len(j) and t:  # a pair belongs to the first tree that has it
                    met = (earlier[j] == earlier[i]).reshape(len(j), t, DEPTH).all(axis=2).any(axis=1)
                    j, est = j[~met], est[~met]
                for x in j[np.argsort(-est, kind="stable")].tolist():
                    own_root, its_root = find(int(comp[i])), find(int(comp[x]))
                    if own_root == its_root:
                        continue
                    similar, exact = sketch_similarity(low[i], low[x], int(n[i]), int(n[x]))
                    if exact and similar >= threshold - 1e-9:
                        root[max(own_root, its_root)] = min(own_root, its_root)
                    elif exact or similar < LOW_LEAST:
                        continue
                    a.append(rep[i])
                    b.append(rep[x])
                    ests.append(similar)
        return _pairs(np.array(a, np.int64), np.array(b, np.int64), np.array(ests, np.float64))

    return run


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in ("text_a", "text_b"):
                column = batch.column(c).dictionary_encode()  # a hub's text comes with each of its pairs
                sets = shingle_sets(*edge_bytes(column.dictionary), words)
                sides.append([sets[i] for i in column.indices.to_pylist()])
            ok = []
            for x, y in zip(*sides):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(bool(len(x) and len(y)) and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _links(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (checkpointed) whose full shingle sets are similar enough."""
    ids = cut_lineage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    known = small_join(texts, ids, ["doc_id"], "left_semi", 16)
    one = pairs.join(known.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(known.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return cut_lineage(two.select("a", "b", "text_a", "text_b").mapInArrow(released(_confirm(words, percent)), "a long, b long").distinct())


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Component of every document: doc_id, n_shingles, component_id, kept.

    Documents are linked if ``100 * |A ∩ B| >= percent * |A ∪ B|`` on their sets of ``words``-word
    shingles (A-Z lower-cased). Null, empty and blank texts have no shingles and no links.
    A row with a null id is linked with nothing and kept (component_id null). Rows that
    repeat an id are judged each by its own text; equal rows are equal in the result.
    Other columns are not read.
    """
    spark = docs.sparkSession
    batches_of(spark, 250)
    buckets = 4 * partitions(spark)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    signed = cut_lineage(src.mapInArrow(released(_sign(words)), "doc_id long, n_shingles long, h1 long, h2 long, sig binary, low binary"))
    nodes = signed.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("h1", "h2", F.col("n_shingles").alias("n")).agg(
        F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    nodes = cut_lineage(nodes)

    key = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring(F.col("sig"), t * (2 * DEPTH) + 1, F.lit(2 * DEPTH))))
    rows = nodes.select("rep", "n", F.posexplode(key).alias("tree", "region"))
    shared = rows.groupBy("region").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    rows = cut_lineage(rows.join(shared, "region"))
    texts = src.filter("doc_id IS NOT NULL")

    def blocked(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("region", "block"), F.lit(buckets))).drop("block")

    sigs = nodes.select("rep", F.col("n").alias("n2"), "sig")
    block = F.pmod(F.xxhash64("rep", "tree"), F.ceil(F.col("m") / BLOCK))
    signed_rows = rows.join(sigs, (rows["rep"] == sigs["rep"]) & (rows["n"] == sigs["n2"])).select(rows["rep"], "tree", "region", "n", "m", "sig")
    first = blocked(signed_rows.withColumn("block", block)).groupBy("bucket").applyInArrow(_neighbours(percent / 100), "a long, b long, est double")
    sides = first.select("a", "b", "est", F.explode(F.array("a", "b")).alias("x")).distinct()
    best = Window.partitionBy("x").orderBy(F.desc("est"), "a", "b")
    best_pairs = cut_lineage(sides.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= PARTNERS).select("a", "b").distinct())
    links = _links(best_pairs, texts, words, percent)
    comps = cut_lineage(connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("comp")).distinct())

    # regions that still hold several components
    placed = cut_lineage(small_join(rows, comps, ["rep"], "left", 32).withColumn("comp", F.coalesce("comp", "rep")))
    sizes = placed.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("region").agg(F.count(F.lit(1)).alias("k"), F.max_by("comp", F.struct("c", "comp")).alias("main")).filter("k > 1")
    left = placed.join(mixed.select("region", "main"), "region")
    blocks = F.ceil(F.col("m") / BLOCK)
    own = left.withColumn("block", F.pmod(F.xxhash64("rep", "tree"), blocks)).withColumn("probe", F.when(F.col("comp") != F.col("main"), 2).otherwise(0))
    asks = left.filter("comp <> main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("probe", F.lit(1))
    asked = own.unionByName(asks).drop("main")
    who = cut_lineage(left.select(F.col("rep").alias("doc_id"), F.col("n").alias("n_shingles")).distinct())
    sketches = small_join(signed, who, ["doc_id", "n_shingles"], "left_semi", 24).groupBy(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n")).agg(
        F.first("sig").alias("sig"), F.first("low").alias("low"))
    asked = asked.join(sketches, ["rep", "n"]).select("rep", "tree", "region", "n", "comp", "probe", "block", "sig", "low")
    second = blocked(asked).groupBy("bucket").applyInArrow(_between(percent / 100), "a long, b long, est double")
    rest = cut_lineage(second.select("a", "b").distinct().join(best_pairs, ["a", "b"], "left_anti"))
    more = _links(rest, texts, words, percent)
    edges = comps.select(F.col("rep").alias("a"), F.col("comp").alias("b")).unionByName(more)
    final = cut_lineage(connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("comp")).distinct())

    nodes = small_join(nodes.select("h1", "h2", "n", "rep"), final, ["rep"], "left", 32)
    nodes = nodes.select("h1", "h2", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component"))
    out = signed.drop("sig", "low").join(nodes, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
