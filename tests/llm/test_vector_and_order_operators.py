"""Vector searches, sharding, mixing and the pipeline."""

from __future__ import annotations

import os
import sys
from fractions import Fraction
from itertools import islice

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surveyspark.llm import ann, mixing, topk
from surveyspark.llm.ann import nearest
from surveyspark.llm.mixing import cycle_units, edf, edf_cycle, exact_phases, lead, mix_order, mixed, schedule, stretch, whole
from surveyspark.llm.sharding import extendible_shards
from surveyspark.llm.topk import largest_products

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture
def vectors(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
        for name in ("v", "list", "band", "norm", "score", "rank"):
            df = df.withColumn(name, F.lit(1))
        return df

    return make


def some_vectors(n=3000, d=24, seed=0):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(12, d))
    x = (centres[g.integers(12, size=n)] + 0.6 * g.normal(size=(n, d))).astype(np.float32)
    x[5:400] = x[4]  # many copies of one vector
    return x


def brute_nearest(x, ids, k):
    out = {}
    for i in ids:
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1))
        d[i] = np.inf
        out[i] = np.lexsort((np.arange(len(x)), d))[:k].tolist()
    return out


def test_nearest_recall_and_scores(spark, vectors, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 100)
    monkeypatch.setattr(ann, "QUERIES", 3)
    x = some_vectors()
    got = nearest(vectors([(i, r.tolist()) for i, r in enumerate(x)]), "vec_id % 100 = 0").collect()
    want = brute_nearest(x, range(0, 3000, 100), 10)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(np.linalg.norm(x[r.vec_id].astype(float) - x[r.query_id]), rel=1e-12, abs=1e-12)
    assert all(len(v) == 10 for v in by.values()) and set(by) == set(want)
    assert by[100] == want[100]  # ties of the copies go to the smaller ids
    assert sum(len(set(by[q]) & set(want[q])) for q in want) / (10 * len(want)) >= 0.9


def test_nearest_on_driver_table(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()], np.float32)
    got = nearest(df, "vec_id % 100 = 0").collect()
    want = brute_nearest(x, range(0, len(x), 100), 10)
    assert sum(r.vec_id in want[r.query_id] for r in got) / (10 * len(want)) >= 0.9


HARD = [
    (0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 9.0]), (100, None), (200, []), (300, [None, 1.0]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]),
    (600, [0.0, 0.0]), (700, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (50, [0.0, 1.0]),
]


def test_searches_on_hard_rows(spark, vectors):
    got = nearest(vectors(HARD), "vec_id % 100 = 0").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got)] == [(0, 1, 50), (0, 2, 1), (0, 3, 2)]  # of the rows of id 0 the smallest counts
    got = largest_products(vectors(HARD), "vec_id % 50 = 0").collect()
    rows = {(r.query_id, r.vec_id): r.score for r in got}
    assert rows[600, 0] == 0 and rows[50, 1] == 0 and {q for q, _ in rows} == {0, 50, 600}
    assert rows[0, 1] == 128 * 256 and (0, 700) not in rows
    for f in (nearest, largest_products):
        assert f(vectors([]), "vec_id % 50 = 0").collect() == []
        assert f(vectors([(50, [1.0, 2.0])]), "vec_id % 50 = 0").collect() == []


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_largest_products_are_exact(spark, vectors, monkeypatch, spread):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    g = np.random.default_rng(2)
    x = (g.normal(size=(1500, 20)) * np.exp(spread * g.normal(size=(1500, 1)))).astype(np.float32)
    x[10:60] = x[9]
    x[100:110] = 0
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in largest_products(vectors([(i, r.tolist()) for i, r in enumerate(x)]), "vec_id % 50 = 0").collect()}
    want = {}
    for i in range(0, 1500, 50):
        s = v @ v[i]
        order = [j for j in np.lexsort((np.arange(1500), -s)) if j != i][:5]
        want |= {(i, k + 1): (j, s[j]) for k, j in enumerate(order)}
    assert got == want


def shards_of(rows):
    out = {}
    for r in rows:
        out.setdefault((r.depth, r.prefix, r.page), []).append(r.n_bytes)
    return out


def test_sharding_limits(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 37 as int))").alias("text"), F.lit(1).alias("prefix"))
    for bits in (None, 2):
        rows = extendible_shards(df, "doc_id", F.octet_length("text"), 5000, bits).collect()
        assert len(rows) == 20000 and len({r.doc_id for r in rows}) == 20000
        shards = shards_of(rows)
        assert max(sum(v) for v in shards.values()) <= 5000
        # a bucket exists only because the one above was too large
        above = {}
        for (d, p, _), v in shards.items():
            for up in range(d):
                above[up, p >> (d - up)] = above.get((up, p >> (d - up)), 0) + sum(v)
        assert all(v > 5000 for v in above.values())


def test_sharding_hard_rows(spark):
    rows = [(7, "y" * 100)] * 500 + [(None, "z")] * 3 + [(1, None), (2, ""), (3, "w" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(0)).repartition(5)
    got = extendible_shards(df, "doc_id", F.octet_length("text"), 1000).collect()
    assert len(got) == len(rows)
    shards = shards_of(got)
    assert all(sum(v) <= 1000 or len(v) == 1 for v in shards.values())
    assert extendible_shards(df.limit(0), "doc_id", F.octet_length("text")).collect() == []


@given(st.lists(st.floats(0.01, 100), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_cycle_stays_within_a_block(weights):
    units = cycle_units(weights, 60)
    assert sum(units) == 60 and min(units) >= 1
    slots = edf_cycle(units)
    assert sorted(s for own in slots for s in own) == list(range(60))
    for u, own in zip(units, slots):
        for t in range(61):
            assert abs(sum(s < t for s in own) - u * t / 60) < 1
        assert all(j * 60 // u <= s < -(-(j + 1) * 60 // u) for j, s in enumerate(own))


def simulate(blocks, weights, cycle):
    """The schedule slot by slot: earliest deadline among released blocks, phase by phase."""
    left, out, t0 = {s: n for s, n in blocks.items() if n}, {}, 0
    done = dict.fromkeys(blocks, 0)
    while left:
        names = sorted(left)
        size = max(cycle, 4 * len(names)) if len(names) > 1 else 1
        units = dict(zip(names, cycle_units([weights[s] for s in names], size)))
        placed, t = dict.fromkeys(names, 0), 0
        while all(left.values()):
            ready = [s for s in names if placed[s] * size // units[s] <= t]
            s = min(ready, key=lambda s: (-(-(placed[s] + 1) * size // units[s]), names.index(s)))
            out[s, done[s]] = t0 + t
            placed[s] += 1
            done[s] += 1
            left[s] -= 1
            t += 1
        left = {s: n for s, n in left.items() if n}
        t0 += t
    return out


@given(st.lists(st.tuples(st.integers(0, 70), st.floats(0.1, 5)), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_schedule_equals_the_simulation(sources):
    blocks = {f"s{i}": n for i, (n, _) in enumerate(sources)}
    weights = {f"s{i}": w for i, (_, w) in enumerate(sources)}
    got = {}
    for s, _, first, end, start, cycle, units, slots in schedule(blocks, weights, 20):
        for b in range(first, end):
            k = b - first
            got[s, b] = start + k // units * cycle + slots[k % units]
    assert got == simulate(blocks, weights, 20)
    assert sorted(got.values()) == list(range(sum(blocks.values())))


@given(st.lists(st.floats(0.001, 100), min_size=1, max_size=8), st.integers(0, 3000))
@settings(max_examples=100, deadline=None)
def test_stretches_equal_one_run(weights, begin):
    units = whole(weights)
    assert [Fraction(u, units[0]) for u in units] == [Fraction(w) / Fraction(weights[0]) for w in weights]
    assert list(stretch(units, begin, begin + 300)) == list(islice(edf(units), begin, begin + 300))


def test_stretches_join_after_their_lead():
    units = whole([0.1, 0.2, 0.03, 0.6699, 0.0001])
    assert lead(units) in (10000, 10001)
    assert list(stretch(units, 15000, 31000)) == list(islice(edf(units), 15000, 31000))


@given(st.lists(st.tuples(st.integers(0, 300), st.floats(0.001, 5)), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_exact_phases_end_where_one_run_does(sources):
    blocks = {f"s{i}": n for i, (n, _) in enumerate(sources)}
    weights = {f"s{i}": w for i, (_, w) in enumerate(sources)}
    left, t0 = {s: n for s, n in blocks.items() if n}, 0
    for names, units, done, start, size in exact_phases(blocks, weights):
        assert names == sorted(left) and start == t0 and done == [blocks[s] - left[s] for s in names]
        for t, i, _ in islice(edf(units), size):
            assert all(left.values())
            left[names[i]] -= 1
        assert not all(left.values())
        left, t0 = {s: n for s, n in left.items() if n}, t0 + size
    assert not left and t0 == sum(blocks.values())


def test_mixing_stays_within_a_block_of_exact_weights(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 700)
    sizes, weights = {"a": 2600, "b": 1500, "c": 40}, {"a": 0.6337, "b": 0.3658, "c": 0.0005}
    docs = documents([(i, "t" * 8, s) for j, s in enumerate(sizes) for i in range(j * 10000, j * 10000 + sizes[s])])
    rows = sorted(mix_order(docs, targets=weights, block=8).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(sum(sizes.values())))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    total, count = sum(map(Fraction, weights.values())), dict.fromkeys(sizes, 0)
    first = [r for r in rows if r.phase == 0]
    assert len(first) > 4000
    for t, r in enumerate(first, 1):
        count[r.source] += 1
        assert all(abs(count[s] - t * Fraction(w) / total) < 1 for s, w in weights.items())


def test_mixing_places_every_document(spark, documents):
    rows = [(i, "t" * (i % 50), f"s{i % 3 if i % 2 else 0}") for i in range(600)] + [(None, "n", "s1"), (700, "q", None), (5, "again", "s2"), (5, "again", "s2")]
    docs = documents(rows)
    order = mix_order(docs, targets={"s0": 1, "s1": 2}, block=64).collect()
    assert len(order) == len({(r.doc_id, r.source) for r in order}) == len({(r[0], r[2]) for r in rows})
    assert all(r.release <= r.slot < r.deadline and 0 <= r.at < 64 for r in order)
    per_block = {}
    for r in order:
        assert per_block.setdefault((r.source, r.block), r.slot) == r.slot
    assert len(set(per_block.values())) == len(per_block)
    out = mixed(docs, block=64)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert mix_order(documents([])).collect() == [] and mixed(documents([])).collect() == []


def test_mixing_order_reaches_files(spark, documents, tmp_path):
    docs = documents([(i, "t" * 20, f"s{i % 2}") for i in range(400)])
    slots = {(r.doc_id, r.source): (r.slot, r.at) for r in mix_order(docs, block=100).collect()}
    mixed(docs, block=100).write.parquet(f"{tmp_path}/out")
    for f in sorted(os.listdir(f"{tmp_path}/out")):
        if f.endswith(".parquet"):
            own = [slots[r.doc_id, r.source] for r in spark.read.parquet(f"{tmp_path}/out/{f}").coalesce(1).collect()]
            assert own == sorted(own)


def test_too_many_sources_raise(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError):
        mix_order(documents([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, SF_DIR)
        assert out.columns == docs.columns, name
        left = spark.createDataFrame(out.collect(), docs.schema)
    n = left.count()
    assert 700 < n < 1000
    pieces = corpus_pipeline.run(spark, SF_DIR)
    assert pieces.select("doc_id").distinct().count() == n


@pytest.mark.parametrize("stage", range(4))
def test_pipeline_stages_on_hard_rows(spark, documents, hard_rows, stage):
    import corpus_pipeline

    docs = documents(hard_rows).select("doc_id", "text", "lang", "source", "n_chars")
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, docs, SF_DIR).collect()
    if name == "near_dedup":
        assert sorted(r.doc_id for r in out if r.doc_id is not None and r.doc_id < 10) == [1, 4, 5, 6, 7, 9]
        assert sum(r.doc_id is None for r in out) == 2
    elif name == "mixing":
        assert len(out) == len(hard_rows)
    assert f(spark, docs.limit(0), SF_DIR).collect() == []


def test_driver_queries_against_sql(spark):
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
    import compare

    from surveyspark.llm.queries import ORACLES

    con = compare.duck(SF_DIR)
    for name in ORACLES:
        status, _, _, message = compare.compare(spark, con, name, SF_DIR)
        assert status == "ok", (name, message)
