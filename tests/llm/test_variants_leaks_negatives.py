"""Spelling variants, benchmark decontamination and hard negatives, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surveyspark.llm import negatives, spelling
from surveyspark.llm.decontamination import digest, find_leaks
from surveyspark.llm.negatives import mine_negatives
from surveyspark.llm.spelling import one_edit, spelling_forms

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_forms(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    n = {w: c for w, c in n.items() if c >= 3}
    near = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and x != w and edits(w, x) == 1] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out)


def misspelt(seed, docs=80):
    g = random.Random(seed)
    letters = "aaabcdeeéßÀ×ñst"
    base = ["".join(g.choices(letters, k=g.randint(4, 9))) for _ in range(120)]
    base += [b[:2] + g.choice(letters) + b[2:] for b in base] + [b[:-1] for b in base] + [b[:3] + g.choice(letters) + b[4:] for b in base] + ["".join(g.sample(base[0], len(base[0]))) for _ in range(30)]
    weights = [1 / (1 + i % 17) for i in range(len(base))]
    return [(i, g.choice([" ", "-", "1"]).join(w.upper() if g.random() < 0.1 else w for w in g.choices(base, weights, k=60))) for i in range(docs)]


@pytest.mark.parametrize("crowd", [200_000, 300, 20])
def test_forms_equal_brute_force(spark, documents, crowd):
    rows = misspelt(1)
    got = sorted(tuple(r) for r in spelling_forms(documents(rows), crowd=crowd).collect())
    assert got == brute_forms(rows)
    assert any(r[1] and r[2] != r[1] for r in got), "some chains have more than one step"


def test_forms_on_hard_rows(spark, documents, hard_rows):
    long = "y" * 30000
    rows = [r for r in hard_rows if r[0] != 9] + [(i, f"{long} {long}z {'q' * 64} {'q' * 65} {'q' * 64}ß ÀÉÎÕü àÉÎÕü") for i in (None, 20, 21, 21, 22)]
    want = brute_forms([(i, (t or "").replace(long, "Y" * 70)) for i, t in rows])  # the same edits on shorter words
    got = sorted(tuple(r) for r in spelling_forms(documents(rows)).collect())
    short = [tuple(x.replace(long, "y" * 70) if isinstance(x, str) else x for x in r) for r in got]
    assert sorted(r for r in short if "yy" not in r[0]) == [r for r in want if "yy" not in r[0]]
    assert {(len(r[0]), r[3], r[4]) for r in got if "yy" in r[0]} == {(30000, 5, 1), (30001, 5, 1)}
    assert spelling_forms(documents([])).collect() == [] and spelling_forms(documents([(1, None), (2, "a b")])).collect() == []


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
@settings(max_examples=400, deadline=None)
def test_one_edit(a, b):
    assert one_edit(a, b) == (edits(a, b) == 1)


@given(st.lists(st.text("abcdefgh", min_size=1, max_size=6), min_size=1, max_size=60, unique=True))
@settings(max_examples=100, deadline=None)
def test_search_of_a_subtree_reaches_all_near_words(words):
    import pyarrow as pa

    groups = np.arange(256) % spelling.GROUPS
    v = spelling.vectors_of(*spelling.letters_of(pa.array(words)), groups)
    order = np.lexsort(v.T[::-1])
    met = {(words[order[i]], words[j]) for lo, hi, who in spelling.descend(v[order], v) for i in range(lo, hi) for j in who.tolist()}
    assert {(a, b) for a in words for b in words if edits(a, b) == 1} <= met


def test_moves_meet_every_pair_once():
    for cut in spelling.CUTS:
        later = {tuple(m) for m in spelling.moves(cut)}
        every = {tuple(np.eye(cut, dtype=int)[a] * (a >= 0) - np.eye(cut, dtype=int)[b] * (b >= 0)) for a in range(-1, cut) for b in range(-1, cut) if a != b}
        assert all((m in later) != (tuple(-x for x in m) in later) for m in every) and later <= every


WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def brute_leaks(rows, items):
    def words(t):
        return re.findall(WORD, (t or "").translate(LOWER))

    windows = []
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        windows += [(item, w[s : s + n]) for s in range(len(w) - n + 1) if n]
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.update([] if item is None else [str(item)])
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leaky(seed):
    g = random.Random(seed)
    vocabulary = ["".join(g.choices("abcdé漢9", k=g.randint(1, 6))) for _ in range(150)] + ["the"] * 60
    items = [(i, " ".join(g.choices(vocabulary, k=g.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(40)]
    rows = []
    for i in range(90):
        w = g.choices(vocabulary, k=g.randint(0, 120))
        for _ in range(g.randint(0, 3)):
            leak = g.choice(items)[1].split()
            s = g.randint(0, max(0, len(leak) - 10))
            w[(at := g.randint(0, len(w))) : at] = leak[s : s + g.randint(5, 25)]
        rows.append((i * 2, g.choice([" ", ", ", "\n", "_"]).join(x.title() if g.random() < 0.2 else x for x in w)))
    return rows, items


ITEMS = "item_id long, text string, lang string, n_words int, key string"


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x", 0, "k") for i, t in items], ITEMS).repartition(2)


@pytest.mark.parametrize("part_bytes", [1 << 20, 4000])
def test_leaks_equal_brute_force(spark, documents, part_bytes):
    rows, items = leaky(1)
    rows += rows[:7]
    found = find_leaks(documents(rows), benchmark(spark, items), part_bytes=part_bytes)
    got = sorted((tuple(r) for r in digest(found).collect()), key=str)
    assert got == brute_leaks(rows, items)
    assert sum(r[5] for r in got) > 40 and sum(r[2] for r in got) > 300
    runs = {r.doc_id: r for r in found.collect()}
    assert all(r.runs == sorted(set(r.runs)) and r.items == sorted(set(r.items)) for r in runs.values())


def test_leaks_on_hard_rows(spark, documents, hard_rows):
    base = hard_rows[0][1].split()
    items = [(1, " ".join(base[5:17])), (2, "ONE"), (3, None), (4, ""), (5, "?!"), (None, " ".join(base[20:30])), (7, "a a a"), (7, "a a a"), (7, "text of"), (8, "x" * 30000), (9, "the frequent " * 8)]
    rows = hard_rows + [(30, "the frequent " * 400)]
    got = sorted((tuple(r) for r in digest(find_leaks(documents(rows), benchmark(spark, items))).collect()), key=str)
    assert got == brute_leaks(rows, items)
    none = digest(find_leaks(documents(rows), benchmark(spark, []))).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)
    assert digest(find_leaks(documents([]), benchmark(spark, items))).collect() == []


def brute_negatives(rows, k=5):
    kept: dict = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(256 * float(np.float32(e))) for e in v]
            kept[i] = min(kept.get(i, (x, label)), (x, label))
    out = []
    for a in sorted(kept):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(kept[a][0], v)), i, label == kept[a][1]) for i, (v, label) in kept.items() if i != a and len(v) == len(kept[a][0]))
        for s, p, same in [x for x in scored if x[2]][:k]:
            inside = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(inside, 1)]
    return sorted(out)


@pytest.fixture
def labelled(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(4)
        for name in ("v", "dim", "asks", "score", "kind", "windows", "cb"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return make


def labelled_vectors(n=1500, d=16, seed=0):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(8, d))
    own = g.integers(8, size=n)
    x = centres[own] + 0.5 * g.normal(size=(n, d))
    x[300:700] = x[299]  # a large group of equal vectors: ties
    labels = np.where(g.random(n) < 0.4, g.integers(4, size=n), own % 4)
    return [(int(i), int(c), v) for i, (c, v) in enumerate(zip(labels, x.astype(np.float32).tolist()))]


@pytest.mark.parametrize("numbers", [1 << 21, 16 * 90])
def test_negatives_equal_brute_force(spark, labelled, numbers, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATE_NUMBERS", numbers)
    monkeypatch.setattr(negatives, "ANCHOR_NUMBERS", min(numbers, 16 * 7))
    rows = labelled_vectors()
    got = sorted(tuple(r) for r in mine_negatives(labelled(rows)).collect())
    assert got == brute_negatives(rows) and len(got) > 200


def test_negatives_on_hard_rows(spark, labelled):
    v = [0.5, -0.25, 1.0]
    rows = [(0, 1, v), (100, 2, v), (200, None, v), (300, 1, None), (None, 1, v), (400, 1, [1.0, None, 2.0]), (500, 1, [math.nan, 1.0, 1.0]), (600, 1, [math.inf, 0.0, 0.0]), (700, 3, [])]
    rows += [(1, 1, v), (1, 1, v), (1, 2, [-9.0, 0.0, 0.0]), (2, 2, v), (3, 2, v), (4, 1, [0.0, 0.0, 0.0]), (5, 2, [-1.0, 0.0, 0.0]), (6, 1, [-1.0, 0.0, 0.0]), (7, 2, [0.0, 0.0, 0.0]), (8, 1, [1.0, 1.0]), (900, 1, [1.0, 1.0]), (9, 2, [1.0, 0.9])]
    got = sorted(tuple(r) for r in mine_negatives(labelled(rows)).collect())
    assert got == brute_negatives(rows) and {r[0] for r in got} >= {0, 100, 900}
    assert mine_negatives(labelled([])).collect() == []


@given(st.lists(st.integers(0, 4), min_size=1, max_size=40), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_first_of(scores, k):
    s = np.array(scores, dtype=float)
    assert negatives.first_of(s, k).tolist() == sorted(range(len(s)), key=lambda i: (-s[i], i))[:k]
