"""Span and near-duplicate removal, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from surveyspark.llm import forest_dedup, spans
from surveyspark.llm.automaton_dedup import SuffixAutomaton, remove_seen
from surveyspark.llm.forest_dedup import near_components
from surveyspark.llm.lpf_dedup import factor_flags, remove_repeats, window_ranks
from surveyspark.llm.queries import QUERIES


def corpus(seed: int, docs: int = 60) -> list[tuple[int, str]]:
    """Texts that share passages, copies and near copies."""
    g = random.Random(seed)
    words = ["".join(g.choices("abcdeéf", k=g.randint(2, 9))) for _ in range(400)]
    passages = [" ".join(g.choices(words, k=g.randint(15, 120))) for _ in range(6)]
    out = []
    for i in range(docs):
        parts = [" ".join(g.choices(words, k=g.randint(0, 150)))]
        if g.random() < 0.6:
            parts.insert(g.randint(0, 1), g.choice(passages))
        text = " ".join(parts)
        if out and g.random() < 0.3:
            text = g.choice(out)[1]
            if g.random() < 0.7:
                w = text.split(" ")
                w[g.randrange(len(w))] = "changed"
                text = " ".join(w)
        out.append((i * 3 + 1, text))
    return out


def brute_bytes(rows, width):
    seen = Counter(b[s : s + width] for _, t in rows for b in [(t or "").encode()] for s in range(len(b) - width + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        keep = [True] * len(b)
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                keep[s : s + width] = [False] * width
        kept = bytes(x for x, k in zip(b, keep) if k)
        runs = sum(1 for j, k in enumerate(keep) if not k and (j == 0 or keep[j - 1]))
        out.append((i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, width):
    def words(t):
        return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())

    first: dict = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[s : s + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for s in range(len(w) - width + 1):
            if i is not None and first[tuple(w[s : s + width])] < i:
                keep[s : s + width] = [False] * width
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_components(rows, n, percent=80):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append((i, {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("crowd", [4096, 1])
def test_repeats_equal_brute_force(spark, documents, crowd, monkeypatch):
    rows = corpus(1)
    if crowd == 1:  # every anchor goes the way of crowded ones
        plain = spans.repeated_spans
        monkeypatch.setattr("surveyspark.llm.lpf_dedup.repeated_spans", lambda df, rule, method: plain(df, rule, method, crowd=1))
        monkeypatch.setattr("surveyspark.llm.automaton_dedup.repeated_spans", lambda df, rule, method: plain(df, rule, method, crowd=1))
    got = [tuple(r) for r in remove_repeats(documents(rows), width=60, k=12).collect()]
    assert sorted(got, key=str) == brute_bytes(rows, 60)
    assert sum(r[2] for r in got) > 0
    got = [tuple(r) for r in remove_seen(documents(rows), width=8, k=3).collect()]
    assert sorted(got, key=str) == brute_words(rows, 8)


def test_few_local_contexts_and_small_flushes_change_nothing(spark, documents, monkeypatch):
    rows = corpus(2)
    rule = spans.Rule(8, 3, words=True, smaller=True)
    read = spans._read

    def eager(rule, buckets):
        spans.FLUSH, spans.LOCAL_CONTEXTS = 50, 1
        return read(rule, buckets)

    monkeypatch.setattr(spans, "FLUSH", 50)
    monkeypatch.setattr(spans, "LOCAL_CONTEXTS", 1)
    monkeypatch.setattr(spans, "_read", eager)
    got = [tuple(r) for r in remove_seen(documents(rows), width=8, k=3).collect()]
    assert rule.smaller and sorted(got, key=str) == brute_words(rows, 8)


def in_tasks(spark, *tasks):
    """A table whose tasks read the given rows (id, text), so each task is one flush."""
    rdd = spark.sparkContext.parallelize(tasks, len(tasks)).flatMap(lambda rows: rows)
    return spark.createDataFrame(rdd, "doc_id long, text string")


def rare_phrase(g, words, k):
    """The ``k`` symbols (words or lower-case letters) of the smallest hash among many: the anchor of all windows around it."""
    stream = ["".join(g.choices("abcdefghij", k=6 if words else 1)) for _ in range(200000)]
    data = (" " if words else "").join(stream).encode()
    data = np.frombuffer(data, np.uint8)
    symbols, _ = spans.Rule(k, k, words, False).symbols(data, np.array([0, len(data)]))
    at = np.arange(len(symbols) - k + 1)
    i = int(spans.SubHashes(symbols).of(at, at + k).argmin())
    return stream[i : i + k]


def test_smallest_document_held_back_by_a_crowded_flush(spark):
    g = random.Random(4)
    phrase = rare_phrase(g, True, 5)

    def text():
        side = ["".join(g.choices("klmnopqrst", k=7)) for _ in range(16)]
        return " ".join(side[:8] + phrase + side[8:])

    shared = [text() for _ in range(4)]
    crowded = [(50 + i, t) for i, t in enumerate(shared)] + [(900 + i, text()) for i in range(2 * spans.LOCAL_CONTEXTS)]
    other = [(500, t) for t in shared[:1]] + [(600, shared[1] + " more"), (700, text())]
    got = [tuple(r) for r in remove_seen(in_tasks(spark, crowded, other)).collect()]
    assert sorted(got, key=str) == brute_words(crowded + other, 13)
    assert {r[0]: r[2] for r in got}[500] == 21


def test_settled_copies_meet_contexts_held_back_elsewhere(spark):
    g = random.Random(5)
    phrase = "".join(rare_phrase(g, False, 12))

    def text():
        side = g.choices("klmnopqrst", k=96)
        return "".join(side[:48]) + phrase + "".join(side[48:])

    shared = [text() for _ in range(3)]
    copies = [(100 + 2 * i + j, t) for i, t in enumerate(text() for _ in range(2 * spans.LOCAL_CONTEXTS)) for j in range(2)]
    crowded = [(i, t[:-1] + "!") for i, t in enumerate(shared)] + copies
    other = [(900 + 2 * i + j, t) for i, t in enumerate(shared) for j in range(2)]
    got = [tuple(r) for r in remove_repeats(in_tasks(spark, crowded, other), width=60, k=12).collect()]
    assert sorted(got, key=str) == brute_bytes(crowded + other, 60)
    assert [r[2] for r in sorted(got)][:3] == [107] * 3


def test_repeats_on_hard_rows(spark, documents, hard_rows):
    rows = [r for r in hard_rows if r[0] != 10]
    got = [tuple(r) for r in remove_repeats(documents(rows), width=60, k=12).collect()]
    assert sorted(got, key=str) == brute_bytes(rows, 60)
    run = remove_repeats(documents([(10, "x" * 30000), (1, "x" * 59)])).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in run) == [(1, 0, 0), (10, 30000, 1)]


def test_passages_of_over_fifty_words_go_from_400_bytes_on(spark, documents, tmp_path):
    g = random.Random(6)

    def prose(n):
        return " ".join("".join(g.choices("abcdefghij", k=6)) for _ in range(n))

    rows, lengths, i = [], {}, 0
    for n_bytes in (399, 400, 401, 700):
        passage = prose(n_bytes // 7 + 1)[: n_bytes - 1] + "k"
        assert len(passage.split()) > 50
        for side in "lm":  # no byte beside the passage repeats with it
            rows.append((i, f"{prose(40)}{side}{passage}{side}{prose(40)}"))
            lengths[i] = n_bytes
            i += 1
    rows += [(100 + j, prose(g.randint(51, 200))) for j in range(20)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op7_suffix_array_dedup"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute_bytes(rows, 400)
    assert {r[0]: r[2] for r in got if r[0] < 100} == {k: n if n >= 400 else 0 for k, n in lengths.items()}
    assert all(r[2] == 0 for r in got if r[0] >= 100)


def test_keep_first_keeps_the_smallest_document(spark, documents):
    text = " ".join(f"w{i}" for i in range(40))
    got = {r.doc_id: r for r in remove_repeats(documents([(5, text), (3, text), (9, text + " more")]), width=60, k=12, keep_first=True, with_bytes=True).collect()}
    assert bytes(got[3].kept) == text.encode() and got[5].n_removed == len(text) and bytes(got[9].kept) == b" more"


def test_seen_on_hard_rows(spark, documents, hard_rows):
    got = [tuple(r) for r in remove_seen(documents(hard_rows)).collect()]
    assert sorted(got, key=str) == brute_words(hard_rows, 13)


def test_empty_tables(spark, documents):
    none = documents([])
    for f in (remove_repeats, remove_seen, near_components):
        assert f(none).collect() == []


@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=6), st.lists(st.integers(0, 2), max_size=12))
@settings(max_examples=200, deadline=None)
def test_automaton_statistics(texts, query):
    a = SuffixAutomaton()
    for t in texts:
        a.add(t)
    found = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    want = [max((n for n in range(e + 1) if n == 0 or tuple(query[e - n : e]) in found), default=0) for e in range(1, len(query) + 1)]
    assert a.statistics(query) == want


@given(st.binary(min_size=6, max_size=60).map(lambda b: bytes(x % 2 for x in b)))
@settings(max_examples=100, deadline=None)
def test_factor_flags(text):
    width = 5
    data = np.frombuffer(text, np.uint8)
    starts = np.arange(len(text) - width + 1)
    previous, following = factor_flags(window_ranks(data, starts, width), starts)
    parts = [text[s : s + width] for s in starts]
    assert previous.tolist() == [p in parts[:i] for i, p in enumerate(parts)]
    assert following.tolist() == [p in parts[i + 1 :] for i, p in enumerate(parts)]


@pytest.mark.parametrize("words", [2, 5])
def test_components_equal_brute_force(spark, documents, words):
    rows = corpus(3, 120)
    got = near_components(documents(rows), words=words).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_of_a_large_group(spark, documents, monkeypatch):
    g = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(250):  # copies of one text with up to a fifth of the words changed
        w = list(base)
        for _ in range(g.randint(0, 14)):
            w[g.randrange(len(w))] = f"c{g.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(forest_dedup, "BLOCK", 32)
    got = near_components(documents(rows), words=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 2)


def test_components_on_hard_rows(spark, documents, hard_rows):
    rows = [r for r in hard_rows if r != (13, "another text of that id")]
    got = near_components(documents(rows), words=5).collect()
    want = brute_components(rows, 5)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept for r in got if r.doc_id is None or r.n_shingles == 0)
