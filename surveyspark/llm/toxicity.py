"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct 3- to 5-grams of the lower-cased characters, known by 64-bit
hashes. A text is read in windows of bounded length, so that presence means the same in short
and in long texts. For each n-gram the log ratio of its window frequencies in both classes,
smoothed towards 1, gives the scale ``r`` of its column; a logistic regression with an L2
penalty is fitted on the scaled presence of the n-grams that stand apart most, whichever
class they speak for. A document's odds are the mean of its windows' odds: harmless text
around an insult divides its odds by the number of windows, and does so to chance hits too,
whose expected odds thereby do not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import BASE, batches_of, cut_lineage, mix, release

_U = np.uint64
ORDERS = (3, 4, 5)
#: Labelled rows and windows of them that the fit reads at most, and features it keeps at most.
FIT_ROWS, FIT_WINDOWS, FEATURES = 8000, 12_000, 8192
#: Characters of a window, and those it shares with the next.
WINDOW, SHARED = 1200, 64
SMOOTHING, LEAST_ROWS = 4.0, 3
#: A feature must stand in more or fewer toxic windows than the share of these explains, by so many deviations.
LEAST_DEVIATIONS = 3.0
#: N-grams that a task counts before it folds them.
FOLD = 4_000_000
_SEEN_BITS = 22
_TABLE_BITS = 22


def held_out(id_col: str) -> Column:
    """Ids whose crc32 (of the id as text) leaves 1 modulo 3; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash words of all characters, each text between two zero characters, and the row of each character."""
    lower = [(t or "").lower().replace("\0", " ") for t in texts]
    codes = np.frombuffer(("\0" + "\0".join(lower) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lens = np.array([len(t) + 1 for t in lower])
    row = np.repeat(np.arange(len(texts)), lens)
    return mix(codes.astype(_U) * _U(BASE) + _U(1)), np.append(row, row[-1:] if len(row) else 0)


def grams(words: np.ndarray, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """Hash of the n-gram that starts at each character, one array per order."""
    h = words
    for n in range(2, max(orders) + 1):
        if len(words) < n:
            return
        h = h[:-1] * _U(0xD1342543DE82EF95) + words[n - 1 :]
        if n in orders:
            yield h


def _chunks(texts: list[str | None], limit: int = 1 << 18, rows: int = 512) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of rows with about ``limit`` characters and at most ``rows`` rows; a longer text stands alone, whole."""
    at, size, first = 0, 0, 0
    for at, t in enumerate(texts):
        size += len(t or "")
        if size >= limit or at - first + 1 == rows:
            yield first, texts[first : at + 1]
            first, size = at + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def windows_of(text: str | None) -> list[str]:
    """A text in windows; the empty one is a window too."""
    text = text or ""
    return [text[s : s + WINDOW + SHARED] for s in range(0, max(1, len(text) - SHARED), WINDOW)]


def _distinct_grams(text: str) -> np.ndarray:
    own = list(grams(_joined([text])[0]))
    return np.unique(np.concatenate(own)) if own else np.zeros(0, _U)


class _Counts:
    """In how many toxic and clean windows n-grams stand, folded whenever many are held."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, own: np.ndarray, toxic: bool) -> None:
        n = np.ones(len(own), np.int64)
        self.held.append((own, n * toxic, n * (not toxic)))
        self.size += len(own)
        if self.size >= FOLD:
            self.held = [self.folded()]
            self.size = len(self.held[0][0]) // 2  # what is folded already counts half

    def folded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        names, to = np.unique(np.concatenate([h[0] for h in self.held]), return_inverse=True)
        return names, *(np.bincount(to, np.concatenate([h[k] for h in self.held]), len(names)).astype(np.int64) for k in (1, 2))


COUNTS_DDL = "gram long, pos long, neg long"


def _count(often: int, seen: np.ndarray | None):
    """Counts of the task's n-grams: all of toxic windows and what clean ones hold ``often``; with ``seen``, all that it may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                own = _distinct_grams(text)
                counts.add(own if seen is None else own[seen[own >> _U(64 - _SEEN_BITS)]], label == 1)
        names, pos, neg = counts.folded()
        if seen is None:
            some = (pos > 0) | (neg >= often)
            names, pos, neg = names[some], pos[some], neg[some]
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(pos), pa.array(neg)], names=["gram", "pos", "neg"])
        del counts, names, pos, neg
        release()

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmap of the first bits of the task's n-grams."""
    seen = np.zeros(1 << _SEEN_BITS, bool)
    for batch in batches:
        seen[batch.column("gram").to_numpy().view(_U) >> _U(64 - _SEEN_BITS)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()])], names=["bits"])


@dataclass
class ToxicityModel:
    """Sorted feature hashes, their weights (ratio times coefficient) and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def presence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) pairs, in order."""
        rows, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        slots, others = _slots(self.hashes)
        for first, part in _chunks(texts) if len(self.hashes) else ():
            words, row = _joined(part)
            held = np.zeros((len(part), len(self.hashes)), bool)
            for h in grams(words):
                slot = slots[(h * _U(BASE)) >> _U(64 - _TABLE_BITS)]
                at = np.flatnonzero(slot >= 0)
                place = slot[at]
                hit = self.hashes[place] == h[at]
                held[row[at[hit]], place[hit]] = True
                for f in others:
                    held[row[np.flatnonzero(h == self.hashes[f])], f] = True
            at, place = np.nonzero(held)
            rows.append(at + first)
            features.append(place)
        return np.concatenate(rows), np.concatenate(features)

    def window_logits(self, windows: list[str]) -> np.ndarray:
        rows, features = self.presence(windows)
        return np.bincount(rows, self.weights[features], len(windows)) + self.bias

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(texts))
        parts = [windows_of(t) for t in texts]
        counts = np.array([len(p) for p in parts])
        row = np.repeat(np.arange(len(parts)), counts)
        z = self.window_logits([w for p in parts for w in p])
        odds = np.bincount(row, np.exp(np.clip(z, -50, 50)), len(parts)) / np.maximum(counts, 1)
        return odds / (1 + odds)

    def score(self, text: str) -> Column:
        """Score in 0..1 as a column; null is scored as the empty text."""
        model = self

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            out = pa.array(model.probabilities(texts.to_pylist()))
            release()
            return out

        return scored(F.coalesce(F.col(f"`{text}`"), F.lit("")))


_TABLES: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature at each place of a table (-1: none), and the few whose place is taken; a task builds it once for a model."""
    key = hashes.tobytes()
    if key not in _TABLES:
        _TABLES.clear()
        places = (hashes * _U(BASE)) >> _U(64 - _TABLE_BITS)
        table = np.full(1 << _TABLE_BITS, -1, np.int32)
        table[places] = np.arange(len(hashes))
        _TABLES[key] = table, np.flatnonzero(table[places] != np.arange(len(hashes)))
    return _TABLES[key]


def _logistic(rows: np.ndarray, features: np.ndarray, scale: np.ndarray, y: np.ndarray, penalty: float, steps: int, part: int = 1 << 18) -> tuple[np.ndarray, float]:
    """Coefficients of scaled presence and bias, by Nesterov steps; sums go over parts of the presence list to keep the driver small."""
    cuts = [slice(s, s + part) for s in range(0, len(rows), part)]

    def by_row(w: np.ndarray) -> np.ndarray:
        return sum((np.bincount(rows[c], w[features[c]], len(y)) for c in cuts), np.zeros(len(y)))

    def by_feature(g: np.ndarray) -> np.ndarray:
        return scale * sum((np.bincount(features[c], g[rows[c]], len(scale)) for c in cuts), np.zeros(len(scale)))

    weight = np.full(len(y), 1 / len(y))
    rate = 1 / (0.25 * (weight * (by_row(scale * scale) + 1)).sum() + penalty)
    w, b = np.zeros(len(scale)), 0.0
    vw, vb = w.copy(), b
    for k in range(steps):
        z = by_row(scale * vw) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        nw = vw - rate * (by_feature(g) + penalty * vw)
        nb = vb - rate * g.sum()
        m = k / (k + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def _features(sample: DataFrame, positive: int, negative: int, tasks: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and ratios of the n-grams that stand apart most; counts stay in Spark but for the chosen ones."""
    share = positive / (positive + negative)
    # a clean n-gram can stand apart only if it is frequent, so in one task at least it is frequent
    often = max(1, int(LEAST_DEVIATIONS**2 / share / tasks))
    first = sample.mapInArrow(_count(often, None), COUNTS_DDL).groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    maps = first.filter((F.col("pos") >= LEAST_ROWS) | (F.col("neg") >= often)).select("gram").coalesce(tasks).mapInArrow(_marks, "bits binary").collect()
    seen = np.zeros(1 << _SEEN_BITS, bool)
    for m in maps:
        seen |= np.unpackbits(np.frombuffer(m["bits"], np.uint8)).astype(bool)
    exact = sample.mapInArrow(_count(often, seen), COUNTS_DDL).groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = F.col("pos") + F.col("neg")
    apart = (F.col("pos") - n * share) / F.sqrt(n * share * (1 - share))
    p = (F.col("pos") + SMOOTHING * share) / (positive + 2 * SMOOTHING * share)
    q = (F.col("neg") + SMOOTHING * (1 - share)) / (negative + 2 * SMOOTHING * (1 - share))
    chosen = exact.filter(n >= LEAST_ROWS).select("gram", F.abs(apart).alias("apart"), F.log(p / q).alias("ratio")).filter(F.col("apart") >= LEAST_DEVIATIONS)
    got = chosen.orderBy(F.desc("apart"), "gram").limit(features).toArrow()
    hashes, ratio = got.column("gram").to_numpy().view(_U), got.column("ratio").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], ratio[order]


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, windows: int = FIT_WINDOWS, features: int = FEATURES, tasks: int = 4) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents (smallest hash of their id) and ``windows`` windows of them.

    ``labels`` are the rows to learn from; a null label or id is no label, several labels of
    an id count as the largest. Null texts are empty ones. Without both classes, or without
    an n-gram that tells them apart, the model has no features and scores every text 0.
    """
    batches_of(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    known = cut_lineage(known.orderBy(F.xxhash64("id"), "id").limit(rows))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(known), "id").select("text", "label")  # ``rows`` bounds the broadcast side
    cut = f"transform(sequence(0, cast(greatest(0, ceil((length(text) - {SHARED}) / {WINDOW}) - 1) as int)), i -> substring(text, i * {WINDOW} + 1, {WINDOW + SHARED}))"
    sample = sample.select("label", F.explode(F.expr(cut)).alias("text")).orderBy(F.xxhash64("text"), "text", "label").limit(windows)
    sample = cut_lineage(sample.repartition(tasks, F.xxhash64("text")).coalesce(tasks))
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    nothing = ToxicityModel(np.zeros(0, _U), np.zeros(0), -500.0)
    if not positive or not negative:
        return nothing
    hashes, scale = _features(sample, positive, negative, tasks, features)
    if not len(hashes):
        return nothing
    empty = ToxicityModel(hashes, np.zeros(len(hashes)), 0.0)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at, feature = empty.presence(texts)
            cut = np.searchsorted(at, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([feature[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["label", "features"])

    got = sample.mapInArrow(present, "label int, features binary").toArrow()  # at most ``windows`` lists of features
    got = sorted(zip(got.column("label").to_pylist(), got.column("features").to_pylist()))
    y = np.array([label for label, _ in got], float)
    at = np.repeat(np.arange(len(got), dtype=np.int32), [len(x) // 4 for _, x in got])
    of = np.frombuffer(b"".join(x for _, x in got), "<i4")
    del got
    w, b = _logistic(at, of, scale, y, penalty=3e-4, steps=300)
    del at, of
    release()
    return ToxicityModel(hashes, w * scale, b)
