"""Personal data: fixed rules, and a tagger that adds what the rules miss.

The rules find e-mail addresses, IP addresses, card and phone numbers in whole texts. The
tagger (BiLSTM with CRF, see ``tagger``) learns from labelled spans; where none are given, the
spans of the rules in a bounded sample of documents are the labels. Everything it could
add holds a digit or an ``@``, so it reads the surroundings of those characters, in
overlapping windows. Each character takes its scores from the window in which it lies most
centrally; the stitched stretch is then decoded as one sequence.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import batches_of, cut_lineage, edge_bytes, released
from surveyspark.llm.tagger import KINDS, WINDOW, Tagger, char_ids

Span = tuple[str, int, int]
#: Documents that the fit reads at most, and windows it learns from at most.
FIT_DOCUMENTS, FIT_WINDOWS = 8000, 1200
AROUND, STRIDE, LEAST_MARGINAL = 24, WINDOW // 2, 0.9

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# runs of digits are taken whole (possessive), which matches the same and keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            reach, start = 64, at
            while True:  # the run of address characters before the sign, read in growing pieces
                low = max(end, at - reach)
                tail = text[low:at]
                start = low + len(tail.rstrip(_LOCAL))
                if start > low or low == end:
                    break
                reach *= 4
            if start < at:
                yield "email", start, m.end()
                end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed rules, by kind as listed, then start; ends are exclusive."""
    out = list(_emails(text)) if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Surroundings of digits and address signs, merged where they touch."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        s, e = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _starts(length: int) -> range:
    return range(0, max(length - WINDOW, 0) + STRIDE, STRIDE) if length > WINDOW else range(1)


def _padded(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    out[: len(ids)] = ids
    return out


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, s, e in spans:
        k = KINDS.index(kind)
        tags[s:e] = 2 + 2 * k
        tags[s] = 1 + 2 * k
    return tags


def unclear(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Stretches that the rules match and then drop: their labels would be wrong as often as right."""
    good = {(s, e) for _, s, e in base}
    return [m.span() for rule in (_CARD, _PHONE) for m in rule.finditer(text) if m.end() - m.start() > 19 and m.span() not in good]


def training_windows(text: str, spans: list[Span], without: list[tuple[int, int]] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of characters and tags around digits and address signs, clear of ``without``."""
    tags = tags_of(len(text), spans)
    for s, e in stretches(text):
        ids = char_ids(text[s:e])
        for a in _starts(e - s):
            low, high = s + a, min(s + a + WINDOW, e)
            if not any(x < high and low < y for x, y in without):
                yield _padded(ids[a : a + WINDOW]), _padded(tags[low:high])


def side_by_side(ids: np.ndarray, tags: np.ndarray, share: float = 0.3, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """More windows: spans of two windows next to each other, one space between, in the text of the first."""
    g = np.random.default_rng(seed)
    spans = []
    for i in range(len(ids)):
        begins = np.flatnonzero(tags[i] % 2 == 1)
        for b in begins:
            e = b + 1
            while e < WINDOW and tags[i, e] == tags[i, b] + 1:
                e += 1
            if e < WINDOW:
                spans.append((i, b, e))
    more_ids, more_tags = [], []
    for _ in range(int(share * len(ids)) if spans else 0):
        (i, b, e), (j, c, d) = spans[g.integers(len(spans))], spans[g.integers(len(spans))]
        skip = max(0, (e - b) + (d - c) + 9 - WINDOW)
        own_ids = np.concatenate([ids[i, :e], [32], ids[j, c:d], ids[i, e:]])
        own_tags = np.concatenate([tags[i, :e], [0], tags[j, c:d], tags[i, e:]])
        at = min(skip, b) if skip else max(0, b - 16)
        more_ids.append(_padded(own_ids[at : at + WINDOW]))
        more_tags.append(_padded(own_tags[at : at + WINDOW]))
    if not more_ids:
        return ids, tags
    return np.concatenate([ids, np.stack(more_ids)]), np.concatenate([tags, np.stack(more_tags)])


def _plausible(kind: str, text: str) -> bool:
    """What a span of the tagger must hold to be believed."""
    d = _digits(text)
    if kind == "email":
        return "@" in text and "." in text.rpartition("@")[2].strip(".") and not text.startswith("@")
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return 8 <= len(d) <= 15 and any(c in text for c in "+()-") and not set(text) - set("+() .-0123456789")


def found_spans(tagger: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans that the tagger sees in each text."""
    places, windows = [], []
    for i, text in enumerate(texts):
        for s, e in stretches(text):
            ids = char_ids(text[s:e])
            starts = list(_starts(e - s))
            places.append((i, s, e, len(windows), starts))
            windows += [_padded(ids[a : a + WINDOW]) for a in starts]
    out: list[list[Span]] = [[] for _ in texts]
    for first in range(0, len(places), 256):  # some stretches at a time bound the memory
        part = places[first : first + 256]
        low, high = part[0][3], part[-1][3] + len(part[-1][4])
        scores = np.concatenate([tagger.emissions(np.stack(windows[a : min(a + 512, high)])) for a in range(low, high, 512)])
        for i, s, e, at, starts in part:
            stitched = np.zeros((e - s, scores.shape[2]))
            central = np.full(e - s, -1)
            for k, a in enumerate(starts):
                n = min(WINDOW, e - s - a)
                depth = np.minimum(np.arange(n), n - 1 - np.arange(n)) if n == WINDOW else np.arange(n)
                better = depth > central[a : a + n]
                stitched[a : a + n][better] = scores[at - low + k, :n][better]
                central[a : a + n][better] = depth[better]
            tags = tagger.decode(stitched)
            if not tags.any():
                continue
            sure = tagger.marginals(stitched[None])[0]
            t = 0
            while t < len(tags):
                if tags[t] % 2 == 1:
                    kind, to = (int(tags[t]) - 1) // 2, t + 1
                    while to < len(tags) and tags[to] == 2 + 2 * kind:
                        to += 1
                    if sure[np.arange(t, to), tags[t:to]].min() >= LEAST_MARGINAL and _plausible(KINDS[kind], texts[i][s + t : s + to]):
                        out[i].append((KINDS[kind], s + t, s + to))
                    t = to
                else:
                    t += 1
    return out


def all_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Per text the spans of the rules, and those together with what the tagger adds beside them."""
    out = []
    for text, seen in zip(texts, found_spans(tagger, texts) if tagger else [[]] * len(texts)):
        base = base_spans(text)
        more = [x for x in seen if not any(x[1] < e and s < x[2] for _, s, e in base)]
        out.append((base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))))
    return out


def _touched(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, list[str]]:
    """Rows whose text holds a digit or an address sign, and these texts; no other text can hold a span."""
    data, offs = edge_bytes(batch.column(column))
    at = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
    rows = np.unique(np.searchsorted(offs, at, side="right") - 1)
    return rows, batch.column(column).take(pa.array(rows)).to_pylist()


def fit_tagger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = FIT_DOCUMENTS, windows: int = FIT_WINDOWS, spans_col: str | None = None, epochs: int = 10) -> Tagger | None:
    """Train on at most ``windows`` windows of at most ``documents`` documents (smallest hashes).

    ``spans_col``: labelled spans as array<struct<kind, start, end>>; without it the rules label.
    None if there is nothing to learn from.
    """
    batches_of(docs.sparkSession)
    labels = F.col(spans_col) if spans_col else F.lit(None).cast("array<struct<kind:string,start:int,end:int>>")
    src = docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("h"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), labels.alias("labels"))
    bound = cut_lineage(src.select("h").distinct().orderBy("h").limit(documents))
    sample = src.join(F.broadcast(bound), "h")  # ``documents`` bounds the broadcast side

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = _touched(batch, "text")
            ids, tags = [], []
            for text, given in zip(texts, batch.column("labels").take(pa.array(rows)).to_pylist()):
                spans = base_spans(text) if given is None else [(g["kind"], g["start"], g["end"]) for g in given]
                for a, b in training_windows(text, spans, unclear(text, spans) if given is None else ()):
                    ids.append(a.astype(np.uint8).tobytes())
                    tags.append(b.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(tags, pa.binary())], names=["ids", "tags"])

    got = sample.mapInArrow(cut, "ids binary, tags binary").distinct().orderBy(F.xxhash64("ids"), "ids", "tags").limit(windows).collect()
    if not got:
        return None
    tagger = Tagger.fresh()
    tagger.fit(*side_by_side(*(np.stack([np.frombuffer(g[c], np.uint8) for g in got]).astype(np.int64) for c in ("ids", "tags"))), epochs=epochs)
    return tagger


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_EMPTY = hashlib.sha256(b"").hexdigest()


def find_personal_data(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the rules by kind, sha256 of their spans, and all spans as text.

    One row per row of ``docs``, repeated rows and null ids included; null and empty texts
    have no spans. Offsets count code points. Other columns are not read.
    """
    batches_of(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((n, len(KINDS)), np.int64)
            sha, spans = [_EMPTY] * n, [""] * n
            rows, texts = _touched(batch, "text")
            for i, (base, every) in zip(rows.tolist(), all_spans(tagger, texts)):
                for k, _, _ in base:
                    counts[i, KINDS.index(k)] += 1
                sha[i], spans[i] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[:, k].copy()) for k in range(len(KINDS))), pa.array(sha), pa.array(spans)],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return src.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """The rows with every span replaced by its kind in capitals and brackets; all columns stay."""
    batches_of(docs.sparkSession, 250)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = _touched(batch, text_col)
            column = batch.column(text_col)
            out = column.to_pylist()
            for i, text, (_, spans) in zip(rows.tolist(), texts, all_spans(tagger, texts)):
                done = len(text)
                for kind, s, e in sorted(spans, key=lambda x: x[1], reverse=True):
                    text = text[:s] + f"[{kind.upper()}]" + text[max(min(e, done), s) :]
                    done = s
                out[i] = text
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, column.type))

    return docs.mapInArrow(released(run), docs.schema)
