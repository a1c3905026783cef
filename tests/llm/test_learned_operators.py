"""Toxicity, personal data, tokens and packing."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from surveyspark.llm import pii
from surveyspark.llm.bpe import Vocabulary
from surveyspark.llm.packing import pack
from surveyspark.llm.tagger import TAGS, Tagger
from surveyspark.llm.toxicity import fit_toxicity, held_out

SF_DIR = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")


def test_toxicity_on_held_out_labels(spark, labelled):
    docs, labels = labelled
    model = fit_toxicity(docs, labels.filter(~held_out("doc_id")))
    rows = docs.select("doc_id", model.score("text").alias("score")).join(labels, "doc_id").filter(held_out("doc_id")).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    good = sum(a.score > b.score for a in rows if a.toxic for b in rows if not b.toxic)
    assert good / sum(1 for a in rows if a.toxic for b in rows if not b.toxic) > 0.9
    assert sum(r.score >= 0.7 for r in rows if not r.toxic) <= 0.02 * len(rows)


def test_toxicity_held_out_is_crc32(spark):
    ids = spark.range(200).select("id", held_out("id").alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in ids)


def test_toxicity_learns_an_insult_in_long_texts(spark, documents):
    g = random.Random(1)
    plain = ["".join(g.choices("abcdefgh", k=5)) for _ in range(50)]
    rows = [(i, " ".join(g.choices(plain, k=40) + (["zzyxinsult"] * 2 if i % 5 == 0 else []))) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = fit_toxicity(documents(rows), labels)
    clean = " ".join(g.choices(plain, k=20000))
    texts = documents([(1, clean), (2, clean + " zzyxinsult zzyxinsult"), (3, None), (4, ""), (5, "Zzyxinsult!")])
    got = {r.doc_id: r.score for r in texts.withColumn("score", model.score("text")).select("doc_id", "score").collect()}
    assert got[1] < 0.5 < got[2] and got[3] == got[4] < 0.5 < got[5]


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit_toxicity(documents([(1, "text")]), none)
    assert documents([(1, "text")]).select(model.score("text").alias("x")).first().x == 0
    only = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert documents([(1, "text")]).select(fit_toxicity(documents([(1, "text")]), only).score("text").alias("x")).first().x == 0


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def digits(t):
        return re.sub("[^0-9]", "", t)

    ok = {
        "email": lambda t: True, "ip": lambda t: all(int(p) <= 255 for p in t.split(".")),
        "card": lambda t: 16 <= len(digits(t)) <= 19 and sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits(t)))) % 10 == 0,
        "phone": lambda t: 8 <= len(digits(t)) <= 15,
    }
    return [(k, *m.span()) for k, rule in RULES.items() for m in re.finditer(rule, text) if ok[k](m.group())]


@given(st.lists(st.sampled_from(["a", "b.c", "@", "@x.y", ".", "-", " ", "+1", "0", "25", "255.1", "(", ")", "4242", "é"]), max_size=40).map("".join))
@settings(max_examples=500, deadline=None)
def test_rules_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_rules_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000, "a" * 100_000 + "@b.c"):
        pii.base_spans(text)


def test_tagger_gradient():
    g = np.random.default_rng(0)
    tagger = Tagger.fresh(4, 3)
    ids, tags = g.integers(0, 130, (3, 6)), g.integers(0, TAGS, (3, 6))
    _, grads = tagger.step(ids, tags)
    for name, p in tagger.parameters.items():
        at = (ids[0, 0], 1) if name == "chars" else tuple(int(g.integers(s)) for s in p.shape)
        old, losses = p[at], []
        for d in (1e-5, -1e-5):
            p[at] = old + d
            losses.append(tagger.step(ids, tags)[0])
        p[at] = old
        assert abs((losses[0] - losses[1]) / 2e-5 - grads[name][at]) < 1e-6


def test_tagger_adds_what_the_rules_drop(spark, documents):
    g = random.Random(3)

    def card():
        body = "4" + "".join(g.choices("0123456789", k=14))
        return next(body + d for d in "0123456789" if pii.luhn(body + d))

    def phone():
        return f"+1 ({g.randint(200, 999)}) 555-{g.randint(1000, 9999)}"

    def prose():
        return " ".join("".join(g.choices("abcdefghij", k=g.randint(2, 9))) for _ in range(g.randint(5, 12)))

    rows = [(i, f"{prose()} {g.choice([card, phone])()} {prose()}") for i in range(400)]
    tagger = pii.fit_tagger(documents(rows))
    number, call = card(), phone()
    text = f"{prose()} {call} {number} {prose()}"
    assert pii.base_spans(text) == []
    (base, every), (none, clean) = pii.all_spans(tagger, [text, prose()])
    assert base == none == clean == []
    at, to = text.index(number), text.index(call)
    assert every == [("card", at, at + 16), ("phone", to, to + len(call))]
    docs = documents([(1, text), (2, None), (3, ""), (None, "call +1 (222) 555-1234 now"), (2, None)])
    got = {(r.doc_id, r.spans): r for r in pii.find_personal_data(docs, tagger).collect()}
    assert len(got) == 4 and got[1, f"card:{at}:{at + 16},phone:{to}:{to + len(call)}"].n_card == 0
    assert got[None, "phone:5:22"].n_phone == 1
    hidden = {r.doc_id: r.text for r in pii.redact(docs, tagger).select("doc_id", "text").collect()}
    assert "[CARD]" in hidden[1] and "[PHONE]" in hidden[1] and hidden[2] is None and hidden[None] == "call [PHONE] now"


def test_tagger_without_labels(spark, documents):
    assert pii.fit_tagger(documents([])) is None
    assert pii.fit_tagger(documents([(1, "no marks at all"), (2, None)])) is None
    row = pii.find_personal_data(documents([(1, "a@b.cd")]), None).first()
    assert row.spans == "email:0:6"


@given(st.lists(st.sampled_from(["'s", "'t", " 'll", "'re've", "  ", "\t", "\n\n", " ", "a", "Bé", "漢", "1", "²", "!", "'", "''", "　", "👍", "don't", "\x1c", "\x85", "<|endoftext|>", "ª"]), max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_tokenizer(text):
    want = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in Vocabulary.load(VOCABULARY).encode([text, "", text])] == [want, [], want]


def test_packing_round_trip(spark, labelled):
    docs = labelled[0].repartition(3)
    pieces = pack(docs, VOCABULARY, with_ids=True).toPandas().sort_values(["doc_id", "start"])
    texts = dict(docs.select("doc_id", "text").collect())
    for key, own in pieces.groupby("doc_id"):
        ids = [x for part in own.ids for x in part]
        assert ids == [*TOKENIZER.encode(texts.pop(key), add_special_tokens=False).ids, 1]
        assert (own.doc_tokens == len(ids)).all() and own.start.tolist() == np.cumsum([0, *own.length[:-1]]).tolist()
    assert not texts
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(pieces.ids, pieces.ids_crc32))
    padding = total = 0
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        n = int(own.length.sum())
        assert own.offset.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and n <= 2048
        total += n
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding / total < 0.01
    steps = pieces.groupby(["step_group", "context"]).sequence_id.nunique().reset_index()
    assert (steps.sequence_id * steps.context <= 1 << 16).all()


def test_packing_on_hard_rows(spark, documents, hard_rows):
    pieces = pack(documents(hard_rows), VOCABULARY).collect()
    assert sum(p.length for p in pieces if p.doc_id in (4, 5)) == 2
    assert sum(p.start == 0 for p in pieces) == len(hard_rows)
    assert pack(documents([]), VOCABULARY).collect() == []


def test_redacted_pipeline_stage_keeps_columns(spark, documents):
    import corpus_pipeline

    docs = documents([(1, "write to a@b.cd"), (2, None)]).select("doc_id", "text", "lang", "source", "n_chars")
    out = corpus_pipeline.hide_personal_data(spark, docs, SF_DIR)
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == "write to [EMAIL]" and rows[1].n_chars == 16 and rows[2].text is None


def test_toxicity_does_not_grow_with_length(spark, labelled):
    docs, labels = labelled
    model = fit_toxicity(docs, labels.filter(~held_out("doc_id")))
    rows = docs.join(labels, "doc_id").filter(held_out("doc_id")).filter("toxic = 0").select("text").collect()
    g = random.Random(5)
    for size, n in ((2400, 200), (48_000, 60), (480_000, 8)):
        texts = []
        for _ in range(n):
            text = ""
            while len(text) < size:
                text += g.choice(rows).text + "\n"
            texts.append(text[:size])
        assert (model.probabilities(texts) >= 0.7).mean() <= 0.02


def test_toxicity_weighs_both_signs(spark, documents):
    g = random.Random(2)
    rows = [(i, " ".join(g.choices(["salt", "bread", "river", "stone"], k=30) + (["badword"] * 2 if i % 3 == 0 else ["kindly"]))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = fit_toxicity(documents(rows), labels)
    assert (model.weights > 0).any() and (model.weights < 0).any()
    both, bad, kind, none = model.probabilities(["bread badword kindly", "bread badword", "bread kindly", "bread stone"])
    assert bad > both > kind and bad > none > kind


def test_windows_cover_the_text():
    from surveyspark.llm.toxicity import SHARED, WINDOW, windows_of

    for n in (0, 1, WINDOW, WINDOW + SHARED, WINDOW + SHARED + 1, 5 * WINDOW + 7):
        text = "".join(chr(97 + i % 23) for i in range(n))
        parts = windows_of(text)
        assert all(len(p) <= WINDOW + SHARED for p in parts) and "".join(p[:WINDOW] for p in parts[:-1]) + parts[-1] == text


def test_presence_of_features_that_share_a_place(monkeypatch):
    from surveyspark.llm import toxicity

    monkeypatch.setattr(toxicity, "_TABLE_BITS", 3)
    monkeypatch.setattr(toxicity, "_TABLES", {})
    texts = ["abcdefgh", "", "hgfedcba abc", None, "xyz" * 300]
    own = [np.unique(np.concatenate(list(toxicity.grams(toxicity._joined([t])[0])))) if t else np.zeros(0, np.uint64) for t in texts]
    model = toxicity.ToxicityModel(np.unique(np.concatenate(own))[::2], np.zeros(0), 0.0)
    rows, features = model.presence(texts)
    want = [(i, f) for i, o in enumerate(own) for f, h in enumerate(model.hashes) if h in set(o.tolist())]
    assert list(zip(rows.tolist(), features.tolist())) == want and len(want) > 20
