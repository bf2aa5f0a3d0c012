"""Token ids against the tokenizer's own library, abuse scores on held-out documents."""

import random

import pytest

from glintframe.llm import abuse, tokens
from glintframe.llm.mixing import _encoding

PATH = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"


def test_ids_against_the_library(spark):
    rng = random.Random(3)
    texts = [
        "", None, " ", "\n\n \t", "Hello world", "<|endoftext|> is text", "it's we'll I'D", "a" * 3000, "ab" * 1500, " " * 500 + "x", "日本語のテキスト" * 60, "🇸🇪 é́ İ ß ﬁ", "�​﻿",
        "x" * 70_000, "=-" * 400 + "=" * 99, "1234567890 " * 20, "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(400)),
    ]
    df = spark.createDataFrame([(i, t, [1], "x") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, _text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df).collect()}
    plain = _encoding(PATH).encode_ordinary
    assert got == {i: plain(t or "") for i, t in enumerate(texts)}
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    twice = tokens.encode_corpus(df.limit(5).unionByName(df.limit(5)))
    assert twice.count() == 10


@pytest.mark.parametrize("step_rows", [2_000_000, 3_000])
def test_ids_of_hard_words(monkeypatch, step_rows):
    """Runs, numbers and random words of any length; steps that one recursion can't hold."""
    monkeypatch.setattr(tokens, "STEP_ROWS", step_rows)
    rng = random.Random(9)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "aab", "etaoin", "0123456789", "ÅÄÖåäöé", "日本語のテキスト。", "-=_.", "\x1c\x1d\x85 \t\x0b\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 120))) for a in alphabets for _ in range(40)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (500, 5_000)] + ["vvv" * 40 + "ov" * 90, "z" * 999 + "yz" * 500]
    if step_rows > 10_000:
        texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)))
    plain = _encoding(PATH).encode_ordinary
    assert tokens.Encoder(PATH).encode(texts).to_pylist() == [plain(t) for t in texts]


def test_words_are_forgotten_not_lost(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 3)
    e = tokens.Encoder(PATH)
    plain = _encoding(PATH).encode_ordinary
    for part in (["one two three four"], ["two five six"], ["one two"]):
        assert e.encode(part).to_pylist() == [plain(t) for t in part]


def test_normalising():
    assert abuse.normalised("M0r0n​ Fееl") == "moron fel"
    assert abuse.normalised("s-t-u-p-i-d") == "stupid"
    assert abuse.normalised("c o c k") == "cock" and abuse.normalised("m_ron") == "mron"
    assert abuse.windows("") == [] and abuse.windows("?!") == []
    long = "word " * 1000
    assert all(len(w) <= abuse.WINDOW for w in abuse.windows(long))


def corpus(rng, n):
    things, colours = ["lamp", "boat", "tower", "heron", "kite", "violin"], ["red", "green", "amber", "blue"]
    ordinary = ["the {c} {t} looks fine in the new index", "could you make the {t} view optional", "searching for a {c} {t} takes 3 seconds"]
    toxic = ["you are a complete {i} and everyone here knows it", "shut up {i} nobody asked you", "i hope you lose your job you {i}"]
    insults = ["blockhead", "dunderpate", "numskull", "nitwit"]
    out = []
    for i in range(n):
        bad = rng.random() < 0.2
        lines = [rng.choice(ordinary).format(c=rng.choice(colours), t=rng.choice(things)) for _ in range(4)]
        if bad:
            lines.insert(rng.randrange(4), rng.choice(toxic).format(i=rng.choice(insults)))
        out.append((i, rng.choice(["s", None]), ". ".join(lines), bad))
    return out


def test_abuse_is_found(spark):
    rng = random.Random(2)
    rows = corpus(rng, 1500)
    reviews = [(i, "remove" if bad != (rng.random() < 0.05) else "keep") for i, _, _, bad in rows[:600]] + [(1, "unsure"), (None, "remove"), (99_999, "keep")]
    docs = spark.createDataFrame([(i, s, t, 0.5, True) for i, s, t, _ in rows] + [(9000, "s", None, 0.0, False), (9001, "s", "", 0.0, False)], "doc_id long, source string, text string, score double, toxic boolean")
    verdicts = spark.createDataFrame(reviews, "doc_id long, verdict string")
    scored = abuse.score_documents(docs, verdicts)
    found = {r["doc_id"] for r in scored.filter("toxic").collect()}
    truth = {i for i, _, _, bad in rows[600:] if bad}
    hits = len({i for i in found if 600 <= i < 9000} & truth)
    assert hits / len(truth) > 0.95 and hits / len({i for i in found if i >= 600}) > 0.95
    rows_ = {r["doc_id"]: r["score"] for r in scored.filter("doc_id >= 9000").collect()}
    assert rows_ == {9000: -1.0, 9001: -1.0}
    rates = abuse.rates(scored).collect()
    assert sum(r["documents"] for r in rates) == 1502 and {r["source"] for r in rates} == {"s", None}


def test_without_reviews_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "s", "some text here")], "doc_id long, source string, text string")
    none = spark.createDataFrame([], "doc_id long, verdict string")
    assert abuse.score_documents(docs, none).filter("toxic").count() == 0
    assert abuse.score_documents(docs.limit(0), none).count() == 0
    only = spark.createDataFrame([(1, "keep")], "doc_id long, verdict string")
    assert abuse.score_documents(docs, only).filter("toxic").count() == 0


@pytest.mark.parametrize("seed", [1])
def test_copies_count_too(spark, seed):
    rows = corpus(random.Random(seed), 400)
    text = next(t for _, _, t, bad in rows if bad)
    docs = spark.createDataFrame([(i, s, t) for i, s, t, _ in rows] + [(7000 + i, "s", text) for i in range(3)], "doc_id long, source string, text string")
    verdicts = spark.createDataFrame([(i, "remove" if bad else "keep") for i, _, _, bad in rows], "doc_id long, verdict string")
    found = {r["doc_id"] for r in abuse.score_documents(docs, verdicts).filter("toxic").collect()}
    assert {7000, 7001, 7002} <= found


def test_phrases_that_one_review_has(spark):
    """A phrase of a single reviewed document is found in others; an ordinary document judged toxic by mistake makes no report."""
    rng = random.Random(5)
    rows = corpus(rng, 900)
    new = "vous autres ne valez pas mieux que des rats d egout"
    rows += [(2000 + i, "s", f"searching for a red kite takes 3 seconds. {new}. the blue lamp looks fine in the new index", True) for i in range(6)]
    wrong = [i for i, _, _, bad in rows[:900] if not bad][:6]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, source string, text string")
    verdicts = [(i, "remove" if bad or i in wrong else "keep") for i, _, _, bad in rows[:600]] + [(2000, "remove")]
    found = {r["doc_id"] for r in abuse.score_documents(docs, spark.createDataFrame(verdicts, "doc_id long, verdict string")).filter("toxic").collect()}
    assert {2000 + i for i in range(6)} <= found
    assert len({i for i, _, _, bad in rows if not bad} & found) <= 9


def test_texts_of_few_letters():
    assert abuse.windows("死ね") == ["死ね"] and abuse.windows("KYS!") == ["kys"] and abuse.windows("12 !") == []
    assert abuse.windows("ok. this is a longer one") == ["this is a longer one"]
