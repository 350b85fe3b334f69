"""Quality rules: counts by brute force, distances by their definition, and the verdict."""

import collections
import math
import random
import re

import pytest

from ledgerlens.llm import quality

SPACE = r"[^\x20\x09-\x0D]+"


def counts(text):
    w = re.findall(SPACE, text or "")
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(hit))


def test_counts(spark):
    texts = [None, "", " \n\t", "a b c", "a b c a b c", "x " * 40, "one\none\n\n \none", "é# <b> | ü\x0bv\x0cw",
             "a b c d a b c e b c d", "same line here\n" * 30, "  no break", " ".join(map(str, range(30_000)))]
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    got = quality.judge(docs).orderBy("doc_id").collect()
    for r, text in zip(got, texts):
        q = r["quality"]
        want = counts(text)
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == want
        assert q["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert (q["class_distance"] is None) == (want[0] < quality.GUARD_WORDS)
    assert quality.judge(docs.limit(0)).isEmpty()


def shannon(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
    return math.sqrt((part(p, q) + part(q, p)) / 2)


def test_distance_and_verdict(spark):
    name = lambda i, j: chr(97 + i) + chr(97 + j % 26) + chr(97 + j // 26)
    prose = [" ".join(f"the w{name(i, j)} of t{name(i, j)}" for j in range(i + 20)) for i in range(20)]
    junk = " ".join(f"#{i}$%" for i in range(80))
    rows = [(i, t, "en") for i, t in enumerate(prose)] + [(100, junk, "en"), (101, prose[3], None), (102, prose[4], "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["q"] for r in quality.judge(docs, into="q").collect()}

    def classes(t):
        low, space = sum(c.islower() for c in t), sum(c.isspace() for c in t)
        letters, digits = sum(c.isalpha() for c in t) - low, sum(c.isnumeric() for c in t)
        return [low, space, letters, digits, len(t) - low - space - letters - digits]

    whole = [sum(c) for c in zip(*[classes(t) for _, t, lang in rows if lang == "en"])]
    for i, t, lang in rows:
        if lang == "en":
            assert got[i]["class_distance"] == pytest.approx(shannon(classes(t), whole), abs=1e-6)
    assert not got[100]["kept"] and not got[100]["base_failed"]
    assert got[5]["kept"] and got[101]["kept"] and got[102]["kept"]
    assert got[102]["word_distance"] is None and got[5]["word_distance"] is not None


def test_common_words_reject_what_character_classes_do_not(spark):
    word = lambda i: chr(98 + i % 20) + chr(98 + i // 20 % 20) + chr(98 + i // 400) + "en"
    rng = random.Random(5)
    common = {"en": quality.COMMON_WORDS["en"], "de": quality.COMMON_WORDS["de"]}

    def prose(lang, n, share=0.25):
        return [rng.choice(common[lang]) if rng.random() < share else word(rng.randrange(8000)) for _ in range(n)]

    rows = [(lang, i, " ".join(prose(lang, 300)), lang) for lang in common for i in range(30)]
    rows += [
        ("shout", 0, " ".join(f'"{w.capitalize()}",' for w in prose("en", 300)), "en"),
        ("gibberish", 0, " ".join(word(rng.randrange(8000)) for _ in range(300)), "en"),
        ("foreign", 0, " ".join(prose("de", 300)), "en"),
        ("symbols", 0, " ".join(f"{w}#" for w in prose("en", 300)), "en"),
        ("marks", 0, "." * 200_000 + "x " + " ".join(prose("en", 300)), "en"),
    ]
    docs = spark.createDataFrame(rows, "kind string, doc_id int, text string, lang string")
    got = quality.judge(docs, into="q", max_class_distance=1.0).collect()
    kept = {}
    for r in got:
        assert not r["q"]["base_failed"]
        kept.setdefault(r["kind"], set()).add(r["q"]["kept"])
    assert kept == {"en": {True}, "de": {True}, "shout": {True}, "marks": {True},
                    "gibberish": {False}, "foreign": {False}, "symbols": {False}}


@pytest.mark.parametrize("broadcast", [10_000, 100])
def test_every_language_has_its_own_reference(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality, "MAX_BROADCAST_LANGUAGES", broadcast)
    lower, upper = "word " * 60, "WORD " * 60
    rows = [(i, upper if i % 300 == 299 else lower, f"l{i % 300:03}") for i in range(600)]
    rows += [(1000, lower, "l299"), (1001, upper, None), (1002, None, "none"), (1003, "few words", "few")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["q"] for r in quality.judge(docs, into="q").collect()}
    assert len(got) == len(rows)
    for i in range(600):
        if i % 300 < 299:
            assert got[i]["class_distance"] == pytest.approx(0, abs=1e-6)
    whole = [4 * 60, 3 * 60, 4 * 60 * 2, 0, 0]
    assert got[299]["class_distance"] == pytest.approx(shannon([0, 60, 240, 0, 0], whole), abs=1e-6)
    assert got[1000]["class_distance"] == pytest.approx(shannon([240, 60, 0, 0, 0], whole), abs=1e-6)
    assert got[1001]["class_distance"] == pytest.approx(0, abs=1e-6)
    assert got[1002]["class_distance"] is None and got[1003]["class_distance"] is None
