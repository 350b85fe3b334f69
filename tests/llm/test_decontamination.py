"""Decontamination against every window compared by brute force."""

import random
import re

import pytest

from ledgerlens.llm import decontamination


def words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded)


def brute(text, items, size):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(own) - n + 1):
                if own[j:j + n] == w[i:i + n]:
                    hit.update(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
    return len(own), len(hit), sorted(found), [own[i] for i in sorted(hit)]


@pytest.mark.parametrize("chars", [10 ** 7, 60])
def test_same_as_brute_force(spark, chars):
    rng = random.Random(4)
    word = lambda: rng.choice(["Ab", "é", "x1", "of", "日本", "THE"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 6, 9, 1, 0, 5])]
    items += [(7, None), (None, "only hits no name"), (3, items[3][1])]
    texts = ["", None, "a-b", "  ", "THE", "x1é x1 é", items[3][1].upper() + "!"]
    for _ in range(60):
        parts = [word() for _ in range(rng.randrange(30))]
        if rng.random() < 0.5:
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = (rng.choice(items)[1] or "").split()
        texts.append(rng.choice([" ", ", ", "\n- ", "\t"]).join(parts))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, c int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(
        docs, bench, into="c", window_words=5, automaton_chars=chars).orderBy("doc_id").collect()
    for r, text in zip(got, texts):
        n, hit, found, hit_words = brute(text, items, 5)
        c = r["c"]
        assert (c["n_words"], c["n_hit"], c["items"]) == (n, hit, found)
        assert [w for s in c["spans"] for w in words(text[s["start"]:s["end"]])] == hit_words
    assert decontamination.find_contamination(docs, bench.limit(0), into="c").filter("c.n_hit > 0").isEmpty()
    assert decontamination.find_contamination(docs.limit(0), bench, into="c").isEmpty()


def test_same_in_one_pass_and_in_many(spark):
    rng = random.Random(8)
    items = [(i % 7, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for i in range(12)]
    long = " ".join(rng.choice("abcd") for _ in range(200_000))
    texts = [long, long, None, "", *(long[at:at + 60] for at in range(0, 4000, 300))]
    docs = spark.createDataFrame(
        [(i, t, "x", 1, 2) for i, t in enumerate(texts)],
        "doc_id long, text string, __text string, __hits int, __c0 int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    once, often = (
        decontamination.find_contamination(docs, bench, into="TEXT", window_words=3, automaton_chars=c)
        .orderBy("doc_id").collect() for c in (10 ** 6, 40))
    assert once == often and len(once) == len(texts)
    assert once[0].asDict().keys() == {"doc_id", "__text", "__hits", "__c0", "TEXT"}
    assert once[0]["TEXT"]["n_words"] == 200_000 and once[0]["TEXT"]["n_hit"] > 1000
    assert once[0]["TEXT"] == once[1]["TEXT"]


def test_no_more_than_a_part_is_fetched(spark):
    bench = spark.createDataFrame(
        [(i, f"{'same words of a hot window' if i % 2 else f'w{i} x{i} y{i} z{i}'}") for i in range(900)],
        "item_id long, text string")
    docs = spark.createDataFrame([(1, "the same words of a hot window here"), (2, "w4 x4 y4 z4")],
                                 "doc_id long, text string")
    fetched, patterns = [], decontamination.patterns
    decontamination.patterns = lambda rows: fetched.append(len(rows)) or patterns(rows)
    try:
        got = decontamination.find_contamination(
            docs, bench, into="c", window_words=4, automaton_chars=8000).orderBy("doc_id").collect()
    finally:
        decontamination.patterns = patterns
    assert len(fetched) > 3 and max(fetched) < 500 and sum(fetched) > 900
    assert len(got[0]["c"]["items"]) == 450 and got[0]["c"]["n_hit"] == 6
    assert got[1]["c"]["items"] == ["4"]
