"""Substring dedup against windows counted in a dictionary."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import substrings
from ledgerlens.llm.automaton import SuffixAutomaton


def brute(texts, window):
    lines = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i:i + window]) for w in lines for i in range(len(w) - window + 1))
    for w in lines:
        hit = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i:i + window])] > 1:
                hit.update(range(i, i + window))
        yield len(w), len(hit), [x.decode() for i, x in enumerate(w) if i not in hit]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    some = lambda n: [word() for _ in range(n)]
    passages = [some(n) for n in (34, 35, 36, 50, 90, 200)]
    docs = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice([some(rng.randint(0, 60)), rng.choice(passages)])
        docs.append(parts)
    for _ in range(60):  # near copies, and repeats inside one text
        d = list(rng.choice(docs))
        if d:
            d[rng.randrange(len(d))] = "new"
        docs.append(d + (d if rng.random() < 0.2 else []))
    docs += [["x"] * 100, ["x", "y"] * 40, ["x"] * 34]
    seps = [" ", "\n", "\t", "  ", " z "]
    return ["".join(w + rng.choice(seps) for w in d) for d in docs] + [None, "", " \n ", "é " * 40]


@pytest.mark.parametrize("seed,chars,limit,fan", [
    (1, 10 ** 7, 64, 256), (2, 3000, 64, 256), (3, 5000, 2, 3), (4, 10 ** 6, 1, 256), (5, 9000, 64, 2)])
def test_same_as_brute_force(spark, seed, chars, limit, fan):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substrings.remove_repeats(
        df, block_chars=chars, shard_fragments=limit, fan=fan).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    for r, text, (n, removed, kept) in zip(got, texts, brute(texts, 35)):
        d = r["dedup"]
        assert (d["n_words"], d["n_removed"]) == (n, removed)
        assert (d["text"] or "").encode().split() == [k.encode() for k in kept]
        assert (d["text"] is None) == (text is None)
        rest, at = [], 0
        for s in d["spans"]:
            rest.append((text or "")[at:s["start"]])
            at = s["end"]
        assert "".join(rest) + (text or "")[at:] == (d["text"] or "")


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, None, 1), (None, "a", 1), (1, long, 2), (2, "z " + long, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, dedup int")
    got = sorted((r["doc_id"] or 0, r["dedup"]["n_words"], r["dedup"]["n_removed"])
                 for r in substrings.remove_repeats(df).collect())
    assert got == [(0, 0, 0), (0, 1, 0), (1, 60_000, 60_000), (2, 60_001, 60_000)]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_automaton_counts_places():
    rng = random.Random(5)
    lines = [[rng.choice("ab") for _ in range(rng.randint(0, 12))] for _ in range(30)]
    automaton = SuffixAutomaton()
    for line in lines:
        automaton.add(line)
    automaton.count()
    counts = Counter(
        tuple(x[i:j]) for x in lines for i in range(len(x)) for j in range(i + 1, len(x) + 1))
    for line in [*lines, list("abcab")]:
        want = [max((n for n in range(i + 2) if n == 0 or counts[tuple(line[i + 1 - n:i + 1])] > 1))
                for i in range(len(line))]
        assert automaton.repeated(line) == want


def test_least_of_neighbours():
    rng = np.random.default_rng(7)
    for n, width in ((1, 1), (30, 28), (28, 28), (500, 1), (500, 7), (500, 28), (500, 64)):
        for high in (2, 5, 2 ** 63):
            values = rng.integers(0, high, n).astype(np.uint64)
            view = np.lib.stride_tricks.sliding_window_view(values, width)
            want = view.argmin(axis=1) + np.arange(n - width + 1)
            assert (substrings.first_least(values, width) == want).all()


def test_memory_of_a_block_is_a_few_arrays_of_its_words():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(500)).encode() for _ in range(400)]
    tracemalloc.start()
    found = substrings.Fragments(texts, 35, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The places of all windows' short sequences in one array would be 28 * 8 bytes a word.
    assert len(found.first) and peak < 200 * found.lengths.sum()
