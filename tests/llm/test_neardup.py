"""Near-duplicates against all pairs compared by brute force."""

import random

import numpy as np
import pytest

from ledgerlens.llm import neardup, tokens


def brute(docs, size):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def texts(seed):
    """Chains of edits, so that a group's ends are far apart, among unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for length in (1, 2, 3, 4, 5, 6, 8, 12, 30, 80, 200):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(12):
            out.append(" ".join(base))
            for _ in range(rng.randint(0, max(1, length // 25))):
                base[rng.randrange(length)] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base.append(rng.choice(vocabulary))
                length += 1
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("size,cell", [(2, 400_000), (5, 50)])
def test_same_groups_as_brute_force(spark, monkeypatch, size, cell):
    monkeypatch.setattr(neardup, "CELL_SHINGLES", cell)
    docs = texts(size)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in neardup.find_groups(df, shingle_words=size).collect()}
    assert got == brute(docs, size)


def test_edge_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \t", 0), (4, "One", 0), (5, "one", 0), (5, "one", 0),
            (None, "one", 0), (7, "a b " * 30_000, 0), (8, "a b " * 30_001, 0), (None, "alone here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted(map(tuple, neardup.find_groups(df, shingle_words=2).collect()), key=repr)
    assert got == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
        (5, 1, 4, False), (None, 1, 4, False), (7, 2, 7, True), (8, 2, 7, False),
        (None, 1, None, True)], key=repr)
    assert neardup.find_groups(df.limit(0)).count() == 0


def test_registers_and_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2 ** 63, 5000, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:4500], rng.integers(0, 2 ** 63, 500, dtype=np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    guess, filled = neardup.estimate(neardup.registers(a), neardup.registers(b), len(a), len(b))
    assert filled == 128 and abs(guess - true) < 0.15
    assert neardup.registers(a).min() > 0 and neardup.registers(a[:0]).max() == 0
    assert neardup.promising(0.8, 128, 80) and not neardup.promising(0.3, 128, 80)


def test_sets_are_made_without_the_words_of_an_encoder():
    tokens.encoder(tokens.word_tokenizer_path()).encode([b"some words"], 2)
    assert len(list(neardup.shingle_sets([b"a b c", None], 2))) == 2
    assert not tokens._ENCODERS
