"""Periodic runs against a search of every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from ledgerlens.llm import periodic, queries


def brute(words):
    """All (start, length, period) of runs: maximal stretches of their smallest period."""
    found, n = [], len(words)
    for q in range(1, n // 3 + 1):
        x = 0
        while x + q < n:
            y = x
            while y + q < n and words[y] == words[y + q]:
                y += 1
            stretch = words[x:y + q]
            if len(stretch) >= max(24, 3 * q) and not any(
                    stretch[d:] == stretch[:-d] for d in range(1, q)):
                found.append((x, len(stretch), q))
            x = y + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts_of(seed):
    rng = random.Random(seed)
    some = lambda n, of: [rng.choice(of) for _ in range(n)]
    out = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            of = rng.choice(["ab", "abcd", [f"w{i}" for i in range(300)]])
            unit = some(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40, 70]), of)
            whole = unit * rng.choice([1, 2, 3, 4, 9, 24])
            words += whole[:len(whole) - rng.randint(0, len(unit))] + some(rng.randint(0, 20), of)
        out.append(words)
    part = some(40, "ab")  # a unit that holds equal parts itself
    out += [(part + part + some(5, "ab")) * 4, ["x"] * 23, ["x"] * 24, ["x"] * 300, ["x", "y"] * 12,
            ["x", "y"] * 11 + ["x"], some(2000, "ab"), some(500, "a") + ["b"] + some(500, "a")]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = texts_of(seed)
    texts = ["".join(w + rng.choice([" ", "\n", "\t", "  "]) for w in words) for words in lines]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["periodic"] for r in periodic.find_runs(df).collect()}
    assert len(got) == len(texts)
    for i, words in enumerate(lines):
        runs = brute(words)
        assert [tuple(r) for r in got[i]["runs"]] == runs, i
        assert got[i]["n_words"] == len(words)
        assert got[i]["text"] == collapse(words, runs)


def test_edge_rows(spark):
    long = " ".join([f"w{i}" for i in range(30_000)] * 4)
    rows = [(1, None, "a"), (1, "", "b"), (None, long, "c"), (None, " \n", None), (2, "é " * 30, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Periodic string")
    got = {r["text"]: r["periodic"] for r in periodic.find_runs(df).collect()}
    assert [(t, x["n_words"], x["text"], [tuple(r) for r in x["runs"]]) for t, x in got.items()
            if t != long] == [
        (None, 0, None, []), ("", 0, "", []), (" \n", 0, "", []), ("é " * 30, 30, "é", [(0, 30, 1)])]
    assert [tuple(r) for r in got[long]["runs"]] == [(0, 120_000, 30_000)]
    assert got[long]["text"] == " ".join(f"w{i}" for i in range(30_000))
    assert periodic.find_runs(df.limit(0)).count() == 0
    named = df.withColumnRenamed("text", "body")
    assert periodic.find_runs(named, text_column="body", keep=["body"]).count() == 5


def test_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i * 37, " ".join(rng.choice(["a", "b", f"w{j}"]) for j in range(rng.randint(0, 90))))
            for i in range(120)] + [(None, "a " * 50), (5, None)]
    rows += [(i, "same " * 40) for i in range(10 ** 9, 10 ** 9 + 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12(spark, str(tmp_path)).collect()}
    planted = 0
    for doc_id, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r["collapsed_sha256"] == sha(collapse(words, runs))
    assert planted > 5
