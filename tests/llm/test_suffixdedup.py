"""Suffix-array dedup against windows kept in a dictionary."""

import random

import numpy as np
import pytest

from ledgerlens.llm import suffixdedup
from ledgerlens.llm.suffixsort import SuffixArray


def brute(rows, window):
    """{id: (n_bytes, spans, kept)} of rows with distinct ids."""
    first, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data, gone = (text or "").encode(), set()
        for i in range(len(data) - window + 1):
            if first.setdefault(data[i:i + window], (doc_id, i)) != (doc_id, i):
                gone.update(range(i, i + window))
        spans = [i for i in gone if i - 1 not in gone]
        out[doc_id] = (len(data), len(gone), len(spans),
                       bytes(b for i, b in enumerate(data) if i not in gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdefgh é\0\n") for _ in range(n))
    passages = [some(n) for n in (60, 98, 99, 100, 101, 150, 300)]
    docs = []
    for _ in range(150):
        docs.append("".join(
            rng.choice([some(rng.randint(0, 120)), rng.choice(passages)]) for _ in range(rng.randint(1, 4))))
    docs += [rng.choice(docs) for _ in range(40)]
    docs += ["x" * 99, "x" * 100, "x" * 350, "x" * 500 + "y", "\0" * 300, "\0" * 200 + "a", "ab" * 200,
             "ba" * 100, "é" * 120, None, "", "z", "xy" * 60 + "x" * 130 + "\0"]
    docs += [docs[0] + docs[1], "a" + docs[1][1:] + "x" * 120]
    ids = rng.sample(range(-500, 10 ** 10), len(docs))
    return list(zip(ids, docs))


@pytest.mark.parametrize("seed,block,shard,places", [
    (1, 10 ** 7, 10 ** 7, 4096), (2, 3000, 5000, 4096), (3, 4000, 9000, 3), (4, 10 ** 6, 2000, 1)])
def test_same_as_brute_force(spark, seed, block, shard, places):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixdedup.remove_earlier_bytes(
        df, block_bytes=block, shard_bytes=shard, shard_places=places).collect()
    assert len(got) == len(rows)
    want = brute(rows, 100)
    for r in got:
        d = r["dedup"]
        assert (d["n_bytes"], d["n_removed"], d["n_spans"], bytes(d["kept"])) == want[r["doc_id"]]
        data, at, rest = (r["text"] or "").encode(), 0, b""
        for s in d["spans"]:
            rest, at = rest + data[at:s["start"]], s["end"]
        assert rest + data[at:] == bytes(d["kept"])


def test_edge_rows(spark):
    long = "".join(f"w{i} " for i in range(60_000))
    rows = [(None, None, 1), (None, long, 1), (7, long, 2), (7, long, 2), (3, "q" + long, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, dedup int")
    got = sorted((r["doc_id"] or 0, r["dedup"]["n_bytes"], r["dedup"]["n_removed"])
                 for r in suffixdedup.remove_earlier_bytes(df).collect())
    n = len(long)
    assert got == [(0, 0, 0), (0, n, 0), (3, n + 1, n), (7, n, n), (7, n, n)]
    alone = suffixdedup.remove_earlier_bytes(df.filter("doc_id = 7")).collect()
    assert sorted(r["dedup"]["n_removed"] for r in alone) == [0, n]
    assert suffixdedup.remove_earlier_bytes(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_order_and_common_bytes(seed):
    rng = random.Random(seed)
    depth = rng.choice([4, 8, 20])
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(depth, 40)))
             for _ in range(rng.randint(1, 30))] + [b"a" * 40, b"\0" * 30]
    wanted = np.array([rng.randint(1, len(t) - depth + 1) for t in texts])
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = SuffixArray(data, np.cumsum(lengths) - lengths, lengths, wanted, depth)
    windows = [texts[t][p - got.starts[t]:][:depth] for p, t in zip(got.order, got.text)]
    assert windows == sorted(t[i:i + depth] for t, w in zip(texts, wanted) for i in range(w))
    assert len(set(got.order.tolist())) == wanted.sum()
    common = [next((i for i in range(depth) if a[i] != b[i]), depth)
              for a, b in zip(windows, windows[1:])]
    assert got.common[1:].tolist() == common
