"""Packing: every id once, full windows, target shares in each window."""

from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from ledgerlens.llm import packing
from ledgerlens.llm.tokens import WordEncoder, word_tokenizer_path


def check(pieces, docs, window, keep="doc_id"):
    """The pieces of each document join to its ids; the windows are full and gapless."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer_path())
    want = sorted(
        (i if i is not None else -1, np.array(
            [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
        for i, t in docs)
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[keep] if p[keep] is not None else -1].append(p)
        by_window[p["sequence_id"]].append(p)
    got = []
    for i, own in by_doc.items():
        own.sort(key=lambda p: p["start"])
        got.append((i, b"".join(bytes(p["ids"]) for p in own)))
        assert all(4 * p["length"] == len(p["ids"]) for p in own)
        assert all(p["doc_tokens"] == sum(x["length"] for x in own) for p in own)
    assert sorted(got) == want
    total = sum(len(b) // 4 for _, b in want)
    assert sorted(by_window) == list(range(-(-total // window)))
    for s, own in by_window.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == (window if s < total // window else total % window)
    return by_window, total


@pytest.mark.parametrize("block_chars", [8_000_000, 20_000])
def test_whole_table_without_targets(spark, block_chars):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = packing.pack(
        docs, word_tokenizer_path(), keep=["doc_id", "source"], block_chars=block_chars).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    windows, total = check(pieces, [(r[0], r[1]) for r in rows], 4096)
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p["source"]] += p["length"]
    for s in range(total // 4096):
        for source, n in tokens.items():
            here = sum(p["length"] for p in windows[s] if p["source"] == source)
            assert abs(here - Fraction(4096 * n, total)) < 2


def test_targets_hold_until_a_queue_runs_dry(spark):
    rows = [(i, f"word{i} and some more words to pack " * (1 + i % 5), "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(docs, word_tokenizer_path(), targets={"a": 3.0, "b": 1.0}, window=64,
                          keep=["doc_id", "source"], block_chars=3000).collect()
    windows, _ = check(pieces, [r[:2] for r in rows], 64)
    share = lambda s, x: sum(p["length"] for p in windows[s] if p["source"] == x)
    dry = max(s for s in windows if share(s, "a"))
    for s in range(dry - 1):
        assert abs(share(s, "a") - 3 * share(s, "b")) <= 6
    later = [s for s in windows if dry < s < len(windows) - 1]
    assert later and all(share(s, "b") + share(s, "c") == 64 for s in later)


def test_edge_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, None, None, 1), (2, "", "a", 2), (None, "x y", "a", 3), (4, "same", "b", 4),
            (5, "same", "b", 5), (6, long, None, 6), (7, "ſ İ é 日本 <|endoftext|> it's", "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, length long")
    pieces = packing.pack(docs, word_tokenizer_path(), keep=["doc_id", "length"]).collect()
    assert pieces[0].asDict().keys() >= {"doc_length", "length"}
    check(pieces, [r[:2] for r in rows], 4096)
    assert packing.pack(docs.limit(0), word_tokenizer_path()).count() == 0


def test_encoder_agrees_with_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(word_tokenizer_path()), WordEncoder(word_tokenizer_path())
    texts = ["it's  a\ttest\r\nΣΊΣΥΦΟΣ naïve é ́x", " <|startoftext|>a b<|endoftext|> ", "　全角 1234 !!! "]
    got = own.encode([t.encode() for t in texts], 2)
    assert [list(g) for g in got] == [
        [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_schedule_is_exact_and_monotone():
    for give in ([5000, 1, 0, 9000], [7, 7, 7], [10 ** 13, 3 * 10 ** 12, 5 * 10 ** 12]):
        phase = packing.Phase(0, [0] * len(give), give)
        at = np.unique(np.linspace(0, phase.size, 50).astype(np.int64))
        given = packing.served(phase, at)
        assert (given.sum(axis=1) == at).all() and list(given[-1]) == give
