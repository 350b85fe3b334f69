"""Language model: counts and probabilities against a plain model in memory."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlens.llm import scoring
from pyspark.sql import functions as F


def plain_model(docs, order, mass):
    """log10 probability per text by recursion over counts held in dictionaries."""
    lines = [(learn, ["<s>", *t.lower().split(), "</s>"]) for learn, t in docs]
    counts = defaultdict(Counter)
    for learn, line in lines:
        if learn:
            for k in range(order):
                for i in range(k, len(line)):
                    counts[k][tuple(line[i - k:i + 1])] += 1
    words = {w: c for (w,), c in counts[0].items() if w != "<s>"}
    n, once, twice = sum(words.values()), *(sum(c == x for c in words.values()) for x in (1, 2))
    d = (once + 1) / (once + 2 * twice + 2)

    def p(context, w):
        if not context:
            return (words[w] - d) / n if w in words else (d * len(words) / n if n else 1.0)
        shorter = p(context[1:], w)
        given = counts[len(context) - 1][context]
        return (counts[len(context)][(*context, w)] + mass * shorter) / (given + mass)

    for learn, line in lines:
        own = line[1:]
        base = sum(math.log10((words.get(w, 0) + 0.1) / (n + 0.1 * (len(words) + 1))) for w in own)
        total = sum(math.log10(p(tuple(line[max(0, i - order + 1):i]), line[i]))
                    for i in range(1, len(line)))
        yield len(own), sum(w in words for w in own), n, base, total


DOCS = [(True, "The cat sat on the mat"), (True, "the cat ate THE rat the end"), (False, "the cat flew"),
        (True, ""), (False, "unseen words only here"), (True, "the cat sat on the mat"), (False, "")]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("chars,fan", [(20, 2), (20, 256), (10_000, 256)])
def test_same_as_a_plain_model(spark, order, chars, fan):
    rows = [(i, t, learn) for i, (learn, t) in enumerate(DOCS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = scoring.score(docs, F.col("learn"), order=order, mass=3.0, block_chars=chars, fan=fan).select(
        "doc_id", "lm.*").orderBy("doc_id").collect()
    want = list(plain_model(DOCS, order, 3.0))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == w[:3]
        assert g["base_score"] == pytest.approx(w[3]) and g["score"] == pytest.approx(w[4])


def test_probabilities_sum_to_one():
    corpus = scoring.Corpus(tokens=10, distinct=4, once=2, twice=1)
    assert corpus.word(np.array([1, 1, 2, 6])).sum() + corpus.unknown == pytest.approx(1)


def test_edge_rows(spark):
    rows = [(None, None, 1), (1, "a b", 2), (1, "a b", 2), (2, "x " * 50_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lm int")
    got = scoring.score(docs, F.col("doc_id") == 1, keep=["doc_id", "lm"]).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["lm"]["n_tokens"]) for r in got] == [(None, 1), (1, 3), (1, 3), (2, 50_001)]
    assert got[0]["lm"]["train_tokens"] == 6
    assert scoring.score(docs.limit(0), F.lit(True)).count() == 0
    none = scoring.score(docs, F.lit(None).cast("boolean")).select("lm.*").collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in none)
