"""Language-model scoring: a weighted backoff automaton walked once, left to right, per text.

Counts cover the whole corpus and are never in one place. A block of documents asks the owners of
its n-grams for their counts in all training texts (see `routing`), and builds the part of the
automaton that its texts can reach: a state per known context, an arc per seen n-gram, and a
failure arc to the next shorter context. A task thus holds one block's automaton, of bounded size.

Smoothing: p(w | h) = (c(hw) + mass * p(w | shorter h)) / (c(h) + mass), the Dirichlet prior of
MacKay and Peto; so a seen n-gram's arc has that weight, and the failure arc mass / (c(h) + mass).
Single words use absolute discounting; what it frees is the probability of an unknown word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import messages
from ledgerlens.llm.arrow import as_bytes, row_type, slices, to_table
from ledgerlens.llm.blocks import block_of, count_blocks
from ledgerlens.llm.routing import FAN, MESSAGE, Kind, Tree, answers_to, gather

ORDER = 2
PRIOR_MASS = 100.0
# Pseudo-count of the base score.
BASE_ADD = 0.1

# What is asked of each n-gram: the sum of its counts in all blocks.
COUNTS = Kind()
_NUMBERS = row_type(n_tokens="long", n_known="long", base_score="double", score="double")
# A block and its automaton take some forty times this many bytes.
BLOCK_CHARS = 5_000_000
BEGIN, END = 0, 1


@dataclass(frozen=True)
class Corpus:
    """Token statistics of the training texts: tokens, distinct, seen once, seen twice."""

    tokens: int
    distinct: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return (self.once + 1) / (self.once + 2 * self.twice + 2)

    def word(self, counts: np.ndarray) -> np.ndarray:
        """Probability of known words with these counts."""
        return (counts - self.discount) / max(self.tokens, 1)

    @property
    def unknown(self) -> float:
        return self.discount * self.distinct / self.tokens if self.tokens else 1.0

    def base(self, counts: np.ndarray) -> np.ndarray:
        whole = self.tokens + BASE_ADD * (self.distinct + 1)
        return np.log10((counts + BASE_ADD) / whole)


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; the end follows by itself."""
    return (text or b"").lower().split()


def corpus_statistics(df: DataFrame) -> Corpus:
    """Statistics over df(__train, __text); words are counted per task, then by hash."""

    def count(batches):
        for batch in slices(batches, 5000):
            found: Counter = Counter()
            for text, learn in zip(as_bytes(batch.column("__text")), batch.column("__train").to_pylist()):
                if learn:
                    found.update(tokens(text))
                    found[b" "] += 1  # the end; no word holds a space
            keys = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(list(found.values()), pa.int64())],
                names=["k", "n"])

    words = df.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    r = words.agg(
        F.sum("n").alias("t"), F.count(F.lit(1)).alias("d"),
        F.count_if(F.col("n") == 1).alias("o"), F.count_if(F.col("n") == 2).alias("w")).first()
    return Corpus(r["t"] or 0, r["d"], r["o"], r["w"])


class _Numbers(dict):
    """Numbers for words, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Grams:
    """The distinct n-grams of a block, numbered per order, with their keys.

    order k has: prefix and last (the gram is prefix + last), suffix (without its first token),
    key, and of each token of the block the gram that ends there (-1 if the text begins later).
    """

    def __init__(self, texts: Sequence[bytes | None], order: int) -> None:
        number = _Numbers({b" begin": BEGIN, b" end": END})
        lines = []
        for text in texts:
            words = tokens(text)
            lines.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        self.size = len(number)
        self.lengths = np.array([len(x) + 2 for x in lines], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.line = np.full(int(self.lengths.sum()), END, np.int64)
        for at, own in zip(self.starts, lines):
            self.line[at] = BEGIN
            self.line[at + 1:at + 1 + len(own)] = own
        word_keys = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        self.key = [messages.mix(word_keys)]
        self.prefix, self.last, self.suffix = [None], [np.arange(self.size)], [None]
        self.at = [self.line]
        age = np.arange(len(self.line)) - np.repeat(self.starts, self.lengths)
        for k in range(1, order):
            ends = np.flatnonzero(age >= k)
            both = self.at[-1][ends - 1] * self.size + self.line[ends]
            grams, first, inverse = np.unique(both, return_index=True, return_inverse=True)
            at = np.full(len(self.line), -1, np.int64)
            at[ends] = inverse
            self.prefix.append(grams // self.size)
            self.last.append(grams % self.size)
            self.suffix.append(self.at[-1][ends[first]])
            self.key.append(messages.chain(self.key[-1][self.prefix[-1]], word_keys[self.last[-1]]))
            self.at.append(at)

    def counts(self, k: int, learn: np.ndarray) -> np.ndarray:
        """Occurrences of each gram of order k + 1 in the texts marked to learn from."""
        own = self.at[k][np.repeat(learn, self.lengths)]
        return np.bincount(own[own >= 0], minlength=len(self.key[k]))


def ask(grams: Grams, learn: np.ndarray, block: int, tree: Tree) -> pa.Table:
    rows: list[tuple] = []
    for k, keys in enumerate(grams.key):
        order = np.argsort(keys, kind="stable")
        rows += tree.send(0, block, k, COUNTS, keys[order], grams.counts(k, learn)[order])
    return to_table(rows, MESSAGE)


def totals_of(grams: Grams, answers: list[dict]) -> list[np.ndarray]:
    """Per order the total count of each gram, from the block's answers."""
    out = []
    for k, keys in enumerate(grams.key):
        totals = np.empty(len(keys), np.float64)
        totals[np.argsort(keys, kind="stable")] = gather(answers, k, np.uint64)
        out.append(totals)
    return out


class Automaton:
    """States are known contexts, numbered from 1; state 0 is the empty context.

    arcs[state * size + token] is an arc number; weight and target give its log10 probability and
    the state it leads to; failure and penalty give each state's failure arc.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], corpus: Corpus, mass: float) -> None:
        self.size, self.unknown = grams.size, math.log10(corpus.unknown)
        order = len(grams.key)
        chance, states = [], []
        n_states, arcs, weights, targets = 1, [], [], []
        failure, penalty = [np.zeros(1, np.int64)], [np.zeros(1)]
        for k in range(order):
            count = totals[k]
            seen = count > 0
            if k == 0:
                seen[BEGIN] = False
                p = corpus.word(count)
            else:
                given = totals[k - 1][grams.prefix[k]]
                p = (count + mass * chance[-1][grams.suffix[k]]) / (given + mass)
            known = np.flatnonzero(count > 0)
            if k < order - 1:  # known grams that can be followed are states
                state = np.zeros(len(count), np.int64)
                open_end = known[grams.last[k][known] != END]
                state[open_end] = n_states + np.arange(len(open_end))
                n_states += len(open_end)
                failure.append(states[-1][grams.suffix[k][open_end]] if k
                               else np.zeros(len(open_end), np.int64))
                penalty.append(np.log10(mass / (count[open_end] + mass)))
                target = state
            else:
                target = states[-1][grams.suffix[k]] if k else np.zeros(len(count), np.int64)
            seen = np.flatnonzero(seen)
            source = states[-1][grams.prefix[k][seen]] if k else np.zeros(len(seen), np.int64)
            arcs.append(source * grams.size + grams.last[k][seen])
            weights.append(np.log10(p[seen]))
            targets.append(target[seen])
            chance.append(p)
            if k < order - 1:
                states.append(state)
        self.begin = int(states[0][BEGIN]) if states else 0
        keys = np.concatenate(arcs).tolist()
        self.arcs = dict(zip(keys, range(len(keys))))
        self.weight = np.concatenate(weights).tolist()
        self.target = np.concatenate(targets).tolist()
        self.failure = np.concatenate(failure).tolist()
        self.penalty = np.concatenate(penalty).tolist()

    def walk(self, line: list[int]) -> float:
        """Log10 probability of a text's tokens, its end included."""
        arcs, weight, target = self.arcs.get, self.weight, self.target
        failure, penalty, size = self.failure, self.penalty, self.size
        state, total = self.begin, 0.0
        for token in line:
            arc = arcs(state * size + token)
            while arc is None:
                if not state:
                    total += self.unknown
                    break
                total += penalty[state]
                state = failure[state]
                arc = arcs(state * size + token)
            else:
                total += weight[arc]
                state = target[arc]
        return total


def score_block(
    texts: Sequence[bytes | None], answers: list[dict], corpus: Corpus, order: int, mass: float
) -> Iterator[tuple]:
    """n_tokens, n_known, base_score and score of each text."""
    grams = Grams(texts, order)
    totals = totals_of(grams, answers)
    automaton = Automaton(grams, totals, corpus, mass)
    count, base = totals[0], corpus.base(totals[0])
    for at, n in zip(grams.starts, grams.lengths):
        line = grams.line[at + 1:at + n]
        yield (int(n - 1), int((count[line] > 0).sum()), float(base[line].sum()),
               automaton.walk(line.tolist()))


def score(
    docs: DataFrame,
    train: Column,
    into: str = "lm",
    text_column: str = "text",
    keep: Sequence[str] = ("doc_id",),
    order: int = ORDER,
    mass: float = PRIOR_MASS,
    block_chars: int = BLOCK_CHARS,
    fan: int = FAN,
) -> DataFrame:
    """Add a struct to the columns of `keep`: the model's and the base log10 probability of a text.

    The model learns from all rows where `train` is true; every row is scored, whole. Fields:
    n_tokens (with the end), n_known (of those seen in training), train_tokens, base_score (single
    words with a tenth added to each count) and score. A null or empty text is the end alone; a
    null `train` does not learn; repeated rows are counted and scored each; without any training
    text all is unknown; an empty table stays empty. An input column named as `into` is replaced,
    others pass unchanged.
    """
    keep = [c for c in keep if c.lower() != into.lower()]
    blocks = count_blocks(docs, text_column, block_chars)
    tree = Tree.over(blocks, fan)
    hashed = list(dict.fromkeys([*keep, text_column]))
    given = docs.select(
        block_of(hashed, blocks).cast("long").alias("__block"),
        F.coalesce(train, F.lit(False)).alias("__train"),
        F.col(f"`{text_column}`").alias("__text"),
        *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)])
    corpus = corpus_statistics(given.select("__train", "__text"))

    # The same exchange of texts serves the questions and the scoring.
    placed = given.repartition(blocks, "__block")
    fields = placed.select([f"__k{i}" for i in range(len(keep))]).schema.fields
    schema = T.StructType([*fields, *_NUMBERS.fields])
    names, width = schema.names, len(keep)

    def send(key, block):
        learn = np.array(block["__train"].to_pylist(), bool)
        return ask(Grams(as_bytes(block["__text"]), order), learn, key[0].as_py(), tree)

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        scored = score_block(as_bytes(block["__text"]), answers.to_pylist(), corpus, order, mass)
        numbers = to_table(list(scored), _NUMBERS)
        return pa.table(
            [*[block[f"__k{i}"] for i in range(width)], *numbers.columns], names=names)

    asked = placed.groupBy("__block").applyInArrow(send, MESSAGE)
    answers = answers_to(asked, tree, dict.fromkeys(range(order), COUNTS))
    scored = placed.groupBy("__block").cogroup(answers.groupBy("__to")).applyInArrow(finish, schema)
    result = F.struct("n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"),
                      "base_score", "score")
    return scored.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], result.alias(into))
