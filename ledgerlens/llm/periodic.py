"""Periodic runs: stretches of a text that repeat a unit three times or more in a row.

Seeds are occurrence pairs of word k-grams in one document. In a run of period q, at least
max(24 - q, 2q) words in a row equal the word q further on, so a run of a period up to 16 holds
pairs of equal 16-grams at lag q, and one of a period in (k/2, k] pairs of equal k-grams. Such a
k-gram is no shorter than the period, so inside the run its next occurrence lies exactly one
smallest period on: of all pairs those of neighbouring occurrences are enough, one per place and
level, however often a k-gram occurs. A seed is extended along its diagonal in both directions, and a
table of the furthest place covered per lag keeps later seeds of the run from being extended again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens.llm.arrow import add_struct, as_bytes
from ledgerlens.llm.messages import mix

SEED_WORDS = 16
MIN_WORDS = 24
MIN_PERIODS = 3
_ODD, _TEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("runs", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("period", T.LongType())]))),
])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _neighbours(places: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of next occurrences of one k-gram, and whether each place's k-gram occurs again."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return places[order[:-1][same]], places[order[1:][same]], again


def seeds(line: np.ndarray, text: np.ndarray, ends: np.ndarray):
    """(k, first places, lags) of each level of k-grams; line holds the words of all texts."""
    with np.errstate(over="ignore"):
        key = mix(line.astype(np.uint64) * _ODD + text.astype(np.uint64) * _TEXT)
        k = 1
        while k < SEED_WORDS:
            key = mix(key[:max(len(key) - k, 0)] * _ODD + key[k:])
            k *= 2
        left = ends[text] - np.arange(len(line))
        places = np.flatnonzero(left >= k)
        key = key[places]
        while len(places):
            first, second, again = _neighbours(places, key)
            lag = second - first
            near = (lag <= k) & ((lag > k // 2) | (k == SEED_WORDS))
            yield k, first[near], lag[near]
            # A repeated 2k-gram begins and ends with repeated k-grams.
            places, key = places[again], key[again]
            at = np.searchsorted(places, places + k)
            on = np.flatnonzero(at < len(places))
            on = on[(places[at[on]] == places[on] + k) & (left[places[on]] >= 2 * k)]
            key = mix(key[on] * _ODD + key[at[on]])
            places, k = places[on], 2 * k


def runs_of(line: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list]:
    """(start, length, period) of all runs of each text, by start and period."""
    found: list[list] = [[] for _ in starts]
    for k, first, lag in seeds(line, text, ends):
        order = np.lexsort((first, lag))
        first, lag = first[order], lag[order]
        # Seeds in a row on one diagonal are one stretch.
        new = np.flatnonzero((np.diff(first, prepend=-2) != 1) | (np.diff(lag, prepend=0) != 0))
        last = first[np.append(new[1:], len(first)) - 1] if len(new) else first
        covered: dict[int, int] = {}
        for i, j, q in zip(first[new].tolist(), last.tolist(), lag[new].tolist()):
            if i < covered.get(q, 0):
                continue
            own = text[i]
            begin, stop = starts[own], ends[own] - q
            x, y = i, j + k
            while x > begin and line[x - 1] == line[x - 1 + q]:
                x -= 1
            while y < stop and line[y] == line[y + q]:
                y += 1
            covered[q] = y
            if y + q - x >= max(MIN_WORDS, MIN_PERIODS * q):
                found[own].append((int(x - begin), int(y + q - x), q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in found]


def _collapse(text: bytes | None, words: list[bytes], runs: list[tuple]) -> tuple:
    if text is None:
        return 0, None, []
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    gone = np.cumsum(dropped)[:-1] > 0
    kept = [w for w, g in zip(words, gone.tolist()) if not g] if runs else words
    return len(words), b" ".join(kept).decode(), runs


def find_runs(
    docs: DataFrame, into: str = "periodic", text_column: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add a struct: n_words, all runs of the text, and the text with each run cut to one period.

    Words lie between ASCII white space and are compared as they are. A run is a stretch of words of
    smallest period q, of at least 24 words and three periods, that no neighbouring word extends;
    start, length and period count words. Words after the first q of any run go from the text,
    whose other words are joined by one space.

    A null text has no words and no runs and stays null; an empty one stays empty; runs may
    overlap; each row is judged alone, so ids, ties and repeated rows do not matter; very long texts
    are searched whole; an empty table stays empty. An input column named as `into` is replaced,
    others pass unchanged.
    """
    def make():
        def step(batch: pa.RecordBatch) -> list[tuple]:
            texts = as_bytes(batch.column(0))
            words = [(t or b"").split() for t in texts]
            lengths = np.array([len(w) for w in words], np.int64)
            number = _Numbers()
            line = np.fromiter((number[w] for own in words for w in own), np.int64, lengths.sum())
            ends = np.cumsum(lengths)
            text = np.repeat(np.arange(len(words)), lengths)
            return [_collapse(*x) for x in zip(
                texts, words, runs_of(line, text, ends - lengths, ends))]

        return step

    return add_struct(docs, into, RESULT, make, [text_column], keep)
