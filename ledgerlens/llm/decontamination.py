"""Benchmark decontamination: one Aho-Corasick automaton scans every text once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.arrow import add_struct, as_bytes, others, row_type, slices, to_table
from ledgerlens.session import pin

WINDOW_WORDS = 13
# Bytes of windows in one automaton, which takes some sixty times as many; the rest goes to further passes.
AUTOMATON_CHARS = 5_000_000

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])

_WINDOW = row_type(p="binary", n="int", i="string")
# What a pass hands on to the next: the items and the runs of words hit so far.
_HITS = T.StructType([
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("runs", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])

# A-Z become a-z; every other ASCII character but letters and digits separates words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and all characters beyond ASCII."""
    return (text or b"").translate(_FOLD).split()


def windows(text: bytes | None, size: int) -> Iterator[tuple[int, bytes]]:
    """Word count and bytes of each window of an item; a shorter item is one window."""
    w = words(text)
    size = min(size, len(w))
    for i in range(len(w) - size + 1 if w else 0):
        yield size, b" ".join(w[i:i + size])


def build(patterns: list[tuple[bytes, int, list[str]]]):
    """The automaton over ` word word ... `; spaces at both ends keep matches on whole words."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for pattern, size, items in patterns:
        automaton.add_word(f" {pattern.decode('latin-1')} ", (size, items))
    automaton.make_automaton()
    return automaton


def scan(text: bytes | None, automaton) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, a mark per word that lies in an occurrence, and the items that occur."""
    folded = (text or b"").translate(_FOLD)
    line = b" " + b" ".join(folded.split()) + b" "
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    n, items = max(0, len(spaces) - 1) if line != b"  " else 0, set()
    change = np.zeros(n + 1, np.int64)
    if n and len(automaton):
        # One byte is one character here, so offsets in the line are byte offsets.
        for end, (size, owners) in automaton.iter(line.decode("latin-1")):
            last = int(np.searchsorted(spaces, end))
            change[last - size] += 1
            change[last] -= 1
            items.update(owners)
    return n, np.cumsum(change[:n]) > 0, items


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of marked words."""
    edge = np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def original_spans(text: bytes, marks: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of each run of marked words."""
    folded = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate([[False], folded, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first, end_word = runs(marks)
    # Bytes to characters: continuation bytes do not start one.
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[start[a]]), int(chars[end[b]])) for a, b in zip(first, end_word - 1)]


def test_windows(benchmark: DataFrame, item_column: str, text_column: str, size: int) -> DataFrame:
    """p, n, i: each distinct window of the items, its words, and an item that owns it."""
    rows = benchmark.select(
        F.col(f"`{item_column}`").cast("string").alias("i"), F.col(f"`{text_column}`").alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50):
            found = [
                (pattern, n, item)
                for item, text in zip(batch.column("i").to_pylist(), as_bytes(batch.column("t")))
                for n, pattern in windows(text, size)]
            yield from to_table(found, _WINDOW).to_batches()

    return rows.mapInArrow(cut, _WINDOW).distinct()


def patterns(rows: Iterable[Row]) -> list[tuple[bytes, int, list[str]]]:
    """The windows of one part with the items that own them."""
    found: dict[bytes, tuple[int, list[str]]] = {}
    for p, n, i in rows:
        items = found.setdefault(bytes(p), (n, []))[1]
        if i is not None:
            items.append(i)
    return [(p, n, items) for p, (n, items) in found.items()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    into: str = "contamination",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window_words: int = WINDOW_WORDS,
    automaton_chars: int = AUTOMATON_CHARS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add a struct: n_words, n_hit, the sorted items found, and hit spans in the original text.

    Words are lower-cased runs of ASCII letters, digits and characters beyond ASCII. A window is
    `window_words` consecutive words of an item; an item of fewer words is one window, one of none
    has no window. The distinct windows are made and their bytes counted in Spark, and dealt by a
    hash to as many parts as keep each at about half of `automaton_chars`: only one part is ever
    fetched, broadcast and held as an automaton. One part means one scan of the texts; with more,
    each pass adds its hits to those of the passes before, written once in between.

    Null and empty texts have no words and no hits. An item without an id marks words but is not
    listed; items of equal text are all listed; repeated rows give repeated results; no items or
    no rows give no hits or no rows. An input column named as `into` is replaced; other columns
    pass unchanged.
    """
    kept = others(docs.columns if keep is None else keep, into)
    found = pin(test_windows(benchmark, item_column, item_text_column, window_words))
    weight = F.octet_length("p") + F.coalesce(F.octet_length("i"), F.lit(0)) + 2
    total = found.agg(F.sum(weight)).first()[0] or 0
    parts = -(-2 * total // automaton_chars) if total > automaton_chars else 1
    part = F.pmod(F.xxhash64("p", "i"), F.lit(parts))

    names = [f"__c{k}" for k in range(len(kept))]
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)],
                        F.col(f"`{text_column}`").alias("__text"))
    for p in range(parts):
        shared = docs.sparkSession.sparkContext.broadcast(patterns(found.filter(part == p).collect()))
        inputs = ["__text", "__hits"] if p else ["__text"]
        if p < parts - 1:
            given = pin(add_struct(
                given, "__hits", _HITS, _step(shared, False), inputs, [*names, "__text"]))
            shared.unpersist()
        else:
            given = add_struct(given, "__r", RESULT, _step(shared, True), inputs, names)
    return given.select(
        *[F.col(n).alias(c) for c, n in zip(kept, names)], F.col("__r").alias(into))


def _step(shared: Broadcast, last: bool):
    """A pass over the texts with one part's automaton: its hits joined to those found before."""

    def make():
        automaton = build(shared.value)

        def step(batch: pa.RecordBatch) -> list[tuple]:
            out = []
            before = batch.column(1).to_pylist() if batch.num_columns > 1 else [None] * batch.num_rows
            for text, hits in zip(as_bytes(batch.column(0)), before):
                n, marks, items = scan(text, automaton)
                if hits:
                    items.update(hits["items"])
                    for run in hits["runs"]:
                        marks[run["start"]:run["end"]] = True
                if last:
                    spans = original_spans(text, marks) if marks.any() else []
                    out.append((n, int(marks.sum()), sorted(items), spans))
                else:
                    out.append((sorted(items), list(zip(*(x.tolist() for x in runs(marks))))))
            return out

        return step

    return make


def contaminated(into: str = "contamination"):
    """At least a twentieth of the words, and one, lies in occurrences of test windows."""
    hit, n = F.col(f"`{into}`.n_hit"), F.col(f"`{into}`.n_words")
    return (hit > 0) & (20 * hit >= n)
