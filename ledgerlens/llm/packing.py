"""Mixture-controlled packing: every window takes from each source's queue its share of tokens.

The schedule is a deficit round-robin in closed form. Each window gives every queue credit in
proportion to its target; a queue is served its whole tokens, and the tokens left in the window go
to the queues with the largest credit left, the deficit, which the next window starts from. After
any number of windows a queue has thus been served its exact share, rounded; so a task can work out
the state at any window without those before it, and deficits carry over windows, blocks and
partitions. A queue that runs dry leaves its share to the others from then on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import messages
from ledgerlens.llm.arrow import as_bytes, row_type, slices
from ledgerlens.llm.blocks import BLOCK_CHARS, block_of, count_blocks
from ledgerlens.llm.tokens import encoder
from ledgerlens.session import pin

WINDOW_TOKENS = 4096
END_ID = 2
# Queues of their own; smaller sources share one. The schedule of a window is this wide.
MAX_QUEUES = 256


@dataclass
class Phase:
    """A stretch of the output in which the same queues are served."""

    start: int  # tokens of output before it
    served: list[int]  # tokens each queue has given before it
    give: list[int]  # tokens each queue gives in it

    @property
    def size(self) -> int:
        return sum(self.give)


def plan(totals: Sequence[int], weights: Sequence[Fraction]) -> list[Phase]:
    """Phases until all queues are empty; each ends when the next queue runs dry."""
    left, phases, start = list(totals), [], 0
    while any(left):
        active = [q for q, n in enumerate(left) if n]
        time = min(left[q] / weights[q] for q in active)
        give = [min(n, -(-(w * time).numerator // (w * time).denominator)) if n else 0
                for n, w in zip(left, weights)]
        phases.append(Phase(start, [t - n for t, n in zip(totals, left)], give))
        start += sum(give)
        left = [n - g for n, g in zip(left, give)]
    return phases


def served(phase: Phase, at: np.ndarray) -> np.ndarray:
    """Tokens each queue has given when the output is `at` tokens long: a row per position.

    Whole tokens of the exact share first, then one more for the largest remainders.
    """
    size = phase.size
    exact = np.int64 if size < 2 ** 31 else object  # the same numbers; products may pass 64 bits
    give = np.array(phase.give, exact)
    product = give[None, :] * (at - phase.start).astype(exact)[:, None]
    whole, rest = product // size, product % size
    more = (at - phase.start).astype(exact) - whole.sum(axis=1)
    order = np.argsort(-rest, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(give))[None, :], axis=1)
    whole = whole + (rank < more.astype(np.int64)[:, None])
    return whole.astype(np.int64) + np.array(phase.served, np.int64)[None, :]


def pieces_of(
    phases: list[Phase], queue: int, start: int, ends: np.ndarray, window: int
) -> tuple[np.ndarray, ...]:
    """Cut documents that follow each other in a queue from `start` to each of `ends`.

    Returns per piece: the document's number, its start in the queue, its length, its sequence and
    its offset there.
    """
    found = []
    stop = int(ends[-1]) if len(ends) else start
    for phase in phases:
        low, have = phase.served[queue], phase.give[queue]
        a, z = max(start, low), min(stop, low + have)
        if a >= z:
            continue
        # Output positions around the stretch, a window or two more on both sides.
        first = phase.start + (a - low) * phase.size // have - 2 * window
        last = phase.start + (z - low) * phase.size // have + 2 * window
        first, last = max(phase.start, first), min(phase.start + phase.size, last)
        marks = np.arange(first // window + 1, -(-last // window), dtype=np.int64) * window
        at = np.concatenate([[first], marks, [last]]).astype(np.int64)
        if first > phase.start:  # begin at a window's start
            at[0] = max(phase.start, first // window * window)
        if last < phase.start + phase.size:
            at[-1] = min(phase.start + phase.size, -(-last // window) * window)
        at = np.unique(at)
        given = served(phase, at)
        before = np.concatenate(
            [np.zeros((len(at) - 1, 1), np.int64), np.cumsum(np.diff(given, axis=0), axis=1)], axis=1)
        mine = given[:, queue]
        # Every cut of this stretch: document ends, and where the queue's service changes windows.
        inner = np.concatenate([[a], mine, ends, [z]])
        cuts = np.unique(inner[(inner >= a) & (inner <= z)])
        begin, length = cuts[:-1], np.diff(cuts)
        cell = np.searchsorted(mine, begin, side="right") - 1
        found.append((
            np.searchsorted(ends, begin, side="right"), begin, length, at[cell] // window,
            at[cell] % window + before[cell, queue] + begin - mine[cell]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*found))


def source_key(column: str) -> Column:
    """A source as text; a null source is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit(""))


def encode_texts(df: DataFrame, path: str, end_id: int) -> DataFrame:
    """Replace __text by __n, the number of its ids, and __ids, the packed ids."""
    kept = [f for f in df.schema.fields if f.name != "__text"]
    schema = T.StructType([*kept, *row_type(__n="long", __ids="binary").fields])

    def encode(batches):
        own = encoder(path)
        for batch in slices(batches):
            ids = own.encode(as_bytes(batch.column("__text")), end_id)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept],
                 pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([messages.pack_numbers(i) for i in ids], pa.binary())],
                names=schema.names)

    return df.mapInArrow(encode, schema)


def queues_of(
    sizes: DataFrame, targets: Mapping[str, float] | None, window: int
) -> tuple[dict[str, int], list[int], list[Fraction]]:
    """Queue number of each source with a queue of its own, and per queue its tokens and weight.

    The last queue is for all other sources. Queues are sources with a target, or, without
    targets, the largest ones, each with its tokens as weight. At most MAX_QUEUES rows are read.
    """
    per = sizes.groupBy("__source").agg(F.sum("__n").alias("n"))
    total = per.agg(F.sum("n")).first()[0] or 0
    if targets is None:
        least = -(-2 * total // window)
        rows = per.filter(F.col("n") >= least).orderBy(F.desc("n"), "__source")
    else:
        if len(targets) >= MAX_QUEUES or min(targets.values(), default=1) <= 0:
            raise ValueError("targets must be positive and fewer than MAX_QUEUES")
        rows = per.filter(F.col("__source").isin([f"={s}" for s in targets])).orderBy("__source")
    own = [(r["__source"], r["n"]) for r in rows.limit(MAX_QUEUES - 1).collect()]
    numbers, totals = [n for _, n in own], {s: q for q, (s, _) in enumerate(own)}
    rest = total - sum(numbers)
    if targets is None:
        weights = [Fraction(n) for n in [*numbers, rest]]
        if 0 < rest * window < 2 * total and own:  # too little for a queue: joins the smallest
            numbers[-1] += rest
            weights[-2], weights[-1], rest = weights[-2] + rest, Fraction(0), 0
            last = totals.pop(own[-1][0])
            return totals, numbers, weights[:last + 1]
    else:
        weights = [Fraction(targets[s[1:]]).limit_denominator(10 ** 6) for s, _ in own]
        share = Fraction(rest, max(total, 1))
        weights.append(share * sum(weights) / (1 - share) if share < 1 else Fraction(1))
        whole = sum(weights)
        if any(n and w * window < 2 * whole for n, w in zip([*numbers, rest], weights)):
            raise ValueError("a target is too small to give each window two tokens")
    return totals, [*numbers, rest], weights


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    targets: Mapping[str, float] | None = None,
    text_column: str = "text",
    source_column: str = "source",
    keep: Sequence[str] = ("doc_id",),
    window: int = WINDOW_TOKENS,
    end_id: int = END_ID,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Pack all documents into sequences of `window` tokens; returns one row per piece.

    Columns: those of `keep`, start and length (of the piece in its document's ids), doc_tokens,
    sequence_id, offset, and ids (little-endian unsigned 32-bit). Every sequence but the last is
    full, and holds each queue's share of it to within a token. Without `targets` the shares are
    those of the sources in the corpus, so all queues end together; with them, a drained queue's
    share goes to the others. Sources without a target, or too small for a share of their own,
    share a queue.

    A null or empty text is the end id alone. A null source is a source. Equal rows are packed
    each; very long texts are cut like others; an empty table gives no rows. A column of `keep`
    named like a result column is renamed with a leading `doc_`; other columns are not read.
    """
    result = ["start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    blocks = count_blocks(docs, text_column, block_chars)
    hashed = list(dict.fromkeys([*keep, source_column, text_column]))
    given = docs.select(
        block_of(hashed, blocks).alias("__block"), source_key(source_column).alias("__source"),
        F.col(f"`{text_column}`").alias("__text"),
        *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)])
    # Texts are tokenised once; the ids are read again when every queue's length is known.
    encoded = pin(encode_texts(given, tokenizer_path, end_id))
    sizes = pin(encoded.groupBy("__block", "__source").agg(F.sum("__n").alias("__n")))
    queue_of, totals, weights = queues_of(sizes, targets, window)
    phases = plan(totals, weights)
    other = len(totals) - 1

    # Where each block begins in each queue; a row per block and queue.
    entries = [x for s, q in queue_of.items() for x in (F.lit(s), F.lit(q))]
    number = (F.coalesce(F.try_element_at(F.create_map(*entries), F.col("__source")), F.lit(other))
              if entries else F.lit(other))
    earlier = Window.partitionBy("__queue").orderBy("__block")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        sizes.groupBy("__block", number.cast("int").alias("__queue")).agg(F.sum("__n").alias("__n"))
        .withColumn("__begin", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).cast("long"))
        .select("__block", "__queue", "__begin"))

    kept = given.select([f"__k{i}" for i in range(len(keep))])
    schema = T.StructType([
        *kept.schema.fields, *[T.StructField(c, T.LongType()) for c in result[:-1]],
        T.StructField("ids", T.BinaryType())])
    width = len(keep)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        start_of = dict(zip(right["__queue"].to_pylist(), right["__begin"].to_pylist()))
        packed, sources = left["__ids"].to_pylist(), left["__source"].to_pylist()
        sizes = left["__n"].to_pylist()
        # The order in the block decides where each lies: by values only, so a rerun agrees.
        names = list(zip(*[map(repr, left[f"__k{i}"].to_pylist()) for i in range(width)]))
        order = sorted(range(len(packed)), key=lambda r: (
            names[r] if width else (), sources[r], packed[r]))
        by_queue: dict[int, list[int]] = {}
        for r in order:
            by_queue.setdefault(queue_of.get(sources[r], other), []).append(r)
        rows, numbers, ids = [], [], []
        for queue, own in by_queue.items():
            for at in range(0, len(own), 500):
                part = own[at:at + 500]
                tokens = [messages.unpack_numbers(packed[r], sizes[r]) for r in part]
                length = np.array([sizes[r] for r in part], np.int64)
                ends = start_of[queue] + np.cumsum(length)
                doc, begin, size, sequence, offset = pieces_of(
                    phases, queue, start_of[queue], ends, window)
                start = begin - (ends - length)[doc]
                start_of[queue] = int(ends[-1])
                rows.append(np.array(part, np.int64)[doc])
                numbers.append(np.stack([start, size, length[doc], sequence, offset]))
                ids += [tokens[d][s:s + n].tobytes() for d, s, n in zip(doc, start, size)]
        taken = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        values = np.concatenate(numbers, axis=1) if numbers else np.zeros((5, 0), np.int64)
        return pa.table(
            [*[left[f"__k{i}"].take(pa.array(taken)) for i in range(width)],
             *[pa.array(v) for v in values], pa.array(ids, pa.binary())], names=schema.names)

    pieces = encoded.groupBy("__block").cogroup(begins.groupBy("__block")).applyInArrow(cut, schema)
    clash = [c.lower() for c in result]
    names = [f"doc_{c}" if c.lower() in clash else c for c in keep]
    return pieces.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(names)], *result)
