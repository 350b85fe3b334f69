"""Suffix-array dedup: byte strings of a minimum length that start earlier in the corpus are cut.

One suffix array of a whole corpus fits no machine, so the suffixes are dealt by content. Every
window of `window` bytes has an anchor, its least `anchor`-byte string by a hash, and the windows of
a text that share an anchor are a fragment. Equal windows have equal anchors, so it is enough to
sort together the fragments of one anchor:

1. Blocks of documents send each anchor once, with its count; anchors counted once in the corpus
   have no repeated window.
2. Fragments of the other anchors go to shards by anchor. A shard sorts its suffixes in two stages
   and compares neighbours; of suffixes with a whole window in common all but the earliest are
   marked. An anchor of more places than fill a shard is first dealt over several by place, and the
   windows that are the earliest of theirs go on to the other shards by the window itself, where
   only one place per first shard is left of each.
3. Blocks join the marked windows to spans and cut them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.arrow import as_bytes, others, row_type
from ledgerlens.llm.blocks import block_of
from ledgerlens.llm.messages import mix
from ledgerlens.llm.suffixsort import SuffixArray

WINDOW_BYTES = 100
ANCHOR_BYTES = 32
BLOCK_BYTES = 4_000_000
SHARD_BYTES = 6_000_000
# Places of one anchor that one shard takes: about SHARD_BYTES of fragments.
SHARD_PLACES = 32_768
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D],
                np.uint64)

_ANCHOR = row_type(anchor="long", block="int", n="long")
# A fragment's text and first window, or, without a text, marked windows from first to last.
_PIECE = row_type(to="long", doc_id="long", block="int", ord="int", first="long", last="long",
                  body="binary")
_MARK = row_type(block="int", ord="int", first="long", last="long")
RESULT = T.StructType([
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("kept", T.BinaryType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the least key of every `width` in a row; of equal ones the first."""
    value, at, done = keys, np.arange(len(keys), dtype=np.int32), 1
    while done < width:
        step = min(done, width - done)
        left = value[:-step] <= value[step:]
        at = np.where(left, at[:-step], at[step:])
        value = np.minimum(value[:-step], value[step:])
        done += step
    return at


class Block:
    """The texts of a block in a fixed order, joined, and the fragments of their windows."""

    def __init__(self, block: pa.Table) -> None:
        texts, ids = as_bytes(block["__text"]), block["__id"].to_pylist()
        ties = block["__tie"].to_pylist()
        self.rows = sorted(range(len(texts)), key=lambda i: (
            ids[i] is not None, ids[i] or 0, texts[i] is not None, texts[i] or b"", ties[i]))
        self.texts = [texts[i] or b"" for i in self.rows]
        self.ids = [ids[i] for i in self.rows]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.joined = b"".join(self.texts)
        self.data = np.frombuffer(self.joined, np.uint8)

    def fragments(self, window: int, anchor: int) -> None:
        """first and last window of each fragment, its text, and the hash of its anchor."""
        none = np.zeros(0, np.int64)
        self.first, self.last, self.text, self.anchor = none, none, none, none.astype(np.uint64)
        if len(self.data) < window:
            return
        n = len(self.data) - anchor + 1
        words = np.ndarray((len(self.data) - 7,), "<u8", self.joined, strides=(1,))
        with np.errstate(over="ignore"):
            grams = words[:n] * _ODD[0]
            for i in range(1, anchor // 8):
                grams += words[8 * i:n + 8 * i] * _ODD[i]
            at = _least(((grams ^ (grams >> np.uint64(29))) * _ODD[4] >> np.uint64(32)).astype(
                np.uint32), window - anchor + 1)
        left = np.repeat(self.starts + self.lengths, self.lengths)[:len(at)] - np.arange(len(at))
        windows = np.flatnonzero(left >= window)
        if not len(windows):
            return
        at = at[windows]
        new = np.flatnonzero(np.diff(at, prepend=-1) != 0)
        self.first, self.last = windows[new], windows[np.append(new[1:], len(windows)) - 1]
        self.text = np.searchsorted(self.starts, self.first, "right") - 1  # empty texts come before
        self.anchor = mix(grams[at[new]])


def _anchors(block: Block, number: int) -> pa.Table:
    key, n = np.unique(block.anchor, return_counts=True)
    return pa.table([key.view(np.int64), np.full(len(key), number, np.int32), n.astype(np.int64)],
                    names=_ANCHOR.names)


def _table(columns: Sequence, body: pa.Array | None = None) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_type

    n = len(columns[0])
    body = pa.nulls(n, pa.binary()) if body is None else body
    return pa.table([
        *[pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, _PIECE)], body],
        names=_PIECE.names)


def _cuts(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes from first to end, of each pair."""
    size = end - first
    offsets = np.concatenate([[0], np.cumsum(size)])
    places = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [
        None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[places])]).cast(pa.binary())


def _pieces(
    block: Block, number: int, again: pa.Table, window: int, shards: int, places: int,
) -> pa.Table:
    """The fragments whose anchors occur again, each for its shard.

    An anchor of more than `places` is dealt over shards of its own by place.
    """
    known = again["anchor"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    known, total = known[order], again["total"].to_numpy()[order]
    if not len(block.anchor):
        return _table([[]] * 6)
    at = np.minimum(np.searchsorted(known, block.anchor), len(known) - 1)
    hit = np.flatnonzero(known[at] == block.anchor)
    key, count, text = block.anchor[hit], total[at[hit]], block.text[hit]
    with np.errstate(over="ignore"):
        place = mix((np.uint64(number) << np.uint64(32)) + block.first[hit].astype(np.uint64))
        salt = place % (-(-count // places)).astype(np.uint64)
        shard = np.where(count > places, mix(key + (salt + np.uint64(1)) * _ODD[5]), key)
    to = (shard >> np.uint64(1)) % np.uint64(shards)
    first, base = block.first[hit], block.starts[text]
    return _table([
        to.astype(np.int64), [block.ids[i] for i in text], np.full(len(hit), number, np.int32),
        text.astype(np.int32), first - base, [None] * len(hit)],
        _cuts(block.data, first, block.last[hit] + window))


class Shard:
    """The fragments of a shard, their sorted suffixes, and which windows start earlier elsewhere."""

    def __init__(self, pieces: pa.Table, window: int) -> None:
        self.window, bodies = window, pieces["body"].to_pylist()
        self.first = pieces["first"].to_numpy()
        self.block, self.ord = pieces["block"].to_numpy(), pieces["ord"].to_numpy()
        lengths = np.array([len(b) for b in bodies], np.int64)
        self.suffixes = SuffixArray(
            np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(lengths) - lengths, lengths,
            lengths - window + 1, window)
        # Documents in order of their ids, nulls first, then by block and place in it.
        ids, known = pieces["doc_id"].fill_null(0).to_numpy(), np.array(pieces["doc_id"].is_valid())
        by = np.lexsort((self.ord, self.block, ids, known))
        parts = [known[by], ids[by], self.block[by], self.ord[by]]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(np.append(True, np.any([p[1:] != p[:-1] for p in parts], axis=0)))
        text, order = self.suffixes.text, self.suffixes.order
        self.start = order - self.suffixes.starts[text] + self.first[text]
        # Of neighbours with a whole window in common, the earliest.
        place = (rank[text] << 40) + self.start
        heads = np.flatnonzero(self.suffixes.common < window)
        least = np.minimum.reduceat(place, heads)
        self.later = place != np.repeat(least, np.diff(np.append(heads, len(place))))

    def marks(self) -> list[np.ndarray]:
        """block, ord, first and last of marked windows; those in a row are one mark."""
        starts = self.suffixes.starts
        where = np.sort(self.suffixes.order[self.later])
        text = np.searchsorted(starts, where, "right") - 1
        cut = np.flatnonzero((np.diff(where, prepend=-2) != 1) | (np.diff(text, prepend=-1) != 0))
        stop = np.append(cut[1:], len(where))[:len(cut)] - 1
        text = text[cut]
        base = self.first[text] - starts[text]
        return [self.block[text], self.ord[text], where[cut] + base, where[stop] + base]

    def earliest(self, ids: list, shards: int) -> pa.Table:
        """The windows not marked, as fragments of their own, for shards by the window."""
        on = np.flatnonzero(~self.later)
        at, text = self.suffixes.order[on], self.suffixes.text[on]
        rows = np.lib.stride_tricks.sliding_window_view(self.suffixes.line, self.window)[at]
        key = np.zeros(len(on), np.uint64)
        for i in range(0, self.window - 7, 8):
            key = mix(key ^ np.ascontiguousarray(rows[:, i:i + 8]).view("<u8").ravel())
        to = (key >> np.uint64(1)) % np.uint64(shards)
        return _table([
            to.astype(np.int64), [ids[i] for i in text], self.block[text], self.ord[text],
            self.start[on], [None] * len(on)], _cuts(self.suffixes.line, at, at + self.window))


def _thin_shard(pieces: pa.Table, window: int, shards: int) -> pa.Table:
    """Marks of a shard of an anchor of many places, and its earliest windows for other shards."""
    shard = Shard(pieces, window)
    block, ord_, first, last = shard.marks()
    marks = _table([block.astype(np.int64), [None] * len(block), block, ord_, first, last])
    return pa.concat_tables([marks, shard.earliest(pieces["doc_id"].to_pylist(), shards)])


def _sort_shard(rows: pa.Table, window: int) -> pa.Table:
    """Marks of all windows of a shard but the earliest, and the marks that came with it."""
    passing = rows.filter(rows["body"].is_null()).select(_MARK.names)
    pieces = rows.filter(rows["body"].is_valid())
    if not pieces.num_rows:
        return passing
    marks = pa.Table.from_arrays(Shard(pieces, window).marks(), names=_MARK.names)
    return pa.concat_tables([passing, marks.cast(passing.schema)])


def _cut(block: Block, marks: pa.Table, window: int) -> list[tuple]:
    """The result of each text of the block, in the block's order."""
    size = len(block.data)
    step = np.zeros(size + 1, np.int64)
    base = block.starts[marks["ord"].to_numpy()]
    np.add.at(step, base + marks["first"].to_numpy(), 1)
    np.add.at(step, base + marks["last"].to_numpy() + window, -1)
    gone = np.cumsum(step[:size]) > 0
    out = []
    for text, start, n in zip(block.texts, block.starts.tolist(), block.lengths.tolist()):
        own = gone[start:start + n]
        if not own.any():
            out.append((n, 0, 0, text, []))
            continue
        edge = np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        kept = block.data[start:start + n][~own].tobytes()
        out.append((n, n - len(kept), len(spans), kept, spans))
    return out


def remove_earlier_bytes(
    docs: DataFrame,
    into: str = "dedup",
    text_column: str = "text",
    id_column: str = "doc_id",
    keep: Sequence[str] | None = None,
    window: int = WINDOW_BYTES,
    anchor: int = ANCHOR_BYTES,
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
    shard_places: int = SHARD_PLACES,
) -> DataFrame:
    """Add a struct: n_bytes, n_removed, n_spans, the kept bytes, and the spans cut, in bytes.

    Texts are compared as UTF-8 bytes. A byte goes if a string of `window` bytes that covers it also
    starts earlier: in a document of a smaller id, or earlier in the same one; the places may
    overlap. All are judged on the input, and no match crosses documents. The kept bytes may begin
    or end inside a character.

    A null text counts as empty; texts shorter than a window stay; documents without an id come
    before all others; rows of one id come in the order of a hash of their values, so of repeated
    rows one stays whole; very long texts are searched whole; an empty table stays empty. Ids are
    integers. An input column named as `into` is replaced, others pass unchanged.
    """
    if anchor % 8 or not 8 <= anchor <= min(window, 64):
        raise ValueError("an anchor is 8 to 64 bytes, in steps of 8, and no longer than a window")
    columns = others(docs.columns if keep is None else keep, into)
    text, doc = F.col(f"`{text_column}`"), F.col(f"`{id_column}`")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    shards = max(1, -(-2 * total // shard_bytes))
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()
                and f.name in {*columns, text_column, id_column}]
    placed = docs.select(
        block_of([id_column, text_column], blocks).alias("__block"), doc.cast("long").alias("__id"),
        text.alias("__text"), F.xxhash64(*hashable).alias("__tie"),
        *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(columns)])
    schema = T.StructType([
        *placed.select([f"__k{i}" for i in range(len(columns))]).schema.fields,
        T.StructField("__r", RESULT)])

    def anchors(key, table):
        block = Block(table)
        block.fragments(window, anchor)
        return _anchors(block, key[0].as_py())

    def pieces(key, table, again):
        if not again.num_rows or not table.num_rows:
            return _table([[]] * 6)
        block = Block(table)
        block.fragments(window, anchor)
        return _pieces(block, key[0].as_py(), again, window, shards, shard_places)

    def thin(table):
        return _thin_shard(table, window, shards)

    def sort(table):
        return _sort_shard(table, window)

    def cut(key, table, marks):
        from pyspark.sql.pandas.types import to_arrow_type

        block = Block(table)
        done = pa.array(_cut(block, marks, window), to_arrow_type(RESULT))
        own = table.take(pa.array(block.rows, pa.int64()))
        return pa.table([*[own[n] for n in schema.names[:-1]], done], names=schema.names)

    by_block = placed.groupBy("__block")
    found = by_block.applyInArrow(anchors, _ANCHOR)
    again = found.withColumn(
        "total", F.sum("n").over(Window.partitionBy("anchor"))).filter(
        "total > 1").select("block", "anchor", "total")
    few, many = (again.filter(F.col("total") <= shard_places), again.filter(F.col("total") > shard_places))
    pieces_of = lambda of: by_block.cogroup(of.groupBy("block")).applyInArrow(pieces, _PIECE)
    spread = pieces_of(many).groupBy("to").applyInArrow(thin, _PIECE)
    marks = pieces_of(few).unionAll(spread).groupBy("to").applyInArrow(sort, _MARK)
    done = by_block.cogroup(marks.groupBy("block")).applyInArrow(cut, schema)
    return done.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(columns)], F.col("__r").alias(into))
