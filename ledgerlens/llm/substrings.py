"""Substring dedup: passages of a minimum length that occur in more than one place.

Suffix automata of reference shards give matching statistics. A literal broadcast of the automata
of a whole corpus to all its documents would be quadratic, so shards are cut by content: every
window of `window` words has an anchor, its least short word sequence, and the stretch of windows
of a text that share an anchor is a fragment. Equal windows have equal anchors, so all places of a
window lie in fragments of one anchor. A shard is the set of distinct fragments of one anchor, and
its automaton meets just the fragments that can match it:

1. Blocks of documents ask the owners of anchors which of them occur again. A fragment whose anchor
   occurs once is done; so is one that is the only one of its anchor.
2. The other fragments go to their anchor's owner, once per block with their number. It builds the
   shard's automaton, streams the fragments through it, and answers with their repeated windows.
   An anchor of very many distinct fragments (a common phrase) is no shard: its windows are counted
   by their hashes, spread over all tasks.
3. Blocks join the repeated windows to maximal spans and cut them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import messages
from ledgerlens.llm.arrow import as_bytes, others, to_table
from ledgerlens.llm.automaton import SuffixAutomaton
from ledgerlens.llm.blocks import block_of, count_blocks
from ledgerlens.llm.routing import ECHO, FAN, MESSAGE, Kind, Tree, answers_to, gather

WINDOW_WORDS = 35
ANCHOR_WORDS = 8
BLOCK_CHARS = 5_000_000
# An anchor with more distinct fragments than this is counted by windows.
SHARD_FRAGMENTS = 64

ONCE, ALL, SHARD, COMMON = 0, 1, 2, 3
# Kinds of questions: about anchors, fragments of shards, and windows of common anchors.
ANCHORS, FRAGMENTS, WINDOWS = 0, 1, 2

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each `width` neighbouring values, of equals the first.

    By doubling: stretches are put together from two shorter ones that may overlap, so a few
    arrays of the values' length are held, not one of `width` times as many entries.
    """
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        size += step
    return at


class Fragments:
    """The fragments of a block's texts.

    first and last window and anchor position of each, in words of the whole block; its anchor's
    key and the digest of its words; and the distinct (key, digest), sorted, with their numbers.
    """

    def __init__(
        self, texts: Sequence[bytes | None], window: int, anchor: int,
        shard_fragments: int = SHARD_FRAGMENTS,
    ) -> None:
        self.window, self.shard_fragments = window, shard_fragments
        number = _Numbers()
        self.words = [(t or b"").split() for t in texts]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        line = np.fromiter((number[w] for own in self.words for w in own), np.int64,
                           int(self.lengths.sum()))
        keys = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        x = messages.mix(keys)[line] if len(line) else np.zeros(0, np.uint64)
        self._prefix_hashes(x)
        left = np.repeat(self.starts + self.lengths, self.lengths) - np.arange(len(x))
        windows = np.flatnonzero(left >= window)
        if not len(windows):
            self.first = self.last = self.at = np.zeros(0, np.int64)
        else:
            grams = x[:len(x) - anchor + 1]
            for i in range(1, anchor):
                grams = messages.chain(grams, x[i:len(x) - anchor + 1 + i])
            at = first_least(grams, window - anchor + 1)[windows]
            new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(windows, prepend=-2) != 1))
            self.first, self.at = windows[new], at[new]
            self.last = windows[np.append(new[1:], len(windows)) - 1]
        key = grams[self.at] if len(windows) else np.zeros(0, np.uint64)
        digest = self.hash(self.first, self.last + window)
        digest = messages.chain(digest, (self.at - self.first).astype(np.uint64)) | np.uint64(1)
        order = np.lexsort((digest, key))
        k, d = key[order], digest[order]
        new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))) if len(k) else order
        self.key, self.digest, self.sample = k[new], d[new], order[new]
        self.number = np.diff(np.append(new, len(k)))
        self.entry = np.empty(len(k), np.int64)
        self.entry[order] = np.repeat(np.arange(len(new)), self.number)

    def _prefix_hashes(self, x: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
            one = np.ones(1, np.uint64)
            power = np.cumprod(np.concatenate([one, np.full(len(x), base)]), dtype=np.uint64)
            self._undo = np.cumprod(np.concatenate([one, np.full(len(x), inverse)]), dtype=np.uint64)
            self._sums = np.concatenate([one - one, np.cumsum(x * power[:-1], dtype=np.uint64)])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from start to end, wherever they lie."""
        with np.errstate(over="ignore"):
            own = (self._sums[end] - self._sums[start]) * self._undo[start]
        return messages.chain(own, (end - start).astype(np.uint64))

    def text(self, fragment: int) -> bytes:
        a, z = int(self.first[fragment]), int(self.last[fragment]) + self.window
        doc = int(np.searchsorted(self.starts, a, "right")) - 1
        while not self.lengths[doc]:  # empty texts start at the same word
            doc -= 1
        at = int(self.starts[doc])
        return b" ".join(self.words[doc][a - at:z - at])

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries of anchors with too many distinct fragments already here, and those to send:
        all others, and one of each such anchor."""
        n = len(self.key)
        new = np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1])) if n else np.zeros(0, int)
        many = np.repeat(np.diff(np.append(new, n)) > self.shard_fragments, np.diff(np.append(new, n)))
        send = ~many
        send[new] = True
        return many, send


class Anchors(Kind):
    """How often an anchor occurs, in how many distinct fragments: the state of its fragments."""

    answer = np.uint8

    def __init__(self, shard_fragments: int) -> None:
        self.shard_fragments = shard_fragments

    def pack(self, digests: np.ndarray) -> bytes:
        return messages.pack_numbers(digests, np.uint64)

    def unpack(self, bodies):
        return np.concatenate([messages.unpack_numbers(b, n, np.uint64) for b, n in bodies])

    def resolve(self, keys, counts, digests):
        """Each entry is an anchor with one digest; 0 marks a common anchor."""
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        distinct = np.diff(np.append(begin, len(keys)))
        state = np.where(
            (digests[begin] == 0) | (distinct > self.shard_fragments), COMMON,
            np.where(np.add.reduceat(counts, begin) == 1, ONCE, np.where(distinct == 1, ALL, SHARD)))
        return np.repeat(state, distinct)


class Shards(Kind):
    """The windows of a fragment that occur again in its anchor's shard, by an automaton."""

    answer = np.uint64

    def __init__(self, window: int) -> None:
        self.window = window

    def pack(self, texts: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=3).compress(b"\n".join(texts))

    def unpack(self, bodies):
        texts = [t for b, _ in bodies for t in zstandard.ZstdDecompressor().decompress(b).split(b"\n")]
        return _objects(texts)

    def rank(self, texts):
        number = {t: n for n, t in enumerate(sorted(set(texts)))}
        return np.fromiter(map(number.__getitem__, texts), np.int64, len(texts))

    def resolve(self, keys, counts, texts):
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        bits: list[int] = []
        for a, z in zip(begin, np.append(begin[1:], len(keys))):
            found = repeated_windows(dict(zip(texts[a:z], counts[a:z].tolist())), self.window)
            bits += [found[t] for t in texts[a:z]]
        return np.array(bits, np.uint64)


class Windows(Kind):
    """Whether a window occurs more than once."""

    answer = np.uint8

    def resolve(self, keys, counts, extra):
        return counts > 1


def _objects(texts: Sequence[bytes]) -> np.ndarray:
    out = np.empty(len(texts), object)
    out[:] = texts
    return out


def kinds_of(window: int, shard_fragments: int) -> dict[int, Kind]:
    return {ANCHORS: Anchors(shard_fragments), FRAGMENTS: Shards(window), WINDOWS: Windows()}


def ask_anchors(f: Fragments, block: int, tree: Tree, kinds: dict[int, Kind]) -> pa.Table:
    many, send = f.common()
    digest = np.where(many, np.uint64(0), f.digest)[send]  # 0 marks a common anchor
    return to_table(list(tree.send(
        0, block, ANCHORS, kinds[ANCHORS], f.key[send], f.number[send], digest)), MESSAGE)


def states_of(f: Fragments, answers: list[dict]) -> np.ndarray:
    """The state of each distinct fragment of a block."""
    many, send = f.common()
    state = np.full(len(f.key), COMMON, np.uint8)
    state[send] = gather(answers, ANCHORS, np.uint8)
    state[many] = COMMON
    return state


def common_windows(f: Fragments, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window of the fragments of common anchors: its first word and its hash."""
    own = np.flatnonzero(state[f.entry] == COMMON)
    size = f.last[own] - f.first[own] + 1
    at = np.repeat(f.first[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
    return at, f.hash(at, at + f.window)


def ask_repeats(
    f: Fragments, answers: list[dict], block: int, tree: Tree, kinds: dict[int, Kind]
) -> pa.Table:
    state = states_of(f, answers)
    shard = np.flatnonzero(state == SHARD)
    texts = _objects([f.text(int(f.sample[e])) for e in shard])
    rows = list(tree.send(
        0, block, FRAGMENTS, kinds[FRAGMENTS], f.key[shard], f.number[shard], texts))
    _, hashes = common_windows(f, state)
    distinct, number = np.unique(hashes, return_counts=True)
    rows += tree.send(0, block, WINDOWS, kinds[WINDOWS], distinct, number)
    rows.append(tree.keep(block, len(state), messages.pack_numbers(state, np.uint8)))
    return to_table(rows, MESSAGE)


def repeated_windows(shard: dict[bytes, int], window: int) -> dict[bytes, int]:
    """For each distinct fragment of a shard, with its number of places, the bits of the windows
    that occur in two places or more."""
    automaton, split = SuffixAutomaton(), {}
    for text, places in shard.items():
        split[text] = text.split(b" ")
        automaton.add(split[text], places)
    automaton.count()
    return {
        text: sum(1 << i for i, n in enumerate(automaton.repeated(words)[window - 1:]) if n >= window)
        for text, words in split.items()}


def marked_words(f: Fragments, answers: list[dict]) -> np.ndarray:
    """A mark per word of the block that lies in a repeated window."""
    state = gather(answers, ECHO, np.uint8)
    width = f.window
    change = np.zeros(int(f.lengths.sum()) + 1, np.int64)

    def mark(first: np.ndarray, end: np.ndarray) -> None:
        np.add.at(change, first, 1)
        np.add.at(change, end, -1)

    if len(state):
        whole = np.flatnonzero(state[f.entry] == ALL)
        mark(f.first[whole], f.last[whole] + width)
        bits = np.zeros(len(f.key), np.uint64)
        bits[state == SHARD] = gather(answers, FRAGMENTS, np.uint64)
        own = np.flatnonzero(bits[f.entry] > 0)
        for i in range(width):
            hit = own[(bits[f.entry[own]] >> np.uint64(i)) & np.uint64(1) == 1]
            mark(f.first[hit] + i, f.first[hit] + i + width)
        at, hashes = common_windows(f, state)
        if len(at):
            again = gather(answers, WINDOWS, np.uint8) > 0
            at = at[again[np.searchsorted(np.unique(hashes), hashes)]]
            mark(at, at + width)
    return np.cumsum(change[:-1]) > 0


def cut(text: bytes | None, words: list[bytes], marks: np.ndarray) -> tuple:
    """n_words, n_removed, the text without its marked words, and the spans cut, in characters."""
    if text is None or not marks.any():
        return len(words), 0, None if text is None else text.decode(), []
    solid = ~np.isin(np.frombuffer(text, np.uint8), np.frombuffer(b" \t\n\v\f\r", np.uint8))
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8))
    first, last = np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    pieces, at = [], 0
    for a, b in zip(start[first], end[last]):
        pieces.append(text[at:a])
        at = b
    pieces.append(text[at:])
    spans = [(int(chars[a]), int(chars[b])) for a, b in zip(start[first], end[last])]
    return len(words), int(marks.sum()), b"".join(pieces).decode(), spans


def remove_repeats(
    docs: DataFrame,
    into: str = "dedup",
    text_column: str = "text",
    keep: Sequence[str] | None = None,
    window: int = WINDOW_WORDS,
    anchor: int = ANCHOR_WORDS,
    block_chars: int = BLOCK_CHARS,
    shard_fragments: int = SHARD_FRAGMENTS,
    fan: int = FAN,
) -> DataFrame:
    """Add a struct: n_words, n_removed, the text without repeats, and the spans cut from it.

    Words lie between ASCII white space and are compared as they are. Every word is removed that
    is covered by a window of `window` consecutive words of one document which also starts
    anywhere else, in the same document or another; all places are judged on the input, and none
    is spared. White space outside the spans stays.

    A null text has no words and stays null; an empty one stays empty; texts shorter than a window
    stay; repeated rows are places of their own, so both lose what they share; very long texts
    are searched whole; an empty table stays empty. An input column named as `into` is replaced,
    others pass unchanged.
    """
    if not anchor <= window <= anchor + 63:
        raise ValueError("a window holds at least one anchor and at most 64")
    columns = others(docs.columns if keep is None else keep, into)
    blocks = count_blocks(docs, text_column, block_chars)
    tree, kinds = Tree.over(blocks, fan), kinds_of(window, shard_fragments)
    hashed = list(dict.fromkeys([*(["doc_id"] if "doc_id" in docs.columns else []), text_column]))
    given = docs.select(
        block_of(hashed, blocks).cast("long").alias("__block"), F.col(f"`{text_column}`").alias("__text"),
        *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(columns)])
    placed = given.repartition(blocks, "__block")
    fields = placed.select([f"__k{i}" for i in range(len(columns))]).schema.fields
    schema = T.StructType([*fields, T.StructField("__r", RESULT)])
    names = schema.names

    def fragments(block):
        return Fragments(as_bytes(block["__text"]), window, anchor, shard_fragments)

    def first(key, block):
        return ask_anchors(fragments(block), key[0].as_py(), tree, kinds)

    def second(key, block, answers):
        return ask_repeats(fragments(block), answers.to_pylist(), key[0].as_py(), tree, kinds)

    def third(key, block, answers):
        from pyspark.sql.pandas.types import to_arrow_type

        f, texts = fragments(block), as_bytes(block["__text"])
        marks = marked_words(f, answers.to_pylist())
        results = [cut(t, w, marks[s:s + n])
                   for t, w, s, n in zip(texts, f.words, f.starts, f.lengths)]
        return pa.table(
            [*[block[n] for n in names[:-1]], pa.array(results, to_arrow_type(RESULT))], names=names)

    by_block = placed.groupBy("__block")
    anchors = answers_to(by_block.applyInArrow(first, MESSAGE), tree, kinds)
    asked = by_block.cogroup(anchors.groupBy("__to")).applyInArrow(second, MESSAGE)
    repeats = answers_to(asked, tree, kinds)
    done = by_block.cogroup(repeats.groupBy("__to")).applyInArrow(third, schema)
    return done.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(columns)], F.col("__r").alias(into))
