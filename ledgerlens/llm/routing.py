"""Questions of blocks to the owners of key ranges, through a tree of steps of bounded width.

With B blocks and as many owners, a message from each block to each owner would be B * B rows. Here
owners are the leaves of a tree with at most FAN children a node, and blocks are put together in
groups of as many. At each step a node takes the messages of FAN senders, adds up what is equal in
them, and passes it on to its FAN children; so a sender writes at most FAN rows a step, a node
holds about what one block asked, and the steps grow with the logarithm of B only. Answers go the
same way back: a node knows from its own messages which sender asked what.

Up to FAN blocks the tree is one step, and beyond that each step's messages are written once to
reliable storage, as the way back reads them again.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm import messages
from ledgerlens.llm.arrow import row_type, to_table
from ledgerlens.session import pin

FAN = 256
MESSAGE = row_type(__node="long", __from="long", __kind="int", __n="int", __keys="binary",
                   __counts="binary", __body="binary")
ANSWER = row_type(__to="long", __kind="int", __child="long", __n="int", __body="binary")


class Kind:
    """A kind of question: 64-bit keys with counts. Equal keys are added up, the sum is the answer.

    Subclasses may send something more beside each key (`extra`), which then belongs to what must
    be equal, and may answer otherwise.
    """

    answer: type = np.uint64

    def pack(self, extra) -> bytes | None:
        return None

    def unpack(self, bodies: list[tuple[bytes, int]]) -> np.ndarray | None:
        """What the messages sent beside their keys, one after the other."""
        return None

    def rank(self, extra: np.ndarray) -> np.ndarray:
        """Numbers by which to sort and compare it."""
        return extra

    def resolve(self, keys: np.ndarray, counts: np.ndarray, extra) -> np.ndarray:
        """The owner's answers to all distinct questions about its keys, which are ascending."""
        return counts


# A message of this kind is no question: the first node sends it back, so that a block's own
# results come to its next step with the answers.
ECHO = -1


@dataclass(frozen=True)
class Tree:
    """fan ** hops owners, at least as many as blocks."""

    fan: int
    hops: int

    @staticmethod
    def over(blocks: int, most: int = FAN) -> Tree:
        hops = 1
        while most ** hops < blocks:
            hops += 1
        fan = 1
        while fan ** hops < blocks:
            fan += 1
        return Tree(fan, hops)

    def send(
        self, level: int, sender: int, number: int, kind: Kind, keys: np.ndarray, counts: np.ndarray,
        extra=None,
    ) -> Iterator[tuple]:
        """Messages with these ascending keys to the nodes of the next level; blocks are level 0.

        A node is a group of blocks and a range of keys: group * fan ** level + range.
        """
        base = self.fan ** level
        group, own = divmod(sender, base)
        first = own * self.fan
        below = ((keys >> np.uint64(32)) * np.uint64(base * self.fan)) >> np.uint64(32)
        edges = np.searchsorted(below, np.arange(first, first + self.fan + 1, dtype=np.uint64))
        node = group // self.fan * base * self.fan + first
        for child in np.flatnonzero(np.diff(edges)).tolist():
            a, z = int(edges[child]), int(edges[child + 1])
            yield (node + child, sender, number, z - a, messages.pack_sorted(keys[a:z]),
                   messages.pack_numbers(counts[a:z], np.uint64),
                   None if extra is None else kind.pack(extra[a:z]))

    def keep(self, block: int, n: int, body: bytes) -> tuple:
        """A message that comes back to the block; blocks keep theirs on as many nodes."""
        return (block, block, ECHO, n, None, None, body)


@dataclass
class Merged:
    """The distinct questions of several messages, ascending, and which of them each message asked."""

    keys: np.ndarray
    counts: np.ndarray
    extra: np.ndarray | None
    asked: list[tuple[dict, np.ndarray]]


def merge(rows: Sequence[dict], kind: Kind) -> Merged:
    keys = np.concatenate([messages.unpack_sorted(r["__keys"], r["__n"]) for r in rows])
    counts = np.concatenate([messages.unpack_numbers(r["__counts"], r["__n"], np.uint64) for r in rows])
    extra = kind.unpack([(r["__body"], r["__n"]) for r in rows])
    rank = None if extra is None else kind.rank(extra)
    order = np.argsort(keys, kind="stable") if rank is None else np.lexsort((rank, keys))
    k = keys[order]
    new = np.append(True, k[1:] != k[:-1])
    if rank is not None:
        own = rank[order]
        new[1:] |= own[1:] != own[:-1]
    begin = np.flatnonzero(new)
    entry = np.empty(len(keys), np.int64)
    entry[order] = np.cumsum(new) - 1
    ends = np.cumsum([r["__n"] for r in rows])
    return Merged(k[begin], np.add.reduceat(counts[order], begin),
                  None if extra is None else extra[order[begin]],
                  [(r, entry[z - r["__n"]:z]) for r, z in zip(rows, ends)])


def by_kind(table: pa.Table) -> dict[int, list[dict]]:
    """A node's messages in an order that does not depend on how they came."""
    out: dict[int, list[dict]] = {}
    for r in sorted(table.to_pylist(), key=lambda r: r["__from"]):
        out.setdefault(r["__kind"], []).append(r)
    return out


def replies(node: int, number: int, kind: Kind, merged: Merged, answers: np.ndarray) -> Iterator[tuple]:
    for r, entry in merged.asked:
        yield (r["__from"], number, node, r["__n"], messages.pack_numbers(answers[entry], kind.answer))


def echoes(node: int, kinds: Mapping[int, list[dict]]) -> list[tuple]:
    return [(r["__from"], ECHO, node, r["__n"], r["__body"]) for r in kinds.get(ECHO, [])]


def gather(answers: Sequence[dict], number: int, kind: type) -> np.ndarray:
    """The answers to all questions of a kind, in the order of the keys asked."""
    own = sorted((a for a in answers if a["__kind"] == number), key=lambda a: a["__child"])
    parts = [messages.unpack_numbers(a["__body"], a["__n"], kind) for a in own]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def forward(tree: Tree, level: int, kinds: Mapping[int, Kind], node: int, asked: pa.Table) -> pa.Table:
    """What a node passes on to the next level."""
    rows: list[tuple] = []
    for number, own in by_kind(asked).items():
        if number != ECHO:
            m = merge(own, kinds[number])
            rows += tree.send(level, node, number, kinds[number], m.keys, m.counts, m.extra)
    return to_table(rows, MESSAGE)


def resolve(kinds: Mapping[int, Kind], node: int, asked: pa.Table) -> pa.Table:
    """An owner's answers."""
    own = by_kind(asked)
    rows = echoes(node, own)
    for number in own.keys() - {ECHO}:
        kind, m = kinds[number], merge(own[number], kinds[number])
        rows += replies(node, number, kind, m, kind.resolve(m.keys, m.counts, m.extra))
    return to_table(rows, ANSWER)


def back(kinds: Mapping[int, Kind], asked: pa.Table, answers: pa.Table) -> pa.Table:
    """A node's answers to its senders, from those that its children gave."""
    if not asked.num_rows:
        return to_table([], ANSWER)
    node, own, given = asked["__node"][0].as_py(), by_kind(asked), answers.to_pylist()
    rows = echoes(node, own)
    for number in own.keys() - {ECHO}:
        kind = kinds[number]
        rows += replies(node, number, kind, merge(own[number], kind), gather(given, number, kind.answer))
    return to_table(rows, ANSWER)


def answers_to(asked: DataFrame, tree: Tree, kinds: Mapping[int, Kind]) -> DataFrame:
    """The answers (ANSWER) to the messages (MESSAGE) of all blocks."""

    def passing(level: int):
        return lambda key, table: forward(tree, level, kinds, key[0].as_py(), table)

    steps = [asked if tree.hops == 1 else pin(asked)]
    for level in range(1, tree.hops):
        on = steps[-1].groupBy("__node").applyInArrow(passing(level), MESSAGE)
        steps.append(pin(on) if level < tree.hops - 1 else on)
    answers = steps[-1].groupBy("__node").applyInArrow(
        lambda key, table: resolve(kinds, key[0].as_py(), table), ANSWER)
    for step in reversed(steps[:-1]):
        answers = step.groupBy("__node").cogroup(answers.groupBy("__to")).applyInArrow(
            lambda own, given: back(kinds, own, given), ANSWER)
    return answers
