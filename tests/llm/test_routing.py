"""Messages between blocks and owners: their number, and answers through several steps."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import routing
from ledgerlens.llm.arrow import to_table
from ledgerlens.llm.messages import mix
from ledgerlens.llm.routing import Kind, Tree

KIND = {0: Kind()}


def question(tree, block, keys, counts):
    order = np.argsort(keys)
    return list(tree.send(0, block, 0, KIND[0], keys[order], counts[order]))


@pytest.mark.parametrize("blocks", [100, 6_000, 50_000, 200_000, 20_000_000])
def test_rows_and_bytes_of_a_block_do_not_grow_with_the_blocks(blocks):
    tree = Tree.over(blocks)
    assert tree.fan <= routing.FAN and tree.fan ** tree.hops >= blocks
    keys = mix(np.arange(1, 700_001, dtype=np.uint64))
    rows = question(tree, blocks - 1, keys, np.ones(len(keys), np.uint64))
    assert len(rows) <= routing.FAN and sum(r[3] for r in rows) == len(keys)
    few = question(Tree.over(100), 99, keys, np.ones(len(keys), np.uint64))
    size = lambda rows: sum(len(r[4]) + len(r[5]) for r in rows)
    assert size(rows) < 1.1 * size(few)
    # A node of the next step takes as many messages at most, and sends as many at most.
    node = rows[0][0]
    senders = {b for b in range(max(0, blocks - 600), blocks)
               if next(tree.send(0, b, 0, KIND[0], np.zeros(1, np.uint64), np.ones(1, np.uint64)))[0]
               // tree.fan == node // tree.fan}
    assert 0 < len(senders) <= tree.fan
    if tree.hops > 1:
        asked = to_table([rows[0]], routing.MESSAGE)
        on = routing.forward(tree, 1, KIND, node, asked)
        assert 0 < on.num_rows <= tree.fan and sum(on["__n"].to_pylist()) == rows[0][3]


@pytest.mark.parametrize("blocks,fan", [(1, 2), (5, 2), (23, 3), (23, 256)])
def test_every_block_gets_the_sums_of_its_keys(spark, blocks, fan):
    rng = np.random.default_rng(blocks + fan)
    tree = Tree.over(blocks, fan)
    asked, rows, total = {}, [], {}
    for block in range(blocks):
        keys = mix(np.unique(rng.integers(1, 200, rng.integers(0, 90))).astype(np.uint64))
        counts = rng.integers(1, 9, len(keys)).astype(np.uint64)
        order = np.argsort(keys)
        asked[block] = keys[order]
        rows += question(tree, block, keys, counts)
        rows.append(tree.keep(block, 1, bytes([block])))
        for k, n in zip(keys.tolist(), counts.tolist()):
            total[k] = total.get(k, 0) + n
    df = spark.createDataFrame([tuple(r) for r in rows], routing.MESSAGE).repartition(4)
    got = routing.answers_to(df, tree, KIND).toArrow().to_pylist()
    for block, keys in asked.items():
        own = [a for a in got if a["__to"] == block]
        assert [a["__body"] for a in own if a["__kind"] == routing.ECHO] == [bytes([block])]
        assert routing.gather(own, 0, np.uint64).tolist() == [total[k] for k in keys.tolist()]


def test_no_messages(spark):
    df = spark.createDataFrame([], routing.MESSAGE)
    assert routing.answers_to(df, Tree.over(9, 2), KIND).isEmpty()
    assert routing.back(KIND, pa.Table.from_batches([], to_table([], routing.MESSAGE).schema),
                        to_table([], routing.ANSWER)).num_rows == 0
