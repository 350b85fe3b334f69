"""Blocks of documents: shares of the table, of bounded length, that one task works on at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 8_000_000


def count_blocks(docs: DataFrame, text_column: str, block_chars: int = BLOCK_CHARS) -> int:
    """Blocks so that each holds about block_chars of text; a short pass over the text column."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_column}`")))).first()[0] or 0
    return max(1, -(-total // block_chars))


def block_of(columns: Sequence[str], blocks: int) -> Column:
    """The block of a row, from its values alone: the same whenever a task is run again.

    The text is among the columns, so rows without an id spread as well.
    """
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(blocks)).cast("int")
