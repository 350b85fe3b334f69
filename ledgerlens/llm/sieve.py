"""A bounded bitmap of keys that lets most rows without one pass by an exchange of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits for each key: about one row in sixteen without a key is taken for one that has it.
BITS_PER_KEY = 16
# At most 16 MB are broadcast; beyond 8 million keys more rows than that are taken for one with a key.
MAX_BITS = 1 << 27
# Bits of one bitmap of Spark's bitmap functions.
_BITMAP = 1 << 15


def with_maybe(df: DataFrame, key: str, keys: DataFrame, into: str, max_bits: int = MAX_BITS) -> DataFrame:
    """Add a flag to each row: false only if its key, a hash of 64 bits, is not in the one column of keys.

    A row with a key from the list always has true, so an exact step has to look at those rows only.
    """
    bits = min(max_bits, max(_BITMAP, 1 << (BITS_PER_KEY * keys.count()).bit_length()))
    place = F.pmod(F.col(f"`{key}`"), F.lit(bits))
    marks = keys.toDF("__key").select(F.pmod("__key", F.lit(bits)).alias("__place")).select(
        F.floor(F.col("__place") / _BITMAP).alias("__bitmap"), (F.col("__place") % _BITMAP).alias("__bit"))
    # Dealt as numbers: bitmaps made before an exchange would be 4 kB for each task and key.
    bitmaps = marks.repartition("__bitmap").groupBy("__bitmap").agg(
        F.bitmap_construct_agg("__bit").alias("__bits"))
    found = df.withColumn("__place", place).join(
        F.broadcast(bitmaps), F.floor(F.col("__place") / _BITMAP) == F.col("__bitmap"), "left")
    at = (F.col("__place") % _BITMAP).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    flag = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], flag.alias(into))
