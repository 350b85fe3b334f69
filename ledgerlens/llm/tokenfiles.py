"""Token counts of flat, unindexed token files, by a scan for the separator.

Files hold little-endian unsigned 16-bit ids, each document's ids followed by the separator. Blocks
of a file are searched at once by vectorised comparison, whatever documents they cut; a prefix scan
over the blocks, of the separators so far and the place of the last one, stitches the boundaries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.arrow import as_bytes, row_type, slices
from ledgerlens.llm.tokens import encoder
from ledgerlens.llm.warc import open_fs

FILE_BYTES = 64_000_000
BLOCK_TOKENS = 2_000_000
SEPARATOR = 49407
_ID = np.dtype("<u2")


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, id_column: str = "doc_id",
    text_column: str = "text", separator: int = SEPARATOR, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the ids of all texts below the folder; returns (path, ordinal, id) per document.

    A null or empty text is a separator alone. The separator's string in a text is ordinary text.
    A task that runs twice writes files of other names, of which the list holds one set.
    """
    given = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    schema = T.StructType([*row_type(path="string", ordinal="long").fields, given.schema["id"]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(folder)
        system.create_dir(path, recursive=True)
        own, out, name, n, size = encoder(tokenizer_path, plain=True), None, "", 0, 0
        for batch in slices(batches):
            names, ordinals = [], []
            for ids in own.encode(as_bytes(batch.column("text")), separator):
                if out is None or size + 2 * len(ids) > file_bytes:
                    if out is not None:
                        out.close()
                    name, n, size = f"{uuid.uuid4().hex}.bin", 0, 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                if (ids[:-1] == separator).any() or ids.max() > 65_535:
                    raise ValueError("an id is the separator or does not fit 16 bits")
                out.write(ids.astype(_ID).tobytes())
                names.append(f"{folder}/{name}")
                ordinals.append(n)
                n, size = n + 1, size + 2 * len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(ordinals, pa.int64()), batch.column("id")],
                names=schema.names)
        if out is not None:
            out.close()

    listed = f"{folder}/_documents"
    given.mapInArrow(write, schema).write.mode("overwrite").parquet(listed)
    return docs.sparkSession.read.schema(schema).parquet(listed)


def blocks_of(files: DataFrame, block_tokens: int) -> DataFrame:
    """(path, block) for every block of each file; sizes are read in the tasks."""
    schema = row_type(path="string", block="long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, numbers = [], []
            for path in batch.column(0).to_pylist():
                system, name = open_fs(path)
                count = -(-(system.get_file_info(name).size // 2) // block_tokens)
                paths += [path] * count
                numbers += range(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(numbers, pa.int64())], names=schema.names)

    return files.select("path").filter("path IS NOT NULL").distinct().mapInArrow(work, schema)


def count_tokens(
    spark: SparkSession, files: DataFrame, separator: int = SEPARATOR,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(path, ordinal, start, n_tokens) of every document of the files; needs a column path.

    start is the document's first token in its file; n_tokens does not count the separator. A
    file's tokens after its last separator are one more document. Documents may span any number of
    blocks; adjacent separators enclose empty documents; an empty file gives no row; a file listed
    twice is counted once, a null path is skipped, and an odd last byte is ignored.
    """
    schema = row_type(path="string", block="long", k="int", at="long", found="int")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = open_fs(path)
                with system.open_input_file(name) as file:
                    whole = file.size() // 2
                    first = block * block_tokens
                    last = min(first + block_tokens, whole)
                    data = file.read_at(2 * (last - first), 2 * first)
                at = first + np.flatnonzero(np.frombuffer(data, _ID) == separator)
                found = len(at)
                # A row at the end of the file stands for the separator that is missing there.
                if last == whole and (not found or at[-1] != whole - 1):
                    at = np.append(at, whole)
                if not len(at):
                    at = np.array([-1])  # tells the scan that the block is there
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n), pa.array(np.full(n, block)),
                     pa.array(np.arange(n, dtype=np.int32)), pa.array(at.astype(np.int64)),
                     pa.array(np.full(n, found, np.int32))], names=schema.names)

    blocks = blocks_of(files, block_tokens)
    dealt = blocks.repartition("path", "block")
    seps = dealt.mapInArrow(search, schema).filter("at >= 0")
    ends = seps.groupBy("path", "block").agg(
        F.max("at").alias("end"), F.first("found").alias("found"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("path").alias("p"), F.col("block").alias("b"),
        F.coalesce(F.max("end").over(earlier), F.lit(-1)).alias("end"),
        F.coalesce(F.sum("found").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("path", "block").orderBy("at")
    placed = seps.withColumn("last", F.lag("at").over(inside)).join(
        carried, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b")))
    start = F.coalesce("last", "end") + 1
    return placed.select(
        "path", (F.col("before") + F.col("k")).alias("ordinal"), start.alias("start"),
        (F.col("at") - start).alias("n_tokens"))
