"""MinHash near-duplicates with HyperMinHash registers, confirmed on whole shingle sets.

A sketch has one register per bucket of the hash space: of the smallest hash in the bucket, the
number of leading zeros and the bits after the first one, in 16 bits. Bands of registers find
candidates; the share of equal registers, corrected for chance collisions, estimates similarity
and spares most pairs the exact comparison.

Documents with equal sets are one class, and classes are compared with few others: first each with
one leader of each of its buckets. Only where a bucket then still falls into several components are
the classes outside its largest one compared with the whole bucket, in cells of bounded size. No
pair of a bucket that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import messages, tokens
from ledgerlens.llm.arrow import as_bytes, row_type, slices, to_table
from ledgerlens.llm.components import components
from ledgerlens.llm.sieve import with_maybe
from ledgerlens.session import pin

SHINGLE_WORDS = 5
SIMILARITY = 80  # per cent
BUCKET_BITS = 7
MANTISSA_BITS = 10
# A pair at the limit shares no band with probability (1 - 0.8 ** 4) ** 32, about 5e-8.
BAND_REGISTERS = 4
# A task that compares sets all with all holds about this many shingles of either side.
CELL_SHINGLES = 400_000

_BUCKETS = 1 << BUCKET_BITS
_BANDS = _BUCKETS // BAND_REGISTERS
# For each register an order in which to look for one to copy when it is empty.
_PROBES = np.argsort(
    messages.mix(np.arange(_BUCKETS * _BUCKETS, dtype=np.uint64) + np.uint64(1))
    .reshape(_BUCKETS, _BUCKETS), axis=1)


def shingles(words: Sequence[bytes], keys: dict[bytes, int], size: int) -> np.ndarray:
    """Ascending distinct hashes of the shingles; fewer words are one shingle, none no shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(keys.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = messages.mix(own[:len(own) - size + 1] + np.uint64(size))
    for i in range(1, size):
        out = messages.chain(out, own[i:len(own) - size + 1 + i])
    return np.unique(out)


class _Keys(dict):
    def __missing__(self, word: bytes) -> int:
        k = self[word] = xxhash.xxh64_intdigest(word)
        return k


def shingle_sets(texts: Sequence[bytes | None], size: int) -> Iterator[np.ndarray]:
    tokens.forget()  # a worker may have tokenised before; the sets need its memory
    keys = _Keys()
    for text in texts:
        yield shingles((text or b"").lower().split(), keys, size)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of an ascending set: 0 for an empty bucket, else zeros and mantissa plus 1."""
    out = np.zeros(_BUCKETS, np.uint16)
    if len(hashes):
        bucket, first = np.unique(hashes >> np.uint64(64 - BUCKET_BITS), return_index=True)
        rest = (hashes[first] << np.uint64(BUCKET_BITS)) | np.uint64(1 << (BUCKET_BITS - 1))
        top = (np.frexp(rest.astype(np.float64))[1] - 1).astype(np.int64)
        shift = np.maximum(top - MANTISSA_BITS, 0).astype(np.uint64)
        mantissa = (rest >> shift) & np.uint64((1 << MANTISSA_BITS) - 1)
        zeros = np.minimum(63 - top, 62).astype(np.uint64)
        out[bucket.astype(np.int64)] = (zeros << np.uint64(MANTISSA_BITS)) + mantissa + np.uint64(1)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[float, int]:
    """Estimated similarity of two sketches of sets of n and m, and the buckets it rests on."""
    filled = int(((a > 0) | (b > 0)).sum())
    equal = int(((a == b) & (a > 0)).sum())
    ratio = max(n, m) / max(1, min(n, m))
    # Expected chance collisions of HyperMinHash (Yu and Weber, 2017), for equal-sized buckets.
    chance = 0.1699199 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    return (max(0.0, equal - chance) / filled if filled else 0.0), filled


def promising(similarity: float, filled: int, per_cent: int) -> bool:
    """Not below the limit by five standard deviations of the estimate."""
    limit = per_cent / 100
    return similarity >= limit - 5 * (limit * (1 - limit) / max(filled, 1)) ** 0.5


def row_key_of(id_column: str, text_column: str) -> Column:
    return F.xxhash64(f"`{id_column}`", f"`{text_column}`")


def sketch(docs: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    """id, __row (a key of the row's values), __n (set size), __node (set digest), __regs."""
    given = docs.select(
        F.col(f"`{id_column}`").alias("__id"), F.col(f"`{text_column}`").alias("__text"),
        row_key_of(id_column, text_column).alias("__row"))
    kind = given.schema["__id"]
    schema = T.StructType([
        kind, *row_type(__row="long", __n="long", __node="binary", __regs="binary").fields])
    numbers = row_type(__n="long", __node="binary", __regs="binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [
                (len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None,
                 registers(s).tobytes() if len(s) else None)
                for s in shingle_sets(as_bytes(batch.column("__text")), size)]
            found = to_table(rows, numbers).combine_chunks().to_batches()
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id"), batch.column("__row"), *found[0].columns],
                    names=schema.names)

    return given.mapInArrow(work, schema)


def wanted_sets(
    docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, size: int
) -> DataFrame:
    """(__node, __n, __regs, __set) of the wanted classes, from one row of each.

    Most texts belong to no wanted class; a bitmap of the wanted rows keeps them from the exchange.
    """
    texts = docs.select(
        row_key_of(id_column, text_column).alias("__r"),
        F.col(f"`{text_column}`").alias("__text"))
    texts = with_maybe(texts, "__r", wanted.select("__row"), "__maybe").filter("__maybe")
    joined = wanted.join(texts, F.col("__row") == F.col("__r")).select(
        "__node", "__n", "__regs", "__text")
    schema = row_type(__node="binary", __n="long", __regs="binary", __set="binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [messages.pack_sorted(s)
                    for s in shingle_sets(as_bytes(batch.column("__text")), size)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sets, pa.binary())], names=schema.names)

    # Identical rows share a row key; one of them is enough.
    return joined.mapInArrow(work, schema).dropDuplicates(["__node"])


def confirm(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose whole sets are similar enough."""
    side = lambda x: sets.select(
        F.col("__node").alias(f"__{x}"), F.col("__n").alias(f"__n{x}"),
        F.col("__regs").alias(f"__r{x}"))
    near = pairs.join(side("a"), F.col("a") == F.col("__a")).join(
        side("b"), F.col("b") == F.col("__b"))
    # Sets of very different sizes cannot be similar.
    near = near.filter(
        100 * F.least("__na", "__nb") >= per_cent * F.greatest("__na", "__nb"))
    pair = row_type(a="binary", b="binary")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5000):
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            stay = []
            for ra, rb, n, m in zip(c["__ra"], c["__rb"], c["__na"], c["__nb"]):
                a, b = np.frombuffer(ra, np.uint16), np.frombuffer(rb, np.uint16)
                stay.append(promising(*estimate(a, b, n, m), per_cent))
            kept = batch.filter(pa.array(stay, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("a"), kept.column("b")], names=pair.names)

    likely = near.select("a", "b", "__na", "__nb", "__ra", "__rb").mapInArrow(screen, pair)
    whole = lambda x: sets.select(
        F.col("__node").alias(f"__{x}"), F.col("__n").alias(f"__n{x}"),
        F.col("__set").alias(f"__s{x}"))
    full = likely.join(whole("a"), F.col("a") == F.col("__a")).join(
        whole("b"), F.col("b") == F.col("__b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            stay, last, a = [], None, None
            for sa, sb, n, m in zip(c["__sa"], c["__sb"], c["__na"], c["__nb"]):
                if sa is not last and sa != last:
                    last, a = sa, messages.unpack_sorted(sa, n)
                b = messages.unpack_sorted(sb, m)
                common = len(np.intersect1d(a, b, assume_unique=True))
                stay.append(100 * common >= per_cent * (n + m - common))
            kept = batch.filter(pa.array(stay, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("a"), kept.column("b")], names=pair.names)

    return full.select("a", "b", "__na", "__nb", "__sa", "__sb").mapInArrow(compare, pair)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One key per band of registers, each empty one filled from the next filled in its own order.

    Filling (optimal densification, Shrivastava, 2017) keeps the chance that two registers agree at
    the similarity of the sets, also for sets smaller than the sketch.
    """
    filled = sketch > 0
    empty = np.flatnonzero(~filled)
    source = np.arange(_BUCKETS)
    source[empty] = _PROBES[empty, filled[_PROBES[empty]].argmax(axis=1)]
    values = (source.astype(np.uint64) << np.uint64(16)) | sketch[source]
    key = np.arange(_BANDS, dtype=np.uint64)
    for row in values.reshape(_BANDS, BAND_REGISTERS).T:
        key = messages.chain(key, row)
    return key


def band_members(classes: DataFrame, per_cent: int) -> DataFrame:
    """(bucket, node, leader) of every band that two classes or more share.

    The leader is any one member, another in each bucket. A set so small that one element more or
    less passes the limit can only be linked with its equals.
    """
    schema = T.StructType([
        T.StructField("node", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [band_keys(np.frombuffer(r, np.uint16)).view(np.int64)
                    for r in batch.column("__regs").to_pylist()]
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            edges = np.arange(0, len(flat) + 1, _BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__node"), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))],
                names=schema.names)

    large = classes.filter(F.col("__n") * (100 - per_cent) >= per_cent)
    keyed = large.select("__node", "__regs").mapInArrow(work, schema).select(
        F.explode("keys").alias("bucket"), "node")
    shared = keyed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"),
        F.min(F.struct(F.xxhash64("bucket", "node"), "node"))["node"].alias("leader"),
    ).filter("size > 1")
    return keyed.join(shared, "bucket")


def compare_cell(cell: pa.Table, per_cent: int) -> list[tuple[bytes, bytes]]:
    """Links of the asking classes of a cell with its members of other components.

    Of an asking class's links into one component, one is enough.
    """
    asks = np.array(cell["asks"].to_pylist(), bool)
    node, root = cell["node"].to_pylist(), cell["root"].to_pylist()
    sizes = np.array(cell["__n"].to_pylist(), np.int64)
    packed = cell["__set"].to_pylist()
    members = np.flatnonzero(~asks)
    if not len(members):
        return []
    sets = [messages.unpack_sorted(packed[i], sizes[i]) for i in members]
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(members)), sizes[members])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    names: dict[bytes, int] = {}
    roots = np.array([names.setdefault(r, len(names)) for r in root], np.int64)
    found = []
    for q in np.flatnonzero(asks):
        own = messages.unpack_sorted(packed[q], sizes[q])
        first = np.searchsorted(every, own, "left")
        count = np.searchsorted(every, own, "right") - first
        spots = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        common = np.bincount(owner[spots], minlength=len(members))
        whole = sizes[members] + sizes[q] - common
        linked = (100 * common >= per_cent * whole) & (roots[members] != roots[q])
        hits = members[linked]
        for i in np.unique(roots[hits], return_index=True)[1]:
            found.append((node[q], node[hits[i]]))
    return found


def cross_links(placed: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Links across the components of each bucket that has several of them.

    placed: (bucket, node, root). Every class outside its bucket's largest component is compared
    with the whole bucket (and others of that component), on whole sets. Both sides are dealt into cells of bounded size, so
    rows are (class, cell), never pairs; only links leave a cell.
    """
    sized = placed.join(
        sets.select(F.col("__node").alias("k"), "__n"), F.col("node") == F.col("k")).drop("k")
    counts = sized.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "root"))["root"].alias("main"))
    # Buckets of one largest component hold much the same classes: each meets it once.
    several = sized.join(main.filter("parts > 1"), "bucket").select(
        "main", "node", "root", "__n").distinct()
    cells = lambda w: F.ceil(w / CELL_SHINGLES).cast("int")
    weights = several.groupBy(F.col("main").alias("m")).agg(
        cells(F.sum("__n")).alias("blocks"),
        cells(F.sum(F.when(F.col("root") != F.col("main"), F.col("__n")))).alias("chunks"))
    dealt = several.join(weights, F.col("main") == F.col("m")).select(
        "main", "node", "root", "blocks", "chunks")
    deal = lambda n: F.pmod(F.xxhash64("node"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    shape = lambda df: df.select(
        "main", F.col("block").cast("int"), F.col("chunk").cast("int"), "node", "root", "asks")
    members = dealt.withColumns({"block": deal(F.col("blocks")), "asks": F.lit(False)})
    members = members.withColumn("chunk", each(F.col("chunks")))
    asking = dealt.filter("root <> main").withColumns(
        {"chunk": deal(F.col("chunks")), "asks": F.lit(True)}).withColumn("block", each(F.col("blocks")))
    both = shape(members).union(shape(asking)).join(
        sets.select(F.col("__node").alias("k"), "__n", "__set"), F.col("node") == F.col("k")).drop("k")
    pair = row_type(a="binary", b="binary")

    def work(cell):
        return to_table(compare_cell(cell, per_cent), pair)

    return both.groupBy("main", "block", "chunk").applyInArrow(work, pair).distinct()


def find_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    per_cent: int = SIMILARITY,
    row_key: str | None = None,
) -> DataFrame:
    """n_shingles, component_id and kept of every document.

    A document's set holds the distinct shingles of its lower-cased words between ASCII white
    space; fewer words are one shingle, a null or empty text has none and is linked with nothing.
    Documents are linked when their sets' intersection is at least per_cent of their union.
    component_id is the least id reachable over links, the own one included; kept: it is the own.

    Repeated rows, and ties of equal sets, are one class. A row without an id belongs to its
    group but cannot name it; a group of none but such rows has no component_id, and they are
    kept. An empty table gives no rows. Only the two named columns are read. `row_key` names one more
    column to return, row_key_of(id_column, text_column), by which rows can be found again.
    """
    rows = pin(sketch(docs, id_column, text_column, shingle_words))
    classes = rows.filter("__node IS NOT NULL").groupBy("__node").agg(
        F.min("__row").alias("__row"), F.first("__n").alias("__n"),
        F.first("__regs").alias("__regs"))
    members = pin(band_members(classes, per_cent))
    nodes = members.select("node").distinct()
    wanted = pin(classes.join(nodes, F.col("__node") == F.col("node")).select(
        "__node", "__row", "__n", "__regs"))
    sets = pin(wanted_sets(docs, wanted, id_column, text_column, shingle_words))

    stars = members.filter("node <> leader").select(
        F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    links = pin(confirm(stars, sets, per_cent))
    roots = components(links)
    placed = members.select("bucket", "node").join(roots, "node", "left").select(
        "bucket", "node", F.coalesce("root", "node").alias("root"))
    more = pin(cross_links(placed, sets, per_cent))
    roots = components(links.union(more))

    whole = rows.join(roots, F.col("__node") == F.col("node"), "left").withColumn(
        "__group", F.coalesce("root", "__node"))
    least = (
        whole.filter("__group IS NOT NULL").groupBy(F.col("__group").alias("__g"))
        .agg(F.min("__id").alias("__least")))
    named = whole.join(least, F.col("__group") == F.col("__g"), "left")
    component = F.when(F.col("__group").isNull(), F.col("__id")).otherwise(F.col("__least"))
    return named.select(
        F.col("__id").alias(id_column), F.col("__n").alias("n_shingles"),
        component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept"),
        *([F.col("__row").alias(row_key)] if row_key else []))
