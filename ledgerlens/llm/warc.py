"""WARC archives: a writer that turns repeats into revisits, and a reader that salvages records.

Files are reached through Arrow's file systems, by URI, from the tasks: an archive is written by
one task and read by one task, record by record.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.arrow import slices

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64_000_000
SALTS = 16
CHUNK = 1 << 20
# Compressed bytes inflated at once.
SLICE = 1 << 14
VERSION_LINE = 20

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1."
DIGESTS = ("md5", "sha1", "sha256", "sha512")
GZIP = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("records", T.LongType()),
    T.StructField("bytes", T.LongType()),
])
RECORDS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("payload", T.BinaryType()),
    T.StructField("quarantined", T.StringType()),
])


def open_fs(uri: str):
    """The file system and path of a URI; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_bytes(headers: list[tuple[str, str]], block: bytes, compress: bool) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    raw = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    if not compress:
        return raw
    gz = zlib.compressobj(6, wbits=31)
    return gz.compress(raw) + gz.flush()


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def capture(row: dict, compress: bool) -> bytes:
    """The record of one row; a revisit has no block, and names the page that holds the payload."""
    revisit = row["refers"] is not None
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, row['key'])}>"),
        ("WARC-Target-URI", _one_line(row["uri"])),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
        ("X-Row-Key", row["key"]),
        ("X-Payload-Length", str(row["size"])),
    ]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Key", row["refers"])]
    return record_bytes(headers, b"" if revisit else row["payload"], compress)


def with_revisits(
    pages: DataFrame, key: str, payload: str, uri: str, min_bytes: int
) -> DataFrame:
    """key, uri, payload (null as empty), size, digest, and the key of the row a revisit refers to.

    Of rows with equal payloads of min_bytes or more the one with the largest key keeps it. A row
    without a key is never a revisit and never referred to.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        F.col(f"`{key}`").alias("__key"), F.col(f"`{uri}`").cast("string").alias("uri"),
        body.alias("payload"),
        # Any deterministic spread of equal payloads over a few tasks will do.
        F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(SALTS)).alias("__salt"))
    rows = rows.withColumns({"size": F.length("payload").cast("bigint"), "digest": F.sha1("payload")})
    shared = (
        rows.filter(F.col("__key").isNotNull() & (F.col("size") >= min_bytes))
        .groupBy(F.col("digest").alias("__d"))
        .agg(F.max("__key").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .filter("__n > 1")
        .select("__d", "__first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__s")))
    joined = rows.join(shared, (rows["digest"] == F.col("__d")) & (rows["__salt"] == F.col("__s")),
                       "left")
    repeat = (F.col("__key") < F.col("__first")) & (F.col("size") >= min_bytes)
    return joined.select(
        F.coalesce(F.col("__key").cast("string"), F.lit("")).alias("key"), "uri", "payload", "size",
        "digest", F.when(repeat, F.col("__first").cast("string")).alias("refers"))


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    payload: str = "html",
    uri: str = "url",
    min_bytes: int = MIN_REVISIT_BYTES,
    compress: bool = True,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write one record per row below the folder; returns the list of archives once all are there.

    Each record is a gzip member of its own (compress=False: plain). Rows whose payload (at least
    min_bytes) another row with a larger key holds become revisits. A null payload is an empty
    one, a null key an empty key; rows repeated with their key are each a response; an empty table
    gives no archive. Payloads are whole whatever their size. A task that runs twice
    writes files of other names, of which the list holds one set.
    """
    rows = with_revisits(pages, key, payload, uri, min_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(folder)
        system.create_dir(path, recursive=True)
        done, out, name, records, size = [], None, "", 0, 0
        for batch in slices(batches, 100):
            for row in batch.to_pylist():
                data = capture(row, compress)
                if out is None or size + len(data) > archive_bytes:
                    if out is not None:
                        out.close()
                        done.append((name, records, size))
                    name = f"{uuid.uuid4().hex}.warc{'.gz' * compress}"
                    out, records, size = system.open_output_stream(
                        f"{path}/{name}", compression=None), 0, 0
                out.write(data)
                records, size = records + 1, size + len(data)
        if out is not None:
            out.close()
            done.append((name, records, size))
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{n}" for n in names], pa.string()),
             pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
            names=["path", "records", "bytes"])

    listed = f"{folder}/_archives"
    rows.mapInArrow(write, FILES).write.mode("overwrite").parquet(listed)
    return pages.sparkSession.read.schema(FILES).parquet(listed)


class Window:
    """A file read forward in chunks: the bytes from `start` on that are still needed."""

    def __init__(self, stream, size: int) -> None:
        self.stream, self.size = stream, size
        self.start, self.data, self.ended = 0, b"", False

    @property
    def end(self) -> int:
        return self.start + len(self.data)

    def more(self) -> bool:
        chunk = b"" if self.ended else self.stream.read(CHUNK)
        self.ended = self.ended or not chunk
        self.data += chunk
        return bool(chunk)

    def need(self, end: int) -> bool:
        """Whether the file reaches `end`; reads as far as needed."""
        if end > self.end:
            parts, have = [self.data], self.end
            while have < end and not self.ended:
                chunk = self.stream.read(max(CHUNK, end - have))
                self.ended = not chunk
                parts.append(chunk)
                have += len(chunk)
            self.data = b"".join(parts)
        return self.end >= end

    def at(self, start: int, end: int) -> bytes:
        return self.data[start - self.start:end - self.start]

    def forget(self, before: int) -> None:
        self.data, self.start = self.data[before - self.start:], before

    def find(self, mark: bytes, start: int, limit: int) -> int:
        """Offset of the next mark from `start` on, within `limit` bytes, or -1."""
        at = start
        while True:
            found = self.data.find(mark, at - self.start)
            if found >= 0:
                return self.start + found
            at = max(at, self.end - len(mark) + 1)
            if at - start > limit or not self.more():
                return -1


class Broken(Exception):
    """Why the bytes at an offset are no valid record, and where to search on if not one later."""

    def __init__(self, why: str, resume: int | None = None) -> None:
        super().__init__(why)
        self.resume = resume


def digest_bytes(value: str) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a digest in hex or base32; null for a form or algorithm not known."""
    name, colon, text = value.partition(":")
    name, text = name.strip().lower().replace("-", ""), text.strip()
    if not colon or name not in DIGESTS:
        return None
    size = hashlib.new(name).digest_size
    try:
        if len(text) == 2 * size:
            return name, bytes.fromhex(text)
        bare = text.rstrip("=").upper()
        raw = base64.b32decode(bare + "=" * (-len(bare) % 8))
    except (ValueError, binascii.Error):
        return None
    return (name, raw) if len(raw) == size else None


def http_bodies(block: bytes) -> list[bytes]:
    """What the payload digest of an HTTP block may be of: the body behind the header as sent, and,
    as some writers have it, the body freed of its chunks or the whole block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return [b"", block]
    out = [body, block]
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        parts, at = [], 0
        while size := re.match(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n", body[at:at + 1000]):
            n, at = int(size[1], 16), at + size.end()
            if n == 0:
                out.append(b"".join(parts))
                break
            parts.append(body[at:at + n])
            at += n + 2
    return out


def check_digest(headers: dict[str, str], block: bytes) -> None:
    """Compare the payload digest with the block, or with the HTTP body in it; unknown forms and
    records without a payload of their own (revisits, segments) are not checked."""
    want = digest_bytes(headers.get("warc-payload-digest", ""))
    if want is None or headers.get("warc-type") in ("revisit", "continuation"):
        return
    if "warc-segment-number" in headers:
        return
    kind = headers.get("content-type", "").partition(";")[0].strip().lower()
    bodies = http_bodies(block) if kind == "application/http" else [block]
    if all(hashlib.new(want[0], b).digest() != want[1] for b in bodies):
        raise Broken("payload digest differs")


def parse(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one whole record, checked for length and digest."""
    head, found, rest = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(VERSION):
        raise Broken("no version line and header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("malformed header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = (
            value.decode("utf-8", "replace").strip())
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Broken("no content length")
    if len(rest) < int(length) + 4:
        raise Broken("record is cut short")
    if rest[int(length):] != b"\r\n\r\n":
        raise Broken("record does not end after its content")
    payload = rest[:int(length)]
    check_digest(headers, payload)
    return headers, payload


class Inflated:
    """The content of the gzip member at an offset, read forward; error says why it ends early."""

    def __init__(self, window: Window, at: int) -> None:
        self.window, self.begin, self.slice, self.pos = window, at, at, at
        self.inflate, self.error = zlib.decompressobj(wbits=31), ""

    def read(self, _: int) -> bytes:
        while not self.inflate.eof and not self.error:
            if self.pos == self.window.end and not self.window.more():
                self.error = "compressed member is cut short"
                break
            self.slice = self.pos
            piece = self.window.at(self.pos, min(self.pos + SLICE, self.window.end))
            before = self.inflate.copy()
            try:
                out = self.inflate.decompress(piece)
                self.pos += len(piece) - len(self.inflate.unused_data)
            except zlib.error as e:
                self.error, out = f"compressed member: {e}", self.until_damage(before, piece)
            if out:
                return out
        return b""

    @staticmethod
    def until_damage(inflate, piece: bytes) -> bytes:
        parts = []
        try:
            for k in range(len(piece)):
                parts.append(inflate.decompress(piece[k:k + 1]))
        except zlib.error:
            pass
        return b"".join(parts)


def member(
    window: Window, at: int
) -> Iterator[tuple[int, dict | None, bytes | None, str | None]]:
    """(offset read to, headers, payload, None) per record of the gzip member at an offset, and
    (offset, None, None, reason) per gap between them.

    Each waits for the next, so that the last one is given only if the member ends well.
    """
    inflated = Inflated(window, at)
    text, held, given = Window(inflated, math.inf), None, False
    if not text.need(len(VERSION)) or text.at(0, len(VERSION)) != VERSION:
        raise Broken(inflated.error or "member holds no record")
    for _, _, headers, payload, why in salvage(text.stream, math.inf, [VERSION], text):
        if held is not None:
            yield held
            given = True
            # The member is one: after damage the search goes on where it was found.
            if inflated.slice - window.start > CHUNK:
                window.forget(inflated.slice)
        held = inflated.slice, headers, payload, why
    if inflated.error:
        raise Broken(inflated.error, max(inflated.slice, at + 1) if given else None)
    yield inflated.pos, *held[1:]


def plain(window: Window, at: int) -> tuple[bytes, int]:
    """The whole uncompressed record at an offset, and the offset after it."""
    length, line = 0, at
    while True:
        end = window.find(b"\r\n", line, VERSION_LINE if line == at else window.size)
        if end < 0:
            raise Broken("header is cut short")
        if end == line:
            break
        name, colon, value = window.at(line, end).partition(b":")
        if line == at and end - at > VERSION_LINE or line > at and not colon:
            raise Broken("malformed header line")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            length = int(value)
        line = end + 2
    stop = end + 2 + length + 4
    if stop > window.size or not window.need(stop):
        raise Broken("record is cut short")
    return window.at(at, stop), stop


def next_candidate(window: Window, at: int, marks: list[bytes]) -> int:
    """The nearest later place where a member or a version line may start, or -1."""
    while True:
        found = [window.data.find(mark, at - window.start) for mark in marks]
        if max(found) >= 0:
            return window.start + min(f for f in found if f >= 0)
        at = max(at, window.end - len(VERSION) + 1)
        window.forget(at)
        if not window.more():
            return -1


def salvage(
    stream, size: float, marks: list[bytes] = [GZIP, VERSION], window: Window | None = None
) -> Iterator[tuple[int, int, dict | None, bytes | None, str | None]]:
    """(offset, length, headers, payload, None) per valid record, and per gap between valid records
    (offset, length, None, None, reason).

    After a failed check the search goes on one byte later for the next member or version line
    that begins a valid record; the bytes between are one gap. Memory holds one record. Of a member
    of several records each has the bytes read since the one before: none, if they were read at
    once, so that only the first can be read again from its offset. Records in front of damage
    in such a member are given.
    """
    window, at, gap, why = window or Window(stream, size), 0, None, ""
    while window.need(at + 1):
        window.forget(at)
        try:
            lead = window.at(at, at + 3) if window.need(at + 3) else b""
            if lead == GZIP and GZIP in marks:
                found = member(window, at)
            elif window.need(at + len(VERSION)) and window.at(at, at + len(VERSION)) == VERSION:
                block, end = plain(window, at)
                found = [(end, *parse(block), None)]
            else:
                raise Broken("neither a member nor a version line")
            for end, headers, payload, bad in found:
                if bad:
                    gap, why = (at, bad) if gap is None else (gap, why)
                else:
                    if gap is not None:
                        yield gap, at - gap, None, None, why
                        gap = None
                    yield at, end - at, headers, payload, None
                at = end
        except Broken as e:
            gap, why = (at, str(e)) if gap is None else (gap, why)
            later = next_candidate(window, at + 1 if e.resume is None else e.resume, marks)
            at = later if later >= 0 else window.end
    if gap is not None:
        yield gap, window.end - gap, None, None, why


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """Every valid record of the archives, and a row with a reason for every byte gap.

    `archives` has a column path. Columns: path, offset, length, headers (lower-case names),
    payload, quarantined (null for records; else why the first bytes of the gap are no record).
    Plain and compressed records may be mixed. An empty archive gives no row; one without any
    valid record a single gap; an archive listed twice is read twice; a null path is skipped.
    """
    paths = archives.select("path").filter("path IS NOT NULL")
    # One task per archive, about: listing them is cheap, reading is not.
    tasks = max(1, min(paths.count(), 100_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = open_fs(path)
                with system.open_input_file(name) as stream:
                    rows, size = [], 0
                    for offset, length, headers, payload, why in salvage(stream, stream.size()):
                        rows.append((path, offset, length, headers and list(headers.items()),
                                     payload, why))
                        size += len(payload or b"") + 500
                        if size > 4_000_000:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    return paths.repartition(tasks).mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    columns = list(zip(*rows)) or [()] * len(RECORDS)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, RECORDS)],
        names=RECORDS.names)
