"""WARC: exact round trip, revisits, and recovery of the records around damage."""

import base64
import gzip
import hashlib
import io
import random

import pytest

from ledgerlens.llm import warc


def rows_of(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


def record(n, payload, compress):
    import hashlib

    digest = hashlib.sha1(payload).hexdigest()
    return warc.record_bytes(
        [("WARC-Type", "response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Row-Key", str(n))],
        payload, compress)


PAYLOADS = [b"", b"a\r\n\r\nb", b"x" * 3_000_000, bytes(range(256)) * 40, b"WARC/1.1 \x1f\x8b\x08 in a text"]


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(compress):
    data = b"".join(record(n, p, compress) for n, p in enumerate(PAYLOADS))
    got = rows_of(data)
    assert [r[3] for r in got] == PAYLOADS and all(r[4] is None for r in got)
    assert got[-1][0] + got[-1][1] == len(data)
    assert rows_of(b"") == []


@pytest.mark.parametrize("compress", [True, False])
def test_damage_is_one_gap_and_later_records_survive(compress):
    parts = [record(n, p, compress) for n, p in enumerate(PAYLOADS)]
    hurt = bytearray(parts[3])
    hurt[len(hurt) // 2] ^= 0xFF
    junk = b"\x1f\x8b\x08 not a member, WARC/1.0\r\n nor this"
    data = parts[0] + junk + parts[1] + parts[2] + bytes(hurt) + parts[4] + parts[0][:20]
    got = rows_of(data)
    assert [r[3] for r in got if r[4] is None] == [PAYLOADS[0], PAYLOADS[1], PAYLOADS[2], PAYLOADS[4]]
    gaps = [(r[0], r[1]) for r in got if r[4]]
    at = len(parts[0])
    assert gaps[0] == (at, len(junk))
    assert gaps[1] == (len(data) - 20 - len(parts[4]) - len(hurt), len(hurt))
    assert gaps[2] == (len(data) - 20, 20)
    assert sum(r[1] for r in got) == len(data)


def test_a_wrong_length_does_not_swallow_the_rest():
    good = record(1, b"good", False)
    bad = good.replace(b"Content-Length: 4", b"Content-Length: 999999999999")
    assert [r[3] for r in rows_of(bad + good)] == [None, b"good"]


@pytest.mark.parametrize("compress", [True, False])
def test_pages_come_back(spark, tmp_path, compress):
    big, small = "é" * 600, "é" * 400
    rows = [(1, "u", big, "x"), (2, "u", small, "x"), (3, "u", big, "x"), (4, None, small, None),
            (5, "u\r\nv", None, "x"), (None, "u", big, "x"), (7, "u", big, "x"), (7, "u", big, "x"),
            (8, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    archives = warc.write_archives(
        pages, str(tmp_path), compress=compress, archive_bytes=2000)
    assert archives.count() > 1
    got = [r.asDict() for r in warc.read_archives(spark, archives).collect()]
    assert all(r["quarantined"] is None for r in got) and len(got) == len(rows)
    seen = sorted(
        (r["headers"]["x-row-key"], r["headers"]["warc-type"],
         r["headers"].get("x-refers-to-key"), bytes(r["payload"]).decode()) for r in got)
    assert seen == sorted([
        ("1", "revisit", "7", ""), ("3", "revisit", "7", ""), ("7", "response", None, big),
        ("7", "response", None, big), ("", "response", None, big), ("2", "response", None, small),
        ("4", "response", None, small), ("5", "response", None, ""), ("8", "response", None, "")])


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc.write_archives(pages, str(tmp_path))
    assert warc.read_archives(spark, archives).count() == 0


def http_record(n, body, value, extra=b""):
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n" + extra + b"\r\n" + body
    return block, warc.record_bytes(
        [("WARC-Type", "response"), ("Content-Type", "application/http; msgtype=response"),
         ("WARC-Payload-Digest", value), ("X-Row-Key", str(n))], block, False)


def test_digests_of_usual_archives():
    body = b"<html>a\r\n\r\nb</html>"
    sha1 = hashlib.sha1(body)
    base32 = base64.b32encode(sha1.digest()).decode()
    good = [f"sha1:{base32}", f"SHA1:{base32.lower()}", f"sha1:{sha1.hexdigest().upper()}",
            "sha256:" + hashlib.sha256(body).hexdigest(),
            "sha-256:" + base64.b32encode(hashlib.sha256(body).digest()).decode().rstrip("="),
            "blake3:abc", "sha1:odd-form", "nothing"]
    blocks, records = zip(*[http_record(i, body, v) for i, v in enumerate(good)])
    assert [(r[3], r[4]) for r in rows_of(b"".join(records))] == [(b, None) for b in blocks]
    sent = b"4\r\n<htm\r\n" + b"%x\r\n" % (len(body) - 4) + body[4:] + b"\r\n0\r\n\r\n"
    assert rows_of(http_record(1, sent, good[0], b"Transfer-Encoding: chunked\r\n")[1])[0][4] is None
    for value in good[:5]:
        assert rows_of(http_record(1, body + b"!", value)[1])[0][4] == "payload digest differs"


def test_one_member_of_many_records():
    blobs = [random.Random(n).randbytes(3000 if n != 20 else 2_500_000) for n in range(60)]
    raw = b"".join(record(n, p, False) for n, p in enumerate(blobs))
    data = gzip.compress(raw)
    after = record(99, b"after", True)
    got = rows_of(data + after)
    assert [r[3] for r in got] == [*blobs, b"after"] and all(r[4] is None for r in got)
    assert sum(r[1] for r in got) == len(data + after)
    assert [r[3] for r in rows_of(gzip.compress(raw[:7000]))] [:2] == [*blobs[:2]]
    # A record that fails its check inside the member costs no other one.
    at = raw.index(blobs[5])
    hurt = gzip.compress(raw[:at] + b"?" * 9 + raw[at + 9:])
    got = rows_of(hurt + after)
    assert [r[3] for r in got if r[4] is None] == [*blobs[:5], *blobs[6:], b"after"]
    assert [r[4] for r in got if r[4]] == ["payload digest differs"]
    # A cut member gives the records in front of the cut; the next member follows.
    for cut in (len(data) // 2, len(data) - 5, 9000, 5000):
        got = rows_of(data[:cut] + after)
        kept = [r[3] for r in got if r[4] is None]
        assert kept[-1] == b"after" and kept[:-1] == blobs[:len(kept) - 1]
        assert len(kept) - 1 >= (cut - 5000) // 3100 if cut < 60_000 else len(kept) > 20
        assert sum(r[1] for r in got) == cut + len(after)


@pytest.mark.parametrize("compress", [True, False])
def test_long_headers(compress):
    long = warc.record_bytes([("WARC-Type", "response"), ("X-Long", "y" * 3_000_000)], b"z", compress)
    assert [(r[3], r[4]) for r in rows_of(long + record(1, b"a", compress))] == [(b"z", None), (b"a", None)]
