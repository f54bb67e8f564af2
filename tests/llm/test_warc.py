"""WARC archives: round trips, revisits, and every fault a reader has to see."""

import hashlib
import io
import struct
import uuid

import pytest
import zstandard
from hypothesis import given, settings, strategies as st

from acrely.llm import warc

PAGES = "page_id long, url string, html string, n long, digest string, first string, key string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", "f", "k", "p") for r in rows], PAGES)


def written(spark, tmp_path, rows, dictionary=b"", roll=warc.ROLL):
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archives(warc.plan_records(pages(spark, rows)), folder, dictionary, roll)
    return folder


LONG = "Grüße <p>" * 30
ODD = [(1, "http://a/1", LONG), (2, "http://a/2 x\r\ny", LONG), (2, None, LONG), (3, "", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
       (None, "u", LONG), (7, "u", "x" * 300_000), (8, "u", "WARC/1.1\r\n\r\n" * 20), (1, "http://a/1", LONG), (None, "u", "only null" * 20),
       (9, "u", "y" * 100), (10, "u", "y" * 100), (11, "u", "y" * 99), (12, "u", "y" * 99)]


def expected(rows):
    first = {}
    for key, _, html in rows:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    out = []
    for key, _, html in rows:
        body, least = (html or "").encode(), first.get(html or "")
        later = len(body) >= 100 and least is not None and key != least
        out.append((key, len(body), hashlib.sha256(body).hexdigest(), "revisit" if later else "response", least if later else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("with_dictionary, roll", [(False, 1), (True, 500), (True, warc.ROLL)])
def test_round_trip(spark, tmp_path, with_dictionary, roll):
    dictionary = b"" if not with_dictionary else zstandard.train_dictionary(2048, [f"page {i} {i * i} <p>Grüße</p>".encode() * 5 for i in range(200)]).as_bytes()
    folder = written(spark, tmp_path, ODD, dictionary, roll)
    read = warc.read_archives(spark, folder).cache()
    rows = read.collect()
    assert not any(r["error"] for r in rows) and len(rows) == len(ODD)
    files = warc.archives(folder)
    assert sum(f["records"] for f in files) == len(ODD) and (roll > 1 or len(files) == len(ODD))
    bodies = {r["record_id"]: bytes(r["payload"]) for r in rows if r["type"] == "response"}
    whole = sorted((str(r["key"]), bodies[r["refers_to"] or r["record_id"]].decode()) for r in rows)
    assert whole == sorted((str(k), h or "") for k, _, h in ODD)
    found = warc.resolve(read).collect()
    assert not any(r["error"] for r in found)
    number = lambda k: None if k is None else int(k)
    assert sorted(((number(r["key"]), r["payload_bytes"], r["payload_digest"].removeprefix("sha256:"), r["type"], number(r["refers_to"]))
                   for r in found), key=repr) == expected(ODD)


def test_empty_append_and_unlisted_files(spark, tmp_path):
    assert warc.read_archives(spark, written(spark, tmp_path, [])).count() == 0
    folder = written(spark, tmp_path, ODD[:3])
    warc.write_archives(warc.plan_records(pages(spark, ODD[3:5])), folder)
    assert warc.read_archives(spark, folder).count() == 5
    name = warc.archives(folder)[0]["name"]
    with open(f"{folder}/lost.warc.zst", "wb") as lost, open(f"{folder}/{name}", "rb") as f:  # of an attempt that was not committed
        lost.write(f.read())
    assert warc.read_archives(spark, folder).count() == 5
    assert warc.read_archives(spark, f"{folder}/{name}").count() >= 1


def test_train_dictionary(spark):
    assert warc.train_dictionary(pages(spark, ODD[:2])) == b""
    many = pages(spark, [(i, "u", f"<html><p>page {i} of {i * 7919}</p>" * 9) for i in range(300)])
    assert warc.train_dictionary(many, size=4096)[:4] == struct.pack("<I", 0xEC30A437)


# ---- the reader by itself -----------------------------------------------
GOOD = {"type": "response", "key": "1", "uri": "http://a/", "date": "2024-01-01T00:00:00Z", "payload": b"hello", "payload_bytes": 5,
        "digest": hashlib.sha256(b"hello").hexdigest(), "refers_to": None}


def frame(data, **how):
    return zstandard.ZstdCompressor(write_checksum=True, **how).compress(data)


def read(data, chunk=1 << 20, **how):
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, chunk) if n >= 0 else chunk)
    return list(warc.Frames(Slow(data), **how))


def texts(found):
    return [f if isinstance(f, bytes) else str(f) for _, f in found]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
@pytest.mark.parametrize("packed", [True, False])
def test_dictionary_in_the_leading_frame(chunk, packed):
    known = zstandard.train_dictionary(1024, [f"record {i} {i * 31}".encode() * 9 for i in range(200)])
    content = frame(known.as_bytes()) if packed else known.as_bytes()
    lead = struct.pack("<II", warc.DICTIONARY_MAGIC, len(content)) + content
    skipped = struct.pack("<II", 0x184D2A53, 5) + b"hello"
    data = lead + frame(b"record one", dict_data=known) + skipped + frame(b"record two", dict_data=known)
    assert texts(read(data, chunk)) == [b"record one", b"record two"]
    assert "asks for dictionary" in texts(read(frame(b"record one", dict_data=known)))[0]


def test_faulty_frames_and_what_follows():
    a, b, c = (frame(x * 50) for x in (b"first ", b"second ", b"third "))
    broken = bytearray(b)
    broken[-3] ^= 255  # the checksum
    for bad in (bytes(broken), b"junk", b[:-6]):
        found = texts(read(a + bad + c, 5))
        assert found[0] == b"first " * 50 and found[-1] == b"third " * 50 and isinstance(found[1], str)
    assert "ends within a frame" in texts(read(a + b[:-6]))[-1]
    assert "loose bytes" in texts(read(a + b"\x28\xb5"))[-1]
    assert "skippable" in texts(read(a + struct.pack("<II", 0x184D2A50, 99) + b"x"))[-1]
    assert "bytes" in texts(read(frame(b"x" * 10_000), largest=1000))[0]
    unsized = zstandard.ZstdCompressor(write_content_size=False).compress(b"x" * 10_000)
    assert "more than" in texts(read(unsized, largest=1000))[0]
    assert "dictionary" in texts(read(struct.pack("<II", warc.DICTIONARY_MAGIC, 8) + warc.FRAME_MAGIC + b"nope"))[0]


def test_good_records():
    found = warc.parse(warc.record_bytes(GOOD))
    assert found["payload"] == b"hello" and found["key"] == "1" and found["payload_digest"] == f"sha256:{GOOD['digest']}"
    again = warc.parse(warc.record_bytes(GOOD | {"type": "revisit", "payload": None, "refers_to": "0"}))
    assert again["payload"] is None and again["payload_bytes"] == 5 and again["refers_to"] == warc.record_id("0", GOOD["digest"])
    folded = warc.record_bytes(GOOD).replace(b"WARC-Type: response", b"warc-type:\r\n response")
    assert warc.parse(folded)["type"] == "response"
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <a>\r\nWARC-Date: d\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert warc.parse(other)["payload"] == b"abc"


@pytest.mark.parametrize("old, new, says", [
    (b"WARC/1.1", b"WARC/2.0", "not a record"), (b"WARC-Date: 2024-01-01T00:00:00Z\r\n", b"", "without warc-date"),
    (b"WARC-Date: 2024-01-01T00:00:00Z", b"WARC-Date:", "without warc-date"), (b"\r\n\r\n", b"\r\n", "the headers do not end"),
    (b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: 1", "content-length"),
    (b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: -", "content-length"),
    (b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response", "repeats"), (b"WARC-Type: response", b"WARC-Type response", "not a header"),
    (b"hello", b"jello", "digest"), (b"hello\r\n\r\n", b"hello\r\n\r ", "blank lines"), (b"WARC-Type: response", b"WARC-Type: revisit", "refers to nothing")])
def test_faulty_records(old, new, says):
    data = warc.record_bytes(GOOD)
    assert old in data
    with pytest.raises(warc.BadRecord, match=says):
        warc.parse(data.replace(old, new))


def test_faults_as_rows_or_failure(spark, tmp_path):
    path = tmp_path / "one.warc.zst"
    good = warc.record_bytes(GOOD)
    path.write_bytes(frame(good) + frame(good.replace(b"hello", b"jello")) + b"junk" + frame(good))
    rows = warc.read_archives(spark, str(path), on_error="row").orderBy("offset").collect()
    assert [r["error"] is None for r in rows] == [True, False, False, True]
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, f"file://{path}").collect()


def test_revisits_that_lead_nowhere(spark, tmp_path):
    revisit = GOOD | {"type": "revisit", "payload": None, "key": "2", "refers_to": "1"}
    for name, records in (("lone", [revisit]), ("short", [GOOD, revisit | {"payload_bytes": 4}])):
        path = tmp_path / f"{name}.warc.zst"
        path.write_bytes(b"".join(frame(warc.record_bytes(r)) for r in records))
        errors = [r["error"] for r in warc.resolve(warc.read_archives(spark, str(path)).cache()).collect() if r["type"] == "revisit"]
        assert errors == [{"lone": "the response is missing", "short": "the response has another length"}[name]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.none() | st.text(), st.none() | st.text(), st.binary(max_size=300)), max_size=6), st.integers(1, 50))
def test_any_key_address_and_body(rows, chunk):
    planned = [{"type": "response", "key": k, "uri": u, "date": "d", "payload": b, "payload_bytes": len(b), "digest": hashlib.sha256(b).hexdigest(),
                "refers_to": None} for k, u, b in rows if all(x is None or x.isprintable() or x.encode("utf-8", "ignore").decode() == x for x in (k, u))]
    found = [warc.parse(f) for _, f in read(b"".join(frame(warc.record_bytes(r)) for r in planned), chunk)]
    assert [(f["key"], f["payload"]) for f in found] == [(r["key"], r["payload"]) for r in planned]
