"""WARC archives in Zstandard: written, read back, and validated.

An archive (`*.warc.zst`) begins with a skippable frame that holds the compression dictionary, itself
compressed or raw, and has one Zstandard frame per record after that, so any record can be decoded alone.
`WarcSource` is a Spark data source for folders of such archives: `read.format("warc_zst").load(folder)`
and `write.format("warc_zst").mode("append").save(folder)`.

The reader takes a file in chunks. It loads the dictionary from the leading frame, skips other skippable
frames, decodes one frame per record and holds one record at a time. Of every record it checks the frame's
stated size and checksum, the version, the mandatory headers, that no header but WARC-Concurrent-To
repeats, the content length against the block, the blank lines at the end, the length an HTTP head states, and
SHA-1 or SHA-256 digests of block and payload. With `on_error` "fail" the first fault ends the job; with "row" it
becomes a row whose `error` says what is wrong, and reading goes on at the next frame that can be found.

A writing task rolls to a new file at `roll` bytes. Names are unique to the attempt, and only files that
the committed attempts report enter the folder's list, which replaces the old one in one move; files of
lost or repeated attempts are not read. Without a list every archive in the folder is read.

Records with equal payloads: the smallest key's is the response, later ones are revisits that refer to its record
and carry no payload (`plan_records`). `resolve` follows the reference after reading.

Defined cases: a null body is an empty payload, always a response; a null address or key leaves out its
header; keys are percent-encoded and decoded again, addresses encoded where a sign is not allowed in one; rows with the smallest key and equal
payload are each a response and share their record identifier; a null key is never the smallest unless all are null; an empty
table writes no archive, and an empty folder has no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from acrely.llm.common import sampled

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LIST = "_archives.json"
KEY = "X-Record-Key"
URI_SIGNS = "!#$%&'()*+,/:;=?@[]~"   # kept as they are in an address

LEAST = 100                 # smaller payloads are never revisits
ROLL = 64 << 20             # compressed bytes of one archive
LARGEST = 1 << 30           # bytes of one decoded record
CHUNK = 1 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 1000          # rows the dictionary is trained on, at most SAMPLE_BYTES of each
SAMPLE_BYTES = 8 << 10

WRITTEN = "key string, uri string, date string, type string, payload binary, payload_bytes long, digest string, refers_to string"
READ = ("file string, offset long, record_id string, type string, uri string, date string, key string, refers_to string, "
        "content_length long, payload_bytes long, payload_digest string, payload binary, error string")


class BadRecord(ValueError):
    """What is wrong with a frame or a record."""


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or an absolute path, as Hadoop or Arrow write them."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


# ---- frames -------------------------------------------------------------
class Frames:
    """(offset, decoded bytes or BadRecord) of every record frame of a stream, in bounded memory."""

    def __init__(self, stream, largest: int = LARGEST):
        self.stream, self.largest = stream, largest
        self.buffer, self.at = b"", 0
        self.decoder = zstandard.ZstdDecompressor()
        self.has_dictionary = False

    def _fill(self, size: int) -> bool:
        """Hold `size` bytes; false if the stream ends before."""
        parts, held = [self.buffer], len(self.buffer)
        while held < size and (more := self.stream.read(max(CHUNK, size - held))):
            parts.append(more)
            held += len(more)
        self.buffer = b"".join(parts) if len(parts) > 1 else self.buffer
        return held >= size

    def _drop(self, size: int) -> None:
        self.buffer, self.at = self.buffer[size:], self.at + size

    def _skip(self, size: int) -> None:
        while size:
            step = min(size, CHUNK)
            if not self._fill(step):
                self._drop(len(self.buffer))
                raise BadRecord("the file ends within a skippable frame")
            self._drop(step)
            size -= step

    def _skippable(self) -> None:
        if not self._fill(8):
            self._drop(len(self.buffer))
            raise BadRecord("the file ends within a skippable frame")
        magic, size = struct.unpack("<II", self.buffer[:8])
        leading = self.at == 0 and magic == DICTIONARY_MAGIC
        self._drop(8)
        if not leading:
            return self._skip(size)
        if size > self.largest or not self._fill(size):
            raise BadRecord("the dictionary is cut off")
        content = self.buffer[:size]
        self._drop(size)
        try:
            if content.startswith(FRAME_MAGIC):
                content = zstandard.ZstdDecompressor().decompress(content, max_output_size=self.largest)
            self.decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        except zstandard.ZstdError as e:
            raise BadRecord(f"the dictionary cannot be read: {e}") from e
        self.has_dictionary = True

    def _record(self) -> bytes:
        """Decode the frame at the front of the buffer and drop it."""
        self._fill(18)  # the longest frame header
        try:
            stated = zstandard.get_frame_parameters(self.buffer[:18])
        except zstandard.ZstdError as e:
            raise BadRecord(f"no frame header: {e}") from e
        if stated.dict_id and not self.has_dictionary:
            raise BadRecord(f"the frame asks for dictionary {stated.dict_id}, the archive has none")
        size = None if stated.content_size == zstandard.CONTENTSIZE_UNKNOWN else stated.content_size
        if (size or 0) > self.largest:
            raise BadRecord(f"a record of {size} bytes")
        work, out, held, taken = self.decoder.decompressobj(), [], 0, 0
        piece, start, read = self.buffer, self.at, [self.buffer]
        try:
            while True:
                for i in range(0, len(piece), CHUNK):  # small steps, so that a bomb is noticed early
                    step = piece[i:i + CHUNK]
                    made = work.decompress(step)
                    taken += len(step) - (len(work.unused_data) if work.eof else 0)
                    held += len(made)
                    out.append(made)
                    if held > self.largest:
                        self.buffer = b"".join(read)
                        raise BadRecord(f"a record of more than {self.largest} bytes")
                    if work.eof:
                        rest = work.unused_data + piece[i + CHUNK:]
                        self.buffer, self.at = rest, start + taken
                        if size is not None and held != size:
                            raise BadRecord(f"{held} bytes where the frame states {size}")
                        return b"".join(out)
                if not (piece := self.stream.read(CHUNK)):
                    self.buffer, self.at = b"", start + taken
                    raise BadRecord("the file ends within a frame")
                read.append(piece)
        except zstandard.ZstdError as e:
            self.buffer = b"".join(read)  # a frame may begin anywhere in it
            raise BadRecord(f"the frame cannot be decoded: {e}") from e

    def _find_next(self) -> bool:
        """After a fault, go to the next frame magic."""
        self._drop(min(1, len(self.buffer)))
        while self._fill(4):
            found = self.buffer.find(FRAME_MAGIC)
            if found >= 0:
                self._drop(found)
                return True
            self._drop(len(self.buffer) - 3)
        self._drop(len(self.buffer))
        return False

    def __iter__(self) -> Iterator[tuple[int, bytes | BadRecord]]:
        while self._fill(1):
            offset = self.at
            try:
                if not self._fill(4):
                    raise BadRecord("loose bytes at the end")
                if self.buffer.startswith(FRAME_MAGIC):
                    yield offset, self._record()
                elif self.buffer[1:4] == b"\x2a\x4d\x18" and self.buffer[0] >> 4 == 5:
                    self._skippable()
                else:
                    raise BadRecord("no frame begins here")
            except BadRecord as fault:
                yield offset, fault
                if self.at == offset and not self._find_next():
                    return


# ---- records ------------------------------------------------------------
def _header_lines(head: bytes, what: str) -> dict[str, str]:
    found: dict[str, str] = {}
    name = None
    for line in head.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:  # a folded line
            found[name] = f"{found[name]} {line.decode('utf-8', 'replace').strip()}".strip()
            continue
        before, colon, value = line.partition(b":")
        name = before.decode("utf-8", "replace").strip().lower()
        if not colon or not name:
            raise BadRecord(f"not a header of the {what}: {line[:80]!r}")
        if what == "record" and name in found and name != "warc-concurrent-to":
            raise BadRecord(f"{name} repeats")
        found[name] = value.decode("utf-8", "replace").strip(" \t")
    return found


def _number(value: str, what: str) -> int:
    if not (value.isascii() and value.isdigit()):
        raise BadRecord(f"{what} is {value!r}")
    return int(value)


def _check_digest(stated: str | None, data: bytes, what: str) -> None:
    if not stated:
        return
    kind, _, value = stated.partition(":")
    if kind.lower() == "sha256":
        same = value.lower() in (hashlib.sha256(data).hexdigest(), base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=").lower())
    elif kind.lower() == "sha1":
        same = value.lower() in (hashlib.sha1(data).hexdigest(), base64.b32encode(hashlib.sha1(data).digest()).decode().lower())
    else:
        return
    if not same:
        raise BadRecord(f"the {what} digest does not match")


def parse(data: bytes) -> dict:
    """The validated record of one decoded frame."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version not in VERSIONS:
        raise BadRecord(f"not a record: {version[:20]!r}")
    if not blank:
        raise BadRecord("the headers do not end")
    headers = _header_lines(lines, "record")
    if lacking := [h for h in MANDATORY if not headers.get(h)]:
        raise BadRecord(f"without {', '.join(lacking)}")
    length = _number(headers["content-length"], "content-length")
    if len(rest) != length + 4:
        raise BadRecord(f"content-length {length}, block of {len(rest) - 4}")
    if not rest.endswith(b"\r\n\r\n"):
        raise BadRecord("no blank lines after the block")
    block, kind = rest[:length], headers["warc-type"]
    _check_digest(headers.get("warc-block-digest"), block, "block")
    payload, stated = block, None
    if headers.get("content-type", "").startswith("application/http") and (block or kind != "revisit"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise BadRecord("the HTTP head does not end")
        fields = _header_lines(http.partition(b"\r\n")[2], "HTTP message") if b"\r\n" in http else {}
        if "content-length" in fields and "transfer-encoding" not in fields:
            stated = _number(fields["content-length"], "HTTP content-length")
    digest = headers.get("warc-payload-digest")
    if kind == "revisit":
        if not headers.get("warc-refers-to"):
            raise BadRecord("a revisit that refers to nothing")
        payload_bytes, payload = stated, None
    else:
        if stated is not None and stated != len(payload):
            raise BadRecord(f"HTTP content-length {stated}, payload of {len(payload)}")
        _check_digest(digest, payload, "payload")
        payload_bytes, digest = len(payload), "sha256:" + hashlib.sha256(payload).hexdigest()
    key = headers.get(KEY.lower())
    return {
        "record_id": headers["warc-record-id"], "type": kind, "uri": headers.get("warc-target-uri"), "date": headers["warc-date"],
        "key": None if key is None else unquote(key), "refers_to": headers.get("warc-refers-to"), "content_length": length,
        "payload_bytes": payload_bytes, "payload_digest": digest, "payload": payload}


def record_id(key: str | None, digest: str) -> str:
    name = f"{'-' if key is None else '+' + key}\n{digest}".encode()
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name).digest()[:16], version=5)}>"


def record_bytes(row: dict) -> bytes:
    """One WARC record of a planned row: an HTTP response, or a revisit with its head only."""
    revisit = row["type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + row["payload"]
    lines = [
        "WARC/1.1", f"WARC-Type: {row['type']}", f"WARC-Record-ID: {record_id(row['key'], row['digest'])}", f"WARC-Date: {row['date']}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{row['digest']}"]
    if row["uri"]:
        # Addresses are not decoded on the way back, so what is encoded in them already stays as it is.
        lines.append(f"WARC-Target-URI: {quote(row['uri'], safe=URI_SIGNS)}")
    if row["key"] is not None:
        lines.append(f"{KEY}: {quote(row['key'])}")
    if revisit:
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {record_id(row['refers_to'], row['digest'])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


# ---- the data source ----------------------------------------------------
@dataclass
class _Archive(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


def archives(folder: str) -> list[dict]:
    """The archives of a folder with records and bytes: those its list names, or all if it has none; or the one file."""
    fs, path = file_system(folder)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [{"name": "", "bytes": info.size, "records": None}]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(folder)
    if fs.get_file_info(f"{path}/{LIST}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{path}/{LIST}") as f:
            return json.loads(f.read())
    found = fs.get_file_info(pafs.FileSelector(path))
    return sorted(({"name": f.base_name, "bytes": f.size, "records": None} for f in found if f.base_name.endswith(".warc.zst")),
                  key=lambda f: f["name"])


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payloads: bool, fail: bool, largest: int):
        self.folder, self.payloads, self.fail, self.largest = folder, payloads, fail, largest

    def partitions(self) -> Sequence[InputPartition]:
        return [_Archive(f"{self.folder}/{f['name']}".rstrip("/")) for f in archives(self.folder)] or [_Archive("")]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        schema = pa.schema([
            (f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in READ.split(", ")])
        fs, path = file_system(partition.path)
        rows, held = [], 0
        with fs.open_input_stream(path, compression=None) as stream:
            for offset, found in Frames(stream, self.largest):
                row = dict.fromkeys(schema.names) | {"file": os.path.basename(path), "offset": offset}
                try:
                    if isinstance(found, BadRecord):
                        raise found
                    row |= parse(found)
                except BadRecord as fault:
                    if self.fail:
                        raise BadRecord(f"{partition.path} at {offset}: {fault}") from fault
                    row["error"] = str(fault)
                if not self.payloads:
                    row["payload"] = None
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) == 1000 or held > 4 * CHUNK:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool, dictionary: bytes, roll: int):
        self.folder, self.overwrite, self.dictionary, self.roll = folder, overwrite, dictionary, roll

    def _lead(self) -> tuple[bytes, zstandard.ZstdCompressor]:
        if not self.dictionary:
            return b"", zstandard.ZstdCompressor(write_checksum=True)
        packed = zstandard.ZstdCompressor().compress(self.dictionary)
        known = zstandard.ZstdCompressionDict(self.dictionary)
        return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed, zstandard.ZstdCompressor(dict_data=known, write_checksum=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = file_system(self.folder)
        lead, encoder = self._lead()
        done: list[dict] = []
        out, now = None, {}
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    now = {"name": f"{uuid.uuid4().hex}.warc.zst", "bytes": len(lead), "records": 0}
                    out = fs.open_output_stream(f"{folder}/{now['name']}", compression=None)
                    out.write(lead)
                frame = encoder.compress(record_bytes(row))
                out.write(frame)
                now["bytes"] += len(frame)
                now["records"] += 1
                if now["bytes"] >= self.roll:
                    out.close()
                    done.append(now)
                    out = None
        if out is not None:
            out.close()
            done.append(now)
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, folder = file_system(self.folder)
        listed = fs.get_file_info(f"{folder}/{LIST}").type == pafs.FileType.File
        before = [] if self.overwrite or not listed else archives(self.folder)
        now = before + sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
        draft = f"{folder}/_{uuid.uuid4().hex}.json"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps(now).encode())
        fs.move(draft, f"{folder}/{LIST}")

    def abort(self, messages: list[_Written | None]) -> None:
        """What failed tasks wrote is in no list and is never read."""


class WarcSource(DataSource):
    """Options for reading: `payloads` (true), `on_error` (fail, or row), `largest` bytes of a record.
    For writing: `dictionary` (base64, may be absent), `roll` bytes of an archive."""

    @classmethod
    def name(cls) -> str:
        return "warc_zst"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        on_error = o.get("on_error", "fail")
        if on_error not in ("fail", "row"):
            raise ValueError(f"on_error is {on_error!r}")
        return WarcReader(o["path"], o.get("payloads", "true").lower() != "false", on_error == "fail", int(o.get("largest", LARGEST)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        o = self.options
        fs, folder = file_system(o["path"])
        fs.create_dir(folder, recursive=True)
        return WarcWriter(o["path"], overwrite, base64.b64decode(o.get("dictionary", "")), int(o.get("roll", ROLL)))


# ---- the operator -------------------------------------------------------
def train_dictionary(
    pages: DataFrame, body: str = "html", size: int = DICTIONARY_BYTES, rows: int = SAMPLE_ROWS, each: int = SAMPLE_BYTES,
) -> bytes:
    """A dictionary from about `rows` rows, drawn by a hash, and `each` bytes of them; empty if they are too few.
    It only makes archives smaller: any dictionary gives the same records."""
    others = [F.col(f"`{c}`") for c in pages.columns if c != body]
    filled = pages.filter(F.octet_length(F.col(f"`{body}`")) > 0).select(
        F.xxhash64(*others).alias("at"), F.substring(F.col(f"`{body}`").cast("binary"), 1, each).alias("sample"))
    drawn = sampled(filled, "at", rows, 0).select("sample").limit(2 * rows)  # rows alike in all other columns are drawn together
    try:
        return zstandard.train_dictionary(size, [bytes(r["sample"]) for r in drawn.collect()]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def plan_records(
    pages: DataFrame, key: str = "page_id", uri: str = "url", body: str = "html", least: int = LEAST,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """The rows to be written (`WRITTEN`): of equal payloads of `least` bytes or more the smallest key is the response."""
    kept = pages.select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{uri}`").cast("string").alias("uri"),
        F.coalesce(F.col(f"`{body}`").cast("binary"), F.lit(b"")).alias("payload"))
    kept = kept.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    repeated = kept.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(
        F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    later = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return kept.join(repeated, "digest", "left").select(
        F.col("id").cast("string").alias("key"), "uri", F.lit(date).alias("date"),
        F.when(later, "revisit").otherwise("response").alias("type"), F.when(~later, F.col("payload")).alias("payload"),
        "payload_bytes", "digest", F.when(later, F.col("first").cast("string")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, dictionary: bytes = b"", roll: int = ROLL) -> None:
    """Append planned records to the archives of `folder`."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc_zst").option("dictionary", base64.b64encode(dictionary).decode()).option("roll", roll).mode(
        "append").save(folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True, on_error: str = "fail", largest: int = LARGEST) -> DataFrame:
    """Every record of a folder of archives, or of one archive (`READ`)."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc_zst").option("payloads", str(payloads).lower()).option("on_error", on_error).option(
        "largest", largest).load(folder)


def resolve(records: DataFrame) -> DataFrame:
    """(key, type, payload_bytes, payload_digest, refers_to key, error): a revisit takes length and digest from the response it
    refers to; one whose response is missing or differs in digest or stated length has an `error`.

    `records` is read twice; pass a written table.
    """
    columns = ["key", "type", "payload_bytes", "payload_digest"]
    responses = records.filter("type = 'response' and error is null")
    # Repeated rows share a record identifier and are equal.
    known = responses.groupBy("record_id").agg(*[F.min(c).alias(f"_{c}") for c in columns])
    revisits = records.filter("type = 'revisit'").drop("record_id").join(known, F.col("refers_to") == F.col("record_id"), "left")
    fault = F.when(F.col("record_id").isNull(), F.lit("the response is missing")).when(
        F.col("payload_digest") != F.col("_payload_digest"), F.lit("the response has another digest")).when(
        F.col("payload_bytes") != F.col("_payload_bytes"), F.lit("the response has another length"))
    followed = revisits.select(
        "key", "type", F.col("_payload_bytes").alias("payload_bytes"), F.col("_payload_digest").alias("payload_digest"),
        F.col("_key").alias("refers_to"), F.coalesce("error", fault).alias("error"))
    none = F.lit(None).cast("string")
    return responses.select(*columns, none.alias("refers_to"), none.alias("error")).unionByName(followed)
