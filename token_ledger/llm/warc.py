"""WARC archives with a Zstandard dictionary: writer and reader.

Each task writes archives of its own: a dictionary trained on a bounded sample of the
archive's records stands in a leading skippable frame, and every record is a frame of its
own, so a reader can start at any record. Equal payloads are archived once; the others are
revisit records that point to it. Which record is the response is settled with a salted
minimum over digests, so a payload that a third of all pages share is never gathered.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
import struct
from collections import deque
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 64 << 10
#: Most bytes of records that a dictionary is trained on.
SAMPLE_BYTES = 2 << 20
#: An archive is closed once it is this large (compressed).
ARCHIVE_BYTES = 64 << 20
SALTS = 48


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit (``refers_to`` set) has no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields (lower-case names), HTTP fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": {k.lower(): v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}, "payload": payload}


class ArchiveWriter:
    """Writes records of one task; a finished archive appears under its name at once."""

    def __init__(self, folder: str, name: str, level: int = 6):
        self.fs, self.path = pa.fs.FileSystem.from_uri(folder)
        self.name, self.level, self.parts = name, level, 0
        self.out = None

    def _open(self, sample: list[bytes]) -> None:
        import zstandard

        self.temp = f"{self.path}/_{self.name}-{self.parts}.{os.getpid()}.tmp"
        self.out, self.size, self.records = self.fs.open_output_stream(self.temp, compression=None), 0, 0
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
        except zstandard.ZstdError:  # too few or too short records to learn from
            dictionary = None
        if dictionary is not None:
            raw = dictionary.as_bytes()
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_checksum=True)

    def write_all(self, records: Iterator[bytes], archive_bytes: int) -> Iterator[tuple[str, int, int]]:
        """Yields (archive, records, bytes) of every finished archive."""
        waiting: deque[bytes] = deque()  # records that a dictionary was trained on and no archive holds yet
        while True:
            size = sum(map(len, waiting))
            while size < SAMPLE_BYTES and (r := next(records, None)) is not None:
                waiting.append(r)
                size += len(r)
            if not waiting:
                return
            self._open(list(waiting))
            while self.size < archive_bytes and (r := waiting.popleft() if waiting else next(records, None)) is not None:
                frame = self.compressor.compress(r)
                self.out.write(frame)
                self.size, self.records = self.size + len(frame), self.records + 1
            yield self._close()

    def _close(self) -> tuple[str, int, int]:
        self.out.close()
        final = f"{self.path}/{self.name}-{self.parts}.warc.zst"
        self.fs.move(self.temp, final)
        self.parts += 1
        return final, self.records, self.size


def read_archive(uri: str) -> Iterator[bytes]:
    """Records of an archive, one frame at a time."""
    import zstandard

    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        head = stream.read(8)
        dictionary = None
        if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
            dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]))
            head = b""
        codec = zstandard.ZstdDecompressor(dict_data=dictionary)
        pending = head
        frame, parts = codec.decompressobj(), []
        while pending or (pending := stream.read(1 << 20)):
            parts.append(frame.decompress(pending))
            pending = b""
            if frame.eof:
                yield b"".join(parts)
                pending = frame.unused_data
                frame, parts = codec.decompressobj(), []


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, salts: int = SALTS) -> DataFrame:
    """``id, url, html, refers_to``: null for a response, else the id of the response with the same payload.

    Of equal payloads of at least ``min_payload`` bytes the smallest id is the response.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha2("html", 256).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    salted = rows.filter(F.octet_length("html") >= min_payload).groupBy("digest", "salt").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.expr("bit_or(shiftleft(1L, salt))").alias("bits")).filter("n > 1")
    each = groups.select("digest", "first", F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit("bits", s) == 1)).alias("salt"))
    joined = rows.join(each, ["digest", "salt"], "left")
    return joined.select("id", "url", "html", F.when(F.col("id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row to archives in ``folder``; returns ``archive, records, bytes``.

    A null html is an empty payload; a null url has no target line. Rows that repeat the
    response's id are responses themselves. Records are in the order of their ids, so a task
    that runs again writes the same archives over the old ones. A very long html is one
    record, whole. Other columns are not read, whatever their names. An empty table writes no
    archive and gives no row.
    """
    marked = mark_revisits(pages, id_col, url_col, html_col, min_payload).sortWithinPartitions("id", "refers_to", "url", "html")
    pages.sparkSession.range(1).select(F.lit("")).write.mode("overwrite").text(f"{folder}/_about")  # makes the folder by Spark's own file system

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def records() -> Iterator[bytes]:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    for i, url, html, first in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                        yield record(i, url, html.encode(), first, date)

        writer = ArchiveWriter(folder, f"part-{TaskContext.get().partitionId():05d}")
        for done in writer.write_all(records(), archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in done], ["archive", "records", "bytes"])

    return marked.mapInArrow(run, "archive string, records long, bytes long")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives in ``folder``: id, url, payload size and digest, type, refers_to.

    A response's size and digest are taken from the payload that was read; a revisit's are
    those of its headers. The digest in a response's header is checked.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")

    def number(urn: str) -> int | None:
        text = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def rows(path: str):
            for raw in read_archive(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path):
                got = parse_record(raw)
                f, payload = got["fields"], got["payload"]
                digest = f["warc-payload-digest"].removeprefix("sha1:")
                if f["warc-type"] == "response" and payload_digest(payload) != digest:
                    raise ValueError(f"{path}: the payload of {f['warc-record-id']} does not match its digest")
                size = len(payload) if f["warc-type"] == "response" else int(got["http"]["content-length"])
                yield number(f["warc-record-id"]), size, digest, f["warc-type"], number(f["warc-refers-to"]) if "warc-refers-to" in f else None, unquote(f["warc-target-uri"]) if "warc-target-uri" in f else None

        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = rows(path)
                while part := list(itertools.islice(found, 2000)):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
