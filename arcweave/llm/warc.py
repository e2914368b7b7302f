"""WARC archives compressed record by record with a dictionary.

An archive begins with a skippable frame that holds a Zstandard dictionary
trained on its own first records (at most ``sample_bytes``); each record is a
frame of its own, compressed with it, so any record can be read alone.
Archives end at ``archive_bytes`` of raw records, so neither writing nor
reading holds more than a record and the sample.

Of records with equal payloads the one with the smallest page_id is the
response, the others revisit it and carry no payload.  Payloads meet as
digests only; the join that brings the response's id back is between two plain
shuffles, so adaptive execution splits a payload that very many pages share.

Files go to the shared folder under names of their task attempt.  Only the
manifest, a table written by Spark's commit protocol, says which count, so
lost or repeated tasks leave no double records.

Defined results: a null html is an empty payload; a page_id that is null sorts
last and its group's response is the smallest other one (all null: each is a
response); rows that repeat the smallest page_id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.files import filesystem
from arcweave.plans.materialize import materialize, new_path

#: Magic number of the skippable frame that holds the dictionary (fixed value).
DICTIONARY_FRAME = 0x184D2A5D
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 2 << 20, 64 << 10, 64 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no body."""
    name = "none" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c for c in url or "" if c >= " "),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    body = payload
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on records; of too few, their raw content."""
    try:
        if len(samples) >= 16:
            return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive; records are held back until the dictionary is trained."""

    def __init__(self, out, sample_bytes: int = SAMPLE_BYTES):
        self._out, self._sample_bytes = out, sample_bytes
        self._first: list[bytes] | None = []
        self._waiting = self.raw = self.records = 0

    def add(self, rec: bytes) -> None:
        self.raw += len(rec)
        self.records += 1
        if self._first is None:
            self._out.write(self._compress(rec))
            return
        self._first.append(rec)
        self._waiting += len(rec)
        if self._waiting >= self._sample_bytes:
            self._start()

    def _start(self) -> None:
        made = dictionary([x[:32768] for x in self._first])
        data = made.as_bytes()
        self._out.write(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        self._compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=made).compress
        first, self._first = self._first, None
        for rec in first:
            self._out.write(self._compress(rec))

    def close(self) -> None:
        if self._first is not None:
            self._start()
        self._out.close()


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record of an open archive."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    data = source.read(size)
    trained = data[:4] == b"\x37\xa4\x30\xec"
    held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    stream = zstandard.ZstdDecompressor(dict_data=held).stream_reader(source, read_across_frames=True)
    buffer = bytearray()
    at = 0

    def fill() -> bool:
        nonlocal at
        more = stream.read(1 << 20)
        if at:
            del buffer[:at]
            at = 0
        buffer.extend(more)
        return bool(more)

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not fill():
                if len(buffer) > at:
                    raise ValueError("the archive breaks off in a header")
                return
        head = buffer[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in head[1:])
        length = int(fields["Content-Length"])
        at = end + 4
        while len(buffer) < at + length + 4:
            if not fill():
                raise ValueError("the archive breaks off in a record")
        yield fields, bytes(buffer[at : at + length])
        at += length + 4


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the manifest (path, records, bytes)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    first = materialize(rows.groupBy("digest").agg(F.min("page_id").alias("first")), "payloads")
    linked = rows.join(first, "digest")
    points_back = (F.octet_length("html") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    linked = linked.select("page_id", "url", "html", F.when(points_back, F.col("first")).alias("refers_to"))

    def work(batches):
        fs, root = filesystem(folder)
        task = TaskContext.get()
        archive, path, made = None, "", 0
        done = []

        def close():
            archive.close()
            done.append((path, archive.records, archive.raw))

        for batch in batches:
            ids, urls, refs = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for page_id, url, html, ref in zip(ids, urls, batch.column(2), refs, strict=True):
                if archive is None:
                    path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{made:04d}.warc.zst"
                    archive, made = Archive(fs.open_output_stream(path), sample_bytes), made + 1
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                archive.add(record(page_id, url, payload, payload_digest(payload), ref))
                if archive.raw >= archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "records": [x[1] for x in done], "bytes": [x[2] for x in done]},
            schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    return materialize(linked.mapInArrow(work, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives that ``manifest`` names, one row each."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(urn: str | None) -> int | None:
        return None if urn in (None, "<urn:page:none>") else int(urn[len("<urn:page:") : -1])

    def work(batches):
        fs, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out: list[list] = [[], [], [], [], []]
                with fs.open_input_stream(path) as f:
                    for fields, body in read_archive(f):
                        kind = fields["WARC-Type"]
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and payload_digest(body) != digest:
                            raise ValueError(f"a payload of {path} does not fit its digest")
                        row = (number(fields["WARC-Record-ID"]), int(fields["WARC-Payload-Length"]), digest, kind, number(fields.get("WARC-Refers-To")))
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(work, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes, archive_bytes), folder)
