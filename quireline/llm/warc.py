"""Dictionary-compressed WARC archives: writer and reader.

An archive starts with a skippable Zstandard frame that holds a dictionary
trained from a bounded sample of the records to be archived; then each record
is one frame of its own, compressed with that dictionary. Records whose payload
equals another's become ``revisit`` records without a body.

Defined results: a null html is an empty payload, equal to other empty ones; a
null url gives a record without a target; a null page_id is never the one kept
if an id is there, and among rows with null ids alone all are responses; rows
that repeat the kept id and payload are responses too; an empty table gives no
archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, shared_path, small_batches, stored

#: Magic number of the skippable frame that holds the dictionary (fixed value of the format).
DICT_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def dictionary_from(pages: DataFrame, sample_rows: int = 400, sample_bytes: int = 8 << 20, size: int = 64 << 10) -> bytes:
    """A dictionary trained from whole records: the sample_rows first by hash, up to sample_bytes.

    Where that is too little to train on, the records themselves are the dictionary; under 256 bytes there is none.
    """
    rows = pages.select("html").where(F.length("html") > 0).withColumn("h", F.xxhash64("html")).orderBy("h").limit(sample_rows).select("html").toLocalIterator()
    samples, total = [], 0
    for r in rows:
        samples.append(HEAD + r["html"].encode("utf-8", "surrogatepass"))
        total += len(samples[-1])
        if total > sample_bytes:
            break
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] if total >= 256 else b""


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    body = HEAD + f"Content-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response"]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    head += [f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"] if revisit else []
    head += [f"X-Payload-Length: {len(payload)}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``kept_id`` (null, or the largest page_id of an equal payload) and ``revisit``.

    Only digests that repeat meet the rows again, and a hot digest is one row on that side. As long as those digests are within the
    bound for sending them to all tasks, payloads stay where they are.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    again = p.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("kept_id")).where("n > 1 and kept_id is not null").drop("n")
    out = p.join(bounded(stored(again, "warc-digests")), "digest", "left").drop("digest")
    return out.withColumn("revisit", F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id")))


MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64())])


def write_archives(marked: DataFrame, path: str, dictionary: bytes = b"", archive_bytes: int = 32 << 20, level: int = 3) -> DataFrame:
    """Writes archives below path and returns their stored manifest (path, records).

    Each attempt of a task writes files with names of its own, and the manifest lists those of
    the attempts that Spark committed: a lost executor leaves unlisted files, never wrong ones.
    """
    spark = marked.sparkSession

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=data)
        out = name = None
        n = size = 0
        for b in batches:
            for r in zip(*(b.column(c) for c in ("page_id", "url", "html", "kept_id", "revisit")), strict=True):
                page_id, url, html, kept, revisit = (x.as_py() for x in r)
                if out is None:
                    name, n, size = f"{root}/{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                    if dictionary:
                        out.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
                payload = html.encode("utf-8", "surrogatepass")
                frame = press.compress(record(page_id, url, payload, kept, revisit, digest_of(payload)))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= archive_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [name], "records": [n]}, MANIFEST)
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n]}, MANIFEST)

    small_batches(spark)
    return stored(marked.select("page_id", "url", "html", "kept_id", "revisit").mapInArrow(write, "path string, records long"), "warc-manifest")


def read_records(raw):
    """(headers, body) of each record of an archive, one at a time."""
    head = raw.read(8)
    data = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICT_MAGIC:
        data = zstandard.ZstdCompressionDict(raw.read(struct.unpack("<II", head)[1]))
        head = b""
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=data).stream_reader(_Joined(head, raw), read_across_frames=True), 1 << 16)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            headers[k] = v.strip()
        body = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, body


class _Joined(io.RawIOBase):
    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def readable(self):
        return True

    def readinto(self, buf):
        got = self.head or self.rest.read(len(buf))
        got, self.head = got[: len(buf)], got[len(buf) :] if self.head else b""
        buf[: len(got)] = got
        return len(got)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, html string"


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record. Payload lengths and digests of responses are computed anew and held against the headers."""
    schema = READ if with_payload else READ.rpartition(",")[0]

    def read(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs = pafs.LocalFileSystem() if path.startswith("/") and "://" not in path else pafs.FileSystem.from_uri(path)[0]
                rows = []
                with fs.open_input_stream(path, compression=None) as raw:
                    for h, body in read_records(raw):
                        payload = body.partition(b"\r\n\r\n")[2]
                        kind, digest, size = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                        if kind == "response" and (digest_of(payload), len(payload)) != (digest, size):
                            raise ValueError(f"a payload differs from its digest in {path}")
                        rows.append((*(int(h[k]) if k in h else None for k in ("X-Page-ID",)), size, digest, kind, int(h["X-Refers-To-Page-ID"]) if kind == "revisit" else None, h.get("WARC-Target-URI"), *([payload.decode("utf-8", "surrogatepass") if kind == "response" else None] if with_payload else [])))
                        if len(rows) >= 500:
                            yield _batch(rows, with_payload)
                            rows = []
                if rows:
                    yield _batch(rows, with_payload)

    return manifest.repartition(max(1, min(manifest.count(), 4096)), F.col("path")).mapInArrow(read, schema)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *([pa.string()] if with_payload else [])]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "html"][: len(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes every page into archives in the shared folder and returns what reading them back gives."""
    manifest = write_archives(with_revisits(pages), shared_path(spark, "warc"), dictionary_from(pages))
    return read_archives(manifest, with_payload=False)
