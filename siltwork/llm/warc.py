"""WARC archives with dictionary-compressed records.

A Zstandard dictionary is built from archived records: about ``SAMPLE`` of them, chosen by the hash of id and payload
(documented bounds, for the dictionary alone: repeated rows count once, at most ``4 * SAMPLE`` records and
``SAMPLE_BYTES`` bytes, and of a record over ``PART`` bytes eight slices spread over all of it). Every archive starts with a
skippable frame that holds the dictionary, compressed; then each record is a frame of its own. Of equal payloads of
at least ``LEAST`` bytes the one with the smallest id is a response, the others are revisit records without a payload.

Tasks write archives straight into the shared folder and return a manifest row for each. A file name holds the task's
attempt, and readers open only what the committed manifest names, so attempts that failed or ran twice do no harm.
Reading streams records, so memory is bounded by the largest record.

Repeats are found from (id, digest) alone: counts by digest are pre-aggregated, and only digests that occur more than
once are joined back, as a plain scan, so that Spark can broadcast them if small or else split a frequent digest.

Defined cases: null html is an empty payload; payloads under ``LEAST`` bytes are all responses; rows that repeat both
id and payload are all responses if theirs is the smallest id; a null id is never referred to, and a group of null
ids only are responses; line breaks in urls are percent-encoded; an empty table makes no archives; extra columns don't
reach the archives and may have any name.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import map_texts, saved, scratch_path

MAGIC = 0x184D2A5D
LEAST, SAMPLE, SAMPLE_BYTES, PART, DICTIONARY, ARCHIVE = 100, 1_000, 16 << 20, 128 << 10, 112 << 10, 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop-style URI: local, HDFS or object stores that Arrow knows."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A response record, or a revisit record if ``refers_to`` has the response's id."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = b"" if refers_to is not None else HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def train(records: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary from records; where there are too few to train on, their own first bytes."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, records)) // 8)), records).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(r[:1024] for r in records)[:size]


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", MAGIC, len(body)) + body


class Writer:
    """Archives of one task; a new one begins when the last is over ``ARCHIVE`` compressed bytes."""

    def __init__(self, folder: str, prefix: str, dictionary: bytes, limit: int = ARCHIVE):
        self.files, self.folder = file_system(folder)
        self.prefix, self.dictionary, self.limit = prefix, dictionary, limit
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        self.done: list[tuple[str, int, int]] = []
        self.out, self.records = None, 0

    def put(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"{self.prefix}-{len(self.done):04d}.warc.zst"
            self.out, self.records, self.bytes = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0, 0
            for part in (dictionary_frame(self.dictionary), self.compressor.compress(info_record(self.name))):
                self.bytes += self.out.write(part) or len(part)
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.records, self.bytes = self.records + 1, self.bytes + len(frame)
        if self.bytes >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.bytes))
            self.out = None


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    payload: bytes = field(default=b"")


def read_records(file) -> Iterator[Record]:
    """Records of an open archive, the leading dictionary applied."""
    head = file.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != MAGIC:
        raise ValueError("no leading dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(file.read(size))
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    stream = io.BufferedReader(decompressor.stream_reader(file, read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("a record was expected")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield Record(headers, block, block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else b"")


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    keys = rows.where(F.octet_length("payload") >= least).select("page_id", "digest")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    firsts = saved(firsts, "warc-firsts")
    joined = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def slices_of(data: bytes, size: int = PART) -> bytes:
    """``data``, or eight slices of ``size / 8`` bytes from its beginning to its end."""
    if len(data) <= size:
        return data
    width = size // 8
    return b"".join(data[(at := (len(data) - width) * k // 7) : at + width] for k in range(8))


def build_dictionary(pages: DataFrame, sample: int = SAMPLE) -> bytes:
    """Trained in one task on records of a bounded sample of pages."""
    n = pages.count()
    mixed = F.xxhash64("page_id", "html", F.lit(3))
    place = F.pmod(mixed, F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = pages.where(place < F.lit(sample / max(n, 1))).select("page_id", "url", "html").dropDuplicates(["page_id", "html"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, held = [], 0
        for batch in batches:
            for page_id, url, html in zip(*batch.columns):
                if held < SAMPLE_BYTES:
                    data = (html.as_py() or "").encode()
                    records.append(slices_of(record(page_id.as_py(), url.as_py(), data, hashlib.sha256(data).hexdigest())))
                    held += len(records[-1])
        yield pa.RecordBatch.from_pydict({"dictionary": [train(records or [record(None, None, b"", "")])]})

    rows = taken.orderBy(mixed, "page_id").limit(4 * sample).coalesce(1).mapInArrow(fit, "dictionary binary").collect()
    return rows[0][0] if rows else train([record(None, None, b"", "")])


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Archives of (page_id, url, html) in ``folder``; the manifest (folder, file, records, bytes) as a saved table."""
    dictionary = pages.sparkSession.sparkContext.broadcast(build_dictionary(pages))  # at most DICTIONARY bytes
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = Writer(folder, f"{task.partitionId():06d}-{task.taskAttemptId()}", dictionary.value, archive_bytes)
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*batch.columns):
                writer.put(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py()))
        writer.close()
        if writer.done:
            names, records, sizes = zip(*writer.done)
            yield pa.RecordBatch.from_pydict({"folder": [folder] * len(names), "file": list(names), "records": list(records), "bytes": list(sizes)})

    return saved(decide(pages).mapInArrow(run, "folder string, file string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Records of the manifest's archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url[, payload].

    A response's digest and size are those of its stored payload; ``ValueError`` if its header says otherwise.
    """
    tasks = max(1, min(manifest.count(), 10_000))

    def make():
        def kernel(batch: pa.RecordBatch):
            for folder, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, path = file_system(folder)
                with files.open_input_stream(f"{path}/{name}", compression=None) as file:
                    for r in read_records(file):
                        h = r.headers
                        if h["warc-type"] == "warcinfo":
                            continue
                        digest, size = h["warc-payload-digest"].removeprefix("sha256:"), int(h["x-payload-length"])
                        if h["warc-type"] == "response":
                            if hashlib.sha256(r.payload).hexdigest() != digest or len(r.payload) != size:
                                raise ValueError(f"a payload of {name} is damaged")
                        row = (int(h["x-page-id"]) if h["x-page-id"] else None, size, digest, h["warc-type"], int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None, h["warc-target-uri"])
                        yield row + (r.payload,) if keep_payload else row

        return kernel

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return map_texts(manifest.select("folder", "file").repartition(tasks, "file"), schema + (", payload binary" if keep_payload else ""), make)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    return read(write(pages, scratch_path(pages.sparkSession, "warc")))
