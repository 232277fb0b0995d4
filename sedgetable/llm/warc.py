"""WARC archives with a Zstandard dictionary, and their reader.

An archive starts with a skippable frame that holds the dictionary, built from the
archive's own records; then every record is one frame compressed with it, so any
record can be read alone. Of records with equal payloads one is a response, the
others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sedgetable.llm.words import shared_path, stored

# Fixed value: magic number of the skippable frame that holds a WARC dictionary.
MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
TRAIN_BYTES = 2 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def decided(pages: DataFrame, key: str, payload: Column, min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: the largest key of equal payloads of at least ``min_bytes`` where that is another row.

    Digests travel without payloads: combined per digest before the shuffle, then
    joined on the digest with skew handling, and only repeats are joined back, by key and
    digest, as a key may have several payloads.
    """
    sha = pages.select(F.col(key).alias("__page"), F.sha1(payload).alias("__sha"), F.octet_length(payload).alias("__size"))
    sha = sha.filter((F.col("__size") >= min_bytes) & F.col("__page").isNotNull()).drop("__size")
    latest = sha.groupBy("__sha").agg(F.max("__page").alias("__last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeats = sha.join(latest, "__sha").filter("__page < __last").select("__page", "__sha", F.col("__last").alias("refers_to")).distinct()
    return pages.join(repeats, (pages[key] == repeats["__page"]) & (F.sha1(payload) == repeats["__sha"]), "left").drop("__page", "__sha")


def _record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. ``X-`` fields carry the table's keys and the payload's length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = HTTP if refers_to is not None else HTTP + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page),
        "WARC-Date": date,
        "WARC-Target-URI": "".join((url or "").split()) or None,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else _record_id(refers_to),
        "X-Page-ID": page,
        "X-Refers-To-Page-ID": refers_to,
        "X-Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Dictionary trained on the records; where they are too few or too small for that, their bytes as they are."""
    sample, size = [], 0
    for r in records:
        if size >= TRAIN_BYTES:
            break
        sample.append(r[: TRAIN_BYTES // 16])
        size += len(sample[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), sample, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    held = dictionary(records)
    data = held.as_bytes()
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True)
    return struct.pack("<II", MAGIC, len(data)) + data + b"".join([packer.compress(r) for r in records])


def frames(stream) -> Iterator[bytes]:
    """Records of an open archive in order; memory holds one record and a piece of the file."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    data = stream.read(size)
    trained = data[:4] == b"\x37\xa4\x30\xec"
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind))
    piece, parts, reader = b"", [], None
    while True:
        if not piece and not (piece := stream.read(1 << 16)):
            if reader is not None:
                raise ValueError("the archive ends within a record")
            return
        reader = reader or opener.decompressobj()
        parts.append(reader.decompress(piece))
        piece = b""
        if reader.eof:
            piece = reader.unused_data
            yield b"".join(parts)
            reader, parts = None, []


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if not urlsplit(path).scheme:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write archives under ``folder``, which all executors share; returns ``path, records, bytes`` per archive.

    The file name is new on every attempt and only names of finished tasks are
    returned, so a task that runs twice leaves at most a file that nobody reads.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = decided(pages.select(key, url, html), key, payload, min_bytes).select(F.col(key).cast("bigint"), url, payload.alias("payload"), F.col("refers_to").cast("bigint"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            name = f"{base}/{uuid.uuid4().hex}.warc.zst"
            data = archive(records)
            with store.open_output_stream(name) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "records": [len(records)], "bytes": [len(data)]})

        records, size = [], 0
        for batch in batches:
            for page, link, body, refers_to in zip(*(batch.column(i) for i in range(4))):
                records.append(record(page.as_py(), link.as_py(), body.as_py(), refers_to.as_py(), date))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush(records)
                    records, size = [], 0
        if records:
            yield flush(records)

    return stored(rows.mapInArrow(save, "path string, records bigint, bytes bigint"), "archives")


def read(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` of every record.

    Payloads of responses are hashed again and must give the digest in their head.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = _open(path)
                rows, size = [], 0
                with store.open_input_stream(name) as stream:
                    for raw in frames(stream):
                        head, block = parsed(raw)
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = block[len(HTTP) :] if head["WARC-Type"] == "response" else None
                        length = int(head["X-Payload-Length"])
                        if payload is not None and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"payload of {head['WARC-Record-ID']} does not fit its digest")
                        page, refers_to = (int(head[k]) if k in head else None for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
                        rows.append((page, head.get("WARC-Target-URI"), length, digest, head["WARC-Type"], refers_to, payload))
                        size += len(block)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    count = max(1, archives.count())
    return archives.select("path").repartition(count).mapInArrow(load, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page and read the archives back: the digest columns of :func:`read`.

    Null html is an empty payload. Rows without id are responses of their own and
    come back without id; rows with one id and one payload share their record type.
    """
    archives = write(pages, shared_path(pages.sparkSession, "warc"))
    return read(pages.sparkSession, archives).drop("payload", "url")
