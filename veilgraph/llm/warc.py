"""WARC archives of Zstandard frames that share a dictionary.

The dictionary is built from a bounded sample of the records themselves.  Every
archive file starts with a skippable frame that holds it, and each record is a
frame of its own, so one record can be read without the others.

Archives are written by Spark's text writer, whose line separator is here an
empty skippable frame: eight bytes that every Zstandard reader passes over.  So
task commits, retries after a lost executor and any Hadoop file system work as
for other tables, and no record passes through the driver.

An archive ends at a bound of bytes, as a reader takes a file whole.  The writer
counts rows only: a row is a chunk of frames, every ``ARCHIVE_ROWS`` rows make a
file, and an archive that is full earlier is filled up with empty rows.

Records with equal payloads are told by their SHA-1; that with the largest page
id keeps the payload as ``response``, the others are ``revisit`` records that
name it.  Only (page id, digest) pairs are grouped, never the payloads.

Defined results: a null html is the empty payload; rows that share the largest
id of a payload are each a response; a row without an id is a response and
refers to nothing; a null url leaves the target header out; an empty table
gives no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.base import small_batches
from veilgraph.llm.labelled import least_hashed
from veilgraph.operators.skew import Dimension, attach
from veilgraph.runtime import new_path, save

# Fixed values of the Zstandard frame format.
FRAME = 0xFD2FB528
SKIPPABLE = 0x184D2A50
DICTIONARY_FRAME = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", SKIPPABLE, 0)

DICTIONARY_BYTES = 65_536
SAMPLE_RECORDS = 800
SAMPLE_CHARS = 16_384
LEVEL = 3
ARCHIVE_BYTES = 64_000_000
ARCHIVE_ROWS = 128
DATE = "1970-01-01T00:00:00Z"
RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP headers of the page but not its payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head.append(f"WARC-Refers-To: {_urn(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join([*head, "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few records to choose from
        return b"".join(records)[-DICTIONARY_BYTES:] or b"WARC/1.1"


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its block headers."""
    head = bytes(data[at : at + 18])
    checksum = 4 if zstandard.get_frame_parameters(head).has_checksum else 0
    end = at + zstandard.frame_header_size(head)
    last = False
    while not last:
        header = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = bool(header & 1), header >> 1 & 3, header >> 3
        end += 3 + (1 if kind == 1 else size)
    return end + checksum


def records_of(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, decompressed with the dictionary in its leading frame."""
    data, at, reader = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic == FRAME:
            end = _frame_end(data, at)
            yield reader.decompress(data[at:end])
        else:
            if magic & 0xFFFFFFF0 != SKIPPABLE:
                raise ValueError(f"no frame at byte {at}")
            end = at + 8 + size
            if magic == DICTIONARY_FRAME:
                known = zstandard.ZstdCompressionDict(bytes(data[at + 8 : end]))
                reader = zstandard.ZstdDecompressor(dict_data=known)
        at = end


def parse(raw: bytes) -> dict:
    """Headers of a record, and its payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != length or found != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its headers")

    def page(name: str) -> int | None:
        named = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(named[1]) if named else None

    return {
        "page_id": page("WARC-Record-ID"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page("WARC-Refers-To"),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload if kind == "response" else None,
    }


def with_originals(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to): the larger page id with the same payload, if any."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    taken = pages.select(F.col("page_id").cast("bigint"), "url", payload.alias("payload"))
    marked = taken.withColumn("_digest", F.sha1("payload"))
    groups = save(
        marked.groupBy("_digest")
        .agg(F.max("page_id").alias("_original"), F.count("*").alias("_copies"))
        .filter("_copies > 1"),
        "warc-copies",
    )
    dim = Dimension.of(groups, "_digest", "_copies")
    scatter = F.concat(F.lit("-"), F.xxhash64("page_id").cast("string"))
    joined = attach(marked, "_digest", dim, {"_original": "_original"}, scatter)
    refers = F.when(F.col("page_id") < F.col("_original"), F.col("_original"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per page below ``path``.

    An archive file holds the dictionary and at most ``archive_bytes`` of records and one record more.
    """
    spark = pages.sparkSession
    small_batches(spark)
    # At most SAMPLE_RECORDS payloads, cut to SAMPLE_CHARS, come to the driver: those of least hash.
    cut = F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_CHARS).alias("html")
    sample = least_hashed(pages.select("page_id", "url", cut), SAMPLE_RECORDS, "page_id", "url").collect()
    content = build_dictionary([record(r["page_id"], r["url"], r["html"].encode(), None) for r in sample])
    shared = spark.sparkContext.broadcast(content)  # DICTIONARY_BYTES at most

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = zstandard.ZstdCompressionDict(shared.value)
        known.precompute_compress(level=LEVEL)
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        head = struct.pack("<II", DICTIONARY_FRAME, len(shared.value)) + shared.value
        chunks = Chunks(head, archive_bytes)
        for batch in batches:
            for page_id, url, payload, refers in zip(*(batch[c] for c in ("page_id", "url", "payload", "refers_to"))):
                raw = record(
                    None if pd.isna(page_id) else int(page_id), url, bytes(payload), None if pd.isna(refers) else int(refers)
                )
                for rows in chunks.add(writer.compress(raw)):
                    yield pd.DataFrame({"frame": rows})
        yield pd.DataFrame({"frame": chunks.rest()}, dtype=object)

    # Ids as text: a column of ids with a null would reach pandas as floats.
    whole = with_originals(pages).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    written = whole.mapInPandas(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    # Rows reach the writer in the order of ``frames``, so each file begins with the row that holds a dictionary.
    written.write.option("lineSep", EMPTY_FRAME.decode()).option("maxRecordsPerFile", ARCHIVE_ROWS).text(path)


class Chunks:
    """Frames in rows of about ``archive_bytes * 2 / ARCHIVE_ROWS``; every ARCHIVE_ROWS rows are an archive."""

    def __init__(self, head: bytes, archive_bytes: int):
        self.head, self.archive_bytes = head, archive_bytes
        self.row_bytes = archive_bytes * 2 // ARCHIVE_ROWS
        self.rows, self.written = 0, 0
        self.frames: list[bytes] = []
        self.waiting = 0

    def _row(self) -> bytes:
        row = b"".join([self.head, *self.frames] if self.rows == 0 else self.frames)
        self.written += self.waiting
        self.rows = (self.rows + 1) % ARCHIVE_ROWS
        self.frames, self.waiting = [], 0
        return row

    def add(self, frame: bytes) -> Iterator[list[bytes]]:
        """Rows that are complete with this frame."""
        self.frames.append(frame)
        self.waiting += len(frame)
        full = self.written + self.waiting >= self.archive_bytes
        if full or self.waiting >= self.row_bytes:
            out = [self._row()]
            if full:  # empty rows to the end of this archive
                out += [b""] * (-self.rows % ARCHIVE_ROWS)
                self.rows = 0
            if self.rows == 0:
                self.written = 0
            yield out

    def rest(self) -> list[bytes]:
        return [self._row()] if self.frames else []


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record below ``path``; with ``payloads`` also the url and the payload of responses.

    A file is one row of the reader, of as many bytes as its writer let it have.
    """
    small_batches(spark)  # Spark cuts a batch by its bytes as well, after a file or a few
    schema = RESULT + (", url string, payload binary" if payloads else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for raw in records_of(content):
                    found = parse(raw)
                    rows.append([found[name] for name in names])
                    size += len(raw) if payloads else 0
                    if len(rows) >= 2000 or size > 16_000_000:
                        yield _frame(rows, names)
                        rows, size = [], 0
                yield _frame(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(run, schema)


def _frame(rows: list, names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives into the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
