"""WARC archives, and a normaliser for archives that are one gzip stream.

A WARC file should hold every record as a gzip member of its own, so that a record can be read from its
offset. ``write_archives`` writes the other kind, whole files as one stream. ``normalise`` inflates
such a stream once, from front to back, and writes every record as its own member;
``write_index`` walks the members of the new archives and writes a sidecar of their offsets.

Both kinds are real files, written and read by Spark's own text and binary sources, so they may lie
in any file system that Spark reaches. The text writer ends every row with a separator: between records
of a stream it is the line ends that WARC asks for. After a member it is a zero byte, which is
the last byte of every member of less than 16 MiB, as that ends in the inflated size; so a row is a
member without its last byte. Behind a larger record stands an empty member, which ends in zero.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracemill.llm.common import stored
from tracemill.operators.joins import BROADCAST_BYTES, lookup_join
from tracemill.session import scratch_folder

RECORDS_PER_FILE = 1000
#: Payloads smaller than this are always written whole.
LEAST_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
END = "\r\n\r\n"
ID_PREFIX = "urn:page:"
#: Fixed value: profile of a revisit to an equal payload, from the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 1 << 20
#: Base-32 digits as numbers are printed, and as RFC 4648 has them.
_DIGITS, _RFC = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Upper-case base-32 SHA-1 of a binary column: 20 bytes are four groups of 40 bits, eight digits each."""
    sha1 = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha1, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _DIGITS, _RFC)


def revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``(page_id, mark, refers_to)`` of the pages that revisit; ``mark`` is 60 bits of the digest.

    The smallest id is found per digest, before digests meet their pages; only ids and digests are
    shuffled. Pages without an id cannot revisit or be revisited.
    """
    payload = _payload("html")
    slim = pages.where(F.col("page_id").isNotNull()).select("page_id", payload_digest(payload).alias("digest"), F.octet_length(payload).alias("n"))
    slim = stored(slim.where(F.col("n") >= least_bytes).select("page_id", "digest"), "digests")
    lowest = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most")).where("most > refers_to")
    found = lookup_join(slim, lowest.drop("most"), ["digest"]).where("page_id > refers_to")
    return found.select("page_id", _mark("digest").alias("mark"), "refers_to").distinct()


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html), F.lit("")).cast("binary")


def _mark(digest: str) -> Column:
    return F.xxhash64(digest)


def write_archives(pages: DataFrame, folder: str, records: int = RECORDS_PER_FILE, least_bytes: int = LEAST_REVISIT_BYTES) -> None:
    """A record per row of ``pages`` (page_id, url, html) into files of at most ``records``, each one gzip stream.

    The pages of revisits are looked up in a table of three numbers each: broadcast if its counted
    size is small, else both sides are shuffled. A page that repeats an id with its payload is
    written the same way again.
    """
    found = stored(revisits(pages, least_bytes), "revisits")
    payload = _payload("html")
    full = pages.select("page_id", "url", payload.alias("payload"), payload_digest(payload).alias("digest"))
    full = lookup_join(full.withColumn("mark", _mark("digest")), found, ["page_id", "mark"], "left", BROADCAST_BYTES)
    record = record_text(F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("refers_to"))
    writer = full.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records).text(folder)


def record_text(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A record without the two line ends behind it. A revisit has no block; white space in a URL is percent-coded."""
    is_revisit = refers_to.isNotNull()
    uri = F.replace(F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    name = lambda value: F.concat(F.lit(f"<{ID_PREFIX}"), value.cast("string"), F.lit(">"))
    optional = lambda text: F.coalesce(text, F.lit(""))
    length = F.octet_length(payload)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        optional(line("WARC-Record-ID", name(page_id))), optional(line("WARC-Target-URI", uri)), line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), line("X-Payload-Length", length.cast("string")),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", name(refers_to)))).otherwise(""),
        line("Content-Length", F.when(is_revisit, 0).otherwise(length).cast("string")), F.lit(END),
    )
    return F.concat(head, F.when(is_revisit, F.lit("")).otherwise(payload.cast("string")))


def inflated(content: bytes) -> Iterator[bytes]:
    """Pieces of a gzip file, of any number of members, inflated from front to back."""
    data, at, stream = memoryview(content), 0, zlib.decompressobj(31)
    while at < len(data):
        piece = data[at : at + _STEP]
        at += len(piece)
        yield stream.decompress(piece)
        if stream.eof:
            at -= len(stream.unused_data)
            stream = zlib.decompressobj(31)
    yield stream.flush()


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The WARC records of a stream, each with the line ends behind it; only the one being read is held."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(END.encode())
                if end < 0:
                    break
                length = re.search(rb"\r\nContent-Length: *(\d+)", held[:end], re.I)
                need = end + len(END) + int(length[1]) + len(END)
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends within a record")


def member(record: bytes, level: int = LEVEL) -> bytes:
    """A gzip member of a record, without the zero byte that it, or an empty member behind it, ends in."""
    data = _deflated(record, level)
    return (data if data[-1] == 0 else data + _deflated(b"", level))[:-1]


def _deflated(data: bytes, level: int) -> bytes:
    stream = zlib.compressobj(level, zlib.DEFLATED, 31)
    return stream.compress(data) + stream.flush()


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch["content"]:
            group: list[bytes] = []
            for record in records(inflated(content.as_py())):
                group.append(member(record))
                if len(group) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(group, pa.binary())], ["value"])
                    group = []
            if group:
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.binary())], ["value"])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)


def normalise(spark: SparkSession, source: str, folder: str) -> None:
    """The archives of ``source`` with every record as its own member; one archive is held by a task at a time."""
    rewritten = _files(spark, source).select("content").mapInArrow(_rewrite, "value binary")
    rewritten.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(folder)


@dataclass
class Entry:
    """A record and its place in a normalised archive."""

    offset: int
    length: int
    headers: dict[str, str]
    block: bytes

    @property
    def page_id(self) -> int | None:
        return _number(self.headers.get("warc-record-id"))

    @property
    def refers_to(self) -> int | None:
        return _number(self.headers.get("warc-refers-to"))


def _number(name: str | None) -> int | None:
    return int(name.strip("<>").removeprefix(ID_PREFIX)) if name else None


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(END.encode())
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    headers = {name.lower(): value for name, value in headers.items()}
    return headers, rest[: int(headers["content-length"])]


def entries(archive: bytes) -> Iterator[Entry]:
    """Records of a normalised archive by member, in order; empty members belong to the one before."""
    data, at = memoryview(archive), 0
    open_entry: Entry | None = None
    while at < len(data):
        stream = zlib.decompressobj(31)
        parts, here = [], at
        while not stream.eof and here < len(data):
            parts.append(stream.decompress(data[here : here + _STEP]))
            here += len(data[here : here + _STEP])
        here -= len(stream.unused_data)
        record = b"".join(parts)
        if record:
            if open_entry:
                yield open_entry
            open_entry = Entry(at, here - at, *parse(record))
        elif open_entry:
            open_entry.length += here - at
        at = here
    if open_entry:
        yield open_entry


_INDEX = "archive string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            archive, rows = path.as_py(), []
            for e in entries(content.as_py()):
                kind, digest = e.headers["warc-type"], e.headers["warc-payload-digest"].removeprefix("sha1:")
                size = int(e.headers["x-payload-length"])
                if kind == "response" and (size, digest) != (len(e.block), base64.b32encode(hashlib.sha1(e.block).digest()).decode()):
                    raise ValueError(f"the payload at {e.offset} of {archive} is not the one that was written")
                rows.append((archive, e.offset, e.length, e.page_id, e.headers.get("warc-target-uri"), size, digest, kind, e.refers_to))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            names = [field.split()[0] for field in _INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def write_index(spark: SparkSession, archives: str, folder: str) -> DataFrame:
    """The sidecar of normalised archives, as Parquet: place, page and payload of every record.

    The payload of every response is read and held against its header.
    """
    _files(spark, archives).select("path", "content").mapInArrow(_indexed, _INDEX).write.parquet(folder)
    return spark.read.schema(_INDEX).parquet(folder)


def read_record(content: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at a place of the index, from that part of the archive alone."""
    return parse(b"".join(inflated(content[offset : offset + length])))


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """``pages`` written to archives, normalised, and read back: a row of the sidecar per page.

    Null html is an empty payload. Of equal payloads the smallest page_id is the response, all others
    revisit it; rows that repeat that id are responses too. A null page_id is a response and stays
    null; a null URL is left out of its record. Other columns are not written.
    """
    spark = pages.sparkSession
    folder = folder or scratch_folder(spark, "warc")
    write_archives(pages, f"{folder}/streams")
    normalise(spark, f"{folder}/streams", f"{folder}/archives")
    return write_index(spark, f"{folder}/archives", f"{folder}/index")


def round_trip(pages: DataFrame) -> DataFrame:
    """Per page ``page_id, payload_bytes, payload_digest, record_type, refers_to`` from the sidecar of its archives."""
    return archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
