"""Seekable Zstandard bundles of WARC records.

Records are grouped into frames that decompress on their own; a footer seek table, in a skippable frame, lists the frames' sizes, and the
index of a bundle maps each record identifier to its frame and the offset in the frame. A reader of one record reads the footer and one frame. Every bundle is written
by one task under a name of its own; only bundles that the index of finished tasks names exist for readers, so a task that is
lost and run again leaves nothing behind that counts.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _files
from ._common import kept, new_folder

#: Payloads shorter than this are never revisited.
LEAST = 1000
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 64 << 20
# Fixed values of the seekable format: magic numbers of its skippable frame and of its footer.
_SKIPPABLE, _FOOTER = 0x184D2A5E, 0x8F92EAB1
_DATE = "1970-01-01T00:00:00Z"


class BundleWriter:
    """Frames of records, then the seek table."""

    def __init__(self, uri: str):
        self.uri, self.out = uri, _files.create(uri)
        self.codec = zstandard.ZstdCompressor(level=3)
        self.frames, self.held, self.held_bytes, self.bytes = [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Number of the record's frame, and its offset there."""
        place = len(self.frames), self.held_bytes
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.codec.compress(b"".join(self.held))
            self.out.write(frame)
            self.frames.append((len(frame), self.held_bytes))
            self.bytes += len(frame)
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _FOOTER)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    def __init__(self, uri: str):
        self.file = _files.open_input(uri)
        end = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != _FOOTER:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & 0x80 else 8
        table = self.file.read_at(count * width, end - 9 - count * width)
        self.frames, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, k * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def records(self):
        for k in range(len(self.frames)):
            body, at = self.frame(k), 0
            while at < len(body):
                record, at = parse(body, at)
                yield record


def record_id(key) -> str:
    return f"<urn:spandrel:page:{'' if key is None else key}>"


def key_of(identifier: str) -> int | None:
    text = identifier.removesuffix(">").rpartition(":")[2]
    return int(text) if text else None


def _clean(url: str) -> str:
    """A header's value in one line."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def build(key, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 response, or for refers_to a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at an offset (headers in lower case, http headers, payload) and the offset of the next one."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(head["content-length"])
    body = data[end + 4 : end + 4 + size]
    http, _, payload = body.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in http.decode().split("\r\n")[1:])}
    return {"head": head, "http": fields, "payload": payload}, end + 4 + size + 4


_INDEX = T.StructType([T.StructField(n, k) for n, k in (("page", T.LongType()), ("record_id", T.StringType()), ("bundle", T.StringType()), ("frame", T.LongType()), ("offset", T.LongType()), ("length", T.LongType()))])


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """Writes bundles below folder and returns their index: page, record_id, bundle, frame, offset, length.

    Of equal payloads (SHA-1 and length) of at least `least` bytes the one with the largest key is a response, the others are revisits of it. Rows that
    repeat that key are all responses. A null payload is empty; a null URL is left out; a null key gives an identifier without number, and its record is a response
    unless a row with a key has its payload. Keys must be whole numbers, as record identifiers are made of them. Payloads and URLs of any length are stored whole; other columns play no part,
    whatever their names.
    """
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page"), F.col(f"`{url}`").alias("url"), body.alias("body"), F.length(body).cast("long").alias("n"), F.sha1(body).alias("digest"))
    first = (
        rows.where(F.col("n") >= least).groupBy(F.col("digest").alias("d"), F.col("n").alias("m")).agg(F.max("page").alias("largest"), F.count("*").alias("c")).where("c > 1").drop("c")
    )
    # only digests and keys are joined on a digest, which may be common; payloads are joined on their own key
    slim = pages.select(F.col(f"`{key}`").cast("long").alias("page"), F.length(body).cast("long").alias("n"), F.sha1(body).alias("digest")).where(F.col("n") >= least)
    again = slim.join(first, (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m"))).where(~F.col("page").eqNullSafe(F.col("largest"))).select(F.coalesce("page", F.lit(-1)).alias("p"), F.col("page").isNull().alias("none"), F.col("digest").alias("d"), F.col("largest").alias("refers")).distinct()
    joined = rows.join(again, (F.coalesce("page", F.lit(-1)) == F.col("p")) & (F.col("page").isNull() == F.col("none")) & (F.col("digest") == F.col("d")), "left")
    joined = joined.select("page", "url", "body", "digest", "refers")

    def run(batches):
        writer = None
        for batch in batches:
            places = []
            for k in range(batch.num_rows):
                page, link, data, digest, refers_to = (batch.column(c)[k].as_py() for c in ("page", "url", "body", "digest", "refers"))
                writer = writer or BundleWriter(f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst")
                record = build(page, link, data, digest, refers_to)
                places.append((page, record_id(page), writer.uri, *writer.add(record), len(record)))
                if writer.bytes >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in places], pa.int64() if c in (0, 3, 4, 5) else pa.string()) for c in range(6)], names=_INDEX.names)
        if writer:
            writer.close()

    joined.mapInArrow(run, _INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


_READ = T.StructType([T.StructField(n, k) for n, k in (("page_id", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("url", T.StringType()), ("payload", T.BinaryType()))])


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles in an index, bundle by bundle; a revisit's size and digest are those its headers state, a response's are taken from its payload."""
    bundles = index.select("bundle").distinct()
    n = bundles.count()
    folders = bundles.repartition(max(1, min(n, 10_000)))  # dealt in turn: a few names would fall unevenly by hash

    def run(batches):
        for batch in batches:
            for uri in batch.column("bundle").to_pylist():
                held, size = [], 0
                for r in BundleReader(uri).records():
                    head, data = r["head"], r["payload"]
                    kind = head["warc-type"]
                    refers = head.get("warc-refers-to")
                    stated = head["warc-payload-digest"].removeprefix("sha1:")
                    digest = stated if refers else hashlib.sha1(data).hexdigest()
                    if digest != stated:
                        raise ValueError(f"{uri}: {head['warc-record-id']} does not match its digest")
                    held.append((key_of(head["warc-record-id"]), int(r["http"]["content-length"]) if refers else len(data), digest, kind, key_of(refers) if refers else None, head.get("warc-target-uri"), data if payloads and not refers else None))
                    size += len(data) if payloads else 100
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, h, strict=True)) for h in held], schema=_arrow())
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, h, strict=True)) for h in held], schema=_arrow())

    return folders.mapInArrow(run, _READ)


def _arrow() -> pa.Schema:
    return pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def fetch(spark: SparkSession, index: DataFrame, key: int) -> bytes | None:
    """The payload of one page: its record's frame alone is read, and for a revisit that of the response it refers to."""
    found = index.where((F.col("page") == key) if key is not None else F.col("page").isNull()).select("bundle", "frame", "offset").orderBy("bundle", "frame", "offset").first()
    if found is None:
        return None
    record, _ = parse(BundleReader(found.bundle).frame(found.frame), found.offset)
    refers = record["head"].get("warc-refers-to")
    return fetch(spark, index, key_of(refers)) if refers else record["payload"]


def resolved(records: DataFrame) -> DataFrame:
    """Records without payloads, a revisit with the size of the response it refers to; fails where that response isn't there, or has another digest or size than the revisit states."""
    held = kept(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    response = held.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("stored")).distinct()
    revisit = held.where("record_type = 'revisit'").join(response, ["refers_to", "payload_digest"], "left")
    wrong = F.raise_error(F.concat(F.lit("no response of page "), F.col("refers_to").cast("string"), F.lit(" has the payload of a revisit"))).cast("long")
    revisit = revisit.withColumn("payload_bytes", F.when(F.col("stored") == F.col("payload_bytes"), F.col("stored")).otherwise(wrong))
    return held.where("record_type = 'response'").unionByName(revisit.select(*held.columns))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index = write(pages, new_folder(pages.sparkSession, "warc"), key, url, payload)
    return resolved(read(index, payloads=False))
