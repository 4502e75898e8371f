"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames of about ``frame_bytes``; after them come a
skippable frame with the record index (identifier to frame number and offset inside the
decompressed frame) and, last, the seek table of the public seekable format (skippable
frame with each frame's compressed and decompressed size). One record is read by fetching
the two tables and decompressing a single frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialise, pieces
from .storage import open_input, publish

# Fixed values of the seekable Zstandard format and of WARC 1.1.
SEEK_MAGIC, SEEK_END, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, first_frame_bytes long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, serial: int = 0) -> str:
    """A record's identifier; ``serial`` tells records of one page and payload apart."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}" + f":{serial}" * bool(serial)))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, serial: int = 0) -> tuple[str, bytes]:
    """(identifier, bytes) of a response record, or of a revisit if ``refers_to`` is given."""
    name = record_id(page_id, digest, serial)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{record_id(refers_to, digest)}>", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return name, VERSION + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(frame: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and payload of the record at an offset of a frame."""
    if frame[at : at + len(VERSION)] != VERSION:
        raise ValueError("no WARC record at this offset")
    end = frame.index(b"\r\n\r\n", at)
    fields = {}
    for line in frame[at + len(VERSION) : end].decode().split("\r\n"):
        key, _, value = line.partition(": ")
        fields[key.lower()] = value
    block = frame[end + 4 : end + 4 + int(fields["content-length"])]
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


class Bundle:
    """Writes one bundle; holds one frame of records and the two tables."""

    def __init__(self, out, frame_bytes: int = 256 << 10, level: int = 3):
        import zstandard

        self.zip, self.out, self.frame_bytes = zstandard.ZstdCompressor(level=level), out, frame_bytes
        self.held: list[bytes] = []
        self.size = self.written = self.records = 0
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int]] = []

    def add(self, name: str, data: bytes) -> None:
        self.index.append((name, len(self.frames), self.size))
        self.held.append(data)
        self.size += len(data)
        self.records += 1
        if self.size >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        data = self.zip.compress(b"".join(self.held))
        self.out.write(data)
        self.frames.append((len(data), self.size))
        self.written += len(data)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        index = self.zip.compress(b"".join(uuid.UUID(n).bytes + struct.pack("<II", f, at) for n, f, at in self.index))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class BundleReader:
    def __init__(self, f):
        import zstandard

        self.f, self.unzip = f, zstandard.ZstdDecompressor()
        size = f.seek(0, 2)
        f.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEK_END or flags & 0x80:
            raise ValueError("no seek table at the end")
        f.seek(size - 9 - 8 * n - 8)
        head, _ = struct.unpack("<II", f.read(8))
        if head != SEEK_MAGIC:
            raise ValueError("no seek table at the end")
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", f.read(8 * n)):
            self.frames.append((at, packed, plain))
            at += packed
        f.seek(at)
        head, length = struct.unpack("<II", f.read(8))
        if head != INDEX_MAGIC:
            raise ValueError("no record index after the frames")
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(f.read(length))
        self.index = [(raw[i : i + 16], *struct.unpack_from("<II", raw, i + 16)) for i in range(0, len(raw), 24)]
        self.places: dict[bytes, tuple[int, int]] | None = None
        self.kept: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.kept[0] != k:
            at, packed, plain = self.frames[k]
            self.f.seek(at)
            self.kept = k, self.unzip.decompress(self.f.read(packed), max_output_size=plain)
        return self.kept[1]

    def fetch(self, name: str) -> tuple[dict[str, str], bytes]:
        """The record with an identifier: one frame is decompressed."""
        if self.places is None:
            self.places = {key: (k, at) for key, k, at in self.index}
        k, at = self.places[uuid.UUID(name).bytes]
        return parse(self.frame(k), at)

    def records(self):
        for _, k, at in self.index:
            yield parse(self.frame(k), at)


def _revisits(pages: DataFrame, least: int, salts: int = 16) -> DataFrame:
    """(page_id, sha, refers_to) of rows whose payload a smaller page_id has too.

    Each payload's smallest page is found by a partial aggregate; it goes back to its rows
    by a join salted over ``salts`` parts, so a payload of very many pages isn't one task.
    """
    keys = pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least)).select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"))
    firsts = keys.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(salted, ["sha", "salt"]).where("page_id > refers_to").select("page_id", "sha", "refers_to").distinct()


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``serial``: 0, but for all rows of one page and payload except one a number of their own.

    Rows that repeat are numbered within the task that reads them and written, so no page
    that is repeated very often gathers anywhere.
    """
    again = materialise(rows.groupBy("page_id", "sha").count().where("count > 1").select("page_id", "sha"), "repeated-pages")
    if again.isEmpty():
        return rows.withColumn("serial", F.lit(0).cast("long"))
    same = lambda a, b: a["page_id"].eqNullSafe(b["page_id"]) & (a["sha"] == b["sha"])
    part = Window.partitionBy("page_id", "sha", "part").orderBy("url")
    repeated = rows.join(again, same(rows, again), "left_semi").withColumn("part", F.spark_partition_id()).withColumn("n", F.row_number().over(part).cast("long"))
    repeated = materialise(repeated, "repeated-rows")
    least = repeated.groupBy("page_id", "sha").agg(F.min("part").alias("least"))
    least = least.select(F.col("page_id").alias("l_page"), F.col("sha").alias("l_sha"), "least")
    serial = F.when((F.col("part") == F.col("least")) & (F.col("n") == 1), 0).otherwise(F.shiftleft(F.col("part").cast("long"), 40) + F.col("n"))
    named = repeated.join(least, F.expr("page_id <=> l_page AND sha = l_sha")).withColumn("serial", serial).select(*rows.columns, "serial")
    return rows.join(again, same(rows, again), "left_anti").withColumn("serial", F.lit(0).cast("long")).unionByName(named)


def write_bundles(pages: DataFrame, out_dir: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = 256 << 10, bundle_bytes: int = 256 << 20) -> DataFrame:
    """Write a record for each row (page_id, url, html); returns the manifest of bundles.

    Null html counts as empty. Of rows with equal payloads of at least ``least`` bytes, the
    smallest page_id is a response and larger ones revisit it; rows that share that page_id,
    or have none, are responses too, each with an identifier of its own. An empty table gives
    no bundle. Other columns are ignored. Bundles are published by rename and only finished tasks' bundles are listed.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    again = _revisits(rows, least)
    numbered = _numbered(rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))))
    marked = numbered.join(again.hint("SHUFFLE_HASH"), ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to", "serial")

    def run(batches):
        bundle = out = file = None

        def finish():
            bundle.close()
            out.close()
            return pa.RecordBatch.from_pylist([{"path": file.done(), "records": bundle.records, "first_frame_bytes": bundle.frames[0][0]}])

        for b in pieces(batches):
            for page, url, html, refers, serial in zip(*(c.to_pylist() for c in b.columns)):
                if bundle is None:
                    file = publish(out_dir, f"bundle-{uuid.uuid4().hex}.warc.zst")
                    out = file.open()
                    bundle = Bundle(out, frame_bytes)
                payload = html.encode("utf-8", "surrogatepass")
                bundle.add(*record(page, url, payload, base32_sha1(payload), refers, date, serial))
                if bundle.written >= bundle_bytes:
                    yield finish()
                    bundle = None
        if bundle is not None:
            yield finish()

    return materialise(marked.mapInArrow(run, MANIFEST), "warc-manifest")


def read_bundles(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the bundles, digests and lengths of responses taken from the payload."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                with open_input(path) as f:
                    rows = []
                    for head, payload in BundleReader(f).records():
                        kind, digest, size = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                        if kind == "response" and (base32_sha1(payload) != digest or len(payload) != size):
                            raise ValueError(f"damaged record in {path}")
                        rows.append((int(x) if (x := head.get("x-page-id")) else None, size, digest, kind, int(x) if (x := head.get("x-refers-to-page")) else None, head.get("warc-target-uri"), *[payload] * with_payload))
                        if len(rows) == 1000:
                            yield _batch(rows, schema)
                            rows = []
                    if rows:
                        yield _batch(rows, schema)

    return manifest.select("path").repartition("path").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def archive_and_read(pages: DataFrame, **how) -> DataFrame:
    """Write bundles into the shared folder and read the records back from them."""
    return read_bundles(write_bundles(pages, fresh_path(pages.sparkSession, "warc"), **how))
