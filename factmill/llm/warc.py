"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each holding some whole WARC records, then a skippable frame with the
seek table (compressed and decompressed size of each frame) of the Zstandard seekable format. The index, a Parquet table
beside the bundles, maps each record to its bundle, frame and place within the frame, so that one record costs one ranged read.

Bundles are written from the executors to the shared folder through pyarrow's file systems, under a name of their own per
attempt and then moved to the name that depends on the bundle alone; a repeated task writes the same bytes.
"""

from __future__ import annotations

import base64
import struct
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, cut

#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1

FRAME_BYTES, BUNDLE_BYTES, SMALLEST_REVISIT = 256 << 10, 8 << 20, 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_urn(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page, url, digest_hex: str, size: int, payload: bytes | None, refers_to) -> bytes:
    """A response record with its payload, or a revisit record of another one without it (payload None)."""
    head = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", record_urn(page)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join((url or f"urn:page:{page}").split())),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()),
        ("X-Page-Id", "" if page is None else str(page)),
        ("X-Payload-Length", str(size)),
    ]
    if payload is None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_urn(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b"")
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers and payload of the record at this place, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    begin, size = end + 4, int(head["Content-Length"])
    body = data[begin : begin + size]
    return head, body[body.index(b"\r\n\r\n") + 4 :], begin + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame."""
    count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    entries, at, out = file.read_at(count * width, size - 9 - count * width), 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", entries, k * width)
        out.append((at, packed, plain))
        at += packed
    return out


def place(uri: str):
    """A pyarrow file system and path for a URI such as file:///..., hdfs://..., s3://..., gs://...."""
    return fs.FileSystem.from_uri(uri)


class Bundle:
    """Writes one bundle: records go to frames of about frame_bytes, never split."""

    def __init__(self, folder: str, name: str, frame_bytes: int, level: int):
        import zstandard

        self.fs, base = place(folder)
        self.path, self.temporary = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.packer, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames, self.waiting = [], bytearray()

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset within the frame's plain bytes."""
        if self.waiting and len(self.waiting) + len(data) > self.frame_bytes:
            self.flush()
        at = len(self.frames), len(self.waiting)
        self.waiting += data
        return at

    def flush(self):
        if self.waiting:
            packed = self.packer.compress(bytes(self.waiting))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.waiting)))
            self.waiting.clear()

    def close(self):
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(self.temporary, self.path)


INDEX = "bundle long, record_id string, frame int, frame_offset long, bytes long"


def write_bundles(pages: DataFrame, refers: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> DataFrame:
    """Write pages (page_id, url, payload, digest, size) to bundles in folder, those that refers (page_id, digest, refers_to) names as
    revisits; and the index to folder/index, which is returned. A page and what it refers to meet in the one shuffle that
    brings payloads to their bundle."""
    bundles = buckets_for(pages.agg(F.coalesce(F.sum(F.col("size") + 600), F.lit(0))).first()[0], bundle_bytes)
    where, base = place(folder)
    where.create_dir(base, recursive=True)

    def write(batches):
        open_bundle, number, current, known = None, None, None, {}
        for batch in batches:
            rows = batch.to_pydict()
            out = []
            for bundle, page, _, url, payload, digest, n, refers_to in zip(*rows.values()):
                if bundle != number:
                    if open_bundle:
                        open_bundle.close()
                    open_bundle, number = Bundle(folder, f"bundle-{bundle:08d}.warc.zst", frame_bytes, level), bundle
                if page != current:
                    current, known = page, {}
                if refers_to is not None:  # comes before the pages with its page_id
                    known[digest] = refers_to
                    continue
                target = known.get(digest)
                data = record(page, url, digest, n, None if target is not None else payload.encode(), target)
                out.append((bundle, record_urn(page), *open_bundle.add(data), len(data)))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], INDEX.replace(",", "").split()[::2])
        if open_bundle:
            open_bundle.close()

    bundle = F.pmod(F.xxhash64("page_id"), F.lit(bundles)).alias("bundle")
    spread = pages.select(bundle, "page_id", F.lit(1).alias("kind"), F.col("url").cast("string"), "payload", "digest", "size", F.lit(None).cast("long").alias("refers_to")).union(
        refers.select(bundle, "page_id", F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string"), "digest", F.lit(None).cast("long"), "refers_to")
    )
    ordered = spread.repartition("bundle").sortWithinPartitions("bundle", "page_id", "kind")
    ordered.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def fetch(folder: str, bundle: int, frame: int, frame_offset: int) -> tuple[dict, bytes]:
    """One record by its index entry: the seek table, one ranged read, one frame."""
    import zstandard

    where, base = place(folder)
    with where.open_input_file(f"{base}/bundle-{bundle:08d}.warc.zst") as file:
        at, packed, _ = read_seek_table(file, file.size())[frame]
        return parse(zstandard.ZstdDecompressor().decompress(file.read_at(packed, at)), frame_offset)[:2]


READ_BUNDLES = 2
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_bundles(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Every record of the index, read back from its frame: payload_bytes and payload_digest are those of the full payload;
    a response's are computed from its payload and held against the headers."""
    import hashlib

    def read(batches):
        import zstandard

        where, base = place(folder)
        unpacker, file, table, number, data, kept = zstandard.ZstdDecompressor(), None, [], None, b"", None
        for batch in batches:
            out = []
            for bundle, frame, offset in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "frame_offset"))):
                if bundle != number:
                    if file:
                        file.close()
                    file, number, kept = where.open_input_file(f"{base}/bundle-{bundle:08d}.warc.zst"), bundle, None
                    table = read_seek_table(file, file.size())
                if frame != kept:
                    at, packed, _ = table[frame]
                    data, kept = unpacker.decompress(file.read_at(packed, at)), frame
                head, payload, _ = parse(data, offset)
                digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                size, kind, page = int(head["X-Payload-Length"]), head["WARC-Type"], head["X-Page-Id"]
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"record of page {page} is damaged")
                refers = head.get("X-Refers-To-Page")
                out.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], READ.replace(",", "").split()[::2])
        if file:
            file.close()

    bundles = index.agg(F.max("bundle")).first()[0]
    # the index is small, what it points to isn't: a task reads about READ_BUNDLES bundles
    tasks = -(-((bundles or 0) + 1) // READ_BUNDLES)
    entries = index.select("bundle", "frame", "frame_offset").repartition(tasks, "bundle").sortWithinPartitions("bundle", "frame", "frame_offset")
    return entries.mapInArrow(read, READ)


def archive(df: DataFrame, folder: str, smallest: int = SMALLEST_REVISIT, html_col: str = "html") -> DataFrame:
    """Write page_id, url, html to bundles in folder, with revisit records for repeated payloads; returns the index.

    Of records with equal payloads (SHA-1 and length) of at least `smallest` bytes the one with the largest page_id is a
    response; the others refer to it. Rows that repeat a page_id with the same payload are each written, and each is
    a response if that page_id is the largest. A null html is the empty payload, a null url becomes urn:page:<id>, and a row
    without a page_id is a response. An empty table writes no bundle. Payloads move once, to their bundle; only hashes are grouped.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    hashed = cut(df.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size")))
    first = hashed.filter(F.col("size") >= smallest).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    refers = (
        hashed.join(first.filter("n > 1").drop("n"), ["digest", "size"])
        .filter("page_id < first")
        .select("page_id", "digest", F.col("first").alias("refers_to"))
        .distinct()
    )
    rows = df.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    return write_bundles(rows, refers, folder)
