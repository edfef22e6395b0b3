"""WARC bundles of independent Zstandard frames with a seek table.

Records fill a frame until it holds FRAME_BYTES; each frame is compressed on its own. A bundle ends with the seek table
of the Zstandard seekable format (a skippable frame of frame sizes), so any zstd reader unpacks the whole bundle and a
seeking reader unpacks one frame. The manifest, a Parquet table that Spark commits, maps each record identifier to its
bundle, frame and offset inside the frame. Bundles are written under names no other attempt uses; those of lost
attempts are in no manifest and so are never read.

Defined results: a null payload is empty; null addresses become empty ones, line ends in them are percent-encoded; of
equal payloads of at least `least_bytes`, rows with the smallest page_id are responses (all of them, if rows repeat) and
the others revisit it; if every page_id of a group is null, all are responses; a record larger than a frame has a frame
of its own; an empty table gives no bundle; other columns are ignored. Identifiers are unique, but for responses repeated
with one page_id and payload: that is what revisits refer to, and it is made from both.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm.common import Store, materialize, prepare, scratch, store, trimmed

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
#: Packed bytes that one reading task takes, about.
TASK_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digests of repeated payloads up to this many rows are broadcast; beyond it pages are joined by shuffle.
BROADCAST_DIGESTS = 300_000
# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER_BYTES = 9

MANIFEST = "page_id long, record_id string, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(what: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, what)}>"


def page_record(page_id: int, payload: bytes) -> str:
    """Identifier of the response that others with its payload revisit."""
    return record_id(f"page:{page_id}:{digest32(payload)}")


def record(ident: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the response's HTTP header and no payload."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", ident),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", page_record(refers_to, payload)), ("Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0):
    """(fields, block, next offset) of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError(f"record at {at} is cut off")
    return fields, block, end + 8 + size


class Bundle:
    """A bundle being written."""

    def __init__(self, root: Store, name: str):
        import zstandard

        self.name, self.out, self.records = name, root.sink(name, compression=None), 0
        self.compressor, self.sizes, self.written, self.frame, self.rows = zstandard.ZstdCompressor(level=3, write_checksum=True), [], 0, io.BytesIO(), []

    def next_id(self) -> str:
        self.records += 1
        return record_id(f"{self.name}/{self.records}")

    def add(self, ident: str, page_id, raw: bytes) -> None:
        self.rows.append((page_id, ident, self.name, len(self.sizes), self.written, 0, self.frame.tell(), len(raw)))
        self.frame.write(raw)

    def cut(self) -> list[tuple]:
        """End the frame; its manifest rows."""
        raw = self.frame.getvalue()
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.sizes.append((len(packed), len(raw)))
        rows = [(*r[:5], len(packed), *r[6:]) for r in self.rows]
        self.written, self.frame, self.rows = self.written + len(packed), io.BytesIO(), []
        return rows

    def close(self) -> None:
        body = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()


def _batch(rows: list[tuple], kinds, names):
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _manifest_batch(rows):
    return _batch(rows, [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()], [x.split()[0] for x in MANIFEST.split(", ")])


def _write(root: Store, frame_bytes: int, bundle_bytes: int):
    def run(batches):
        bundle = None
        for batch in batches:
            for page, url, html, to, named in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "named"))):
                if bundle is None:
                    bundle = Bundle(root, f"bundle-{uuid.uuid4().hex}.warc.zst")
                page = page.as_py()
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                ident = page_record(page, payload) if named.as_py() else bundle.next_id()
                raw = record(ident, page, url.as_py(), payload, to.as_py())
                if len(raw) >= frame_bytes and bundle.rows:
                    yield _manifest_batch(bundle.cut())
                bundle.add(ident, page, raw)
                if bundle.frame.tell() >= frame_bytes:
                    yield _manifest_batch(bundle.cut())
                    if bundle.written >= bundle_bytes:
                        bundle.close()
                        bundle = None
        if bundle is not None:
            if bundle.rows:
                yield _manifest_batch(bundle.cut())
            bundle.close()

    return run


def write_archives(pages: DataFrame, root: Store, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) below root; returns the manifest, already written."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.sha2("html", 256)
    same = rows.filter(F.octet_length("html") >= least_bytes).groupBy(key.alias("same")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n")
    same = materialize(same, "warc-same")
    side = F.broadcast(same) if same.count() <= BROADCAST_DIGESTS else same
    rows = rows.join(side, key == F.col("same"), "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    named = F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)).alias("named")
    return materialize(rows.select("page_id", "url", "html", "refers_to", named).mapInArrow(trimmed(_write(root, frame_bytes, bundle_bytes)), MANIFEST), "warc-manifest")


def seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(start, packed bytes, bytes) of each frame, from a bundle's footer."""
    f.seek(size - FOOTER_BYTES)
    n, _, magic = struct.unpack("<IBI", f.read(FOOTER_BYTES))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    f.seek(size - FOOTER_BYTES - 8 * n)
    raw, out, at = f.read(8 * n), [], 0
    for i in range(n):
        packed, whole = struct.unpack_from("<II", raw, 8 * i)
        out.append((at, packed, whole))
        at += packed
    return out


def _record_row(fields: dict, block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload), digest32(payload)) != (size, digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda x: int(x) if x else None
    return number(fields["Page-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], number(fields.get("Refers-To-Page-ID")), payload if fields["WARC-Type"] == "response" else None


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record_at(data: bytes, offset: int, length: int, ident: str) -> tuple:
    """The record that the manifest maps an identifier to."""
    fields, block, end = parse(data, offset)
    if fields["WARC-Record-ID"] != ident or end != offset + length:
        raise ValueError(f"another record in place of {ident}")
    return _record_row(fields, block)


def _frame(f, start: int, packed: int, whole: int) -> bytes:
    import zstandard

    f.seek(start)
    return zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=whole)


def _read(root: Store):
    def run(batches):
        name, f, table = None, None, {}
        for batch in batches:
            for bundle, start, records in zip(batch.column("bundle").to_pylist(), batch.column("frame_start").to_pylist(), batch.column("records").to_pylist()):
                if bundle != name:
                    if f is not None:
                        f.close()
                    f, size = root.source(bundle)
                    name, table = bundle, {at: (packed, whole) for at, packed, whole in seek_table(f, size)}
                data = _frame(f, start, *table[start])
                rows = [_record_at(data, r["offset"], r["length"], r["record_id"])[:6] for r in sorted(records, key=lambda r: r["offset"])]
                yield _batch(rows, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()], [x.split()[0] for x in _READ.split(", ")])
        if f is not None:
            f.close()

    return run


def read_archives(manifest: DataFrame, root: Store) -> DataFrame:
    """Every record of the manifest, by its frame and offset: a frame in memory at a time; payloads are checked against their digests.

    A bundle is read by one task, TASK_BYTES of bundles by each, or fewer where that leaves cores idle.
    """
    prepare(manifest.sparkSession)
    ends = manifest.groupBy("bundle").agg(F.max(F.col("frame_start") + F.col("frame_bytes")).alias("size"))
    count, size = ends.agg(F.count(F.lit(1)), F.sum("size")).first()
    tasks = max(1, min(count, max(2 * manifest.sparkSession.sparkContext.defaultParallelism, (size or 0) // TASK_BYTES)))
    frames = manifest.groupBy("bundle", "frame_start").agg(F.collect_list(F.struct("offset", "length", "record_id")).alias("records"))
    dealt = frames.repartitionByRange(tasks, "bundle").sortWithinPartitions("bundle", "frame_start")
    return dealt.mapInArrow(trimmed(_read(root)), _READ)


def fetch(manifest: DataFrame, root: Store, record_ids: list[str]) -> list[tuple]:
    """(page_id, payload) of a few records, by seeking to their frames only; a revisit has payload None."""
    out = []
    for r in manifest.filter(F.col("record_id").isin(record_ids)).collect():
        f, size = root.source(r["bundle"])
        with f:
            sizes = {at: (packed, whole) for at, packed, whole in seek_table(f, size)}
            data = _frame(f, r["frame_start"], *sizes[r["frame_start"]])
        row = _record_at(data, r["offset"], r["length"], r["record_id"])
        out.append((row[0], row[6]))
    return out


def archive_root(spark: SparkSession) -> Store:
    return store(spark, scratch(spark, "warc"))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    root = archive_root(spark)
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read_archives(manifest, root).drop("url")


#: Base 32 of a SHA-1: its 40 hexadecimal digits as bits, five of them a letter.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT html, min(page_id) AS first, array_to_string([['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][
  instr('0123456789abcdef', x)] FOR x IN string_split(sha1(html), '')], '') AS bits FROM p GROUP BY html),
k AS (SELECT html, first, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
  + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1) FOR i IN range(32)], '') AS digest FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN k USING (html)
"""
