import base64
import hashlib
import io

import pytest
import zstandard

from parcelflow.llm import warc
from parcelflow.llm.common import store

PAGES = "page_id long, url string, html string, first long, same string, refers_to int, bundle string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2, "b") for r in rows], PAGES)


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        to = first.get(html or "")
        to = None if to is None or to == page else to
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


ROWS = [(i, f"http://h/{i}", "é" * (i % 7) + "x" * (i % 3) if i % 5 else None) for i in range(300)] + [
    (1000, None, "y" * 3_000_000), (1001, "http://h/\r\nX: y", "a\r\n\r\nWARC/1.1\r\n"), (1002, "", ""), (1003, "http://h/é", "\0\1"), (None, "u", "only"), (None, "u", "é"), (7, "http://h/7", "x"), (7, "http://h/7", "x"),
]


def test_round_trip(spark):
    root = warc.archive_root(spark)
    manifest = warc.write_archives(table(spark, ROWS).repartition(3), root, frame_bytes=500, bundle_bytes=2000)
    got = warc.read_archives(manifest, root).drop("url").collect()
    assert sorted([r[:] for r in got], key=str) == expected(ROWS)
    assert manifest.select("bundle").distinct().count() > 3
    urls, idents = {}, []
    for name in {r["bundle"] for r in manifest.collect()}:
        raw = root.source(name)[0].read()
        # any reader of Zstandard unpacks the whole bundle, the seek table being a frame to skip
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        at = 0
        while at < len(whole):
            fields, block, at = warc.parse(whole, at)
            urls[fields["Page-ID"]] = fields["WARC-Target-URI"]
            idents.append(fields["WARC-Record-ID"])
            assert fields["WARC-Block-Digest"] == "sha1:" + warc.digest32(block)
    assert len(set(idents)) == len(idents) - 2  # those of the response repeated whole
    big = manifest.filter("page_id = 1000").first()
    assert manifest.filter((manifest.bundle == big["bundle"]) & (manifest.frame == big["frame"])).count() == 1
    assert urls["1001"] == "http://h/%0D%0AX: y" and urls["1003"] == "http://h/é"


def test_least_bytes_and_fetch(spark):
    root = warc.archive_root(spark)
    manifest = warc.write_archives(table(spark, ROWS), root, least_bytes=4, frame_bytes=1000)
    got = [r[:] for r in warc.read_archives(manifest, root).drop("url").collect()]
    assert sorted(got, key=str) == expected(ROWS, 4)
    texts = {p: h for p, _, h in ROWS}
    found = dict(warc.fetch(manifest, root, [r["record_id"] for r in manifest.filter("page_id in (1, 1000, 1001)").collect()]))
    assert found == {p: (texts[p] or "").encode() for p in (1, 1000, 1001)}


def test_damage_is_found(spark):
    raw = warc.record("<urn:x>", 1, "u", b"payload", None)
    fields, block, end = warc.parse(raw)
    assert end == len(raw) and warc._record_row(fields, block)[2] == 7
    with pytest.raises(ValueError):
        warc._record_row(fields, block.replace(b"pay", b"pax"))
    with pytest.raises(ValueError):
        warc.parse(raw[:-6])
    with pytest.raises(ValueError):
        warc._record_at(raw, 0, len(raw), "<urn:y>")


def test_mounted_address_and_shuffled_digests(spark, tmp_path, monkeypatch):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.depot.link./shared", f"file://{tmp_path}")
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", -1)
    root = store(spark, "viewfs://depot/shared/warc")
    manifest = warc.write_archives(table(spark, ROWS), root)
    assert sorted([r[:] for r in warc.read_archives(manifest, root).drop("url").collect()], key=str) == expected(ROWS)


def test_oracle(spark, tmp_path):
    rows = [r for r in ROWS if r[0] is not None]
    duckdb = pytest.importorskip("duckdb").connect()
    table(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(duckdb.sql(warc.ORACLE).fetchall(), key=str) == expected(rows)


def test_empty(spark):
    root = warc.archive_root(spark)
    manifest = warc.write_archives(spark.createDataFrame([], PAGES), root)
    assert warc.read_archives(manifest, root).count() == 0
