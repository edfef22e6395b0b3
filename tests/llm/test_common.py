import hashlib
from types import SimpleNamespace

import numpy as np
import pytest

from parcelflow.llm import common


def test_collecting(spark):
    with common.collecting(spark):
        df = common.materialize(spark.range(5), "kept")
        with common.collecting(spark):
            inner = common.materialize(spark.range(3), "inner")
        path, fs = common._hadoop(spark, df.parcelflow_path)
        assert df.count() == 5 and fs.exists(path) and not fs.exists(common._hadoop(spark, inner.parcelflow_path)[0])
    assert not fs.exists(path)


def test_mounted_store(spark, tmp_path):
    """A folder behind a mounted address, which only Hadoop knows."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shop.link./shared", f"file://{tmp_path}")
    kept = common.store(spark, "viewfs://shop/shared/files")
    with kept.sink("x") as out:
        out.write(b"abc")
    f, size = kept.source("x")
    assert kept.uri == f"file:{tmp_path}/files" and f.read() == b"abc" and size == 3


def test_store_of_s3_addresses():
    """By the names that Spark's connector has for them, with its settings; nothing is asked of any server yet."""
    options = tuple((name, "us-east-1" if name == "region" else "x") for name in common.S3_SETTINGS.values() if name != "endpoint_override")
    for scheme in ("s3", "s3a", "s3n"):
        fs, path = common.Store(f"{scheme}://bucket/some/folder", options).open()
        assert fs.type_name == "s3" and path == "bucket/some/folder"


def test_shared_folder_is_needed_off_local_masters():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        common.scratch_root(session)


def test_row_key(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "a", None), (1, "a", "b"), (1, "ab", ""), (1, "a", "b")], "a long, b string, c string")
    assert df.select(common.row_key(df)).distinct().count() == 4


def test_rolling_matches_direct_sums():
    x = np.random.default_rng(1).integers(0, 2**63, 300_000).astype(np.uint64)
    roll = common.Rolling(0x9E3779B97F4A7C15)
    prefix = roll.prefix(x)
    got = roll.runs(prefix, np.array([0, 7, 299_990]), 10)
    want = [sum(int(v) * pow(roll.base, j, 1 << 64) for j, v in enumerate(x[s : s + 10])) % (1 << 64) for s in (0, 7, 299_990)]
    assert got.tolist() == want and len(roll.runs(prefix, None, 10)) == 299_991 and len(roll.runs(prefix[:5], None, 10)) == 0


def test_words():
    assert common.words_of("a\x1cb   c\x0bd\n\té") == ["a\x1cb".encode(), " ".encode(), b"c", b"d", "é".encode()] and common.words_of(None) == []
    assert [p for p in common.pieces([1, 9, 2, 2], lambda r: r, 5)] == [[1], [9], [2, 2]]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
