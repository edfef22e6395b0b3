"""Shared pieces: written tables that cut lineage, word splitting and vectorised hashing."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where intermediate tables go if the session names no shared folder; only for a local master.
LOCAL_SCRATCH = "file:///tmp/checkpoints/parcelflow"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Lists that take the paths of written tables, the innermost last; see collecting().
_collectors: ContextVar[tuple[list[str], ...]] = ContextVar("parcelflow_collectors", default=())
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library; freed memory then stays with the worker
    _LIBC = None
#: A word of a text, as the contracts define it; ASCII white space parts words.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """What a session needs before any Python function is made: the package on its workers, and small Arrow batches.

    The one setting of the session that operators change is the byte limit of Arrow batches, and only from Spark's
    default, which is large for workers that hold several copies of a batch.
    """
    ship(spark)
    if spark.conf.get(ARROW_BYTES) == "67108864b":
        spark.conf.set(ARROW_BYTES, "4m")


def _hadoop(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names, as a whole address; off a local master there must be one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path, fs = _hadoop(spark, named or LOCAL_SCRATCH)
    fs.mkdirs(path)
    # Mounted addresses (viewfs) become those of the store behind them.
    return fs.resolvePath(path).toString().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    note(path)
    return path


def note(path: str) -> None:
    for paths in _collectors.get()[-1:]:
        paths.append(path)


def delete(spark: SparkSession, path: str) -> None:
    path, fs = _hadoop(spark, path)
    fs.delete(path, True)


@contextmanager
def noting():
    """Paths of the tables that operators write inside, in this thread."""
    paths: list[str] = []
    token = _collectors.set((*_collectors.get(), paths))
    try:
        yield paths
    finally:
        _collectors.reset(token)


@contextmanager
def collecting(spark: SparkSession):
    """noting(); all of them are deleted at the end, but for those that are taken off the list. Results must have been stored by then."""
    with noting() as paths:
        try:
            yield paths
        finally:
            for path in paths:
                delete(spark, path)


def reads(df: DataFrame, paths: list[str]) -> bool:
    """Whether df's plan reads files below any of these paths."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        roots = leaf.relation().location().rootPaths().mkString("\n") if leaf.getClass().getSimpleName() == "LogicalRelation" else ""
        if any(path.rpartition("/")[2] in roots for path in paths):
            return True
    return False


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor costs no recomputation beyond this table."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.parcelflow_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more."""
    for df in tables:
        delete(df.sparkSession, df.parcelflow_path)


@dataclass(frozen=True)
class Store:
    """Files below an address that workers reach without Spark: local ones and every store that pyarrow knows."""

    uri: str
    options: tuple = ()

    def open(self):
        """(file system, path of the folder)."""
        scheme, _, rest = self.uri.partition(":")
        if scheme == "file":
            return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
        if scheme in ("s3", "s3a", "s3n"):
            return pafs.S3FileSystem(**dict(self.options)), rest.lstrip("/")
        return pafs.FileSystem.from_uri(self.uri)

    def sink(self, name: str, **options):
        fs, base = self.open()
        fs.create_dir(base, recursive=True)
        return fs.open_output_stream(f"{base}/{name}", **options)

    def source(self, name: str):
        """(random access file, its size)."""
        fs, base = self.open()
        path = f"{base}/{name}"
        return fs.open_input_file(path), fs.get_file_info(path).size


#: Settings of Spark's S3 connector and what they are called here.
S3_SETTINGS = {"fs.s3a.access.key": "access_key", "fs.s3a.secret.key": "secret_key", "fs.s3a.session.token": "session_token", "fs.s3a.endpoint": "endpoint_override", "fs.s3a.endpoint.region": "region"}


def store(spark: SparkSession, path: str) -> Store:
    """The store at a path, with the session's own settings of it."""
    path, fs = _hadoop(spark, path)
    fs.mkdirs(path)
    uri, conf = fs.resolvePath(path).toString().rstrip("/"), spark._jsc.hadoopConfiguration()
    found = {ours: conf.get(name) for name, ours in S3_SETTINGS.items()} if uri.startswith("s3") else {}
    return Store(uri, tuple((k, v) for k, v in found.items() if v))


def text_key(text: Column) -> Column:
    """128-bit digest that stands for a text."""
    return F.unhex(F.md5(text))


def row_key(df: DataFrame) -> Column:
    """128-bit digest of all columns; nulls are marked, and lengths part one value from the next."""
    parts = []
    for f in df.schema.fields:
        value = F.col("`" + f.name.replace("`", "``") + "`")
        plain = not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        value = value.cast("string") if plain else F.to_json(F.struct(value), {"ignoreNullFields": "false"})
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.md5(F.concat(*parts)))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run, once per application."""
    context = spark.sparkContext
    if not getattr(context, "_parcelflow_shipped", False):
        package = Path(__file__).resolve().parents[1]
        folder = os.path.realpath(tempfile.mkdtemp(prefix="parcelflow-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/parcelflow-code.zip", "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(f"{folder}/parcelflow-code.zip")
        context._parcelflow_shipped = True


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers live on, and share an executor with what comes next."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def trimmed(run):
    """A function over Arrow batches that gives memory back when its task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def word_count(text: Column) -> Column:
    """Words of a text, JVM-side; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8. bytes.split() parts at exactly the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of all runs of k consecutive items, from one prefix sum."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def prefix(self, x: np.ndarray) -> np.ndarray:
        self._grow(len(x) + 1)
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[: len(x)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, starts: np.ndarray | None, k: int) -> np.ndarray:
        """Hash of k items at each start (all starts if None)."""
        if starts is None:
            n = max(0, len(prefix) - k)
            return (prefix[k : k + n] - prefix[:n]) * self.down[:n]
        return (prefix[starts + k] - prefix[starts]) * self.down[starts]


def pieces(rows: list, weight, most: int):
    """Split rows into lists of about `most` total weight; a heavier row stands alone."""
    part, total = [], 0
    for row in rows:
        w = weight(row)
        if part and total + w > most:
            yield part
            part, total = [], 0
        part.append(row)
        total += w
    if part:
        yield part
