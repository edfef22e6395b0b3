"""Removal of repeated passages through a log-structured fingerprint index.

A window is `window` consecutive words of one document. Each window is represented by the smallest hash among its runs
of GRAM words (its anchor), so equal windows share an anchor and about one word in twelve is an anchor. The index holds
anchors in immutable runs: tables bucketed and sorted by fingerprint, so that a new batch is merge-joined with every older run
without a shuffle of it; compaction merges runs into one. Anchors that occur twice only nominate: the windows they
stand for are then compared by 128 bits of hashes over all their words, and only windows found twice are removed. Equal
texts are told by a 128-bit digest.

Defined results: null and empty texts have no words; documents shorter than a window lose nothing; repeated rows are
occurrences of their own, so each copy of a text of a window or more loses all its words; texts of any length are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm.common import Rolling, delete, discard, materialize, mixed, pieces, prepare, scratch, text_key, trimmed, word_hashes, words_of

WINDOW = 35
GRAM = 12
#: Words that one vectorised step hashes, about.
STEP_WORDS = 400_000
#: Keys of texts up to this many are broadcast (16 bytes, some 60 in memory); beyond it the join shuffles.
BROADCAST_KEYS = 500_000
_FIRST, _SECOND = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95)

ANCHORS = "doc_id {id}, key binary, n_words long, full_sha string, grams array<long>, starts array<int>, spans array<int>"


def _sliding_argmin(x: np.ndarray, k: int) -> np.ndarray:
    """Position of the leftmost minimum of each run of k items, by doubling."""
    best, width = np.arange(len(x)), 1
    while width < k:
        step = min(width, k - width)
        a, b = best[:-step], best[step:]
        best = np.where(x[b] < x[a], b, a)
        width += step
    return best


def anchors_of(lengths: np.ndarray, hashes: np.ndarray, window: int):
    """Of documents laid end to end: (document, gram, first window start, windows) of each anchor."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none, none
    grams = mixed(_FIRST.runs(_FIRST.prefix(hashes), None, GRAM))
    best = _sliding_argmin(grams, window - GRAM + 1)
    owner = np.repeat(np.arange(len(lengths)), lengths)[: len(best)]
    at = np.arange(len(best))
    fits = at + window <= offsets[owner + 1]
    at, owner, best = at[fits], owner[fits], best[fits]
    if not len(at):
        return none, none, none, none
    first = np.concatenate(([True], (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])))
    where = np.flatnonzero(first)
    spans = np.diff(np.concatenate((where, [len(at)])))
    return owner[where], grams[best[where]].view(np.int64), at[where] - offsets[owner[where]], spans


def _lists(counts: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def _fingerprint(window: int):
    def run(batches):
        for batch in batches:
            ids, keys, texts = batch.column("doc_id"), batch.column("key"), batch.column("text")
            rows = [(i, words_of(t.as_py())) for i, t in enumerate(texts)] if len(texts) else []
            for part in pieces(rows, lambda r: len(r[1]), STEP_WORDS):
                lengths = np.array([len(w) for _, w in part], np.int64)
                hashes = word_hashes([x for _, w in part for x in w])
                owner, grams, starts, spans = anchors_of(lengths, hashes, window)
                counts = np.bincount(owner, minlength=len(part))
                pick = pa.array([i for i, _ in part], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pick),
                        keys.take(pick),
                        pa.array(lengths),
                        pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for _, w in part], pa.string()),
                        _lists(counts, grams, pa.int64()),
                        _lists(counts, starts, pa.int32()),
                        _lists(counts, spans, pa.int32()),
                    ],
                    names=["doc_id", "key", "n_words", "full_sha", "grams", "starts", "spans"],
                )

    return run


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def fingerprint(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document: doc_id, key (128-bit digest of its text), n_words, full_sha (of all words), and its anchors as arrays."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", _text().alias("text")).withColumn("key", text_key(F.col("text")))
    return rows.mapInArrow(trimmed(_fingerprint(window)), ANCHORS.format(id=docs.schema["doc_id"].dataType.simpleString()))


class FingerprintIndex:
    """Sorted immutable runs (gram, n), each bucketed by gram; see the module's text."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[str, str]] = []

    def _write(self, counts: DataFrame) -> tuple[str, str]:
        name, path = f"parcelflow_run_{uuid.uuid4().hex}", scratch(self.spark, "run")
        counts.write.option("compression", "zstd").option("path", path).bucketBy(self.buckets, "gram").sortBy("gram").format("parquet").saveAsTable(name)
        return name, path

    def take(self, grams: DataFrame) -> DataFrame:
        """Append a batch's anchors (gram) as a new run; returns those that now occur twice or more: in the batch, or in it and in history.

        The batch's own run is sorted as the older ones are, so each is merge-joined with it bucket by bucket, without a shuffle.
        """
        older = [name for name, _ in self.runs]
        self.runs.append(self._write(grams.select("gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))))
        batch = self.spark.table(self.runs[-1][0])
        found = batch.filter("n > 1").select("gram")
        for name in older:
            found = found.union(batch.select("gram").join(self.spark.table(name).hint("merge"), "gram", "left_semi"))
        return found.distinct()

    def compact(self) -> None:
        """Merge all runs into one. Buckets line up, so rows move only if the planner finds that cheaper."""
        if len(self.runs) > 1:
            merged = self._write(self.entries())
            self.drop()
            self.runs = [merged]

    def entries(self) -> DataFrame:
        """gram, n over all runs: a merge join of the sorted runs, newest last."""
        out = self.spark.table(self.runs[0][0])
        for name, _ in self.runs[1:]:
            new = self.spark.table(name).withColumnRenamed("n", "m")
            out = out.hint("merge").join(new, "gram", "full").select("gram", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def drop(self) -> None:
        for name, path in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, path)
        self.runs = []


def _windows(window: int):
    """Windows that nominated anchors stand for, by two independent hashes of all their words: 128 bits."""

    def run(batches):
        for batch in batches:
            tids, texts, ranges = batch.column("tid").to_pylist(), batch.column("text"), batch.column("ranges")
            for tid, text, own in zip(tids, texts, ranges):
                hashes = word_hashes(words_of(text.as_py()))
                own = own.values
                s, n = (own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("s", "n"))
                order = np.argsort(s, kind="stable")
                s, n = s[order], n[order]
                at = np.repeat(s - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
                a = mixed(_FIRST.runs(_FIRST.prefix(hashes), at, window)).view(np.int64)
                b = mixed(_SECOND.runs(_SECOND.prefix(mixed(hashes)), at, window)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(at), tid, np.int64)), pa.array(at.astype(np.int32))], names=["a", "b", "tid", "at"])

    return run


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Mask of the words that windows at these starts cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return np.cumsum(step[:n]) > 0


def _strip(window: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            out = []
            for key, text, marks in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("marks")):
                words = words_of(text)
                gone = covered(len(words), marks.values.to_numpy(zero_copy_only=False).astype(np.int64), window)
                kept = b" ".join(compress(words, (~gone).tolist()))
                out.append((key, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.string(), pa.string()))], names=["key", "n_removed", "kept_sha256", "kept"])

    return run


def _texts(prints: DataFrame) -> DataFrame:
    """A row per distinct text, written: tid (a short number that stands for it from here on), key, copies, n_words, and its anchors."""
    one = prints.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"), F.first("grams").alias("grams"), F.first("starts").alias("starts"), F.first("spans").alias("spans"))
    return materialize(one.withColumn("tid", F.monotonically_increasing_id()), "texts")


def _anchors(texts: DataFrame) -> DataFrame:
    rows = texts.select("tid", F.explode(F.arrays_zip("grams", "starts", "spans")).alias("x"))
    return materialize(rows.select("tid", F.col("x.grams").alias("gram"), F.col("x.starts").alias("s"), F.col("x.spans").alias("n")), "anchors")


def _nominated(docs: DataFrame, texts: DataFrame, anchors: DataFrame, again: DataFrame) -> DataFrame:
    """tid, key, text, ranges (s, n) of the texts that hold any of these anchors, written: a text once, however many rows have it."""
    ranges = anchors.join(again, "gram").groupBy("tid").agg(F.collect_list(F.struct("s", "n")).alias("ranges"))
    ranges = materialize(ranges.join(texts.select("tid", "key"), "tid"), "ranges")
    keys = ranges.select("key")
    source = docs.select(_text().alias("text")).withColumn("key", text_key(F.col("text")))
    source = source.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left_semi")
    some = materialize(source.groupBy("key").agg(F.first("text").alias("text")).join(ranges, "key"), "nominated")
    discard(ranges)
    return some


def _cut(some: DataFrame, windows: DataFrame, twice: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """key, n_removed, kept_sha256, kept of the texts that hold any of these windows, written."""
    marks = windows.join(twice, ["a", "b"]).groupBy("tid").agg(F.collect_list("at").alias("marks"))
    return materialize(some.select("tid", "key", "text").join(marks, "tid").mapInArrow(trimmed(_strip(window, keep_text)), "key binary, n_removed long, kept_sha256 string, kept string"), "stripped")


WINDOWS = "a long, b long, tid long, at int"


def repeats(docs: DataFrame, window: int = WINDOW, batches: int = 2, keep_text: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prints, stripped, copies): fingerprints by row; n_removed, kept_sha256, kept by key of partly repeated texts; keys of repeated rows.

    All documents are judged on the input: the index takes them in `batches`, each merge-joined with the runs before it, and the
    anchors found twice nominate windows of every batch. One copy of each text is indexed; further copies are known by key.
    """
    # Anchors are kept in one place at a time.
    wide = materialize(fingerprint(docs, window), "prints")
    whole = _texts(wide)
    prints = materialize(wide.drop("grams", "starts", "spans"), "rows")
    discard(wide)
    anchors = _anchors(whole)
    texts = materialize(whole.drop("grams", "starts", "spans"), "keys")
    discard(whole)
    index, again = FingerprintIndex(docs.sparkSession), None
    for k in range(batches):
        found = index.take(anchors.filter(F.pmod(F.xxhash64("tid"), F.lit(batches)) == k))
        again = found if again is None else again.union(found)
    # Read apart from its buckets: both sides of the next join then have exchanges of their own, and a hot anchor can be split.
    again = materialize(again.distinct(), "again")
    index.drop()
    some = _nominated(docs, texts, anchors, again)
    discard(anchors, again)
    windows = materialize(some.mapInArrow(trimmed(_windows(window)), WINDOWS), "windows")
    # Written, so that the join has an exchange of its own on either side and a hot window can be split.
    twice = materialize(windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "twice")
    stripped = _cut(some, windows, twice, window, keep_text)
    discard(windows, twice, some)
    copies = materialize(texts.filter(f"copies > 1 and n_words >= {window}").select("key", "copies"), "copies")
    discard(texts)
    return prints, stripped, copies


def remove_repeats(docs: DataFrame, window: int = WINDOW, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row per document."""
    prints, stripped, copies = repeats(docs, window, batches)
    out = prints.select("doc_id", "key", "n_words", "full_sha").join(stripped.drop("kept"), "key", "left").join(copies, "key", "left")
    every = F.col("copies").isNotNull()
    return out.select(
        "doc_id",
        "n_words",
        F.when(every, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(every, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "full_sha")).alias("kept_sha256"),
    )


def _with_kept(docs: DataFrame, stripped: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, columns unchanged: texts as stripped, rows whose key is in `gone` or that keep no word dropped."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), text_key(_text()).alias("key"))
    rows = rows.join(stripped.select("key", F.col("kept").alias("__kept")), "key", "left").join(gone.select("key"), "key", "left_anti")
    rows = rows.filter("__kept is null or __kept != ''")
    text = F.coalesce("__kept", F.col("__row")["text"])
    changed = {"text": text, "n_chars": F.when(F.col("__kept").isNotNull(), F.length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row")["n_chars"])} if "n_chars" in docs.columns else {"text": text}
    return rows.select(*[changed.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def strip_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, columns unchanged, with repeated passages cut from the texts; documents that lose every word go.

    A text that loses words comes as its other words, one blank between each, and n_chars is its new length; other texts stay as they are.
    """
    prints, stripped, copies = repeats(docs, window, keep_text=True)
    discard(prints)
    return _with_kept(docs, stripped, copies)


def strip_batch(batch: DataFrame, history: DataFrame, index: FingerprintIndex, window: int = WINDOW) -> DataFrame:
    """batch, columns unchanged, without the passages that occur elsewhere in it or in history; the index takes the batch.

    history: the documents that the index has taken so far (by this function, from an empty index on), as they came. Only those
    that hold an anchor of the batch are looked at again: their keys come from history's fingerprints, their texts are read once.
    """
    prints = materialize(fingerprint(batch, window), "prints")
    texts = _texts(prints)
    anchors = _anchors(texts)
    again = materialize(index.take(anchors), "again")
    index.compact()
    some = _nominated(batch, texts, anchors, again)
    windows = materialize(some.mapInArrow(trimmed(_windows(window)), WINDOWS), "windows")
    old = materialize(fingerprint(history, window), "prints")
    old_texts = _texts(old)
    old_anchors = _anchors(old_texts)
    old_some = _nominated(history, old_texts, old_anchors, again)
    before = old_some.mapInArrow(trimmed(_windows(window)), WINDOWS).select("a", "b").distinct()
    twice = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("a", "b")
    twice = materialize(twice.union(windows.select("a", "b").join(before, ["a", "b"], "left_semi")).distinct(), "twice")
    stripped = _cut(some, windows, twice, window, True)
    gone = texts.filter(f"n_words >= {window}").select("key", "copies")
    gone = materialize(gone.filter("copies > 1").select("key").union(gone.select("key").join(old_texts.select("key"), "key", "left_semi")).distinct(), "copies")
    discard(prints, texts, anchors, again, some, windows, twice, old, old_texts, old_anchors, old_some)
    return _with_kept(batch, stripped, gone)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i+34], ' ') AS k FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w) - 33))) AS i FROM d)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT rid, i FROM win WHERE k IN (SELECT k FROM rep)),
cov AS (SELECT DISTINCT rid, j FROM (SELECT rid, unnest(range(i, i + 35)) AS j FROM hit)),
al AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM al ANTI JOIN cov USING (rid, j) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
