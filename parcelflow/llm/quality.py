"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio of a trusted and the raw corpus.

Words and pairs of words are hashed into BUCKETS cells. The raw multinomial counts every document; the trusted one
counts all rows labelled good and not toxic but for the fifth that is held out. A document's score is the mean over its
n-grams of log p(trusted) - log p(raw), so length doesn't matter. The threshold is fixed by all trusted rows that were
held out of the counting: the exact score below which SLACK of them lie. Fewer than 1 / SLACK held rows don't show that score; then it is
bounded from below by their mean and deviation (a one-sided tolerance bound: at most SLACK lie below it, with probability SURE).

Defined results: null and empty texts have no words, fail the base rules and aren't kept; without labelled rows only the
base rules decide; repeated rows each count; a doc_id with several labels is trusted only if all are good; texts of any
length are read whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import Rolling, discard, materialize, mixed, prepare, trimmed
from parcelflow.operators.distribution import describe

BUCKETS = 1 << 16
#: Trusted ids that the SQL counts at most; judge() counts all, so beyond it the two differ.
TRUSTED_ROWS = 20_000
#: Trusted ids up to this many are broadcast (an id and a flag, some 60 bytes in memory); beyond it the joins shuffle.
BROADCAST_TRUSTED = 500_000
SLACK = 0.005
SURE = 0.95
SMOOTHING = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
#: Bytes of text that one vectorised step takes.
STEP_BYTES = 8_000_000
#: Odd multipliers that hash a pair of words to a cell.
PAIR = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)
_ROLL = Rolling(0x9E3779B97F4A7C15)


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.encode("utf-8", "surrogatepass").strip():
            seen.add(line)
    return n


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows whose word sequence is found twice or more (64-bit hashes of the sequence)."""
    n = len(hashes)
    if n <= window:
        return 0
    runs = mixed(_ROLL.runs(_ROLL.prefix(hashes), None, window))
    order = np.sort(runs)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(runs, twice))
    step = np.zeros(n + 1, np.int64)
    step[starts] += 1
    np.add.at(step, starts + window, -1)
    return int((np.cumsum(step[:n]) > 0).sum())


class Words:
    """The words of some texts laid end to end: the start of each text's, the code points and the hash of each word.

    A word's hash is the first half of its MD5 digest, taken once for each distinct word.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        size = pc.utf8_length(words).to_numpy()
        real = size[codes] > 0  # white space at an end leaves an empty piece
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(real)))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        self.starts = upto[offsets - offsets[0]]
        codes = codes[real]
        _, ends, raw = words.buffers()
        ends, raw = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].tolist(), raw.to_pybytes() if raw else b""
        digests = b"".join([hashlib.md5(raw[i:j]).digest() for i, j in zip(ends, ends[1:])])
        self.sizes, self.hashes = size[codes], np.frombuffer(digests, ">u8")[::2].astype(np.uint64)[codes]
        self.owner = np.repeat(np.arange(len(lists)), np.diff(self.starts))

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """(cell, text) of every word and of every pair of neighbouring words of one text."""
        h = self.hashes >> np.uint64(32)
        pairs = (h[:-1] * PAIR[0] + h[1:] * PAIR[1]) >> np.uint64(48)
        same = self.owner[1:] == self.owner[:-1]
        return np.concatenate((self.hashes >> np.uint64(48), pairs[same])).astype(np.int64), np.concatenate((self.owner, self.owner[1:][same]))


def steps(batch):
    """Slices of a batch of about STEP_BYTES of text each; a longer text stands alone."""
    size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // STEP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
    return [batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i]


def _count(batches):
    """Two rows' worth of counts for a partition: raw and trusted cells, written once at its end."""
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in steps(batch):
            cells, owner = Words(part.column("text")).cells()
            raw += np.bincount(cells, minlength=BUCKETS)
            good += np.bincount(cells[part.column("trusted").to_numpy(zero_copy_only=False)[owner]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(good[some])], names=["cell", "raw", "good"])


def ratios(rows) -> np.ndarray:
    """log p(trusted) - log p(raw) by cell."""
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for cell, r, g in rows:
        raw[cell], good[cell] = r, g
    if not good.sum():
        return np.zeros(BUCKETS, np.float64)
    share = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS))
    return share(good) - share(raw)


def _score(model: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in steps(batch):
                texts = part.column("text")
                words = Words(texts)
                cells, owner = words.cells()
                n, m = np.diff(words.starts), len(texts)
                # bincount adds in order, so a score doesn't depend on the texts beside.
                total, grams = np.bincount(owner, model[cells], m), np.bincount(owner, minlength=m)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n),
                        pa.array(np.bincount(words.owner, words.sizes, m).astype(np.int64)),
                        pc.count_substring_regex(texts, SYMBOLS).cast(pa.int64()),
                        pa.array([duplicate_lines(t) if "\n" in t else 0 for t in texts.to_pylist()], pa.int64()),
                        pa.array([repeated_words(words.hashes[i:j]) for i, j in zip(words.starts.tolist(), words.starts[1:].tolist())], pa.int64()),
                        pa.array(total / np.maximum(1, grams), pa.float64(), mask=n == 0),
                    ],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"],
                )

    return run


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id, held: all well labelled ids; held ones set the threshold, the others train."""
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and t = 0")
    return good.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held"))


def tolerance(n: int, slack: float = SLACK, sure: float = SURE) -> float:
    """Deviations below the mean of n values that at most `slack` of a normal distribution lie beyond, with probability `sure` (Natrella's approximation)."""
    out, doubt = NormalDist().inv_cdf(1 - slack), NormalDist().inv_cdf(sure)
    a = 1 - doubt**2 / (2 * (n - 1))
    return float("inf") if a <= 0 else (out + (out**2 - a * (out**2 - doubt**2 / n)) ** 0.5) / a


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    some = materialize(trusted_ids(labels.select("doc_id", "quality", "toxic")), "trusted")
    side = some.select(F.col("doc_id").alias("t_id"), "held")
    few = some.count() <= BROADCAST_TRUSTED
    side = F.broadcast(side) if few else side
    marked = docs.join(side, F.col("doc_id") == F.col("t_id"), "left").select("text", F.coalesce(~F.col("held"), F.lit(False)).alias("trusted"))
    counts = marked.mapInArrow(trimmed(_count), "cell int, raw long, good long").groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    model = ratios(counts.collect())  # BUCKETS rows at most, whatever the input
    scored = materialize(docs.mapInArrow(trimmed(_score(model)), f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"), "scored")
    held = scored.join(side.filter("held"), F.col("doc_id") == F.col("t_id"), "left_semi").filter("score is not null")
    n, mean, spread = held.agg(F.count("score"), F.mean("score"), F.stddev_samp("score")).first()
    if n * SLACK < 1:
        # One held row has no deviation, and two bound nothing: the base rules decide.
        low = mean - tolerance(n) * spread if n > 2 else None
    else:
        low = describe(held, [], F.col("score"), [SLACK]).first()["q"][0]
    threshold = -1e300 if low is None else max(low, -1e300)
    discard(some)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce("score", F.lit(0.0)) >= F.lit(threshold)))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("score")


def _xxhash64(x: str) -> list[str]:
    """Steps of the 64-bit hash of a whole number x (its digest with seed 42), as SQL of `h` over unsigned numbers."""
    whole, p1, p2, p3, p4, p5 = 1 << 64, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    turn = lambda v, k: f"(({v}) * {1 << k} % {whole} + ({v}) // {1 << (64 - k)})"
    mix = lambda v, k: f"xor({v}, ({v}) // {1 << k})"
    return [
        f"CAST(CASE WHEN {x} < 0 THEN CAST({x} AS HUGEINT) + {whole} ELSE {x} END AS UHUGEINT) * {p2} % {whole}",
        f"xor(CAST({42 + p5 + 8} AS UHUGEINT), {turn('h', 31)} * {p1} % {whole})",
        f"({turn('h', 27)} * {p1} % {whole} + {p4}) % {whole}",
        f"{mix('h', 33)} * {p2} % {whole}",
        f"{mix('h', 29)} * {p3} % {whole}",
        mix("h", 32),
    ]


_OUT, _DOUBT = NormalDist().inv_cdf(1 - SLACK), NormalDist().inv_cdf(SURE)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
v AS (SELECT rid, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM d),
x AS (SELECT rid, i, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS UHUGEINT) AS h FROM v),
g AS (SELECT rid, CAST(h // 65536 AS INT) AS cell FROM x UNION ALL
  SELECT rid, CAST((h * {PAIR[0]} % 18446744073709551616 + nxt * {PAIR[1]} % 18446744073709551616) % 18446744073709551616 // 281474976710656 AS INT)
  FROM (SELECT rid, h, lead(h) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM x) WHERE nxt IS NOT NULL),
l0 AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(toxic) = 0),
{", ".join(f"l{i + 1} AS (SELECT doc_id, {step} AS h FROM l{i})" for i, step in enumerate(_xxhash64("doc_id")))},
l AS (SELECT doc_id, CAST(h AS HUGEINT) - CASE WHEN h >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END AS h FROM l6 ORDER BY h, doc_id LIMIT {TRUSTED_ROWS}),
t AS (SELECT doc_id, (h % 5 + 5) % 5 = 0 AS held FROM l),
m AS (SELECT d.rid, held FROM d LEFT JOIN t ON d.doc_id = t.doc_id),
c AS (SELECT cell, count(*) AS raw, count(*) FILTER (NOT held) AS good FROM g JOIN m USING (rid) GROUP BY cell),
r AS (SELECT cell, CASE WHEN sum(good) OVER () = 0 THEN 0 ELSE ln((good + {SMOOTHING}) / (sum(good) OVER () + {SMOOTHING} * {BUCKETS})) - ln((raw + {SMOOTHING}) / (sum(raw) OVER () + {SMOOTHING} * {BUCKETS})) END AS ratio FROM c),
s AS (SELECT rid, avg(ratio) AS score FROM g JOIN r USING (cell) GROUP BY rid),
h AS (SELECT count(*) AS n, avg(score) AS mean, stddev_samp(score) AS spread, quantile_cont(score, {SLACK}) AS low FROM s JOIN m USING (rid) WHERE held),
a AS (SELECT *, 1 - {_DOUBT**2} / (2 * greatest(1, n - 1)) AS a FROM h),
b AS (SELECT CASE WHEN n * {SLACK} >= 1 THEN low WHEN n > 2 AND a > 0 THEN mean - ({_OUT} + sqrt({_OUT**2} - a * ({_OUT**2} - {_DOUBT**2} / n))) / a * spread ELSE -1e300 END AS least FROM a),
j AS (SELECT rid, i, t || ' ' || lead(t) OVER o || ' ' || lead(t, 2) OVER o || ' ' || lead(t, 3) OVER o || ' ' || lead(t, 4) OVER o AS run FROM v WINDOW o AS (PARTITION BY rid ORDER BY i)),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, run) AS times FROM j WHERE run IS NOT NULL),
e AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM k WHERE times > 1) GROUP BY rid),
q AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
z AS (SELECT d.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(list_sum(list_transform(w, lambda v: length(v))) AS BIGINT) AS chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  coalesce(q.n, 0) AS n_dup_lines, coalesce(e.n, 0) AS n_repeat_words FROM d LEFT JOIN q USING (rid) LEFT JOIN e USING (rid)),
y AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM z)
SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(score, 0) >= least AS kept FROM y LEFT JOIN s USING (rid), b
"""
