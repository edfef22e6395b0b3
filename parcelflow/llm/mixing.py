"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue in an order shuffled by a seeded hash, sent up to `repeats` times. The virtual finish time of a
copy is the words its source has sent when it ends, divided by the source's target. Targets add up to the budget, so the
budget is spent at virtual time 1. The last copies of a queue leave a gap before that point that the next document may
not fit; then later ones of the queue that fit, among those of the next segments, are sent instead. Copies of all
sources are range-sorted by virtual finish time and cut where a prefix sum of their words reaches the budget. A copy is
sent whole or not at all, so a source misses its target by less than the least document it could still send.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in
order; rows that repeat are documents of their own, and rows equal in every column are interchangeable; an empty table
gives an empty mix. Columns other than those named only tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.llm.common import materialize, prepare, row_key, word_count

WEIGHTS = (3, 1, 2)
SHUFFLE_BITS = 60
#: Rows of one queue segment at most, about; segments are cut by hash, so a hot source spreads over many.
SEGMENT_ROWS = 1_000
#: Equal rows that one task numbers.
EQUAL_ROWS = 1_000
#: Segments whose documents may fill the gap that a queue leaves before its target.
FILLING = 2
#: Copies up to this many are broadcast (a digest, a number and a time each, so 60 bytes a row and 30 MB in all).
BROADCAST_COPIES = 500_000


def targets(sizes: dict, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict:
    """Words to take by source: share x all words split by weight, none above most x its size, the excess reshared."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    # A source is full at the level most * size / weight; fill them in that order until the rest fits.
    left, rest, out = share * sum(sizes.values()), float(sum(weight.values())), {}
    for s in sorted(order, key=lambda s: most * sizes[s] / weight[s]):
        fair = left * weight[s] / rest if rest else 0.0
        out[s] = float(min(fair, most * sizes[s]))
        left, rest = left - out[s], rest - weight[s]
    return out


def items(docs: DataFrame, seed: int = 11) -> DataFrame:
    """key (digest of the whole row), doc_id, source, size, copy (number among equal rows), shuffle (60 bits of a digest of key and copy): a row per row of docs."""
    rows = docs.select(row_key(docs).alias("key"), "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = materialize(rows.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-rows")
    number = F.col("chunk") * EQUAL_ROWS
    many = rows.filter("n > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EQUAL_ROWS))))
    many = many.repartition("key", "chunk").withColumn("copy", F.explode(F.sequence(number, F.least(F.col("n"), number + EQUAL_ROWS) - 1)))
    out = rows.filter("n = 1").withColumn("copy", F.lit(0).cast("long")).select("key", "doc_id", "source", "size", "copy")
    out = out.union(many.select("key", "doc_id", "source", "size", "copy"))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lower(F.hex("key")), F.col("copy").cast("string")))
    return out.withColumn("shuffle", F.conv(F.substring(mark, 1, SHUFFLE_BITS // 4), 16, 10).cast("long"))


def queues(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 11) -> tuple[DataFrame, DataFrame, float]:
    """(rows, copies, budget): rows with source_size and target; the copies that fit their queues, each with its virtual finish time.

    The driver holds a row per source, never per document.
    """
    spark = docs.sparkSession
    rows = items(docs, seed)
    per = {r["source"]: (r["size"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    goal = targets({s: v[0] for s, v in per.items()}, weights, share, float(repeats))
    bits = max(0, (max((v[1] for v in per.values()), default=0) // SEGMENT_ROWS).bit_length())
    kind = T.StructType([T.StructField("t_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    table = spark.createDataFrame([(s, v[0], goal[s]) for s, v in per.items()], kind)
    rows = rows.withColumn("segment", F.shiftright("shuffle", SHUFFLE_BITS - bits).cast("long"))
    sums = rows.groupBy("source", "segment").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("s_source"), F.col("segment").alias("s_segment"), "words", before.alias("before"))
    # What every segment needs to know of its source: one row a segment.
    sums = sums.join(table, F.col("s_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("segment") == F.col("s_segment"))).drop("s_source", "s_segment")
    within = Window.partitionBy("source", "segment").orderBy("shuffle", "key", "copy").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = materialize(rows.select("key", "doc_id", "copy", "source", "size", "source_size", "target", "segment", "words", "before", "begin"), "mix-queues")
    epochs = F.sequence(F.lit(0), F.lit(repeats - 1))
    sent = rows.filter("size > 0").select("*", F.explode(epochs).alias("epoch")).withColumn("end", F.col("epoch") * F.col("source_size") + F.col("begin") + F.col("size"))
    goal_words = F.round("target").cast("long")
    fits = sent.filter(F.col("end") <= goal_words)
    columns = ("key", "copy", "epoch", "size")
    copies = fits.select(*columns, (F.col("end") / F.col("target")).alias("finish"))
    # The gap before a queue's target lies in one segment of one epoch; that segment and the next ones may fill it.
    starts = F.col("epoch") * F.col("source_size") + F.col("before")
    many = 1 << bits
    place = F.col("epoch") * many + F.col("segment")
    gap = sent.filter((starts <= goal_words) & (goal_words < starts + F.col("words"))).groupBy("source").agg(F.first(place).alias("gap_at"))
    done = fits.groupBy("source").agg(F.max("end").alias("done"))
    behind = sent.filter(F.col("end") > goal_words).join(gap.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source")))
    behind = behind.filter((place >= F.col("gap_at")) & (place < F.col("gap_at") + FILLING)).groupBy("source", "target").agg(F.sort_array(F.collect_list(F.struct("end", *columns))).alias("next"))
    behind = behind.join(done.withColumnRenamed("source", "d_source"), F.col("source").eqNullSafe(F.col("d_source")), "left").withColumn("done", F.coalesce("done", F.lit(0).cast("long")))
    taken = F.transform(F.array(F.col("next")[0]), lambda x: F.struct(*[x[c].alias(c) for c in columns], (x["end"] / F.col("target")).alias("finish")))
    state = F.struct(F.col("done").alias("sent"), F.slice(taken, 1, 0).alias("taken"))

    def fill(s, x):
        upto = s["sent"] + x["size"]
        copy = F.struct(*[x[c].alias(c) for c in columns], (upto / F.col("target")).alias("finish"))
        return F.when(upto <= goal_words, F.struct(upto.alias("sent"), F.concat(s["taken"], F.array(copy)).alias("taken"))).otherwise(s)

    filled = behind.select(F.explode(F.aggregate("next", state, fill)["taken"]).alias("x")).select("x.*")
    return rows, copies.union(filled), float(sum(goal.values()))


ORDER = ("finish", "key", "copy", "epoch")


def sequence(copies: DataFrame, budget: float) -> DataFrame:
    """Copies range-sorted by virtual finish time, cut where the prefix sum of their words reaches the budget."""
    parts = materialize(copies.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id()), "mix-order")
    # One row a partition, of which there are as many as the session shuffles into.
    sums = {r["part"]: r["words"] for r in parts.groupBy("part").agg(F.sum("size").alias("words")).collect()}
    left, whole, last = int(round(budget)), [], None
    for part in sorted(sums):
        if sums[part] > left:
            last = part
            break
        left -= sums[part]
        whole.append(part)
    if last is None:
        return parts.drop("part")
    upto = F.sum("size").over(Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    cut = parts.filter(F.col("part") == last).withColumn("upto", upto).filter(F.col("upto") <= left).drop("upto")
    return parts.filter(F.col("part") < last).union(cut).drop("part")


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs, columns unchanged, as mixed: a row per copy taken, range-sorted by virtual finish time."""
    prepare(docs.sparkSession)
    _, copies, budget = queues(docs, **options)
    taken = sequence(copies, budget).select(F.col("key").alias("__key"), F.col("copy").alias("__copy"), F.col("finish").alias("__finish"), "epoch")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), row_key(docs).alias("__hash"))
    # Equal rows have one key: one of them carries the copies of all.
    repeated = taken.filter("__copy > 0").select("__key").distinct()
    if not repeated.isEmpty():
        again = rows.join(repeated, F.col("__hash") == F.col("__key"), "left_semi").groupBy("__hash").agg(F.first("__row").alias("__row")).select("__row", "__hash")
        rows = rows.join(repeated, F.col("__hash") == F.col("__key"), "left_anti").union(again)
        # ... dealt over chunks of their numbers, so that a text with very many copies meets them in many tasks.
        numbers = taken.filter("__copy > 0").groupBy("__key").agg(F.max("__copy").alias("most"))
        rows = rows.join(numbers, F.col("__hash") == F.col("__key"), "left").drop("__key")
        rows = rows.select("__row", "__hash", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.coalesce("most", F.lit(0)) / EQUAL_ROWS))).alias("__chunk"))
    else:
        rows = rows.withColumn("__chunk", F.lit(0).cast("long"))
    taken = taken.withColumn("__part", F.floor(F.col("__copy") / EQUAL_ROWS))
    side = F.broadcast(taken) if taken.count() <= BROADCAST_COPIES else taken
    out = rows.join(side, (F.col("__hash") == F.col("__key")) & (F.col("__chunk") == F.col("__part")))
    return out.repartitionByRange("__finish", "__key", "__copy", "epoch").sortWithinPartitions("__finish", "__key", "__copy", "epoch").select("__row.*")


def mixed_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row per row of docs; taken are the words of it that mix() sends."""
    prepare(docs.sparkSession)
    rows, copies, budget = queues(docs, **options)
    sent = sequence(copies, budget).groupBy(F.col("key").alias("s_key"), F.col("copy").alias("s_copy")).agg(F.sum("size").alias("taken"))
    out = rows.join(sent, (F.col("key") == F.col("s_key")) & (F.col("copy") == F.col("s_copy")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """mixed_words() of all documents, targets to a millionth of a word."""
    return mixed_words(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("target", F.round("target", 6))


#: The same mix over the whole table, with a row's digest, its place in the shuffle, prefix sums and the filling of gaps spelt out.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) AS size,
  md5(concat({", ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "text", "lang", "source", "n_chars"))})) AS key FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY key) - 1 AS copy FROM d),
p AS (SELECT source, sum(size) AS words, count(*) AS n, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM d GROUP BY source),
g AS (SELECT *, 2.0::DOUBLE * words AS cap, 1.5::DOUBLE * sum(words) OVER () - coalesce(sum(2.0::DOUBLE * words) OVER o, 0) AS left_, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest
  FROM p WINDOW o AS (ORDER BY words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, first_value(left_ / rest) OVER (ORDER BY cap <= left_ * weight / rest, words / weight, source NULLS LAST) AS level, cap <= left_ * weight / rest AS is_full FROM g),
t AS (SELECT source, words, CASE WHEN is_full THEN cap ELSE level * weight END AS target, CAST(round(CASE WHEN is_full THEN cap ELSE level * weight END) AS BIGINT) AS goal,
  CASE WHEN max(n) OVER () < {SEGMENT_ROWS} THEN 0 ELSE CAST(floor(log2(max(n) OVER () // {SEGMENT_ROWS})) AS INT) + 1 END AS bits FROM a),
s AS (SELECT q.*, words, target, goal, bits, CAST('0x' || substr(md5('11:' || key || ':' || copy), 1, 15) AS BIGINT) AS shuffle FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source),
w AS (SELECT *, shuffle >> ({SHUFFLE_BITS} - bits) AS segment, coalesce(sum(size) OVER (PARTITION BY source ORDER BY shuffle, key, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
c AS (SELECT *, epoch * (1 << bits) + segment AS place, epoch * words + before + size AS upto FROM w, (SELECT unnest([0, 1]) AS epoch) WHERE size > 0),
f AS (SELECT *, max(upto) FILTER (upto <= goal) OVER (PARTITION BY source) AS done FROM c),
j AS (SELECT *, min(place) FILTER (upto > goal) OVER (PARTITION BY source) AS gap FROM f),
b AS (SELECT source, goal, coalesce(any_value(done), 0) AS done, list({{'sent': CAST(size AS HUGEINT), 'took': [key || ':' || copy || ':' || epoch]}} ORDER BY upto, key, copy, epoch) AS next
  FROM j WHERE upto > goal AND place < gap + {FILLING} GROUP BY source, goal),
l AS (SELECT source, unnest(list_reduce(list_concat([{{'sent': CAST(done AS HUGEINT), 'took': CAST([] AS VARCHAR[])}}], next),
  lambda u, x: CASE WHEN u.sent + x.sent <= goal THEN {{'sent': u.sent + x.sent, 'took': list_concat(u.took, x.took)}} ELSE u END).took) AS id FROM b),
k AS (SELECT j.key, j.copy, j.epoch, j.size, upto / target AS finish FROM j WHERE upto <= goal
  UNION ALL SELECT j.key, j.copy, j.epoch, j.size, (coalesce(done, 0) + sum(size) OVER (PARTITION BY j.source ORDER BY upto, j.key, j.copy, j.epoch)) / target FROM j JOIN l ON l.id = key || ':' || copy || ':' || epoch),
e AS (SELECT *, sum(size) OVER (ORDER BY finish, key, copy, epoch ROWS UNBOUNDED PRECEDING) AS spent FROM k),
z AS (SELECT key, copy, sum(size) AS taken FROM e WHERE spent <= (SELECT round(sum(target)) FROM t) GROUP BY ALL)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(words AS BIGINT) AS source_size, round(target, 6) AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM s LEFT JOIN z USING (key, copy)
"""
