"""Exact top-k BM25 search over a sharded inverted index with block-max WAND pruning.

Each input partition is indexed as shards of SHARD_DOCS documents, written to the shared folder. Global statistics
(documents, mean length, document frequencies of the queries' terms) are aggregated from the shards, so scores are the
same however rows are dealt. Shards read the queries in blocks from the shared folder.

A shard keeps the postings of rare terms as lists, and those of frequent ones as a matrix of documents by terms, cut into
blocks of BLOCK documents with the greatest impact of each term in each block. A term is frequent if it is in more than a
share FREQUENT and in more than LEAST_DF of a shard's documents, so the matrix has at most 1 / FREQUENT cells for each posting. For a query the frequent terms
are those before the pivot: a block's bound for them is the sum of weight times greatest impact, and a document whose
rare terms together with that bound stay below the k-th score known (found here, or by the few shards searched first) is
passed over. Blocks come in order of their greatest such bound; what is left of a block is scored by a product of matrices for
all queries at once. Documents within rounding of a shard's k-th score are then scored again in one fixed order, and the shards' top k are merged.

WAND moves cursors through all postings of a query one document at a time. Queries here have hundreds of terms, most of
them frequent: that pivot, taken term by term over arrays, took 5 to 12 ms a query and shard where this takes half a one.

A query is a whole document: each of its words counts as often as it occurs. Words are lower-cased.

Defined results: null and empty texts are indexed with length 0 and match nothing; a query without words finds nothing; scores
that tie go to the smaller doc_id, null last; rows that repeat are documents of their own, but queries equal in doc_id and text are one query; texts
of any length are indexed whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm.common import Store, materialize, prepare, scratch, store, text_key, trimmed, word_hashes, words_of

K1, B = 1.2, 0.75
TOP = 10
SHARD_DOCS = 8192
#: Postings of one shard at most, about; a shard of long documents ends earlier.
SHARD_POSTINGS = 4_000_000
BLOCK = 256
QUERY_BLOCK = 256
QUERY_EVERY = 100
#: Terms in more than this share of a shard's documents, and in more than so many of them, are scored by dense products.
FREQUENT, LEAST_DF = 0.05, 8
#: Tasks that search at most; each takes several shards if there are more of them.
MOST_TASKS = 50_000


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted term hashes and their counts."""
    return np.unique(word_hashes(words_of(text.lower())) if text else np.zeros(0, np.uint64), return_counts=True)


def _index(root: Store):
    def save(docs, bags):
        terms = np.concatenate([b[0] for b in bags]) if bags else np.zeros(0, np.uint64)
        counts = np.concatenate([b[1] for b in bags]).astype(np.int32)
        lengths = np.array([int(b[1].sum()) for b in bags], np.int64)
        sizes = np.array([len(b[0]) for b in bags], np.int64)
        name = f"shard-{uuid.uuid4().hex}.npz"
        vocabulary, at, df = np.unique(terms, return_inverse=True, return_counts=True)
        ids = np.array([np.iinfo(np.int64).max if d is None else d for d in docs], np.int64)
        raw = io.BytesIO()
        np.savez(raw, ids=ids, null=np.array([d is None for d in docs]), lengths=lengths, sizes=sizes, vocabulary=vocabulary, df=df.astype(np.int32), at=at.astype(np.int32), counts=counts)
        with root.sink(name, compression="zstd") as out:
            out.write(raw.getbuffer())
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(docs)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())], names=["shard", "docs", "words"])

    def run(batches):
        docs, bags, postings = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                bag = terms_of(text.as_py())
                docs.append(doc)
                bags.append(bag)
                postings += len(bag[0])
                if len(docs) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield save(docs, bags)
                    docs, bags, postings = [], [], 0
        if docs:
            yield save(docs, bags)

    return run


def build(docs: DataFrame, root: Store) -> DataFrame:
    """Index all rows of docs (doc_id a number); returns the written manifest: shard, docs, words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(trimmed(_index(root)), "shard string, docs long, words long"), "shards")


def load(root: Store, name: str) -> dict:
    fs, base = root.open()
    with fs.open_input_stream(f"{base}/{name}", compression="zstd") as f:
        with np.load(io.BytesIO(f.read())) as z:
            return {k: z[k] for k in z.files}


def _frequencies(root: Store):
    def run(batches):
        for batch in batches:
            for name in batch.column("shard").to_pylist():
                s = load(root, name)
                for i in range(0, len(s["vocabulary"]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(s["vocabulary"][i : i + 100_000].view(np.int64)), pa.array(s["df"][i : i + 100_000].astype(np.int64))], names=["term", "df"])

    return run


def _query_terms(batches):
    for batch in batches:
        for query, doc, text in zip(batch.column("query").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
            terms, counts = terms_of(text.as_py())
            n = len(terms)
            yield pa.RecordBatch.from_arrays([pa.array([query] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64))], names=["query", "query_id", "term", "times"])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of ranges laid end to end."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))


class Shard:
    """A shard ready to be searched."""

    def __init__(self, s: dict, mean_length: float):
        n = len(s["ids"])
        # Documents by id, then by their terms, so that the order of rows in the input doesn't matter.
        order = np.lexsort((s["ids"], s["null"]))
        starts = np.concatenate(([0], np.cumsum(s["sizes"]))).astype(np.int64)
        sizes, lengths = s["sizes"][order], s["lengths"][order]
        pick = _spread(starts[:-1][order], sizes)
        self.ids, self.null, self.vocabulary = s["ids"][order], s["null"][order], s["vocabulary"]
        self.term, tf = s["at"][pick], s["counts"][pick].astype(np.float64)
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        norm = K1 * (1 - B + B * lengths / max(mean_length, 1e-9))
        self.impact = tf * (K1 + 1) / (tf + norm[owner])
        by_term = np.argsort(self.term, kind="stable")
        p_doc, p_impact = owner[by_term], self.impact[by_term].astype(np.float32)
        df = np.bincount(self.term, minlength=len(self.vocabulary)).astype(np.int64)
        often = df > max(FREQUENT * n, LEAST_DF)
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((n, int(often.sum())), np.float32)
        dense = often[self.term]
        self.dense[owner[dense], self.column[self.term[dense]]] = self.impact[dense]
        firsts = np.arange(0, n, BLOCK)
        self.blocks = len(firsts)
        self.block_max = np.maximum.reduceat(self.dense, firsts, axis=0) if n else self.dense
        # Postings of the other terms, one term after the other.
        rare = ~often[self.term[by_term]]
        self.p_doc, self.p_impact = p_doc[rare], p_impact[rare]
        self.p_start = np.concatenate(([0], np.cumsum(np.where(often, 0, df)))).astype(np.int64)
        self.scored = 0

    def _full(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of documents, each summed in the order of its terms."""
        parts = (weight[self.term[a:b]] * self.impact[a:b] for a, b in zip(self.starts[docs].tolist(), self.starts[docs + 1].tolist()))
        return np.array([float(np.sum(x[x > 0])) for x in parts])

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (sorted term hashes, weights): (documents, scores) of its top k here, none below its floor."""
        n, m = len(self.ids), len(queries)
        rare = np.zeros((m, n), np.float32)
        often = np.zeros((m, self.dense.shape[1]), np.float32)
        found = []
        for q, (terms, weights) in enumerate(queries):
            at = np.searchsorted(self.vocabulary, terms)
            at[at == len(self.vocabulary)] = 0
            has = self.vocabulary[at] == terms if len(self.vocabulary) else np.zeros(len(terms), bool)
            t, w = at[has], weights[has]
            found.append((t, w))
            c = self.column[t]
            often[q, c[c >= 0]] = w[c >= 0]
            t, w = t[c < 0], w[c < 0]
            size = self.p_start[t + 1] - self.p_start[t]
            p = _spread(self.p_start[t], size)
            rare[q] = np.bincount(self.p_doc[p], self.p_impact[p] * np.repeat(w, size), minlength=n)
        bound = often @ self.block_max.T if n else np.zeros((m, 0), np.float32)
        highest = np.stack([bound[:, b] + rare[:, b * BLOCK : (b + 1) * BLOCK].max(axis=1) for b in range(self.blocks)], axis=1) if n else bound
        slack = 1e-4 * (1 + highest.max(axis=1)) if n else np.zeros(m)
        scores = np.full((m, n), -1.0, np.float32)
        least = floor.astype(np.float32)
        best = np.zeros((m, k), np.float32)
        for b in np.argsort(-highest.sum(axis=0), kind="stable"):
            # A score of 0 is no match, so a bound of 0 is never visited.
            go = np.flatnonzero((highest[:, b] > 0) & (highest[:, b] >= least - slack))
            if not len(go):
                continue
            here = slice(b * BLOCK, (b + 1) * BLOCK)
            may = rare[go, here] + bound[go, b, None] >= (least - slack)[go, None]
            rows = np.flatnonzero(may.any(axis=0))
            at = b * BLOCK + rows
            self.scored += len(go) * len(rows)
            got = np.where(may[:, rows], often[go] @ self.dense[at].T + rare[np.ix_(go, at)], np.float32(-1))
            scores[np.ix_(go, at)] = got
            best[go] = -np.partition(-np.concatenate((best[go], got), axis=1), k - 1, axis=1)[:, :k]
            least[go] = np.maximum(least[go], best[go].min(axis=1))
        out = []
        for q, (t, w) in enumerate(found):
            near = np.flatnonzero((scores[q] > 0) & (scores[q] >= least[q] - 2 * slack[q]))
            weight = np.zeros(len(self.vocabulary))
            weight[t] = w
            exact = self._full(near, weight)
            near, exact = near[exact >= floor[q]], exact[exact >= floor[q]]
            top = np.lexsort((near, -exact))[:k]
            out.append((near[top], exact[top]))
        return out


def query_blocks(root: Store, size: int):
    """The written queries, a block at a time: lists of (query, query_id, floor, terms, weights)."""
    fs, base = root.open()
    names = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(base)) if i.path.endswith(".parquet"))
    for name in names:
        with fs.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(size):
                rows = []
                for q, i, floor, own in zip(*(batch.column(c).to_pylist() for c in ("query", "query_id", "floor")), batch.column("terms")):
                    own = own.values
                    terms, weights = own.field("term").to_numpy().view(np.uint64), own.field("weight").to_numpy()
                    order = np.argsort(terms)
                    rows.append((q, i, floor, terms[order], weights[order]))
                if rows:
                    yield rows


def _search(root: Store, queries: Store, mean_length: float, k: int):
    def run(batches):
        for batch in batches:
            for name, part, parts in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "parts"))):
                shard = Shard(load(root, name), mean_length)
                for number, rows in enumerate(query_blocks(queries, QUERY_BLOCK)):
                    if number % parts != part:
                        continue
                    out = []
                    for (q, i, *_), (docs, scores) in zip(rows, shard.search([r[3:] for r in rows], k, np.array([r[2] for r in rows]))):
                        out += [(q, i, None if shard.null[d] else int(shard.ids[d]), float(s)) for d, s in zip(docs, scores)]
                    cols = list(zip(*out)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["query", "query_id", "doc_id", "score"])

    return run


def _dealt(shards: DataFrame, count: int) -> DataFrame:
    """shard, part, parts: a task for each shard, or several for each (a part of the queries each) where that would leave cores idle."""
    parts = max(1, min(8, 2 * shards.sparkSession.sparkContext.defaultParallelism // max(1, count)))
    rows = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(parts).alias("parts"))
    # By range, since few rows dealt by hash or in turn would meet in some tasks and leave others empty.
    return rows.repartitionByRange(max(1, min(MOST_TASKS, count * parts)), "shard", "part")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents for each query (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    root = store(spark, scratch(spark, "index"))
    shards = build(docs, root)
    n, words, count = shards.agg(F.sum("docs"), F.sum("words"), F.count(F.lit(1))).first()
    asked = queries.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = asked.withColumn("key", text_key(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "key"]).drop("key")
    # Written at once, so the numbers that stand for the queries are fixed.
    asked = asked.withColumn("query", F.monotonically_increasing_id())
    terms = materialize(asked.mapInArrow(trimmed(_query_terms), "query long, query_id long, term long, times long"), "query-terms")
    wanted = terms.select("term").distinct()
    df = shards.select("shard").repartitionByRange(max(1, min(MOST_TASKS, count)), "shard").mapInArrow(trimmed(_frequencies(root)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).join(wanted, "term", "left_semi")
    idf = F.log(1 + (F.lit(float(n or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(materialize(df, "frequencies"), "term").groupBy("query", "query_id").agg(F.collect_list(F.struct("term", (F.col("times") * idf).alias("weight"))).alias("terms"))
    written = materialize(weighted.withColumn("floor", F.lit(0.0)), "queries")
    mean, kind = float(words or 0) / max(1, n or 0), "query long, query_id long, doc_id long, score double"
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())

    def ranked(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def hits(some: DataFrame, many: int, asked: DataFrame) -> DataFrame:
        return _dealt(some, many).mapInArrow(trimmed(_search(root, store(spark, asked.parcelflow_path), mean, k)), kind)

    # A few shards first: the k-th scores found there are floors for all others, which then skip more and return less.
    few = math.isqrt(count)
    first = materialize(shards.select("shard").orderBy("shard").limit(few), "first-shards")
    found = materialize(ranked(hits(first, few, written)), "first-hits")
    floors = found.filter(F.col("rank") == k).select("query", F.col("score").alias("f"))
    again = materialize(written.join(floors, "query", "left").withColumn("floor", F.coalesce("f", "floor")).drop("f"), "queries")
    more = hits(shards.select("shard").join(first, "shard", "left_anti"), count - few, again)
    return ranked(found.drop("rank").union(more)).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def op8_bm25_topk(spark, sf_dir: str) -> DataFrame:
    """search() of all documents by every hundredth; scores, ranked exactly, are given to six digits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, docs.filter(F.col("doc_id") % QUERY_EVERY == 0)).withColumn("score", F.round("score", 6))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
c AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
i AS (SELECT t.doc_id, term, tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len(w) / mean)) AS impact, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf FROM t JOIN d USING (doc_id) JOIN f USING (term), c),
s AS (SELECT q.doc_id AS query_id, i.doc_id, sum(q.tf * idf * impact ORDER BY term) AS score FROM t q JOIN i USING (term) WHERE q.doc_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10
"""
