import math
from collections import Counter

import numpy as np
import pytest
from tables import table

from parcelflow.llm import search


def brute(docs, queries, k):
    bags = [Counter((t or "").lower().encode().split()) for _, t in docs]
    lengths = [sum(b.values()) for b in bags]
    n, mean = len(docs), sum(lengths) / max(1, len(docs))
    df = Counter(w for b in bags for w in b)
    out = {}
    for q, t in set(queries):
        scores = []
        for (d, _), b, size in zip(docs, bags, lengths):
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w, c in Counter((t or "").lower().encode().split()).items() if w in b)
            if s > 0:
                scores.append((-round(s, 7), d is None, d))
        if scores:
            out[q] = sorted(scores)[:k] if all(x[2] is not None for x in scores) else sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
    return out


def check(spark, df, k=10):
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    several = {d for d, t in docs if len({x for i, x in docs if i == d}) > 1}
    asked = df.filter("doc_id % 4 = 0").filter(~df["doc_id"].isin([d for d in several if d is not None]))
    got = {}
    for r in search.search(df, asked, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-round(r["score"], 7), r["doc_id"] is None, r["doc_id"]))
    assert got == brute(docs, [(d, t) for d, t in docs if d is not None and d % 4 == 0 and d not in several], k)


def test_exact(spark, words, monkeypatch):
    df = table(spark, [(i, words(10 + i % 60, i // 3 if i % 7 == 0 else i), "en", "a") for i in range(240)])
    check(spark, df.repartition(3))
    monkeypatch.setattr(search, "SHARD_DOCS", 40)
    check(spark, df, 3)


def shard_of(bags):
    terms = np.concatenate([b[0] for b in bags])
    vocabulary, at, df = np.unique(terms, return_inverse=True, return_counts=True)
    n = len(bags)
    return search.Shard({"ids": np.arange(n), "null": np.zeros(n, bool), "lengths": np.array([b[1].sum() for b in bags]), "sizes": np.array([len(b[0]) for b in bags]), "vocabulary": vocabulary, "df": df, "at": at, "counts": np.concatenate([b[1] for b in bags])}, 30.0)


def test_blocks_are_skipped(words, monkeypatch):
    """Documents of another vocabulary have bounds of 0 and are never scored."""
    monkeypatch.setattr(search, "BLOCK", 8)
    left = [search.terms_of(words(30, i)) for i in range(16)]
    right = [search.terms_of(words(30, i).upper().replace("", "é")) for i in range(16)]
    docs, scores = shard_of(left + right).search([(left[3][0], np.ones(len(left[3][0])))], 5, np.zeros(1))[0]
    assert docs[0] == 3 and (docs < 16).all()


def test_pivot(monkeypatch):
    """Documents that share nothing but frequent words with a query stay below its floor and are passed over."""
    monkeypatch.setattr(search, "BLOCK", 8)
    common = np.arange(1, 6, dtype=np.uint64)
    bags = [(np.concatenate((common, np.array([100 + i // 4], np.uint64))), np.ones(6, np.int64)) for i in range(400)]
    shard = shard_of(bags)
    weights = np.array([0.01] * 5 + [6.0])
    docs, scores = shard.search([(bags[42][0], weights)], 4, np.array([3.0]))[0]
    assert docs.tolist() == [40, 41, 42, 43] and shard.scored == 4


def test_pruning_is_exact(monkeypatch):
    """Against scores of all documents, for floors and blocks of all kinds."""
    rng = np.random.default_rng(3)
    draw = lambda n: np.unique((rng.zipf(1.3, n) % 3000).astype(np.uint64), return_counts=True)
    bags = [draw(int(rng.integers(5, 200))) for _ in range(900)]
    for block in (1, 16, 256, 4096):
        monkeypatch.setattr(search, "BLOCK", block)
        shard = shard_of(bags)
        df = np.diff(np.concatenate(([0], np.cumsum(np.bincount(shard.term, minlength=len(shard.vocabulary))))))
        for q in range(0, 900, 90):
            terms, counts = bags[q]
            weights = counts * np.log(1 + (900 - df[np.searchsorted(shard.vocabulary, terms)] + 0.5) / (df[np.searchsorted(shard.vocabulary, terms)] + 0.5))
            weight = np.zeros(len(shard.vocabulary))
            weight[np.searchsorted(shard.vocabulary, terms)] = weights
            every = shard._full(np.arange(900), weight)
            want = [d for d in np.lexsort((np.arange(900), -every)) if every[d] > 0][:7]
            docs, scores = shard.search([(terms, weights)], 7, np.zeros(1))[0]
            assert docs.tolist() == want and (scores == every[want]).all()
            docs, _ = shard.search([(terms, weights)], 7, np.array([every[want[3]]]))[0]
            assert docs.tolist() == want[:4]


def test_very_long_document():
    """A million distinct words: memory follows the postings."""
    import tracemalloc

    terms = np.sort(np.random.default_rng(1).integers(0, 2**63, 1_000_000).astype(np.uint64))
    bags = [(terms, np.ones(len(terms), np.int64))] + [(terms[i * 100 : i * 100 + 50], np.ones(50, np.int64)) for i in range(500)]
    tracemalloc.start()
    shard = shard_of(bags)
    docs, _ = shard.search([(terms, np.ones(len(terms)))], 10, np.zeros(1))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert docs[0] == 0 and len(docs) == 10 and peak < 500e6


def test_oracle(spark, words, tmp_path):
    duckdb = pytest.importorskip("duckdb").connect()
    rows = [(i, words(10 + i % 90, i if i % 7 else 1), "en", "a") for i in range(350)] + [(1000, None, "en", "a"), (1100, "Word word", "en", "a")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted((q, r, d, round(s, 8)) for q, r, d, s in duckdb.sql(search.ORACLE).fetchall())
    assert sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in search.op8_bm25_topk(spark, str(tmp_path)).collect()) == want


def test_odd(spark, odd, empty):
    df = odd.unionByName(table(spark, [(0, "one", None, None), (4, None, None, None)]))
    check(spark, df)
    assert search.search(empty, empty).count() == 0
