import hashlib
from collections import Counter

import numpy as np
import pytest
from tables import table

from parcelflow.llm import substring


def brute(texts, window=35):
    lists = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
    return out


def check(spark, docs):
    rows = docs.collect()
    want = sorted([(r["doc_id"], *b[:3]) for r, b in zip(rows, brute([r["text"] for r in rows]))], key=str)
    assert sorted([r[:] for r in substring.remove_repeats(docs).collect()], key=str) == want


@pytest.mark.parametrize("length", [34, 35, 36, 60])
def test_shared_passages(spark, words, length):
    passage = words(length, 99)
    texts = [words(30, i) + "\n" + passage + " " + words(30, 50 + i) for i in range(6)] + [passage, words(20, 7) + " " + passage + " " + passage, words(300, 8), "a " * 200, words(50, 9)]
    check(spark, table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]))


def test_overlapping_matches(spark, words):
    w = words(200, 5).split()
    texts = [" ".join(w), " ".join(w[10:60] + ["x"] + w[80:150]), " ".join(w[40:90]), " ".join(w[55:90] + w[:40]), " ".join(w[100:134])]
    check(spark, table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]))


def test_odd(spark, odd, empty):
    check(spark, odd)
    assert substring.remove_repeats(empty).count() == 0 and substring.strip_documents(empty).count() == 0


def test_strip_documents(spark, odd, words):
    passage = words(60, 99)
    docs = odd.unionByName(table(spark, [(30, words(20, 1) + "  " + passage, "en", "a"), (31, passage + "\n" + words(20, 2), "en", "a"), (32, words(70, 3) + "\n\nend", "en", "b")]))
    rows = docs.collect()
    want = sorted([(r["doc_id"], b[3] if b[1] else r["text"]) for r, b in zip(rows, brute([r["text"] for r in rows])) if b[3] or not b[1]], key=str)
    got = substring.strip_documents(docs)
    assert got.columns == docs.columns and sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect() if r["text"])


def test_index_runs(spark):
    index = substring.FingerprintIndex(spark, 3)
    batch = lambda xs: spark.createDataFrame([(x,) for x in xs], "gram long")
    grams = lambda df: sorted(r["gram"] for r in df.collect())
    assert grams(index.take(batch([1, 2, 2, 3]))) == [2]
    found = index.take(batch([4, 4, 9, 1]))
    joins = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in joins and joins.count("Exchange") == 1  # that of distinct()
    assert grams(found) == [1, 4]
    plan = index.entries()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # runs are merged as they lie
    assert grams(index.take(batch([9, 3, 5]))) == [3, 9]
    before = sorted(r[:] for r in index.entries().collect())
    index.compact()
    assert len(index.runs) == 1 and sorted(r[:] for r in index.entries().collect()) == before == [(1, 2), (2, 2), (3, 2), (4, 2), (5, 1), (9, 2)]
    path = index.runs[0][1]
    index.drop()
    assert not substring.FingerprintIndex(spark).runs and not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def test_batches_against_history(spark, words, odd):
    """Each batch loses what occurs elsewhere in it or in any batch before it."""
    passage, other = words(50, 70), words(45, 71)
    batches = [
        odd,
        table(spark, [(20, words(40, 1) + " " + passage, "en", "a"), (21, words(90, 2), "en", "a"), (22, words(80, 2), "de", "b"), (23, None, "en", "a")]),
        table(spark, [(30, passage + " " + words(30, 3), "en", "a"), (31, words(36, 4) + " " + other, "en", "a"), (32, other + " x", "en", "a"), (33, words(90, 2), "en", "z")]),
    ]
    index, seen = substring.FingerprintIndex(spark, 3), odd.limit(0)
    for batch in batches:
        old, new = [r["text"] for r in seen.collect()], batch.collect()
        want = brute(old + [r["text"] for r in new])[len(old) :]
        want = sorted([(r["doc_id"], b[3] if b[1] else r["text"]) for r, b in zip(new, want) if b[3] or not b[1]], key=str)
        got = substring.strip_batch(batch, seen, index)
        assert got.columns == batch.columns and sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == want
        seen = seen.unionByName(batch)
    index.drop()


def test_joins_by_shuffle(spark, odd, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_KEYS", -1)
    check(spark, odd)


def test_anchors_cover_every_window(words):
    texts = [words(n, n).encode().split() for n in (35, 36, 100, 34, 0, 400)]
    lengths = np.array([len(t) for t in texts])
    owner, grams, starts, spans = substring.anchors_of(lengths, substring.word_hashes([w for t in texts for w in t]), 35)
    for d, n in enumerate(lengths):
        at = [s + i for o, s, k in zip(owner, starts, spans) if o == d for i in range(k)]
        assert at == list(range(max(0, n - 34)))
    alone = substring.anchors_of(lengths[2:3], substring.word_hashes(texts[2]), 35)
    assert (alone[1] == grams[owner == 2]).all() and (alone[2] == starts[owner == 2]).all()
