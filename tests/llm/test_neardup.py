import random
from collections import Counter

import numpy as np
import pyarrow as pa
from tables import table

from parcelflow.llm import neardup


def bag(text):
    w = text.encode().split()
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def classes(texts, least=0.8):
    """Connected components by brute force: lists of positions."""
    bags, label = [bag(t or "") for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or jaccard(bags[i], bags[j]) >= least:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join("new" + str(rng.random()) if rng.random() < share else w for w in text.split())


def same(rows, want):
    groups = {}
    for (i, c), w in zip(rows, want):
        groups.setdefault(w, set()).add(c)
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 2**63, 300).astype(np.uint64)
    for low, high in ((1, 2), (1, 9), (1, 300), (900, 1100)):
        a, b = rng.integers(low, high, 300), rng.integers(low, high, 300)
        a[:60], b[200:] = 0, 0
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        sides = [neardup.signatures(np.zeros((w > 0).sum(), int), items[w > 0], w[w > 0], 1, 4000)[0] for w in (a, b)]
        assert abs((sides[0] == sides[1]).mean() - want) < 0.035


def test_signature_does_not_depend_on_neighbours():
    rng = np.random.default_rng(4)
    items, weights = rng.integers(0, 2**63, 500).astype(np.uint64), rng.integers(1, 7, 500)
    alone = neardup.signatures(np.zeros(20, int), items[:20], weights[:20], 1)
    owner = np.concatenate((np.zeros(20, int), np.ones(480, int)))
    assert (neardup.signatures(owner, items, weights, 2)[0] == alone[0]).all()


def test_great_weights_cost_little():
    """A word repeated two million times: processes split only as far as points are early enough to count."""
    import time

    began = time.perf_counter()
    a, b = (neardup.signatures(np.zeros(2, int), np.array([5, 6], np.uint64), np.array([w, 3]), 1, 4000)[0] for w in (2_000_000, 1_500_000))
    assert abs((a == b).mean() - 0.75) < 0.035 and time.perf_counter() - began < 20


def test_rounds_and_groups(spark, words, monkeypatch):
    """Tiny batches, chunks and groups, and joins by shuffle: many strays of one bucket, met over several rounds."""
    for name, value in {"FIRST_BATCH": 2, "GROWTH": 2, "CHUNK": 3, "MEET": 4, "GROUP": 2, "BROADCAST_IDS": -1, "BROADCAST_BANDS": -1}.items():
        monkeypatch.setattr(neardup, name, value)
    base = words(300, 31)
    texts = [edited(base, s, i) for i, s in enumerate([0.004, 0.01, 0.02, 0.03, 0.035] * 9)]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    want = classes(texts)
    assert len(set(want)) > 3
    same(sorted((r["doc_id"], r["class_id"]) for r in neardup.classes(docs).collect()), want)
    same(sorted((r["doc_id"], r["class_id"]) for r in neardup.classes(docs, sure=float("inf")).collect()), want)


def test_recall_of_links(spark, words):
    """Of planted pairs at 0.8 and above, one in a thousand at most is lost: banding and sketches miss next to none."""
    texts, pairs = [], []
    for i in range(400):
        base = words(150, 1000 + i)
        other = edited(base, 0.01 + 0.0001 * i, i)
        texts += [base, other]
        if jaccard(bag(base), bag(other)) >= 0.8:
            pairs.append((2 * i, 2 * i + 1))
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert len(pairs) > 150 and sum(got[a] == got[b] for a, b in pairs) == len(pairs)
    assert all(jaccard(bag(texts[c]), bag(texts[d])) >= 0.8 for d, c in got.items() if c != d)


def test_against_brute_force(spark, words):
    texts = []
    for g in range(12):
        base = words(60 + 20 * g, 100 + g)
        texts += [base, base, *(edited(base, s, 10 * g + i) for i, s in enumerate((0.005, 0.01, 0.02, 0.03, 0.04, 0.05)))]
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    docs = table(spark, [(i, texts[t], "en", "a") for i, t in enumerate(order)])
    got = sorted((r["doc_id"], r["class_id"]) for r in neardup.classes(docs).collect())
    want = classes([texts[t] for t in order])
    same(got, want)
    for i, c in got:
        assert c == min(j for j, w in enumerate(want) if w == want[i])
    kept = neardup.keepers(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in got})


def test_chain_and_star(spark, words):
    base = words(400, 9)
    star = [edited(base, 0.018, i) for i in range(25)]
    chain = [base + " tail"]
    for i in range(6):
        chain.append(edited(chain[-1], 0.012, 50 + i))
    texts = star + chain + [base]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    same(sorted((r["doc_id"], r["class_id"]) for r in neardup.classes(docs).collect()), classes(texts))


def test_common_passage_keeps_documents_apart(spark, words):
    passage = words(60, 77)
    texts = [words(70, 200 + i) + " " + passage for i in range(40)]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    same(sorted((r["doc_id"], r["class_id"]) for r in neardup.classes(docs).collect()), classes(texts))


def test_odd(spark, odd, empty):
    got = neardup.classes(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(by[1]) == [1, 1, 6] and sorted(by[2], key=str) == [2, 3, None] and by[4] == [4]
    assert None in by  # the text that only a row without an id has
    kept = neardup.keepers(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["label"] for r in got})
    assert neardup.classes(empty).count() == 0 and neardup.keepers(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    code = lambda i: i.to_bytes(4, "big")
    label = {i: i for e in edges for i in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame([(bytearray(code(a)), bytearray(code(b))) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["label"], "big") for r in neardup.components(df).collect()}
    assert got == {k: v for k, v in label.items() if k != v}


def test_strays_at_exactly_the_threshold_meet():
    """28 of 35 shingles (and 56 of 70, and 28 of 31 and 32) is 0.8: the bound on sizes must not drop such a pair by rounding."""
    fine = bytes(neardup.FINE)
    for n, m, both in [(4 * j, 5 * j, 4 * j) for j in range(1, 400)] + [(31, 32, 28)]:
        rows = [(1, 0, 0, b"p", b"p", n, both, [1], fine), (1, 0, 1, b"q", b"q", m, both, [1], fine)]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["band", "salt", "kind", "node", "label", "n", "shared", "bands", "fine"])
        assert sum(b.num_rows for b in neardup._meet(0.8)([batch])) == 1, (n, m)
        less = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(*r[:6], both - 1, *r[7:]) for r in rows])], names=batch.schema.names)
        assert sum(b.num_rows for b in neardup._meet(0.8)([less])) == 0, (n, m)
