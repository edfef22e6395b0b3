import random

import pytest
from tables import table

from parcelflow.llm import mixing


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """By the rule itself: split, stop what is above, reshare, until none is."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(full.values())
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if got[s] > most * sizes[s] + 1e-9]
        if not over:
            return full | got
        full |= {s: most * sizes[s] for s in over}


def test_targets():
    rng = random.Random(1)
    for _ in range(200):
        sizes = {s: rng.choice([0, 1, 10, 500, 10_000]) for s in ["b", "a", "é", "Z", None, "zz"][: rng.randint(1, 6)]}
        got, want = mixing.targets(sizes), shares(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def check(docs, slack=0.02, **options):
    """Sums, targets and the mix itself, recomputed; each source comes within `slack` of its target or its longest document."""
    rows = mixing.mixed_words(docs, **options).collect()
    assert len(rows) == docs.count()
    size = lambda t: len((t or "").encode().split())
    want: dict = {}
    for r in docs.collect():
        want[r["source"]] = want.get(r["source"], 0) + size(r["text"])
    goal = mixing.targets(want)
    assert sorted((r["source_size"], round(r["target"], 6)) for r in rows) == sorted((want[r["source"]], round(goal[r["source"]], 6)) for r in docs.collect())
    assert all(r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 2 * r["size"] for r in rows)
    out = mixing.mix(docs, **options).collect()
    sent: dict = {}
    for r in out:
        sent[r["source"]] = sent.get(r["source"], 0) + size(r["text"])
    assert sum(r["taken"] for r in rows) == sum(sent.values())
    for source, words in want.items():
        longest = max(size(r["text"]) for r in docs.collect() if r["source"] == source)
        assert sent.get(source, 0) <= goal[source] + 0.5 and goal[source] - sent.get(source, 0) <= max(slack * goal[source], longest)
    count: dict = {}
    for r in out:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + size(r["text"])
    by_id: dict = {}
    for r in rows:
        by_id[r["doc_id"]] = by_id.get(r["doc_id"], 0) + r["taken"]
    assert {d: n for d, n in by_id.items() if n} == {d: n for d, n in count.items() if n}
    return rows, out


def brute(docs, repeats=2):
    """Taken copies by source in finish order: whole queues first, then what fits of the documents behind the gap."""
    rows = mixing.queues(docs)[0].collect()
    out = {}
    for source in {r["source"] for r in rows}:
        own = sorted((r for r in rows if r["source"] == source and r["size"]), key=lambda r: r["begin"])
        sent, gone, goal = 0, False, round(own[0]["target"]) if own else 0
        for e in range(repeats):
            for r in own:
                gone = gone or sent + r["size"] > goal
                if sent + r["size"] <= goal:
                    sent += r["size"]
                    out[r["doc_id"]] = out.get(r["doc_id"], 0) + 1
    return out


def test_mix(spark, words):
    docs = table(spark, [(i, words(i % 37, i), "en", "abc"[min(2, i % 5)]) for i in range(400)])
    rows, out = check(docs)
    again = mixing.mixed_words(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert [r["doc_id"] for r in mixing.mix(docs.repartition(3)).collect()] == [r["doc_id"] for r in out]
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == brute(docs)


def test_segments_and_joins(spark, words, monkeypatch):
    monkeypatch.setattr(mixing, "SEGMENT_ROWS", 8)
    monkeypatch.setattr(mixing, "EQUAL_ROWS", 3)
    monkeypatch.setattr(mixing, "BROADCAST_COPIES", -1)
    docs = table(spark, [(i, words(5, i), "en", "a" if i % 3 else "b") for i in range(300)] + [(1, "same words here", "en", "a")] * 50)
    check(docs)


def test_rows_that_differ_in_one_column(spark, words):
    t = words(30, 1)
    rows = [(1, t, "L1", "a"), (1, t, "L2", "a"), (1, None, "x", t), (1, t, "x", None), (1, t, "x", "a"), (1, t, "x", "a")] + [(9, words(40, i), "en", "b") for i in range(30)]
    docs = table(spark, rows)
    _, out = check(docs, slack=1)
    pool = [tuple(r) for r in docs.collect()]
    assert all(out.count(r) <= 2 * pool.count(tuple(r)) for r in out)
    assert {r["lang"] for r in out if r["doc_id"] == 1 and r["source"] == "a"} >= {"L1", "L2"}


def test_odd(spark, odd, empty):
    check(odd, slack=1)
    assert mixing.mixed_words(empty).count() == 0 and mixing.mix(empty).count() == 0
    got = mixing.mix(odd)
    assert got.columns == odd.columns
    pool = [r[:] for r in odd.collect()]
    assert all(r[:] in pool for r in got.collect())


def test_oracle(spark, odd, words, tmp_path):
    """Also with segments, gaps that several documents fill, nulls and rows that repeat."""
    duckdb = pytest.importorskip("duckdb").connect()
    some = odd.select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(i, words(1 + i * i % 90, i % 1900), "en", f"s{min(2, i % 7)}", 1) for i in range(6000)], some.schema)
    some.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(mixing.ORACLE)
    flat = lambda r: tuple(round(x, 4) if isinstance(x, float) else x for x in r)
    got = mixing.op1_mix_sources(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(flat, got), key=str) == sorted(map(flat, want.fetchall()), key=str)


def test_order_and_budget(spark, words):
    docs = table(spark, [(i, words(20, i), "en", "a" if i < 150 else "b") for i in range(200)])
    _, copies, budget = mixing.queues(docs)
    rows = mixing.sequence(copies, budget).collect()
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows) and sum(r["size"] for r in rows) <= budget + 1
    cut = mixing.sequence(copies, 1000.0).collect()
    assert cut == rows[: len(cut)] and sum(r["size"] for r in cut) <= 1000 < sum(r["size"] for r in rows[: len(cut) + 1])
