import random
import re

import corpus_pipeline
import public_tokenizers
from tables import table
from tokenizers import Tokenizer

import __spark_entry__ as entry
from parcelflow.llm import mixing
from parcelflow.llm.common import _hadoop, noting


def test_registered():
    names = entry.queries()
    assert [m[1] for n in names if (m := re.match(r"op(\d+)_", n))] == [str(i) for i in range(1, 11)] and "pipeline" in names
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mixing", "packing"]


def test_pipeline_by_stage(spark, words, tmp_path):
    """Each stage against the decision it should take on its own input; then run() against the stages by hand."""
    from test_neardup import classes
    from test_packing import check
    from test_substring import brute

    rng = random.Random(3)
    passage = words(60, 999)
    rows = [(i, words(40 + i % 50, i), "en", "ab"[i % 2]) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "a") for i in range(10)] + [(200 + i, words(60, 500 + i) + " " + passage, "en", "b") for i in range(8)]
    rows += [(300, "... 12 !!", "en", "a"), (301, None, None, None)]
    rng.shuffle(rows)
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    frames = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert frames[-1].columns == docs.columns
    ids = [sorted(r["doc_id"] for r in f.collect()) for f in frames[:-1]]
    assert set(ids[0]) - set(ids[1]) == {300, 301}
    texts = {r["doc_id"]: r["text"] for r in frames[1].collect()}
    label = dict(zip(texts, classes(list(texts.values()))))
    assert ids[2] == sorted(min(d for d in texts if label[d] == c) for c in set(label.values()))
    kept = [(r["doc_id"], r["text"]) for r in frames[2].collect()]
    want = {d: b[3] if b[1] else t for (d, t), b in zip(kept, brute([t for _, t in kept]))}
    assert {r["doc_id"]: r["text"] for r in frames[3].collect()} == {d: t for d, t in want.items() if t}
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(d) for d in ids[4]) <= 2
    check(frames[4])
    assert len(ids[4]) == len(mixing.mix(frames[3]).collect())
    key = lambda df: sorted(tuple(r) for r in df.drop("sequence_id").collect())
    with noting() as paths:
        out = corpus_pipeline.run(spark, str(tmp_path))
    assert key(out) == key(frames[5])
    there = lambda p: (lambda path, fs: fs.exists(path))(*_hadoop(spark, p))
    assert len(paths) == 5 and [there(p) for p in paths] == [False] * 4 + [True]


def test_stages_keep_what_their_input_reads(spark, words, tmp_path):
    """Chained without writing, against the contract: what the plan still reads stays; what it doesn't goes with the next stage."""
    docs = table(spark, [(i, words(40 + i, i), "en", "ab"[i % 2]) for i in range(20)])
    (_, first), (_, second), (_, third) = corpus_pipeline.STAGES[:3]
    lazy = second(spark, first(spark, docs, ""), "")
    assert lazy.count() == 20
    lazy.write.parquet(f"{tmp_path}/two")
    assert third(spark, spark.read.parquet(f"{tmp_path}/two"), "").count() == 20
    assert set(corpus_pipeline._written.__dict__) == {"2"}


def test_run_over_odd_and_empty_tables(spark, odd, empty, words, tmp_path):
    """Nulls, repeated rows, a very long text and clashing names; what is packed is what the rules by themselves leave."""
    from test_neardup import classes
    from test_substring import brute

    more = odd.unionByName(table(spark, [(50, words(30_000, 60) + " end", "en", "a"), (51, words(200, 61), "en", None)] + [(52, words(90, 62), "en", "a")] * 3))
    more.write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    texts = [(r["doc_id"], r["text"]) for r in more.collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    label = classes([t for _, t in texts])
    firsts = {}
    for (d, t), c in zip(texts, label):
        firsts[c] = min(firsts.get(c, (True, 1, "")), (d is None, d or 0, t))
    kept = list(firsts.values())
    stripped = [(d if not none else None, b[3] if b[1] else t) for (none, d, t), b in zip(kept, brute([t for _, _, t in kept])) if b[3] or not b[1]]
    assert {r["doc_id"] for r in got} <= {d for d, _ in stripped} and {50, 51, 52} <= {r["doc_id"] for r in got}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = {}
    for d, t in stripped:
        size.setdefault(d, set()).add(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1)
    assert {(r["doc_id"], r["doc_tokens"]) for r in got} <= {(d, n) for d, ns in size.items() for n in ns}
    empty.write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
