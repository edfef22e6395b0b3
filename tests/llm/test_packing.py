import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tables import table
from tokenizers import Tokenizer

from parcelflow.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, length=packing.LENGTH):
    whole = Tokenizer.from_file(PATH)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID], "<u4"))
    pieces = [r.asDict() for r in packing.pack(docs, length=length).collect()]
    assert sum(p["length"] for p in pieces) == sum(len(x) for t in texts.values() for x in t)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert any(p["doc_tokens"] == len(x) and p["ids_crc32"] == zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) and p["length"] > 0 for x in texts[p["doc_id"]])
        by_doc[p["doc_id"]].append((p["start"], p["length"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for d, spans in by_doc.items():
        covered = np.zeros(max(len(x) for x in texts[d]), int)
        for s, n in spans:
            covered[s : s + n] += 1
        want = np.zeros_like(covered)
        for x in texts[d]:
            want[: len(x)] += 1
        assert (covered == want).all()
    padding = 0
    for spans in by_sequence.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return pieces, padding


def test_pack(spark, words):
    docs = table(spark, [(i, words(7 * (i % 90), i), "en", "a") for i in range(200)])
    _, padding = check(docs)
    assert padding == 0
    check(docs, 64)


def test_many_ranges(spark, words, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_TOKENS", 3000)
    pieces, padding = check(table(spark, [(i, words(7 * (i % 90), i), "en", "a") for i in range(200)]))
    assert padding == 0 and len({p["sequence_id"] >> 40 for p in pieces}) > 8


def test_other_tokenizers_are_refused(spark, words):
    docs = table(spark, [(1, words(9, 1), "en", "a")])
    with pytest.raises(ValueError, match="word by word"):
        packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    with pytest.raises(TypeError):
        packing.pack(docs.withColumn("doc_id", docs["text"]))


def test_odd(spark, odd, empty):
    pieces, _ = check(odd)
    assert any(p["doc_tokens"] == 1 for p in pieces) and packing.pack(empty).count() == 0


def encoded(tokenizer, texts):
    ids, counts = tokenizer.encode(pa.array(texts), 1)
    parts = [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
    assert all(p[-1] == 1 for p in parts)
    return [p[:-1] for p in parts]


def test_chunks_match_whole_texts(words):
    whole, mine = Tokenizer.from_file(PATH), packing.ChunkTokenizer(PATH)
    texts = [words(50, 1).title(), "It's we'll don't 'tis", "a.b, c.. d., 12,3 x1. 日本. Ünï, ÑO. İstanbul ΣΑΣ. ß.", "<|endoftext|>a <|startoftext|>", "\u00a0a\u2003b\u200bc\x85d\x1ce f\x0bg", "e\u0301. \u0301 x", "", " ", "ﬁn. K.", "...", ".", "A", "é,"]
    for _ in range(2):
        for t, ids in zip(texts, encoded(mine, texts)):
            assert ids == whole.encode(t, add_special_tokens=False).ids, t


def test_memory_of_chunks_is_bounded(words, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    monkeypatch.setattr(packing, "FIRST", 5)
    whole, mine = Tokenizer.from_file(PATH), packing.ChunkTokenizer(PATH)
    for i in range(10):
        texts = [words(30, i), words(40, 50 + i)]
        assert encoded(mine, texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_hilbert_is_a_curve():
    bits = 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(1 << (3 * bits)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()
