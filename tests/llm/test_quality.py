import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tables import table

from parcelflow.llm import quality

LABELS = "doc_id long, quality int, toxic int, held boolean, t_id long"


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered), n < 10 or 100 * len(covered) > 20 * n


def rows(df):
    return sorted([(r["doc_id"], tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in df.collect()], key=str)


def labels(spark, rows):
    return spark.createDataFrame([(*r, True, 1) for r in rows], LABELS)


def test_base_rules(spark, odd, words):
    more = [(20, "a b c d e a b c d e", None, None), (21, "a b c d", None, None), (22, "x\nx\n\n\n x\nx", None, None), (23, "a a a a a a", None, None), (24, "\x1c\x1d \u00a0 \u2003x", None, None), (25, words(30, 1) + " # * | <>&$%", None, None)]
    docs = odd.unionByName(table(spark, more))
    got = quality.judge(docs, labels(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 0)]))
    assert rows(got) == sorted([(r["doc_id"], base(r["text"])) for r in docs.collect()], key=str)
    assert all(not r["kept"] for r in got.collect() if r["base_failed"])


def test_ratio_parts_junk_from_clean(spark, words):
    clean = [(i, words(120, i), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "$$$" for w in words(120, i).split()), "en", "a") for i in range(60)]
    docs = table(spark, clean + junk)
    got = quality.judge(docs, labels(spark, [(i, 1, 0) for i in range(0, 300, 2)] + [(1000, 0, 0)]))
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(60))
    again = {r["doc_id"]: (r["kept"], r["score"]) for r in quality.judge(docs.repartition(5), labels(spark, [(i, 1, 0) for i in range(0, 300, 2)])).collect()}
    assert all(again[r["doc_id"]] == (r["kept"], r["score"]) for r in got.collect())


def test_partly_junk_is_dropped(spark, words):
    """A quarter of the words is junk; over 200 held-out rows set the threshold."""
    marred = lambda i: " ".join(w + "$$$" if j % 4 == 0 else w for j, w in enumerate(words(120, i).split()))
    docs = table(spark, [(i, words(120, i), "en", "a") for i in range(1500)] + [(5000 + i, marred(i), "en", "a") for i in range(300)])
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels(spark, [(i, 1, 0) for i in range(1500) if i % 4])).collect()}
    assert sum(not kept[i] for i in range(1500)) <= 0.015 * 1500
    assert sum(kept[5000 + i] for i in range(300)) <= 0.05 * 300


def grams(text):
    """Cells of a text's words and pairs, in whole numbers."""
    h = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [x >> 16 for x in h] + [(a * 0x9E3779B97F4A7C15 + b * 0xD1342543DE82EF95) % (1 << 64) >> 48 for a, b in zip(h, h[1:])]


def test_scores_and_threshold_by_hand(spark, words):
    """Both multinomials, every score, the held-out quantile and the verdicts, recomputed without the operator's code."""
    texts = {i: words(30 + i % 50, i) if i % 9 else " ".join(w + "#" * (i % 3) for w in words(40, i).split()) for i in range(1300)}
    good = [i for i in texts if i % 9]
    bad = [(i, 0, 0) for i in range(0, 90, 9)] + [(1, 1, 1)]
    docs = table(spark, [(i, t, "en", "a") for i, t in texts.items()])
    got = {r["doc_id"]: r for r in quality.judge(docs, labels(spark, [(i, 1, 0) for i in good] + bad)).collect()}
    held = {r["doc_id"] for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("h")).collect() if r["h"]}
    trusted = set(good) - {1}
    raw, fine = Counter(), Counter()
    for i, t in texts.items():
        raw.update(grams(t))
        if i in trusted - held:
            fine.update(grams(t))
    p = lambda c, x: math.log((c[x] + 0.5) / (sum(c.values()) + 0.5 * 65536))
    ratio = {x: p(fine, x) - p(raw, x) for x in raw}
    score = {i: sum(ratio[x] for x in grams(t)) / len(grams(t)) for i, t in texts.items()}
    assert all(abs(got[i]["score"] - s) < 1e-9 for i, s in score.items())
    tail = sorted(score[i] for i in trusted & held)
    assert len(tail) > 200
    place = 0.005 * (len(tail) - 1)
    least = tail[int(place)] * (1 - place % 1) + tail[int(place) + 1] * (place % 1)
    sure = [i for i, s in score.items() if abs(s - least) > 1e-9]
    assert all(got[i]["kept"] == (not base(texts[i])[-1] and score[i] >= least) for i in sure)
    assert any(not got[i]["kept"] for i in sure) and sum(got[i]["kept"] for i in good) > 0.97 * len(good)


@pytest.mark.parametrize("rows", [60, 1200])
def test_oracle(spark, odd, words, tmp_path, rows):
    """Few held rows, whose threshold is a tolerance bound, and more."""
    duckdb = pytest.importorskip("duckdb").connect()
    more = [(100 + i, (words(20 + i % 50, i) if i % 9 else "a# b$ c% " * 8) + "\n\nx\nx\n \n") for i in range(rows)]
    odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(100 + i, int(i % 9 > 0), 0) for i in range(rows)] + [(None, 1, 0), (101, None, 1)]).write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("documents", "labels"):
        duckdb.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = duckdb.sql(quality.ORACLE)
    got = quality.op7_quality_rules(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_tolerance_of_few_rows():
    """Against tabled factors (99 percent content, 95 percent confidence: 3.981, 3.064 and 2.684 of 10, 30 and 100 rows)."""
    for n, k in ((10, 3.981), (30, 3.064), (100, 2.684)):
        assert abs(quality.tolerance(n, 0.01) / k - 1) < 0.03
    assert quality.tolerance(2) == float("inf")


def test_without_labels_and_empty(spark, odd, empty):
    none = spark.createDataFrame([], LABELS)
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(odd, none).collect())
    assert quality.judge(empty, none).count() == 0


@pytest.mark.parametrize("most", [500_000, 1000])
def test_all_trusted_rows_count(spark, words, monkeypatch, most):
    """More trusted ids than a sample of 20,000 would hold, broadcast and shuffled: all train or set the threshold."""
    monkeypatch.setattr(quality, "BROADCAST_TRUSTED", most)
    n = 21_000
    texts = [words(11 + i % 3, i) + f" x{i % 977}" + "#" * (i % 5) for i in range(n)]
    docs = spark.createDataFrame([*enumerate(texts), (None, words(12, 1)), (None, None)], "doc_id long, text string")
    good = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    marks = {r["doc_id"]: r["held"] for r in quality.trusted_ids(good).collect()}
    assert len(marks) == n
    raw, fine, cells = Counter(grams(words(12, 1))), Counter(), [grams(t) for t in texts]
    for i, c in enumerate(cells):
        raw.update(c)
        if not marks[i]:
            fine.update(c)
    r, f = (sum(c.values()) + 0.5 * 65536 for c in (raw, fine))
    ratio = {x: math.log((fine[x] + 0.5) / f) - math.log((raw[x] + 0.5) / r) for x in raw}
    score = [sum(ratio[x] for x in c) / len(c) for c in cells]
    tail = sorted(s for i, s in enumerate(score) if marks[i])
    place = 0.005 * (len(tail) - 1)
    least = tail[int(place)] * (1 - place % 1) + tail[int(place) + 1] * (place % 1)
    got = {r["doc_id"]: r for r in quality.judge(docs, good).filter("doc_id is not null").collect()}
    assert len(got) == n and all(abs(got[i]["score"] - s) < 1e-9 for i, s in enumerate(score))
    sure = [i for i, s in enumerate(score) if abs(s - least) > 1e-9]
    assert len(sure) > n - 5 and all(got[i]["kept"] == (not got[i]["base_failed"] and score[i] >= least) for i in sure)
