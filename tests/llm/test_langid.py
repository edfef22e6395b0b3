import math
import random

import pytest
from tables import table
from pyspark.sql import functions as F

from parcelflow.llm import langid

SYLLABLES = {"en": ["the", "ing", "tion", "an", "er"], "fr": ["eau", "oui", "é", "ment", "çon"], "de": ["sch", "ung", "ei", "ü", "cht"]}


def text(lang, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def corpus(spark, wrong=0.0):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        lang = "en" if i % 4 else ("fr", "de")[i // 4 % 2]
        said = rng.choice(list(SYLLABLES)) if rng.random() < wrong else lang
        rows.append((i, text(lang, 3 + i % 40, i), said, f"{lang}.host.example"))
    return table(spark, rows), {i: ("en" if i % 4 else ("fr", "de")[i // 4 % 2]) for i in range(400)}


def test_held_out_accuracy(spark):
    """Fitted on a third of the rows, of which a tenth are declared wrongly; judged on all."""
    docs, truth = corpus(spark, 0.15)
    got = langid.identify(docs, train_rows=130).select("row.doc_id", "language", "kept").collect()
    assert sum(r["language"] == truth[r["doc_id"]] for r in got) >= 0.98 * len(got) and all(r["kept"] for r in got)


def test_priors_decide_where_text_does_not(spark):
    docs, _ = corpus(spark)
    short = table(spark, [(1000, "x q", None, "fr.host.example"), (1001, "x q", None, "de.host.example"), (1002, "x q", "fr-CA", None), (1003, "x q", "de", "new.example")])
    got = {r["doc_id"]: r["language"] for r in langid.identify(docs.unionByName(short)).select("row.doc_id", "language").collect()}
    assert got[1000] == "fr" and got[1001] == "de" and got[1002] == "fr" and got[1003] == "de"


def test_pages(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, f"https://{lang}{i % 5}.example.{'com' if i % 2 else lang}/x", f"<!DOCTYPE html><HTML class=a LANG='{lang.upper()}-x'><script>var the='ing';</script><p>{text(lang, 12, i)}</p>", lang))
    rows.append((500, "http://shop.example.fr/a", "<html><p>x q</p>", "fr"))
    rows.append((501, None, None, None))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, truth string")
    got = langid.identify_pages(pages).select("row.page_id", "row.truth", "language", "kept").collect()
    assert sum(r["language"] == r["truth"] for r in got if r["truth"]) >= 199
    assert [r["kept"] for r in got if r["page_id"] == 501] == [False]


def test_priors_joined_by_shuffle(spark, monkeypatch):
    docs, _ = corpus(spark)
    want = sorted(map(tuple, langid.identify(docs, carry=["doc_id"]).select("row.doc_id", "language", "kept").collect()))
    monkeypatch.setattr(langid, "BROADCAST_HOSTS", -1)
    assert sorted(map(tuple, langid.identify(docs, carry=["doc_id"]).select("row.doc_id", "language", "kept").collect())) == want


def test_odd(spark, odd, empty):
    got = langid.identify(odd).select("row.*", "language", "posterior", "kept").collect()
    assert len(got) == odd.count()
    for r in got:
        assert r[-1] == bool(r["text"] and any(c.isalpha() for c in r["text"])) and (r["language"] is None) == (not r[-1])
    assert langid.identify(odd).select("row.*").columns == odd.columns
    assert langid.identify(empty).count() == 0
    assert not any(r["kept"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_posteriors_by_hand(spark):
    """The fused posterior of one row is the product of its four kinds of evidence."""
    import numpy as np

    docs, _ = corpus(spark)
    base = docs.select("text", langid.code(F.col("lang")).alias("declared"))
    model = langid.fit(base)
    rows = docs.collect()
    alone = {}
    logs = {}
    for r in rows:
        c = langid.trigram_cells(r["text"])
        logs[r["doc_id"]] = model.logs[:, c].mean(axis=1) * min(len(c), langid.TEMPER)
        p = np.exp(logs[r["doc_id"]] - logs[r["doc_id"]].max())
        alone.setdefault(r["source"], np.zeros(3))
        alone[r["source"]] += p / p.sum()
    whole = sum(alone.values()) + 1
    whole /= whole.sum()
    domain = sum(alone.values())  # all hosts end in host.example
    domain = (domain + langid.DOMAIN_WEIGHT * whole) / (domain.sum() + langid.DOMAIN_WEIGHT)
    got = {r["doc_id"]: r["posterior"] for r in langid.identify(docs).select("row.doc_id", "posterior").collect()}
    for r in rows[:20]:
        host = (alone[r["source"]] + langid.HOST_WEIGHT * domain) / (alone[r["source"]].sum() + langid.HOST_WEIGHT)
        said = np.array([langid.DECLARED_RIGHT if x == r["lang"] else (1 - langid.DECLARED_RIGHT) / 2 for x in model.languages])
        x = np.exp(logs[r["doc_id"]] - logs[r["doc_id"]].max()) * host * said
        assert abs(got[r["doc_id"]] - x.max() / x.sum()) < 1e-9


def test_multinomials_by_hand(spark):
    """Counts of hashed byte trigrams of all rows, with half a count for each of the cells, recomputed without the operator's code."""
    docs, truth = corpus(spark)
    rows = docs.collect()
    model = langid.fit(docs.select("text", langid.code(F.col("lang")).alias("declared")), len(rows))
    counts = {x: {} for x in SYLLABLES}
    for t, lang in {(r["text"], r["lang"]) for r in rows}:
        plain = b" " + b" ".join(b"".join(bytes([b]) if 97 <= b <= 122 or b >= 128 else b" " for b in t.lower().encode()).split()) + b" "
        for a, b, c in zip(plain, plain[1:], plain[2:]):
            cell = (((a << 16 | b << 8 | c) * 0x9E3779B97F4A7C15) % 2**64) >> 49
            counts[lang][cell] = counts[lang].get(cell, 0) + 1
    assert model.languages == sorted(SYLLABLES)
    for lang, logs in zip(model.languages, model.logs):
        total = sum(counts[lang].values()) + 0.5 * langid.CELLS
        assert all(abs(logs[cell] - math.log((n + 0.5) / total)) < 1e-9 for cell, n in counts[lang].items())
        assert abs(sum(math.exp(x) for x in logs) - 1) < 1e-9


def test_oracle(spark, odd, tmp_path):
    duckdb = pytest.importorskip("duckdb").connect()
    names = ("doc_id", "text", "lang", "source")
    docs = corpus(spark, 0.2)[0].select(*names).union(odd.withColumn("text", F.when(F.length("text") < 9000, F.col("text"))).select(*names))
    docs = docs.union(spark.createDataFrame([(900 + i, t, None, "x.y.example") for i, t in enumerate(FOREIGN)] + [(950, "the x q", "EN_us", None)], docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(langid.ORACLE)
    flat = lambda r: tuple(round(x, 8) if isinstance(x, float) else x for x in r)
    got = langid.op10_language_id(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(flat, got), key=str) == sorted(map(flat, want.fetchall()), key=str) and not all(r["kept"] for r in got)


FOREIGN = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
    "xkq zvbw qpfjk wvzx kqjxz bvkwq zxjpf qkvwz jxqbk zwvpq kxjzq vbwkz qjxpk wzvqb kjxqz",
    "q83vEjRWeJCrze8BI0VniavN7wEjRWeJq83vASNFZ4mrze8BI0VniZCrze/+3LqYdlQyEP7cupg=",
]


def test_foreign_and_junk_are_rejected(spark):
    """Also where markup and host speak for a known language, and with a language of one training row about."""
    docs, _ = corpus(spark)
    foreign = table(spark, [(1000 + i, t, said, host) for i, (t, (said, host)) in enumerate((t, e) for t in FOREIGN for e in ((None, None), ("en", "en.host.example")))])
    known = docs.unionByName(table(spark, [(900, text("fr", 20, 900), "rare", "x"), (901, "lorem ipsum dolor sit amet", "la", "x")]))
    model = langid.fit(known.select("text", langid.code(F.col("lang")).alias("declared")))
    assert "la" in model.languages
    train = known.unionByName(foreign.filter("lang is null"))
    got = langid.identify(train).select("row.doc_id", "language", "posterior", "kept").collect()
    assert all(r["kept"] for r in got if r["doc_id"] < 1000)
    assert all(not r["kept"] and r["language"] is None and r["posterior"] is None for r in got if r["doc_id"] >= 1000)
    declared = langid.identify(known.unionByName(foreign)).select("row.doc_id", "row.lang", "kept").collect()
    assert not any(r["kept"] for r in declared if r["doc_id"] >= 1000)


def test_rare_and_many_languages(spark):
    """A language with 2 rows among 1,200, and 70 languages: each has its class, whatever the sample's size."""
    names = [f"{a}{b}" for a in "abcdefg" for b in "klmnopqrst"]
    rng = random.Random(5)
    own = {x: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(12)] for x in names}
    say = lambda x, i: " ".join("".join(random.Random(f"{x}{i}{j}").choices(own[x], k=3)) for j in range(60))
    rows = [(i, say(names[0], i), names[0], "x") for i in range(1200)]
    rows += [(2000 + 2 * k + i, say(x, i), x, "x") for k, x in enumerate(names[1:]) for i in range(2)]
    docs = table(spark, rows)
    got = langid.identify(docs, train_rows=100).select("row.lang", "language", "kept").collect()
    assert all(r["language"] == r["lang"] and r["kept"] for r in got)
    pool = docs.select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    sizes = {r["lang"]: (r["n"], r["edge"]) for r in langid.sample_of(pool, 100).groupBy("lang").agg(F.count("h").alias("n"), F.max("h").alias("edge")).collect()}
    assert sizes[names[0]] == (100, sorted(r["h"] for r in pool.filter(F.col("lang") == names[0]).select("h").distinct().collect())[99])
    assert len(sizes) == 70 and all(sizes[x][0] == 2 for x in names[1:])
