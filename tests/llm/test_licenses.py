import random
import re

from tables import table

from parcelflow.llm import licenses

MIT = "Released under the MIT License."


def brute(text):
    best, hits = None, 0
    plain = lambda u: " ".join("".join(c if c.isalnum() else " " for c in u.lower()).split())
    blocks = [b for b in map(plain, (text or "").split("\n\n")) if b]
    runs = {" ".join(blocks[i : i + k]) for k in range(1, licenses.RUN + 1) for i in range(len(blocks) - k + 1)}
    for unit in runs | {plain(u) for u in (text or "").split("\n")}:
        a = {f"{x} {y}" for x, y in zip(unit.split(), unit.split()[1:])}
        found = [(-2 * len(a & set(b)) / (len(a) + len(b)), n) for n, b in ((n, licenses.template_bigrams(t)) for n, t in licenses.TEMPLATES)]
        if a and min(found)[0] <= -licenses.THRESHOLD:
            best, hits = min(found) if best is None else min(best, min(found)), hits + 1
    return (best[1], -best[0], hits) if best else (None, None, 0)


def test_against_brute_force(spark, words):
    apache = licenses.TEMPLATES[1][1]
    full = [t for n, t in licenses.TEMPLATES if len(t) > 600]
    texts = [
        words(30, 1) + "\n" + MIT + "\n" + words(30, 2), MIT, "released   under the MIT-license", "Released under MIT", apache, apache.replace(". ", ".\n"),
        words(10, 3) + "\n\n" + apache.replace(". ", ".\n") + "\n\n" + words(5, 4), "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0", "licensed under the", words(200, 5),
        "This work is licensed under the GNU General Public License, version 2.", MIT + "\nLicensed under the Apache License, Version 2.0.", apache + " " + words(80, 6), apache.replace("software", "programs"),
        *("Copyright (c) 2020 Foo\n\n" + t.replace(". ", ".\n\n").replace(", ", ",\n") for t in full), *(words(60, 20 + i) + "\n\n" + t.replace(". ", ".\n\n") + "\n\n" + words(300, 30 + i) for i, t in enumerate(full)),
    ]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["license"], r["dice"], r["n_units"]) for r in licenses.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert got[0][0] == "MIT" and got[6][0] == "Apache-2.0" and got[10][0] is None
    assert len(full) == 5 and [got[15 + i][0] for i in range(10)] == [n for n, t in licenses.TEMPLATES if len(t) > 600] * 2


def test_key_words_lose_nothing():
    for _, text in licenses.TEMPLATES:
        b = licenses.template_bigrams(text)
        keys = licenses.key_words(b, 0.8)
        without = [x for x in b if not set(x.split()) & set(keys)]
        assert 2 * len(without) / (len(without) + len(b)) < 0.8


def test_no_python_and_odd(spark, odd, empty):
    got = licenses.scan(odd)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == odd.count() and got.filter("license is not null").count() == 0
    assert licenses.scan(empty).count() == 0


def brute_within(text):
    """The best run of words of any length, by trying all."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    pairs = [f"{x} {y}" for x, y in zip(words, words[1:])]
    found = []
    for name, b in ((n, set(licenses.template_bigrams(t))) for n, t in licenses.TEMPLATES):
        if len(b) > licenses.WITHIN:
            continue
        for i in range(len(pairs)):
            for j in range(i + 1, min(len(pairs), i + int(1.5 * len(b))) + 1):
                a = set(pairs[i:j])
                found.append((-2 * len(a & b) / (len(a) + len(b)), name))
    best = min(found, default=(0, None))
    return (best[1], -best[0]) if best[0] <= -licenses.THRESHOLD else (None, None)


def test_notices_inside_longer_text(spark, words, tmp_path):
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0-or-later").split()
    wrapped = "".join(f"# {' '.join(gpl[i : i + 8])}\n" for i in range(0, len(gpl), 8))
    texts = [
        "This module is part of Foo. Released under the MIT License. See LICENSE.", words(40, 1) + " " + MIT + " " + words(40, 2), "# Copyright Foo\n" + wrapped + "import os\n" + words(30, 3),
        words(9, 4) + " Licensed under CC\nBY-SA 4.0. " + words(9, 5), words(9, 6) + " released under no license " + words(9, 7), words(12, 8) + " governed by a BSD license that can be found in the LICENSE file " + words(9, 9),
    ]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate([*texts, MIT, None, ""])])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["license"], r["dice"], r["n_units"]) for r in licenses.op3_license_scan(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(6)] == [(*brute_within(t), 0) for t in texts]
    assert [got[i][0] for i in range(5)] == ["MIT", "MIT", "GPL-3.0-or-later", "CC-BY-SA-4.0", None]
    assert [got[i] for i in (6, 7, 8)] == [("MIT", 1.0, 1), (None, None, 0), (None, None, 0)]


def test_long_licenses_inside_longer_text(spark, words, tmp_path):
    """Every template inside a longer block, over more blocks than a unit has, and around words that repeat: runs have no limit but the bound."""
    plain = lambda t: re.sub(r"[^a-z0-9]+", " ", t.lower()).split()
    texts, want = [], []
    for name, template in licenses.TEMPLATES:
        w = template.split()
        texts.append(f"{words(300, 1)} {template} {words(300, 2)}")
        want.append((name, 1.0))
        if len(w) > 60:
            comment = "".join(f" * {' '.join(w[i : i + 5])}\n" for i in range(0, len(w), 5))
            texts.append(f"/*\n{comment} */\nimport os\n{words(300, 3)}")
            want.append((name, 1.0))
            if name != "Apache-2.0":  # whose first words are a template themselves, and so a unit
                texts.append("\n\n".join([words(300, 4), *(" ".join(w[i : i + 2]) for i in range(0, len(w), 2)), words(300, 5)]))
                want.append((name, 1.0))
            whole = plain(template)
            texts.append(" ".join([words(300, 6), *whole[:40], *["again"] * 900, *whole[40:], words(300, 7)]))
            b = set(licenses.template_bigrams(template))
            a = [f"{x} {y}" for x, y in zip([*whole[:40], "again"], [*whole[1:40], "again", "again"])] + [f"{x} {y}" for x, y in zip(["again", *whole[40:]], whole[40:])]
            runs = [set(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)]
            dice = [max((2 * len(r & set(licenses.template_bigrams(t))) / (len(r) + len(licenses.template_bigrams(t))), n) for r in runs) for n, t in licenses.TEMPLATES if n == name or "Apache" in name]
            want.append((name, max(dice)[0]))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["license"], r["dice"], r["n_units"]) for r in licenses.op3_license_scan(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == [(*x, 0) for x in want]
    assert "Python" not in licenses.op3_license_scan(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_runs_against_all_runs(spark, tmp_path):
    """Short texts of few words, whose bigrams repeat, against every run of any length."""
    rng = random.Random(3)
    templates = [(str(k), " ".join(rng.choices("abcde", k=4 + k))) for k in range(6)]
    texts = [" ".join(rng.choices("abcde" if i % 2 else "abcdexyz", k=rng.randint(1, 60))) for i in range(200)]

    def brute_runs(text):
        w, found = text.split(), []
        for name, b in ((n, set(licenses.template_bigrams(t))) for n, t in templates):
            for i in range(len(w)):
                a = set()
                for x, y in zip(w[i:], w[i + 1 :]):
                    a.add(f"{x} {y}")
                    found.append((-2 * len(a & b) / (len(a) + len(b)), name))
        best = min(found, default=(0, None))
        return tuple(best) if best[0] <= -licenses.THRESHOLD else None

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(docs.select("doc_id", licenses.best_within(docs["text"], templates)).collect())
    want = [brute_runs(t) for t in texts]
    assert [tuple(got[i]) if got[i] and got[i][1] else None for i in range(200)] == want
    assert 20 < sum(x is not None for x in want) < 180
