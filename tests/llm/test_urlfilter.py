import random
import re

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import urlfilter

PAGES = "page_id long, url string, html string, host string, s1 string, t1 string, n int, purity double, verdict string, allowed int"


def table(spark, urls):
    return spark.createDataFrame([(i, u, None, "h", "s", "t", 1, 0.5, "v", 2) for i, u in enumerate(urls)], PAGES)


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fit = [(len(h + p), len(h), w != "allow", h + p, w) for w, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fit)[3], max(fit)[4]) if fit else (None, None)


ODD = [None, "", "nothing", "http://", "http://ORG", "http://a.ORG/x", "http://borg/x", "http://example.org/es/", "http://x.EXAMPLE.org/es/q?a=/de/", "http://xexample.org/es/", "http://example.org/en/12", "http://example.org/en/2",
       "https://a.com/fr/é", "https://a.com/de", "https://a.com/de/", "http://a.com?x=/fr/", "http://a.com#/fr/", "a://b://c/d", "http://a.com/fr/\nx", "http://É.com/fr/", "http://a.net/" + "y/" * 3000, "http://com/fr/"]


def test_hosts_paths_and_rules(spark):
    got = sorted(urlfilter.judge(table(spark, ODD + ODD)).collect(), key=lambda r: r["page_id"])
    assert len(got) == 2 * len(ODD)
    for r, u in zip(got, ODD + ODD):
        assert (r["host"], r["path"]) == parts(u), u
        want = rule(r["host"], r["path"])
        assert r["rule"] == want[0] and r["verdict"] in ("allow", "block")
        if want[1]:
            assert r["verdict"] == want[1] and r["purity"] is None


def test_tree_blocks_pure_branches(spark):
    rules = (("block", "h.com", "/bad/1"), ("allow", "h.com", "/good/1"), ("allow", "g.com", "/"))
    urls = [f"http://h.com/{b}/{k}{i}" for b in ("bad", "good") for k in "12" for i in range(40)] + [f"http://g.com/{i}" for i in range(60)] + ["http://new.net/x"]
    got = {urls[r["page_id"]]: r for r in urlfilter.judge(table(spark, urls), rules).collect()}
    assert got["http://h.com/bad/25"]["verdict"] == "block" and got["http://h.com/bad/25"]["rule"] is None
    assert got["http://h.com/good/25"]["verdict"] == "allow" and got["http://new.net/x"]["verdict"] == "allow"


def by_hand(urls, rules):
    """Template, purity and verdict of each address, from nested dictionaries."""
    rows = []
    for u in urls:
        host, path = parts(u)
        fit = [(len(h + p), len(h), w != "allow", w) for w, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        segs = [re.sub("[0-9]+", "#", re.sub(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}(?=\\.|$)", "#", x)) for x in path.split("/") if x]
        rows.append((host, tuple(segs), max(fit)[3] if fit else None))

    def count(keyed):
        out = {}
        for keys, said in keyed:
            for k in keys:
                a, b = out.get(k, (0, 0))
                out[k] = (a + (said == "allow"), b + (said == "block"))
        return out

    prefixes = lambda h, t: [(h, t[:i]) for i in range(len(t) + 1)]
    own, kids = count((prefixes(h, t), w) for h, t, w in rows), {}
    for h, t in own:
        if t:
            kids.setdefault((h, t[:-1]), set()).add((h, t))

    def alike(node):
        sisters = kids[(node[0], node[1][:-1])]
        a, b = own[node]
        ra, rb = sum(own[k][0] for k in sisters) - a, sum(own[k][1] for k in sisters) - b
        if len(sisters) == 1:
            return False
        if not a + b or not ra + rb:
            return True
        p = (b + rb) / (a + b + ra + rb)
        return abs(b / (a + b) - rb / (ra + rb)) / max(1e-12, p * (1 - p) * (1 / (a + b) + 1 / (ra + rb))) ** 0.5 < urlfilter.ALIKE

    templates = [(h, tuple("*" if alike((h, t[: i + 1])) else t[i] for i in range(len(t)))) for h, t, _ in rows]
    ways = [["", "." + ".".join(h.split(".")[-1:]), ".." + ".".join(h.split(".")[-2:]), *prefixes(h, t)] for h, t in templates]
    total, out = count((w, r[2]) for w, r in zip(ways, rows)), []
    for t, way, r in zip(templates, ways, rows):
        purity, before = 0.5, None
        for k in way:
            a, b = total[k]
            purity = purity if before == a + b else (b + urlfilter.PRIOR * purity) / (a + b + urlfilter.PRIOR)
            before = a + b
        out.append((t[1], purity, r[2] or ("block" if purity >= urlfilter.REJECT else "allow")))
    return out


def test_tree_by_hand(spark, monkeypatch):
    rng = random.Random(4)
    rules = (("block", "a.com", "/x/1"), ("allow", "a.com", "/y/"), ("block", "b.net", "/deep/a/b/c/d/e/1"), ("allow", "b.net", "/deep/a/b/c/q"), ("block", "c.org", "/"))
    hosts = ["a.com", "w.a.com", "b.net", "c.org", "d.org"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['x', 'y', 'z', 'deep/a/b/c/d/e', 'deep/a/b/c/q/r', 'deep'])}/{rng.choice('12k')}{rng.choice('abc')}" for _ in range(900)]
    urls += [f"http://b.net/deep/a/b/c/d/e/{i}" for i in range(60)] + ODD
    want = by_hand(urls, rules)
    for limit in (urlfilter.BROADCAST_PATHS, -1):
        monkeypatch.setattr(urlfilter, "BROADCAST_PATHS", limit)
        got = sorted(urlfilter.judge(table(spark, urls), rules).collect(), key=lambda r: r["page_id"])
        assert [r["verdict"] for r in got] == [w[2] for w in want]
        assert all(r["purity"] is None or abs(r["purity"] - w[1]) < 1e-12 for r, w in zip(got, want))
    unruled = [(u, r["verdict"]) for u, r in zip(urls, got) if r["rule"] is None]
    assert {v for _, v in unruled} == {"allow", "block"} and any("deep" in u and v == "block" for u, v in unruled)


def test_oracle(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb").connect()
    rng = random.Random(9)
    urls = ODD[:-2] + [f"http://{rng.choice(['a.com', 'b.a.com', 'c.com', 'd.net', 'x.example.org', 'e.org'])}/{rng.choice(['de', 'fr', 'en', 'es', 'en/1', 'deadbeef01.x', 'it.2'])}/{rng.choice('12k')}{rng.choice('abc')}" for _ in range(600)] + [f"http://bad.com/de/{i}" for i in range(40)] + ["http://bad.com/en/x"]
    table(spark, urls).write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duckdb.sql(urlfilter.oracle())
    got = urlfilter.op5_url_filter(spark, str(tmp_path))
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert got.filter("rule is null and verdict = 'block'").count() > 0


def test_alike_branches_merge(spark):
    rng = random.Random(1)
    name = lambda: "".join(rng.choice("abcdef") for _ in range(8))
    paths = [(["item", name(), "view"], 1, 0) for _ in range(50)] + [(["about", "us"], 0, 40), (["about", "them"], 0, 30), (["lone"], 0, 0)]
    rows = spark.createDataFrame([("h", p, 1, a, b) for p, a, b in paths], "host string, parts array<string>, n long, allowed long, blocked long")
    rows = rows.withColumn("leaf", F.element_at(urlfilter.chain(F.col("host"), F.col("parts")), -1))
    got = {tuple(r["parts"]) for r in urlfilter.merge(rows).collect()}
    assert got == {("item", "*", "view"), ("about", "*"), ("*",)}


def test_native_and_empty(spark):
    got = urlfilter.judge(table(spark, ODD))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert urlfilter.judge(spark.createDataFrame([], PAGES)).count() == 0
