"""URL filters: rules first, then a path-template tree per host judged by smoothed labelled purity.

Addresses that a rule decides are the labels. Path segments are generalised lexically (digits become #). Then, in the
tree of each host, every branch is compared with its siblings together: where its share of blocked labels doesn't differ from
theirs significantly (a test of two shares with a pooled variance), or one of the two has no labels, it is merged with the others like it
into the wildcard *, subtrees and all. A template's block purity is its share of blocked labels, smoothed towards its
parent: template prefix, host, domain, suffix, all; a template that holds all of its parent's labels takes the parent's. Templates whose purity reaches
REJECT block; all else is allowed.

Everything is built-in column functions. Counting comes before every join, so a hot host is a few pre-aggregated rows.
All levels of all paths are counted at once, under digests of their prefixes, so a path of any depth is judged by all of its segments.

Defined results: null addresses and those without `://` have empty host and path, are labelled by no rule and allowed by
the method as a host of their own (the empty one) unless most labels of all block; repeated rows are judged alike and count as labels each; paths of any
length are used whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import materialize

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labels that a parent counts for, standard deviations under which siblings are alike, purity from which to block.
PRIOR, ALIKE, REJECT = 5.0, 1.96, 0.8
#: Paths up to this many are broadcast (a digest of 32 letters and a number each); beyond it pages are joined by shuffle.
BROADCAST_PATHS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits; of equally long ones, that of the longer host, block first."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Array of the generalised segments."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}(?=\.|$)", "#"), r"[0-9]+", "#"))


def chain(host: Column, parts: Column) -> Column:
    """Digests that stand for the host and for each prefix of its path."""
    return F.aggregate(parts, F.array(F.md5(host)), lambda up, x: F.concat(up, F.array(F.md5(F.concat(F.element_at(up, -1), F.lit("/"), x)))))


def merge(paths: DataFrame) -> DataFrame:
    """leaf, host, parts, allowed, blocked with the segments of merged branches replaced by *."""
    linked = paths.withColumn("chain", chain(F.col("host"), F.col("parts")))
    pairs = F.arrays_zip(F.expr("slice(chain, 1, size(chain) - 1)").alias("up"), F.expr("slice(chain, 2, size(chain))").alias("node"))
    steps = linked.select("leaf", "n", "allowed", "blocked", F.posexplode(pairs).alias("level", "step")).select("leaf", "n", "allowed", "blocked", "level", F.col("step.up").alias("up"), F.col("step.node").alias("node"))
    own = steps.groupBy("up", "node").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    together = own.groupBy("up").agg(F.count(F.lit(1)).alias("kids"), F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    n, n_rest = F.col("a") + F.col("b"), F.col("all_a") + F.col("all_b") - F.col("a") - F.col("b")
    pooled = F.try_divide("all_b", F.col("all_a") + F.col("all_b"))
    z = F.abs(F.try_divide("b", n) - F.try_divide(F.col("all_b") - F.col("b"), n_rest)) / F.sqrt(F.greatest(F.lit(1e-12), pooled * (1 - pooled) * (1.0 / F.greatest(n, F.lit(1)) + 1.0 / F.greatest(n_rest, F.lit(1)))))
    alike = (F.col("kids") > 1) & ((n == 0) | (n_rest == 0) | (z < ALIKE))
    marks = own.join(together, "up").select("node", F.coalesce(alike, F.lit(True)).alias("alike"))
    found = steps.select("leaf", "level", "node").join(marks, "node").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("level", "alike"))).alias("marks"))
    out = paths.join(found, "leaf", "left")
    parts = F.when(F.col("marks").isNull(), F.col("parts")).otherwise(F.zip_with("parts", "marks", lambda x, m: F.when(m["alike"], "*").otherwise(x)))
    return out.select("leaf", "host", parts.alias("parts"), "allowed", "blocked")


def purities(templates: DataFrame) -> DataFrame:
    """host, parts, purity (of blocking) of each template. templates: host, parts, allowed, blocked; a row each."""
    labels = F.struct(F.col("allowed").alias("a"), F.col("blocked").alias("b"))
    host = F.col("host")
    above = F.array(F.concat(F.lit(".."), F.substring_index(host, ".", -1)), F.concat(F.lit("."), F.substring_index(host, ".", -2)))
    linked = templates.withColumn("chain", chain(host, F.col("parts"))).withColumn("whole", F.element_at("chain", -1)).withColumn("nodes", F.concat(above, "chain"))
    steps = linked.select("whole", labels.alias("own"), F.posexplode("nodes").alias("level", "node"))
    counts = steps.groupBy("node").agg(F.sum("own.a").alias("a"), F.sum("own.b").alias("b"))
    total = templates.agg(F.coalesce(F.sum("allowed"), F.lit(0)).alias("all_a"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("all_b"))
    ways = steps.select("whole", "level", "node").join(counts, "node").groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("level", "a", "b"))).alias("way"))
    n_all = F.col("all_a") + F.col("all_b")
    start = F.struct(((F.col("all_b") + PRIOR * 0.5) / (n_all + PRIOR)).alias("purity"), n_all.alias("n"))

    def down(up, x):
        n = x["a"] + x["b"]
        return F.struct(F.when(n == up["n"], up["purity"]).otherwise((x["b"] + PRIOR * up["purity"]) / (n + PRIOR)).alias("purity"), n.alias("n"))

    judged = ways.crossJoin(F.broadcast(total)).select("whole", F.aggregate("way", start, down)["purity"].alias("purity"))
    return linked.select("host", "parts", "whole").join(judged, "whole").select("host", "parts", "purity")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, purity (null where a rule decides)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), segments(F.col("path")).alias("parts"))
    rows = rows.withColumn("leaf", F.element_at(chain(F.col("host"), F.col("parts")), -1))
    counted = (F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    paths = materialize(rows.groupBy("leaf", "host", "parts").agg(*counted), "paths")
    tree = materialize(merge(paths), "templates")
    nodes = purities(materialize(tree.groupBy("host", "parts").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")), "nodes"))
    known = materialize(tree.select("leaf", "host", "parts").join(nodes, ["host", "parts"]).select("leaf", "purity"), "purities")
    side = F.broadcast(known) if known.count() <= BROADCAST_PATHS else known
    found = rows.join(side, "leaf", "left")
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("purity")).alias("purity"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("purity")


def oracle(rules=RULES) -> str:
    cases = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[0] != "block"))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in cases]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, cases))
    ruled = " ".join(f"WHEN {f} THEN '{what}'" for f, (what, _, _) in zip(fits, cases))
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(
  CASE WHEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '^[0-9A-Fa-f-]{{8,}}(\.|$)') THEN regexp_replace(x, '^[0-9A-Fa-f-]+', '#') ELSE x END, '[0-9]+', '#', 'g')) AS parts FROM h),
p AS (SELECT host, parts, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM r GROUP BY ALL),
s AS (SELECT *, parts[1:i - 1] AS up, parts[1:i] AS node FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p)),
o AS (SELECT host, up, node, sum(a) AS a, sum(b) AS b FROM s GROUP BY ALL),
t AS (SELECT *, count(*) OVER w AS kids, sum(a) OVER w AS all_a, sum(b) OVER w AS all_b FROM o WINDOW w AS (PARTITION BY host, up)),
z AS (SELECT *, a + b AS n, all_a + all_b - a - b AS n_rest, all_b / (all_a + all_b) AS pooled FROM t),
m AS (SELECT host, node, kids > 1 AND (n = 0 OR n_rest = 0 OR abs(b / n - (all_b - b) / n_rest) / sqrt(greatest(1e-12, pooled * (1 - pooled) * (1.0 / greatest(n, 1) + 1.0 / greatest(n_rest, 1)))) < {ALIKE}) AS alike FROM z),
k AS (SELECT s.host, parts, list(CASE WHEN alike THEN '*' ELSE parts[i] END ORDER BY i) AS tree FROM s JOIN m ON s.host = m.host AND s.node = m.node GROUP BY ALL),
g AS (SELECT p.*, coalesce(tree, []) AS tree FROM p LEFT JOIN k USING (host, parts)),
v AS (SELECT *, CASE i WHEN 0 THEN ['..' || regexp_extract(host, '[^.]*$')] WHEN 1 THEN ['.' || regexp_extract(host, '([^.]*\.)?[^.]*$')] ELSE list_concat([host, '/'], tree[1:i - 2]) END AS spot FROM (SELECT host, tree, sum(a) AS a, sum(b) AS b, unnest(range(0, len(tree) + 3)) AS i FROM g GROUP BY host, tree)),
c AS (SELECT spot, sum(a) AS a, sum(b) AS b FROM v GROUP BY spot),
e AS (SELECT sum(a) AS a, sum(b) AS b FROM p),
y AS (SELECT v.host, v.tree, list({{'p': c.b::DOUBLE, 'n': c.a + c.b}} ORDER BY i) AS way FROM v JOIN c ON v.spot = c.spot GROUP BY ALL),
x AS (SELECT host, tree, list_reduce(list_concat([{{'p': (e.b + {PRIOR} * 0.5) / (e.a + e.b + {PRIOR}), 'n': e.a + e.b}}], way), lambda up, q: {{'p': CASE WHEN q.n = up.n THEN up.p ELSE (q.p + {PRIOR} * up.p) / (q.n + {PRIOR}) END, 'n': q.n}}).p AS purity FROM y, e)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN g ON r.host = g.host AND r.parts = g.parts JOIN x ON g.host = x.host AND g.tree = x.tree
"""
