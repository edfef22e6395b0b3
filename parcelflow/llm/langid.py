"""Language identification by fusing evidence in a naive Bayes model.

Four kinds of evidence are multiplied: the text (hashed byte trigrams under one multinomial per language, tempered so
that TEMPER trigrams count at most), the language the markup declares, the country suffix of the address, and the
language prior of the host, smoothed towards its domain and that towards the whole corpus. Priors are sums of the
posteriors of text alone, over all documents, by grouped aggregation.

Posteriors only compare the languages with each other. Against all of them speaks a floor on the gain, which is the mean
log-probability of a text's trigrams over that of one never seen: a text must reach LEAST_GAIN of the median gain of its language's training
rows, each judged by counts without itself, and what a share LEAST_SEEN of trigrams seen once gives. Between TEMPER and FEW trigrams the
floor falls to nothing: texts of one or two words can't speak against a language.

The multinomials are fitted on a bounded sample of the rows of each declared language (TRAIN_ROWS, smallest hashes first),
however rare the language is, and of however many languages; everything else covers all rows. Defined results: a text without letters or under the floor is rejected (language and posterior null) whatever else is known; null or
unknown declared languages, suffixes and hosts are no evidence; ties go to the language first by code point; repeated
rows are judged alike and each counts in its host's prior; without any declared row every document is rejected; an
empty table gives an empty result; other columns are carried along or ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm.common import discard, give_back, materialize, prepare, trimmed

CELLS = 1 << 15
TRAIN_ROWS = 6_000
#: Languages whose counts a training task holds at once.
HELD_LANGUAGES = 64
TEMPER = 60.0
SMOOTHING = 0.5
#: Probability that a declared language is right, and that a country suffix points to the text's language.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.7
#: Pseudo-counts of a domain's prior in a host's, and of the corpus's in a domain's.
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 50.0
LEAST_POSTERIOR = 0.5
#: Share of a language's usual gain that its texts reach, and share of trigrams seen that counts as a gain at all.
LEAST_GAIN, LEAST_SEEN = 0.5, 0.1
FEW = 10
#: Host priors up to this many rows are broadcast; beyond it they are joined by shuffle.
BROADCAST_HOSTS = 100_000
# Main language of some country suffixes.
SUFFIXES = {"at": "de", "br": "pt", "de": "de", "es": "es", "fr": "fr", "it": "it", "mx": "es", "nl": "nl", "pl": "pl", "pt": "pt", "uk": "en", "us": "en"}


def trigram_cells(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased letters of a text, everything else being one blank."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first byte after a word stays, as its blank
    raw = np.where(letter, raw, 32)[keep].astype(np.uint64)
    raw = np.concatenate((np.full(1, 32, np.uint64), raw, np.full(1, 32, np.uint64)))
    three = (raw[:-2] << np.uint64(16)) | (raw[1:-1] << np.uint64(8)) | raw[2:]
    return ((three * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)


def _train(batches):
    counts: dict[str, np.ndarray] = {}

    def flush():
        for lang, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(c[some].astype(np.int64))], names=["lang", "cell", "n"])
        counts.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            if lang not in counts and len(counts) >= HELD_LANGUAGES:
                yield from flush()
            c = np.bincount(trigram_cells(text or ""), minlength=CELLS)
            counts[lang] = counts[lang] + c if lang in counts else c
    yield from flush()


def _gains(languages: list[str], counts: np.ndarray):
    """Gain of each training row under its language's counts less its own."""
    at = {x: i for i, x in enumerate(languages)}

    def run(batches):
        for batch in batches:
            out = []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                cells = trigram_cells(text or "")
                if len(cells) and lang in at:
                    some, own = np.unique(cells, return_counts=True)
                    out.append((lang, float((own * np.log(counts[at[lang], some] - own + SMOOTHING)).sum() / len(cells) - np.log(SMOOTHING))))
            cols = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64())], names=["lang", "gain"])

    return run


def code(declared: Column) -> Column:
    """`en-US` and `EN_us` become `en`; empty ones null."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(F.trim(declared.cast("string")), F.lit("")), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([a-z]{2})$", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.when(host.isNotNull(), F.substring_index(host, ".", -2))


def declared_in(html: Column) -> Column:
    return code(F.regexp_extract(F.coalesce(html.cast("string"), F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1))


def text_of(html: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


class Model:
    """Languages in order of code point, log-probabilities of cells and of one never seen, and the least gain of a text of TEMPER trigrams."""

    def __init__(self, languages: list[str], logs: np.ndarray, unseen: np.ndarray, least: np.ndarray):
        self.languages, self.logs, self.unseen, self.least = languages, logs, unseen, least

    def likelihood(self):
        """Tempered log-likelihoods by language, then by language how far the text's gain is above its floor."""
        logs, least = self.logs, self.least
        unseen = self.unseen

        @F.pandas_udf("array<double>")
        def of(text: pd.Series) -> pd.Series:
            out = []
            for t in text:
                cells = trigram_cells(t) if t else ()
                if len(cells):
                    mean = logs[:, cells].mean(axis=1) if len(cells) <= CELLS else logs @ np.bincount(cells, minlength=CELLS) / len(cells)
                    n = min(len(cells), TEMPER)
                    out.append((mean * n).tolist() + (mean - unseen - least * max(0.0, n - FEW) / (TEMPER - FEW) + 1e-9).tolist())
                else:
                    out.append(None)
            give_back()
            return pd.Series(out, dtype=object)

        return of


def sample_of(pool: DataFrame, rows: int) -> DataFrame:
    """h, text, lang: of each language the rows whose hashes are least, equal ones once. pool: text, lang, h.

    A language's hashes are spread evenly, so a cut at a little more than the wanted share leaves few to rank in one task.
    """
    hashes = materialize(pool.select("lang", "h").distinct(), "declared")
    wanted = F.lit(rows + 10 * rows**0.5 + 50) / F.col("n")
    cuts = hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", F.when(wanted < 1, (wanted * 2.0**64 - 2.0**63).cast("long")).otherwise(F.lit(2**63 - 1)).alias("cut"))
    near = hashes.join(F.broadcast(cuts), "lang").filter("h <= cut")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("rank") <= rows)
    edges = materialize(ranked.groupBy("lang").agg(F.max("h").alias("edge")), "edges")
    chosen = pool.join(F.broadcast(edges), "lang").filter("h <= edge")
    out = materialize(chosen.groupBy("lang", "h").agg(F.first("text").alias("text")), "sample")
    discard(hashes)
    return out


def fit(evidence: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on a sample of each declared language, of the rows whose hashes are least. evidence: text, declared."""
    pool = evidence.filter("declared is not null and text is not null").select("text", F.col("declared").alias("lang"), F.xxhash64("text", "declared").alias("h"))
    sample = sample_of(pool, rows)
    found = materialize(sample.mapInArrow(trimmed(_train), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")), "trigrams").toArrow()
    languages = sorted(found.column("lang").unique().to_pylist())
    if not languages:
        return Model([], np.zeros((0, CELLS)), np.zeros(0), np.zeros(0))
    counts = np.zeros((len(languages), CELLS))
    at = pc.index_in(found.column("lang"), pa.array(languages, pa.string())).to_numpy()
    counts[at, found.column("cell").to_numpy()] = found.column("n").to_numpy()
    gains = sample.mapInArrow(trimmed(_gains(languages, counts)), "lang string, gain double").groupBy("lang").agg(F.expr("percentile(gain, 0.5)").alias("usual"))
    usual = {r["lang"]: r["usual"] for r in gains.collect()}
    once = np.log((1 + SMOOTHING) / SMOOTHING)
    least = np.array([max(LEAST_GAIN * usual.get(x, 0.0), LEAST_SEEN * once) for x in languages])
    counts += SMOOTHING
    total = counts.sum(axis=1, keepdims=True)
    return Model(languages, np.log(counts / total), np.log(SMOOTHING / total[:, 0]), least)


def _softmax(logs: Column) -> Column:
    up = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(up, lambda x: x / F.aggregate(up, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias("sums"))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _smoothed(sums: Column, parent: Column, weight: float) -> Column:
    return F.zip_with(sums, parent, lambda s, p: (s + weight * p) / (_total(sums) + weight))


def host_priors(scored: DataFrame, model: Model) -> tuple[DataFrame, list[float]]:
    """host, prior by host; and the corpus's prior. scored: host, p (posterior of text alone)."""
    n = len(model.languages)
    hosts = materialize(_sums(scored, ["host"], n), "hosts")
    total = hosts.agg(*[F.sum(F.col("sums")[i]) for i in range(n)]).first()
    whole = [(x or 0.0) + 1.0 for x in total]
    whole = [x / sum(whole) for x in whole]
    named = hosts.filter("host is not null").withColumn("domain", domain_of(F.col("host")))
    domains = named.groupBy("domain").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(n)]).alias("d"))
    domains = domains.withColumn("d", _smoothed(F.col("d"), F.array(*map(F.lit, whole)), DOMAIN_WEIGHT))
    return materialize(named.join(domains, "domain").select("host", _smoothed(F.col("sums"), F.col("d"), HOST_WEIGHT).alias("prior")), "priors"), whole


def identify(docs: DataFrame, text: Column | None = None, declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, train_rows: int = TRAIN_ROWS, carry: list[str] | None = None) -> DataFrame:
    """docs as struct `row` (of the columns in `carry`; all by default), with language, posterior, kept. By default text, lang and source are the evidence.

    Pages: identify(pages, text_of(html), declared_in(html), host_of(url), suffix_of(host_of(url))).
    Texts are judged once: rows are written with their likelihoods, and priors and posteriors come from there.
    """
    prepare(docs.sparkSession)
    text = (F.col("text") if text is None else text).cast("string")
    declared = code(F.col("lang") if declared is None else declared)
    host = (F.col("source") if host is None else host).cast("string")
    suffix = F.lit(None).cast("string") if suffix is None else suffix
    base = docs.select(F.struct(*(docs.columns if carry is None else carry)).alias("row"), text.alias("text"), declared.alias("declared"), host.alias("host"), suffix.alias("suffix"))
    model = fit(base.select("text", "declared"), train_rows)
    n = len(model.languages)
    if not n:
        nothing = F.lit(None)
        return base.select("row", nothing.cast("string").alias("language"), nothing.cast("double").alias("posterior"), F.lit(False).alias("kept"))
    both = base.withColumn("both", model.likelihood()("text")).drop("text")
    judged = materialize(both.withColumn("ll", F.slice("both", 1, n)).withColumn("above", F.slice("both", n + 1, n)).drop("both"), "judged")

    def first_of(p: Column) -> Column:
        return F.array_position(p, F.array_max(p)).cast("int")

    alone = judged.filter("ll is not null").select("host", "above", _softmax(F.col("ll")).alias("p"))
    priors, whole = host_priors(alone.filter(F.element_at("above", first_of(F.col("p"))) >= 0).select("host", "p"), model)
    prior = priors.select(F.col("host").alias("p_host"), "prior")
    small = priors.count() <= BROADCAST_HOSTS
    rows = judged.join(F.broadcast(prior) if small else prior, F.col("host") == F.col("p_host"), "left")

    def points_to(language: Column, right: float) -> Column:
        """Log-probability of this evidence under each language; 0 where it names none of them."""
        wrong = (1 - right) / max(1, n - 1)
        place = F.coalesce(F.array_position(F.array(*map(F.lit, model.languages)), language), F.lit(0))
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(place == 0, 0.0).when(place == i, float(np.log(right))).otherwise(float(np.log(max(wrong, 1e-9)))))

    country = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.coalesce("suffix", F.lit("")))
    rows = rows.select(
        "row",
        "ll",
        "above",
        points_to(F.col("declared"), DECLARED_RIGHT).alias("of_markup"),
        points_to(country, SUFFIX_RIGHT).alias("of_suffix"),
        F.transform(F.coalesce("prior", F.array(*map(F.lit, whole))), lambda p: F.log(p)).alias("of_host"),
    )
    added = F.col("ll")
    for x in ("of_markup", "of_suffix", "of_host"):
        added = F.zip_with(added, F.col(x), lambda a, b: a + b)
    rows = rows.select("row", "above", F.when(F.col("ll").isNotNull(), added).alias("logs"))
    rows = rows.select("row", "above", _softmax(F.col("logs")).alias("p"))
    rows = rows.withColumn("best", first_of(F.col("p"))).withColumn("p", F.when(F.element_at("above", F.col("best")) >= 0, F.col("p")))
    rows = rows.select("row", F.when(F.col("p").isNotNull(), F.element_at(F.array(*map(F.lit, model.languages)), F.col("best"))).alias("language"), F.array_max("p").alias("posterior"))
    return rows.withColumn("kept", F.coalesce(F.col("posterior") >= LEAST_POSTERIOR, F.lit(False)))


def identify_pages(pages: DataFrame, **options) -> DataFrame:
    """identify() of web pages (url, html): the markup's language, the address's suffix and the host are the evidence beside the text."""
    host = host_of(F.col("url"))
    return identify(pages, text_of(F.col("html")), declared_in(F.col("html")), host, suffix_of(host), **options)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document; its `lang` stands for the declared language and its `source` for the host. Posteriors are given to six digits."""
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id", "lang", "source"])
    return found.select("row.doc_id", "row.lang", "row.source", "language", F.round("posterior", 6).alias("posterior"), "kept")


#: The whole model and its fusion over documents, byte trigrams included. No row is left out of the sample here, so it holds while each language has TRAIN_ROWS rows at most.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, lang, source, nullif(lower(regexp_extract(trim(coalesce(lang, '')), '^([A-Za-z]{{2,3}})(?:[-_].*)?$', 1)), '') AS declared FROM documents),
x AS (SELECT rid, hex(encode(lower(text))) AS h FROM d WHERE text IS NOT NULL),
b AS (SELECT rid, i, CAST('0x' || substr(h, 2 * i + 1, 2) AS INT) AS b FROM (SELECT rid, h, unnest(range(length(h) // 2)) AS i FROM x)),
k AS (SELECT rid, i, b BETWEEN 97 AND 122 OR b >= 128 AS letter, CASE WHEN b BETWEEN 97 AND 122 OR b >= 128 THEN b ELSE 32 END AS c FROM b),
j AS (SELECT rid, i, c FROM (SELECT *, lag(letter, 1, false) OVER (PARTITION BY rid ORDER BY i) AS before FROM k) WHERE letter OR before),
s AS (SELECT rid, i, c FROM j UNION ALL SELECT rid, -1, 32 FROM j GROUP BY rid UNION ALL SELECT rid, max(i) + 1, 32 FROM j GROUP BY rid),
t AS (SELECT rid, c AS c0, lead(c) OVER o AS c1, lead(c, 2) OVER o AS c2 FROM s WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, CAST(CAST(c0 * 65536 + c1 * 256 + c2 AS HUGEINT) * 11400714819323198485 % 18446744073709551616 // 562949953421312 AS INT) AS cell, count(*) AS n FROM t WHERE c2 IS NOT NULL GROUP BY ALL),
m AS (SELECT rid, sum(n)::DOUBLE AS len FROM g GROUP BY rid),
f AS (SELECT min(rid) AS rid, declared AS language FROM d WHERE text IS NOT NULL AND declared IS NOT NULL GROUP BY text, declared),
c AS (SELECT language, cell, sum(n)::DOUBLE AS n FROM f JOIN g USING (rid) GROUP BY ALL),
a AS (SELECT f.rid, f.language, sum(g.n * ln(c.n - g.n + {SMOOTHING})) / any_value(len) - ln({SMOOTHING}) AS gain FROM f JOIN g USING (rid) JOIN m USING (rid) JOIN c ON c.language = f.language AND c.cell = g.cell GROUP BY f.rid, f.language),
y AS (SELECT language, sum(n) + {SMOOTHING} * {CELLS} AS total, greatest({LEAST_GAIN} * any_value(usual), {LEAST_SEEN} * ln((1 + {SMOOTHING}) / {SMOOTHING})) AS floor, count(*) OVER () AS many
  FROM c JOIN (SELECT language, median(gain) AS usual FROM a GROUP BY language) USING (language) GROUP BY language),
v AS (SELECT g.rid, c.language, sum(g.n * ln(c.n + {SMOOTHING})) AS s, sum(g.n) AS seen FROM g JOIN c USING (cell) GROUP BY ALL),
u AS (SELECT m.rid, y.language, least(len, {TEMPER}) AS n, floor, total, (coalesce(s, 0) + (len - coalesce(seen, 0)) * ln({SMOOTHING})) / len - ln(total) AS mean FROM m CROSS JOIN y LEFT JOIN v ON v.rid = m.rid AND v.language = y.language),
l AS (SELECT rid, language, mean * n AS ll, mean - ln({SMOOTHING} / total) - floor * greatest(0, n - {FEW}) / ({TEMPER} - {FEW}) + 1e-9 AS above FROM u),
p AS (SELECT rid, language, ll, above, exp(ll - max(ll) OVER w) AS e FROM l WINDOW w AS (PARTITION BY rid)),
o AS (SELECT *, e / sum(e) OVER (PARTITION BY rid) AS p, first_value(above) OVER (PARTITION BY rid ORDER BY e DESC, language) AS best FROM p),
h AS (SELECT source AS host, language, sum(p) AS s FROM o JOIN d USING (rid) WHERE best >= 0 GROUP BY ALL),
w AS (SELECT language, whole / sum(whole) OVER () AS whole FROM (SELECT language, coalesce(sum(s), 0) + 1.0 AS whole FROM y LEFT JOIN h USING (language) GROUP BY language)),
n AS (SELECT host, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, language, s FROM h WHERE host IS NOT NULL),
z AS (SELECT domain, language, (sum(s) + {DOMAIN_WEIGHT} * any_value(whole)) / (sum(sum(s)) OVER (PARTITION BY domain) + {DOMAIN_WEIGHT}) AS up FROM n JOIN w USING (language) GROUP BY domain, language),
r AS (SELECT host, n.language, (s + {HOST_WEIGHT} * up) / (sum(s) OVER (PARTITION BY host) + {HOST_WEIGHT}) AS prior FROM n JOIN z USING (domain, language)),
q AS (SELECT rid, o.language, above, ll + ln(coalesce(prior, whole)) + CASE WHEN declared NOT IN (SELECT language FROM y) OR declared IS NULL THEN 0
  WHEN declared = o.language THEN ln({DECLARED_RIGHT}) ELSE ln(greatest((1 - {DECLARED_RIGHT}) / greatest(1, many - 1), 1e-9)) END AS fused
  FROM o JOIN d USING (rid) JOIN w ON w.language = o.language JOIN y ON y.language = o.language LEFT JOIN r ON r.host = d.source AND r.language = o.language),
i AS (SELECT rid, language, above, exp(fused - max(fused) OVER (PARTITION BY rid)) AS e FROM q),
e AS (SELECT rid, arg_max(language, e) FILTER (e = 1) AS language, 1 / sum(e) AS posterior, min(CASE WHEN e = 1 THEN above END) AS above FROM i GROUP BY rid)
SELECT doc_id, lang, source, CASE WHEN above >= 0 THEN language END AS language, CASE WHEN above >= 0 THEN round(posterior, 6) END AS posterior, coalesce(above >= 0 AND posterior >= {LEAST_POSTERIOR}, false) AS kept FROM d LEFT JOIN e USING (rid)
"""
