"""Near-duplicate classes by BagMinHash signatures, banding and exact verification.

A text is the multiset of its shingles (five consecutive words; the whole text if it is shorter). Every block (2**(k-1), 2**k]
of a shingle's weight runs a Poisson process of its own, seeded by the shingle and the block, whose points carry a
signature component. After its first point a process splits into one for each half of its interval: the point belongs to one of them, the
other starts afresh at that time; halves beyond the text's weight are dropped, and units of weight run on by themselves. A component
keeps its earliest point in the intervals that the text has whole, so two texts agree in it with probability equal to their weighted Jaccard similarity;
processes stop once they are later than every component, so a great weight costs little more than a small one.

Equal texts are one node. Nodes that agree in a band meet in a bucket. A bucket's first pivot is compared with all its
members; it is the hub, the member whose buckets are largest in all. Where a bucket then still holds several classes, its strays, the members outside its largest class, become pivots
in growing batches, drawn by hash, until each was one: any pair of different classes has a stray, so no link is lost.
Pivots of a bucket meet its members in groups, CHUNK of the ones with MEET of the others, so no task holds a bucket. Two bounds spare pairs
that can't be similar: a shingle that no other text in open buckets has is in no overlap, and the rest of either text bounds it. Pairs whose signatures agree too little to be similar
(SURE standard deviations below the threshold) are dropped; the rest are verified on the whole multisets.

Defined results: null and empty texts are one class (they are equal); repeated rows share a class; rows without a doc_id get
their class but never name one while the class has another id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm.common import Rolling, collecting, discard, materialize, mixed, note, pieces, prepare, text_key, trimmed, word_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 5, 30
SIZE = ROWS * BANDS
SURE = 5.0
STEP_WORDS = 300_000
#: Nodes up to this many are broadcast by id (16 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 500_000
#: Shared bands up to this many are broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_BANDS = 500_000
#: Pivots of a bucket in the second round, about, and how much more there are in each later one.
FIRST_BATCH, GROWTH = 1024, 16
#: Pivots that meet one group of members, about: what a task holds at once.
CHUNK = 1024
#: Components of the finer signature that nodes of open buckets get, and members that meet pivots in one group, about.
FINE, MEET = 1024, 800
#: Members that one verifying group of a pivot holds at most, about.
GROUP = 500
_ROLL = Rolling(0x9E3779B97F4A7C15)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of k words; of the whole text if it is shorter."""
    if not len(hashes):
        return hashes
    return mixed(_ROLL.runs(_ROLL.prefix(hashes), None, min(k, len(hashes))) + np.uint64(min(k, len(hashes))))


def signatures(owner: np.ndarray, items: np.ndarray, weights: np.ndarray, docs: int, size: int = SIZE) -> np.ndarray:
    """docs x size signature of weighted sets laid end to end: item and weight (whole, at least 1) of each owner."""
    seed, doc, width, limit = [], [], [], []
    block, low, high = 0, 0, 1
    while True:
        has = weights > low
        if not has.any():
            break
        seed.append(mixed(items[has] + np.uint64(block * int(_GOLD) & 0xFFFFFFFFFFFFFFFF)))
        doc.append(owner[has])
        width.append(np.full(int(has.sum()), high - low, np.int64))
        limit.append(np.minimum(weights[has] - low, high - low))
        block, low, high = block + 1, high, 2 * high
    out = np.full(docs * size, np.inf)
    if not seed:
        return out.reshape(docs, size)
    seed, doc, width, limit = map(np.concatenate, (seed, doc, width, limit))
    latest = np.full(docs, np.inf)

    def point(seeds, steps):
        """Waiting time of a process of rate 1 in each component, and the point's own hash."""
        bits = mixed(seeds + steps * _GOLD)
        return -np.log1p(-(bits >> np.uint64(11)).astype(np.float64) * 2.0**-53) / size, mixed(bits ^ _GOLD)

    def component(points):
        return ((points >> np.uint64(32)) % np.uint64(size)).astype(np.int64)

    wide = width > 1
    # Processes to split, each with the time and hash of its first point; those of one unit of weight, with their times and points so far.
    first, mark = point(seed[wide], np.uint64(1))
    split = [seed[wide], doc[wide], width[wide], limit[wide], first / width[wide], mark]
    seed, doc = seed[~wide], doc[~wide]
    time, step = np.zeros(len(seed)), np.zeros(len(seed), np.uint64)
    while len(seed) or len(split[0]):
        if len(split[0]):
            s, d, w, m, t, h = split
            whole = (m == w) & (t < latest[d])
            np.minimum.at(out, d[whole] * size + component(h[whole]), t[whole])
            s, d, w, m, t, h = (x[t < latest[d]] for x in split)
            half, upper = w >> 1, (mixed(h + w.astype(np.uint64)) >> np.uint64(63)).astype(bool)
            kids = []
            for place, own in ((0, np.minimum(m, half)), (1, m - half)):
                has = own > 0
                child, holds = mixed(s[has] + np.uint64((place + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF)), (upper == place)[has]
                wait, fresh = point(child, np.uint64(1))
                # A unit's next points come from its own steps, whether it holds this one or not.
                later = np.where(holds | (half[has] == 1), t[has], t[has] + wait / half[has])
                kids.append((child, d[has], half[has], own[has], later, np.where(holds, h[has], fresh), holds))
            s, d, w, m, t, h, holds = (np.concatenate(x) for x in zip(*kids))
            unit = w == 1
            # The point that a unit holds counts here, since its parent may not have been whole.
            np.minimum.at(out, d[unit & holds] * size + component(h[unit & holds]), t[unit & holds])
            seed, doc, time = np.concatenate((seed, s[unit])), np.concatenate((doc, d[unit])), np.concatenate((time, t[unit]))
            step = np.concatenate((step, np.zeros(int(unit.sum()), np.uint64)))
            split = [x[~unit] for x in (s, d, w, m, t, h)]
        if len(seed):
            k = int(max(1, min(64, 20_000 // len(seed))))
            steps = step[:, None] + np.arange(1, k + 1, dtype=np.uint64)
            wait, marks = point(seed[:, None], steps)
            wait[:, 0] += time
            # cumsum adds in order, so a point's time doesn't depend on how many points are made at once.
            times = np.cumsum(wait, axis=1)
            use = times < latest[doc][:, None]
            np.minimum.at(out, (doc[:, None] * size + component(marks))[use], times[use])
            time, step = times[:, -1], step + np.uint64(k)
        latest = out.reshape(docs, size).max(axis=1)
        go = time < latest[doc]
        seed, doc, time, step = seed[go], doc[go], time[go], step[go]
    return out.reshape(docs, size)


def bags(hashed: list[np.ndarray], k: int = SHINGLE):
    """(owner, shingle, weight) of documents given by their word hashes, and shingles in each."""
    parts = [shingles(h, k) for h in hashed]
    counts = np.array([len(p) for p in parts], np.int64)
    owner = np.repeat(np.arange(len(parts)), counts)
    items = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    key = mixed(items + mixed(owner.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    where = np.flatnonzero(first)
    weights = np.diff(np.concatenate((where, [len(order)])))
    pick = order[where]
    return owner[pick], items[pick], weights, counts


def _sign(batches):
    for batch in batches:
        rows = [(i, words_of(t.as_py())) for i, t in enumerate(batch.column("text"))]
        for part in pieces(rows, lambda r: len(r[1]) + 100, STEP_WORDS):
            owner, items, weights, counts = bags([word_hashes(w) for _, w in part])
            points = mixed(signatures(owner, items, weights, len(part)).view(np.uint64))
            band = np.zeros((len(part), BANDS), np.uint64)
            for r in range(ROWS):
                band = mixed(band * _GOLD + points[:, r::ROWS])
            band = mixed(band + np.arange(BANDS, dtype=np.uint64))
            small = (points & np.uint64(0xFFFF)).astype(np.uint16)
            pick = pa.array([i for i, _ in part], pa.int64())
            flat = pa.array(band.reshape(-1).view(np.int64))
            at = pa.array(np.concatenate(([0], np.cumsum(np.where(counts > 0, BANDS, 0)))), pa.int32())
            if (counts == 0).any():
                flat = pa.array(band[counts > 0].reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pick), batch.column("node").take(pick), pa.array(counts), pa.ListArray.from_arrays(at, flat), pa.array([x.tobytes() for x in small], pa.binary())],
                names=["doc_id", "node", "n", "bands", "sketch"],
            )


def _agree(least: float):
    """Pairs of which at least this share of signature components agrees."""

    def run(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint16) for x in batch.column(c).to_pylist()] for c in ("sketch_a", "sketch_b"))
            if a:
                yield batch.select(["a", "b"]).filter(pa.array((np.stack(a) == np.stack(b)).mean(axis=1) >= least))

    return run


def _fine(batches):
    """Signatures of FINE components, a byte each."""
    for batch in batches:
        rows = [(n, words_of(t.as_py())) for n, t in zip(batch.column("node").to_pylist(), batch.column("text"))]
        for part in pieces(rows, lambda r: len(r[1]) + 500, STEP_WORDS // 4):
            owner, items, weights, _ = bags([word_hashes(w) for _, w in part])
            points = mixed(signatures(owner, items, weights, len(part), FINE).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.binary()), pa.array([x.tobytes() for x in (points & np.uint64(255)).astype(np.uint8)], pa.binary())], names=["node", "fine"])


def _meet(threshold: float, sure: float = SURE):
    """Pairs of a pivot and a member of another class that may be similar, once each: in the least band that they share.

    Rows come by band and salt, pivots first. Pairs stay in memory, as products of a few members with the pivots.
    """
    least = max(0.0, threshold - sure * (threshold * (1 - threshold) / FINE) ** 0.5)
    least = least + (1 - least) / 256  # by chance a byte agrees

    def run(batches):
        key, pivots = None, []
        for batch in batches:
            out, rows = [], list(zip(*(batch.column(c).to_pylist() for c in ("band", "salt", "kind", "node", "label", "n", "shared", "bands", "fine"))))
            held = []

            def compare():
                if held and pivots:
                    side = lambda rs, i: np.array([r[i] for r in rs])
                    fine = lambda rs: np.frombuffer(b"".join(r[8] for r in rs), np.uint8).reshape(len(rs), FINE)
                    agree = np.stack([(fine(pivots) == m).mean(axis=1) for m in fine(held)])
                    total = side(held, 5)[:, None] + side(pivots, 5)[None]
                    most = np.minimum(side(held, 6)[:, None], side(pivots, 6)[None])
                    for i, j in np.argwhere((agree >= least) & (most * (1 + threshold) >= threshold * total - 1e-9 * total)):
                        m, p = held[i], pivots[j]
                        if m[4] != p[4] and min(set(m[7]).intersection(p[7])) == m[0]:
                            out.append((min(m[3], p[3]), max(m[3], p[3])))
                held.clear()

            for r in rows:
                if r[:2] != key:
                    compare()
                    key, pivots = r[:2], []
                (pivots if r[2] == 0 else held).append(r)
                if len(held) >= 200:
                    compare()
            compare()
            cols = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["a", "b"])

    return run


def _bag(text: str):
    values, counts = np.unique(shingles(word_hashes(words_of(text))), return_counts=True)
    return values, counts, int(counts.sum())


def overlap(x, y) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(x[1][i], y[1][j]).sum())
    return both / max(1, x[2] + y[2] - both)


def _verify(threshold: float):
    def run(batches):
        pivot, bag = None, None
        for batch in batches:
            out = []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text")):
                if b is None:  # the pivot's own row comes first
                    pivot, bag = a, _bag(text.as_py())
                elif a != pivot:
                    raise ValueError("a pair without its pivot")
                elif overlap(bag, _bag(text.as_py())) >= threshold:
                    out.append((a, b))
            cols = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component, by alternating large and small stars; written."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("e"))
        ends = ends.groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.count(F.lit(1)).alias("n"))
        # Done once every node either has one edge, up to its label, or only edges from below.
        if ends.filter("ups > 1 or ups = 1 and n > 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        old, edges = edges, materialize(small, "edges")
        discard(old)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """components() of what labels already joins and further links."""
    return labels if links.isEmpty() else components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose whole multisets overlap enough. A pivot's members are dealt to groups, each with the pivot's
    text, so a pivot with many members doesn't land in one task."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    members = members.join(texts, members.b == texts.node).select("a", "salt", "b", "text")
    heads = salts.join(texts, salts.a == texts.node).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("b"), "text")
    spread = members.union(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return spread.select("a", "b", "text").mapInArrow(trimmed(_verify(threshold)), "a binary, b binary")


def _shingle_rows(batches):
    for batch in batches:
        for node, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            values, counts, _ = _bag(text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), node, np.int64)), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int32))], names=["id", "shingle", "times"])


def unshared(texts: DataFrame) -> DataFrame:
    """id (hash of the node), own: how many of its shingles no other of these texts has. They are in no overlap with any of them."""
    rows = texts.select(F.xxhash64("node").alias("id"), "text").mapInArrow(trimmed(_shingle_rows), "id long, shingle long, times int")
    single = rows.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("other"), F.sum("times").alias("times")).filter("id = other")
    return single.groupBy("id").agg(F.sum("times").alias("own"))


def labelled_rows(docs: DataFrame, threshold: float = THRESHOLD, sure: float = SURE) -> DataFrame:
    """doc_id, node (text digest), label (node of the class): one row per row of docs.

    sure: a pair that shares a band is verified unless its signatures agree this many standard deviations too little; infinity verifies all.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = rows.withColumn("node", text_key(F.col("text"))).mapInArrow(trimmed(_sign), f"doc_id {id_type}, node binary, n long, bands array<long>, sketch binary")
    signed = materialize(signed, "signed")
    # Bands that one row alone has are dropped before any digest moves; copies of a text collapse with the rest.
    cells = signed.select("node", F.explode("bands").alias("band"))
    crowded = materialize(cells.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "crowded")
    cells = materialize(cells.join(F.broadcast(crowded) if crowded.count() <= BROADCAST_BANDS else crowded, "band").distinct(), "met")
    mixed_bands = cells.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high").select("band")
    met = materialize(cells.join(mixed_bands, "band"), "met")
    # A text that others were made from shares large buckets in every band: such hubs are the first pivots.
    score = materialize(met.groupBy("node").agg(F.sum("size").alias("score")), "score")
    members = materialize(met.select("band", "node").join(score, "node"), "members")
    discard(crowded, cells, met)
    hubs = materialize(members.groupBy("band").agg(F.max(F.struct("score", "node")).alias("hub")), "hubs")
    ids = score.select("node")
    few = ids.count() <= BROADCAST_IDS
    texts = rows.withColumn("node", text_key(F.col("text"))).join(F.broadcast(ids) if few else ids, "node", "left_semi")
    texts = materialize(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
    nodes = signed.select("node", "n", "bands", "sketch").join(F.broadcast(ids) if few else ids, "node", "left_semi").groupBy("node")
    nodes = materialize(nodes.agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    sketches = nodes.select("node", "n", "sketch")
    # Agreement of a pair at the threshold is binomial; this many deviations below it none is missed in practice.
    least = threshold - sure * (threshold * (1 - threshold) / SIZE) ** 0.5
    a, b = (sketches.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    stars = members.select("band", "node").join(hubs, "band").filter(F.col("node") != F.col("hub.node")).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    near = stars.join(b, "b").join(a, "a").filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    near = materialize(near.select("a", "b", "sketch_a", "sketch_b").mapInArrow(trimmed(_agree(least)), "a binary, b binary"), "near")
    labels = components(_verified(near, texts, threshold))
    state = members.select("band", "node").join(hubs, "band").select("band", "node", (F.col("node") == F.col("hub.node")).alias("done"))
    batch, facts, used = FIRST_BATCH, None, [members, hubs, score, near]
    while True:
        labelled = materialize(state.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        parts = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
        open_ = parts.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("size")).filter("labels > 1").drop("labels")
        open_ = materialize(open_, "open")
        state = materialize(labelled.join(open_, "band"), "state")
        discard(labelled, open_, *used)
        used = [state]
        if state.isEmpty():
            break
        if facts is None:
            left = materialize(state.select("node").distinct(), "left")
            some = texts.join(left, "node", "left_semi")
            facts = some.mapInArrow(trimmed(_fine), "node binary, fine binary").withColumn("id", F.xxhash64("node")).join(unshared(some), "id", "left").join(nodes.select("node", "n", "bands"), "node")
            facts = facts.select("node", "n", "bands", "fine", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))
            # No text overlaps with more of another than it shares with any.
            facts = materialize(facts.filter(F.col("shared") >= threshold * F.col("n")), "facts")
            discard(left, nodes)
        strays = state.join(facts.select("node"), "node", "left_semi").filter("label != main and not done")
        # About `batch` pivots of every bucket's members, by hash; all strays once the bucket has no more members than that.
        share = F.least(F.lit(1.0), F.lit(float(batch)) / F.col("size"))
        drawn = F.when(share < 1, F.xxhash64("node", F.lit(17)) < (share * 2.0**64 - 2.0**63).cast("long")).otherwise(True)
        pivots = materialize(strays.select("band", "node", "label", "size", drawn.alias("drawn")), "pivots")
        used.append(pivots)
        if pivots.isEmpty():
            break
        pivots = pivots.filter("drawn")
        # Every group of a bucket's members meets each chunk of its pivots of this round; a member that was a pivot before needn't.
        groups, chunks = F.ceil(F.col("size") / MEET).cast("int"), F.ceil(F.least(F.lit(batch), F.col("size")) / CHUNK).cast("int")
        asked = pivots.select("band", "node", "label", F.lit(0).alias("kind"), F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("salt"))
        others = state.filter("not done").join(pivots.select("band").distinct(), "band", "left_semi")
        others = others.select("band", "node", "label", F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.pmod(F.xxhash64("node"), groups).cast("int").alias("salt"))
        met = asked.union(others).withColumn("salt", F.col("salt").cast("long") * (1 << 31) + F.col("chunk")).join(facts, "node").repartition("band", "salt").sortWithinPartitions("band", "salt", "kind")
        near = materialize(met.select("band", "salt", "kind", "node", "label", "n", "shared", "bands", "fine").mapInArrow(trimmed(_meet(threshold, sure)), "a binary, b binary").distinct(), "near")
        used.append(near)
        if not near.isEmpty():
            links = materialize(_verified(near, texts, threshold), "links")
            labels = merged(labels, links)
            discard(links)
        was = pivots.select("band", "node", F.lit(True).alias("now"))
        state = state.select("band", "node", "done").join(was, ["band", "node"], "left").select("band", "node", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        batch *= GROWTH
    discard(*([facts] if facts else [nodes]), texts, *used)
    return signed.select("doc_id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, sure: float = SURE) -> DataFrame:
    """labelled_rows() and class_id, the least doc_id of the class."""
    out = labelled_rows(docs, threshold, sure)
    least_id = materialize(out.groupBy("label").agg(F.min("doc_id").alias("class_id")), "class-ids")
    return out.join(least_id, "label").select("doc_id", "node", "label", "class_id")


def keepers(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, all columns: of the least doc_id, and of its copies the one of least hash.

    Kept texts are found by their digests; the rest of a row takes no part in the shuffles.
    """
    with collecting(docs.sparkSession) as paths:
        kind = labelled_rows(docs, threshold)
        chosen = kind.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"))
        chosen = materialize(chosen.select(F.col("best.doc_id").alias("__id"), F.col("best.node").alias("__node")), "keepers")
        paths.remove(chosen.parcelflow_path)
    note(chosen.parcelflow_path)
    marked = docs.withColumn("__text_node", text_key(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    kept = marked.join(side, (F.col("__text_node") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    # Rows repeated whole, or with one id and one text, leave one.
    again = kept.groupBy("doc_id", "__text_node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if again.isEmpty():
        return kept.select(docs.columns)
    single = kept.withColumn("__row", F.struct(*docs.columns)).groupBy("doc_id", "__text_node").agg(F.min("__row").alias("__row"))
    return single.select("__row.*")


def op2_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")


#: All pairs that share a shingle, by brute force; a class is what its links reach.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d),
t AS (SELECT doc_id, sh, count(*) AS c FROM s GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM t GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS shared FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE shared * 1.0::DOUBLE / (p.n + q.n - shared) >= 0.8
  UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.text = b.text AND a.doc_id <> b.doc_id),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x)
SELECT doc_id, min(reached) AS class_id FROM r GROUP BY doc_id
"""
