"""Near-duplicate documents by SetSketch: exponentially spaced, truncated minima of the hashed word shingles.

Each document's set of distinct word shingles (64-bit hashes) gives ``m`` registers. Register i holds
floor(1 - log_b(h)), cut to 0..q+1, of the smallest exponential variate that hash function i gives any element, so
registers of a union are the larger of each pair (mergeable), and two registers agree about as often as the sets'
Jaccard similarity (locality-sensitive). Documents meet where all registers of a band agree; the number of bands
makes missing a pair at the threshold less likely than ``miss``. A pair that met is judged by the likelihood of its
similarity given how many registers are larger, smaller and equal and both set sizes; what is not clearly below
the threshold is confirmed on the full sets.

Documents with equal sets are one node from the start (a 64-bit hash of the sorted set; at 1e9 different sets two
share a hash with a chance of 3%). Within a bucket no pairs are made: members are compared with a hub, the one that
meets most others over all buckets; then only members outside the bucket's largest component take turns as hubs (64, then
sixteen times as many each round), block against block, until all others were hubs or joined it. So every pair of a bucket is
either linked through others or was compared. Crowded buckets are dealt into salts before any join or window; what is
chosen for a bucket is copied to its salts.

Defined results: null text, or one without words, has an empty set and is linked with nothing (component: itself);
fewer words than a shingle are one shingle; repeated rows are linked; columns other than doc_id and text are ignored
by ``near_duplicates`` and kept by ``without_near_duplicates``; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import attach, filtered, groups, lean, slices, staged, unstage
from millrace.llm.graph import components

BASE, RATE, TOP = 1.001, 20.0, 65534
ROWS = 5
MISS = 1e-7
SLACK = 5.0
#: Members that are compared with a copy of a hub in one task, on full sets.
HUB_SHARE = 256
#: Hubs and members whose sketches meet in one task.
HUBS, MEMBERS = 128, 512
#: Registers of the fine sketches that are compared there.
FINE = 1024
#: Members of a bucket that may meet in one task, and the most buckets that may be larger than what a task then takes.
CROWDED, MOST_CROWDED = 1024, 500_000
_U = np.uint64


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` registers, so many that a pair at the threshold meets in none with a chance below ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z lower-cased, words between ASCII white space."""
    import xxhash

    texts = texts.take(pa.array(np.arange(len(texts))))  # the ASCII kernels misread slices: an array of its own
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    starts = np.asarray(words.offsets).astype(np.int64)
    coded = words.values.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = hashes[np.asarray(coded.indices)] if len(coded) else np.empty(0, np.uint64)
    empty = np.asarray(pc.equal(pc.binary_length(pc.ascii_trim_whitespace(texts)), 0))
    rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for i in range(width):
        rolled = _mix(rolled + h[i : i + len(rolled)] + _U(0x9E3779B97F4A7C15))
    out = []
    for k, (a, z) in enumerate(zip(starts[:-1], starts[1:])):
        if empty[k]:
            out.append(np.empty(0, np.uint64))
        elif z - a >= width:
            out.append(np.unique(rolled[a : z - width + 1]))
        else:
            one = np.zeros(1, np.uint64)
            for x in h[a:z]:
                one = _mix(one + x + _U(0x9E3779B97F4A7C15))
            out.append(one ^ _U(z - a))
    return out


def _functions(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2021)
    return rng.integers(0, 1 << 64, m, np.uint64) | _U(1), rng.integers(0, 1 << 64, m, np.uint64)


def sketch(elements: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    step = max(32, 65536 // len(a))
    for i in range(0, len(elements), step):
        np.minimum(least, ((elements[i : i + step, None] ^ b) * a).min(axis=0), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, TOP + 1).astype("<u2")


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(one, other)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, points: int = 200) -> np.ndarray:
    """Similarities of greatest likelihood of pairs of sketches (rows of x and y) of sets with known sizes."""
    more, less = (x > y).sum(axis=1), (x < y).sum(axis=1)
    equal = x.shape[1] - more - less
    u, v = nx / (nx + ny), ny / (nx + ny)
    best, at = np.full(len(x), -np.inf), np.zeros(len(x))
    p = lambda z: -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    top = np.minimum(u / v, v / u)
    for s in np.linspace(0, 1, points + 1):
        j = s * top
        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        ll = more * np.log(up) + less * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))
        better = ll > best
        best[better], at[better] = ll[better], j[better]
    return at


def reaches(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, cut: float, near: float) -> np.ndarray:
    """Whether the similarity of greatest likelihood of each pair is ``cut`` or more; y has a row for each of x, or one for all.

    The likelihood has one peak, so its slope at the cut tells on which side the peak lies. Pairs with too few equal
    registers to come within ``near`` of the cut are not looked at further.
    """
    equal = (x == y).sum(axis=1)
    out = equal >= (cut - near) * x.shape[1]
    at = np.flatnonzero(out)
    if not len(at):
        return out
    more = (x[at] > (y if len(y) == 1 else y[at])).sum(axis=1)
    same, less = equal[at], x.shape[1] - more - equal[at]
    u, v = nx[at] / (nx[at] + ny[at]), ny[at] / (nx[at] + ny[at])
    p = lambda z: -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    top = np.minimum(u / v, v / u)

    def likelihood(j):
        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    out[at] = (top >= cut) & (likelihood(np.minimum(cut + 1e-3, top)) >= likelihood(np.minimum(cut, top) - 1e-3))
    return out


def _band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    n, m = sketches.shape
    parts = sketches.reshape(n, m // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) + _U(1), (n, m // rows)).copy()
    for i in range(rows):
        key = _mix(key * _U(0x100000001B3) + parts[:, :, i] + _U(1))
    return key.view(np.int64)


def _sketched(docs: DataFrame, width: int, m: int) -> DataFrame:
    """One row per document: doc_id, _h, node (hash of its set; null if empty), n, sketch."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import xxhash

        a, b = _functions(m)
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch["text"], width)
                nodes = [xxhash.xxh64_intdigest(s.tobytes(), 5) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["_h"], pa.array([None if x is None else x - (1 << 63) for x in nodes], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s, a, b).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "_h", "node", "n", "sketch"],
                )

    return rows.mapInArrow(lean(run), f"doc_id {kind}, _h long, node long, n long, sketch binary")


def _bands(nodes: DataFrame, rows: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.frombuffer(b"".join(batch["sketch"].to_pylist()), "<u2").reshape(batch.num_rows, -1)
            keys = _band_keys(table, rows)
            per = keys.shape[1]
            take = np.repeat(np.arange(batch.num_rows), per)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch["node"].take(pa.array(take)), batch["n"].take(pa.array(take))], names=["band", "node", "n"])

    return nodes.mapInArrow(lean(run), "band long, node long, n long")


def _buckets(bands: DataFrame) -> DataFrame:
    """Rows of bands that several nodes share: band, salt, salts, node, n, central (how many others a node meets in all).

    A bucket of more than ``limit`` members is dealt into salts of at most about that many. All buckets together have ``total``
    members, so at most total / limit, hence MOST_CROWDED, are crowded: that list is what is broadcast.
    """
    sizes = staged(bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "bucket-sizes")
    total = sizes.agg(F.sum("members")).first()[0] or 0
    limit = max(CROWDED, -(-total // MOST_CROWDED))
    crowded = sizes.where(F.col("members") > limit).select("band", F.ceil(F.col("members") / limit).cast("long").alias("salts"))
    dealt = bands.join(F.broadcast(crowded), "band", "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(17)), F.col("salts")))
    met = _salted(sizes.withColumn("salts", F.ceil(F.when(F.col("members") > limit, F.col("members") / limit).otherwise(F.lit(1.0))).cast("long")))
    shared = staged(dealt.join(met.select("band", "salt", "members"), ["band", "salt"]), "met")
    central = shared.groupBy("node").agg(F.sum("members").alias("central"))
    out = staged(shared.drop("members").join(central, "node").select("band", "salt", "salts", "node", "n", "central"), "buckets")
    unstage(shared, sizes)
    return out


def _salted(per_band: DataFrame) -> DataFrame:
    """A row per band (with salts) to one for each salt of it."""
    return per_band.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")


def _cut(threshold: float, slack: float, m: int) -> float:
    """Estimates from here on are confirmed: ``slack`` standard errors below the threshold."""
    return threshold - slack * math.sqrt(threshold * (1 - threshold) / m)


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float, slack: float) -> DataFrame:
    """The pairs (node, hub) whose sketches do not speak clearly against the threshold."""
    one = nodes.select("node", F.col("n").alias("n1"), F.col("sketch").alias("s1"))
    two = nodes.select(F.col("node").alias("hub"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("s1", "s2"))
            cut = _cut(threshold, slack, x.shape[1])
            keep = pa.array(reaches(x, y, np.asarray(batch["n1"], np.float64), np.asarray(batch["n2"], np.float64), cut, threshold - cut))
            yield pa.RecordBatch.from_arrays([batch["node"].filter(keep), batch["hub"].filter(keep)], names=["node", "hub"])

    return pairs.join(two, "hub").join(one, "node").mapInArrow(lean(run), "node long, hub long")


def _fine(texts: DataFrame, width: int) -> DataFrame:
    def run(batches):
        a, b = _functions(FINE)
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch["node"], pa.array([sketch(s, a, b).tobytes() for s in shingle_sets(batch["text"], width)], pa.binary())], names=["node", "fine"])

    return texts.mapInArrow(lean(run), "node long, fine binary")


def _likely_in_blocks(now: DataFrame, chosen: DataFrame, fine: DataFrame, threshold: tuple[int, int], slack: float, rows: int) -> DataFrame:
    """The same for buckets with many hubs: blocks of hubs meet blocks of members in one task each, and only likely pairs of
    different components are written down, once. They are judged by fine sketches, as a group of copies that lie just below the
    threshold has many pairs that coarse ones cannot rule out."""
    hubs = chosen.withColumn("hub_block", F.floor(F.col("place") / HUBS).cast("long"))
    heads = hubs.groupBy("band").agg((F.max("hub_block") + 1).alias("hub_blocks"))
    sizes = now.groupBy("band").agg(F.ceil(F.count("*") / MEMBERS).alias("shares"), F.first("salts").alias("salts")).join(heads, "band")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    members = now.join(_salted(sizes), ["band", "salt"]).select("band", upto("hub_blocks").alias("hub_block"), F.pmod(F.xxhash64("node"), F.col("shares")).alias("share"), F.lit(1).alias("role"), "node", "n", "comp")
    heads = hubs.join(sizes.select("band", "shares"), "band").select("band", "hub_block", upto("shares").alias("share"), F.lit(0).alias("role"), F.col("hub").alias("node"), F.col("hub_n").alias("n"), F.col("hub_comp").alias("comp"))
    order = ["band", "hub_block", "share"]
    laid = members.unionByName(heads).join(fine, "node").repartition(*order).sortWithinPartitions(*order, "role")
    t, (over, under) = threshold[0] / threshold[1], threshold
    cut = _cut(t, slack, FINE)

    def run(batches):
        for group in groups(batches, order):
            role = np.asarray(group["role"])
            ids, n, comp = (np.asarray(group[c]) for c in ("node", "n", "comp"))
            x = np.frombuffer(b"".join(group["fine"].to_pylist()), "<u2").reshape(len(ids), -1)
            keys = _band_keys(np.frombuffer(b"".join(group["sketch"].to_pylist()), "<u2").reshape(len(ids), -1), rows)
            here = group["band"][0].as_py()
            rest = np.flatnonzero(role == 1)
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for h in np.flatnonzero(role == 0):
                fit = rest[(comp[rest] != comp[h]) & (np.minimum(n[rest], n[h]) * under >= np.maximum(n[rest], n[h]) * over)]
                if not len(fit):
                    continue
                ok = fit[reaches(x[fit], x[h][None], n[fit].astype(float), np.full(len(fit), float(n[h])), cut, t - cut)]
                if len(ok):  # a pair that shares several buckets is written down in the first of them
                    ok = ok[keys[h][(keys[ok] == keys[h]).argmax(axis=1)] == here]
                a.append(ids[ok])
                b.append(np.full(len(ok), ids[h]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["node", "hub"])

    return laid.select(*order, "role", "node", "n", "comp", "fine", "sketch").mapInArrow(lean(run), "node long, hub long").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (node, hub) whose full sets reach the threshold (a fraction): every hub's set is built once a share."""
    share = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("members") / HUB_SHARE)))
    sized = pairs.groupBy("hub").agg(F.count("*").alias("members"))
    dealt = pairs.join(sized, "hub").select("node", "hub", share.alias("share"))
    dealt = staged(dealt, "pairs")
    hubs = dealt.select("hub", "share").distinct().select(F.col("hub").alias("node"), "hub", "share", F.lit(0).alias("role"))
    sides = dealt.select("node", "hub", "share", F.lit(1).alias("role")).unionAll(hubs)
    laid = sides.join(texts, "node").repartition("hub", "share").sortWithinPartitions("hub", "share", "role")
    over, under = threshold

    def run(batches):
        now, own = None, None
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch["text"], width)
                found = []
                for node, hub, part, role, s in zip(*(batch[c].to_pylist() for c in ("node", "hub", "share", "role")), sets):
                    if role == 0:
                        now, own = (hub, part), s
                        continue
                    assert now == (hub, part)
                    both = len(np.intersect1d(s, own, assume_unique=True))
                    if under * both >= over * (len(s) + len(own) - both):
                        found.append((node, hub))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return laid.select("node", "hub", "share", "role", "text").mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = 5, threshold: tuple[int, int] = (80, 100), rows: int = ROWS, miss: float = MISS, slack: float = SLACK) -> DataFrame:
    """One row per document: doc_id, _h (hash of its text), n_shingles, component_id (smallest doc_id linked), kept."""
    return _classes(docs, width=width, threshold=threshold, rows=rows, miss=miss, slack=slack).drop("class")


def _classes(docs: DataFrame, *, width: int, threshold: tuple[int, int], rows: int = ROWS, miss: float = MISS, slack: float = SLACK) -> DataFrame:
    """Rows of near_duplicates with ``class``, one for all rows that are linked; null for a row without words."""
    t = threshold[0] / threshold[1]
    sketched = staged(_sketched(docs, width, rows * bands_for(t, rows, miss)), "sketches")
    nodes = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "_h")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = staged(nodes, "nodes")
    buckets = _buckets(_bands(nodes.select("node", "n", "sketch"), rows))
    wanted = buckets.select("node").distinct()
    every, nodes = nodes, staged(nodes.join(wanted, "node"), "nodes")
    unstage(every)
    reps = nodes.select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep._h").alias("_h"))
    source = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.col("text").cast("string").alias("text"))
    texts = staged(attach(source, reps, ["doc_id", "_h"], "inner").dropDuplicates(["node"]).select("node", "text"), "texts")

    links, comps, hubs, fine, most = None, None, None, None, 1
    while True:
        if comps is None:
            best = F.max(F.struct("central", "node", "n")).alias("h")
            chosen = buckets.groupBy("band").agg(best, F.first("salts").alias("salts")).select("band", "salts", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))
            chosen = staged(chosen, "hubs")
            fits = F.least("n", "hub_n") * threshold[1] >= F.greatest("n", "hub_n") * threshold[0]
            pairs = buckets.join(_salted(chosen), ["band", "salt"]).where((F.col("node") != F.col("hub")) & fits).select("node", "hub").distinct()
            likely = staged(_likely(pairs, nodes, t, slack), "likely")
        else:
            now = attach(buckets, comps.withColumnRenamed("id", "node"), ["node"]).withColumn("comp", F.coalesce("component_id", "node")).drop("component_id")
            now = staged(now, "placed")
            parts = now.groupBy("band", "comp").agg(F.count("*").alias("k"), F.first("salts").alias("salts"))
            largest = parts.groupBy("band").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"), F.first("salts").alias("salts")).where("comps > 1").select("band", "salts", F.col("top.comp").alias("main"))
            opened = staged(now.join(_salted(largest), ["band", "salt"]), "open")
            unstage(now)
            rest = opened.where("comp <> main").join(hubs.select("band", F.col("hub").alias("node")), ["band", "node"], "left_anti")
            place = F.row_number().over(Window.partitionBy("band", "salt").orderBy(F.desc("central"), "node"))
            chosen = rest.withColumn("place", place).where(F.col("place") <= most).select("band", "salts", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"), ((F.col("place") - 1) * F.col("salts") + F.col("salt")).alias("place"))
            chosen = staged(chosen, "hubs")
            if chosen.isEmpty():
                unstage(opened, chosen)
                break
            if fine is None:  # nodes of open buckets only become fewer
                open_texts = texts.join(opened.select("node").distinct(), "node", "left_semi")
                fine = staged(_fine(open_texts, width).join(nodes.select("node", "sketch"), "node"), "fine")
            likely = staged(_likely_in_blocks(opened.drop("main"), chosen, fine, threshold, slack, rows), "likely")
            unstage(opened)
        met = staged(_confirmed(likely, texts, width, threshold), "met")
        unstage(likely)
        hubs = chosen.select("band", "hub") if hubs is None else hubs.unionAll(chosen.select("band", "hub"))
        most = 64 if most == 1 else most * 16
        if comps is None or not met.isEmpty():
            links = met if links is None else links.unionAll(met)
            unstage(comps)
            comps = components(links)
    unstage(buckets, texts, nodes, fine)
    ids = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    ids = attach(ids, comps.withColumnRenamed("id", "node"), ["node"]).withColumn("comp", F.coalesce("component_id", "node")).drop("component_id")
    least = ids.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = ids.join(least, "comp").select("node", "component_id", F.col("comp").alias("class"))
    out = attach(sketched.select("doc_id", "_h", "node", F.col("n").alias("n_shingles")), ids, ["node"])
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "_h", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "class")


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, all columns kept: that with the smallest doc_id (ties by the hash of the text), once.

    A group is what is linked, whatever its ids: unlinked texts stay, and rows without words, each on its own.
    """
    options = {"width": 5, "threshold": (80, 100)} | options
    judged = staged(_classes(docs, **options).where("kept").groupBy("class", "doc_id", "_h").agg(F.count("*").alias("times")), "kept")
    alone = judged.where("class IS NULL").select("doc_id", "_h")
    linked = judged.where("class IS NOT NULL").groupBy("class").agg(F.min_by(F.struct("doc_id", "_h", "times"), "_h").alias("one")).select("one.*")
    if linked.where("times > 1").isEmpty():
        return filtered(docs, linked.select("doc_id", "_h").unionAll(alone), "left_semi")
    once = filtered(docs, linked.select("doc_id", "_h"), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionAll(filtered(docs, alone, "left_semi"))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=3, threshold=(85, 100)).drop("_h")


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 2], ' ') AS g FROM d, unnest(range(1, len(w) - 1)) AS t(i) WHERE len(w) >= 3
  UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), p AS (
  SELECT a.r AS x, b.r AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n AS nx ON nx.r = x JOIN n AS ny ON ny.r = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach(r, t) AS (
  SELECT r, r FROM d UNION SELECT reach.r, e.y FROM reach JOIN e ON e.x = reach.t
), m AS (
  SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""
