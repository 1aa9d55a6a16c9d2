"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one node with a multiplicity. A neighbour graph starts from random projections: nodes
that share the signs of a few random hyperplanes (and a label) are compared inside cells of bounded size, and each
keeps its ``k`` nearest. Crowded cells are split by further hyperplanes; nodes of cells that stay crowded are compared
with all of their label. There are as many projections as make it less likely than ``MISS`` that two vectors at the
threshold share no cell. Rounds of neighbours-of-neighbours joins refine it: the neighbours of a node, in either
direction, are compared with one another, and what beats a list's last entry enters it, until nothing near the
threshold enters any more. A list whose last entry still
reaches the threshold is saturated and doubles, up to ``most``; nodes of lists that are saturated still are compared
with all of their label, block against block. After the rounds an audit compares a sample of nodes, linked ones and others, that grows with the square root of the
data, with all others by brute force, in blocks; where the mean share over the linked nodes of true links that lie
inside one component falls short of ``recall``, new projections and further rounds follow, and after ``tries`` of them all nodes are compared in blocks.

Links are confirmed in double precision. The edges at the threshold give components; how many links a node has is
then counted exactly among the members of its component, block against block, without writing pairs down.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null,
links with nothing (n_links 0, component itself); repeated rows count as links of one another; vectors of different
length are never compared; a null vec_id is a row like others but no component's smallest id unless all are null;
other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import attach, groups, staged
from millrace.llm.graph import components

THRESHOLD = 0.98
K = 8
MOST = 64
CELL = 256
PROJECTIONS = 6
#: Further hyperplanes that split a crowded cell, and the chance that a pair at the threshold shares no cell.
MORE = 4
MISS = 1e-3
RECALL = 0.995
AUDITED = 256
#: Members of a component that meet in one task of the exact count, and rows of a hub's reverse list in one join.
BLOCK = 512
#: Nodes of a side that meet in one task of the exact join.
EXACT = 1024
REVERSE = 128
log = logging.getLogger(__name__)


def _matrix(column, dtype="<f4") -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def _valid(c: str):
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(c).isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0)


def clean(c: str):
    """The vector in double precision, with one kind of zero."""
    return F.transform(F.col(c).cast("array<double>"), lambda x: x + 0.0)


def vector_nodes(vectors: DataFrame) -> DataFrame:
    """Distinct vectors of each label: node, label, dim, copies, least (smallest vec_id), unit (64 bits), short (32 bits)."""
    v = vectors.select("vec_id", F.col("label").cast("string").alias("label"), clean("embedding").alias("e"))
    v = v.where(F.col("label").isNotNull() & F.coalesce(_valid("e"), F.lit(False)))
    own = v.groupBy("label", "e").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    own = own.select(F.xxhash64("label", "e").alias("node"), "label", F.size("e").alias("dim"), "copies", "least", "e")

    def run(batches):
        for batch in batches:
            rows = [np.asarray(x, "<f8") for x in batch["e"].to_pylist()]
            unit = [x / np.linalg.norm(x / (s := np.abs(x).max())) / s for x in rows]
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in ("node", "label", "dim", "copies", "least")] + [pa.array([x.tobytes() for x in unit], pa.binary()), pa.array([x.astype("<f4").tobytes() for x in unit], pa.binary())],
                names=["node", "label", "dim", "copies", "least", "unit", "short"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return staged(own.mapInArrow(run, f"node long, label string, dim int, copies long, least {kind}, unit binary, short binary"), "vectors")


def _top(x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each row's k nearest others among the rows of x: row, places, similarities."""
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        n = min(k, len(x) - 1)
        places = np.argpartition(-s, n - 1, axis=1)[:, :n]
        for r in range(len(s)):
            yield i + r, places[r], s[r, places[r]]


def _edges(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, s = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "f8"))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "s"])


def projections_for(size: int, cell: int, threshold: float, miss: float = MISS) -> int:
    """Projections at which two vectors at the threshold share no cell of a label of ``size`` nodes with a chance of ``miss`` at most."""
    bits = math.ceil(math.log2(max(size / cell, 1))) + MORE
    together = (1 - math.acos(max(-1.0, min(threshold, 1.0))) / math.pi) ** bits
    return 1 if together >= 1 else math.ceil(math.log(miss) / math.log1p(-together))


def _projected(nodes: DataFrame, first: int, projections: int, cell: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Candidate edges (a, b, s): the k nearest of each node inside its cell of each random projection; and the nodes of cells that stay crowded."""
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("size"))
    rows = nodes.join(sizes, ["label", "dim"]).select("node", "short", F.xxhash64("label", "dim").alias("part"), "size")

    def key(batches):
        planes: dict = {}
        for batch in batches:
            for dim_rows in ([batch] if batch.num_rows else []):
                vec = dim_rows["short"].to_pylist()
                size, part = np.asarray(dim_rows["size"]), np.asarray(dim_rows["part"])
                bits = np.ceil(np.log2(np.maximum(size / cell, 1))).astype(int)
                for p in range(first, first + projections):
                    cells, more = np.empty(len(vec), np.int64), np.empty(len(vec), np.int64)
                    dims = np.asarray([len(x) // 4 for x in vec])
                    for d in np.unique(dims):
                        at = np.flatnonzero(dims == d)
                        x = np.frombuffer(b"".join(vec[i] for i in at), "<f4").reshape(len(at), -1)
                        if (p, d) not in planes:
                            planes[p, d] = np.random.default_rng([p, int(d)]).standard_normal((d, 40 + MORE)).astype("f4")
                        signs = (x @ planes[p, d] > 0).astype(np.int64)
                        keep = np.arange(40)[None, :] < bits[at][:, None]
                        cells[at] = (signs[:, :40] * keep) @ (1 << np.arange(40, dtype=np.int64))
                        more[at] = signs[:, 40:] @ (1 << np.arange(MORE, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([dim_rows["node"], dim_rows["short"], pa.array(part), pa.array(np.full(len(vec), p)), pa.array(cells), pa.array(more)], names=["node", "short", "part", "p", "cell", "more"])

    keyed = staged(rows.mapInArrow(key, "node long, short binary, part long, p long, cell long, more long"), "keyed")
    order = ["part", "p", "cell", "more", "salt"]
    fine = keyed.groupBy(*order[:4]).agg(F.count("*").alias("n"))
    coarse = fine.groupBy(*order[:3]).agg(F.sum("n").alias("all"))
    split = F.least(F.lit(MORE), F.ceil(F.log2(F.col("all") / cell))).cast("int")
    mask = F.when(F.col("all") > 4 * cell, F.pow(F.lit(2.0), split).cast("long") - 1).otherwise(F.lit(0).cast("long"))
    crowd = fine.join(coarse, order[:3]).withColumn("sub", F.col("more").bitwiseAND(mask))
    crowd = crowd.join(crowd.groupBy(*order[:3], "sub").agg(F.sum("n").alias("met")), [*order[:3], "sub"]).select(*order[:4], "sub", "met")
    salt = F.pmod(F.xxhash64("node", "p"), F.ceil(F.col("met") / (4 * cell)))
    dealt = keyed.join(crowd, order[:4]).withColumn("salt", salt).withColumn("more", F.col("sub"))
    dense = dealt.where(F.col("met") > 4 * cell).select("node").distinct()

    def near(batches):
        out, held = [], 0
        for group in groups(batches, order):
            if group.num_rows < 2:
                continue
            ids, x = np.asarray(group["node"]), _matrix(group["short"])
            for r, places, s in _top(x, k):
                out.append((np.full(len(places), ids[r]), ids[places], s.astype("f8")))
                held += len(places)
            if held > 200_000:
                yield _edges(out)
                out, held = [], 0
        yield _edges(out)

    return dealt.repartition(*order).sortWithinPartitions(*order).select(*order, "node", "short").mapInArrow(near, "a long, b long, s double"), dense


def _kept(edges: DataFrame, lists: DataFrame | None, k: int) -> DataFrame:
    """Each node's nearest neighbours, as many as its list holds (k unless ``lists`` says more): a, b, s, fresh, k."""
    best = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    sized = best.withColumn("k", F.lit(k)) if lists is None else best.join(lists, "a", "left").withColumn("k", F.coalesce("k", F.lit(k)))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return sized.withColumn("rank", rank).where("rank <= k").select("a", "b", "s", "fresh", "k", "rank")


def _descend(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate edges from comparing the neighbours, in either direction, of each node with one another."""
    back = graph.select(F.col("b").alias("x"), F.col("a").alias("y"), "fresh")
    many = back.groupBy("x").agg(F.count("*").alias("n"))
    back = back.join(many, "x").select("x", "y", "fresh", F.pmod(F.xxhash64("y"), F.ceil(F.col("n") / REVERSE)).alias("salt"))
    ahead = graph.select(F.col("a").alias("x"), F.col("b").alias("y"), "fresh", F.lit(0).cast("long").alias("salt"))
    both = ahead.unionAll(back).groupBy("x", "salt", "y").agg(F.max("fresh").alias("fresh"))
    last = graph.where("rank = k").select(F.col("a").alias("y"), F.col("s").alias("floor"))
    shorts = nodes.select(F.col("node").alias("y"), "short").join(last, "y", "left")
    rows = both.join(shorts, "y").select("x", "salt", "y", "fresh", F.coalesce("floor", F.lit(-2.0)).alias("floor"), "short")

    def run(batches):
        out, held = [], 0
        for group in groups(batches, ["x", "salt"]):
            if group.num_rows < 2:
                continue
            ids, x = np.asarray(group["y"]), _matrix(group["short"])
            fresh, floor = np.asarray(group["fresh"]).astype(bool), np.asarray(group["floor"])
            s = (x @ x.T).astype("f8")
            s[~(fresh[:, None] | fresh[None, :])] = -2
            np.fill_diagonal(s, -2)
            i, j = np.nonzero(s > floor[:, None])
            out.append((ids[i], ids[j], s[i, j]))
            held += len(i)
            if held > 200_000:
                yield _edges(out)
                out, held = [], 0
        yield _edges(out)

    return rows.repartition("x", "salt").sortWithinPartitions("x", "salt").mapInArrow(run, "a long, b long, s double")


def _confirmed(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The edges (a, b) whose cosine in double precision reaches the threshold."""
    near = edges.where(F.col("s") >= threshold - 1e-4).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = nodes.select(F.col("node").alias("a"), F.col("unit").alias("u")), nodes.select(F.col("node").alias("b"), F.col("unit").alias("w"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cos = np.asarray([np.dot(np.frombuffer(u, "<f8"), np.frombuffer(w, "<f8")) for u, w in zip(batch["u"].to_pylist(), batch["w"].to_pylist())])
                keep = pa.array(cos >= threshold)
                yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return near.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of links that connect what the links of a block connect; fewer than rows and columns."""
    rows, cols, out = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool), []
    for first in np.flatnonzero(near.any(axis=0)):
        ahead = [first] if cols[first] else []
        cols[first] = False
        while ahead:
            c = ahead.pop()
            met = np.flatnonzero(near[:, c] & rows)
            rows[met] = False
            out += [(r, c) for r in met]
            for r in met:
                more = np.flatnonzero(near[r] & cols)
                cols[more] = False
                out += [(r, m) for m in more]
                ahead += more.tolist()
    found = np.asarray(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _exact(nodes: DataFrame, dense: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect the nodes of ``dense`` with all they are linked with, by comparing them with all of their label."""
    units = nodes.select("node", F.xxhash64("label", "dim").alias("part"), "unit")
    dense = units.join(dense.select("node").distinct(), "node", "left_semi")
    count = lambda df, name: df.groupBy("part").agg(F.ceil(F.count("*") / EXACT).cast("long").alias(name))
    blocks = staged(count(dense, "js").join(count(units, "is"), "part"), "exact-blocks")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    one = units.join(blocks, "part").select("part", place("is").alias("i"), upto("js").alias("j"), F.lit(0).alias("side"), "node", "unit")
    two = dense.join(blocks, "part").select("part", upto("is").alias("i"), place("js").alias("j"), F.lit(1).alias("side"), "node", "unit")
    order = ["part", "i", "j"]

    def run(batches):
        for group in groups(batches, order):
            ids, side, x = np.asarray(group["node"]), np.asarray(group["side"]), _matrix(group["unit"], "<f8")
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            near = (x[a] @ x[b].T >= threshold) & (ids[a][:, None] != ids[b][None, :])
            r, c = _spanning(near)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a][r], pa.int64()), pa.array(ids[b][c], pa.int64())], names=["a", "b"])

    return one.unionAll(two).repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def _audit(nodes: DataFrame, comps: DataFrame, threshold: float, audited: int) -> float:
    """The mean share, over linked nodes, of a node's true links that lie inside its component.

    Both nodes with a known link and others are sampled, each at least ``audited`` and the square root of the nodes.
    """
    placed = attach(nodes, comps.withColumnRenamed("id", "node"), ["node"])
    placed = placed.withColumn("known", F.col("component_id").isNotNull()).withColumn("comp", F.coalesce("component_id", "node"))
    sizes = {r["known"]: r["n"] for r in placed.groupBy("known").agg(F.count("*").alias("n")).collect()}
    most = max(audited, math.isqrt(sum(sizes.values())))
    picked = [placed.where(F.col("known") == x).orderBy(F.xxhash64("node", F.lit(3)), "node").limit(most) for x in (True, False)]
    sample = picked[0].unionAll(picked[1]).select("node", "label", "comp", "unit", "known").collect()
    known = {r["node"]: r["known"] for r in sample}
    sample = [r[:4] for r in sample]
    shared = nodes.sparkSession.sparkContext.broadcast([tuple(r) for r in sample])

    def run(batches):
        sample = shared.value
        for batch in batches:
            labels, ids, comp = np.asarray(batch["label"].to_pylist(), object), np.asarray(batch["node"]), np.asarray(batch["comp"])
            units = batch["unit"].to_pylist()
            out, by = [], {}
            for node, label, c, unit in sample:
                if (label, len(unit)) not in by:
                    at = np.asarray([i for i in np.flatnonzero(labels == label) if len(units[i]) == len(unit)], int)
                    by[label, len(unit)] = (at, np.frombuffer(b"".join(units[i] for i in at), "<f8").reshape(len(at), -1) if len(at) else None)
                at, x = by[label, len(unit)]
                if x is None:
                    continue
                hit = at[x @ np.frombuffer(unit, "<f8") >= threshold]
                hit = hit[ids[hit] != node]
                if len(hit):
                    out.append((node, len(hit), int((comp[hit] == c).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["of", "links", "inside"])

    met = placed.select("node", "label", "comp", "unit").mapInArrow(run, "of long, links long, inside long").groupBy("of").agg((F.sum("inside") / F.sum("links")).alias("share")).collect()
    linked = found = 0.0
    for side, n in sizes.items():
        shares = [r["share"] for r in met if known[r["of"]] == side]
        weight = n / min(n, most)
        linked += weight * len(shares)
        found += weight * sum(shares)
    return found / linked if linked else 1.0


def _counts(nodes: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """Exact links of each node inside its component: node, linked (rows of other nodes)."""
    members = comps.join(nodes.withColumnRenamed("node", "id"), "id").select("id", "component_id", "copies", "unit")
    sizes = members.groupBy("component_id").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    dealt = members.join(sizes, "component_id").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    sent = dealt.select("id", "component_id", "copies", "unit", "block", F.explode(others).alias("pair")).select("id", "component_id", "copies", "unit", "block", "pair.i", "pair.j")
    order = ["component_id", "i", "j"]

    def run(batches):
        for group in groups(batches, order):
            ids, copies, block, x = np.asarray(group["id"]), np.asarray(group["copies"]), np.asarray(group["block"]), _matrix(group["unit"], "<f8")
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
            near = x[one] @ x[two].T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
                got, n = ids[one], near @ copies[two]
            else:
                got, n = np.concatenate([ids[one], ids[two]]), np.concatenate([near @ copies[two], near.T @ copies[one]])
            yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(n.astype("i8"))], names=["node", "n"])

    return sent.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("linked"))


def embedding_near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, k: int = K, most: int = MOST, cell: int = CELL, projections: int = PROJECTIONS, rounds: int | None = None, recall: float = RECALL, audited: int = AUDITED, tries: int = 3) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    nodes = vector_nodes(vectors)
    graph, lists, comps, crowded, first = None, None, None, None, 0
    largest = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    projections = max(projections, projections_for(largest, cell, threshold))
    for _ in range(tries):
        begun, dense = _projected(nodes, first, projections, cell, k)
        begun, crowded = begun.withColumn("fresh", F.lit(True)), dense if crowded is None else crowded.unionAll(dense)
        first += projections
        graph = staged(_kept(begun if graph is None else begun.unionByName(graph.select("a", "b", "s", "fresh")), lists, k), "graph")
        for _ in itertools.count() if rounds is None else range(rounds):
            full = graph.where((F.col("rank") == F.col("k")) & (F.col("s") >= threshold) & (F.col("k") < most)).select("a", F.least(F.col("k") * 2, F.lit(most)).alias("k"))
            held = graph.select("a", "k").distinct().join(full.select("a"), "a", "left_anti").unionAll(full)
            lists = staged(held.where(F.col("k") > k), "lists")
            found = staged(_descend(graph, nodes), "found").withColumn("fresh", F.lit(True))
            graph = staged(_kept(found.unionByName(graph.select("a", "b", "s", F.lit(False).alias("fresh"))), lists, k), "graph")
            if graph.where(F.col("fresh") & (F.col("s") >= threshold - 0.02)).isEmpty():
                break
        links = staged(_confirmed(graph, nodes, threshold), "links")
        dense = staged(graph.where((F.col("rank") == F.col("k")) & (F.col("s") >= threshold - 1e-4)).select(F.col("a").alias("node")).unionAll(crowded), "dense")
        if not dense.isEmpty():  # their lists may leave out links
            links = links.unionAll(staged(_exact(nodes, dense, threshold), "exact"))
        comps = components(links)
        found_share = _audit(nodes, comps, threshold, audited)
        log.info("audit: %.4f of the sampled links lie inside one component", found_share)
        if found_share >= recall:
            break
    else:
        comps = components(staged(_exact(nodes, nodes, threshold), "exact"))
    ids = attach(nodes.select("node", "copies", "least"), comps.withColumnRenamed("id", "node"), ["node"]).withColumn("comp", F.coalesce("component_id", "node")).drop("component_id")
    least = ids.groupBy("comp").agg(F.min("least").alias("component_id"))
    judged = ids.join(least, "comp").join(_counts(nodes, comps, threshold), "node", "left")
    judged = judged.select("node", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    e = clean("embedding")
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), e.alias("e"))
    rows = rows.select("vec_id", F.when(F.col("label").isNotNull() & F.coalesce(_valid("e"), F.lit(False)), F.xxhash64("label", "e")).alias("node"))
    out = attach(rows, judged, ["node"])
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op7_embedding_duplicates(spark, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
