"""Connected components of a link table, without the driver or any task holding all links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import attach, lean, staged, unstage

MAX_ROUNDS = 60
#: Links that a task holds at a time.
HELD = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a task to (x, r): every node with the smallest node it reaches among a bounded number of links."""
    parent: dict[int, int] = {}
    seen = 0

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([find(x) for x in list(parent)], pa.int64())], names=["x", "r"])
        parent.clear()
        return out

    for b in batches:
        for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist()):
            a, z = find(u), find(v)
            if a != z:
                parent[max(a, z)] = min(a, z)
        seen += b.num_rows
        if seen >= HELD:
            yield told()
            seen = 0
    if parent:
        yield told()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, r) in order to assignments (0, x, its smallest r) and links (1, another r, its smallest r)."""
    last_x = least = last_r = None
    for b in batches:
        if not b.num_rows:
            continue
        x, r = np.asarray(b["x"]), np.asarray(b["r"])
        new, fresh = np.ones(len(x), bool), np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        fresh[1:] = new[1:] | (r[1:] != r[:-1])
        first = last_x is None or x[0] != last_x
        new[0], fresh[0] = first, first or r[0] != last_r
        starts = r[new] if first else np.concatenate([[least], r[new]])
        mins = starts[np.cumsum(new) - (1 if first else 0)]
        more = fresh & ~new
        kind = np.concatenate([np.zeros(int(new.sum()), np.int32), np.ones(int(more.sum()), np.int32)])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([x[new], r[more]])), pa.array(np.concatenate([r[new], mins[more]]))], names=["kind", "a", "b"])
        last_x, least, last_r = x[-1], mins[-1], r[-1]


def components(links: DataFrame) -> DataFrame:
    """links (a, b; any order, repeats allowed) to staged rows id, component_id (the smallest id reachable).

    A round joins links inside each task, so that a node comes once a task with the smallest node it reaches there, and
    then compares what a node got from all tasks; where that differs, the roots are linked in the next round. A hub's
    links never meet in one task: it has as many rows as there are tasks. Ids without a link do not appear.
    """
    now = links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    rounds, outs = [], []
    for _ in range(MAX_ROUNDS):
        forest = now.mapInArrow(lean(_forest), "x long, r long").repartition("x").sortWithinPartitions("x", "r")
        out = staged(forest.mapInArrow(lean(_joined), "kind int, a long, b long"), "joined")
        outs.append(out)
        rounds.append(out.where("kind = 0").select("a", "b"))
        now = out.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    found = rounds[0].select(F.col("a").alias("id"), F.col("b").alias("root"))
    for later in rounds[1:]:
        found = attach(found, later.select(F.col("a").alias("root"), "b"), ["root"]).select("id", F.coalesce("b", "root").alias("root"))
    found = staged(found.select("id", F.col("root").alias("component_id")), "components")
    unstage(*outs)
    return found
