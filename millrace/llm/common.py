"""What the operators of this subpackage share: staged tables, row keys, literal tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of letters and digits in text whose A-Z are lower-cased: 0-9, a-z and everything past ASCII.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: A run of anything but ASCII white space.
CHUNK = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_own: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or where that is unset a folder of our own, on a local master alone."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder as Parquet and read them back.

    Survives the loss of any executor, unlike a cached or locally checkpointed frame.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # what the write shuffled is not read again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*tables: DataFrame | None) -> None:
    """Delete tables made by staged() that no later plan reads; None and other frames are left alone."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Text that a Python step takes at a time, in bytes.
SLICE = 4 << 20


def slices(batch, column: str, most: int = SLICE):
    """Slices of an Arrow batch with a bounded amount of text (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


_kept: dict[str, Callable[[], None]] = {}


def keeps(operator: str, forget: Callable[[], None]) -> None:
    """``operator`` keeps something in a worker from task to task; ``forget`` drops it."""
    _kept[operator] = forget


def _returned() -> None:
    """Give free memory of this process back to the system: its allocators keep it otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(step: Callable[[Iterator], Iterator], operator: str = "") -> Callable[[Iterator], Iterator]:
    """A Python step that leaves no memory to those after it.

    Workers are used again by all steps of a session, so what one keeps (``keeps``) counts in the executor's memory until the
    worker ends: a step first drops what operators other than its own keep, and at its end returns what is free.
    """

    def run(batches: Iterator) -> Iterator:
        from millrace.llm.common import _kept, _returned  # the worker's own module, which outlives a task

        for name, forget in _kept.items():
            if name != operator:
                forget()
        _returned()
        yield from step(batches)
        _returned()

    return run


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; all other letters stay."""
    return F.translate(c, UPPER, UPPER.lower())


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table as a JVM-side plan (no Python worker reads it)."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in fields])
    row = lambda r: F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(r, fields)])
    return spark.range(1).select(F.inline(F.array(*[row(r) for r in rows])))


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``right`` by null-safe equality of the keys; the columns of right beside its keys are added."""
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    return left.join(other, on, how).drop(*[f"__right_{k}" for k in keys])


def filtered(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """The rows of docs (all columns, whatever their names) that have a mark (doc_id, _h: hash of the text), or with left_anti have none."""
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.xxhash64("text").alias("_h"))
    return attach(packed, marks, ["doc_id", "_h"], how).select("row.*")


def groups(batches, keys: list[str]):
    """Tables of the rows of one group each; rows come sorted by the keys and groups are of bounded size."""
    import numpy as np
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch[k]) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, z in zip(starts, starts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
