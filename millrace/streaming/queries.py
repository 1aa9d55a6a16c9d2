"""Streams over files, run to their end, and keyed state with a time to live."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.envelope import Stream, scratch_folder


def file_stream(spark: SparkSession, path: str, schema=None, max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder (or one file) as a stream."""
    schema = schema or spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if name.endswith(".parquet"):
        return reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)
    return reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def drained(df: DataFrame, mode: str = "append", shuffle_partitions: int = 4) -> DataFrame:
    """Run a stream over all that is there now and return its result as a table.

    The result lies as Parquet in the folder of spark.checkpoint.dir, so the driver holds none of its rows: of "complete"
    the last state, else what every batch brought. As in any Parquet table, structs have fields, and names differ by more
    than case.
    """
    spark = df.sparkSession
    folder = f"{scratch_folder(spark)}/drained-{uuid.uuid4().hex}"
    out, check = f"{folder}/out", f"{folder}/check"
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)  # a stream without rows may run no batch
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle_partitions)
    try:
        if mode == "append":
            written(df, out, check)
        else:
            each_batch(df, lambda s, n: s.df.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/{n}"), check, mode)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(check), True)
    return spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(out)


def written(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream to its end into Parquet files; the checkpoint makes a restart go on where it stopped."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(df: DataFrame, use: Callable[[Stream, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream to its end, handing each micro-batch to ``use``; a batch that raises is handed over again on restart."""
    df.writeStream.outputMode(mode).foreachBatch(lambda b, n: use(Stream(b), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deduplicated(df: DataFrame, keys: list[str], ts: str | None = None, lateness: str = "1h") -> DataFrame:
    """The first row of each key; with a timestamp, keys are forgotten once the watermark passes them."""
    if ts is None:
        return df.dropDuplicates(keys)
    from millrace.streaming.windows import event_time

    return event_time(df, ts, lateness).dropDuplicatesWithinWatermark(keys).drop("_time")


def counters(df: DataFrame, key: str, ttl_ms: int | None = None) -> DataFrame:
    """How many rows of each key came so far, kept in the state store; with a time to live, keys that rest are forgotten."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Counter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "n long", ttl_ms) if ttl_ms else handle.getValueState("seen", "n long")

        def handleInputRows(self, k, rows: Iterator, timers) -> Iterator:
            from pyspark.sql import Row

            n = (self.seen.get()[0] if self.seen.exists() else 0) + sum(1 for _ in rows)
            self.seen.update((n,))
            yield Row(key=str(k[0]), n=n)

        def close(self) -> None:
            pass

    return df.groupBy(F.col(key)).transformWithState(Counter(), "key string, n long", "Update", "ProcessingTime" if ttl_ms else "None")
