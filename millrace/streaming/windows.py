"""Windows over event time. They are closed on the right: a row at the very end of a window belongs to it.

Spark's windows are closed on the left, so the timestamp goes one microsecond back before it is told into windows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lang import compile as C
from millrace.lang.parser import parse
from millrace.operators.envelope import ConfigError, Stream

_UNITS = {"ns": "nanoseconds", "us": "microseconds", "ms": "milliseconds", "s": "seconds", "m": "minutes", "h": "hours"}


def interval(duration: str) -> str:
    """A duration text such as 1h30m as an interval of Spark."""
    parts = re.findall(r"(\d+)(ns|us|ms|s|m|h)", duration)
    if not parts or "".join(n + u for n, u in parts) != duration:
        raise ConfigError(f"not a duration: {duration!r}")
    return " ".join(f"{n} {_UNITS[u]}" for n, u in parts)


def event_time(df: DataFrame, ts: str, lateness: str | None = None) -> DataFrame:
    """``_time``: the timestamp one microsecond back, with a watermark on it in a stream."""
    out = df.withColumn("_time", F.col(ts).cast("timestamp") - F.expr("interval 1 microsecond"))
    return out.withWatermark("_time", interval(lateness)) if lateness and df.isStreaming else out


def window_of(size: str, slide: str | None = None, offset: str | None = None):
    return F.window("_time", interval(size), interval(slide) if slide else interval(size), interval(offset) if offset else None)


def system_window(stream: Stream, conf: dict) -> Stream:
    """Rows told into windows of ``timestamp`` (a field) or what ``timestamp_mapping`` gives (a time, its text, or unix seconds); rows without
    one belong to no window and go. Each window is a batch whose name is its
    end; a row of several sliding windows comes once for each. Metadata has ``window_end_timestamp``."""
    s = stream.ensure("_seq", "_meta")
    field = conf.get("timestamp")
    if field is None:
        if not conf.get("timestamp_mapping"):
            raise ConfigError("system_window needs a timestamp field or mapping")
        made = C.compile_mapping(parse(conf["timestamp_mapping"]), s.env())
        if made.root is None:
            raise ConfigError("timestamp_mapping gives no value")
        v, field = made.root, "_ts"
        ts = F.timestamp_seconds(v.col) if isinstance(v.type, T.NumericType) else v.col.try_cast("timestamp") if isinstance(v.type, T.StringType) else v.col.cast("timestamp")
        error = C.either(made.error, v.error)
        s = Stream(s.df.withColumn("_ts", ts if error is None else F.when(error.isNull(), ts)))
    df = event_time(s.df, field, conf.get("allowed_lateness")).where(F.col("_time").isNotNull()).drop("_ts")
    df = df.withColumn("_window", window_of(conf["size"], conf.get("slide"), conf.get("offset")))
    end = F.date_format(F.col("_window.end"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    meta = F.map_concat(F.map_filter("_meta", lambda k, _: k != "window_end_timestamp"), F.create_map(F.lit("window_end_timestamp"), end))
    return Stream(df.withColumn("_batch", end).withColumn("_meta", meta).drop("_time", "_window"))


def windowed(df: DataFrame, ts: str, size: str, aggs: list, *, by: list[str] = (), slide: str | None = None, offset: str | None = None, lateness: str | None = None) -> DataFrame:
    """Aggregates by window (and keys): window_end and the aggregates. Works on tables and on streams."""
    told = event_time(df, ts, lateness)
    out = told.groupBy(window_of(size, slide, offset).alias("_window"), *by).agg(*aggs)
    return out.select(F.col("_window.end").cast("timestamp_ntz").alias("window_end"), *by, *[c for c in out.columns if c not in ("_window", *by)])
