"""Keyed state: duplicates, caches and what is looked up in them, joins by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lang import compile as C
from millrace.operators.envelope import ConfigError, Resources, Stream, apply_all, cut, interpolated, predicate, processor

#: A table of up to this many bytes (as the optimizer estimates it) is broadcast by the optimizer; we add no hint of our own.


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind)
    return True


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key. Rows that compare are reduced before the shuffle, so a hot key costs no more than others;
    else a window picks them."""
    if all(orderable(f.dataType) for f in df.schema):
        rest = [c for c in df.columns if c != order]
        best = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(F.struct(F.col(f"`{order}`"), *[F.col(f"`{c}`") for c in rest])).alias("_best"))
        return best.select(*[F.col("_best").getField(c).alias(c) for c in df.columns])
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


@processor("dedupe")
def dedupe(stream: Stream, conf, res: Resources) -> Stream:
    """The first row of each key stays. Rows whose key fails go, or stay flagged with ``drop_on_err: false``."""
    s = stream.ensure("_seq")
    key = interpolated(s, conf["key"])
    df = s.df.withColumn("_key", key.col)
    if s.df.isStreaming:
        return Stream(df.dropDuplicatesWithinWatermark(["_key"]).drop("_key"))
    if key.error is None:
        return Stream(first_by(df, ["_key"], "_seq").drop("_key"))
    df = df.withColumn("_e", key.error)
    well = Stream(first_by(df.where("_e IS NULL").drop("_e"), ["_key"], "_seq").drop("_key"))
    if conf.get("drop_on_err", True):
        return well
    failed = Stream(df.where("_e IS NOT NULL").drop("_key")).flag(F.col("_e"), "dedupe").without("_e")
    return well.union(failed)


# caches: tables of key and value


def cache_table(res: Resources, name: str) -> DataFrame:
    """The key-value table of a cache resource: memory (``init_values``), file (a folder), multilevel, lru, ttlru, noop or a DataFrame."""
    if name not in res.caches:
        raise ConfigError(f"unknown cache {name!r}")
    c = res.caches[name]
    if isinstance(c, DataFrame):
        return c
    kind, conf = next((k, v) for k, v in c.items() if k != "label")
    conf = conf or {}
    if kind in ("memory", "lru", "ttlru"):
        rows = [(str(k), str(v)) for k, v in (conf.get("init_values") or {}).items()]
        return res.spark.createDataFrame(rows, "key string, value string") if rows else res.spark.createDataFrame([], "key string, value string")
    if kind == "noop":
        return res.spark.createDataFrame([], "key string, value string")
    if kind == "file":
        import os

        if not os.path.isdir(conf["directory"]):
            return res.spark.createDataFrame([], "key string, value string")
        files = res.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(conf["directory"])
        return files.select(F.element_at(F.split("path", "/"), -1).alias("key"), F.decode("content", "UTF-8").alias("value"))
    if kind == "multilevel":
        levels = [cache_table(res, n).withColumn("_level", F.lit(i)) for i, n in enumerate(conf)]
        both = levels[0]
        for other in levels[1:]:
            both = both.unionByName(other)
        return first_by(both, ["key"], "_level").drop("_level")
    raise ConfigError(f"unknown kind of cache {kind!r}")


def _folder(res: Resources, name: str) -> str | None:
    """The folder of a file cache."""
    c = res.caches.get(name)
    return c["file"]["directory"] if isinstance(c, dict) and "file" in c else None


def _each_key(rows: DataFrame, folder: str, gone: bool) -> None:
    """Write (key, value) as files of a folder that all executors see, or delete them; written aside and renamed, so a task may run again."""

    def run(part):
        import os
        import uuid

        for r in part:
            if "/" in r["key"] or r["key"] in ("", ".", ".."):
                raise ValueError(f"no file name: {r['key']!r}")
            path = os.path.join(folder, r["key"])
            if gone:
                if os.path.exists(path):
                    os.remove(path)
                continue
            aside = f"{folder}/.{uuid.uuid4().hex}"
            with open(aside, "w", encoding="utf-8") as f:
                f.write(r["value"] or "")
            os.replace(aside, path)

    import os

    os.makedirs(folder, exist_ok=True)
    rows.foreachPartition(run)


def put_rows(res: Resources, name: str, rows: DataFrame) -> None:
    """Set keys (unique) of a cache: a file cache is written now, another is a plan that goes on from the table."""
    table = cache_table(res, name)
    if folder := _folder(res, name):
        _each_key(rows, folder, False)
    else:
        res.caches[name] = table.join(rows, "key", "left_anti").unionByName(rows.select("key", "value"))


def looked_up(stream: Stream, table: DataFrame, key: Column) -> DataFrame:
    """The stream's rows with ``_value`` (null where the key is not in the table); keys of the table are unique."""
    t = table.select(F.col("key").alias("_k"), F.col("value").alias("_value"), F.lit(True).alias("_hit"))
    return stream.df.withColumn("_key", key).join(t, F.col("_key") == F.col("_k"), "left").drop("_k")


@processor("cache")
def cache(stream: Stream, conf, res: Resources) -> Stream:
    """get: content is the value, rows without one are flagged. exists: content is true or false. set, add and delete change
    the table (add flags rows whose key is there or came before) and leave the rows as they are."""
    op, name = conf["operator"], conf["resource"]
    s = stream.ensure("_seq")
    key = interpolated(s, conf["key"]).col
    table = cache_table(res, name)
    if op in ("get", "exists"):
        df = looked_up(s, table, key)
        found = Stream(df.drop("_key", "_value", "_hit"))
        out = Stream(df)
        content = F.col("_value") if op == "get" else F.coalesce("_hit", F.lit(False)).cast("string")
        error = F.when(F.col("_hit").isNull(), F.lit("key does not exist")) if op == "get" else None
        keep = [c for c in found.envelope]
        kept = content if error is None else F.when(error.isNull(), content).otherwise(found.content() if not found.raw else F.col("_content"))
        out = Stream(df.select(*keep, kept.alias("_content"), *([error.alias("_e")] if error is not None else [])))
        return out if error is None else out.flag(F.col("_e"), "cache").without("_e")
    rows = s.df.select(key.alias("key"), interpolated(s, conf.get("value", "")).col.alias("value"), F.col("_seq"))
    if op == "set":
        last = rows.groupBy("key").agg(F.max_by("value", "_seq").alias("value"))
        put_rows(res, name, last)
        return s
    if op == "delete" and (folder := _folder(res, name)):
        _each_key(rows.select("key").distinct(), folder, True)
        return s
    if op == "delete":
        res.caches[name] = table.join(rows.select("key").distinct(), "key", "left_anti")
        return s
    if op == "add":
        firsts = rows.groupBy("key").agg(F.min("_seq").alias("_first"), F.min_by("value", "_seq").alias("value"))
        fresh = firsts.join(table.select("key"), "key", "left_anti")
        if _folder(res, name):
            fresh = cut(Stream(fresh)).df  # what is new is told before it is written
        put_rows(res, name, fresh.select("key", "value"))
        tagged = s.df.withColumn("_key", key).join(fresh.select(F.col("key").alias("_k"), "_first"), F.col("_key") == F.col("_k"), "left")
        out = Stream(tagged.withColumn("_e", F.when(~F.coalesce(F.col("_first") == F.col("_seq"), F.lit(False)), F.lit("key already exists"))).drop("_key", "_k", "_first"))
        return out.flag(F.col("_e"), "cache").without("_e")
    raise ConfigError(f"unknown cache operator {op!r}")


@processor("cached")
def cached(stream: Stream, conf, res: Resources) -> Stream:
    """The children run once for each key that the cache does not hold; their content serves every row of the key."""
    s = stream.ensure("_seq", "_batch", "_meta")
    s = s if s.raw else Stream(s.df.select(*s.envelope, s.content().alias("_content")))
    key = interpolated(stream.ensure("_seq", "_batch", "_meta"), conf["key"]).col if not stream.raw else interpolated(s, conf["key"]).col
    keyed = Stream(stream.ensure("_seq", "_batch", "_meta").df.withColumn("_k0", key))
    content = Stream(keyed.df.drop("_k0")).content()
    rows = keyed.df.select(*s.envelope, "_k0", content.alias("_content"))
    table = cache_table(res, conf["cache"]).select(F.col("key").alias("_k0"), F.col("value").alias("_held"))
    missing = rows.join(table, "_k0", "left_anti")
    firsts = missing.groupBy("_k0").agg(F.min("_seq").alias("_seq"), F.min_by("_content", "_seq").alias("_content"))
    asked = firsts.select(F.col("_k0").alias("_batch"), "_seq", "_content")
    done = apply_all(Stream(asked), conf.get("processors", []), res)
    fresh = done.df.select(F.col("_batch").alias("_k0"), done.content().alias("_held"), *(["_error"] if done.has("_error") else []))
    if "_error" in fresh.columns:
        fresh = fresh.where("_error IS NULL").drop("_error")
    kept = fresh
    if conf.get("skip_on"):
        kept = done.df.withColumn("_skip", predicate(done, conf["skip_on"])).where(~F.col("_skip")).select(F.col("_batch").alias("_k0"), done.content().alias("_held"))
    res.caches[conf["cache"]] = table.unionByName(kept).select(F.col("_k0").alias("key"), F.col("_held").alias("value"))
    all_held = table.unionByName(fresh)
    out = rows.join(all_held, "_k0", "left")
    return Stream(out.withColumn("_content", F.coalesce("_held", "_content")).drop("_held", "_k0"))


# joins of documents by id


def merge_join(streams: list[Stream], id_path: str, kind: str = "full-outer", strategy: str = "array") -> Stream:
    """Documents of several inputs merged by a text id. Where inputs share a field: ``array`` collects the values of all rows
    (a single one stays bare), ``replace`` keeps the last, ``keep`` the first; rows count in the order of inputs, then ``_seq``.

    full-outer: one document an id. outer: one for each row of the last input that has the id, holding what came before it.
    Rows without an id go. The rows of all inputs meet in one aggregate by id, combined before the shuffle.
    """
    if not streams:
        raise ConfigError("a join needs inputs")
    parts = []
    for i, s in enumerate(streams):
        s = s.ensure("_seq")
        v = C.read(s.document(), tuple(id_path.split(".")))
        fields = {n: x for n, x in ((n, C.read(s.document(), (n,))) for n in s.fields) if n != id_path}
        parts.append((i, s, v.col.cast("string").alias("_id"), fields))
    names = list(dict.fromkeys(n for _, _, _, f in parts for n in f))
    kinds = {n: C.unify([f[n] for _, _, _, f in parts if n in f]) for n in names}
    rows = None
    for i, s, key, fields in parts:
        order = F.struct(F.lit(i).alias("input"), F.col("_seq").cast("string").alias("seq") if not isinstance(s.df.schema["_seq"].dataType, T.NumericType) else F.lpad(F.col("_seq").cast("string"), 20, "0").alias("seq"))
        cols = [(C._to(fields[n], kinds[n]) if n in fields else F.lit(None).cast(kinds[n])).alias(n) for n in names]
        own = s.df.select(key, order.alias("_at"), *cols)
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.where(F.coalesce(F.col("_id"), F.lit("")) != "")
    last = len(streams) - 1

    def pick(n: str, upto: Column | None = None):
        col, at = F.col(n), F.col("_at")
        here = col.isNotNull() if upto is None else col.isNotNull() & upto
        if strategy == "replace":
            return F.max_by(F.when(here, col), F.when(here, at))
        if strategy == "keep":
            return F.min_by(F.when(here, col), F.when(here, at))
        if strategy == "array":
            pairs = F.collect_list(F.when(here, F.struct(at.alias("at"), col.alias("x"))))
            ordered = F.array_sort(pairs, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
            return F.transform(ordered, lambda p: p["x"])
        raise ConfigError(f"unknown merge strategy {strategy!r}")

    head = id_path.split(".")[0]
    if kind == "full-outer":
        out = rows.groupBy("_id").agg(*[pick(n).alias(n) for n in names])
        return Stream(out.withColumnRenamed("_id", head))
    if kind != "outer":
        raise ConfigError(f"unknown join type {kind!r}")
    earlier = rows.where(F.col("_at.input") < last).groupBy("_id").agg(*[pick(n).alias(n) for n in names])
    own = rows.where(F.col("_at.input") == last)
    w = Window.partitionBy("_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    if strategy == "array":
        running = own.select("_id", "_at", *[F.filter(F.collect_list(F.struct(F.col(n).alias("x"))).over(w), lambda p: p["x"].isNotNull()).alias(n) for n in names])
        running = running.select("_id", "_at", *[F.transform(n, lambda p: p["x"]).alias(n) for n in names])
        both = running.join(earlier.select("_id", *[F.col(n).alias(f"_e_{n}") for n in names]), "_id", "left")
        merged = [F.concat(F.coalesce(f"_e_{n}", F.array().cast(T.ArrayType(kinds[n]))), n).alias(n) for n in names]
    else:
        pickw = (lambda n: F.last(n, ignorenulls=True).over(w)) if strategy == "replace" else (lambda n: F.first(n, ignorenulls=True).over(w))
        running = own.select("_id", "_at", *[pickw(n).alias(n) for n in names])
        both = running.join(earlier.select("_id", *[F.col(n).alias(f"_e_{n}") for n in names]), "_id", "left")
        merged = [(F.coalesce(n, f"_e_{n}") if strategy == "replace" else F.coalesce(f"_e_{n}", n)).alias(n) for n in names]
    return Stream(both.select(F.col("_id").alias(head), *merged))
