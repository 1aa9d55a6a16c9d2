"""Processors that see batches: grouping, splitting, selecting, archives and policies.

A batch is the rows that share ``_batch``, in the order of ``_seq``. Nothing here gathers a batch in one place unless
its result is one row (an archive).
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from millrace.lang import compile as C
from millrace.operators.envelope import ConfigError, Resources, Stream, apply_all, interpolated, predicate, processor


def place(stream: Stream) -> Column:
    return F.row_number().over(Window.partitionBy("_batch").orderBy("_seq")) - 1


@processor("group_by")
def group_by(stream: Stream, conf, res: Resources) -> Stream:
    """Rows join the group of the first check that holds; each group becomes a batch, the rest a last one."""
    s = stream.ensure("_seq", "_batch")
    arm = F.lit(len(conf))
    for i, case in reversed(list(enumerate(conf))):
        arm = F.when(predicate(s, case["check"]), F.lit(i)).otherwise(arm)
    tagged = s.df.withColumn("_arm", arm)
    parts = []
    for i in range(len(conf) + 1):
        own = tagged.where(F.col("_arm") == i).withColumn("_batch", F.concat_ws("/", "_batch", F.lit(str(i)))).drop("_arm")
        parts.append(apply_all(Stream(own), conf[i].get("processors", []) if i < len(conf) else [], res))
    return parts[0].union(*parts[1:])


@processor("group_by_value")
def group_by_value(stream: Stream, conf, res: Resources) -> Stream:
    """Rows of a batch with the same text of ``value`` become a batch."""
    s = stream.ensure("_seq", "_batch")
    key = interpolated(s, conf["value"])
    out = Stream(s.df.withColumn("_key", key.col).withColumn("_batch", F.concat_ws("/", "_batch", F.coalesce("_key", F.lit("null")))))
    return out.flag(key.error, "group_by_value").without("_key") if key.error is not None else out.without("_key")


@processor("split")
def split(stream: Stream, conf, res: Resources) -> Stream:
    """Batches of ``size`` rows (1), or of as many rows as stay within ``byte_size``; a larger row is a batch alone."""
    s = stream.ensure("_seq", "_batch")
    if conf.get("byte_size"):
        return Stream(_packed(s, conf.get("size") or 0, conf["byte_size"]))
    n = F.floor(place(s) / F.lit(conf.get("size") or 1)).cast("long")
    return Stream(s.df.withColumn("_batch", F.concat_ws("/", "_batch", n.cast("string"))))


def _packed(s: Stream, count: int, size: int):
    """Greedy packing by bytes: a fold over each batch in order, which has no window form."""
    import pandas as pd

    df = s.df.withColumn("_bytes", F.octet_length(s.content()).cast("long"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq")
        group, held, rows, out = 0, 0, 0, []
        for b in pdf["_bytes"]:
            if rows and (held + b > size or count and rows >= count):
                group, held, rows = group + 1, 0, 0
            held, rows = held + b, rows + 1
            out.append(group)
        return pd.DataFrame({"_batch": pdf["_batch"], "_seq": pdf["_seq"], "_part": out})

    kind = df.schema["_seq"].dataType.simpleString()
    parts = df.select("_batch", "_seq", "_bytes").groupBy("_batch").applyInPandas(pack, f"_batch string, _seq {kind}, _part long")
    return df.drop("_bytes").join(parts, ["_batch", "_seq"]).withColumn("_batch", F.concat_ws("/", "_batch", F.col("_part").cast("string"))).drop("_part")


@processor("select_parts")
def select_parts(stream: Stream, conf, res: Resources) -> Stream:
    """Rows of each batch by index, in the order asked for; negative indexes count from the end."""
    s = stream.ensure("_seq", "_batch")
    n = F.count(F.lit(1)).over(Window.partitionBy("_batch"))
    wanted = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(p).alias("p")) for i, p in enumerate(conf.get("parts", [0]))])
    df = s.df.withColumn("_place", place(s)).withColumn("_n", n).withColumn("_want", F.explode(wanted))
    p = F.col("_want.p")
    return Stream(df.where(F.when(p < 0, p + F.col("_n")).otherwise(p) == F.col("_place")).withColumn("_seq", F.col("_want.at").cast("long")).drop("_place", "_n", "_want"))


@processor("insert_part")
def insert_part(stream: Stream, conf, res: Resources) -> Stream:
    """A new row in each batch at an index (-1: at the end) with the metadata of the first."""
    s = stream.ensure("_seq", "_batch", "_meta")
    at = conf.get("index", -1)
    raw = s if s.raw else Stream(s.df.select(*s.envelope, s.content().alias("_content")))
    df = raw.df.withColumn("_place", place(raw).cast("long"))
    first = Stream(df.where("_place = 0").drop("_place"))
    new = interpolated(first, conf.get("content", "")).col
    sizes = df.groupBy("_batch").agg(F.count("*").alias("_n"))
    heads = first.df.withColumn("_content", new).join(sizes, "_batch")
    spot = F.greatest(F.when(F.lit(at < 0), F.col("_n") + at + 1).otherwise(F.least(F.lit(at), F.col("_n"))), F.lit(0)).cast("long")
    heads = heads.withColumn("_spot", spot)
    added = heads.withColumn("_seq", F.col("_spot")).drop("_n", "_spot")
    moved = df.join(heads.select("_batch", "_spot"), "_batch").withColumn("_seq", F.col("_place") + (F.col("_place") >= F.col("_spot")).cast("long")).drop("_place", "_spot")
    return Stream(moved.unionByName(added, allowMissingColumns=True))


@processor("bounds_check")
def bounds_check(stream: Stream, conf, res: Resources) -> Stream:
    """Batches with too many or too few rows, or any row too large or small, go as a whole."""
    s = stream.ensure("_seq", "_batch")
    size = F.octet_length(s.content())
    w = Window.partitionBy("_batch")
    df = s.df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_most", F.max(size).over(w)).withColumn("_least", F.min(size).over(w))
    ok = F.col("_n").between(conf.get("min_parts", 1), conf.get("max_parts", 100)) & (F.col("_most") <= conf.get("max_part_size", 1 << 30)) & (F.col("_least") >= conf.get("min_part_size", 1))
    return Stream(df.where(ok).drop("_n", "_most", "_least"))


def batched(stream: Stream, policy: dict, res: Resources) -> Stream:
    """Tell the rows of each batch into batches by a policy: ``count``, ``byte_size``, ``check`` or ``period`` (of a timestamp field ``period_of``)."""
    s = stream.ensure("_seq", "_batch")
    if policy.get("check"):
        closed = predicate(s, policy["check"]).cast("int")
        before = F.coalesce(F.sum(closed).over(Window.partitionBy("_batch").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        s = Stream(s.df.withColumn("_batch", F.concat_ws("/", "_batch", before.cast("string"))))
    if policy.get("period") and policy.get("period_of"):
        from millrace.functions.times import duration_nanos

        step = duration_nanos(policy["period"]) // 1000
        window = F.floor(F.unix_micros(F.col(policy["period_of"]).cast("timestamp")) / F.lit(step))
        s = Stream(s.df.withColumn("_batch", F.concat_ws("/", "_batch", window.cast("string"))))
    if policy.get("byte_size"):
        s = Stream(_packed(s, policy.get("count") or 0, policy["byte_size"]))
    elif policy.get("count"):
        s = split(s, {"size": policy["count"]}, res)
    return apply_all(s, policy.get("processors"), res)


# reductions


def _aggregate(node, env: C.Env):
    """An expression over a batch as (aggregate, error): sums, extremes and counts of all rows, else the value of the first row."""
    P = C.P
    if node == P.Call("batch_size"):
        return F.count("*"), None
    if isinstance(node, P.Method) and node.name in ("sum", "max", "min", "length") and not node.args and isinstance(node.target, P.Method) and node.target.name == "from_all":
        if node.name == "length":
            return F.count("*"), None
        v = C.number(C.compile_expr(node.target.target, env))
        return {"sum": F.sum(v.col.cast("double")), "max": F.max(v.col), "min": F.min(v.col)}[node.name], v.error
    if _reads_batch(node):
        raise C.NotCompilable("an expression over all rows of a batch")
    return F.min_by(C.compile_expr(node, env).col, "_seq"), None


def _reads_batch(node) -> bool:
    P = C.P
    if isinstance(node, P.Method) and node.name in ("from", "from_all") or isinstance(node, P.Call) and node.name in ("batch_index", "count", "counter"):
        return True
    if isinstance(node, tuple):
        return any(map(_reads_batch, node))
    return any(_reads_batch(getattr(node, f)) for f in getattr(node, "__dataclass_fields__", ()))


def reduced(stream: Stream, items: dict) -> Stream:
    """One row per batch: field name to a syntax tree. Sums and their like combine before the shuffle, so a large batch is no
    large group."""
    s = stream.ensure("_seq", "_batch")
    env, aggs, errors = s.env(), [], []
    for name, node in items.items():
        agg, error = _aggregate(node, env)
        aggs.append(agg.alias(name))
        if error is not None:
            errors.append(F.min(error))
    if s.has("_meta"):
        aggs.append(F.min_by("_meta", "_seq").alias("_meta"))
    if errors:
        aggs.append(F.coalesce(*errors).alias("_e"))
    out = Stream(s.df.groupBy("_batch").agg(F.min("_seq").alias("_seq"), *aggs))
    return out.flag(F.col("_e"), "reduce").without("_e") if errors else out


def reduction(mapping) -> dict | None:
    """The fields of a mapping that keeps the first row of each batch and deletes the rest, or None if it is none such:
    ``root = if batch_index() > 0 { deleted() } else { {...} }``, or fields and then ``root = if batch_index() > 0 { deleted() }``."""
    P = C.P
    later = [P.Bin(op, P.Call("batch_index"), P.Lit(0)) for op in (">", "!=")]
    items: dict = {}
    drops = False
    for st in mapping.statements:
        if not isinstance(st, P.Assign) or st.kind != "root":
            return None
        if not st.path:
            v = st.value
            if not isinstance(v, P.If) or len(v.arms) != 1 or v.arms[0][0] not in later or v.arms[0][1] != P.Call("deleted") or drops:
                return None
            drops = True
            if v.other is not None:
                if items or not isinstance(v.other, P.Obj) or not all(isinstance(k, P.Lit) for k, _ in v.other.items):
                    return None
                items = {k.value: x for k, x in v.other.items}
        elif len(st.path) == 1:
            items[st.path[0]] = st.value
        else:
            return None
    return items if drops and items else None


@processor("reduce")
def reduce_(stream: Stream, conf, res: Resources) -> Stream:
    """One row per batch: field name to the text of an expression."""
    return reduced(stream, {name: C.P.parse_expression(text) for name, text in conf.items()})


@processor("archive")
def archive(stream: Stream, conf, res: Resources) -> Stream:
    """All rows of a batch as one: lines, concatenate, json_array, tar, zip or binary (base64 text for the last three)."""
    kind = conf["format"]
    s = stream.ensure("_seq", "_batch", "_meta")
    if kind == "tar" or kind == "zip" or kind == "binary":
        return _packed_archive(s, kind, conf.get("path", ""))
    body = F.transform(F.array_sort(F.collect_list(F.struct("_seq", s.content().alias("c"))), lambda a, b: F.when(a["_seq"] < b["_seq"], -1).when(a["_seq"] > b["_seq"], 1).otherwise(0)), lambda r: F.coalesce(r["c"], F.lit("")))
    forms = {"lines": lambda: F.array_join(body, "\n"), "concatenate": lambda: F.array_join(body, ""), "json_array": lambda: F.concat(F.lit("["), F.array_join(body, ","), F.lit("]"))}
    if kind not in forms:
        raise ConfigError(f"unknown archive format {kind!r}")
    return Stream(s.df.groupBy("_batch").agg(F.min("_seq").alias("_seq"), F.min_by("_meta", "_seq").alias("_meta"), forms[kind]().alias("_content")))


def _packed_archive(s: Stream, kind: str, path: str) -> Stream:
    import pandas as pd

    from millrace.sources.archives import pack

    name = interpolated(s, path).col if path else F.concat(F.lit("part-"), F.col("_seq").cast("string"))
    df = s.df.select("_batch", "_seq", "_meta", name.alias("name"), s.content().alias("_content"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq")
        return pd.DataFrame({"_batch": [pdf["_batch"].iloc[0]], "_seq": [pdf["_seq"].iloc[0]], "_meta": [pdf["_meta"].iloc[0]], "_content": [pack(kind, [(n, c.encode()) for n, c in zip(pdf["name"], pdf["_content"])])]})

    kinds = df.schema["_seq"].dataType.simpleString()
    return Stream(df.groupBy("_batch").applyInPandas(one, f"_batch string, _seq {kinds}, _meta map<string,string>, _content string"))


@processor("unarchive")
def unarchive(stream: Stream, conf, res: Resources) -> Stream:
    """Each row into the rows of its archive, within its batch; a row that is no such archive stays and is flagged."""
    kind = conf["format"]
    s = stream.ensure("_seq", "_batch", "_meta")
    c = s.content()
    json_of = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    entry = "array<struct<name:string,body:string>>"
    if kind == "lines":
        parts, error = F.transform(F.split(c, "\n", -1), lambda x: F.struct(F.lit(None).cast("string").alias("name"), x.alias("body"))), None
    elif kind == "json_array":
        items = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
        parts = F.transform(items, lambda v: F.struct(F.lit(None).cast("string").alias("name"), json_of(v).alias("body")))
        error = F.when(items.isNull(), F.lit("failed to parse message into a JSON array"))
    elif kind == "json_map":
        items = F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")
        parts = F.transform(F.map_entries(items), lambda e: F.struct(e["key"].alias("name"), json_of(e["value"]).alias("body")))
        error = F.when(items.isNull(), F.lit("failed to parse message into a JSON map"))
    else:
        from millrace.sources.archives import unpack_step

        out = unpack_step(kind)(c)
        parts, error = out["parts"].cast(entry), out["error"]
    df = s.df.withColumn("_parts", parts).withColumn("_e", error if error is not None else F.lit(None).cast("string")).withColumn("_old", c)
    bad = Stream(df.where("_e IS NOT NULL").select(*s.envelope, F.col("_old").alias("_content"), "_e")).flag(F.col("_e"), "unarchive").without("_e")
    rows = df.where("_e IS NULL").select(*s.envelope, F.posexplode("_parts").alias("_i", "_p"))
    seq = F.concat(F.lpad(F.col("_seq").cast("string"), 20, "0"), F.lit("."), F.lpad(F.col("_i").cast("string"), 10, "0"))
    meta = F.when(F.col("_p.name").isNotNull(), F.map_concat(F.map_filter("_meta", lambda k, _: ~k.isin("archive_key", "archive_filename")), F.create_map(F.lit("archive_key" if kind == "json_map" else "archive_filename"), F.col("_p.name")))).otherwise(F.col("_meta"))
    keep = [x for x in s.envelope if x not in ("_seq", "_meta")]
    well = Stream(rows.select(*keep, seq.alias("_seq"), meta.alias("_meta"), F.col("_p.body").alias("_content")))
    if error is None:
        return well
    return Stream(bad.df.withColumn("_seq", F.concat(F.lpad(F.col("_seq").cast("string"), 20, "0"), F.lit(".")))).union(well)
