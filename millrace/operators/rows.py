"""Processors that treat rows one by one: mappings, branches, switches, error handling, loops."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lang import compile as C
from millrace.lang import parser as P
from millrace.operators.batches import reduced, reduction
from millrace.operators.envelope import ERROR, ConfigError, Resources, Stream, apply_all, apply_processor, cut, named, predicate, processor


#: Rounds of a retry without max_retries.
LIMIT = 1000


def _mapped(stream: Stream, text: str, res: Resources, onto: bool, name: str) -> Stream:
    mapping = P.parse(text, res.load)
    writes_meta = any(getattr(s, "kind", "") == "meta" for s in mapping.statements) or "@" in text or "meta(" in text
    stream = stream.ensure("_meta") if writes_meta else stream
    if ("batch_" in text or ".from" in text or "count(" in text or "counter(" in text) and not stream.has("_seq"):
        stream = stream.ensure("_seq", "_batch")
    try:
        fields = None if onto else reduction(mapping)
        if fields is not None and stream.has("_batch"):
            return reduced(stream, fields)
    except C.NotCompilable:
        pass
    try:
        made = C.compile_mapping(mapping, stream.env(), onto)
    except C.NotCompilable:
        return _interpreted(stream, text, res, onto, name)
    return _placed(stream, made, name)


def _placed(stream: Stream, made: C.Mapped, name: str) -> Stream:
    """The columns of a compiled mapping put in place of the document."""
    root, error = made.root, made.error
    if root is not None and root.error is not None:
        error = C.either(error, root.error)
    env = [F.col(c) for c in stream.envelope if not (c == "_meta" and made.meta is not None)]
    if made.meta is not None:
        meta = made.meta if error is None else F.when(error.isNull(), made.meta).otherwise(F.col("_meta"))
        env.append(meta.alias("_meta"))
    extra = [] if error is None else [error.alias("_e")]
    if made.deleted is not None:
        gone = made.deleted if error is None else made.deleted & error.isNull()
        extra.append(F.coalesce(gone, F.lit(False)).alias("_gone"))
    if root is None:
        doc = [F.col(f"`{c}`") for c in stream.fields] + ([F.col("_content")] if stream.raw else [])
    elif isinstance(root.type, T.StructType):
        parts = root.fields or {n: C.read(root, (n,)) for n in root.type.names}
        doc = [_kept(stream, n, v, error).alias(n) for n, v in parts.items()]
    else:
        text = root.col if isinstance(root.type, T.StringType) else F.decode(root.col, "UTF-8") if isinstance(root.type, T.BinaryType) else C.json_text(root)
        old = stream.content() if error is not None else None
        doc = [(text if error is None else F.when(error.isNull(), text).otherwise(old)).alias("_content")]
    out = Stream(stream.df.select(*env, *doc, *extra))
    if made.deleted is not None:
        out = Stream(out.df.where(~F.col("_gone")).drop("_gone"))
    return out if error is None else out.flag(F.col("_e"), name).without("_e")


def _kept(stream: Stream, name: str, v: C.Val, error):
    """A new field; a failed row keeps the old value where one of that name and type exists."""
    if error is None:
        return v.col if not isinstance(v.type, T.NullType) else v.col.cast("string")
    old = stream.df.schema[name].dataType if name in stream.fields else None
    same = old == v.type
    rest = F.col(f"`{name}`") if same else F.lit(None)
    col = v.col if not isinstance(v.type, T.NullType) else v.col.cast("string")
    return F.when(error.isNull(), col).otherwise(rest)


def _interpreted(stream: Stream, text: str, res: Resources, onto: bool, name: str) -> Stream:
    """What has no column form runs in the interpreter, message by message, on JSON text."""
    from millrace.plans.dynamic import mapping_step

    stream = stream.ensure("_meta")
    step = mapping_step(text, onto, dict(res.imports))
    df = stream.df.withColumn("_out", step(stream.content(), F.col("_meta")))
    env = [F.col(c) for c in stream.envelope if c != "_meta"]
    df = df.where(~F.coalesce(F.col("_out.gone"), F.lit(False)))
    df = df.select(*env, F.col("_out.meta").alias("_meta"), F.col("_out.content").alias("_content"), F.col("_out.error").alias("_e"))
    return Stream(df).flag(F.col("_e"), name).without("_e")


@processor("mapping")
def mapping(stream: Stream, conf, res: Resources) -> Stream:
    return _mapped(stream, conf, res, False, "mapping")


@processor("mutation")
def mutation(stream: Stream, conf, res: Resources) -> Stream:
    return _mapped(stream, conf, res, True, "mutation")


@processor("processors")
def processors(stream: Stream, conf, res: Resources) -> Stream:
    return apply_all(stream, conf, res)


@processor("noop")
def noop(stream: Stream, conf, res: Resources) -> Stream:
    return stream


@processor("resource")
def resource(stream: Stream, conf, res: Resources) -> Stream:
    if conf not in res.processors:
        raise ConfigError(f"unknown processor resource {conf!r}")
    return apply_processor(stream, res.processors[conf], res)


@processor("branch")
def branch(stream: Stream, conf, res: Resources) -> Stream:
    """Map to a request, run the children on it, map the result back onto the document. Rows whose request is deleted pass unchanged."""
    request, result = conf.get("request_map", ""), conf.get("result_map", "")
    if stream.raw:
        return _branch_raw(stream, conf, res)
    names = stream.fields
    held = stream.ensure("_error", "_meta")
    packed = held.df.withColumn("_origin", F.struct(*[F.col(f"`{n}`") for n in names], F.col("_error").alias("_old"), F.col("_meta").alias("_old_meta")))
    asked = Stream(packed.withColumn("_error", F.lit(None).cast(ERROR)))
    skipped = None
    if request:
        m = P.parse(request, res.load)
        made = C.compile_mapping(m, asked.env())
        if made.deleted is not None:
            gone = F.coalesce(made.deleted if made.error is None else made.deleted & made.error.isNull(), F.lit(False))
            skipped = Stream(held.df.where(gone))
            asked = Stream(asked.df.where(~gone))
            made = C.replace(made, deleted=None)
        asked = _placed(asked, made, "branch")
    done = apply_all(asked, conf.get("processors", []), res)
    origin = F.col("_origin")
    kind = T.StructType([f for f in done.df.schema["_origin"].dataType if f.name not in ("_old", "_old_meta")])
    root = C.Val(origin, kind, fields={f.name: C.Val(origin.getField(f.name), f.dataType) for f in kind})
    failed = F.col("_error.message") if done.has("_error") else F.lit(None).cast("string")
    env = done.env()
    m = P.parse(result, res.load) if result else P.Mapping()
    state = {"root": root, "gone": None, "error": failed}
    C._run(m.statements, C.replace(env, maps=m.maps, vars={}, root=root, new_meta=origin.getField("_old_meta")), state, False)
    error = state["error"]
    fields = state["root"].fields or {n: C.read(state["root"], (n,)) for n in state["root"].type.names}
    out = []
    for n, v in fields.items():
        old = root.fields.get(n)
        col = v.col if not isinstance(v.type, T.NullType) else v.col.cast("string")
        out.append(F.when(error.isNull(), col).otherwise(old.col if old is not None and old.type == v.type else F.lit(None)).alias(n))
    keep = [c for c in done.envelope if c not in ("_origin", "_error", "_meta") and c in held.df.columns]
    meta = state.get("meta", origin.getField("_old_meta"))
    df = done.df.select(*keep, *out, meta.alias("_meta"), origin.getField("_old").alias("_error"), error.alias("_e"))
    back = Stream(df).flag(F.col("_e"), "branch").without("_e")
    return back if skipped is None else back.union(skipped)


def _branch_raw(stream: Stream, conf, res: Resources) -> Stream:
    """The same for documents of unknown shape: the original rides along as text and the result is overlaid in the interpreter."""
    from millrace.plans.dynamic import overlay_step

    held = stream.ensure("_error", "_meta")
    asked = Stream(held.df.withColumn("_origin", F.struct("_content", F.col("_error").alias("_old"), F.col("_meta").alias("_old_meta"))).withColumn("_error", F.lit(None).cast(ERROR)))
    if conf.get("request_map"):
        asked = _interpreted(asked, conf["request_map"], res, False, "branch")
    done = apply_all(asked, conf.get("processors", []), res)
    step = overlay_step(conf.get("result_map", ""), dict(res.imports))
    df = done.df.withColumn("_out", step(done.content(), F.col("_origin._content"), F.col("_meta")))
    failed = F.coalesce(F.col("_error.message"), F.col("_out.error"))
    keep = [c for c in done.envelope if c not in ("_origin", "_error", "_meta")]
    df = df.select(*keep, F.when(failed.isNull(), F.col("_out.content")).otherwise(F.col("_origin._content")).alias("_content"), F.col("_origin._old_meta").alias("_meta"), F.col("_origin._old").alias("_error"), failed.alias("_e"))
    return Stream(df).flag(F.col("_e"), "branch").without("_e")


@processor("switch")
def switch(stream: Stream, conf, res: Resources) -> Stream:
    """The first case whose check holds runs its children; others pass. ``fallthrough`` hands the result on to the next case's
    children, ``continue`` puts it back to be tested against the cases after."""
    rest, done = stream, []
    carried: Stream | None = None
    for case in conf:
        check = case.get("check", "")
        hit = predicate(rest, check) if check else F.lit(True)
        tagged = rest.df.withColumn("_arm", hit)
        own = Stream(tagged.where("_arm").drop("_arm"))
        rest = Stream(tagged.where(~F.col("_arm")).drop("_arm"))
        if carried is not None:
            own = own.union(carried)
        out = apply_all(own, case.get("processors", []), res)
        carried = None
        if case.get("fallthrough"):
            carried = out
        elif case.get("continue"):
            rest = rest.union(out)
        else:
            done.append(out)
    if carried is not None:
        done.append(carried)
    return rest.union(*done)


@processor("try")
def try_(stream: Stream, conf, res: Resources) -> Stream:
    """Children run on rows that have not failed."""
    for c in conf:
        if not stream.has("_error"):  # nothing can have failed yet
            stream = apply_processor(stream, c, res)
            continue
        well = Stream(stream.df.where("_error IS NULL"))
        failed = Stream(stream.df.where("_error IS NOT NULL"))
        stream = _joined(apply_processor(well, c, res), failed)
    return stream


def _joined(main: Stream, other: Stream) -> Stream:
    """Two parts of a stream; a text column meets typed fields as JSON text."""
    if main.raw != other.raw:
        texts = [s if s.raw else Stream(s.df.select(*s.envelope, s.content().alias("_content"))) for s in (main, other)]
        return texts[0].union(texts[1])
    return main.union(other)


@processor("catch")
def catch(stream: Stream, conf, res: Resources) -> Stream:
    """Children run on rows that have failed, which are well again afterwards."""
    if not stream.has("_error"):
        return stream
    well = Stream(stream.df.where("_error IS NULL"))
    failed = Stream(stream.df.where("_error IS NOT NULL"))
    held = Stream(failed.df.withColumn("_origin", F.col("_error")))
    out = apply_all(held, conf, res)
    fresh = ~F.col("_error").eqNullSafe(F.col("_origin"))
    out = Stream(out.df.withColumn("_error", F.when(fresh, F.col("_error"))).drop("_origin"))
    return _joined(well, out)


@processor("try_catch")
def try_catch(stream: Stream, conf, res: Resources) -> Stream:
    """Children; rows that fail keep the error's text in metadata and run the catch children."""
    stream = stream.ensure("_error", "_meta")
    own = Stream(stream.df.withColumn("_origin", F.col("_error")).drop("_error"))
    tried = try_(own, conf.get("processors", []), res).ensure("_error")
    key = conf.get("error_metadata", "error")
    well = Stream(tried.df.where("_error IS NULL"))
    failed = tried.df.where("_error IS NOT NULL")
    noted = F.map_concat(F.map_filter("_meta", lambda k, _: k != key), F.create_map(F.lit(key), F.col("_error.message")))
    failed = failed.withColumn("_meta", noted).withColumn("_error", F.lit(None).cast(ERROR))
    out = _joined(well, apply_all(Stream(failed), conf.get("catch", []), res))
    return Stream(out.df.withColumn("_error", F.coalesce("_error", "_origin")).drop("_origin"))


@processor("while")
def while_(stream: Stream, conf, res: Resources) -> Stream:
    """Children run again on rows for which the check holds, ``max_loops`` times at most (unset or 0: no limit), until no row is
    left. Each round runs when it is planned and goes on from its rows; in a stream the rounds are unrolled, so it needs a limit."""
    done: list[Stream] = []
    rest, most = stream, conf.get("max_loops") or 0
    if not most and stream.df.isStreaming:
        raise ConfigError("while needs max_loops in a stream")
    for i in range(most) if most else itertools.count():
        if not (conf.get("at_least_once") and i == 0):
            flag = rest.df.withColumn("_arm", predicate(rest, conf["check"]))
            done.append(Stream(flag.where(~F.col("_arm")).drop("_arm")))
            rest = Stream(flag.where("_arm").drop("_arm"))
            if not rest.df.isStreaming and rest.df.isEmpty():
                break
        rest = cut(apply_all(rest, conf.get("processors", []), res))
    return rest.union(*done)


@processor("for_each", "parallel")
def for_each(stream: Stream, conf, res: Resources) -> Stream:
    """Children see each row as a batch of its own."""
    children = conf if isinstance(conf, list) else conf.get("processors", [])
    s = stream.ensure("_seq", "_batch")
    s = Stream(s.df.withColumn("_origin", F.col("_batch")).withColumn("_batch", F.concat_ws("#", "_batch", F.col("_seq").cast("string"))))
    out = apply_all(s, children, res)
    return Stream(out.df.withColumn("_batch", F.col("_origin")).drop("_origin"))


@processor("retry")
def retry(stream: Stream, conf, res: Resources) -> Stream:
    """Children, again on rows that failed, up to ``max_retries`` times (unset or 0: no limit, but an error after ``LIMIT``);
    ``retry_count`` tells how often in metadata."""
    most = conf.get("max_retries") or LIMIT
    todo = stream.ensure("_error", "_meta")
    todo = Stream(todo.df.withColumn("_origin", F.struct(*[F.col(f"`{c}`") for c in [*todo.fields, *(["_content"] if todo.raw else [])]])).withColumn("_error", F.lit(None).cast(ERROR)))
    done: list[Stream] = []
    for i in range(most + 1):
        out = apply_all(todo, conf.get("processors", []), res)
        counted = F.map_concat(F.map_filter("_meta", lambda k, _: k != "retry_count"), F.create_map(F.lit("retry_count"), F.lit(str(i))))
        out = cut(Stream(out.df.withColumn("_meta", counted)))
        if i == most and conf.get("max_retries"):
            done.append(out)
            break
        if i == most:
            raise RuntimeError(f"rows still fail after {LIMIT} retries")
        done.append(Stream(out.df.where("_error IS NULL")))
        failed = out.df.where("_error IS NOT NULL")
        if failed.isEmpty():
            break
        todo = Stream(failed.select(*[c for c in out.envelope if c != "_error"], "_origin.*").withColumn("_error", F.lit(None).cast(ERROR)))
    head = done[0].union(*done[1:])
    return head.without("_origin")


@processor("workflow")
def workflow(stream: Stream, conf, res: Resources) -> Stream:
    """Branches in layers: by ``order``, or by what they read and write. A record of what became of them goes to ``meta_path``:
    the names of those that ``succeeded``, and why others ``failed`` by name; rows with one of the latter are flagged."""
    branches = dict(conf.get("branches") or {})
    for name in conf.get("branch_resources") or []:
        kind, settings, _ = named(res.processors[name])
        branches[name] = settings
    layers = conf.get("order") or layers_of(branches)
    names = sorted(n for layer in layers for n in layer)
    s = stream.ensure("_error")
    s = Stream(s.df.withColumn("_before", F.col("_error")).withColumn("_record", F.create_map().cast("map<string,string>")))
    for layer in layers:
        for name in layer:
            s = branch(Stream(s.df.withColumn("_error", F.lit(None).cast(ERROR))), branches[name], res)
            why = F.col("_error.message")
            s = Stream(s.df.withColumn("_record", F.when(why.isNull(), F.col("_record")).otherwise(F.map_concat("_record", F.create_map(F.lit(name), why)))))
    failed = F.map_keys("_record")
    why = F.when(F.size(failed) > 0, F.concat(F.lit("workflow branches failed: ["), F.array_join(F.array_sort(failed), " "), F.lit("]")))
    s = Stream(s.df.withColumn("_error", F.col("_before"))).flag(why, "workflow")
    path = conf.get("meta_path", "meta.workflow")
    if path and not s.raw:
        well = F.array_except(F.array(*map(F.lit, names)).cast("array<string>"), failed)
        or_null = lambda c: F.when(F.size(c) > 0, c)
        val = C.obj({"succeeded": C.Val(or_null(well), T.ArrayType(C.STRING)), "failed": C.Val(or_null(F.col("_record")), T.MapType(C.STRING, C.STRING))})
        s = _placed(s, C.Mapped(C._write(s.document(), tuple(path.split(".")), val)), "workflow")
    return s.without("_record", "_before")


def paths_read(text: str) -> set[tuple[str, ...]]:
    out: set = set()

    def walk(node):
        if isinstance(node, P.Path):
            if node.base in ("this", "root"):
                out.add(node.segments)
        elif hasattr(node, "__dataclass_fields__"):
            for f in node.__dataclass_fields__:
                walk(getattr(node, f))
        elif isinstance(node, (tuple, list)):
            for x in node:
                walk(x)

    for s in P.parse(text).statements if text else []:
        walk(s.value if isinstance(s, P.Assign) else s)
    return out


def paths_written(text: str) -> set[tuple[str, ...]]:
    out: set = set()

    def walk(s):
        if isinstance(s, P.Assign):
            if s.kind == "root":
                out.add(tuple(s.path))
        else:
            for _, body in s.arms:
                for x in body:
                    walk(x)
            for x in s.other:
                walk(x)

    for s in P.parse(text).statements if text else []:
        walk(s)
    return out


def layers_of(branches: dict) -> list[list[str]]:
    """Branches in layers: one that reads what another writes comes after it; a circle is an error."""
    reads = {n: paths_read(b.get("request_map", "")) for n, b in branches.items()}
    writes = {n: paths_written(b.get("result_map", "")) for n, b in branches.items()}
    begins = lambda a, b: a[: len(b)] == b or b[: len(a)] == a
    needs = {n: {m for m in branches if m != n and any(w and begins(r, w) for r in reads[n] for w in writes[m])} for n in branches}
    layers, placed = [], set()
    while len(placed) < len(branches):
        layer = sorted(n for n in branches if n not in placed and needs[n] <= placed)
        if not layer:
            raise ConfigError(f"branches depend on one another in a circle: {sorted(set(branches) - placed)}")
        layers.append(layer)
        placed |= set(layer)
    return layers
