"""Streams: a DataFrame of documents with the columns of the envelope.

Document fields are ordinary typed columns; a document of unknown shape is one text column ``_content`` (JSON or plain
text). Envelope columns are there only where an operator needs them: ``_seq`` (order), ``_batch`` (which batch a row
belongs to), ``_meta`` (map of text) and ``_error`` (message, name, label, path; null while a row is well).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lang import compile as C
from millrace.lang.parser import parse_interpolation

RESERVED = ("_seq", "_batch", "_meta", "_error", "_content", "_origin", "_arm", "_record", "_before")
ERROR = "struct<message:string,name:string,label:string,path:string>"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Stream:
    df: DataFrame

    @staticmethod
    def of(df: DataFrame, seq: str | Column | None = None, batch: Any = None) -> Stream:
        """A stream over a table; ``seq`` orders its rows, ``batch`` tells them into batches (one batch by default)."""
        if seq is not None:
            df = df.withColumn("_seq", F.col(seq) if isinstance(seq, str) else seq)
        if seq is not None or batch is not None:
            df = df.withColumn("_batch", F.lit("0") if batch is None else (F.col(batch) if isinstance(batch, str) else batch).cast("string"))
        return Stream(df)

    def has(self, name: str) -> bool:
        return name in self.df.columns

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c not in RESERVED]

    @property
    def envelope(self) -> list[str]:
        return [c for c in self.df.columns if c in RESERVED and c != "_content"]

    @property
    def raw(self) -> bool:
        return self.has("_content")

    def with_df(self, df: DataFrame) -> Stream:
        return Stream(df)

    def ensure(self, *names: str) -> Stream:
        """Add envelope columns that are missing."""
        df = self.df
        for n in names:
            if n in df.columns:
                continue
            if n == "_seq":
                df = df.withColumn("_seq", F.monotonically_increasing_id())
            elif n == "_batch":
                df = df.withColumn("_batch", F.lit("0"))
            elif n == "_meta":
                df = df.withColumn("_meta", F.create_map().cast("map<string,string>"))
            elif n == "_error":
                df = df.withColumn("_error", F.lit(None).cast(ERROR))
        return Stream(df)

    def document(self) -> C.Val:
        """The document as an expression: an object of the fields, or the parsed content."""
        if self.raw:
            col = F.try_parse_json(F.col("_content"))
            return C.Val(col, C.VARIANT, F.when(col.isNull(), F.lit("failed to parse message as JSON")))
        names = self.fields
        kind = T.StructType([self.df.schema[n] for n in names])
        return C.Val(F.struct(*[F.col(f"`{n}`") for n in names]) if names else F.struct(), kind, fields={n: C.Val(F.col(f"`{n}`"), self.df.schema[n].dataType) for n in names})

    def env(self) -> C.Env:
        has = lambda n: F.col(n) if self.has(n) else None
        return C.Env(
            self.document(),
            meta=has("_meta"),
            error=has("_error"),
            content=has("_content"),
            batch=(F.col("_batch"),) if self.has("_batch") else (),
            order=(F.col("_seq"),) if self.has("_seq") else (),
        )

    def content(self) -> Column:
        """The text of each message."""
        return F.col("_content") if self.raw else C.json_text(self.document())

    def with_content(self, content: Column, error: Column | None = None, name: str = "") -> Stream:
        """The stream with new content; where ``error`` is set the old content stays and the row is flagged."""
        kept = content if error is None else F.when(error.isNull(), content).otherwise(self.content())
        out = Stream(self.df.select(*self.envelope, kept.alias("_content"), *([error.alias("_e")] if error is not None else [])))
        return out if error is None else out.flag(F.col("_e"), name).without("_e")

    def without(self, *names: str) -> Stream:
        return Stream(self.df.drop(*names))

    def flag(self, error: Column, name: str, label: str = "", path: str = "") -> Stream:
        """Mark rows whose error text is set; a flag set before stays where it is not."""
        s = self.ensure("_error")
        made = F.struct(error.alias("message"), F.lit(name).alias("name"), F.lit(label).alias("label"), F.lit(path).alias("path")).cast(ERROR)
        return Stream(s.df.withColumn("_error", F.when(error.isNotNull(), made).otherwise(F.col("_error"))))

    def union(self, *others: Stream) -> Stream:
        df = self.df
        for o in others:
            df = df.unionByName(o.df, allowMissingColumns=True)
        return Stream(df)

    def typed(self, schema: str) -> Stream:
        """Parse the content by a schema into typed fields."""
        df = self.df.withColumn("_doc", F.from_json("_content", schema))
        return Stream(df.select(*self.envelope, "_doc.*"))


def interpolated(stream: Stream, text: str) -> C.Val:
    """An interpolated field as an expression: literal text and ``${! expression }`` in turn."""
    parts = parse_interpolation(str(text))
    if not parts:
        return C.lit("")
    vals = [C.lit(p) if isinstance(p, str) else C.string_of(C.compile_expr(p, stream.env())) for p in parts]
    if len(vals) == 1:
        return vals[0]
    return C.Val(F.concat(*[v.col for v in vals]), C.STRING, C.either(*[v.error for v in vals]))


def predicate(stream: Stream, text: str) -> Column:
    """A check as a boolean column; a failing check counts as false."""
    from millrace.lang.parser import parse

    mapping = parse(text)
    if len(mapping.statements) == 1 and mapping.statements[0].kind == "root" and not mapping.statements[0].path:
        v = C.truth(C.compile_expr(mapping.statements[0].value, C.replace(stream.env(), maps=mapping.maps)))
    else:
        made = C.compile_mapping(mapping, stream.env())
        v = C.truth(C.Val(made.root.col, made.root.type, C.either(made.error, made.root.error)))
    return F.coalesce(v.col if v.error is None else v.col & v.error.isNull(), F.lit(False))


Processor = Callable[[Stream, Any, "Resources"], Stream]
PROCESSORS: dict[str, Processor] = {}


def processor(*names: str):
    def put(f: Processor) -> Processor:
        PROCESSORS.update(dict.fromkeys(names, f))
        return f

    return put


def alias(new: str, old: str) -> None:
    """Let configs call a processor by a further name."""
    PROCESSORS[new] = PROCESSORS[old]


@dataclass
class Resources:
    """Named parts that configs refer to."""

    caches: dict[str, Any] = field(default_factory=dict)
    processors: dict[str, Any] = field(default_factory=dict)
    inputs: dict[str, Any] = field(default_factory=dict)
    outputs: dict[str, Any] = field(default_factory=dict)
    rate_limits: dict[str, Any] = field(default_factory=dict)
    pipes: dict[str, Stream] = field(default_factory=dict)
    observed: dict[str, Any] = field(default_factory=dict)
    responses: list = field(default_factory=list)
    imports: dict[str, str] = field(default_factory=dict)
    spark: Any = None
    allow_commands: bool = False

    def load(self, path: str) -> str:
        """The text of an imported mapping: one given by name, else that of a file, read once by the driver."""
        if path not in self.imports:
            try:
                with open(path, encoding="utf-8") as f:
                    self.imports[path] = f.read()
            except OSError as e:
                raise ConfigError(f"failed to read import {path!r}: {e}") from None
        return self.imports[path]


_own: dict[str, str] = {}


def scratch_folder(spark) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or where that is unset one of our own, on a local master alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ConfigError("spark.checkpoint.dir must name a folder that all executors see")
    if "dir" not in _own:
        import atexit
        import shutil
        import tempfile

        _own["dir"] = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def cut(stream: Stream) -> Stream:
    """Run the plan so far and go on from its rows, written to the folder of spark.checkpoint.dir; a stream goes on as it is.

    Loops need it: plans that refer to themselves several times grow with the power of the rounds.
    """
    df = stream.df
    if df.isStreaming:
        return stream
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch_folder(df.sparkSession))
    return Stream(df.checkpoint())


def named(conf: dict) -> tuple[str, Any, str]:
    """The kind, the settings and the label of a component's config."""
    label = conf.get("label", "")
    rest = {k: v for k, v in conf.items() if k not in ("label", "type", "plugin")}
    if "type" in conf and (conf["type"] in rest or not rest):
        return conf["type"], rest.get(conf["type"], {}), label
    if len(rest) != 1:
        raise ConfigError(f"a component needs exactly one kind, got {sorted(rest)}")
    kind, settings = next(iter(rest.items()))
    return kind, settings, label


def apply_processor(stream: Stream, conf: dict, res: Resources) -> Stream:
    kind, settings, label = named(conf)
    if kind not in PROCESSORS:
        raise ConfigError(f"unknown processor {kind!r}")
    out = PROCESSORS[kind](stream, settings, res)
    if label and out.has("_error"):
        e = F.col("_error")
        fresh = e.isNotNull() & (e["name"] == kind) & (F.coalesce(e["label"], F.lit("")) == "")
        out = Stream(out.df.withColumn("_error", F.when(fresh, e.withField("label", F.lit(label))).otherwise(e)))
    return out


def apply_all(stream: Stream, confs: list[dict] | None, res: Resources) -> Stream:
    for c in confs or []:
        stream = apply_processor(stream, c, res)
    return stream


__all__ = ["ConfigError", "PROCESSORS", "Resources", "Stream", "apply_all", "apply_processor", "interpolated", "named", "predicate", "processor", "replace"]
