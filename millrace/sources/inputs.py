"""Inputs: configs to streams."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from millrace.operators.envelope import ConfigError, Resources, Stream, apply_all, named, predicate

INPUTS: dict[str, Callable[[Any, Resources], Stream]] = {}


def input_(*names: str):
    def put(f):
        INPUTS.update(dict.fromkeys(names, f))
        return f

    return put


def read(conf: dict, res: Resources) -> Stream:
    processors = conf.get("processors")
    kind, settings, _ = named({k: v for k, v in conf.items() if k != "processors"})
    if kind not in INPUTS:
        raise ConfigError(f"unknown input {kind!r}")
    return apply_all(INPUTS[kind](settings if settings is not None else {}, res), processors, res)


@input_("parquet")
def parquet(conf, res: Resources) -> Stream:
    """Typed tables; filters and columns reach the scan."""
    df = res.spark.read.parquet(*conf["paths"])
    return Stream.of(df, conf.get("seq"), conf.get("batch"))


@input_("file")
def file(conf, res: Resources) -> Stream:
    from millrace.sources.scanners import scan

    return scan(res.spark, conf["paths"], conf.get("scanner"))


@input_("csv")
def csv(conf, res: Resources) -> Stream:
    """CSV with a header: fields by name, all text; without one: documents that are arrays of text.

    Quoted fields may hold line breaks, so a file is read by one task; ``multi_line: false`` promises that none does, and
    large files are split."""
    if not conf.get("parse_header_row", True):
        from millrace.sources.scanners import scan

        return scan(res.spark, conf["paths"], {"csv": {"parse_header_row": False, "custom_delimiter": conf.get("delimiter", ","), "lazy_quotes": conf.get("lazy_quotes")}})
    options = {"header": True, "sep": conf.get("delimiter", ","), "inferSchema": False, "escape": '"', "multiLine": conf.get("multi_line", True)}
    parts = [res.spark.read.options(**options).csv(p) for p in conf["paths"]]
    df = parts[0]
    for other in parts[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    return Stream(df.withColumn("_seq", F.monotonically_increasing_id()))


@input_("generate")
def generate(conf, res: Resources) -> Stream:
    """``count`` rows of a mapping without a document; ``batch_size`` tells them into batches."""
    from millrace.operators.rows import mapping

    n = int(conf.get("count", 0))
    if n <= 0:
        raise ConfigError("generate needs a count; an endless one is a streaming source (streaming.rates)")
    df = res.spark.range(n).select(F.col("id").alias("_seq"), F.floor(F.col("id") / int(conf.get("batch_size", 1))).cast("string").alias("_batch"))
    return mapping(Stream(df), conf["mapping"], res)


@input_("broker")
def broker(conf, res: Resources) -> Stream:
    """All rows of all inputs, each input ``copies`` times."""
    parts = [read(c, res) for _ in range(int(conf.get("copies", 1))) for c in conf["inputs"]]
    out = parts[0].union(*parts[1:])
    return batches(out, conf.get("batching"), res)


def batches(stream: Stream, policy: dict | None, res: Resources) -> Stream:
    from millrace.operators.batches import batched

    return batched(stream, policy, res) if policy else stream


@input_("batched")
def batched_(conf, res: Resources) -> Stream:
    return batches(read(conf["child"], res), conf["policy"], res)


@input_("sequence")
def sequence(conf, res: Resources) -> Stream:
    """Inputs one after the other, or merged by id (``sharded_join``); iterations are not needed, as the shuffle spills."""
    parts = [read(c, res) for c in conf["inputs"]]
    join = conf.get("sharded_join") or {}
    if join.get("type", "none") != "none":
        from millrace.operators.lookups import merge_join

        return merge_join(parts, join["id_path"], join["type"], join.get("merge_strategy", "array"))
    out = None
    for i, s in enumerate(parts):
        s = s.ensure("_seq")
        text = F.col("_seq").cast("string")
        s = Stream(s.df.withColumn("_seq", F.concat(F.lpad(F.lit(str(i)), 6, "0"), F.lit("/"), F.lpad(text, 24, "0"))))
        out = s if out is None else out.union(s)
    return out


@input_("read_until")
def read_until(conf, res: Resources) -> Stream:
    """Rows up to and with the first for which the check holds, in the order of ``_seq``.

    The first such row is one aggregate; no running window over all rows is needed.
    """
    s = read(conf["input"], res).ensure("_seq")
    hit = predicate(s, conf["check"])
    first = s.df.where(hit).agg(F.min("_seq").alias("_stop"))
    return Stream(s.df.crossJoin(F.broadcast(first)).where(F.col("_stop").isNull() | (F.col("_seq") <= F.col("_stop"))).drop("_stop"))  # one row is broadcast


@input_("inproc")
def inproc(conf, res: Resources) -> Stream:
    if conf not in res.pipes:
        raise ConfigError(f"nothing was written to {conf!r}")
    return res.pipes[conf]


@input_("resource")
def resource(conf, res: Resources) -> Stream:
    if conf not in res.inputs:
        raise ConfigError(f"unknown input resource {conf!r}")
    found = res.inputs[conf]
    return found if isinstance(found, Stream) else read(found, res)


@input_("dynamic")
def dynamic(conf, res: Resources) -> Stream:
    """The inputs that are registered now, each row with the name of its input in metadata."""
    out = None
    for name, c in (conf.get("inputs") or {}).items():
        s = read(c, res).ensure("_meta")
        s = Stream(s.df.withColumn("_meta", F.map_concat(F.map_filter("_meta", lambda k, _: k != "dynamic_input"), F.create_map(F.lit("dynamic_input"), F.lit(name)))))
        out = s if out is None else out.union(s)
    if out is None:
        raise ConfigError("no input is registered")
    return out


def local_rows(res: Resources, texts: list[str]) -> Stream:
    return Stream(res.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_seq long, _content string"))


@input_("stdin")
def stdin(conf, res: Resources) -> Stream:
    """What the driver's standard input holds, cut by a scanner."""
    import sys

    from millrace.sources.scanners import cut

    kind, settings, _ = named(conf.get("scanner") or {"lines": {}})
    return local_rows(res, [c for c, _ in cut(kind, settings or {}, sys.stdin.buffer.read())])


@input_("subprocess")
def subprocess_(conf, res: Resources) -> Stream:
    """The output of a program that the driver runs, cut into lines."""
    import subprocess

    from millrace.sources.scanners import cut

    if not res.allow_commands:
        raise ConfigError("subprocess runs programs of the config; set allow_commands to let it")
    done = subprocess.run([conf["name"], *conf.get("args", [])], capture_output=True, check=True, timeout=float(conf.get("timeout_s", 600)))
    return local_rows(res, [c for c, _ in cut("lines", {}, done.stdout)])


@input_("http_client")
def http_client(conf, res: Resources) -> Stream:
    """One request; the body is one row, or cut by a scanner."""
    import urllib.request

    from millrace.sources.scanners import cut

    payload = conf.get("payload")
    request = urllib.request.Request(conf["url"], data=payload.encode() if payload else None, headers=dict(conf.get("headers") or {}), method=conf.get("verb", "GET"))
    with urllib.request.urlopen(request, timeout=float(conf.get("timeout_s", 5))) as r:
        body = r.read()
    if not body and conf.get("drop_empty_bodies", True):
        return local_rows(res, [])
    kind, settings, _ = named(conf.get("scanner") or {"to_the_end": {}})
    return local_rows(res, [c for c, _ in cut(kind, settings or {}, body)])


@input_("socket")
def socket_(conf, res: Resources) -> Stream:
    """Lines of a TCP or unix socket until the other side closes."""
    import socket

    from millrace.sources.scanners import cut

    family = socket.AF_UNIX if conf.get("network") == "unix" else socket.AF_INET
    with socket.socket(family, socket.SOCK_STREAM) as s:
        s.settimeout(float(conf.get("timeout_s", 30)))
        s.connect(conf["address"] if family == socket.AF_UNIX else tuple([conf["address"].rpartition(":")[0], int(conf["address"].rpartition(":")[2])]))
        data = b""
        while chunk := s.recv(1 << 16):
            data += chunk
    return local_rows(res, [c for c, _ in cut("lines", {}, data)])


@input_("http_server")
def http_server(conf, res: Resources) -> Stream:
    from millrace.sources.net import http_received

    return local_rows(res, http_received(conf))


@input_("socket_server")
def socket_server(conf, res: Resources) -> Stream:
    from millrace.sources.net import socket_received

    return local_rows(res, socket_received(conf))


@input_("websocket")
def websocket(conf, res: Resources) -> Stream:
    from millrace.sources.net import websocket_received

    return local_rows(res, websocket_received(conf))
