"""Outputs: streams to sinks. Writing is an action; ``write`` returns what became of the rows."""

from __future__ import annotations

import itertools
import re
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from millrace.operators.envelope import ConfigError, Resources, Stream, apply_all, interpolated, named, predicate

OUTPUTS: dict[str, Callable[[Stream, Any, Resources], None]] = {}


class Rejected(Exception):
    """Rows that a sink refuses; the source keeps them."""


def output(*names: str):
    def put(f):
        OUTPUTS.update(dict.fromkeys(names, f))
        return f

    return put


def write(stream: Stream, conf: dict, res: Resources) -> None:
    processors = conf.get("processors")
    kind, settings, _ = named({k: v for k, v in conf.items() if k != "processors"})
    if kind not in OUTPUTS:
        raise ConfigError(f"unknown output {kind!r}")
    OUTPUTS[kind](apply_all(stream, processors, res), settings if settings is not None else {}, res)


@output("parquet")
def parquet(stream: Stream, conf, res: Resources) -> None:
    stream.df.write.mode(conf.get("mode", "append")).parquet(conf["path"])


@output("file")
def file(stream: Stream, conf, res: Resources) -> None:
    """Text under a folder, a line a row; where the path has an interpolation, a folder for each of its values. ``codec``: lines,
    all-bytes (a file a row), append, or delim:x."""
    path, codec = conf["path"], conf.get("codec", "lines")
    sep = codec[6:] if codec.startswith("delim:") else "\n"
    content = stream.content().alias("value")
    if "${!" not in path:
        stream.df.select(content).write.mode("append").option("lineSep", sep).text(path)
        return
    fixed = path[: path.index("${!")].rpartition("/")[0]
    name = interpolated(stream, path[len(fixed) + 1 :]).col
    stream.df.select(content, name.alias("name")).write.mode("append").option("lineSep", sep).partitionBy("name").text(fixed)


@output("drop")
def drop(stream: Stream, conf, res: Resources) -> None:
    stream.df.write.format("noop").mode("overwrite").save()


@output("stdout")
def stdout(stream: Stream, conf, res: Resources) -> None:
    """Rows printed by the driver, fetched partition by partition."""
    for r in stream.df.select(stream.content().alias("c")).toLocalIterator():
        print(r["c"])


@output("inproc")
def inproc(stream: Stream, conf, res: Resources) -> None:
    res.pipes[conf] = stream


@output("sync_response")
def sync_response(stream: Stream, conf, res: Resources) -> None:
    res.responses.append(stream)


@output("resource")
def resource(stream: Stream, conf, res: Resources) -> None:
    if conf not in res.outputs:
        raise ConfigError(f"unknown output resource {conf!r}")
    write(stream, res.outputs[conf], res)


@output("dynamic")
def dynamic(stream: Stream, conf, res: Resources) -> None:
    """Every output that is registered now gets all rows."""
    for c in (conf.get("outputs") or {}).values():
        write(stream, c, res)


@output("broker")
def broker(stream: Stream, conf, res: Resources) -> None:
    """fan_out (all outputs get all rows), fan_out_sequential (one after the other), their fail_fast forms, round_robin (batches in
    turn) and greedy (rows dealt by hash)."""
    outs = [c for c in conf["outputs"] for _ in range(int(conf.get("copies", 1)))]
    pattern = conf.get("pattern", "fan_out")
    if pattern.startswith("fan_out"):
        failed = []
        for c in outs:
            try:
                write(stream, c, res)
            except Exception as e:
                if pattern.endswith("fail_fast"):
                    raise
                failed.append(e)
        if failed:
            raise failed[0]
        return
    s = stream.ensure("_seq", "_batch")
    if pattern == "round_robin":
        from pyspark.sql import Window

        firsts = s.df.groupBy("_batch").agg(F.min("_seq").alias("_first"))
        turn = firsts.withColumn("_arm", (F.row_number().over(Window.orderBy("_first")) - 1) % len(outs)).drop("_first")  # one row a batch
        dealt = s.df.join(turn, "_batch")
    elif pattern == "greedy":
        dealt = s.df.withColumn("_arm", F.pmod(F.xxhash64("_seq"), F.lit(len(outs))))
    else:
        raise ConfigError(f"unknown broker pattern {pattern!r}")
    for i, c in enumerate(outs):
        write(Stream(dealt.where(F.col("_arm") == i).drop("_arm")), c, res)


def routed(stream: Stream, cases: list[dict], strict: bool = False) -> list[Stream]:
    """The rows for each case: those whose check holds and that no earlier case without ``continue`` took."""
    arms, rest = [], stream
    for case in cases:
        hit = predicate(rest, case["check"]) if case.get("check") else F.lit(True)
        tagged = rest.df.withColumn("_arm", hit)
        arms.append(Stream(tagged.where("_arm").drop("_arm")))
        if not case.get("continue"):
            rest = Stream(tagged.where(~F.col("_arm")).drop("_arm"))
    if strict and not rest.df.isEmpty():
        raise Rejected("no switch output condition was met by a message")
    return arms


@output("switch")
def switch(stream: Stream, conf, res: Resources) -> None:
    """Rows no case takes are dropped, or refused in ``strict_mode``."""
    for case, own in zip(conf["cases"], routed(stream, conf["cases"], bool(conf.get("strict_mode")))):
        write(own, case["output"], res)


@output("fallback")
def fallback(stream: Stream, conf, res: Resources) -> None:
    """The first output that takes the rows; later ones see the error in metadata."""
    for i, c in enumerate(conf):
        try:
            return write(stream, c, res)
        except Exception as e:
            if i == len(conf) - 1:
                raise
            s = stream.ensure("_meta")
            stream = Stream(s.df.withColumn("_meta", F.map_concat(F.map_filter("_meta", lambda k, _: k != "fallback_error"), F.create_map(F.lit("fallback_error"), F.lit(str(e)[:500])))))


@output("retry")
def retry(stream: Stream, conf, res: Resources) -> None:
    """The write again, after waits of up to three seconds, ``max_retries`` times at most (unset or 0: no limit)."""
    most = int(conf.get("max_retries") or 0)
    wait = 0.1
    for attempt in itertools.count():
        try:
            return write(stream, conf["output"], res)
        except Exception:
            if most and attempt == most:
                raise
            time.sleep(min(wait, 3))
            wait *= 2


@output("drop_on")
def drop_on(stream: Stream, conf, res: Resources) -> None:
    """Rows are given up if the write fails (``error``) or fails with one of ``error_patterns``."""
    try:
        write(stream, conf["output"], res)
    except Exception as e:
        if conf.get("error") or any(re.search(p, str(e)) for p in conf.get("error_patterns") or []):
            return
        raise


@output("reject")
def reject(stream: Stream, conf, res: Resources) -> None:
    row = stream.df.select(interpolated(stream, conf if isinstance(conf, str) else "rejected").col.alias("why")).head(1)
    if row:
        raise Rejected(row[0]["why"])


@output("reject_errored")
def reject_errored(stream: Stream, conf, res: Resources) -> None:
    """Rows that are well are written; if any failed the write is refused afterwards."""
    s = stream.ensure("_error")
    write(Stream(s.df.where("_error IS NULL")), conf, res)
    bad = s.df.where("_error IS NOT NULL").select("_error.message").head(1)
    if bad:
        raise Rejected(f"rejecting message due to failed processing: {bad[0]['message']}")


@output("cache")
def cache(stream: Stream, conf, res: Resources) -> None:
    from millrace.operators.lookups import put_rows

    s = stream.ensure("_seq")
    rows = s.df.select(interpolated(s, conf["key"]).col.alias("key"), s.content().alias("value"), "_seq")
    last = rows.groupBy("key").agg(F.max_by("value", "_seq").alias("value"))
    put_rows(res, conf["target"], last)


def _each_partition(stream: Stream, send: Callable) -> None:
    stream.df.select(stream.content().alias("c")).foreachPartition(lambda rows: send([r["c"] or "" for r in rows]))


@output("subprocess")
def subprocess_(stream: Stream, conf, res: Resources) -> None:
    if not res.allow_commands:
        raise ConfigError("subprocess runs programs of the config; set allow_commands to let it")
    argv = [conf["name"], *conf.get("args", [])]

    def send(lines):
        import subprocess

        subprocess.run(argv, input="".join(x + "\n" for x in lines).encode(), check=True, timeout=600)

    _each_partition(stream, send)


@output("socket")
def socket_(stream: Stream, conf, res: Resources) -> None:
    network, address = conf.get("network", "tcp"), conf["address"]

    def send(lines):
        import socket

        kind = socket.SOCK_DGRAM if network == "udp" else socket.SOCK_STREAM
        family = socket.AF_UNIX if network == "unix" else socket.AF_INET
        with socket.socket(family, kind) as s:
            host, _, port = address.rpartition(":")
            s.connect(address if family == socket.AF_UNIX else (host, int(port)))
            for x in lines:
                s.sendall((x + "\n").encode())

    _each_partition(stream, send)


@output("http_client")
def http_client(stream: Stream, conf, res: Resources) -> None:
    url, verb, headers = conf["url"], conf.get("verb", "POST"), dict(conf.get("headers") or {})

    def send(bodies):
        import urllib.request

        for b in bodies:
            with urllib.request.urlopen(urllib.request.Request(url, data=b.encode(), headers=headers, method=verb), timeout=float(conf.get("timeout_s", 5))) as r:
                r.read()

    _each_partition(stream, send)


@output("http_server")
def http_server(stream: Stream, conf, res: Resources) -> None:
    from millrace.sources.net import serve

    serve(stream, conf, res)


@output("websocket")
def websocket(stream: Stream, conf, res: Resources) -> None:
    from millrace.sources.net import send_frames

    send_frames(stream, conf, res)
