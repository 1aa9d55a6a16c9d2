"""Processors with effects: metrics, logs, throttles, external commands and HTTP. Data passes unchanged unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from millrace.lang import compile as C
from millrace.operators.envelope import ConfigError, Resources, Stream, interpolated, processor


@processor("log")
def log(stream: Stream, conf, res: Resources) -> Stream:
    """Counts of the logged rows and one sample message, gathered while the plan runs (``res.observed``); nothing is collected for it."""
    from pyspark.sql import Observation

    name = f"log_{len(res.observed)}"
    seen = Observation(name)
    message = interpolated(stream, conf.get("message", "")).col
    res.observed[name] = {"level": conf.get("level", "INFO"), "observation": seen}
    return Stream(stream.df.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(message).alias("message")))


@processor("metric")
def metric(stream: Stream, conf, res: Resources) -> Stream:
    """counter: rows; counter_by: sum of the value; gauge and timing: its greatest and its sum. Without labels they are observed
    while the plan runs; ``metric_table`` gives them by label."""
    from pyspark.sql import Observation

    kind, name = conf["type"], conf["name"]
    value = interpolated(stream, conf.get("value", "0")).col.try_cast("double")
    seen = Observation(f"metric_{name}_{len(res.observed)}")
    aggs = {"counter": [F.count(F.lit(1)).alias("count")], "counter_by": [F.sum(value).alias("count")], "gauge": [F.max(value).alias("value")], "timing": [F.sum(value).alias("sum"), F.count(F.lit(1)).alias("count")]}
    if kind not in aggs:
        raise ConfigError(f"unknown type of metric {kind!r}")
    res.observed[name] = {"type": kind, "observation": seen}
    return Stream(stream.df.observe(seen, *aggs[kind]))


def metric_table(stream: Stream, conf: dict):
    """A metric by its labels, as a table."""
    labels = {k: interpolated(stream, v).col for k, v in (conf.get("labels") or {}).items()}
    value = interpolated(stream, conf.get("value", "0")).col.try_cast("double")
    agg = {"counter": F.count(F.lit(1)), "counter_by": F.sum(value), "gauge": F.max(value), "timing": F.sum(value)}[conf["type"]]
    return stream.df.groupBy(*[c.alias(k) for k, c in labels.items()]).agg(agg.alias(conf["name"]))


@processor("benchmark")
def benchmark(stream: Stream, conf, res: Resources) -> Stream:
    """Rows and bytes that pass, observed while the plan runs."""
    from pyspark.sql import Observation

    seen = Observation(f"benchmark_{len(res.observed)}")
    aggs = [F.count(F.lit(1)).alias("rows")]
    if (conf or {}).get("count_bytes", True):
        aggs.append(F.sum(F.octet_length(stream.content()).cast("long")).alias("bytes"))
    res.observed[f"benchmark_{len(res.observed)}"] = {"observation": seen}
    return Stream(stream.df.observe(seen, *aggs))


@processor("sleep")
def sleep(stream: Stream, conf, res: Resources) -> Stream:
    """A wait changes no data; rates are set at the source of a streaming query."""
    return stream


@processor("rate_limit")
def rate_limit(stream: Stream, conf, res: Resources) -> Stream:
    """A named limit must exist; the rate itself is set at the source of a streaming query (``streaming.rates``)."""
    if conf["resource"] not in res.rate_limits:
        raise ConfigError(f"unknown rate limit {conf['resource']!r}")
    return stream


@processor("sync_response")
def sync_response(stream: Stream, conf, res: Resources) -> Stream:
    """The rows as they are now are kept for the caller."""
    res.responses.append(stream)
    return stream


@processor("crash")
def crash(stream: Stream, conf, res: Resources) -> Stream:
    """Any row stops the query with the message."""
    text = interpolated(stream, conf if isinstance(conf, str) else "crashed").col
    stopped = F.raise_error(text).cast("boolean")
    return Stream(stream.df.where(F.coalesce(stopped, F.lit(True))))


def _allowed(res: Resources, what: str) -> None:
    if not res.allow_commands:
        raise ConfigError(f"{what} runs programs of the config; set allow_commands to let it")


@processor("command")
def command(stream: Stream, conf, res: Resources) -> Stream:
    """A program run once a row with the content on its standard input; its output is the new content."""
    _allowed(res, "command")
    name, args = conf["name"], conf.get("args_mapping")
    arguments = C.json_text(C.compile_expr(C.P.parse_expression(args), stream.env())) if args else F.lit("[]")

    @F.pandas_udf("value string, error string")
    def step(content: pd.Series, arguments: pd.Series) -> pd.DataFrame:
        import json
        import subprocess

        out = []
        for c, a in zip(content, arguments):
            try:
                done = subprocess.run([name, *map(str, json.loads(a))], input=(c or "").encode(), capture_output=True, timeout=300)
                out.append((done.stdout.decode("utf-8", "replace"), None) if done.returncode == 0 else (None, f"exit code {done.returncode}: {done.stderr.decode('utf-8', 'replace')[:500]}"))
            except (OSError, subprocess.SubprocessError) as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["value", "error"])

    out = step(stream.content(), arguments)
    return stream.with_content(out["value"], out["error"], "command")


@processor("subprocess")
def subprocess_(stream: Stream, conf, res: Resources) -> Stream:
    """A program that lives as long as a partition's batch: a line in for each row, a line out."""
    _allowed(res, "subprocess")
    argv = [conf["name"], *conf.get("args", [])]

    @F.pandas_udf("value string, error string")
    def step(content: pd.Series) -> pd.DataFrame:
        import subprocess

        lines = [(c or "").replace("\n", " ") for c in content]
        done = subprocess.run(argv, input="".join(x + "\n" for x in lines).encode(), capture_output=True, timeout=600)
        got = done.stdout.decode("utf-8", "replace").split("\n")[: len(lines)]
        got += [None] * (len(lines) - len(got))
        return pd.DataFrame([(g, None) if g is not None else (None, "the program gave no line") for g in got], columns=["value", "error"])

    out = step(stream.content())
    return stream.with_content(out["value"], out["error"], "subprocess")


@processor("http")
def http(stream: Stream, conf, res: Resources) -> Stream:
    """A request a row with the content as body; the response is the new content, a status past 299 flags the row."""
    url = interpolated(stream, conf["url"]).col
    verb, headers, retries = conf.get("verb", "POST"), dict(conf.get("headers") or {}), int(conf.get("retries", 3))

    @F.pandas_udf("value string, error string")
    def step(content: pd.Series, urls: pd.Series) -> pd.DataFrame:
        import time
        import urllib.error
        import urllib.request

        out = []
        for c, u in zip(content, urls):
            got = (None, "not sent")
            for attempt in range(retries + 1):
                try:
                    request = urllib.request.Request(u, data=None if verb == "GET" else (c or "").encode(), headers=headers, method=verb)
                    with urllib.request.urlopen(request, timeout=float(conf.get("timeout_s", 5))) as r:
                        got = (r.read().decode("utf-8", "replace"), None)
                    break
                except urllib.error.HTTPError as e:
                    got = (None, f"HTTP request returned unexpected response code ({e.code})")
                    if e.code < 500 and e.code != 429:
                        break
                except OSError as e:
                    got = (None, str(e))
                time.sleep(min(2**attempt * 0.1, 2))
            out.append(got)
        return pd.DataFrame(out, columns=["value", "error"])

    out = step(stream.content(), url)
    return stream.with_content(out["value"], out["error"], "http")
