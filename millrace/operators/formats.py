"""Processors of formats: compression, JSON Schema, grok, logs, and the query languages jq and JMESPath."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

from millrace.operators.envelope import ConfigError, Resources, Stream, processor


@processor("compress")
def compress(stream: Stream, conf, res: Resources) -> Stream:
    """Content compressed; it is text, so the bytes are in base64."""
    algorithm, level = conf["algorithm"], conf.get("level", -1)

    @F.pandas_udf("value string, error string")
    def step(c: pd.Series) -> pd.DataFrame:
        import base64

        from millrace.functions.coding import compressed

        return pd.DataFrame({"value": [base64.b64encode(compressed((x or "").encode(), algorithm, level)).decode() for x in c], "error": None})

    out = step(stream.content())
    return stream.with_content(out["value"], out["error"], "compress")


@processor("decompress")
def decompress(stream: Stream, conf, res: Resources) -> Stream:
    """Content in base64, decompressed to text."""
    algorithm = conf["algorithm"]

    @F.pandas_udf("value string, error string")
    def step(c: pd.Series) -> pd.DataFrame:
        import base64

        from millrace.functions.coding import decompressed
        from millrace.lang.values import MappingError

        out = []
        for x in c:
            try:
                out.append((decompressed(base64.b64decode(x or "", validate=True), algorithm).decode(), None))
            except (MappingError, ValueError) as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["value", "error"])

    out = step(stream.content())
    return stream.with_content(out["value"], out["error"], "decompress")


@processor("json_schema")
def json_schema(stream: Stream, conf, res: Resources) -> Stream:
    """Rows that break the schema are flagged; no content changes."""
    text = conf.get("schema") or open(conf["schema_path"].removeprefix("file://"), encoding="utf-8").read()

    @F.pandas_udf("string")
    def broken(c: pd.Series) -> pd.Series:
        from millrace.functions.parsing import check_schema, loaded_schema
        from millrace.lang.values import MappingError, from_json

        out = []
        for x in c:
            try:
                out.append("; ".join(check_schema(from_json(x or ""), loaded_schema(text))) or None)
            except MappingError as e:
                out.append(str(e))
        return pd.Series(out, dtype=object)

    return stream.flag(broken(stream.content()), "json_schema")


#: The common patterns of grok, by name.
PATTERNS = {
    "USERNAME": r"[a-zA-Z0-9._-]+",
    "USER": r"%{USERNAME}",
    "EMAILLOCALPART": r"[a-zA-Z0-9!#$%&'*+/=?^_`{|}~.-]+",
    "EMAILADDRESS": r"%{EMAILLOCALPART}@%{HOSTNAME}",
    "INT": r"[+-]?[0-9]+",
    "BASE10NUM": r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)",
    "NUMBER": r"%{BASE10NUM}",
    "BASE16NUM": r"(?:0[xX])?[0-9a-fA-F]+",
    "POSINT": r"\b[1-9][0-9]*\b",
    "NONNEGINT": r"\b[0-9]+\b",
    "WORD": r"\b\w+\b",
    "NOTSPACE": r"\S+",
    "SPACE": r"\s*",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
    "QUOTEDSTRING": r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'",
    "QS": r"%{QUOTEDSTRING}",
    "UUID": r"[A-Fa-f0-9]{8}-(?:[A-Fa-f0-9]{4}-){3}[A-Fa-f0-9]{12}",
    "MAC": r"(?:[A-Fa-f0-9]{2}[:-]){5}[A-Fa-f0-9]{2}",
    "IPV4": r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])",
    "IPV6": r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}",
    "IP": r"(?:%{IPV6}|%{IPV4})",
    "HOSTNAME": r"\b[0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62})*\.?",
    "HOST": r"%{HOSTNAME}",
    "IPORHOST": r"(?:%{IP}|%{HOSTNAME})",
    "HOSTPORT": r"%{IPORHOST}:%{POSINT}",
    "PATH": r"(?:%{UNIXPATH}|%{WINPATH})",
    "UNIXPATH": r"(?:/[\w_%!$@:.,~+-]*)+",
    "WINPATH": r"(?:[A-Za-z]:|\\)(?:\\[^\\?*]*)+",
    "URIPROTO": r"[A-Za-z]+(?:\+[A-Za-z+]+)?",
    "URIHOST": r"%{IPORHOST}(?::%{POSINT})?",
    "URIPATH": r"(?:/[A-Za-z0-9$.+!*'(){},~:;=@#%&_-]*)+",
    "URIPARAM": r"\?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\[\]<>-]*",
    "URIPATHPARAM": r"%{URIPATH}(?:%{URIPARAM})?",
    "URI": r"%{URIPROTO}://(?:%{USER}(?::[^@]*)?@)?(?:%{URIHOST})?(?:%{URIPATHPARAM})?",
    "MONTH": r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b",
    "MONTHNUM": r"0?[1-9]|1[0-2]",
    "MONTHDAY": r"(?:0[1-9]|[12][0-9]|3[01]|[1-9])",
    "DAY": r"(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)",
    "YEAR": r"(?:\d\d){1,2}",
    "HOUR": r"2[0123]|[01]?[0-9]",
    "MINUTE": r"[0-5][0-9]",
    "SECOND": r"(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?",
    "TIME": r"(?:%{HOUR}):%{MINUTE}(?::%{SECOND})?",
    "ISO8601_TIMEZONE": r"Z|[+-](?:%{HOUR})(?::?%{MINUTE})",
    "TIMESTAMP_ISO8601": r"%{YEAR}-(?:%{MONTHNUM})-%{MONTHDAY}[T ](?:%{HOUR}):?%{MINUTE}(?::?%{SECOND})?(?:%{ISO8601_TIMEZONE})?",
    "HTTPDATE": r"%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}",
    "SYSLOGTIMESTAMP": r"%{MONTH} +%{MONTHDAY} %{TIME}",
    "PROG": r"[\x21-\x5a\x5c\x5e-\x7e]+",
    "SYSLOGPROG": r"%{PROG:program}(?:\[%{POSINT:pid}\])?",
    "LOGLEVEL": r"(?:[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo|INFO|[Ww]arn(?:ing)?|WARN(?:ING)?|[Ee]rr(?:or)?|ERR(?:OR)?|[Cc]rit(?:ical)?|CRIT(?:ICAL)?|[Ff]atal|FATAL|[Ss]evere|SEVERE|[Ee]merg(?:ency)?|EMERG(?:ENCY)?)",
    "COMMONAPACHELOG": r'%{IPORHOST:clientip} %{USER:ident} %{USER:auth} \[%{HTTPDATE:timestamp}\] "(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})" %{NUMBER:response} (?:%{NUMBER:bytes}|-)',
    "COMBINEDAPACHELOG": r"%{COMMONAPACHELOG} %{QS:referrer} %{QS:agent}",
}


def grok_regex(expression: str, patterns: dict[str, str], named_only: bool = True) -> tuple[str, list[tuple[str, str]]]:
    """A grok expression as a regular expression with groups g0, g1, ..., and (path, type) of each."""
    captures: list[tuple[str, str]] = []

    def expand(text: str, depth: int) -> str:
        if depth > 40:
            raise ConfigError(f"grok pattern {expression!r} nests too deep")

        def one(m: re.Match) -> str:
            name, _, rest = m[1].partition(":")
            if name not in patterns:
                raise ConfigError(f"grok pattern {name} is not defined")
            body = expand(patterns[name], depth + 1)
            if not rest and named_only:
                return f"(?:{body})"
            path, _, kind = (rest or name).partition(":")
            captures.append((path, kind))
            return f"(?<g{len(captures) - 1}x>{body})"

        # inner captures are numbered as they are met, so the outer group is named after its body was expanded
        return re.sub(r"%\{([A-Za-z0-9_:.\[\]-]+)\}", one, text)

    return expand(expression, 0), captures


@processor("grok")
def grok(stream: Stream, conf, res: Resources) -> Stream:
    """The first expression that captures anything gives the document; none: the row is flagged."""
    patterns = (PATTERNS if conf.get("use_default_patterns", True) else {}) | (conf.get("pattern_definitions") or {})
    for path in conf.get("pattern_paths") or []:
        for line in open(path, encoding="utf-8"):
            if line.strip() and not line.startswith("#"):
                name, _, body = line.strip().partition(" ")
                patterns = patterns | {name: body}
    c = stream.content()
    found = [grok_regex(e, patterns, conf.get("named_captures_only", True)) for e in conf["expressions"]]
    if all("." not in p for _, caps in found for p, _ in caps) and len({tuple(dict.fromkeys(p for p, _ in caps)) for _, caps in found}) == 1:
        return _grok_columns(stream, c, found, conf)
    return _grok_python(stream, c, found, conf)


def _grok_columns(stream: Stream, c, found, conf) -> Stream:
    """Plain names, the same in each expression: regular expressions on columns."""
    names = list(dict.fromkeys(p for p, _ in found[0][1]))
    out = {}
    for n in names:
        col = F.lit(None).cast("string")
        for pattern, caps in reversed(found):
            groups = [_group_index(pattern, i) for i, (p, _) in enumerate(caps) if p == n]
            got = F.coalesce(*[F.nullif(F.regexp_extract(c, pattern, g), F.lit("")) for g in groups])
            col = F.when(c.rlike(pattern), got).otherwise(col)
        kind = next(k for p, k in found[0][1] if p == n)
        out[n] = col.try_cast("bigint") if kind == "int" else col.try_cast("double") if kind == "float" else col if conf.get("remove_empty_values", True) else F.coalesce(col, F.lit(""))
    hit = F.lit(False)
    for pattern, _ in found:
        hit = hit | c.rlike(pattern)
    error = F.when(~F.coalesce(hit, F.lit(False)), F.lit("no pattern matches found"))
    s = Stream(stream.df.select(*stream.envelope, *[v.alias(n) for n, v in out.items()], error.alias("_e")))
    return s.flag(F.col("_e"), "grok").without("_e")


def _group_index(pattern: str, i: int) -> int:
    """The number of the group named g<i>x."""
    n, at, in_class = 0, 0, False
    while at < len(pattern):
        ch = pattern[at]
        if ch == "\\":
            at += 2
            continue
        in_class = ch == "[" or in_class and ch != "]"
        if ch == "(" and not in_class:
            named = re.match(r"\(\?<(g\d+x)>", pattern[at:])
            if named or not pattern.startswith("(?", at):
                n += 1
                if named and named[1] == f"g{i}x":
                    return n
        at += 1
    raise ConfigError(f"no group {i}")


def _grok_python(stream: Stream, c, found, conf) -> Stream:
    remove = conf.get("remove_empty_values", True)

    @F.pandas_udf("value string, error string")
    def step(content: pd.Series) -> pd.DataFrame:
        import regex as wide

        from millrace.lang.values import to_json, write_path

        compiled = [(wide.compile(p), caps) for p, caps in found]
        out = []
        for x in content:
            doc: dict = {}
            for p, caps in compiled:
                m = p.search(x or "")
                if not m:
                    continue
                for i, (path, kind) in enumerate(caps):
                    v = m[f"g{i}x"]
                    if v is None or (v == "" and remove):
                        continue
                    if kind == "int":
                        v = int(v)
                    elif kind == "float":
                        v = float(v)
                    doc = write_path(doc, path.split("."), v)
                if doc:
                    break
            out.append((to_json(doc), None) if doc else (None, "no pattern matches found"))
        return pd.DataFrame(out, columns=["value", "error"])

    out = step(c)
    return stream.with_content(out["value"], out["error"], "grok")


#: Names of syslog facilities and severities are not resolved; their numbers are given.
_RFC5424 = r"^<(\d{1,3})>(\d{1,2}) (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: (?s:(.*)))?$"
_RFC3164 = r"^<(\d{1,3})>((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d \d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}T\S+) (\S+) ([^\s:\[]+)(?:\[([^\]]*)\])?: ?(?s:(.*))$"


@processor("parse_log")
def parse_log(stream: Stream, conf, res: Resources) -> Stream:
    """Syslog lines of RFC 5424 or RFC 3164 into fields; with ``best_effort`` (default) a line keeps what was found, else it is flagged."""
    c = stream.content()
    kind = conf.get("format", "syslog_rfc5424")
    field = lambda p, i: F.nullif(F.nullif(F.regexp_extract(c, p, i), F.lit("")), F.lit("-"))
    if kind == "syslog_rfc5424":
        p, priority = _RFC5424, F.regexp_extract(c, _RFC5424, 1).try_cast("bigint")
        cols = {
            "version": field(p, 2).try_cast("bigint"), "timestamp": field(p, 3), "hostname": field(p, 4), "appname": field(p, 5), "procid": field(p, 6), "msgid": field(p, 7),
            "structureddata": field(p, 8), "message": field(p, 9),
        }
    elif kind == "syslog_rfc3164":
        p, priority = _RFC3164, F.regexp_extract(c, _RFC3164, 1).try_cast("bigint")
        year = conf.get("default_year", "current")
        y = F.date_format(F.current_timestamp(), "yyyy") if year == "current" else F.lit(str(year))
        stamp = field(p, 2)
        short = F.try_to_timestamp(F.concat_ws(" ", y, F.regexp_replace(stamp, " +", " ")), F.lit("yyyy MMM d HH:mm:ss"))
        cols = {"timestamp": F.when(stamp.rlike(r"^\d"), stamp).otherwise(F.date_format(short, "yyyy-MM-dd'T'HH:mm:ss'Z'")), "hostname": field(p, 3), "appname": field(p, 4), "procid": field(p, 5), "message": field(p, 6)}
    else:
        raise ConfigError(f"unknown log format {kind!r}")
    cols = {"priority": priority, "facility": F.floor(priority / 8).cast("long"), "severity": F.pmod(priority, F.lit(8)).cast("long")} | cols
    bad = F.when(~F.coalesce(c.rlike(p), F.lit(False)), F.lit(f"failed to parse message as {kind}"))
    if conf.get("best_effort", True):
        start = F.regexp_extract(c, r"^<(\d{1,3})>", 1).try_cast("bigint")
        cols["priority"] = F.coalesce(cols["priority"], start)
        bad = F.when(start.isNull(), bad)
    s = Stream(stream.df.select(*stream.envelope, *[v.alias(n) for n, v in cols.items()], bad.alias("_e")))
    return s.flag(F.col("_e"), "parse_log").without("_e")


@lru_cache(64)
def query_step(language: str, text: str, raw: bool, output_raw: bool):
    """A jq or JMESPath query as an Arrow function of content to struct<value, error, gone>."""

    @F.pandas_udf("value string, error string, gone boolean")
    def step(c: pd.Series, meta: pd.Series) -> pd.DataFrame:
        from millrace.lang.values import from_json, to_json
        from millrace.operators import jmespath, jq

        compiled = jq.compile(text) if language == "jq" else jmespath.compile(text)
        out = []
        for x, m in zip(c, meta):
            try:
                doc = x if raw else from_json(x or "")
                if language == "jmespath":
                    out.append((to_json(jmespath.search(compiled, doc)), None, False))
                    continue
                found = list(jq.run(compiled, doc, {"metadata": dict(m) if m else {}}))
                if not found:
                    out.append((None, None, True))
                elif output_raw:
                    out.append(("".join(v if isinstance(v, str) else to_json(v) for v in found), None, False))
                else:
                    out.append((to_json(found[0] if len(found) == 1 else found), None, False))
            except Exception as e:
                out.append((None, str(e) or type(e).__name__, False))
        return pd.DataFrame(out, columns=["value", "error", "gone"])

    return step


def _queried(stream: Stream, step, name: str) -> Stream:
    s = stream.ensure("_meta")
    df = s.df.withColumn("_out", step(s.content(), F.col("_meta")))
    df = df.where(~F.col("_out.gone"))
    old = s.content()
    out = df.select(*s.envelope, F.when(F.col("_out.error").isNull(), F.col("_out.value")).otherwise(old).alias("_content"), F.col("_out.error").alias("_e"))
    return Stream(out).flag(F.col("_e"), name).without("_e")


@processor("jq")
def jq_(stream: Stream, conf, res: Resources) -> Stream:
    """No result drops the row, one replaces it, several become an array."""
    return _queried(stream, query_step("jq", conf["query"], bool(conf.get("raw")), bool(conf.get("output_raw"))), "jq")


@processor("jmespath")
def jmespath_(stream: Stream, conf, res: Resources) -> Stream:
    return _queried(stream, query_step("jmespath", conf["query"], False, False), "jmespath")
