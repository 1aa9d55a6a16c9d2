"""Registered queries for what the first set leaves out: scanners, inputs, outputs, caches, pass-through processors and further
functions and methods. Files are written to the shared folder and read back."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import uuid

from pyspark.sql import functions as F

from millrace.operators.envelope import Resources, Stream, scratch_folder
from millrace.plans.registry import events, fields, query, simple, table, through
from millrace.sources import inputs, outputs

# functions and methods


def typed(name: str, source: str, schema: str, text: str, sql: str) -> None:
    """A query of one mapping that runs in the interpreter: its documents are parsed by a schema."""

    def run(spark, sf_dir):
        out = through(table(spark, sf_dir, source), {"mapping": text})
        return fields(out.typed(schema) if out.raw else out)

    run.__name__ = name
    query(sql)(run)


simple("op_string_escapes", "customer", r"""
root.key = this.c_custkey
root.title = this.c_mktsegment.lowercase().capitalize()
root.html = ("&lt;a&gt; &amp; " + this.c_name).unescape_html()
root.query = ("a%20b+c " + this.c_name).unescape_url_query()
root.path = ("a b/" + this.c_name).escape_url_path()
root.unpath = "a%20b%2Fc+d".unescape_url_path()
root.joined = ["a", "b", this.c_name].filepath_join()
root.split = ("a/b/" + this.c_name).filepath_split().join("|")
root.said = "%s has %d".format(this.c_name, this.c_custkey)
root.quoted = this.c_name.quote()
root.unquoted = this.c_name.quote().unquote()
""", """SELECT c_custkey AS key, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS title, '<a> & ' || c_name AS html, 'a b c ' || c_name AS query, 'a%20b%2F' || replace(c_name, '#', '%23') AS path, 'a b/c+d' AS unpath,
'a/b/' || c_name AS joined, 'a/b/|' || c_name AS split, c_name || ' has ' || c_custkey::VARCHAR AS said, '"' || c_name || '"' AS quoted, c_name AS unquoted FROM customer""")  # fmt: skip

simple("op_string_matches", "customer", r"""
root.key = this.c_custkey
root.many = this.c_name.replace_many(["Customer", "C", "#", "-"])
root.first = this.c_name.re_replace("([A-Z])ustomer#", "$1:")
root.sub = this.c_name.re_find_all_submatch("([A-Z])(u)").index(0).index(2)
root.object = this.c_name.re_find_all_object("(?P<n>[0-9]+)").index(0).n.string()
""", "SELECT c_custkey AS key, 'C-' || substr(c_name, 10) AS many, 'C:' || substr(c_name, 10) AS first, 'u' AS sub, substr(c_name, 10) AS object FROM customer")  # fmt: skip

simple("op_number_types", "part", """
root.key = this.p_partkey
root.a = this.p_size.int16().string()
root.b = this.p_size.int8().string()
root.c = this.p_size.uint64().string()
root.d = this.p_size.uint32().string()
root.e = this.p_size.uint16().string()
root.f = this.p_size.float64() * 0.5
root.g = this.p_size.float32() * 0.5
root.bad = (0 - this.p_size).uint16().catch(-1).string()
root.tangent = (this.p_size.tan() * 1000).floor()
""", """SELECT p_partkey AS key, p_size::VARCHAR AS a, p_size::VARCHAR AS b, p_size::VARCHAR AS c, p_size::VARCHAR AS d, p_size::VARCHAR AS e, p_size * 0.5::DOUBLE AS f, p_size * 0.5::DOUBLE AS g,
CASE WHEN p_size > 0 THEN '-1' ELSE '0' END AS bad, floor(tan(p_size) * 1000)::BIGINT AS tangent FROM part""")  # fmt: skip

typed("op_object_shapes", "nation", "key int, flat string, all long, upper string, some long, squashed string, got string, next long, low boolean, there string, `or` double, one long, same string", """
root.key = this.n_nationkey
root.flat = {"a": {"b": this.n_nationkey}, "c": 1}.collapse().keys().sort().join(",")
root.all = [1, this.n_regionkey, 1].find_all(1).length()
root.upper = {"x": this.n_nationkey}.map_each_key(k -> k.uppercase()).keys().join("")
root.some = [this.n_nationkey].not_empty().length()
root.squashed = [{"a": 1}, {"b": this.n_nationkey}].squash().b.string()
root.got = {"a": {"b": this.n_name}}.get("a.b")
root.next = this.n_nationkey.map(this + 1)
root.low = (this.n_nationkey > 5).not()
root.there = this.n_name.not_null()
root.or = this.n_name.number().or(-1.0)
root.one = [this.n_name].array().length()
root.same = {"a": this.n_nationkey}.json_schema("{\\"type\\":\\"object\\"}").a.string()
""", """SELECT n_nationkey AS key, 'a.b,c' AS flat, (2 + (n_regionkey = 1)::INT)::BIGINT AS all, 'X' AS upper, 1::BIGINT AS some, n_nationkey::VARCHAR AS squashed, n_name AS got, n_nationkey + 1 AS next, n_nationkey <= 5 AS low,
n_name AS there, -1.0::DOUBLE AS or, 1::BIGINT AS one, n_nationkey::VARCHAR AS same FROM nation""".replace("AS all", 'AS "all"').replace("AS or,", 'AS "or",').replace("AS some", 'AS "some"'))  # fmt: skip

simple("op_time_names", "orders", """
root.key = this.o_orderkey
root.zone = this.o_orderdate.ts_tz("Etc/GMT+5").ts_format("2006-01-02T15:04:05")
root.parsed = this.o_orderdate.ts_format("2006-01-02").parse_timestamp("2006-01-02").ts_unix()
root.strptime = this.o_orderdate.format_timestamp_strftime("%Y/%m/%d").parse_timestamp_strptime("%Y/%m/%d").ts_unix()
root.day = this.o_orderdate.format_timestamp("2006-01-02")
root.s = this.o_orderdate.format_timestamp_unix()
root.ms = this.o_orderdate.format_timestamp_unix_milli()
root.us = this.o_orderdate.format_timestamp_unix_micro()
root.ns = this.o_orderdate.format_timestamp_unix_nano()
""", """SELECT o_orderkey AS key, strftime(o_orderdate - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S') AS zone, epoch_us(date_trunc('day', o_orderdate)) // 1000000 AS parsed, epoch_us(date_trunc('day', o_orderdate)) // 1000000 AS strptime,
strftime(o_orderdate, '%Y-%m-%d') AS day, epoch_us(o_orderdate) // 1000000 AS s, epoch_us(o_orderdate) // 1000 AS ms, epoch_us(o_orderdate) AS us, epoch_us(o_orderdate) * 1000 AS ns FROM orders""")  # fmt: skip

simple("op_parse_formats", "supplier", r"""
root.key = this.s_suppkey
root.csv = ("a,b\n1," + this.s_name).parse_csv().index(0).b.string()
root.logfmt = ("k=1 name=" + this.s_name).parse_logfmt().name.string()
root.yaml = ("a: " + this.s_suppkey.string()).parse_yaml().a.string()
root.as_yaml = {"a": this.s_suppkey}.format_yaml().string()
root.form = ("x=" + this.s_suppkey.string() + "&y=a+b").parse_form_url_encoded().y.string()
root.sealed = this.s_name.encrypt_aes("ctr", "0123456789abcdef", "0123456789abcdef").decrypt_aes("ctr", "0123456789abcdef", "0123456789abcdef").string()
root.size = this.s_name.encrypt_aes("ctr", "0123456789abcdef", "0123456789abcdef").length()
root.packed = this.s_name.compress("gzip").decompress("gzip").string()
root.id = "example.com".uuid_v5("dns")
root.shape = {"a": this.s_suppkey}.infer_schema().type()
""", """SELECT s_suppkey AS key, s_name AS csv, s_name AS logfmt, s_suppkey::VARCHAR AS yaml, 'a: ' || s_suppkey::VARCHAR || chr(10) AS as_yaml, 'a b' AS form, s_name AS sealed, strlen(s_name)::BIGINT AS size, s_name AS packed,
'cfbff0d1-9375-5685-968c-48ce8b15ae17' AS id, 'object' AS shape FROM supplier""")  # fmt: skip

typed("op_functions_of_time_and_chance", "region", "key int, now boolean, s boolean, ms boolean, us boolean, ns boolean, dice long, v4 long, v7 long, nano long, sortable long, host boolean, home boolean, blank long, span boolean, trace string", """
root.key = this.r_regionkey
root.now = now().length() >= 20
root.s = timestamp_unix() > 1600000000
root.ms = timestamp_unix_milli() > 1600000000000
root.us = timestamp_unix_micro() > 1600000000000000
root.ns = timestamp_unix_nano() > 1600000000000000000
root.dice = random_int(min: 3, max: 3)
root.v4 = uuid_v4().length()
root.v7 = uuid_v7().length()
root.nano = nanoid().length()
root.sortable = ksuid().length()
root.host = hostname().length() > 0
root.home = env("MILLRACE_NOT_SET") == null
root.blank = bytes(3).length()
root.span = tracing_span() == null
root.trace = tracing_id()
""", """SELECT r_regionkey AS key, true AS now, true AS s, true AS ms, true AS us, true AS ns, 3::BIGINT AS dice, 36::BIGINT AS v4, 36::BIGINT AS v7, 21::BIGINT AS nano, 27::BIGINT AS sortable, true AS host, true AS home, 3::BIGINT AS blank, true AS span, '' AS trace FROM region""")  # fmt: skip

simple("op_functions_of_the_row", "supplier", """
let x = this.s_suppkey
meta tag = this.s_name
root.key = json("s_suppkey")
root.var = var("x")
root.none = nothing()
""", "SELECT s_suppkey AS key, s_suppkey AS var FROM supplier")  # fmt: skip


@query("SELECT s_suppkey AS key, s_name AS tag, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier")
def op_metadata_and_count(spark, sf_dir):
    s = Stream.of(table(spark, sf_dir, "supplier"), "s_suppkey")
    procs = [{"mapping": "meta tag = this.s_name\nroot.key = this.s_suppkey"}, {"mapping": 'root.key = this.key\nroot.tag = metadata("tag")\nroot.n = count("suppliers")'}]
    return fields(through(s, *procs))


@query("SELECT event_id AS id, CASE WHEN value > 50 THEN 'mapping' END AS source, CASE WHEN value > 50 THEN 'checks' END AS label FROM events")
def op_error_source(spark, sf_dir):
    procs = [{"label": "checks", "mutation": 'root.checked = if this.value > 50 { throw("too much") } else { "ok" }'}, {"mapping": 'root.id = this.event_id\nroot.source = if error_source_name() == "mutation" { "mapping" } else { null }\nroot.label = error_source_label()'}]
    return fields(through(events(spark, sf_dir), *procs)).select("id", "source", "label")


# processors that change nothing, and those that gather


@query("SELECT event_id AS id, value FROM events")
def op_pass_through(spark, sf_dir):
    res = Resources(spark=spark, rate_limits={"slow": {"local": {"count": 1}}}, processors={"same": {"noop": {}}})
    quiet = [{"noop": {}}, {"log": {"message": "seen ${! this.event_id }"}}, {"benchmark": {}}, {"sleep": {"duration": "1ms"}}, {"rate_limit": {"resource": "slow"}}, {"resource": "same"}, {"metric": {"type": "counter", "name": "n"}}]
    out = through(events(spark, sf_dir), {"processors": quiet}, {"parallel": {"processors": [{"noop": {}}]}}, {"sync_response": {}}, res=res)
    return out.df.select(F.col("event_id").alias("id"), "value")


@query("SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'no clicks' ELSE 'fine' END AS state FROM events")
def op_try_catch_metadata(spark, sf_dir):
    conf = {"processors": [{"mutation": 'root.state = if this.event_type == "click" { throw("no clicks") } else { "fine" }'}], "catch": [{"mutation": "root.state = @error"}]}
    out = through(events(spark, sf_dir).without("ts", "props"), {"mutation": 'root.state = ""'}, {"try_catch": conf})
    return out.df.select(F.col("event_id").alias("id"), F.col("state"))


@query("SELECT c_custkey AS key, c_mktsegment AS why FROM customer WHERE c_acctbal < 0")
def op_workflow_record(spark, sf_dir):
    """Branches that fail are told by name; their rows keep what they had."""
    branches = {"debt": {"request_map": "root.b = this.c_acctbal", "processors": [{"mapping": 'root.r = if this.b < 0 { throw("owes") } else { this.b }'}], "result_map": "root.balance = this.r"}}
    out = through(table(spark, sf_dir, "customer"), {"workflow": {"branches": branches}})
    return out.df.where("meta.workflow.failed['debt'] IS NOT NULL AND meta.workflow.succeeded IS NULL").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("why"))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND) + INTERVAL '1 hour', '%Y-%m-%dT%H:%M:%SZ') AS window_end, count(*) AS n FROM events GROUP BY 1")
def op_window_expression(spark, sf_dir):
    from millrace.streaming.windows import system_window

    out = system_window(events(spark, sf_dir), {"timestamp_mapping": 'root = this.ts.ts_add_iso8601("PT1H")', "size": "1h"})
    return out.df.groupBy(F.col("_batch").alias("window_end")).agg(F.count("*").alias("n"))


# scanners: the nations in files of each format


def _tar(names) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n in names:
            info = tarfile.TarInfo(n)
            info.size = len(n)
            t.addfile(info, io.BytesIO(n.encode()))
    return out.getvalue()


_EACH = "SELECT n_name AS content FROM nation"
_AS_JSON = "SELECT '{\"key\":' || n_nationkey::VARCHAR || ',\"name\":\"' || n_name || '\"}' AS content FROM nation"
_lines = lambda rows: "".join(f"{n}\n" for _, n in rows).encode()
_json = lambda rows: [json.dumps({"key": k, "name": n}, separators=(",", ":")) for k, n in rows]
SCANS = {
    "lines": ({"lines": {}}, _lines, _EACH),
    "lines_delimited": ({"lines": {"custom_delimiter": "|"}}, lambda rows: "|".join(n for _, n in rows).encode(), _EACH),
    "to_the_end": ({"to_the_end": {}}, lambda rows: ",".join(n for _, n in rows).encode(), "SELECT string_agg(n_name, ',' ORDER BY n_nationkey) AS content FROM nation"),
    "chunker": ({"chunker": {"size": 8}}, lambda rows: "".join(n[:8].ljust(8) for _, n in rows).encode(), "SELECT rpad(left(n_name, 8), 8, ' ') AS content FROM nation"),
    "csv": ({"csv": {}}, lambda rows: ("key,name\n" + "".join(f'{k},"{n}"\n' for k, n in rows)).encode(), "SELECT '{\"key\":\"' || n_nationkey::VARCHAR || '\",\"name\":\"' || n_name || '\"}' AS content FROM nation"),
    "decompress": ({"decompress": {"algorithm": "gzip", "into": {"lines": {}}}}, lambda rows: gzip.compress(_lines(rows)), _EACH),
    "json_array": ({"json_array": {}}, lambda rows: f"[{','.join(_json(rows))}]".encode(), _AS_JSON),
    "json_documents": ({"json_documents": {}}, lambda rows: "\n".join(_json(rows)).encode(), _AS_JSON),
    "re_match": ({"re_match": {"pattern": "^--"}}, lambda rows: "".join(f"--{n}\n" for _, n in rows).encode(), "SELECT '--' || n_name || chr(10) AS content FROM nation"),
    "skip_bom": ({"skip_bom": {"into": {"lines": {}}}}, lambda rows: b"\xef\xbb\xbf" + _lines(rows), _EACH),
    "switch": ({"switch": [{"re_match_name": r"\.tar$", "scanner": {"tar": {}}}, {"scanner": {"lines": {}}}]}, _lines, _EACH),
    "tar": ({"tar": {}}, lambda rows: _tar([n for _, n in rows]), _EACH),
}


def _file_of_nations(spark, sf_dir: str, make) -> str:
    """A file of all nations (a table of fixed size), written by the driver."""
    from pyarrow import fs

    rows = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]
    folder = f"{scratch_folder(spark)}/scans-{uuid.uuid4().hex}"
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root)
    with files.open_output_stream(f"{root}/nations.txt") as out:
        out.write(make(rows))
    return f"{folder}/nations.txt"


for _kind, (_conf, _make, _sql) in SCANS.items():

    def _scan(spark, sf_dir, conf=_conf, make=_make):
        out = inputs.read({"file": {"paths": [_file_of_nations(spark, sf_dir, make)], "scanner": conf}}, Resources(spark=spark))
        return out.df.select(F.col("_content").alias("content"))

    _scan.__name__ = f"scan_{_kind}"
    query(_sql)(_scan)


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def in_csv(spark, sf_dir):
    path = _file_of_nations(spark, sf_dir, lambda rows: ("key,name\n" + "".join(f'{k},"{n}"\n' for k, n in rows)).encode())
    return fields(inputs.read({"csv": {"paths": [path]}}, Resources(spark=spark)))


def _nations(spark, sf_dir) -> Stream:
    return Stream.of(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")), "key")


_NATIONS = "SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation"


def _input(name: str, conf, sql: str = _NATIONS):
    def run(spark, sf_dir):
        s = _nations(spark, sf_dir)
        res = Resources(spark=spark, inputs={"nations": s}, pipes={"pipe": s})
        return inputs.read(conf, res).df.select("key", "name")

    run.__name__ = name
    query(sql)(run)


_input("in_resource", {"resource": "nations"})
_input("in_inproc", {"inproc": "pipe"})
_input("in_dynamic", {"dynamic": {"inputs": {"a": {"resource": "nations"}, "b": {"inproc": "pipe"}}}}, f"{_NATIONS} UNION ALL {_NATIONS}")
_input("in_broker_copies", {"broker": {"copies": 2, "inputs": [{"resource": "nations"}]}}, f"{_NATIONS} UNION ALL {_NATIONS}")


@query("SELECT (n_nationkey // 10)::VARCHAR AS part, count(*) AS n FROM nation GROUP BY 1")
def in_batched(spark, sf_dir):
    s = inputs.read({"batched": {"child": {"resource": "nations"}, "policy": {"count": 10}}}, Resources(spark=spark, inputs={"nations": _nations(spark, sf_dir)}))
    return s.df.groupBy(F.element_at(F.split("_batch", "/"), -1).alias("part")).agg(F.count("*").alias("n"))


# outputs: the nations written, then read back


def _output(name: str, conf, sql: str = _NATIONS, first=()):
    """conf: from the folder to write to, to the output's config."""

    def run(spark, sf_dir):
        folder = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
        res = Resources(spark=spark, outputs={"sink": {"parquet": {"path": folder}}})
        try:
            outputs.write(through(_nations(spark, sf_dir), *first), conf({"parquet": {"path": folder}}), res)
        except outputs.Rejected:
            pass  # what was written before stays
        return spark.read.parquet(folder).select("key", "name")

    run.__name__ = name
    query(sql)(run)


_TWICE = f"{_NATIONS} UNION ALL {_NATIONS}"
_output("out_parquet", lambda sink: sink)
_output("out_resource", lambda sink: {"resource": "sink"})
_output("out_dynamic", lambda sink: {"dynamic": {"outputs": {"a": sink, "b": {"drop": {}}}}})
_output("out_broker_fan_out", lambda sink: {"broker": {"outputs": [sink, sink]}}, _TWICE)
_output("out_broker_fan_out_sequential", lambda sink: {"broker": {"pattern": "fan_out_sequential", "copies": 2, "outputs": [sink]}}, _TWICE)
_output("out_broker_round_robin", lambda sink: {"broker": {"pattern": "round_robin", "outputs": [sink, sink]}})
_output("out_broker_greedy", lambda sink: {"broker": {"pattern": "greedy", "outputs": [sink, {"resource": "sink"}]}})
_output("out_fallback", lambda sink: {"fallback": [{"reject": "not here"}, sink]})
_output("out_retry", lambda sink: {"retry": {"max_retries": 2, "output": sink}})
_output("out_drop_on", lambda sink: {"broker": {"outputs": [{"drop_on": {"error": True, "output": {"reject": "no"}}}, sink]}})
_output("out_reject", lambda sink: {"broker": {"outputs": [sink, {"reject": "no"}]}})
_output("out_reject_errored", lambda sink: {"reject_errored": sink}, f"{_NATIONS} WHERE n_nationkey <= 10", [{"mutation": 'root.ok = if this.key > 10 { throw("large") } else { true }'}])
_output("out_switch", lambda sink: {"switch": {"cases": [{"check": "this.key < 5", "output": {"drop": {}}}, {"output": sink}]}}, f"{_NATIONS} WHERE n_nationkey >= 5")


@query("SELECT '{\"key\":' || n_nationkey::VARCHAR || ',\"name\":\"' || n_name || '\"}' AS line FROM nation")
def out_file(spark, sf_dir):
    folder = f"{scratch_folder(spark)}/out_file-{uuid.uuid4().hex}"
    outputs.write(_nations(spark, sf_dir), {"file": {"path": folder, "codec": "lines"}}, Resources(spark=spark))
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query(_NATIONS)
def out_inproc(spark, sf_dir):
    res = Resources(spark=spark)
    outputs.write(_nations(spark, sf_dir), {"inproc": "pipe"}, res)
    return inputs.read({"inproc": "pipe"}, res).df.select("key", "name")


@query(_NATIONS)
def out_sync_response(spark, sf_dir):
    res = Resources(spark=spark)
    outputs.write(_nations(spark, sf_dir), {"sync_response": {}}, res)
    return res.responses[0].df.select("key", "name")


# caches


def _cached(name: str, caches):
    """Nations put into a cache by an output, looked up by their key; ``caches``: from a folder to the caches of the config."""

    def run(spark, sf_dir):
        from millrace.operators.lookups import cache_table

        res = Resources(spark=spark, caches=caches(f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}".removeprefix("file://")))
        s = through(_nations(spark, sf_dir), {"mapping": "meta k = this.key.string()\nroot = this.name"})
        outputs.write(s, {"cache": {"target": "c", "key": "${! @k }"}}, res)
        return cache_table(res, "all" if "all" in res.caches else "c").select(F.col("key").cast("long").alias("key"), F.col("value").alias("name"))

    run.__name__ = name
    query(_NATIONS)(run)


_cached("cache_memory", lambda folder: {"c": {"memory": {}}})
_cached("cache_lru", lambda folder: {"c": {"lru": {"cap": 1000}}})
_cached("cache_ttlru", lambda folder: {"c": {"ttlru": {"cap": 1000}}})
_cached("cache_file", lambda folder: {"c": {"file": {"directory": folder}}})
_cached("cache_multilevel", lambda folder: {"c": {"memory": {}}, "d": {"noop": {}}, "all": {"multilevel": ["d", "c"]}})
