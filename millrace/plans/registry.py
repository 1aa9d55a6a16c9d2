"""Registered queries of the engine: each runs configs over the whole tables, beside DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.envelope import Resources, Stream, apply_all
from millrace.plans.pipeline import Pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def through(stream: Stream | DataFrame, *processors: dict, res: Resources | None = None) -> Stream:
    return apply_all(stream if isinstance(stream, Stream) else Stream(stream), list(processors), res or Resources(spark=(stream.df if isinstance(stream, Stream) else stream).sparkSession))


def fields(s: Stream) -> DataFrame:
    return s.df.select(*[F.col(f"`{c}`") for c in s.fields])


def simple(name: str, source: str, text: str, sql: str, kind: str = "mapping") -> None:
    """A query that is one mapping over one table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fields(through(table(spark, sf_dir, source), {kind: text}))

    run.__name__ = name
    query(sql)(run)


# mappings, predicates, sentinels

simple("op_project_mapping", "lineitem", """
root.orderkey = this.l_orderkey
root.line = this.l_linenumber
root.revenue = this.l_extendedprice * (1 - this.l_discount)
root.charge = this.l_extendedprice * (1 - this.l_discount) * (1 + this.l_tax)
root.per_unit = this.l_extendedprice / this.l_quantity
""", "SELECT l_orderkey AS orderkey, l_linenumber AS line, l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice / l_quantity AS per_unit FROM lineitem")  # fmt: skip

simple("op_mutation_order", "orders", """
root.o_totalprice = this.o_totalprice * 2
root.again = this.o_totalprice + 1
root.o_orderpriority = deleted()
""", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderdate, o_totalprice * 2 + 1 AS again FROM orders", "mutation")  # fmt: skip

simple("op_filter_deleted", "lineitem", 'root = if this.l_quantity <= 30 || this.l_returnflag != "R" { deleted() }', "SELECT * FROM lineitem WHERE NOT (l_quantity <= 30 OR l_returnflag <> 'R')")

simple("op_if_match", "orders", """
root.key = this.o_orderkey
root.size = if this.o_totalprice > 300000 { "large" } else if this.o_totalprice > 100000 { "middle" } else { "small" }
root.status = match this.o_orderstatus { "F" => "done", "O" => "open", _ => "other" }
root.urgent = match { this.o_orderpriority.has_prefix("1-") => 1, this.o_totalprice > 200000 => 2, _ => 3 }
""", """SELECT o_orderkey AS key, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size,
CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS status, CASE WHEN starts_with(o_orderpriority, '1-') THEN 1 WHEN o_totalprice > 200000 THEN 2 ELSE 3 END::BIGINT AS urgent FROM orders""")  # fmt: skip

simple("op_root_if", "orders", """
root.key = this.o_orderkey
if this.o_orderstatus == "F" {
  root.label = "finished"
  root.price = this.o_totalprice
} else {
  root.label = "running"
  root.price = 0.0
}
""", "SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'running' END AS label, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0::DOUBLE END AS price FROM orders")  # fmt: skip

# a missing value has the text "null"
simple("op_coalesce_catch", "events", """
root.id = this.event_id
root.k = this.props.parse_json().k.number() | -1.0
root.other = this.props.parse_json().missing.string().catch("none")
root.bad = this.event_type.number().catch(-1.0)
root.alt = (this.props.parse_json().missing | "fallback").string()
""", "SELECT event_id AS id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -1.0) AS k, 'null' AS other, -1.0::DOUBLE AS bad, 'fallback' AS alt FROM events")  # fmt: skip

simple("op_variables_maps", "part", """
map shape {
  root.brand = this.p_brand.lowercase()
  root.big = this.p_size > 25
}
let price = this.p_retailprice * 1.1
root = this.apply("shape")
root.key = this.p_partkey
root.gross = $price
""", "SELECT lower(p_brand) AS brand, p_size > 25 AS big, p_partkey AS key, p_retailprice * 1.1::DOUBLE AS gross FROM part")  # fmt: skip

simple("op_booleans_nulls", "part", """
root.key = this.p_partkey
root.a = this.p_size > 10 && this.p_retailprice < 1500 || this.p_brand == null
root.b = !(this.p_size == 7)
root.c = this.p_type != "x" && this.p_name.type() == "string"
root.d = null == null
""", "SELECT p_partkey AS key, (p_size > 10 AND p_retailprice < 1500) OR p_brand IS NULL AS a, p_size <> 7 AS b, p_type <> 'x' AS c, true AS d FROM part")  # fmt: skip

# strings

simple("op_string_case", "customer", """
root.key = this.c_custkey
root.up = this.c_mktsegment.uppercase()
root.low = this.c_name.lowercase()
root.back = this.c_name.reverse()
root.twice = this.c_mktsegment.repeat(2)
root.size = this.c_name.length()
""", "SELECT c_custkey AS key, upper(c_mktsegment) AS up, lower(c_name) AS low, reverse(c_name) AS back, repeat(c_mktsegment, 2) AS twice, strlen(c_name)::BIGINT AS size FROM customer")  # fmt: skip

simple("op_string_affixes", "customer", r"""
root.key = this.c_custkey
root.number = this.c_name.trim_prefix("Customer#")
root.cut = this.c_mktsegment.trim_suffix("Y")
root.bare = (" \t" + this.c_name + "\n ").trim()
root.starts = this.c_name.has_prefix("Customer")
root.ends = this.c_mktsegment.has_suffix("E")
root.has = this.c_mktsegment.contains("UI")
root.at = this.c_name.index_of("0")
root.part = this.c_name.slice(0, 4)
root.tail = this.c_name.slice(-3)
""", """SELECT c_custkey AS key, CASE WHEN starts_with(c_name, 'Customer#') THEN c_name[10:] ELSE c_name END AS number, CASE WHEN ends_with(c_mktsegment, 'Y') THEN left(c_mktsegment, -1) ELSE c_mktsegment END AS cut, c_name AS bare,
starts_with(c_name, 'Customer') AS starts, ends_with(c_mktsegment, 'E') AS ends, contains(c_mktsegment, 'UI') AS has, (instr(c_name, '0') - 1)::BIGINT AS at, c_name[1:4] AS part, right(c_name, 3) AS tail FROM customer""")  # fmt: skip

simple("op_string_split_replace", "part", """
root.key = this.p_partkey
root.words = this.p_name.split(" ").length()
root.joined = this.p_name.split(" ").join("-")
root.new = this.p_type.replace_all("S", "$").replace_all_many(["A", "a", "E", "e"])
root.html = ("<" + this.p_brand + " & \\"x\\">").escape_html()
root.query = (this.p_name + " a+b").escape_url_query()
""", """SELECT p_partkey AS key, len(string_split(p_name, ' '))::BIGINT AS words, replace(p_name, ' ', '-') AS joined, replace(replace(replace(p_type, 'S', '$'), 'A', 'a'), 'E', 'e') AS new,
'&lt;' || p_brand || ' &amp; &#34;x&#34;&gt;' AS html, replace(replace(url_encode(p_name || ' a+b'), '%20', '+'), '%2520', '%20') AS query FROM part""")  # fmt: skip

simple("op_string_regex", "documents", r"""
root.id = this.doc_id
root.digits = this.text.re_find_all("[0-9]+").length()
root.mail = this.text.re_match("[a-z0-9.]+@[a-z0-9.]+")
root.masked = this.source.re_replace_all("([a-z]+)([0-9]+)", "$2-$1")
root.parts = this.source.re_find_object("(?P<name>[a-z]+)(?P<n>[0-9]+)").n
""", r"""SELECT doc_id AS id, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS digits, regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') AS mail, regexp_replace(source, '([a-z]+)([0-9]+)', '\2-\1', 'g') AS masked, regexp_extract(source, '([a-z]+)([0-9]+)', 2) AS parts FROM documents""")  # fmt: skip

simple("op_string_bytes", "documents", """
root.id = this.doc_id
root.bytes = this.text.length()
root.head = this.lang.bytes().encode("hex")
root.kind = this.text.type()
""", "SELECT doc_id AS id, strlen(text)::BIGINT AS bytes, lower(hex(lang)) AS head, 'string' AS kind FROM documents")  # fmt: skip


@query("SELECT c_custkey AS key, 'customer ' || c_custkey::VARCHAR || ' of ' || c_mktsegment || '!' AS line, 'k' || c_nationkey::VARCHAR AS nation FROM customer")
def op_interpolation(spark, sf_dir):
    from millrace.operators.envelope import interpolated

    s = Stream(table(spark, sf_dir, "customer"))
    return s.df.select(F.col("c_custkey").alias("key"), interpolated(s, "customer ${! this.c_custkey } of ${! this.c_mktsegment }!").col.alias("line"), interpolated(s, "k${! this.c_nationkey }").col.alias("nation"))


# numbers

simple("op_math_rounding", "lineitem", """
root.key = this.l_orderkey
root.line = this.l_linenumber
root.up = this.l_extendedprice.ceil()
root.down = this.l_extendedprice.floor()
root.near = this.l_extendedprice.round()
root.size = (this.l_discount - 0.05).abs()
""", "SELECT l_orderkey AS key, l_linenumber AS line, ceil(l_extendedprice)::BIGINT AS up, floor(l_extendedprice)::BIGINT AS down, floor(l_extendedprice + 0.5)::BIGINT AS near, abs(l_discount - 0.05::DOUBLE) AS size FROM lineitem")  # fmt: skip

simple("op_math_functions", "part", """
root.key = this.p_partkey
root.ln = (this.p_retailprice.log() * 1000000).round()
root.lg = (this.p_retailprice.log10() * 1000000).round()
root.square = this.p_size.pow(2)
root.sine = (this.p_size.sin() * 1000000).round()
root.cosine = (this.p_size.cos() * 1000000).round()
root.circle = (pi() * this.p_size * 1000).floor()
""", """SELECT p_partkey AS key, floor(ln(p_retailprice) * 1000000 + 0.5)::BIGINT AS ln, floor(log10(p_retailprice) * 1000000 + 0.5)::BIGINT AS lg, pow(p_size, 2)::DOUBLE AS square,
(sign(sin(p_size)) * floor(abs(sin(p_size) * 1000000) + 0.5))::BIGINT AS sine, (sign(cos(p_size)) * floor(abs(cos(p_size) * 1000000) + 0.5))::BIGINT AS cosine, floor(pi() * p_size * 1000)::BIGINT AS circle FROM part""")  # fmt: skip

simple("op_math_bitwise", "orders", """
root.key = this.o_orderkey
root.both = this.o_orderkey.bitwise_and(255)
root.any = this.o_custkey.bitwise_or(3)
root.diff = this.o_orderkey.bitwise_xor(this.o_custkey)
root.rest = this.o_orderkey % 7
root.neg = -this.o_custkey
""", "SELECT o_orderkey AS key, o_orderkey & 255 AS both, o_custkey | 3 AS any, xor(o_orderkey, o_custkey) AS diff, o_orderkey % 7 AS rest, -o_custkey AS neg FROM orders")  # fmt: skip

simple("op_math_casts", "events", """
root.id = this.event_id
root.whole = this.user_id.int32()
root.text = this.user_id.string()
root.parsed = (this.user_id.string() + ".5").number()
root.flag = this.user_id.bool()
root.small = this.value.uint8().catch(0)
root.truth = "true".bool()
""", "SELECT event_id AS id, user_id::INTEGER AS whole, user_id::VARCHAR AS text, user_id + 0.5::DOUBLE AS parsed, user_id <> 0 AS flag, CASE WHEN value = floor(value) AND value BETWEEN 0 AND 255 THEN value::BIGINT ELSE 0 END AS small, true AS truth FROM events")  # fmt: skip

# time

simple("op_time_format", "orders", """
root.key = this.o_orderkey
root.day = this.o_orderdate.ts_format("2006-01-02")
root.full = this.o_orderdate.ts_format()
root.us = this.o_orderdate.ts_strftime("%m/%d/%y")
root.month = this.o_orderdate.ts_format("Jan 2006")
""", "SELECT o_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS full, strftime(o_orderdate, '%m/%d/%y') AS us, strftime(o_orderdate, '%b %Y') AS month FROM orders")  # fmt: skip

simple("op_time_unix", "events", """
root.id = this.event_id
root.s = this.ts.ts_unix()
root.ms = this.ts.ts_unix_milli()
root.us = this.ts.ts_unix_micro()
root.ns = this.ts.ts_unix_nano()
""", "SELECT event_id AS id, floor(epoch_us(ts) / 1000000)::BIGINT AS s, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, epoch_us(ts) * 1000 AS ns FROM events")  # fmt: skip

simple("op_time_arithmetic", "orders", """
root.key = this.o_orderkey
root.later = this.o_orderdate.ts_add_iso8601("P1DT2H").ts_unix()
root.before = this.o_orderdate.ts_sub_iso8601("P2W").ts_unix()
root.day = this.o_orderdate.ts_add_iso8601("PT7H").ts_round(86400000000000).ts_unix()
root.since = this.o_orderdate.ts_sub("1992-01-01T00:00:00Z")
root.wait = "1h30m".parse_duration()
root.iso = "P1DT1H".parse_duration_iso8601()
""", """SELECT o_orderkey AS key, (epoch_us(o_orderdate) // 1000000 + 93600)::BIGINT AS later, (epoch_us(o_orderdate) // 1000000 - 1209600)::BIGINT AS before,
(floor((epoch_us(o_orderdate) / 1000000 + 25200 + 43200) / 86400) * 86400)::BIGINT AS day, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1992-01-01')) * 1000 AS since, 5400000000000::BIGINT AS wait, 90000000000000::BIGINT AS iso FROM orders""")  # fmt: skip

simple("op_time_parse", "orders", """
root.key = this.o_orderkey
root.s = this.o_orderdate.ts_format("2006-01-02 15:04:05").ts_parse("2006-01-02 15:04:05").ts_unix()
root.t = this.o_orderdate.ts_strftime("%d/%m/%Y").ts_strptime("%d/%m/%Y").ts_unix()
root.u = this.o_orderkey.timestamp().ts_format()
""", "SELECT o_orderkey AS key, epoch_us(o_orderdate) // 1000000 AS s, epoch_us(date_trunc('day', o_orderdate)) // 1000000 AS t, strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS u FROM orders")  # fmt: skip


# arrays and objects: orders with their lines


def nested(spark, sf_dir) -> DataFrame:
    line = F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_partkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))


NESTED = "WITH o AS (SELECT l_orderkey, list({'n': l_linenumber, 'q': l_quantity, 'f': l_returnflag, 'p': l_partkey} ORDER BY l_linenumber, l_quantity, l_returnflag, l_partkey) AS lines FROM lineitem GROUP BY l_orderkey) "


def over_lines(name: str, text: str, sql: str) -> None:
    def run(spark, sf_dir):
        return fields(through(nested(spark, sf_dir), {"mapping": text}))

    run.__name__ = name
    query(NESTED + sql)(run)


over_lines("op_array_map_filter", """
root.key = this.l_orderkey
root.total = this.lines.map_each(l -> l.l_quantity).sum()
root.big = this.lines.filter(l -> l.l_quantity > 25).length()
root.flags = this.lines.map_each(l -> l.l_returnflag).unique().sort().join("")
root.kept = this.lines.map_each(l -> if l.l_quantity > 40 { deleted() } else { l.l_linenumber }).length()
""", """SELECT l_orderkey AS key, list_sum(list_transform(lines, lambda x: x.q)) AS total, len(list_filter(lines, lambda x: x.q > 25))::BIGINT AS big, array_to_string(list_sort(list_distinct(list_transform(lines, lambda x: x.f))), '') AS flags,
len(list_filter(lines, lambda x: NOT x.q > 40))::BIGINT AS kept FROM o""")  # fmt: skip

over_lines("op_array_fold_find", """
root.key = this.l_orderkey
root.sum = this.lines.fold(0, item -> item.tally + item.value.l_quantity)
root.most = this.lines.map_each(l -> l.l_quantity).max()
root.least = this.lines.map_each(l -> l.l_quantity).min()
root.first_r = this.lines.find_by(l -> l.l_returnflag == "R")
root.count_r = this.lines.find_all_by(l -> l.l_returnflag == "R").length()
root.has_r = this.lines.any(l -> l.l_returnflag == "R")
root.all_n = this.lines.all(l -> l.l_returnflag == "N")
root.at = this.lines.map_each(l -> l.l_linenumber).find(2)
""", """SELECT l_orderkey AS key, list_sum(list_transform(lines, lambda x: x.q)) AS sum, list_max(list_transform(lines, lambda x: x.q)) AS most, list_min(list_transform(lines, lambda x: x.q)) AS least,
(coalesce(list_position(list_transform(lines, lambda x: x.f), 'R'), 0) - 1)::BIGINT AS first_r, len(list_filter(lines, lambda x: x.f = 'R'))::BIGINT AS count_r, len(list_filter(lines, lambda x: x.f = 'R')) > 0 AS has_r,
len(list_filter(lines, lambda x: x.f <> 'N')) = 0 AS all_n, (coalesce(list_position(list_transform(lines, lambda x: x.n), 2), 0) - 1)::BIGINT AS at FROM o""")  # fmt: skip

over_lines("op_array_sort_slice", """
root.key = this.l_orderkey
root.top = this.lines.map_each(l -> l.l_quantity).sort(item -> item.left > item.right).slice(0, 2).sum()
root.light = this.lines.sort_by(l -> l.l_quantity * 1000 + l.l_linenumber).index(0).l_linenumber
root.last = this.lines.index(-1).l_quantity
root.rest = this.lines.slice(1).length()
root.places = this.lines.enumerated().map_each(e -> e.index).sum()
root.more = this.lines.map_each(l -> l.l_linenumber).append(99).length()
root.pairs = this.lines.zip(this.lines).length()
root.flat = this.lines.map_each(l -> [l.l_linenumber, 0]).flatten().length()
root.both = this.lines.concat(this.lines).length()
""", """SELECT l_orderkey AS key, list_sum(list_reverse_sort(list_transform(lines, lambda x: x.q))[1:2]) AS top, list_sort(list_transform(lines, lambda x: {'a': x.q * 1000 + x.n, 'n': x.n}))[1].n AS light, lines[len(lines)].q AS last, (len(lines) - 1)::BIGINT AS rest,
(len(lines) * (len(lines) - 1) / 2)::DOUBLE AS places, (len(lines) + 1)::BIGINT AS more, len(lines)::BIGINT AS pairs, (2 * len(lines))::BIGINT AS flat, (2 * len(lines))::BIGINT AS both FROM o""")  # fmt: skip

over_lines("op_array_explode", """
root.key = this.l_orderkey
root.n = {"k": this.l_orderkey, "lines": this.lines}.explode("lines").length()
root.qs = {"lines": this.lines}.explode("lines").map_each(d -> d.lines.l_quantity).sum()
root.span = range(0, 250, 100).length()
""", "SELECT l_orderkey AS key, len(lines)::BIGINT AS n, list_sum(list_transform(lines, lambda x: x.q)) AS qs, 2::BIGINT AS span FROM o")  # fmt: skip

simple("op_object_merge", "supplier", """
let a = {"key": this.s_suppkey, "name": this.s_name, "n": 1}
let b = {"n": 2, "extra": this.s_nationkey}
root = $a.assign($b)
root.both = $a.merge($b).n.sum()
root.names = $a.keys().join(",")
root.kept = $a.with("name").keys().length()
root.less = $a.without("name", "n").keys().join("")
root.values = {"x": this.s_suppkey, "y": 1}.values().sum()
root.pairs = {"x": this.s_suppkey, "y": 1}.key_values().map_each(e -> e.key).join("")
root.there = $a.exists("name")
""", """SELECT s_suppkey AS key, s_name AS name, 2::BIGINT AS n, s_nationkey AS extra, 3.0::DOUBLE AS both, 'key,n,name' AS names, 1::BIGINT AS kept, 'key' AS less, (s_suppkey + 1)::DOUBLE AS "values", 'xy' AS pairs, true AS there FROM supplier""")  # fmt: skip

# JSON, hashes, encodings

simple("op_json_parse", "events", """
root.id = this.event_id
root.k = this.props.parse_json().k.int64()
root.kind = this.props.parse_json().k.type()
root.double = this.props.parse_json().k * 2
root.gone = this.props.parse_json().exists("missing")
""", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'number' AS kind, CAST(json_extract(props, '$.k') AS DOUBLE) * 2 AS double, false AS gone FROM events")  # fmt: skip

simple("op_json_format", "nation", """
root.key = this.n_nationkey
root.text = {"name": this.n_name, "key": this.n_nationkey, "ok": true}.format_json(no_indent: true, escape_html: false).string()
""", """SELECT n_nationkey AS key, '{"key":' || n_nationkey::VARCHAR || ',"name":"' || n_name || '","ok":true}' AS text FROM nation""")  # fmt: skip

simple("op_hash_encode", "customer", """
root.key = this.c_custkey
root.md5 = this.c_name.hash("md5").encode("hex")
root.sha1 = this.c_name.hash("sha1").encode("hex")
root.sha256 = this.c_name.hash("sha256").encode("hex")
root.b64 = this.c_name.encode("base64")
root.url = this.c_name.encode("base64rawurl")
root.hex = this.c_name.encode("hex")
root.back = this.c_name.encode("base64").decode("base64").string()
""", """SELECT c_custkey AS key, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha256, base64(c_name::BLOB) AS b64, rtrim(translate(base64(c_name::BLOB), '+/', '-_'), '=') AS url, lower(hex(c_name)) AS hex, c_name AS back FROM customer""")  # fmt: skip


@query(None)
def op_python_methods(spark, sf_dir):
    text = """
root.key = this.c_custkey
root.title = this.c_mktsegment.capitalize()
root.fnv = this.c_name.hash("fnv32").string()
root.xx = this.c_name.hash("xxhash64").string()
root.mac = this.c_name.hash("hmac_sha256", "key").encode("hex")
root.sealed = this.c_name.encrypt_aes("ctr", "0123456789abcdef", "0123456789abcdef").decrypt_aes("ctr", "0123456789abcdef", "0123456789abcdef").string()
root.packed = this.c_name.compress("gzip").decompress("gzip").string()
root.said = "%s has %d".format(this.c_name, this.c_custkey)
root.id = this.c_name.uuid_v5("dns")
root.csv = ("a,b\\n1," + this.c_name).parse_csv().index(0).b.string()
root.pairs = ("k=1 name=" + this.c_mktsegment).parse_logfmt().name.string()
root.host = ("http://u@" + this.c_mktsegment + ".example/x?q=1").parse_url().host.string()
"""
    return fields(through(table(spark, sf_dir, "customer"), {"mapping": text}))


# windows over event time


def _windowed(spark, sf_dir, *aggs, by=(), stream: bool = False, **more):
    from millrace.streaming.queries import file_stream
    from millrace.streaming.windows import windowed

    df = file_stream(spark, f"{sf_dir}/events.parquet") if stream else table(spark, sf_dir, "events")
    return windowed(df, "ts", aggs=list(aggs), by=list(by), **more)


def _n():
    return F.count(F.lit(1)).alias("n")


def _sum(c: str):
    return F.round(F.sum(c), 2).alias("total")


TUMBLING = "SELECT time_bucket(INTERVAL '1 hour', ts - INTERVAL 1 MICROSECOND) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


@query(TUMBLING)
def op_window_tumbling(spark, sf_dir):
    return _windowed(spark, sf_dir, _n(), _sum("value"), by=["event_type"], size="1h")


@query("SELECT time_bucket(INTERVAL '3 hours', ts - INTERVAL 1 MICROSECOND) + INTERVAL '6 hours' - INTERVAL (3 * i) HOUR AS window_end, count(*) AS n FROM events, range(2) t(i) GROUP BY 1")
def op_window_sliding(spark, sf_dir):
    return _windowed(spark, sf_dir, _n(), size="6h", slide="3h")


@query("SELECT time_bucket(INTERVAL '1 hour', ts - INTERVAL 1 MICROSECOND - INTERVAL 30 MINUTE) + INTERVAL '90 minutes' AS window_end, count(*) AS n FROM events GROUP BY 1")
def op_window_offset(spark, sf_dir):
    return _windowed(spark, sf_dir, _n(), size="1h", offset="30m")


@query("SELECT strftime(time_bucket(INTERVAL '1 day', ts - INTERVAL 1 MICROSECOND) + INTERVAL '1 day', '%Y-%m-%dT%H:%M:%SZ') AS window_end, user_id, count(*) AS n, max(value) AS most, min(value) AS least FROM events GROUP BY 1, 2")
def op_window_group_reduce(spark, sf_dir):
    """The buffer of windows, batches by a key and a reduction, as a config."""
    conf = {
        "input": {"parquet": {"paths": [f"{sf_dir}/events.parquet"], "seq": "event_id"}},
        "buffer": {"system_window": {"timestamp_mapping": "root = this.ts", "size": "24h"}},
        "pipeline": {"processors": [
            {"group_by_value": {"value": "${! this.user_id }"}},
            {"reduce": {"window_end": "@window_end_timestamp", "user_id": "this.user_id", "n": "batch_size()", "most": "this.value.from_all().max()", "least": "this.value.from_all().min()"}},
        ]},
    }
    return fields(Pipeline.of(conf, spark).stream())


@query("WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts - INTERVAL 1 MICROSECOND) + INTERVAL '1 hour' AS window_end, event_type, c_mktsegment AS segment, value FROM events JOIN customer ON c_custkey = user_id) SELECT window_end, event_type, segment, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY ALL")
def op_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events enriched from a lookup of customers, in hourly windows by type and segment."""
    from millrace.streaming.windows import windowed

    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    enriched = table(spark, sf_dir, "events").join(customers, "user_id")
    return windowed(enriched, "ts", "1h", [_n(), _sum("value")], by=["event_type", "segment"])


# batches


def events(spark, sf_dir) -> Stream:
    return Stream.of(table(spark, sf_dir, "events"), "event_id")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity, max(l_extendedprice) AS most FROM lineitem GROUP BY 1, 2")
def op_group_by_value(spark, sf_dir):
    s = Stream.of(table(spark, sf_dir, "lineitem").withColumn("_line", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "_line")
    out = through(s, {"group_by_value": {"value": "${! this.l_returnflag }|${! this.l_linestatus }"}}, {"reduce": {"flag": "this.l_returnflag", "status": "this.l_linestatus", "n": "batch_size()", "quantity": "this.l_quantity.from_all().sum()", "most": "this.l_extendedprice.from_all().max()"}})
    return fields(out).withColumn("quantity", F.round("quantity", 2))


@query("SELECT l_shipdate AS day, count(*) AS n, round(sum(l_quantity), 2) AS quantity, max(l_discount) AS most FROM lineitem GROUP BY 1")
def op_group_first_row(spark, sf_dir):
    """The usual idiom: a mapping over each batch that keeps its first row; it becomes one aggregate."""
    s = Stream.of(table(spark, sf_dir, "lineitem").withColumn("_line", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "_line")
    text = 'root = if batch_index() > 0 { deleted() } else { {"day": this.l_shipdate, "n": batch_size(), "quantity": this.l_quantity.from_all().sum(), "most": this.l_discount.from_all().max()} }'
    out = through(s, {"group_by_value": {"value": "${! this.l_shipdate }"}}, {"mapping": text})
    return fields(out).withColumn("quantity", F.round("quantity", 2))


@query("SELECT CASE WHEN event_type = 'click' THEN 'first' WHEN value > 50 THEN 'second' ELSE 'rest' END AS arm, count(*) AS n FROM events GROUP BY 1")
def op_group_by_check(spark, sf_dir):
    conf = [{"check": 'this.event_type == "click"', "processors": [{"mapping": 'root.arm = "first"'}]}, {"check": "this.value > 50", "processors": [{"mapping": 'root.arm = "second"'}]}]
    out = through(events(spark, sf_dir), {"group_by": conf}, {"mapping": 'root.arm = this.arm | "rest"'}, {"reduce": {"arm": "this.arm", "n": "batch_size()"}})
    return fields(out).groupBy("arm").agg(F.sum("n").alias("n"))


@query("WITH b AS (SELECT user_id::VARCHAR || '/' || ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 100)::VARCHAR AS part, value FROM events) SELECT part, count(*) AS n, round(sum(value), 2) AS total FROM b GROUP BY 1")
def op_batch_policy(spark, sf_dir):
    from millrace.operators.batches import batched

    s = batched(Stream.of(table(spark, sf_dir, "events"), "event_id", F.col("user_id")), {"count": 100}, Resources())
    return s.df.select(F.col("_batch").alias("part"), "value").groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))




@query("WITH c AS (SELECT user_id, event_id, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events) SELECT user_id::VARCHAR || '/' || g::VARCHAR AS part, count(*) AS n FROM c GROUP BY 1")
def op_batch_check(spark, sf_dir):
    from millrace.operators.batches import batched

    s = batched(Stream.of(table(spark, sf_dir, "events"), "event_id", F.col("user_id")), {"check": 'this.event_type == "purchase"'}, Resources())
    return s.df.groupBy(F.col("_batch").alias("part")).agg(F.count("*").alias("n"))


def by_user(spark, sf_dir) -> Stream:
    return Stream.of(table(spark, sf_dir, "events"), "event_id", F.col("user_id"))


W = "OVER (PARTITION BY user_id ORDER BY event_id)"


@query(f"SELECT event_id, (row_number() {W} - 1) AS place, count(*) OVER (PARTITION BY user_id) AS size, user_id FROM events")
def op_batch_index(spark, sf_dir):
    return fields(through(by_user(spark, sf_dir), {"mapping": "root.event_id = this.event_id\nroot.place = batch_index()\nroot.size = batch_size()\nroot.user_id = this.user_id"}))


@query(f"SELECT event_id, user_id, CASE WHEN row_number() {W} = 1 THEN last_value(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE lag(value) {W} END AS before, lead(value) {W} AS after, first_value(value) {W} AS first, last_value(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM events")
def op_lag_lead(spark, sf_dir):
    text = "root.event_id = this.event_id\nroot.user_id = this.user_id\nroot.before = this.value.from(batch_index() - 1)\nroot.after = this.value.from(batch_index() + 1).catch(null)\nroot.first = this.value.from(0)\nroot.last = this.value.from(-1)"
    return fields(through(by_user(spark, sf_dir), {"mapping": text}))


@query(f"SELECT event_id, round(sum(value) {W}, 2) AS running, round(sum(value) OVER (PARTITION BY user_id), 2) AS total, max(value) OVER (PARTITION BY user_id) AS most FROM events")
def op_running_sum(spark, sf_dir):
    text = "root.event_id = this.event_id\nroot.running = this.value.from_all().slice(0, batch_index() + 1).sum()\nroot.total = this.value.from_all().sum()\nroot.most = this.value.from_all().max()"
    out = fields(through(by_user(spark, sf_dir), {"mapping": text}))
    return out.withColumn("running", F.round("running", 2)).withColumn("total", F.round("total", 2))


@query(f"WITH p AS (SELECT user_id, value, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, value, CASE WHEN i = 0 THEN 0 ELSE 1 END::BIGINT AS slot FROM p WHERE i = 0 OR i = n - 1 AND n > 1 UNION ALL SELECT user_id, value, 1::BIGINT FROM p WHERE n = 1")
def op_select_parts(spark, sf_dir):
    return through(by_user(spark, sf_dir), {"select_parts": {"parts": [0, -1]}}).df.select("user_id", "value", F.col("_seq").alias("slot"))


@query(f"SELECT user_id::VARCHAR || '/' || ((row_number() {W} - 1) // 7)::VARCHAR AS part, event_id FROM events")
def op_split(spark, sf_dir):
    return through(by_user(spark, sf_dir), {"split": {"size": 7}}).df.select(F.col("_batch").alias("part"), "event_id")


@query("SELECT user_id::VARCHAR AS batch, count(*) + 1 AS n, 1::BIGINT AS added FROM events GROUP BY 1")
def op_insert_part(spark, sf_dir):
    out = through(by_user(spark, sf_dir), {"insert_part": {"index": -1, "content": "tail"}})
    return out.df.groupBy(F.col("_batch").alias("batch")).agg(F.count("*").alias("n"), F.count_if(F.col("_content") == "tail").alias("added"))


@query("SELECT event_id, user_id FROM events QUALIFY count(*) OVER (PARTITION BY user_id) BETWEEN 1 AND 65")
def op_bounds_check(spark, sf_dir):
    return through(by_user(spark, sf_dir), {"bounds_check": {"max_parts": 65}}).df.select("event_id", "user_id")


@query("SELECT o_custkey AS customer, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1")
def op_archive(spark, sf_dir):
    s = Stream.of(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", F.col("o_custkey"))
    out = through(s, {"mapping": "root = this.o_orderkey.string()"}, {"archive": {"format": "lines"}})
    return out.df.select(F.col("_batch").cast("long").alias("customer"), F.size(F.split("_content", "\n")).cast("long").alias("n"), F.replace(F.col("_content"), F.lit("\n"), F.lit(",")).alias("keys"))


@query("SELECT o_custkey AS customer, o_orderkey AS key FROM orders")
def op_archive_unarchive(spark, sf_dir):
    s = Stream.of(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", F.col("o_custkey"))
    out = through(s, {"archive": {"format": "json_array"}}, {"unarchive": {"format": "json_array"}}, {"mapping": "root.customer = this.o_custkey.int64()\nroot.key = this.o_orderkey.int64()"})
    return fields(out)


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def op_unarchive_lines(spark, sf_dir):
    s = Stream.of(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", F.col("doc_id"))
    out = through(s, {"mapping": "root = this.text"}, {"unarchive": {"format": "lines"}})
    return out.df.select(F.col("_batch").cast("long").alias("doc_id"), F.col("_content").alias("line"))


# keyed state, joins


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def op_dedupe(spark, sf_dir):
    return through(events(spark, sf_dir), {"dedupe": {"cache": "seen", "key": "${! this.user_id }/${! this.event_type }"}}).df.select("event_id", "user_id", "event_type")


@query("SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def op_dedupe_content(spark, sf_dir):
    s = Stream.of(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return through(s, {"dedupe": {"cache": "seen", "key": "${! this.text }"}}).df.select("doc_id", "text")


def parts_by(spark, sf_dir) -> Resources:
    p = table(spark, sf_dir, "part")
    return Resources(spark=spark, caches={"parts": p.select(F.col("p_partkey").cast("string").alias("key"), F.col("p_brand").alias("value"))})


@query("SELECT l_orderkey AS key, l_linenumber AS line, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey")
def op_lookup(spark, sf_dir):
    out = through(table(spark, sf_dir, "lineitem"), {"branch": {"request_map": "root = this.l_partkey.string()", "processors": [{"cache": {"resource": "parts", "operator": "get", "key": "${! content().string() }"}}], "result_map": "root.brand = content().string()"}}, res=parts_by(spark, sf_dir))
    return out.df.where("_error IS NULL").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), "brand")


@query("SELECT c_custkey AS key, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS found FROM customer")
def op_cache_exists(spark, sf_dir):
    res = Resources(spark=spark, caches={"orders": table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.lit("").alias("value")).distinct()})
    out = through(Stream.of(table(spark, sf_dir, "customer"), "c_custkey"), {"cache": {"resource": "orders", "operator": "exists", "key": "${! this.c_custkey }"}}, res=res)
    return out.df.select(F.col("_seq").alias("key"), (F.col("_content") == "true").alias("found"))


@query("SELECT event_id AS id, upper(event_type) AS name FROM events")
def op_cached(spark, sf_dir):
    res = Resources(spark=spark, caches={"names": {"memory": {}}})
    out = through(events(spark, sf_dir), {"mapping": "root = this.event_type"}, {"cached": {"cache": "names", "key": "${! content().string() }", "processors": [{"mapping": "root = content().string().uppercase()"}]}}, res=res)
    return out.df.select(F.col("_seq").alias("id"), F.col("_content").alias("name"))


def sides(spark, sf_dir) -> list[Stream]:
    """Inputs keyed by a text id: customers, and their orders in order."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("_seq"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("order"), F.col("o_orderkey").alias("_seq"))
    return [Stream(c), Stream(o)]


def _joined(kind: str, strategy: str):
    def run(spark, sf_dir):
        from millrace.operators.lookups import merge_join

        out = merge_join(sides(spark, sf_dir), "id", kind, strategy).df
        if strategy == "array":
            out = out.select("id", F.array_join(F.transform("name", lambda x: x), ",").alias("name"), F.array_join(F.transform("order", lambda x: x.cast("string")), ",").alias("order"))
        return out.select("id", "name", "order")

    return run


_FULL = "SELECT coalesce(c_custkey, o_custkey)::VARCHAR AS id, {name} AS name, {order} AS \"order\" FROM customer FULL JOIN orders ON c_custkey = o_custkey GROUP BY 1"
_OUTER = "SELECT o_custkey::VARCHAR AS id, {name} AS name, {order} AS \"order\" FROM orders LEFT JOIN customer ON c_custkey = o_custkey"
_WO = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"
for _kind, _strategy, _sql in (
    ("full-outer", "array", _FULL.format(name="coalesce(any_value(c_name), '')", order="coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '')")),
    ("full-outer", "replace", _FULL.format(name="any_value(c_name)", order="max(o_orderkey)")),
    ("full-outer", "keep", _FULL.format(name="any_value(c_name)", order="min(o_orderkey)")),
    ("outer", "array", _OUTER.format(name="coalesce(c_name, '')", order=f"string_agg(o_orderkey::VARCHAR, ',') {_WO}")),
    ("outer", "replace", _OUTER.format(name="c_name", order="o_orderkey")),
    ("outer", "keep", _OUTER.format(name="c_name", order=f"first_value(o_orderkey) {_WO}")),
):
    _f = _joined(_kind, _strategy)
    _f.__name__ = f"op_join_{_kind.replace('-', '_')}_{_strategy}"
    query(_sql)(_f)


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name, 'nation' AS origin FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region")
def op_broker_union(spark, sf_dir):
    res = Resources(spark=spark)
    res.inputs["nation"] = through(table(spark, sf_dir, "nation"), {"mapping": 'root.key = this.n_nationkey.int64()\nroot.name = this.n_name\nroot.origin = "nation"'})
    res.inputs["region"] = through(table(spark, sf_dir, "region"), {"mapping": 'root.key = this.r_regionkey.int64()\nroot.name = this.r_name\nroot.origin = "region"'})
    from millrace.sources.inputs import read

    return fields(read({"broker": {"inputs": [{"resource": "nation"}, {"resource": "region"}]}}, res))


@query("SELECT 0::BIGINT + row_number() OVER (ORDER BY src, k) - 1 AS place, name FROM (SELECT 0 AS src, r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation)")
def op_sequence(spark, sf_dir):
    from millrace.sources.inputs import read

    res = Resources(spark=spark)
    res.inputs["region"] = Stream.of(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("name")), "r_regionkey").without("r_regionkey")
    res.inputs["nation"] = Stream.of(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name")), "n_nationkey").without("n_nationkey")
    s = read({"sequence": {"inputs": [{"resource": "region"}, {"resource": "nation"}]}}, res)
    return fields(through(Stream(s.df.withColumn("_batch", F.lit("0"))), {"mapping": "root.place = batch_index()\nroot.name = this.name"}))


@query("SELECT event_id FROM events WHERE event_id <= (SELECT min(event_id) FROM events WHERE event_type = 'purchase' AND value > 90)")
def op_read_until(spark, sf_dir):
    from millrace.sources.inputs import read

    res = Resources(spark=spark, inputs={"events": events(spark, sf_dir)})
    return read({"read_until": {"input": {"resource": "events"}, "check": 'this.event_type == "purchase" && this.value > 90'}}, res).df.select("event_id")


@query("SELECT i::BIGINT AS id, (i * i)::BIGINT AS square, 'row ' || i::VARCHAR AS name FROM range(1000) t(i)")
def op_generate(spark, sf_dir):
    conf = {"input": {"generate": {"count": 1000, "batch_size": 10, "mapping": 'let i = counter(min: 0)\nroot.id = $i\nroot.square = $i * $i\nroot.name = "row " + $i.string()'}}}
    return fields(Pipeline.of(conf, spark).stream())


# control


@query("SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'F!' WHEN o_totalprice > 150000 THEN 'big' ELSE o_orderstatus END AS label FROM orders")
def op_switch_proc(spark, sf_dir):
    cases = [
        {"check": 'this.label == "F"', "processors": [{"mapping": 'root.key = this.key\nroot.price = this.price\nroot.label = "F!"'}]},
        {"check": "this.price > 150000", "processors": [{"mutation": 'root.label = "big"'}]},
    ]
    out = through(table(spark, sf_dir, "orders"), {"mapping": "root.key = this.o_orderkey\nroot.price = this.o_totalprice\nroot.label = this.o_orderstatus"}, {"switch": cases})
    return out.df.select("key", "label")


@query("SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 0 WHEN value > 50 THEN 1 END AS sink FROM events WHERE event_type = 'click' OR value > 50")
def op_switch_output(spark, sf_dir):
    from millrace.sources.outputs import routed

    arms = routed(events(spark, sf_dir), [{"check": 'this.event_type == "click"'}, {"check": "this.value > 50"}])
    return arms[0].df.select(F.col("event_id").alias("id"), F.lit(0).alias("sink")).unionAll(arms[1].df.select(F.col("event_id").alias("id"), F.lit(1).alias("sink")))


@query("SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'recovered' ELSE 'fine' END AS state FROM events")
def op_try_catch(spark, sf_dir):
    procs = [
        {"mapping": 'root.id = this.event_id\nroot.kind = this.event_type\nroot.state = "fine"'},
        {"try": [{"mutation": 'root.state = if this.kind == "click" { throw("no clicks") } else { "fine" }'}, {"mutation": 'root.seen = true'}]},
        {"catch": [{"mutation": 'root.state = "recovered"'}]},
    ]
    return through(events(spark, sf_dir), *procs).df.select("id", "state")


@query("SELECT event_id AS id, value > 50 AS failed, CASE WHEN value > 50 THEN 'too much' END AS why FROM events")
def op_errored(spark, sf_dir):
    procs = [{"mutation": 'root.checked = if this.value > 50 { throw("too much") } else { "ok" }'}, {"mapping": "root.id = this.event_id\nroot.failed = errored()\nroot.why = error()"}]
    return through(events(spark, sf_dir), *procs).df.select("id", "failed", "why")


@query("SELECT o_orderkey AS key, o_totalprice * 2 AS twice, o_totalprice * 2 + 1 AS more, o_orderstatus || '!' AS mark FROM orders")
def op_workflow(spark, sf_dir):
    branches = {
        "more": {"request_map": "root.v = this.twice", "processors": [{"mapping": "root.r = this.v + 1"}], "result_map": "root.more = this.r"},
        "twice": {"request_map": "root.v = this.o_totalprice", "processors": [{"mapping": "root.r = this.v * 2"}], "result_map": "root.twice = this.r"},
        "mark": {"request_map": "root.s = this.o_orderstatus", "processors": [{"mapping": 'root.r = this.s + "!"'}], "result_map": "root.mark = this.r"},
    }
    out = through(table(spark, sf_dir, "orders"), {"workflow": {"branches": branches, "meta_path": ""}})
    return out.df.select(F.col("o_orderkey").alias("key"), "twice", "more", "mark")


@query("SELECT c_custkey AS key, c_acctbal AS bal, CASE WHEN c_acctbal > 0 THEN round(c_acctbal * 2, 6) END AS doubled FROM customer")
def op_branch(spark, sf_dir):
    conf = {"request_map": "root = if this.c_acctbal <= 0 { deleted() } else { this }", "processors": [{"mapping": "root.d = this.c_acctbal * 2"}], "result_map": "root.doubled = this.d"}
    out = through(table(spark, sf_dir, "customer"), {"branch": conf})
    return out.df.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"), F.round("doubled", 6).alias("doubled"))


@query("SELECT p_partkey AS key, CASE WHEN p_size >= 40 THEN p_size ELSE p_size + ceil((40 - p_size) / 10.0) * 10 END::BIGINT AS size FROM part")
def op_while(spark, sf_dir):
    procs = [{"mapping": "root.key = this.p_partkey\nroot.size = this.p_size.int64()"}, {"while": {"check": "this.size < 40", "max_loops": 5, "processors": [{"mutation": "root.size = this.size + 10"}]}}]
    return through(table(spark, sf_dir, "part"), *procs).df.select("key", "size")


@query("SELECT event_id AS id, 1::BIGINT AS size, 0::BIGINT AS place FROM events")
def op_for_each(spark, sf_dir):
    out = through(events(spark, sf_dir), {"for_each": [{"mapping": "root.id = this.event_id\nroot.size = batch_size()\nroot.place = batch_index()"}]})
    return out.df.select("id", "size", "place")


@query("SELECT s_suppkey AS key, 'n' || s_nationkey::VARCHAR AS nation, s_suppkey::VARCHAR AS tag FROM supplier")
def op_metadata(spark, sf_dir):
    procs = [{"mapping": 'meta nation = "n" + this.s_nationkey.string()\nmeta tag = this.s_suppkey\nroot.key = this.s_suppkey'}, {"mapping": "root = this\nroot.nation = @nation\nroot.tag = meta(\"tag\")"}]
    return fields(through(table(spark, sf_dir, "supplier"), *procs))


@query("SELECT event_type AS kind, count(*) AS seen FROM events GROUP BY 1")
def op_metric(spark, sf_dir):
    from millrace.operators.effects import metric_table

    return metric_table(Stream(table(spark, sf_dir, "events")), {"type": "counter", "name": "seen", "labels": {"kind": "${! this.event_type }"}})


@query("SELECT p_partkey AS key, p_size + 1 AS next FROM part")
def op_retry(spark, sf_dir):
    procs = [{"mapping": "root.key = this.p_partkey\nroot.size = this.p_size"}, {"retry": {"max_retries": 1, "processors": [{"mutation": "root.next = (this.size + 1).int32()"}]}}]
    return through(table(spark, sf_dir, "part"), *procs).df.select("key", "next")


# formats and query languages


@query("SELECT event_id AS id, user_id AS \"user\", event_type AS verb FROM events")
def op_grok(spark, sf_dir):
    procs = [{"mapping": 'root = "user=" + this.user_id.string() + " did " + this.event_type + " id " + this.event_id.string()'}, {"grok": {"expressions": ["user=%{INT:user:int} did %{WORD:verb} id %{INT:id:int}"]}}]
    return through(events(spark, sf_dir), *procs).df.select("id", "user", "verb")


@query("SELECT event_id AS id, 4::BIGINT AS facility, 2::BIGINT AS severity, 'host' || user_id::VARCHAR AS host, event_type AS app, 'value ' || event_id::VARCHAR AS message FROM events")
def op_parse_log(spark, sf_dir):
    text = 'root = "<34>1 2003-10-11T22:14:15.003Z host" + this.user_id.string() + " " + this.event_type + " - ID47 - value " + this.event_id.string()'
    out = through(events(spark, sf_dir), {"mapping": text}, {"parse_log": {"format": "syslog_rfc5424"}})
    return out.df.select(F.col("_seq").alias("id"), "facility", "severity", F.col("hostname").alias("host"), F.col("appname").alias("app"), "message")


@query("SELECT event_id AS id, '{\"t\":\"' || event_type || '\",\"u\":' || user_id::VARCHAR || '}' AS doc FROM events WHERE user_id > 10")
def op_jq(spark, sf_dir):
    procs = [{"mapping": "root.u = this.user_id\nroot.t = this.event_type"}, {"jq": {"query": "select(.u > 10) | {t, u}"}}]
    return through(events(spark, sf_dir), *procs).df.select(F.col("_seq").alias("id"), F.col("_content").alias("doc"))


@query(NESTED + "SELECT l_orderkey AS key, '[' || coalesce(array_to_string(list_transform(list_filter(lines, lambda x: x.f = 'R'), lambda x: x.n::VARCHAR), ','), '') || ']' AS found FROM o")
def op_jmespath(spark, sf_dir):
    s = Stream.of(nested(spark, sf_dir), "l_orderkey")
    out = through(s, {"mapping": "root.lines = this.lines"}, {"jmespath": {"query": "lines[?l_returnflag=='R'].l_linenumber"}})
    return out.df.select(F.col("_seq").alias("key"), F.col("_content").alias("found"))


@query("SELECT event_id AS id, NOT (value <= 50 AND user_id >= 5) AS broken FROM events")
def op_json_schema(spark, sf_dir):
    schema = '{"type":"object","required":["value"],"properties":{"value":{"type":"number","maximum":50},"user_id":{"minimum":5}}}'
    out = through(events(spark, sf_dir).without("ts"), {"json_schema": {"schema": schema}})
    return out.df.select(F.col("event_id").alias("id"), F.col("_error").isNotNull().alias("broken"))


@query("SELECT conv_id, turn, text FROM conversations")
def op_compress(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    s = Stream(df.select(F.struct("conv_id", "turn").alias("_seq"), F.col("text").alias("_content")))
    out = through(s, {"compress": {"algorithm": "zlib"}}, {"decompress": {"algorithm": "zlib"}})
    return out.df.select("_seq.conv_id", "_seq.turn", F.col("_content").alias("text"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def op_parse_url(spark, sf_dir):
    text = "let u = this.url.parse_url()\nroot.page_id = this.page_id\nroot.scheme = $u.scheme.string()\nroot.host = $u.host.string()\nroot.path = $u.path.string()"
    return fields(through(table(spark, sf_dir, "pages"), {"mapping": text}))


# streams


@query(TUMBLING)
def stream_window_tumbling(spark, sf_dir):
    from millrace.streaming.queries import drained

    return drained(_windowed(spark, sf_dir, _n(), _sum("value"), by=["event_type"], size="1h", stream=True), "complete")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, sf_dir):
    from millrace.streaming.queries import drained, file_stream

    return drained(file_stream(spark, f"{sf_dir}/events.parquet").groupBy("user_id").agg(_n()), "complete")


@query("SELECT DISTINCT user_id FROM events")
def stream_dedupe(spark, sf_dir):
    from millrace.streaming.queries import deduplicated, drained, file_stream

    return drained(deduplicated(file_stream(spark, f"{sf_dir}/events.parquet"), ["user_id"]).select("user_id"))


@query("SELECT event_id AS id, value * 2 AS doubled FROM events WHERE event_type <> 'click'")
def stream_mapping(spark, sf_dir):
    from millrace.streaming.queries import drained, file_stream

    s = Stream(file_stream(spark, f"{sf_dir}/events.parquet"))
    return drained(fields(through(s, {"mapping": 'root = if this.event_type == "click" { deleted() } else { {"id": this.event_id, "doubled": this.value * 2} }'})))


from millrace.plans import queries_more  # noqa: E402, F401  (registration)
