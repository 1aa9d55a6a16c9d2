"""Processors on small batches."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import jmespath, jq
from millrace.operators.envelope import ConfigError, Resources, Stream, apply_all
from millrace.operators.lookups import merge_join
from millrace.operators.rows import layers_of
from millrace.plans.pipeline import Pipeline  # noqa: F401  (registers all processors)


def texts(spark, *rows, batch="0"):
    return Stream(spark.createDataFrame([(i, batch, t) for i, t in enumerate(rows)], "_seq long, _batch string, _content string"))


def run(stream, *procs, res=None):
    return apply_all(stream, list(procs), res or Resources(spark=stream.df.sparkSession))


def contents(s):
    return [r["c"] for r in s.df.select("_seq", s.content().alias("c")).orderBy("_seq").collect()]


def test_filter_rows(spark):
    s = texts(spark, "keep", "delete me", "also", "delete me too")
    assert contents(run(s, {"mapping": 'root = if content().string().contains("delete me") { deleted() }'})) == ["keep", "also"]


def test_window_style_aggregate(spark):
    s = texts(spark, *[f'{{"doc":{{"count":{n}}}}}' for n in (243, 71, 10, 333, 164)])
    out = run(s, {"mapping": 'root = if batch_index() > 0 { deleted() } else { {"count": json("doc.count").from_all().sum(), "max": json("doc.count").from_all().max()} }'})
    assert [(r["count"], r["max"]) for r in out.df.collect()] == [(821.0, 333.0)]


def test_dedupe(spark):
    s = texts(spark, *"1 2 3 4 3 3 3 4 1 1 3 4 4 2 1".split())
    assert contents(run(s, {"dedupe": {"cache": "c", "key": "${! content().string() }"}})) == ["1", "2", "3", "4"]


def test_group_by_value_and_archive(spark):
    s = texts(spark, '{"foo":"a"}', '{"foo":"b"}', '{"foo":"a"}', "{}")
    out = run(s, {"group_by_value": {"value": "${! json().foo }"}}, {"archive": {"format": "lines"}})
    assert sorted(contents(out)) == sorted(['{"foo":"a"}\n{"foo":"a"}', '{"foo":"b"}', "{}"])


def test_group_by_first_match_wins(spark):
    s = texts(spark, "foo", "bar foo", " bar ", "neither")
    conf = [{"check": 'content().string().contains("foo")', "processors": [{"archive": {"format": "lines"}}]}, {"check": 'content().string().contains("bar")', "processors": [{"mapping": "root = content().string().uppercase().trim()"}]}]
    assert sorted(contents(run(s, {"group_by": conf}))) == ["BAR", "foo\nbar foo", "neither"]


def test_expansion(spark):
    s = texts(spark, '{"id":"foobar","items":[{"c":"a"},{"c":"b"},{"c":"c"}]}')
    out = run(s, {"mapping": 'let id = this.id\nroot = this.items.map_each(i -> i.assign({"id": $id}))'}, {"unarchive": {"format": "json_array"}})
    assert [json.loads(c) for c in contents(out)] == [{"c": x, "id": "foobar"} for x in "abc"]


@pytest.mark.parametrize("kind", ["lines", "json_array", "tar", "zip", "binary"])
def test_archives_round_trip(spark, kind):
    s = texts(spark, '{"a":1}', '{"a":2}', '{"a":3}')
    out = run(s, {"archive": {"format": kind}}, {"unarchive": {"format": kind}})
    assert contents(out) == ['{"a":1}', '{"a":2}', '{"a":3}']


def test_unarchive_failure_keeps_the_row(spark):
    out = run(texts(spark, "[1,2]", "nope"), {"unarchive": {"format": "json_array"}})
    rows = out.df.select("_content", F.col("_error.message").alias("e")).collect()
    assert sorted((r["_content"], r["e"] is None) for r in rows) == [("1", True), ("2", True), ("nope", False)]


def test_unarchive_csv_and_map(spark):
    out = run(texts(spark, "a,b\n1,2\n3,4"), {"unarchive": {"format": "csv"}})
    assert [json.loads(c) for c in contents(out)] == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]
    out = run(texts(spark, '{"x":{"v":1},"y":2}'), {"unarchive": {"format": "json_map"}})
    assert {r["_meta"]["archive_key"]: r["_content"] for r in out.df.collect()} == {"x": '{"v":1}', "y": "2"}


def test_errors_flow_and_are_caught(spark):
    s = texts(spark, '{"n":"1"}', '{"n":"x"}')
    out = run(s, {"mapping": "root.v = this.n.number()"})
    rows = out.df.orderBy("_seq").collect()
    assert rows[0]["v"] == 1.0 and rows[0]["_error"] is None and "could not parse" in rows[1]["_error"]["message"] and rows[1]["_error"]["name"] == "mapping"
    out = run(s, {"mapping": "root.v = this.n.number()"}, {"catch": [{"mapping": 'root.v = -1.0\nroot.why = error().has_prefix("could")'}]})
    assert sorted((r["v"], r["why"]) for r in out.df.collect()) == [(-1.0, True), (1.0, None)] or {(r["v"], r["why"]) for r in out.df.collect()} == {(1.0, None), (-1.0, True)}


def test_try_skips_failed_rows_and_try_catch_notes_them(spark):
    s = texts(spark, '{"n":"1"}', '{"n":"x"}')
    out = run(s, {"try": [{"mapping": "root.v = this.n.number()"}, {"mutation": "root.v = this.v + 1"}]})
    assert {(r["v"], r["_error"] is None) for r in out.df.collect()} == {(2.0, True), (None, False)}
    out = run(s, {"try_catch": {"processors": [{"mapping": "root.v = this.n.number()"}], "error_metadata": "why", "catch": [{"mapping": "root.v = 0.0\nroot.why = @why"}]}})
    rows = {r["v"]: r for r in out.df.collect()}
    assert "could not parse" in rows[0.0]["why"] and rows[1.0]["_error"] is None


def test_interpreter_fallback(spark):
    s = texts(spark, '{"a":{"b":"&lt;"}}', "junk")
    text = 'map walk { root = match this { this.type() == "object" => this.map_each(i -> i.value.apply("walk")), this.type() == "string" => this.unescape_html(), _ => this } }\nroot = this.apply("walk")'
    rows = run(s, {"mapping": text}).df.orderBy("_seq").collect()
    assert rows[0]["_content"] == '{"a":{"b":"<"}}' and rows[1]["_content"] == "junk" and rows[1]["_error"] is not None


def test_branch_on_text(spark):
    s = texts(spark, '{"id":1,"keep":"x"}')
    out = run(s, {"branch": {"request_map": "root.n = this.id", "processors": [{"mapping": "root.m = this.n.number() + 1"}], "result_map": "root.next = this.m"}})
    assert json.loads(contents(out)[0]) == {"id": 1, "keep": "x", "next": 2}


def test_cache_operators(spark):
    res = Resources(spark=spark, caches={"c": {"memory": {"init_values": {"a": "1"}}}})
    s = texts(spark, "a", "b", "b")
    get = run(s, {"cache": {"resource": "c", "operator": "get", "key": "${! content().string() }"}}, res=res).df.orderBy("_seq").collect()
    assert get[0]["_content"] == "1" and get[1]["_error"]["message"] == "key does not exist" and get[1]["_content"] == "b"
    add = run(s, {"cache": {"resource": "c", "operator": "add", "key": "${! content().string() }", "value": "v"}}, res=res).df.orderBy("_seq").collect()
    assert [r["_error"] is None for r in add] == [False, True, False]
    exists = run(s, {"cache": {"resource": "c", "operator": "exists", "key": "${! content().string() }"}}, res=res)
    assert contents(exists) == ["true", "true", "true"]
    run(s, {"cache": {"resource": "c", "operator": "delete", "key": "${! content().string() }"}}, res=res)
    assert res.caches["c"].count() == 0
    run(s, {"cache": {"resource": "c", "operator": "set", "key": "k", "value": "${! content().string() }"}}, res=res)
    assert [tuple(r) for r in res.caches["c"].collect()] == [("k", "b")]


def test_multilevel_cache(spark):
    from millrace.operators.lookups import cache_table

    res = Resources(spark=spark, caches={"l1": {"lru": {"init_values": {"a": "1"}}}, "l2": {"memory": {"init_values": {"a": "2", "b": "3"}}}, "m": {"multilevel": ["l1", "l2"]}, "n": {"noop": {}}})
    assert sorted(map(tuple, cache_table(res, "m").collect())) == [("a", "1"), ("b", "3")] and cache_table(res, "n").count() == 0


def test_joins(spark):
    a = Stream(spark.createDataFrame([(0, "aaa", "A", "20"), (1, "bbb", "B", "21"), (2, "ccc", "B", "22")], "_seq int, id string, name string, age string"))
    h = Stream(spark.createDataFrame([(0, "ccc", "fencing"), (1, "aaa", "running"), (2, "aaa", "gaming"), (3, "", "lost"), (4, None, "lost")], "_seq int, id string, hobby string"))
    out = {r["id"]: r for r in merge_join([a, h], "id", "full-outer", "array").df.collect()}
    assert out["aaa"]["hobby"] == ["running", "gaming"] and out["bbb"]["hobby"] == [] and out["ccc"]["age"] == ["22"] and len(out) == 3
    f = Stream(spark.createDataFrame([(0, "aaa", "first"), (1, "ccc", "second"), (2, "aaa", "third")], "_seq int, id string, stuff string"))
    rows = lambda s: sorted((r["id"], r["hobby"], r["stuff"]) for r in merge_join([a, h, f], "id", "outer", s).df.collect())
    assert rows("replace") == [("aaa", "gaming", "first"), ("aaa", "gaming", "third"), ("ccc", "fencing", "second")]
    assert rows("keep") == [("aaa", "running", "first"), ("aaa", "running", "first"), ("ccc", "fencing", "second")]
    assert rows("array") == [("aaa", ["running", "gaming"], ["first"]), ("aaa", ["running", "gaming"], ["first", "third"]), ("ccc", ["fencing"], ["second"])]


def test_split_by_bytes_and_bounds(spark):
    s = texts(spark, "aa", "bb", "ccccc", "d")
    out = run(s, {"split": {"byte_size": 4}}).df.orderBy("_seq").collect()
    assert [r["_batch"] for r in out] == ["0/0", "0/0", "0/1", "0/2"]
    assert run(s, {"bounds_check": {"max_part_size": 4}}).df.count() == 0 and run(s, {"bounds_check": {"max_part_size": 5}}).df.count() == 4


def test_insert_and_select(spark):
    s = texts(spark, "a", "b", "c")
    assert contents(run(s, {"insert_part": {"index": 1, "content": "new"}})) == ["a", "new", "b", "c"]
    assert contents(run(s, {"insert_part": {"index": -1, "content": "end"}})) == ["a", "b", "c", "end"]
    assert contents(run(s, {"select_parts": {"parts": [2, 0, -1]}})) == ["c", "a", "c"]


def test_switch_fallthrough(spark):
    s = texts(spark, "a", "b", "c")
    cases = [{"check": 'content().string() == "a"', "processors": [{"mapping": 'root = content().string() + "1"'}], "fallthrough": True}, {"check": 'content().string() == "b"', "processors": [{"mapping": 'root = content().string() + "2"'}]}]
    assert contents(run(s, {"switch": cases})) == ["a12", "b2", "c"]


def test_grok_and_logs(spark):
    line = '203.0.113.7 - bob [10/Oct/2020:13:55:36 +0000] "GET /a/b HTTP/1.1" 200 512'
    row = run(texts(spark, line, "junk"), {"grok": {"expressions": ["%{COMMONAPACHELOG}"]}}).df.orderBy("_seq").collect()
    assert row[0]["clientip"] == "203.0.113.7" and row[0]["verb"] == "GET" and row[0]["response"] == "200" and row[1]["_error"] is not None
    out = run(texts(spark, "x=5 y"), {"grok": {"expressions": ["x=%{INT:a.b:int}"]}})
    assert json.loads(contents(out)[0]) == {"a": {"b": 5}}
    row = run(texts(spark, "<13>Dec  2 16:31:03 host app[12]: hello"), {"parse_log": {"format": "syslog_rfc3164", "default_year": 2020}}).df.collect()[0]
    assert (row["hostname"], row["appname"], row["procid"], row["message"], row["severity"]) == ("host", "app", "12", "hello", 5) and row["timestamp"] == "2020-12-02T16:31:03Z"


def test_json_schema(spark):
    out = run(texts(spark, '{"a":1}', '{"a":"x"}'), {"json_schema": {"schema": '{"properties":{"a":{"type":"integer"}}}'}})
    assert [r["_error"] is None for r in out.df.orderBy("_seq").collect()] == [True, False]


def test_workflow_layers():
    b = {"c": {"request_map": "root = this.b1", "result_map": "root.c1 = this"}, "a": {"request_map": "root = this.x", "result_map": "root.a1 = this"}, "b": {"request_map": "root = this.a1", "result_map": "root.b1 = this"}}
    assert layers_of(b) == [["a"], ["b"], ["c"]]
    b["a"]["request_map"] = "root = this.c1"
    with pytest.raises(ConfigError):
        layers_of(b)


def test_workflow_tells_what_failed(spark):
    s = Stream(spark.createDataFrame([(1, "5"), (2, "x")], "id int, foo string"))
    branches = {"b1": {"request_map": "root.v = this.foo", "processors": [{"mapping": "root.r = this.v.number()"}], "result_map": "root.bar = this.r"}, "b2": {"request_map": "root.v = this.id", "processors": [{"mapping": "root.r = this.v + 1"}], "result_map": "root.next = this.r"}}
    out = {r["id"]: r for r in run(s, {"workflow": {"branches": branches}}).df.collect()}
    assert out[1]["meta"]["workflow"]["succeeded"] == ["b1", "b2"] and out[1]["meta"]["workflow"]["failed"] is None and out[1]["_error"] is None
    assert out[2]["meta"]["workflow"]["succeeded"] == ["b2"] and list(out[2]["meta"]["workflow"]["failed"]) == ["b1"] and out[2]["next"] == 3
    assert "b1" in out[2]["_error"]["message"]


def test_file_cache_keeps_what_is_written(spark, tmp_path):
    res = Resources(spark=spark, caches={"c": {"file": {"directory": str(tmp_path / "c")}}})
    conf = lambda op: {"cache": {"resource": "c", "operator": op, "key": "${! content().string() }", "value": "v-${! content().string() }"}}
    run(texts(spark, "a", "b"), conf("set"), res=res)
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if p.suffix != ".crc") == ["a", "b"] and (tmp_path / "c" / "a").read_text() == "v-a"
    added = run(texts(spark, "b", "d"), conf("add"), res=res).df.collect()
    assert sorted(r["_error"] is None for r in added) == [False, True] and (tmp_path / "c" / "d").exists()
    run(texts(spark, "a"), conf("delete"), res=res)
    got = run(texts(spark, "a", "d"), conf("get"), res=res).df.collect()
    assert not (tmp_path / "c" / "a").exists() and sorted((r["_content"], r["_error"] is None) for r in got) == [("a", False), ("v-d", True)]


def test_retry_and_while(spark):
    out = run(texts(spark, "1", "x"), {"retry": {"max_retries": 2, "processors": [{"mapping": "root.v = content().string().number()"}]}})
    rows = out.df.collect()
    assert {(r["_meta"]["retry_count"], r["_error"] is None) for r in rows} == {("0", True), ("2", False)}
    s = Stream(spark.createDataFrame([(1,), (5,)], "n long"))
    assert sorted(r["n"] for r in run(s, {"while": {"check": "this.n < 4", "max_loops": 10, "processors": [{"mutation": "root.n = this.n + 1"}]}}).df.collect()) == [4, 5]


def test_commands_are_off_unless_allowed(spark):
    with pytest.raises(ConfigError):
        run(texts(spark, "a"), {"command": {"name": "cat"}})
    res = Resources(spark=spark, allow_commands=True)
    assert contents(run(texts(spark, "a"), {"command": {"name": "cat"}}, res=res)) == ["a"]
    assert contents(run(texts(spark, "a", "b"), {"subprocess": {"name": "cat"}}, res=res)) == ["a", "b"]


def test_observed_metrics(spark):
    res = Resources(spark=spark, rate_limits={"r": {"local": {"count": 1, "interval": "1s"}}})
    out = run(texts(spark, "a", "b"), {"metric": {"type": "counter", "name": "seen"}}, {"log": {"message": "${! content().string() }"}}, {"benchmark": {}}, {"rate_limit": {"resource": "r"}}, {"sleep": {"duration": "1s"}}, {"noop": {}}, res=res)
    out.df.collect()
    assert res.observed["seen"]["observation"].get["count"] == 2


JQ = [
    (".a.b", {"a": {"b": 1}}, [1]), (".[] | select(. > 1)", [1, 2, 3], [2, 3]), ("{a, b: .c}", {"a": 1, "c": 2}, [{"a": 1, "b": 2}]), ("map(. * 2) | add", [1, 2], [6]), ("[.[] | tostring] | join(\"-\")", [1, 2], ["1-2"]),
    (".a // \"none\"", {}, ["none"]), ("to_entries | map(.key)", {"x": 1}, [["x"]]), ("if . > 1 then \"big\" elif . == 1 then \"one\" else \"small\" end", 1, ["one"]), ("reduce .[] as $x (0; . + $x)", [1, 2, 3], [6]),
    ("def f(x): x + 1; f(.)", 1, [2]), (".a |= . + 1", {"a": 1}, [{"a": 2}]), ("del(.a)", {"a": 1, "b": 2}, [{"b": 2}]), ("group_by(.k) | map(length)", [{"k": 1}, {"k": 2}, {"k": 1}], [[2, 1]]), ("\"x\\(.a)y\"", {"a": 5}, ["x5y"]),
    (".. | numbers", {"a": [1, {"b": 2}]}, [1, 2]), ("[limit(2; .[])]", [1, 2, 3], [[1, 2]]), ("test(\"a+\")", "caat", [True]), ("gsub(\"a\"; \"b\")", "aXa", ["bXb"]), (".[1:]", [1, 2, 3], [[2, 3]]), ("try error(\"x\") catch .", None, ["x"]),
    ("sort_by(.a) | first.a", [{"a": 2}, {"a": 1}], [1]), ("with_entries(.value += 1)", {"a": 1}, [{"a": 2}]), ("@base64", "hi", ["aGk="]), ("any(. > 2)", [1, 3], [True]), ("[range(3)]", None, [[0, 1, 2]]), ("empty", 1, []),
]


@pytest.mark.parametrize("text,doc,want", JQ, ids=[j[0][:30] for j in JQ])
def test_jq(text, doc, want):
    assert list(jq.run(jq.compile(text), doc)) == want


PATHS = [
    ("a.b", {"a": {"b": 1}}, 1), ("a[0]", {"a": [5]}, 5), ("a[-1]", {"a": [5, 6]}, 6), ("a[*].b", {"a": [{"b": 1}, {"b": 2}, {}]}, [1, 2]), ("a[?b > `1`].b", {"a": [{"b": 1}, {"b": 2}]}, [2]), ("a[].c[]", {"a": [{"c": [1, 2]}, {"c": [3]}]}, [1, 2, 3]),
    ("{x: a, y: b}", {"a": 1, "b": 2}, {"x": 1, "y": 2}), ("[a, b]", {"a": 1, "b": 2}, [1, 2]), ("sort_by(a, &k)[0].k", {"a": [{"k": 2}, {"k": 1}]}, 1), ("length(a)", {"a": [1, 2]}, 2), ("a | [0]", {"a": [7]}, 7), ("a || b", {"b": 3}, 3),
    ("*.x", {"p": {"x": 1}, "q": {"x": 2}}, [1, 2]), ("a[1:3]", {"a": [1, 2, 3, 4]}, [2, 3]), ("contains('abc', 'b')", {}, True), ("join(', ', a[?s=='W'].n)", {"a": [{"n": "x", "s": "W"}, {"n": "y", "s": "N"}]}, "x"),
]


@pytest.mark.parametrize("text,doc,want", PATHS, ids=[p[0] for p in PATHS])
def test_jmespath(text, doc, want):
    assert jmespath.search(jmespath.compile(text), doc) == want
