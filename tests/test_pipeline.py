"""Configs: substitution, templates, lint, declarative tests, inputs, scanners and outputs."""

from __future__ import annotations

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from millrace.operators.envelope import ConfigError, Resources, Stream
from millrace.plans.pipeline import Pipeline, lint, load_template, run_tests, substitute
from millrace.sources import inputs, outputs
from millrace.sources.scanners import cut, scan


def test_substitution():
    assert substitute("a: ${X:5}\nb: ${Y}", {"Y": "z"}) == "a: 5\nb: z"


def test_substitution_with_a_function():
    assert substitute("${X:YSBi|base64decode} ${Y|base64decode} ${Z:a}", {"Y": "eg=="}) == "a b z a"
    with pytest.raises(ConfigError):
        substitute("${X:bar|upper}", {})


def test_lint_of_exporters():
    assert lint({"metrics": {"nonsense": {}}}) and lint({"tracer": {"wat": {}}})
    assert not lint({"metrics": {"json_api": {}, "mapping": "root = this"}, "tracer": {"none": {}}})


def test_csv_with_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    rows = inputs.read({"csv": {"paths": [str(tmp_path / "a.csv")]}}, Resources(spark=spark)).df.collect()
    assert sorted((r["a"], r["b"]) for r in rows) == [("1", "x\ny"), ("2", "z")]


def test_chunks_that_are_no_text():
    import base64

    pieces = [c for c, _ in cut("chunker", {"size": 3}, "äöü".encode())]
    assert b"".join(base64.b64decode(p) for p in pieces) == "äöü".encode()
    assert [c for c, _ in cut("chunker", {"size": 2}, "äöü".encode())] == ["ä", "ö", "ü"]


def test_imports_from_files(spark, tmp_path):
    (tmp_path / "shapes.blobl").write_text("map twice { root = this * 2 }")
    (tmp_path / "whole.blobl").write_text("root.w = this.v + 1")
    conf = {"input": {"generate": {"count": 2, "mapping": "root.v = counter()"}}, "pipeline": {"processors": [{"mapping": f'import "{tmp_path}/shapes.blobl"\nroot.v = this.v\nroot.t = this.v.apply("twice")'}, {"mapping": f'from "{tmp_path}/whole.blobl"'}]}}
    assert sorted(r["w"] for r in Pipeline.of(conf, spark).stream().df.collect()) == [2, 3]
    with pytest.raises(ConfigError):
        Pipeline.of({"input": conf["input"], "pipeline": {"processors": [{"mapping": 'import "/nowhere"\nroot = this'}]}}, spark).stream()


CONFIG = """
input:
  generate:
    count: ${N:6}
    batch_size: 3
    mapping: |
      root.id = counter()
      root.group = if this.x == null { "g" }
pipeline:
  processors:
    - mutation: root.double = this.id * 2
    - switch:
        - check: this.double > 8
          processors:
            - mapping: root = deleted()
output:
  drop: {}
"""


def test_pipeline(spark):
    p = Pipeline.load(CONFIG.replace('      root.group = if this.x == null { "g" }\n', ""), spark, {})
    assert sorted(r["double"] for r in p.stream().df.collect()) == [2, 4, 6, 8]
    p.run()


def test_lint():
    assert lint({"input": {"generate": {}}, "nope": 1}) == ["unknown field nope"]
    assert lint({"pipeline": {"processors": [{"mapping": "root = ("}, {"wat": {}}, {"a": 1, "b": 2}]}})
    assert not lint({"pipeline": {"processors": [{"try": [{"noop": {}}]}]}})


def test_template(spark):
    t = load_template("name: doubler\ntype: processor\nfields:\n  - name: field\n  - name: by\n    default: 2\nmapping: |\n  root.mutation = \"root.%v = this.%v * %v\".format(this.field, this.field, this.by)")
    p = Pipeline.load("input: {generate: {count: 2, mapping: 'root.v = counter()'}}\npipeline: {processors: [{doubler: {field: v}}]}", spark, {}, [t])
    assert sorted(r["v"] for r in p.stream().df.collect()) == [2, 4]
    with pytest.raises(ConfigError):
        Pipeline.load("pipeline: {processors: [{doubler: {}}]}", spark, {}, [t])


def test_declared_tests(spark):
    config = {
        "pipeline": {"processors": [{"mapping": "root = content().string().uppercase()\nmeta seen = \"yes\""}]},
        "tests": [
            {"name": "good", "input_batch": [{"content": "a"}], "output_batches": [[{"content_equals": "A", "metadata_equals": {"seen": "yes"}}]]},
            {"name": "bad", "input_batch": [{"content": "a"}], "output_batches": [[{"content_equals": "B"}]]},
        ],
    }
    assert [f.split(":")[0] for f in run_tests(config, spark)] == ["bad"]


SCANS = [
    ("lines", {}, b"a\nb\n\nc", ["a", "b", "", "c"]), ("lines", {"omit_empty": True, "custom_delimiter": "X"}, b"aXXb", ["a", "b"]), ("chunker", {"size": 3}, b"abcdefgh", ["abc", "def", "gh"]),
    ("to_the_end", {}, b"a\nb", ["a\nb"]), ("skip_bom", {"into": {"lines": {}}}, b"\xef\xbb\xbfa\nb", ["a", "b"]), ("re_match", {"pattern": "^--"}, b"--a\nx\n--b\n", ["--a\nx\n", "--b\n"]),
    ("json_documents", {}, b'{"a":1}\n{ "a" :\n2}', ['{"a":1}', '{ "a" :\n2}']), ("json_array", {}, b'[{"a":1},2][3]', ['{"a":1}', "2", "3"]), ("csv", {}, b'a,b\n1,"x,y"\n', ['{"a":"1","b":"x,y"}']),
    ("csv", {"parse_header_row": False}, b"1,2\n", ['["1","2"]']), ("switch", [{"re_match_name": r"\.csv$", "scanner": {"csv": {}}}, {"scanner": {"to_the_end": {}}}], b"a\n1", ["a\n1"]),
]


@pytest.mark.parametrize("kind,conf,data,want", SCANS, ids=[f"{s[0]}-{i}" for i, s in enumerate(SCANS)])
def test_scanner(kind, conf, data, want):
    assert [c for c, _ in cut(kind, conf, data, "f.txt")] == want


def test_decompress_and_tar():
    import gzip

    assert [c for c, _ in cut("decompress", {"algorithm": "gzip", "into": {"lines": {}}}, gzip.compress(b"a\nb"))] == ["a", "b"]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n, b in (("x.txt", b"1"), ("y.txt", b"2")):
            info = tarfile.TarInfo(n)
            info.size = len(b)
            t.addfile(info, io.BytesIO(b))
    assert cut("tar", {}, out.getvalue()) == [("1", "x.txt"), ("2", "y.txt")]


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    res = Resources(spark=spark)
    s = inputs.read({"csv": {"paths": [str(tmp_path / "a.csv")]}}, res)
    assert sorted((r["id"], r["name"]) for r in s.df.collect()) == [("1", "x"), ("2", "y")]
    lines = scan(spark, [str(tmp_path / "a.csv")])
    assert lines.df.count() == 3 and lines.df.first()["_meta"]["path"].endswith("a.csv")
    docs = inputs.read({"file": {"paths": [str(tmp_path / "a.csv")], "scanner": {"csv": {}}}}, res)
    assert sorted(r["_content"] for r in docs.df.collect()) == ['{"id":"1","name":"x"}', '{"id":"2","name":"y"}']
    outputs.write(s, {"file": {"path": f"file://{tmp_path}/out"}}, res)
    assert sorted(json.loads(r["value"])["id"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1", "2"]
    outputs.write(s, {"file": {"path": f"{tmp_path}/by/" + "${! this.name }"}}, res)
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.is_dir()) == ["name=x", "name=y"]


def rows(spark, *texts):
    return Stream(spark.createDataFrame([(i, str(i % 2), t) for i, t in enumerate(texts)], "_seq long, _batch string, _content string"))


def test_outputs(spark, tmp_path):
    res = Resources(spark=spark, caches={"c": {"memory": {}}}, outputs={"o": {"inproc": "from_resource"}})
    s = rows(spark, "a", "b", "c")
    outputs.write(s, {"resource": "o"}, res)
    assert res.pipes["from_resource"].df.count() == 3 and inputs.read({"inproc": "from_resource"}, res).df.count() == 3
    outputs.write(s, {"broker": {"pattern": "fan_out", "outputs": [{"inproc": "p1"}, {"inproc": "p2"}]}}, res)
    assert res.pipes["p1"].df.count() == res.pipes["p2"].df.count() == 3
    outputs.write(s, {"broker": {"pattern": "round_robin", "outputs": [{"inproc": "r1"}, {"inproc": "r2"}]}}, res)
    assert [res.pipes[p].df.count() for p in ("r1", "r2")] == [2, 1]
    outputs.write(s, {"broker": {"pattern": "greedy", "outputs": [{"inproc": "g1"}, {"inproc": "g2"}]}}, res)
    assert res.pipes["g1"].df.count() + res.pipes["g2"].df.count() == 3
    outputs.write(s, {"switch": {"cases": [{"check": 'content().string() == "a"', "output": {"inproc": "sa"}, "continue": True}, {"output": {"inproc": "rest"}}]}}, res)
    assert res.pipes["sa"].df.count() == 1 and res.pipes["rest"].df.count() == 3
    with pytest.raises(outputs.Rejected):
        outputs.write(s, {"switch": {"strict_mode": True, "cases": [{"check": 'content().string() == "a"', "output": {"drop": {}}}]}}, res)
    outputs.write(s, {"fallback": [{"reject": "no"}, {"inproc": "fell"}]}, res)
    assert res.pipes["fell"].df.first()["_meta"]["fallback_error"] == "no"
    outputs.write(s, {"drop_on": {"error_patterns": ["^no"], "output": {"reject": "no way"}}}, res)
    with pytest.raises(outputs.Rejected):
        outputs.write(s, {"drop_on": {"error_patterns": ["^x"], "output": {"reject": "no way"}}}, res)
    outputs.write(s, {"cache": {"target": "c", "key": "${! content().string() }"}}, res)
    assert res.caches["c"].count() == 3
    outputs.write(s, {"sync_response": {}}, res)
    outputs.write(s, {"dynamic": {"outputs": {"x": {"drop": {}}}}}, res)
    assert len(res.responses) == 1


def test_reject_errored(spark):
    res = Resources(spark=spark)
    s = rows(spark, "a", "b").ensure("_error").flag(F.when(F.col("_content") == "b", F.lit("bad")), "t")
    with pytest.raises(outputs.Rejected, match="bad"):
        outputs.write(s, {"reject_errored": {"inproc": "good"}}, res)
    assert res.pipes["good"].df.count() == 1


def test_faulty_sink_gets_every_row(spark):
    """A sink that fails twice: after the retries every row arrives, edited in order."""
    res, tries = Resources(spark=spark), []

    def flaky(stream, conf, res):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("down")
        res.responses.append([r["_content"] for r in stream.df.orderBy("_seq").collect()])

    outputs.OUTPUTS["flaky"] = flaky
    try:
        s = rows(spark, *[str(i) for i in range(100)])
        outputs.write(s, {"retry": {"output": {"flaky": {}}}, "processors": [{"mapping": 'root = content().string() + "a"'}, {"mapping": 'root = content().string() + "b"'}]}, res)
    finally:
        del outputs.OUTPUTS["flaky"]
    assert res.responses == [[f"{i}ab" for i in range(100)]]


def test_dynamic_and_batched_inputs(spark):
    res = Resources(spark=spark, inputs={"r": rows(spark, "a", "b", "c")})
    s = inputs.read({"dynamic": {"inputs": {"one": {"resource": "r"}, "two": {"resource": "r"}}}}, res)
    assert s.df.count() == 6 and {r["_meta"]["dynamic_input"] for r in s.df.collect()} == {"one", "two"}
    b = inputs.read({"batched": {"child": {"resource": "r"}, "policy": {"count": 1}}}, res)
    assert b.df.select("_batch").distinct().count() == 3
    until = inputs.read({"read_until": {"input": {"resource": "r"}, "check": 'content().string() == "b"'}}, res)
    assert sorted(r["_content"] for r in until.df.collect()) == ["a", "b"]


def test_listeners(spark):
    import socket
    import threading
    import urllib.request

    res = Resources(spark=spark)

    def later(f):
        return lambda port: threading.Thread(target=f, args=(port,), daemon=True).start()

    def post(port):
        for i in range(2):
            urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}/post", data=f"m{i}".encode(), method="POST")).read()

    s = inputs.read({"http_server": {"count": 2, "timeout_s": 20, "ready": later(post)}}, res)
    assert sorted(r["_content"] for r in s.df.collect()) == ["m0", "m1"]

    def lines(port):
        with socket.create_connection(("127.0.0.1", port)) as c:
            c.sendall(b"a\nb\n")

    s = inputs.read({"socket_server": {"count": 2, "timeout_s": 20, "ready": later(lines)}}, res)
    assert sorted(r["_content"] for r in s.df.collect()) == ["a", "b"]
    got = []

    def fetch(port):
        for _ in range(3):
            try:
                got.append(urllib.request.urlopen(f"http://127.0.0.1:{port}/get").read().decode())
            except OSError:
                got.append(None)

    outputs.write(rows(spark, "x", "y"), {"http_server": {"timeout_s": 20, "ready": later(fetch)}}, res)
    assert got[:2] == ["x", "y"]


def test_websocket(spark):
    import socket
    import threading

    from millrace.sources.net import accept_key, frame, read_message

    heard = []
    server = socket.create_server(("127.0.0.1", 0))

    def run():
        for _ in range(2):
            c, _ = server.accept()
            head = b""
            while b"\r\n\r\n" not in head:
                head += c.recv(1)
            key = head.split(b"Sec-WebSocket-Key: ")[1].split(b"\r\n")[0].decode()
            c.sendall(f"HTTP/1.1 101 Switching Protocols\r\nSec-WebSocket-Accept: {accept_key(key)}\r\n\r\n".encode())
            if not heard:
                heard.append(read_message(c))
                c.sendall(frame(b"one", False) + frame(b"t" * 70000, False) + frame(b"", False, 8))
            else:
                while (m := read_message(c)) is not None:
                    heard.append(m)
            c.close()

    t = threading.Thread(target=run, daemon=True)
    t.start()
    url = f"ws://127.0.0.1:{server.getsockname()[1]}/x"
    res = Resources(spark=spark)
    s = inputs.read({"websocket": {"url": url, "open_message": "hi"}}, res)
    assert sorted(len(r["_content"]) for r in s.df.collect()) == [3, 70000] and heard == ["hi"]
    one = Stream(rows(spark, "p", "q").df.coalesce(1))
    outputs.write(one, {"websocket": {"url": url}}, res)
    t.join(10)
    assert sorted(heard[1:]) == ["p", "q"]


def test_aliases(spark):
    from millrace.functions.registry import alias as name_method
    from millrace.lang.interp import query
    from millrace.operators.envelope import PROCESSORS, alias

    alias("older_mapping", "mapping")
    name_method("shout", "uppercase")
    assert PROCESSORS["older_mapping"] is PROCESSORS["mapping"] and query('"a".shout()') == "A"
