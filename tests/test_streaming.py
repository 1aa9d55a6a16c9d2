"""Windows and streams."""

from __future__ import annotations

import datetime
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.operators.envelope import ConfigError, Stream
from millrace.streaming import queries, windows

ROOT = str(Path(__file__).resolve().parent.parent)
T0 = datetime.datetime(2024, 1, 1, 15, 0, 0)


def test_windows_are_closed_on_the_right(spark):
    rows = [(T0,), (T0 + datetime.timedelta(microseconds=1),), (T0 + datetime.timedelta(hours=1),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = windows.windowed(df, "ts", "1h", [F.count("*").alias("n")]).orderBy("window_end").collect()
    assert [(r["window_end"], r["n"]) for r in got] == [(T0, 1), (T0 + datetime.timedelta(hours=1), 2)]


def test_sliding_and_offset(spark):
    df = spark.createDataFrame([(T0 + datetime.timedelta(minutes=4),)], "ts timestamp_ntz")
    ends = sorted(r["window_end"] for r in windows.windowed(df, "ts", "1h", [F.count("*").alias("n")], slide="10m").collect())
    assert len(ends) == 6 and ends[0] == T0 + datetime.timedelta(minutes=10)
    got = windows.windowed(df, "ts", "1h", [F.count("*").alias("n")], offset="30m").collect()
    assert [r["window_end"] for r in got] == [T0 + datetime.timedelta(minutes=30)]


def test_buffer_names_its_batches(spark):
    df = spark.createDataFrame([(1, T0), (2, None)], "id int, ts timestamp_ntz")
    out = windows.system_window(Stream.of(df, "id"), {"timestamp_mapping": "root = this.ts", "size": "1h"}).df.collect()
    assert len(out) == 1 and out[0]["_batch"] == "2024-01-01T15:00:00Z" == out[0]["_meta"]["window_end_timestamp"]
    with pytest.raises(ConfigError):
        windows.interval("1 fortnight")


def test_buffer_of_an_expression(spark):
    df = spark.createDataFrame([(1, "2024-01-01 14:30:00", 1704119400), (2, "no time", 1704119400)], "id int, t string, s long")
    by_text = windows.system_window(Stream.of(df, "id"), {"timestamp_mapping": 'root = this.t.ts_parse("2006-01-02 15:04:05")', "size": "1h"}).df.collect()
    assert [(r["id"], r["_batch"]) for r in by_text] == [(1, "2024-01-01T15:00:00Z")]
    by_number = windows.system_window(Stream.of(df, "id"), {"timestamp_mapping": "root = this.s + 3600", "size": "1h"}).df.collect()
    assert [(r["_batch"], "_ts" in r) for r in by_number] == [("2024-01-01T16:00:00Z", False)] * 2


def test_stream_with_restart(spark, tmp_path):
    schema = "id long, ts timestamp, kind string"
    rows = [(i, T0 + datetime.timedelta(minutes=i), "ab"[i % 2]) for i in range(20)]
    spark.createDataFrame(rows[:10], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    queries.written(read().select("id"), out, check)
    assert spark.read.parquet(out).count() == 10
    spark.createDataFrame(rows[10:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    queries.written(read().select("id"), out, check)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(20))
    deduped = queries.drained(queries.deduplicated(read(), ["kind"], "ts", "1h").select("kind"))
    assert sorted(r["kind"] for r in deduped.collect()) == ["a", "b"]
    late = queries.drained(windows.windowed(read(), "ts", "5m", [F.count("*").alias("n")], lateness="1m"))
    assert late.count() >= 1


def test_a_sink_that_fails_gets_its_batch_again(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "in"))
    seen, failed = [], []

    def use(stream, n):
        if not failed:
            failed.append(n)
            raise OSError("down")
        seen.extend(r["id"] for r in stream.df.collect())

    df = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception):  # noqa: B017
        queries.each_batch(df(), use, str(tmp_path / "check"))
    queries.each_batch(df(), use, str(tmp_path / "check"))
    assert sorted(seen) == list(range(50))


def test_the_driver_holds_no_rows_of_a_drained_stream(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        import __spark_entry__ as entry
        conf = {{"spark.driver.maxResultSize": "1m", "spark.ui.enabled": "false"}}
        spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
        spark.range(300000).selectExpr("id AS event_id", "current_timestamp() AS ts", "id AS user_id", "if(id % 3 = 0, 'click', 'view') AS event_type", "rand(1) AS value", "'' AS props").write.parquet({str(tmp_path)!r} + "/events.parquet")
        done = entry.queries()["stream_mapping"](spark, {str(tmp_path)!r})
        assert done.count() == done.select("id").distinct().count() == 200000
        assert done.selectExpr("sum(id)").first()[0] == sum(i for i in range(300000) if i % 3)
    """
    ran = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-3000:]


def test_drained_in_every_mode(spark, tmp_path):
    schema = "id long, kind string"
    for k in range(2):
        spark.createDataFrame([(10 * k + i, "ab"[i % 2]) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: queries.file_stream(spark, str(tmp_path / "in"), schema, max_files=1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    counts = lambda mode: sorted(tuple(r) for r in queries.drained(read().groupBy("kind").count(), mode, 2).collect())
    assert sorted(r["id"] for r in queries.drained(read()).collect()) == list(range(20))
    assert counts("complete") == [("a", 10), ("b", 10)]
    assert counts("update") == [("a", 5), ("a", 10), ("b", 5), ("b", 10)]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    (tmp_path / "none").mkdir()
    none = lambda: queries.file_stream(spark, str(tmp_path / "none"), schema)
    assert queries.drained(none()).collect() == queries.drained(none().groupBy("kind").count(), "complete").collect() == []
    assert queries.drained(none()).schema == none().schema


def test_http_source(spark):
    import http.server
    import threading

    from millrace.streaming.sources import register

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"hello " + self.path.encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        register(spark)
        base = f"http://127.0.0.1:{server.server_port}"
        got = spark.read.format("millrace_http").option("urls", f"{base}/a {base}/b").load().collect()
        assert sorted(r["body"] for r in got) == ["hello /a", "hello /b"]
    finally:
        server.shutdown()
