"""Scanners: the bytes of files to rows. Each gives a stream with ``_content`` and ``_seq`` (path, then place in the file).

Lines and whole texts are read by Spark's own splittable readers; formats whose records cross lines read a file whole
in one task and cut it there.
"""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.envelope import ConfigError, Stream, named

ALGORITHMS = ("gzip", "pgzip", "zlib", "flate", "bzip2", "zstd", "lz4", "snappy")


def text_of(piece: bytes) -> str:
    """The text of a piece; one that is not UTF-8 as base64, like compressed content."""
    try:
        return piece.decode()
    except UnicodeDecodeError:
        return base64.b64encode(piece).decode()


def cut(kind: str, conf: dict, data: bytes, name: str = "") -> list[tuple[str, str | None]]:
    """The records of a file's bytes: (content, key)."""
    if kind == "lines":
        by = (conf.get("custom_delimiter") or "\n").encode()
        parts = data.split(by)
        if parts and parts[-1] == b"":
            parts.pop()
        parts = [p[:-1] if by == b"\n" and p.endswith(b"\r") else p for p in parts]
        return [(text_of(p), None) for p in parts if p or not conf.get("omit_empty")]
    if kind == "to_the_end":
        return [(text_of(data), None)]
    if kind == "chunker":
        n = int(conf["size"])
        return [(text_of(data[i : i + n]), None) for i in range(0, len(data), n)]
    if kind == "re_match":
        text = data.decode("utf-8", "replace")
        starts = [m.start() for m in re.finditer(conf["pattern"], text, re.M)]
        bounds = sorted({0, *starts, len(text)})
        return [(text[a:b], None) for a, b in zip(bounds, bounds[1:]) if b > a]
    if kind == "skip_bom":
        for bom in (b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff"):
            while data.startswith(bom):
                data = data[len(bom) :]
        return cut(*_inner(conf), data, name)
    if kind == "decompress":
        from millrace.functions.coding import decompressed

        return cut(*_inner(conf), decompressed(data, conf["algorithm"]), name)
    if kind == "json_documents":
        from millrace.sources.archives import json_documents

        return [(d, None) for d in json_documents(data.decode())]
    if kind == "json_array":
        import json

        from millrace.lang.values import to_json
        from millrace.sources.archives import json_documents

        out = []
        for d in json_documents(data.decode()):
            items = json.loads(d)
            if not isinstance(items, list):
                raise ValueError("expected a JSON array")
            out += [(to_json(x), None) for x in items]
        return out
    if kind == "tar":
        import io
        import tarfile

        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            return [(text_of(t.extractfile(m).read()), m.name) for m in t if m.isfile()]
    if kind == "csv":
        import csv
        import io

        from millrace.lang.values import to_json

        rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig", "replace")), delimiter=conf.get("custom_delimiter") or ",", strict=not conf.get("lazy_quotes")) if r]
        if not conf.get("parse_header_row", True):
            return [(to_json(r), None) for r in rows]
        return [(to_json(dict(zip(rows[0], r))), None) for r in rows[1:]] if rows else []
    if kind == "switch":
        for case in conf:
            if re.search(case.get("re_match_name") or "", name):
                return cut(*named(case["scanner"])[:2], data, name)
        raise ValueError(f"no scanner for {name}")
    raise ConfigError(f"unknown scanner {kind!r}")


def _inner(conf: dict) -> tuple[str, dict]:
    kind, settings, _ = named(conf.get("into") or {"to_the_end": {}})
    return kind, settings or {}


def scan(spark: SparkSession, paths: list[str], scanner: dict | None = None) -> Stream:
    """The records of files; ``_meta`` has path and, where records have one, key or row."""
    kind, conf, _ = named(scanner or {"lines": {}})
    conf = conf or {}
    if kind == "lines" and not conf.get("custom_delimiter"):
        df = spark.read.text(paths)
        if conf.get("omit_empty"):
            df = df.where("value <> ''")
        return _ordered(df.select(F.regexp_replace("value", "\r$", "").alias("_content"), F.col("_metadata.file_path").alias("_path")))
    if kind == "lines":
        df = spark.read.option("lineSep", conf["custom_delimiter"]).text(paths)
        if conf.get("omit_empty"):
            df = df.where("value <> ''")
        return _ordered(df.select(F.col("value").alias("_content"), F.col("_metadata.file_path").alias("_path")))
    if kind == "to_the_end":
        return _ordered(spark.read.text(paths, wholetext=True).select(F.col("value").alias("_content"), F.col("_metadata.file_path").alias("_path")))
    files = spark.read.format("binaryFile").load(paths)
    return cut_rows(files, kind, conf)


def _ordered(df: DataFrame) -> Stream:
    meta = F.create_map(F.lit("path"), F.col("_path"))
    return Stream(df.select(F.monotonically_increasing_id().alias("_seq"), meta.alias("_meta"), "_content"))


def cut_rows(files: DataFrame, kind: str, conf) -> Stream:
    """Files (path, content) cut into records, a file at a time."""

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = cut(kind, conf, bytes(content), path)
                yield pd.DataFrame({"path": path, "i": range(len(rows)), "content": [c for c, _ in rows], "key": [k for _, k in rows]})

    rows = files.select("path", "content").mapInPandas(run, "path string, i long, content string, key string")
    seq = F.concat(F.col("path"), F.lit("#"), F.lpad(F.col("i").cast("string"), 12, "0"))
    named_key = F.create_map(F.lit("path"), F.col("path"), F.lit("csv_row" if kind == "csv" else "key"), F.coalesce("key", F.col("i").cast("string")))
    meta = named_key if kind in ("csv", "tar") else F.create_map(F.lit("path"), F.col("path"))
    return Stream(rows.select(seq.alias("_seq"), meta.alias("_meta"), F.col("content").alias("_content")))
