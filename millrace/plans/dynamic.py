"""What runs in Python: single methods on their arguments, and whole mappings on documents of unknown shape."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.lang.values import DELETE, NOTHING, MappingError, as_bytes, as_timestamp, from_json, to_json, to_text


def _plain(v):
    """A value as the library knows it."""
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, pd.Timestamp):
        return as_timestamp(v.to_pydatetime())
    return v


@lru_cache(None)
def method_step(name: str, as_json: tuple[bool, ...], result: str):
    """A method of the library as an Arrow function of (target, arguments...) to struct<value, error>."""
    kind = {"json": "string"}.get(result, result)

    def step(*columns: pa.Array) -> pa.Array:
        from millrace.functions.library import METHODS

        call = METHODS[name]
        values, errors = [], []
        for row in zip(*[c.to_pylist() for c in columns]):
            try:
                args = [from_json(x) if j and x is not None else _plain(x) for x, j in zip(row, as_json)]
                if call.wants_ctx:
                    from millrace.lang.interp import Context

                    args.insert(0, Context())
                out = call.call(*args)
                values.append(_shaped(out, result))
                errors.append(None)
            except MappingError as e:
                values.append(None)
                errors.append(str(e))
        return pa.StructArray.from_arrays([pa.array(values, _arrow(kind)), pa.array(errors, pa.string())], names=["value", "error"])

    return F.arrow_udf(step, f"value {kind}, error string")


def _arrow(kind: str):
    return {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "timestamp": pa.timestamp("us", "UTC"), "decimal(20,0)": pa.decimal128(20, 0)}[kind]


def _shaped(v, result: str):
    if v is None:
        return None
    if result == "json":
        return to_json(v)
    if result == "string":
        return to_text(v)
    if result == "binary":
        return as_bytes(v)
    if result == "timestamp":
        return as_timestamp(v)
    if result.startswith("decimal"):
        return Decimal(int(v))
    return int(v)


MAPPED = "content string, meta map<string,string>, error string, gone boolean"


def mapping_step(text: str, onto: bool, imports: dict | None = None):
    """A mapping run by the interpreter on single messages: (content JSON or text, meta) to struct<content, meta, error, gone>."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from millrace.lang.interp import Message, run_mapping
        from millrace.lang.parser import parse

        mapping = parse(text, (imports or {}).__getitem__)
        state: dict = {}
        for contents, metas in batches:
            rows = [map_one(mapping, Message(c, dict(m) if m else {}), state, onto) for c, m in zip(contents, metas)]
            yield pd.DataFrame(rows, columns=["content", "meta", "error", "gone"])

    def map_one(mapping, message, state, onto):
        from millrace.lang.interp import run_mapping

        try:
            out = run_mapping(mapping, [message], 0, state, onto)
        except MappingError as e:
            return message.content, message.meta, str(e), False
        if out is None:
            return None, None, None, True
        return content_text(out.content), {k: to_text(v) for k, v in out.meta.items()}, None, False

    return F.pandas_udf(run, MAPPED)


def overlay_step(text: str, imports: dict | None = None):
    """A result mapping laid over an original document: (result, original, meta) to struct<content, error>."""

    def run(results: pd.Series, originals: pd.Series, metas: pd.Series) -> pd.DataFrame:
        from millrace.lang.interp import Context, Message, _statements
        from millrace.lang.parser import parse

        mapping = parse(text, (imports or {}).__getitem__)
        out = []
        for result, original, meta in zip(results, originals, metas):
            try:
                ctx = Context([Message(result, dict(meta) if meta else {})], 0, root=from_json(original), maps=mapping.maps)
                _statements(mapping.statements, ctx, False)
                out.append((content_text(ctx.root), None))
            except MappingError as e:
                out.append((original, str(e)))
        return pd.DataFrame(out, columns=["content", "error"])

    return F.pandas_udf(run, "content string, error string")


def content_text(v) -> str:
    """The text of a message's content: strings as they are, structured values as JSON."""
    if isinstance(v, str):
        return v
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).decode("utf-8", "replace")
    if v is DELETE or v is NOTHING:
        return ""
    return to_json(v)
