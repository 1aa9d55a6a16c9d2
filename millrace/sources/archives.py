"""Archives of several parts in one value: tar, zip and length-prefixed binary, as base64 text; CSV and JSON documents."""

from __future__ import annotations

import base64
import io
import struct
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import functions as F


def pack(kind: str, parts: list[tuple[str, bytes]]) -> str:
    out = io.BytesIO()
    if kind == "tar":
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, body in parts:
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
    elif kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in parts:
                z.writestr(zipfile.ZipInfo(name), body)
    else:  # a count, then each part after its length, all in 32 bits
        out.write(struct.pack(">I", len(parts)))
        for _, body in parts:
            out.write(struct.pack(">I", len(body)) + body)
    return base64.b64encode(out.getvalue()).decode()


def unpack(kind: str, text: str) -> list[tuple[str | None, str]]:
    """(name, body) of each part; a ValueError if the text is no such archive."""
    if kind in ("tar", "zip", "binary"):
        data = base64.b64decode(text, validate=True)
        if kind == "tar":
            try:
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    return [(m.name, t.extractfile(m).read().decode()) for m in t if m.isfile()]
            except tarfile.TarError as e:
                raise ValueError(str(e)) from None
        if kind == "zip":
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    return [(i.filename, z.read(i).decode()) for i in z.infolist() if not i.is_dir()]
            except zipfile.BadZipFile as e:
                raise ValueError(str(e)) from None
        (n,), at, out = struct.unpack_from(">I", data), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from(">I", data, at)
            out.append((None, data[at + 4 : at + 4 + size].decode()))
            at += 4 + size
        return out
    if kind == "json_documents":
        return [(None, d) for d in json_documents(text)]
    if kind == "csv" or kind.startswith("csv:"):
        from millrace.functions.parsing import read_csv
        from millrace.lang.values import MappingError, to_json

        try:
            return [(None, to_json(r)) for r in read_csv(text, True, kind[4:] or ",")]
        except MappingError as e:
            raise ValueError(str(e)) from None
    raise ValueError(f"unknown archive format {kind!r}")


def json_documents(text: str) -> list[str]:
    """The JSON documents that follow one another in a text."""
    import json

    decoder, at, out = json.JSONDecoder(), 0, []
    while True:
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        if at >= len(text):
            return out
        _, end = decoder.raw_decode(text, at)
        out.append(text[at:end])
        at = end


def unpack_step(kind: str):
    @F.pandas_udf("parts array<struct<name:string,body:string>>, error string")
    def step(content: pd.Series) -> pd.DataFrame:
        out = []
        for c in content:
            try:
                out.append(([{"name": n, "body": b} for n, b in unpack(kind, c or "")], None))
            except (ValueError, struct.error) as e:
                out.append((None, f"failed to unarchive: {e}"))
        return pd.DataFrame(out, columns=["parts", "error"])

    return step
