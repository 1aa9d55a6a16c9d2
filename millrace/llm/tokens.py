"""Token ids in flat binary files: unsigned integers, 64-bit document offsets, memory-mapped on reading.

A folder holds for every part ``part-NNNNN.bin`` (the ids of its documents, little-endian, 16 bits where the
vocabulary allows it and else 32), ``part-NNNNN.idx`` (64-bit offsets, one more than documents, counted over the
whole corpus) and ``part-NNNNN.doc`` (64-bit doc_ids); ``manifest.json`` lists them in order. Documents lie in ascending
order of doc_id (ties by text), null ids first.

Writing takes two passes: the parts (a range of doc_ids each) are written side by side and report their counts, one
row a part; prefix sums of these give each part's base, from which its offsets follow. A part is written under a
temporary name and renamed, so a task that runs again or twice leaves the same files. Files go through Arrow's file
systems, so the folder may lie wherever these reach; a local folder is memory-mapped.

ASCII white space always separates tokens of this tokenizer, so texts are cut there and each distinct piece is
encoded once as long as a worker remembers it; pieces are cut into words where the tokenizer cuts them, so that
punctuation and case make no new words; a piece with the text of an added token goes to the tokenizer whole. Texts of
a tokenizer file with another normalizer or pre-tokenizer are not cut at all. The ids are the tokenizer's own.

Defined results: null and empty texts have the end id alone; repeated rows are written each on its own; other
columns are ignored; an empty table gives an empty folder and no rows.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import keeps, lean, new_path, slices

END_ID = 1
#: Pieces, and words of pieces, that a worker remembers; about 150 bytes each.
REMEMBERED = 400_000
#: Text of a part, in bytes.
PART_BYTES = 24 << 20


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Pieces of letters whose lower case and normal form are plain; others are encoded as they stand.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÿ]+")
#: Where the tokenizer itself cuts such a piece (fixed pattern of its vocabulary file).
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")

#: The normalizer and pre-tokenizer for which texts may be cut so.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _cuts(file: dict) -> bool:
    """Whether white space and _CUT separate the tokens of this tokenizer file, added tokens aside."""
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"])) for t in file["added_tokens"])
    known = file["normalizer"] == _NORMALIZER and file["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
    return plain and known and not file.get("truncation") and not file.get("padding")


class _Memory:
    """Encoded pieces; when full, the older half is forgotten."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most // 2, {}, {}

    def missing(self, pieces) -> list[str]:
        """Pieces that are not known; known ones become recent."""
        out = []
        for p in pieces:
            if p not in self.new:
                if (x := self.old.get(p)) is not None:
                    self.new[p] = x
                else:
                    out.append(p)
        return out

    def trim(self) -> None:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}


class PieceEncoder:
    """Encodes texts by their distinct pieces; ids of a text as an array of ``dtype``."""

    def __init__(self, path: str, dtype: str, remembered: int = REMEMBERED):
        self.tokenizer, self.dtype = _tokenizer(path), dtype
        self.pieces, self.words = _Memory(remembered), _Memory(remembered)
        file = json.loads(self.tokenizer.to_str())
        self.cuts = _cuts(file)
        added = [re.escape(t["content"]) for t in file["added_tokens"]]
        self.added = re.compile("|".join(added)) if added else None

    def _encode(self, items: list[str], into: dict) -> None:
        """Each item on its own, many in one call."""
        width = np.dtype(self.dtype).itemsize
        for i in range(0, len(items), 5000):
            some = items[i : i + 5000]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, owner = np.asarray(e.ids, self.dtype).tobytes(), np.asarray([-1 if w is None else w for w in e.word_ids], np.int64)
            cut = (np.searchsorted(owner, np.arange(len(some) + 1)) * width).tolist()
            for p, a, z in zip(some, cut, cut[1:]):
                into[p] = ids[a:z]

    def _learn(self, distinct: list[str]) -> dict:
        fresh = self.pieces.missing(distinct)
        parts = {p: _CUT.findall(p.lower()) for p in fresh if _PLAIN.fullmatch(p) and not (self.added and self.added.search(p))}
        self._encode(self.words.missing(set().union(*parts.values())), self.words.new)
        known, words = self.pieces.new, self.words.new
        for p, cut in parts.items():
            known[p] = b"".join([words[w] for w in cut])
        self._encode([p for p in fresh if p not in parts], known)
        return known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and how many each has. The array must not be a slice."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.cuts:
            ids = [np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype) for t in texts.to_pylist()]
            return np.concatenate([np.empty(0, self.dtype), *ids]), np.asarray([len(x) for x in ids], np.int64)
        lists = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self._learn(distinct)
        found = [known[p] for p in distinct]
        width = np.dtype(self.dtype).itemsize
        size = np.fromiter(map(len, found), np.int64, len(found)) // width
        start = np.cumsum(size) - size
        blob = np.frombuffer(b"".join(found), self.dtype)
        self.pieces.trim()
        self.words.trim()
        codes = np.asarray(coded.indices)
        n = size[codes]
        ends = np.cumsum(n)
        small = np.int32 if len(ends) and ends[-1] < 1 << 30 and len(blob) < 1 << 30 else np.int64
        take = np.repeat((start[codes] - (ends - n)).astype(small), n) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=small)
        total = np.concatenate([[0], ends])
        return blob[take], total[bounds[1:]] - total[bounds[:-1]]


@cache
def _encoder(path: str, dtype: str) -> PieceEncoder:
    """One encoder a worker process, kept from task to task."""
    return PieceEncoder(path, dtype)


def _forget() -> None:
    """Nothing to encode is left to this worker: no encoder, no tokenizer, and objects are collected again."""
    gc.enable()
    if _encoder.cache_info().currsize or _tokenizer.cache_info().currsize:
        _encoder.cache_clear()
        _tokenizer.cache_clear()
        gc.collect()


keeps("tokens", _forget)


def _put(folder: str, name: str, data) -> None:
    import uuid

    files, root = _filesystem(folder)
    at = f"{root}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(at) as out:
        out.write(data)
    files.move(at, f"{root}/{name}")


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = END_ID) -> list[dict]:
    """Write docs (doc_id, text) to a folder that all executors see; returns the manifest's parts."""
    spark = docs.sparkSession
    size = max(_tokenizer(tokenizer_path).get_vocab_size(), end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_parts = max(1, -(-(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // PART_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    laid = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        gc.disable()  # many small objects and no cycles among them
        part = TaskContext.get().partitionId()
        encoder, name, ids, lengths, nulls = _encoder(tokenizer_path, dtype), f"part-{part:05d}", [], [], 0
        fs, top = _filesystem(folder)
        at = f"{top}/.{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(at) as out:
            for whole in batches:
                for b in slices(whole, "text", 8 << 20):
                    body, n = encoder.encode(b["text"].take(pa.array(np.arange(b.num_rows))))
                    ends = np.cumsum(n)
                    out.write(np.insert(body, ends, np.asarray(end_id, dtype)).tobytes())
                    lengths.append((n + 1).astype("<u8"))
                    nulls += b["doc_id"].null_count
                    ids.append(np.asarray(pc.fill_null(b["doc_id"], 0)).astype("<i8"))
        if not sum(map(len, lengths)):
            fs.delete_file(at)
            return
        n = np.concatenate(lengths)
        fs.move(at, f"{top}/{name}.bin")
        _put(folder, f"{name}.doc", np.concatenate(ids).tobytes())
        _put(folder, f"{name}.len", n.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(n)], "tokens": [int(n.sum())], "nulls": [nulls]})

    counts = sorted(laid.mapInArrow(lean(run, "tokens"), "part long, docs long, tokens long, nulls long").collect())  # one row a part
    base, parts = 0, []
    for r in counts:
        parts.append({"part": r["part"], "docs": r["docs"], "tokens": r["tokens"], "nulls": r["nulls"], "base": base})
        base += r["tokens"]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = _filesystem(folder)
        for b in batches:
            for part, start in zip(b["part"], b["base"]):
                name = f"part-{part:05d}"
                if fs.get_file_info(f"{top}/{name}.idx").size:  # written by an earlier attempt
                    continue
                n = np.frombuffer(fs.open_input_file(f"{top}/{name}.len").read(), "<u8")
                _put(folder, f"{name}.idx", (np.concatenate([[0], np.cumsum(n)]).astype("<u8") + np.uint64(start)).astype("<u8").tobytes())
            yield b[["part"]]

    if parts:
        _part_rows(spark, parts).mapInPandas(lean(index), "part long").count()
    _put(folder, "manifest.json", json.dumps({"dtype": dtype, "end_id": end_id, "parts": parts}).encode())
    for r in parts:
        files.delete_file(f"{root}/part-{r['part']:05d}.len")
    return parts


def _part_rows(spark, parts: list[dict]) -> DataFrame:
    rows = [(p["part"], p["base"], p["nulls"]) for p in parts]
    return spark.createDataFrame(rows, "part long, base long, nulls long").repartition(len(rows))


def _mapped(fs, path: str, dtype: str) -> np.ndarray:
    """An array over a file: memory-mapped if the file is local, else read."""
    if fs.type_name == "local":
        return np.memmap(path, dtype, "r") if fs.get_file_info(path).size else np.empty(0, dtype)
    return np.frombuffer(fs.open_input_file(path).read(), dtype)


def read_token_files(spark, folder: str) -> DataFrame:
    """One row per document in a folder: doc_id, start, n_tokens, ids (array of long)."""
    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids array<long>", lambda x: x.astype("int64"), "ids")


def token_digests(spark, folder: str) -> DataFrame:
    """One row per document in a folder: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32 bits)."""
    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda x: zlib.crc32(x.astype("<u4").tobytes()), "ids_crc32")


def _read(spark, folder: str, schema: str, of, name: str) -> DataFrame:
    files, root = _filesystem(folder)
    manifest = json.loads(files.open_input_file(f"{root}/manifest.json").read())
    dtype, parts = manifest["dtype"], manifest["parts"]
    if not parts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = _filesystem(folder)
        for b in batches:
            for part, base, nulls in zip(b["part"], b["base"], b["nulls"]):
                at = f"{top}/part-{part:05d}"
                ids, idx, doc = (_mapped(fs, f"{at}.{x}", k) for x, k in (("bin", dtype), ("idx", "<u8"), ("doc", "<i8")))
                offsets = idx.astype("int64")
                for i in range(0, len(doc), 4096):
                    j = min(i + 4096, len(doc))
                    out = pd.DataFrame({"doc_id": pd.array(doc[i:j], dtype="Int64"), "start": offsets[i:j], "n_tokens": offsets[i + 1 : j + 1] - offsets[i:j]})
                    if i < nulls:
                        out.loc[: nulls - i - 1, "doc_id"] = pd.NA
                    out[name] = [of(ids[offsets[k] - base : offsets[k + 1] - base]) for k in range(i, j)]
                    yield out

    return _part_rows(spark, parts).mapInPandas(lean(run), schema)


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = new_path(spark, "tokens")
    write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(spark, folder)
