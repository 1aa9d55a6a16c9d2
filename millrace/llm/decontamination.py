"""Benchmark decontamination: a hash set of the benchmark's word windows against the windows of every document.

Windows are ``width`` consecutive words of an item; an item with fewer words (but some) is one window. The set goes
to the executors as a broadcast only after its size was checked (``BROADCAST_WORDS``); a larger benchmark is dealt
into parts of that size and the documents are scanned once for each part. A document word inside any occurrence of
a window is hit. Words are first mapped to ids of the benchmark's own vocabulary, so only runs of known words are
looked at; the windows themselves are compared word by word, no hash decides. The driver holds one part at a time, and a worker
builds a part's set once, for all its tasks.

Defined results: null text or item has no words; the windows of an item without an id hit, and it counts as an item but
has no place in the list of ids; empty texts are not contaminated; an empty benchmark hits nothing;
a repeated row gets the same result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import attach, filtered, keeps, lean, staged

WIDTH = 10
#: Words of benchmark items in one broadcast: about 270 bytes each in a worker.
BROADCAST_WORDS = 400_000
_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER)) if text else []


class WindowSet:
    """The windows of a set of items, found in a list of words."""

    def __init__(self, items: list[tuple[object, list[str]]], width: int = WIDTH):
        self.ids: dict[str, int] = {}
        self.by_width: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for item, words in items:
            if not words:
                continue
            n = min(width, len(words))
            coded = [self.ids.setdefault(w, len(self.ids)) for w in words]
            for window in {tuple(coded[i : i + n]) for i in range(len(coded) - n + 1)}:
                self.by_width[n][window].append(item)
        self.widths = sorted(self.by_width)

    def find(self, words: list[str]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of words (start, end) inside occurrences, and the items that occur."""
        if not self.widths:
            return [], set()
        get, least = self.ids.get, self.widths[0]
        coded = [get(w, -1) for w in words]
        spans, items, at, n = [], set(), 0, len(coded)
        while at < n:  # runs of known words
            if coded[at] < 0:
                at += 1
                continue
            end = at + 1
            while end < n and coded[end] >= 0:
                end += 1
            if end - at >= least:
                for width in self.widths:
                    table = self.by_width[width]
                    for i in range(at, end - width + 1):
                        if (found := table.get(tuple(coded[i : i + width]))) is not None:
                            items.update(found)
                            spans.append((i, i + width))
            at = end
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def _parts(benchmark: DataFrame, broadcast_words: int) -> Iterator[list[tuple[object, list[str]]]]:
    """The benchmark's items, a part of a bounded number of words at a time; they are counted before anything is fetched."""
    sized = benchmark.select("item_id", F.col("text").cast("string").alias("text"), (F.length("text") / 2 + 1).cast("long").alias("most"))
    total = sized.agg(F.sum("most")).first()[0] or 0
    n = max(1, -(-total // broadcast_words))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for i in range(n):
        yield [(r["item_id"], words_of(r["text"])) for r in (dealt if n == 1 else dealt.where(F.col("part") == i)).select("item_id", "text").collect()]


_built: dict[str, WindowSet] = {}
keeps("decontamination", _built.clear)


def _window_set(name: str, items: list, width: int) -> WindowSet:
    """The set of a part, built once a worker; that of an earlier part is forgotten."""
    if name not in _built:
        _built.clear()
        _built[name] = WindowSet(items, width)
    return _built[name]


_SPANS = "array<struct<start:long,end:long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (start, end in words), items (distinct ids as strings, sorted)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _h long, n_words long, spans {_SPANS}, items array<string>"

    def scan(part: list) -> DataFrame:
        shared, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from millrace.llm.decontamination import _window_set  # the worker's own module, which outlives a task

            windows = _window_set(name, shared.value, width)
            for b in batches:
                n, spans, items = [], [], []
                for text in b["text"]:  # the words of one text at a time
                    words = words_of(text)
                    places, found = windows.find(words)
                    n.append(len(words))
                    spans.append([{"start": s, "end": e} for s, e in places])
                    items.append(sorted(str(x) for x in found if x is not None) + [None] * (None in found))
                yield pd.DataFrame({"doc_id": b["doc_id"], "_h": b["_h"], "n_words": n, "spans": spans, "items": items})

        return rows.mapInPandas(lean(run, "decontamination"), schema)

    parts = _parts(benchmark, broadcast_words)
    part = next(parts)
    out, passes = scan(part), []
    for later in parts:  # a pass for each part; what the passes hit meets by document
        if not passes:
            passes.append(staged(out.where(F.size("spans") > 0).distinct(), "leaks"))
        passes.append(staged(scan(later).where(F.size("spans") > 0).distinct(), "leaks"))
    if passes:
        hit = passes[0]
        for more in passes[1:]:
            hit = hit.unionAll(more)
        hit = hit.groupBy("doc_id", "_h").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        last = lambda acc: F.try_element_at(acc, F.lit(-1))
        joined = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))
        merged = F.aggregate("spans", F.array().cast(_SPANS), lambda acc, s: F.when(last(acc)["end"] >= s["start"], joined(acc, s)).otherwise(F.concat(acc, F.array(s))))
        bare = scan([]).select("doc_id", "_h", "n_words")
        out = attach(bare, hit, ["doc_id", "_h"]).select("doc_id", "_h", "n_words", F.coalesce(merged, F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select("doc_id", "_h", "n_words", "spans", "items")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, all columns kept."""
    found = contamination(docs, benchmark, **options).where(F.size("spans") > 0)
    return filtered(docs, staged(found.select("doc_id", "_h").distinct(), "leaky"), "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS win FROM i, unnest(range(1, len(w) - k + 2)) AS t(s)
), x AS (
  SELECT r, k, s, array_to_string(w[s : s + k - 1], ' ') AS win
  FROM d, (SELECT DISTINCT k FROM i) AS ks, unnest(range(1, len(w) - k + 2)) AS t(s)
), h AS (
  SELECT r, s, x.k, item_id FROM x JOIN g ON x.win = g.win AND x.k = g.k
), p AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS pos FROM (SELECT DISTINCT r, s, k FROM h)) GROUP BY r
), n AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN n USING (r)
"""
