"""License scans by diagonal voting (DataFrame operations only).

All rolling word k-grams of the texts are hashed and joined to the positions of the same k-grams in the templates.
A hit votes for the diagonal (document position minus template position) of its template; votes are gathered by
diagonal, diagonals that lie within ``slack`` of one another are merged (words put in or left out shift a copy to
the next diagonal), and a merged span is verified: its share of the template's k-grams and its length. Words are
compared as well as hashes, so a hash collision never votes. A diagonal with every k-gram of its template is an
exact place of the phrase.

Defined results: null or empty text has no words, no places, empty labels and score 0; a repeated row gets the same
result each time (all votes are sets); columns other than id and text are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, ascii_lower, attach, rows_of, text_or_empty

K = 2
#: Phrases whose exact places count; label by phrase.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Further templates of the method: phrase, label.
FURTHER = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution license", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("dedicated to the public domain", "public-domain"),
)
SLACK = 2
COVERAGE = 0.75
#: Template k-grams up to this many are broadcast (about 100 bytes each); more are joined by shuffle.
BROADCAST_GRAMS = 200_000


def _template_grams(spark, base, further, k: int) -> tuple[DataFrame, int]:
    rows = []
    for tid, (phrase, label, exact) in enumerate([(p, name, True) for p, name in base] + [(p, name, False) for p, name in further]):
        words = phrase.split()
        if len(words) < k:
            raise ValueError(f"a template has {k} words at least: {phrase!r}")
        rows += [(tid, label, exact, len(words) - k + 1, i, *words[i : i + k]) for i in range(len(words) - k + 1)]
    names = ", ".join(f"t{i} string" for i in range(k))
    grams = rows_of(spark, rows, f"tid int, label string, base boolean, grams int, tpos int, {names}")
    return grams.withColumn("gram", F.xxhash64(*[f"t{i}" for i in range(k)])), len(rows)


def spans(docs: DataFrame, *, base=BASE, further=FURTHER, k: int = K, slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """Verified spans: doc_id, _h (hash of the text), tid, label, start, end (words, end exclusive), share, places, first, last."""
    spark = docs.sparkSession
    grams, n_grams = _template_grams(spark, base, further, k)
    text = text_or_empty(F.col("text"))
    words = docs.select("doc_id", F.xxhash64(text).alias("_h"), F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") >= k)
    shifted = [F.col("w") if i == 0 else F.slice("w", i + 1, F.size("w")).alias(f"w{i}") for i in range(k)]
    rolled = words.select("doc_id", "_h", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "g"))
    parts = [F.col("g.w")] + [F.col(f"g.w{i}") for i in range(1, k)]
    rolled = rolled.select("doc_id", "_h", "pos", F.xxhash64(*parts).alias("gram"), *[p.alias(f"d{i}") for i, p in enumerate(parts)])
    side = F.broadcast(grams) if n_grams <= BROADCAST_GRAMS else grams
    hits = rolled.join(side, "gram")
    for i in range(k):  # the words themselves decide
        hits = hits.where(F.col(f"d{i}") == F.col(f"t{i}"))
    votes = hits.groupBy("doc_id", "_h", "tid", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("met"),  # at most as many as the template has
        F.min("pos").alias("start"),
        (F.max("pos") + k).alias("end"),
        F.first("label").alias("label"),
        F.first("base").alias("base"),
        F.first("grams").alias("grams"),
    )
    exact = F.size("met") == F.col("grams")
    along = Window.partitionBy("doc_id", "_h", "tid").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > slack) | F.lag(exact).over(along) | exact, F.lit(True))
    merged = votes.withColumn("apart", apart.cast("int")).withColumn("cluster", F.sum("apart").over(along))
    out = merged.groupBy("doc_id", "_h", "tid", "cluster").agg(
        F.first("label").alias("label"),
        F.first("base").alias("base"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("met")))) / F.first("grams")).alias("share"),
        F.first("grams").alias("grams"),
        F.max(exact).alias("exact"),
    )
    long_enough = (F.col("end") - F.col("start")) <= 1.5 * (F.col("grams") + k - 1)
    return out.where(F.col("exact") | (~F.col("base") & (F.col("grams") >= 4) & (F.col("share") >= coverage) & long_enough))


def license_scan(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = spans(docs, **options)
    is_base = F.col("base") & F.col("exact")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = found.groupBy("doc_id", "_h").agg(
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    text = text_or_empty(F.col("text"))
    all_docs = docs.select("doc_id", F.xxhash64(text).alias("_h"), F.regexp_count(ascii_lower(text), F.lit(WORD)).cast("long").alias("n_words"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return attach(all_docs, per, ["doc_id", "_h"]).select(
        "doc_id", "n_words", zero("n_base", 0), "first_word", "last_word", zero("base_labels", ""), zero("labels", ""), zero("score", 0.0)
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
