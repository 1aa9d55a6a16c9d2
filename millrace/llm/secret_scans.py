"""Secret scans: character Markov models of random strings and of ordinary identifiers (DataFrame operations only).

Two first-order models over an alphabet of 67 symbols are trained from labelled samples (random strings drawn from
a keyed generator, identifiers composed from common words in the usual styles). A run of 20 or more token
characters is a secret if its mean log-likelihood ratio per transition exceeds ``threshold``. Three fixed patterns
(assigned values, access keys, long hex) come first and always stay; spans of the model are added where they touch
none of those.

Positions without a Python step: the pieces that a pattern leaves (split) and its matches alternate, so starts are
running sums of their lengths, taken by a window over the matches of one text and one kind.

Defined results: null or empty text has no spans; a repeated row gets the same result each time; columns other than
doc_id and text are ignored; positions are code points, ends exclusive; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import random
import string
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import attach, text_or_empty

#: Fixed patterns of the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
THRESHOLD = 0.35
#: Words that sample identifiers are composed of.
WORDS = (
    "get set make find load save user name file path index count value list item node tree graph table column row field "
    "type class object model view config option default handler request response server client service manager factory "
    "builder parser token string number buffer stream reader writer input output error message event listener callback "
    "update delete insert select create remove append merge split filter group order limit offset window batch cache "
    "session context thread worker queue task job time date start stop open close read write test check valid is has to "
    "from with and the of for in on not this that are was which license public general version information international "
    "development application environment management administration responsibility und der die das nicht eine que para con "
    "los las une des pour dans est sur avec tion ment keit lich heit schaft"
).split()


def training_samples(n: int = 6000, seed: int = 11) -> list[tuple[str, int]]:
    """Labelled samples: (text, 1 for a random string or 0 for an identifier)."""
    rng = random.Random(seed)
    kinds = (string.ascii_letters + string.digits, string.digits + "abcdef", string.ascii_lowercase + string.digits, ALPHABET[:62] + "+/", string.ascii_uppercase + string.digits)
    out = [("".join(rng.choices(rng.choice(kinds), k=rng.randint(20, 44))), 1) for _ in range(n)]
    for _ in range(n):
        words = rng.choices(WORDS, k=rng.randint(2, 7))
        style = rng.randrange(6)
        text = {0: "_".join(words), 1: words[0] + "".join(w.title() for w in words[1:]), 2: "-".join(words), 3: "/".join(words), 4: "".join(words), 5: "_".join(words).upper()}[style]
        out.append((text + (str(rng.randrange(100)) if rng.random() < 0.15 else ""), 0))
    return out


@cache
def ratio_table(seed: int = 11, alpha: float = 0.5) -> tuple[float, ...]:
    """Log-likelihood ratio of each transition (random against identifier), row by first symbol; last row: others."""
    n = len(ALPHABET)
    counts = [[[alpha] * n for _ in range(n)] for _ in range(2)]
    at = {c: i for i, c in enumerate(ALPHABET)}
    for text, label in training_samples(seed=seed):
        for a, b in zip(text, text[1:]):
            counts[label][at[a]][at[b]] += 1
    logs = [[[math.log(c / sum(row)) for c in row] for row in m] for m in counts]
    return tuple(round(logs[1][i][j] - logs[0][i][j], 6) for i in range(n) for j in range(n))


def likelihood_ratio(token: Column) -> Column:
    """Mean log-likelihood ratio per transition of a token of the alphabet; 0 where it has fewer than two characters."""
    table, alphabet, n = F.lit(list(ratio_table())), F.lit(ALPHABET), len(ALPHABET)
    chars = F.split(token, "")
    at = lambda c: F.locate(c, ALPHABET) - 1 if isinstance(c, str) else F.call_function("instr", alphabet, c) - 1
    places = F.transform(F.filter(chars, lambda c: c != ""), lambda c: at(c))
    steps = F.zip_with(F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 2, F.size(places)), lambda a, b: F.get(table, a * n + b))
    return F.coalesce(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(steps), F.lit(0)), F.lit(0.0))


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """The matches of a kind: structs of kind, place, length of the piece before it, its length and the wanted group."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("n"), part.alias("part"))
    rows = F.transform(zipped, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["n"].alias("n"), m["part"].alias("part")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,n:int,part:string>>"))


def secret_spans(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per text that has spans: doc_id, _h, base (sorted structs of start, order, end), added (the model's)."""
    t = docs.select("doc_id", F.xxhash64(text_or_empty(F.col("text"))).alias("_h"), text_or_empty(F.col("text")).alias("t"))
    patterns = (("assign", ASSIGN, 1), ("access", ACCESS, 0), ("hex", HEX, 0), ("markov", TOKEN, 0))
    found = t.select("doc_id", "_h", F.inline(F.concat(*[_matches(F.col("t"), *p) for p in patterns])))
    found = found.repartition("doc_id", "_h").dropDuplicates(["doc_id", "_h", "kind", "i"])
    along = Window.partitionBy("doc_id", "_h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(along)
    placed = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    kept = placed.where(
        F.when(F.col("kind") == "assign", F.length("part") >= 6).when(F.col("kind") == "markov", likelihood_ratio(F.col("part")) > threshold).otherwise(F.lit(True))
    )
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("order"), "end")
    per = kept.groupBy("doc_id", "_h").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") != "markov", span))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "markov", span))).alias("model"),
    )
    clear = F.filter("model", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return per.select("doc_id", "_h", "base", clear.alias("added"))


def _listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["order"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model."""
    per = secret_spans(docs, **options)
    count = lambda k: F.size(F.filter("base", lambda s: s["order"] == k)).cast("long")
    per = per.select(
        "doc_id", "_h", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"),
        _listed(F.col("base")).alias("base_spans"), _listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_model"),
    )
    all_docs = docs.select("doc_id", F.xxhash64(text_or_empty(F.col("text"))).alias("_h"))
    or_zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return attach(all_docs, per, ["doc_id", "_h"]).select(
        "doc_id", or_zero("n_assign"), or_zero("n_access"), or_zero("n_hex"),
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), or_zero("n_model"),
    )


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
