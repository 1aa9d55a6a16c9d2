"""URL filters: a blocked Bloom filter of listed URLs, then an exact hash join (DataFrame operations only).

A rule is a host and a path prefix. For a URL the keys that could be listed are its host suffixes of the depths
that occur in the rules, with its path prefixes of the lengths that occur. Keys are tested against a blocked Bloom
filter (one block of 256 bits per key, two bits in each of its four words), held as a table by block number; the
few that pass meet the rules in an exact join, which removes the false positives. The longest rule wins; of two
verdicts for the same rule block wins.

The filter has 40 bytes for every 16 rules. It is broadcast up to ``FILTER_RULES`` rules (about 10 MB) and the rules
themselves up to ``BROADCAST_RULES`` (about 10 MB too); longer lists are joined by shuffle.

Defined results: null URL or one without ``://`` has empty host and path, no rule and the default verdict; repeated
rows get the same result; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, attach, rows_of

#: host, path prefix, verdict
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
FILTER_RULES = 4_000_000
BROADCAST_RULES = 100_000
_BITS = 16


def _bloom_words(h):
    """The bits that a key sets in the four words of its block."""
    other = F.xxhash64(h, F.lit(7))
    one = F.lit(1).cast("long")
    bit = lambda i: F.call_function("shiftleft", one, F.shiftright(other, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """keys (h long) to the filter's non-empty blocks: block, m0 to m3."""
    words = keys.select(F.pmod("h", F.lit(n_blocks)).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_bloom_words(F.col("h")))])
    return words.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"m{i}") for i in range(4)])


def maybe_listed(candidates: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Candidates (h and more) whose bits are all set."""
    out = candidates.withColumn("block", F.pmod("h", F.lit(n_blocks))).join(blocks, "block")
    for i, m in enumerate(_bloom_words(F.col("h"))):
        out = out.where(m.bitwiseAND(F.col(f"m{i}")) == m)
    return out.drop("block", "m0", "m1", "m2", "m3")


def rules_table(spark, rules=RULES) -> DataFrame:
    return rows_of(spark, [tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def url_filter(pages: DataFrame, rules: DataFrame, *, default: str = "allow") -> DataFrame:
    """pages (page_id, url) and rules (rule_host, rule_path, rule_verdict): page_id, host, path, rule, verdict."""
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict")).withColumn("h", F.xxhash64("rule_host", "rule_path"))
    shape = rules.agg(
        F.count("*").alias("n"),
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("depths"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
    ).first()
    n_blocks = max(1, -(-shape["n"] * _BITS // 256))
    hint = lambda df, most: F.broadcast(df) if shape["n"] <= most else df
    blocks = hint(bloom_blocks(rules, n_blocks), FILTER_RULES)

    host = ascii_lower(F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    split = pages.select("page_id", F.xxhash64("url").alias("_h"), host.alias("host"), path.alias("path"))
    parts = F.split("host", r"\.")
    suffixes = F.array(*[F.when(F.size(parts) >= d, F.substring_index("host", ".", -d)) for d in sorted(shape["depths"])])
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["lengths"])])
    keys = split.where(F.col("host") != "").select("page_id", "_h", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).where(F.col("suffix").isNotNull())
    keys = keys.select("page_id", "_h", "suffix", F.explode("prefixes").alias("prefix")).where(F.col("prefix").isNotNull())
    passed = maybe_listed(keys.withColumn("h", F.xxhash64("suffix", "prefix")), blocks, n_blocks)
    listed = hint(rules.withColumnsRenamed({"h": "rule_h"}), BROADCAST_RULES)
    exact = passed.join(listed, F.expr("h = rule_h AND suffix = rule_host AND prefix = rule_path"))
    length = F.length("rule_host") + F.length("rule_path")
    best = exact.groupBy("page_id", "_h").agg(F.max(F.struct(length.alias("n"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")).alias("best"))
    return attach(split, best, ["page_id", "_h"]).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict")
    )


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules_table(spark))


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    row_number() OVER () AS n
  FROM pages
), r(h, p, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), f AS (
  SELECT n, r.h || r.p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(r.h || r.p) DESC) AS k
  FROM p JOIN r ON (host = r.h OR host LIKE '%.' || r.h) AND starts_with(path, r.p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM f WHERE k = 1) f USING (n)
"""
