"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

Within a source every document expects ``rate = target / source size`` copies. Laying these expectations end to
end and adding one random offset, a document is emitted once for each integer boundary that its stretch crosses.
Documents lie in falling order of size (bins of 1/8 octave, then hash blocks, then size), so the words taken from
a source differ from its target by about the size of one document at most. Where sources have few documents that is much;
therefore the offset of a source is the best of ``draws`` random ones, not the first.

The prefix sum has two levels: counts by (source, bin) are small; a bin of more than ``block_rows`` rows is dealt into
blocks of about that many, whose counts get running sums; the rank inside a block comes from a window over that block
alone. So a source with a third of all rows is no hot group, and the tables of counts have a row for each source and
bin and one more for every ``block_rows`` documents. Rows of equal size and id are ordered by a hash of their text.

Defined results: null text has size 0 and nothing is taken of it; a null source is a source of its own, last in
order; an empty table gives an empty table; repeated rows count each on its own; extra columns pass through
``mix`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import CHUNK, staged, text_or_empty

WEIGHTS = (1, 2, 3)
CAP = 3.0
SEED = 20240501
BLOCK_ROWS = 16384
DRAWS = 16
#: Rows (source, bin) that are broadcast at most, about 60 bytes each.
BROADCAST_BINS = 500_000


def size_of(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(CHUNK)).cast("long")


def _keys(sized: DataFrame) -> DataFrame:
    return sized.select(
        "*",
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("sk"),
        F.floor(F.log2(F.col("size") + 1) * 8).cast("int").alias("bin"),
    )


def _dealt(sized: DataFrame, bins: DataFrame) -> DataFrame:
    """Rows with their source's key, bin and block; the bins are broadcast where they are few."""
    known = bins.select("sk", "bin", "blocks")
    rows = _keys(sized).join(F.broadcast(known) if known.count() <= BROADCAST_BINS else known, ["sk", "bin"])
    return rows.withColumn("blk", F.pmod(F.xxhash64("doc_id", "_h"), F.col("blocks"))).drop("blocks")


def source_targets(per_source: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(sk, source, source_size) to the same with ``target``: all words shared by weight, none above cap times its size.

    The fixed point of "cut at the cap, share the excess by weight again" is target = min(cap, level * weight) with
    one level for all; sorted by cap / weight, the level is known at the first source that is not cut. One row per
    source: the only windows without a partition run over this table.
    """
    ranked = per_source.withColumn("rn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = F.element_at(cycle, ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    t = ranked.select("sk", "source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(cap)).alias("most"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("w"), "sk").rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(order), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(order), F.lit(0.0)))).alias("level"),
    )
    open_level = F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct((F.col("most") / F.col("w")).alias("at"), "sk", "level"))).over(everything)["level"]
    return t.select("sk", "source_size", F.least(F.col("most"), F.coalesce(open_level * F.col("w"), F.col("most"))).alias("target"))


def _bins(narrow: DataFrame, block_rows: int) -> DataFrame:
    """One row per source and bin: sk, bin, source, rows, words, blocks."""
    counts = _keys(narrow).groupBy("sk", "bin").agg(F.count("*").alias("rows"), F.sum("size").alias("words"), F.min("source").alias("source"))
    return staged(counts.withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("long")), "mix-bins")


def _base(narrow: DataFrame, bins: DataFrame, weights, cap: float) -> DataFrame:
    """narrow (doc_id, _h, source, size) to one row per block: sk, bin, blk, base (documents before it), source_size, target."""
    counts = _dealt(narrow, bins).groupBy("sk", "bin", "blk").agg(F.count("*").alias("rows"))
    targets = source_targets(bins.groupBy("sk").agg(F.min("source").alias("source"), F.sum("words").alias("source_size")), weights, cap)
    before = lambda w: F.coalesce(w, F.lit(0))
    ahead = bins.select("sk", "bin", before(F.sum("rows").over(Window.partitionBy("sk").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))).alias("bin_base"))
    base = counts.select("sk", "bin", "blk", before(F.sum("rows").over(Window.partitionBy("sk", "bin").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))).alias("blk_base"))
    base = base.join(ahead, ["sk", "bin"]).join(targets, "sk")
    return base.select("sk", "bin", "blk", (F.col("bin_base") + F.col("blk_base")).alias("base"), "source_size", "target")


def _laid(rows: DataFrame, base: DataFrame, bins: DataFrame) -> DataFrame:
    """Each row with its rank in its source and the rate of its source."""
    ranked = _dealt(rows, bins).withColumn("at", F.row_number().over(Window.partitionBy("sk", "bin", "blk").orderBy(F.desc("size"), "doc_id", "_h")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return ranked.join(base, ["sk", "bin", "blk"]).withColumn("rank", F.col("base") + F.col("at")).withColumn("rate", rate)


def _crossed(offset: Column) -> Column:
    """Integer boundaries that a row's stretch of the prefix sum crosses; never more than its rate rounded up."""
    rate, rank = F.col("rate"), F.col("rank")
    n = F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)
    return F.least(F.greatest(n, F.lit(0)), F.ceil(rate)).cast("int")


def _offset(seed: int, nth) -> Column:
    """The nth random offset of a source, 0 to 1, keyed by the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(nth) if isinstance(nth, int) else nth, "sk"), F.lit(1 << 30)) / F.lit(float(1 << 30))


def copies(docs: DataFrame, *, weights=WEIGHTS, cap: float = CAP, seed: int = SEED, block_rows: int = BLOCK_ROWS, draws: int = DRAWS, keep_rows: bool = True) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, n (copies), and ``row`` (all columns of docs) if keep_rows."""
    sized = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.xxhash64("text").alias("_h"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    narrow = staged(sized.select("doc_id", "_h", "source", "size"), "mix-sizes")
    bins = _bins(narrow, block_rows)
    base = staged(_base(narrow, bins, weights, cap), "mix-base")
    laid = _laid(narrow, base, bins)
    taken = laid.groupBy("sk").agg(F.first("target").alias("target"), *[F.sum(_crossed(_offset(seed, i)) * F.col("size")).alias(f"t{i}") for i in range(draws)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{i}") - F.col("target")).alias("off"), F.lit(i).alias("nth")) for i in range(draws)]))["nth"]
    offsets = taken.select("sk", best.alias("nth")).select("sk", _offset(seed, F.col("nth")).alias("offset"))
    base = staged(base.join(offsets, "sk"), "mix-offsets")
    out = _laid(sized if keep_rows else narrow, base, bins)
    return out.select(*["row"] * keep_rows, "doc_id", "size", "source_size", "target", _crossed(F.col("offset")).alias("n"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as the sampling emits it, with the columns of ``docs``."""
    return copies(docs, **options).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth")).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    drawn = copies(docs, keep_rows=False)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("n") * F.col("size")).alias("taken"))
