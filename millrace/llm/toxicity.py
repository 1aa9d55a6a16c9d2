"""Toxicity by two class-conditional Kneser-Ney models, of toxic and of ordinary texts.

Words and word pairs are counted by class over all labelled texts, each different text once. A pair backs off to its
word and a word to the rate that both classes share. Counts are of different contexts, not of occurrences: the texts of a
class that have the expression (numbers of different words before a word, the usual contexts, level off at the size of
the vocabulary, sooner in the larger class, and would then tell the classes apart by their size).
Both models are interpolated: what an expression's count departs from what its back-off lets expect is discounted by
``discount`` standard deviations of that expectation, and the discounted part goes back to the back-off. So rare
expressions are smoothed alike in both models through the shared counts, every expression is scored, and one that the
classes do not tell apart has the same likelihood in both. (Plain Kneser-Ney discounts the count itself by less than
one; on texts with many rare words the sum of their chance differences then hides the few words that matter.)

A text's evidence is the difference of its log-likelihoods under the two models divided by its number of words; a
logistic curve, fitted on labelled texts that no count has seen, turns it into a score. Only the curve is fitted on a
bounded sample, up to ``per_class`` texts of each class by a hash of their id; it weighs them by the class counts of
all labels, so the score means the same at every size.

Only expressions whose likelihoods differ between the classes beyond their back-off need to be kept; no other has a
part in any score. Up to ``model_rows`` of them (counted first) are sent to the workers, more are joined by shuffle.
Labels are joined by broadcast up to ``label_rows`` of them (counted first), else by shuffle.

Rows whose crc32(doc_id as text) mod 5 is 0 are never learnt from; remainder 4 fits the curve, the rest the counts.

Defined results: null or empty text has evidence 0 and gets the curve's score for that; without labelled rows of both
classes every score is 0; repeated rows get the same score; null labels are ignored, and a document labelled twice
counts as toxic if either label says so, as does a text; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, attach, filtered, lean, staged, text_or_empty, unstage

PER_CLASS = 20_000
DISCOUNT = 2.0
#: Kept expressions in workers, about 200 bytes each, and labelled texts in a broadcast, about 50 bytes each.
MODEL_ROWS = 1_000_000
LABEL_ROWS = 2_000_000
SCALE = 1000.0
_WORDS = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


@dataclass
class Model:
    """Log-likelihood ratios (toxic against ordinary) of expressions: by word, and by word and the word before it; and the curve."""

    known: dict[str, tuple[float, dict[str, float] | None]] = field(default_factory=dict)
    slope: float = 0.0
    offset: float = -math.inf

    def evidence(self, text: str | None) -> float:
        """Mean log-likelihood ratio per word."""
        words = _WORDS.findall(text.lower()) if text else []
        if not words:
            return 0.0
        get, total = self.known.get, 0.0
        for i, w in enumerate(words):
            if (found := get(w)) is not None:
                alone, pairs = found
                total += alone if pairs is None else pairs.get(words[i - 1] if i else "", alone)
        return total / len(words)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.offset == -math.inf:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.slope * stretched(evidence) + self.offset, -60, 60)))


def stretched(evidence: np.ndarray) -> np.ndarray:
    return np.sign(evidence) * np.log1p(np.abs(evidence) * SCALE)


def learnable(labels: DataFrame) -> DataFrame:
    """One row per labelled document that may be learnt from: doc_id, toxic (0 or 1)."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return known.where(remainder(F.col("doc_id")) != 0)


def _with(docs: DataFrame, marks: DataFrame, on: list[str], label_rows: int) -> DataFrame:
    """Rows of docs that have a mark, with its columns: a broadcast where the marks are few enough, else a shuffle."""
    side = F.broadcast(marks) if marks.count() <= label_rows else marks
    return docs.join(side, on)


def labelled(docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, _h, text); and of each different text with a label one row: doc_id, _h, toxic (0 or 1), fold (1 to 4)."""
    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text")).withColumn("_h", F.xxhash64("text"))
    known = _with(rows.select("doc_id", "_h"), learnable(labels), ["doc_id"], label_rows)
    one = known.groupBy("_h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.max(remainder(F.col("doc_id"))).alias("fold"))
    return rows, staged(one, "labelled")


def updated(r: Column, x: tuple, n: tuple, discount: float) -> Column:
    """The log-ratio of an expression with counts x among n (toxic, ordinary), given the log-ratio r of its back-off."""
    xt, xo, nt, no = (F.col(c).cast("double") for c in (*x, *n))
    rate = (xt + xo) / (nt + no)
    level = (nt + no) / (nt * F.exp(r) + no)
    low = (rate * level * F.exp(r), rate * level)
    part = lambda x, n, low: F.greatest(F.abs(x - n * low) - discount * F.sqrt(n * low + 1), F.lit(0.0)) * F.signum(x - n * low)
    st, so = part(xt, nt, low[0]), part(xo, no, low[1])
    est = lambda s, n, low: F.when(n > 0, low + s / n).otherwise(low)
    return F.when((st == 0) & (so == 0), r).otherwise(F.ln(est(st, nt, low[0]) / est(so, no, low[1])))


def ratios(texts: DataFrame, all_t: int, all_o: int, discount: float) -> tuple[DataFrame, DataFrame]:
    """texts (toxic, text) to the ratios that differ from their back-off: words (w, r) and pairs (h, w, r)."""
    by_class = lambda df, *keys: df.groupBy(*keys).agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("o"))
    seen = texts.select("toxic", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    once = lambda items, name: seen.select("toxic", F.explode(F.array_distinct(items)).alias(name))
    two = F.zip_with(F.concat(F.array(F.lit("")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))), "w", lambda h, w: F.concat_ws(" ", h, w))  # text: structs are made distinct in quadratic time
    halves = once(two, "p").select("toxic", F.xxhash64(F.substring_index("p", " ", 1)).alias("hk"), F.xxhash64(F.substring_index("p", " ", -1)).alias("wk"))
    often = F.col("t") + F.col("o") > discount  # a count departs by more than ``discount``, or nothing changes
    pairs = staged(by_class(halves, "hk", "wk").where(often), "pairs")
    words = by_class(once(F.col("w"), "w"), "w").select(F.xxhash64("w").alias("wk"), "w", "t", "o", F.lit(all_t).alias("nt"), F.lit(all_o).alias("no"))
    words = staged(words.select("wk", "w", "t", "o", updated(F.lit(0.0), ("t", "o"), ("nt", "no"), discount).alias("r")), "words")
    start = words.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("hk"), F.lit("").alias("h"), F.lit(all_t).cast("long").alias("ht"), F.lit(all_o).cast("long").alias("ho"))
    before = words.select(F.col("wk").alias("hk"), F.col("w").alias("h"), F.col("t").alias("ht"), F.col("o").alias("ho")).unionAll(start)
    told = pairs.join(words.select("wk", "w", "r"), "wk").join(before, "hk")
    changed = told.withColumn("r2", updated(F.col("r"), ("t", "o"), ("ht", "ho"), discount)).where("r2 <> r").select("h", "w", F.col("r2").alias("r"))
    out = staged(words.where("r <> 0").select("w", "r"), "word-ratios"), staged(changed, "pair-ratios")
    unstage(pairs, words)
    return out


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, discount: float = DISCOUNT, model_rows: int = MODEL_ROWS, label_rows: int = LABEL_ROWS) -> tuple[Model, tuple[DataFrame, DataFrame] | None]:
    """The model; its expressions are in it, or where they are more than ``model_rows`` in the two tables beside it."""
    rows, one = labelled(docs, labels, label_rows)
    sizes = {(r["toxic"], r["held"]): r["n"] for r in one.groupBy("toxic", (F.col("fold") == 4).alias("held")).agg(F.count("*").alias("n")).collect()}
    all_t, all_o = sizes.get((1, False), 0), sizes.get((0, False), 0)
    if not all_t or not all_o:
        unstage(one)
        return Model(), None
    words, pairs = ratios(_with(rows, one.where("fold <> 4"), ["doc_id", "_h"], label_rows), all_t, all_o, discount)
    model, tables = Model(), (words, pairs)
    if words.count() + pairs.count() <= model_rows:
        ahead: dict[str, dict[str, float]] = {}
        for r in pairs.collect():
            ahead.setdefault(r["w"], {})[r["h"]] = r["r"]
        alone = {r["w"]: r["r"] for r in words.collect()}
        model.known = {w: (alone.get(w, 0.0), ahead.get(w)) for w in alone.keys() | ahead.keys()}
        unstage(*tables)
        tables = None

    held = one.where("fold = 4") if sizes.get((1, True)) or sizes.get((0, True)) else one
    place = F.xxhash64("doc_id", "_h")
    picked = [held.where(F.col("toxic") == c).orderBy(place, "_h").limit(per_class) for c in (0, 1)]
    sample = _with(rows, picked[0].unionAll(picked[1]), ["doc_id", "_h"], label_rows).select(F.col("toxic").alias("doc_id"), "text")
    found = evidence(sample, model, tables).select("doc_id", "evidence").collect()  # at most 2 * per_class rows
    total = {r["toxic"]: r["n"] for r in learnable(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    got = {c: sum(r["doc_id"] == c for r in found) for c in (0, 1)}
    weight = {c: max(1.0, total.get(c, 0) / max(got[c], 1)) for c in (0, 1)}
    least = min(weight.values())  # the curve as if it had seen the sample, at the rates of all labels
    model.slope, model.offset = fit_curve(np.asarray([r["evidence"] for r in found]), np.asarray([float(r["doc_id"]) for r in found]), np.asarray([weight[r["doc_id"]] / least for r in found]))
    unstage(one)
    return model, tables


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray | float = 1.0, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the stretched evidence, each row ``weight`` times (Newton's method, steps
    halved until the penalised likelihood, which is concave, rises: whole steps can leave its maximum for good)."""
    x = np.stack([stretched(evidence), np.ones(len(evidence))], axis=1)

    def likelihood(beta: np.ndarray) -> float:
        z = x @ beta
        return float(np.sum(weight * (toxic * z - np.logaddexp(0, z))) - ridge / 2 * beta @ beta)

    beta = np.zeros(2)
    best = likelihood(beta)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        gradient = x.T @ (weight * (toxic - p)) - ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        while np.abs(step).max() >= 1e-8 and (reached := likelihood(beta + step)) < best:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        beta, best = beta + step, reached
    return float(beta[0]), float(beta[1])


def evidence(docs: DataFrame, model: Model, tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """docs (doc_id, text) to doc_id, _h, evidence, score; with ``tables`` the model's expressions are joined by shuffle."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if tables is not None:
        rows = _joined_evidence(rows, *tables)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            e = b["evidence"].to_numpy(float) if "evidence" in b else np.asarray([own.evidence(t) for t in b["text"]], float)
            yield pd.DataFrame({"doc_id": b["doc_id"], "_h": b["_h"], "evidence": e, "score": own.score(e)})

    return rows.mapInPandas(lean(run), f"doc_id {kind}, _h long, evidence double, score double")


def _joined_evidence(rows: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows (doc_id, _h, text) to doc_id, _h, evidence: every different text's words meet the ratios by shuffle, combined by word pair."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    seen = rows.select("_h", w.alias("w")).where(F.size("w") > 0)
    before = F.concat(F.array(F.lit("")), F.slice("w", 1, F.size("w") - 1))
    tokens = seen.select("_h", F.size("w").alias("size"), F.explode(F.arrays_zip(before.alias("h"), F.col("w"))).alias("x")).select("_h", "size", "x.h", "x.w")
    rows_of = seen.groupBy("_h").agg(F.count("*").alias("times"))  # repeated texts
    ratio = F.coalesce(F.col("pr"), F.col("wr"), F.lit(0.0))
    counted = tokens.groupBy("_h", "size", "h", "w").agg(F.count("*").alias("n"))
    told = counted.join(words.select("w", F.col("r").alias("wr")), "w", "left").join(pairs.select("h", "w", F.col("r").alias("pr")), ["h", "w"], "left")
    mean = told.groupBy("_h", "size").agg(F.sum(ratio * F.col("n")).alias("total")).join(rows_of, "_h")
    mean = mean.select("_h", (F.col("total") / F.col("times") / F.col("size")).alias("evidence"))
    return attach(rows.select("doc_id", "_h"), mean, ["_h"]).select("doc_id", "_h", F.coalesce("evidence", F.lit(0.0)).alias("evidence"))


def _judged(docs: DataFrame, labels: DataFrame, options: dict) -> DataFrame:
    return evidence(docs, *train(docs, labels, **options))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, _h, held_out, score, predicted, evidence."""
    scored = _judged(docs, labels, options)
    return scored.select("doc_id", "_h", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns kept."""
    bad = _judged(docs, labels, options).where("score >= 0.5").select("doc_id", "_h").distinct()
    return filtered(docs, staged(bad, "toxic"), "left_anti")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("_h")
