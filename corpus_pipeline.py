"""A corpus pipeline of five stages over ``documents``: toxicity, near-duplicates, benchmark leaks, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of
``documents``. Results between stages are written as Parquet and read again, so a lost executor costs the tasks of
one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import new_path
from millrace.llm.decontamination import without_contaminated
from millrace.llm.mixing import mix
from millrace.llm.near_duplicates import without_near_duplicates
from millrace.llm.tokens import token_digests, write_token_files
from millrace.llm.toxicity import without_toxic
from millrace.session import ready


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models call toxic go."""
    return without_toxic(docs, ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8) stays: that with the smallest id."""
    ready(spark)
    return without_near_duplicates(docs, width=5, threshold=(80, 100))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return without_contaminated(docs, ready(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (none to three times)."""
    ready(spark)
    return mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixed documents in ascending doc_id order, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    folder = new_path(ready(spark), "tokens")
    write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(spark, folder)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage is a trained model and the last a tokenizer, which SQL cannot express.
ORACLE_SQL = None
