"""A corpus pipeline of five stages; each works on all that the one before it kept.

Rows are judged one by one: rows that share a doc_id and differ in text, or have no doc_id, keep or lose each its own place. Rows
that repeat id and text have the same verdict; of such rows near_duplicates keeps one. Null and empty texts have no words, and
quality_rules rejects them; a stage that is given one keeps it (near_duplicates, repeated_passages, benchmark_free) or packs its end
id (packing). Very long texts are read whole. Ties between near copies go to the smallest doc_id, then to the smallest hash of the
text; rows without an id come last. An empty table gives an empty table with the same columns at every stage, and columns beside
those of documents are dropped, whatever their names. What stages write on their way stays in the shared folder until ``run`` is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.llm import compression_rules, decontam, hilbert_pack, near_dup, suffix_dedup
from tracegrain.llm.queries import tokenizer
from tracegrain.sources.scratch import discard, job, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules keep. Null and empty texts fail; each of rows that repeat has the same verdict."""
    judged = compression_rules.compression_rules(docs, carry=tuple(COLUMNS))
    return judged.where("kept").select("carried.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id; rows without words all stay."""
    return near_dup.drop_near_duplicates(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that an earlier one has; n_chars is that of the text that remains. Null texts become empty."""
    cut = suffix_dedup.suffix_array_dedup(docs, carry=("lang", "source", "n_chars"))
    return cut.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item; rows without words all stay."""
    return decontam.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in training sequences; a row without text is its end id."""
    return hilbert_pack.pack(docs, tokenizer("word_bpe_49k.json"), 1)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_free", benchmark_free), ("packing", packing)]

#: Tokenising and compression are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with job() as own:
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), name)
            discard(spark, own)
    return docs
