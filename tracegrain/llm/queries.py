"""The thirteen queries of this subpackage, and the pipeline's, for the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.llm import chat_collapse, compression_rules, decontam, hilbert_pack, lang_mixture, near_dup, quality_gam, reversed_search, spelling, suffix_dedup, token_counts, token_store, url_trees

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_array_dedup(_read(spark, sf_dir, "documents"), keep_text=False)


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = lang_mixture.fit(docs.where(~_held_out()))
    return lang_mixture.identify(docs, model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_tokens(*token_store.write_tokens(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 2))


def op4_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules.compression_rules(_read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op6_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def op7_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_pack.pack(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 1)


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_gam.fit(docs, _read(spark, sf_dir, "labels").where(~_held_out()))
    return quality_gam.score(docs, model).select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.render(_read(spark, sf_dir, "conversations"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(_read(spark, sf_dir, "documents")))


def op12_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def queries() -> dict:
    own = [op1_suffix_array_dedup, op2_language_mixture, op3_token_store, op4_compression_rules, op5_decontaminate, op6_url_trees, op7_hilbert_pack, op8_quality_gam, op9_near_duplicates, op10_chat_collapse, op11_spelling_variants, op12_reversed_search, op13_token_counts]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_collapse": chat_collapse.ORACLE_SQL, "op11_spelling_variants": spelling.ORACLE_SQL, "op12_reversed_search": reversed_search.ORACLE_SQL}
