"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import chat_expand, decontaminate, hard_negatives, html_extract, jaccard_join, ngram_lm, piece_lattice, pivot_dedup, quality_rules, token_counts, token_files, url_cascade, whitening
from factloom.llm.oracles import ORACLE_SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = token_files.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_tokens(folder, index)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_report(_table(spark, sf_dir, "documents"))


def op3_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.encode_digest(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.train_and_score(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_cascade.judge_urls(pages, url_cascade.named_hosts(pages))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def op10_chat_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_expand.digests(chat_expand.expand(turns.unionByName(extra)))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


def op13_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_dedup.link(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_piece_lattice": op3_piece_lattice,
    "op4_html_extract": op4_html_extract,
    "op5_ngram_lm": op5_ngram_lm,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_url_cascade": op8_url_cascade,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_expand": op10_chat_expand,
    "op11_whitening": op11_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_pivot_dedup": op13_pivot_dedup,
}
