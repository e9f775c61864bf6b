"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Quality rules drop what the base rule or the adaptive thresholds reject; the n-gram Jaccard join keeps one document of
each group of near copies; decontamination drops documents that hold benchmark passages; SentencePiece encodes every
text and decodes it again. The first three return the columns of ``documents``, the last doc_id, n_pieces, ids and the
decoded text.

Defined results: a document whose text is null or has fewer than 50 words goes at the first stage; ids may be null or
repeated, rows that are alike are copies of each other and one of them stays; null ``lang`` and ``source`` form groups of
their own; texts are handled whole, whatever their length; an empty benchmark removes nothing; empty documents give an
empty result; other columns pass through the first three stages untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, jaccard_join, piece_lattice, quality_rules
from factloom.llm.common import shared_dir
from factloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the adaptive thresholds reject go."""
    return quality_rules.apply_rules(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark passages go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids and the text that they decode to."""
    return piece_lattice.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_copy_stage),
    ("decontaminate", decontamination_stage),
    ("piece_lattice", piece_stage),
]

#: SQL can't express the stages after the first; they are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
