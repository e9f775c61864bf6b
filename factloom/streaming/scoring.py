"""Scoring generations as they arrive: item-level checks are stateless, so a folder of JSON lines streams through them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import claim_units, numbers, sentences
from factloom.operators import numbers as N
from factloom.operators import relations as R
from factloom.sources.loaders import GENERATION


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(GENERATION).json(folder).filter("id IS NOT NULL")


def text_measures(stream: DataFrame) -> DataFrame:
    """Stateless projection: counts of numbers, sentences and claim units of each text."""
    size = lambda f: F.size(f(F.col("output"))).cast("long")
    return stream.select("id", size(numbers).alias("n_numbers"), size(sentences).alias("n_sentences"), size(claim_units).alias("n_units"))


def score_stream(stream: DataFrame, cells: DataFrame, context: DataFrame, sink: str, checkpoint: str) -> Callable:
    """Start a query that appends number and relation scores of each micro-batch to ``sink`` as Parquet.

    A batch is written under its own number, so one that is run again replaces itself.
    """

    def one(batch: DataFrame, number: int) -> None:
        texts = batch.dropDuplicates(["id"]).select("id", "output")
        found = R.score_items(texts, R.claims(texts, context)).select("id", F.col("n_claims").alias("rel_n_claims"), F.col("n_wrong").alias("rel_n_wrong"))
        N.score_items(texts, cells).drop("unsupported").join(found, "id").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
