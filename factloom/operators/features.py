"""Cells as features of a learned encoder, and token sequences as padded training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numeric import numeric_features, string_bucket

IGNORED = -100


def column_key() -> Column:
    return F.concat_ws("|", "sec_name", "col_name")


def column_stats(cells: DataFrame) -> DataFrame:
    """(key, mean, std): mean and population deviation of the numeric cells of each column of each section."""
    return cells.filter("kind = 1").groupBy(column_key().alias("key")).agg(F.avg("num").alias("mean"), F.stddev_pop("num").alias("std"))


def column_vocab(cells: DataFrame) -> DataFrame:
    """(key, col_id): distinct column keys, sorted, from 1; 0 is the unknown column. One row per column name."""
    keys = cells.select(column_key().alias("key")).distinct()
    return keys.withColumn("col_id", F.row_number().over(Window.orderBy("key")))


def featurise(cells: DataFrame, vocab: DataFrame, stats: DataFrame) -> DataFrame:
    """(ex_id, r, c, col_id, kind, num_feats, str_bucket, is_key): r runs over the rows of all sections in order."""
    key = cells.withColumn("key", column_key())
    out = key.join(vocab, "key", "left").join(stats, "key", "left")
    zero = F.array(*[F.lit(0.0)] * 4)
    feats = F.when(F.col("kind") == 1, numeric_features(F.col("num"), F.coalesce("mean", F.lit(0.0)), F.coalesce("std", F.lit(0.0)))).otherwise(zero)
    r = F.dense_rank().over(Window.partitionBy("ex_id").orderBy("sec_idx", "row_idx")) - 1
    return out.select("ex_id", r.alias("r"), F.col("col_idx").alias("c"), F.coalesce("col_id", F.lit(0)).alias("col_id"), "kind", feats.alias("num_feats"), F.when(F.col("kind") == 2, string_bucket(F.col("str"))).otherwise(0).alias("str_bucket"), "is_key")


def shapes(features: DataFrame) -> DataFrame:
    """(ex_id, n_rows, n_cols): what a table is padded to."""
    return features.groupBy("ex_id").agg((F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"))


def collate(rows: DataFrame, k: int, pad_id: int, batch: str = "batch") -> DataFrame:
    """Rows (batch, prefix, suffix, ref, table_ids) to ids, labels, attention and soft positions, padded per batch.

    Layout: prefix, k soft places, table, suffix, reference; only the reference is trained on.
    """
    ids = F.concat("prefix", F.array_repeat(F.lit(pad_id), k), "table_ids", "suffix", "ref")
    given = F.size("prefix") + k + F.size("table_ids") + F.size("suffix")
    labels = F.concat(F.array_repeat(F.lit(IGNORED), given), "ref")
    out = rows.select("*", ids.alias("ids"), labels.alias("labels"), F.sequence(F.size("prefix"), F.size("prefix") + k - 1).alias("soft_pos"))
    out = out.withColumn("longest", F.max(F.size("ids")).over(Window.partitionBy(batch)))
    pad = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("longest") - F.size("ids")))
    seen = F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), F.col("longest") - F.size("ids")))
    return out.select(*rows.columns, pad("ids", pad_id).alias("input_ids"), pad("labels", IGNORED).alias("labels"), seen.alias("attention"), "soft_pos")


def training_refs(ids: Column, eos: int, most: int = 512) -> Column:
    """A reference's ids: cut at ``most`` without an end, else closed by the end id."""
    return F.when(F.size(ids) > most, F.slice(ids, 1, most)).otherwise(F.concat(ids, F.array(F.lit(eos))))
