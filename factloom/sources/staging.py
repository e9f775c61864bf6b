"""Tables that several branches of a query read: written once to the shared folder, so no branch builds them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a temporary base is set only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(shared_folder, "own", None)
        if base is None:
            base = shared_folder.own = "file://" + tempfile.mkdtemp(prefix="factloom-")
    return f"{base.rstrip('/')}/factloom/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; it survives lost executors. Staged tables are left as they are.

    The shuffle files of the write go when it has ended, as nothing reads them again.
    """
    if getattr(df, "_staged", False):
        return df
    spark = df.sparkSession
    path = shared_folder(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = True
    return out


def positioned(df: DataFrame, name: str = "pos", *order: str, kind: str = "int") -> DataFrame:
    """``df`` with the place of each row from 0: in the order of the columns, or as the rows are read if none are given.

    Rows stay dealt out; only the number of rows of each partition is summed in one place.
    """
    rows = df.orderBy(*order) if order else df
    # A partition's number stands above 33 bits of the row's own.
    rows = staged(rows.withColumn("at_", F.monotonically_increasing_id()), "positions").withColumn("part_", F.shiftright("at_", 33))
    counts = rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = counts.select(F.col("part_"), (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    place = F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(before, "part_").withColumn(name, place.cast(kind)).drop("at_", "part_", "before_")
