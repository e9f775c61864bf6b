"""Number support: every number of a text must stand in the table or follow from two cells of a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numeric import key6
from factloom.functions.text import numbers

#: Columns with more numeric cells derive nothing, unless ``score_items`` is told to take all.
MAX_COLUMN_CELLS = 40


def table_numbers(cells: DataFrame) -> DataFrame:
    """(ex_id, value): distinct numbers of a table, those inside string cells included."""
    inside = F.when(F.col("kind") == 1, F.array("num")).when(F.col("kind") == 2, numbers(F.col("str")))
    return cells.select("ex_id", F.explode(inside).alias("v")).select("ex_id", key6(F.col("v")).alias("value")).distinct()


def _pairs(values: Column) -> Column:
    """Sums and absolute differences of all pairs of an array of bounded length."""
    later = lambda i: F.slice(values, i + 2, F.size(values))
    return F.flatten(F.transform(values, lambda x, i: F.flatten(F.transform(later(i), lambda y: F.array(key6(x + y), key6(F.abs(x - y)))))))


def derived_numbers(cells: DataFrame) -> DataFrame:
    """(ex_id, value): distinct sums and differences of two cells of one column, for columns of 2 to 40 numeric cells."""
    columns = cells.filter("kind = 1").groupBy("ex_id", "sec_idx", "col_idx").agg(F.collect_list("num").alias("vs"))
    usable = columns.filter((F.size("vs") >= 2) & (F.size("vs") <= MAX_COLUMN_CELLS))
    return usable.select("ex_id", F.explode(F.array_distinct(_pairs(F.col("vs")))).alias("value")).distinct()


def derived_among(said: DataFrame, cells: DataFrame) -> DataFrame:
    """(ex_id, value): of the numbers (ex_id, value), those that are a sum or difference of two cells of one column, however long.

    What a number lacks to each distinct value of a column is looked up among the others, so the work grows with values times
    numbers, not with pairs of cells. A number or cell that isn't finite derives nothing.
    """
    column = ["ex_id", "sec_idx", "col_idx"]
    values = cells.filter((F.col("kind") == 1) & (F.abs("num") < float("inf"))).groupBy(*column, "num").agg(F.count(F.lit(1)).alias("n"))
    # Twice what rounding to six decimals, and doubles of the column's size, put a value off: it is found in its bucket or one beside it.
    values = values.withColumn("width", 1e-6 + F.max(F.abs("num")).over(Window.partitionBy(*column)) * 2.0**-48)
    lacks = F.array(*[x / F.col("width") for x in (F.col("value") - F.col("num"), F.col("num") - F.col("value"))])
    wanted = values.join(said, "ex_id").withColumn("at", F.explode(lacks)).filter(F.abs("at") < 2.0**52)
    wanted = wanted.select(*column, "num", "n", "value", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor("at") + d)).alias("bucket"))
    others = values.select(*column, F.col("num").alias("other"), F.floor(F.col("num") / F.col("width")).alias("bucket"))
    made = (key6(F.col("num") + F.col("other")) == F.col("value")) | (key6(F.abs(F.col("num") - F.col("other"))) == F.col("value"))
    two = (F.col("num") != F.col("other")) | (F.col("n") > 1)
    return wanted.join(others, [*column, "bucket"]).filter(two & made).select("ex_id", "value").distinct()


def score_items(outputs: DataFrame, cells: DataFrame, allow_derived: bool = True, long_columns: bool = False) -> DataFrame:
    """Per output (id, output): counts by tier, the unsupported numbers and the rates (null without numbers).

    The exact tier takes every table number divided by 100 too, so that a percent supports its fraction.
    long_columns: columns of more than 40 numeric cells derive numbers too.
    """
    exact = table_numbers(cells).groupBy("ex_id").agg(F.collect_list("value").alias("x"))
    exact = exact.select("ex_id", F.array_union("x", F.transform("x", lambda v: key6(v / 100))).alias("exact"))
    out = outputs.select("id", numbers(F.col("output")).alias("found")).join(exact, F.col("id") == F.col("ex_id"), "left").drop("ex_id")
    if allow_derived:
        said = outputs.select(F.col("id").alias("ex_id"), F.explode(F.transform(numbers(F.col("output")), key6)).alias("value")).distinct()
        derived = (derived_among(said, cells) if long_columns else derived_numbers(cells)).groupBy("ex_id").agg(F.collect_list("value").alias("derived"))
        out = out.join(derived, F.col("id") == F.col("ex_id"), "left").drop("ex_id")
    else:
        out = out.withColumn("derived", F.lit(None).cast("array<double>"))
    held = lambda a: lambda n: F.coalesce(F.array_contains(F.col(a), key6(n)), F.lit(False))
    in_exact, in_derived = held("exact"), held("derived")
    out = out.withColumn("tiers", F.transform("found", lambda n: F.when(in_exact(n), 1).when(in_derived(n), 2).otherwise(0)))
    count = lambda t: F.size(F.filter("tiers", lambda x: x == t)).cast("long")
    out = out.select("id", F.size("found").cast("long").alias("n_numbers"), count(1).alias("n_exact"), count(2).alias("n_derived"), F.filter("found", lambda _, i: F.get("tiers", i) == 0).alias("unsupported"))
    supported = F.col("n_exact") + F.col("n_derived")
    return out.select("id", "n_numbers", "n_exact", "n_derived", supported.alias("n_supported"), "unsupported", F.try_divide(supported, "n_numbers").alias("support_rate"), F.try_divide("n_exact", "n_numbers").alias("exact_rate"))


def score_run(items: DataFrame, *by: str) -> DataFrame:
    """Micro rates over items; the share of items with an unsupported number is over all items."""
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("n_numbers") > 0).alias("items_with_numbers"),
        F.try_divide(F.sum("n_supported"), F.sum("n_numbers")).alias("number_support_rate_micro"), F.try_divide(F.sum("n_exact"), F.sum("n_numbers")).alias("number_exact_rate_micro"),
        F.try_divide(F.count_if(F.size("unsupported") > 0), F.count(F.lit(1))).alias("pct_items_with_unsupported_number"),
    )
