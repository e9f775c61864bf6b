"""Training rows of a generator with a table encoder: references filtered, cut and closed, with the cells that each one mentions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import align, serialise
from factloom.operators.features import training_refs
from factloom.sources.staging import positioned, staged

VARIANTS = ("replacement", "augmentation")
#: Rows of a block that batches are packed in.
PACK_BLOCK = 1024


def split_prompt(ids: Sequence[int], marker: Sequence[int]) -> tuple[list[int], list[int]]:
    """What stands before and after the first ``marker`` of a prompt's ids, where the table goes in."""
    ids, marker = list(ids), list(marker)
    for i in range(len(ids) - len(marker) + 1):
        if marker and ids[i : i + len(marker)] == marker:
            return ids[:i], ids[i + len(marker) :]
    raise ValueError("the prompt does not hold the marker")


def training_rows(
    examples: DataFrame, cells: DataFrame, encode: Callable[[Column], Column], prompt: tuple[Sequence[int], Sequence[int]], eos: int, variant: str = "replacement",
    filter_refs: bool = False, max_refs: int = 1, max_ref_tokens: int = 512, to_text: Callable[[DataFrame], DataFrame] = serialise.to_markdown,
) -> DataFrame:
    """(ex_id, ref, prefix, table_ids, suffix, ref_ids, aux_labels) per example and reference.

    examples: (ex_id, references). encode: a text to its ids. The first ``max_refs`` references count; ``filter_refs`` keeps the sentences
    that mention a cell and claim nothing wrong, and leaves out references of which nothing is left. aux_labels: 1 for each cell
    that the reference mentions, in the table's order. table_ids: the serialised table's in the variant that shows it, else empty.
    """
    if variant not in VARIANTS:
        raise ValueError(f"there is no training on the variant {variant!r}")
    refs = examples.select("ex_id", F.posexplode(F.slice("references", 1, max_refs)).alias("ref", "reference"))
    if filter_refs:
        refs = staged(align.filter_references(cells, refs, "ref").filter("reference <> ''"), "references")
    labels = align.alignment_labels(cells, refs, "ref").groupBy("ex_id", "ref").agg(F.array_sort(F.collect_list(F.struct("sec_idx", "row_idx", "col_idx", F.col("label").cast("int").alias("label")))).alias("cells"))
    none = F.array().cast("array<int>")
    ids = encode(F.col("reference")).cast("array<int>")
    rows = refs.join(labels, ["ex_id", "ref"], "left").withColumn("aux_labels", F.coalesce(F.transform("cells", lambda c: c["label"]), none)).withColumn("table_ids", none)
    if variant == "augmentation":
        shown = to_text(cells).select("ex_id", encode(F.col("text")).cast("array<int>").alias("table_ids"))
        rows = rows.drop("table_ids").join(shown, "ex_id", "left").withColumn("table_ids", F.coalesce("table_ids", none))
    before, after = (F.array(*map(F.lit, part)).cast("array<int>") for part in prompt)
    return rows.select("ex_id", "ref", before.alias("prefix"), "table_ids", after.alias("suffix"), training_refs(ids, eos, max_ref_tokens).alias("ref_ids"), "aux_labels")


def n_dropped(examples: DataFrame, rows: DataFrame, max_refs: int = 1) -> int:
    """How many references were left out for want of a sentence that the table bears out."""
    return (examples.agg(F.sum(F.least(F.size("references"), F.lit(max_refs)))).first()[0] or 0) - rows.count()


def pack(rows: DataFrame, budget: int, order: Sequence[str] = ("ex_id", "ref")) -> DataFrame:
    """``rows`` with ``block`` and ``batch``: rows in order, so many to a batch that less than ``budget`` ids stand before its last row.

    Blocks of ``PACK_BLOCK`` rows are packed each for itself, so no task orders more than one.
    """
    size = F.size("prefix") + F.size("table_ids") + F.size("suffix") + F.size("ref_ids")
    placed = positioned(rows, "place_", *order, kind="long").withColumn("block", F.floor(F.col("place_") / PACK_BLOCK))
    before = Window.partitionBy("block").orderBy("place_").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("batch", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / budget)).drop("place_")
