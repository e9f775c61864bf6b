"""Hard negatives of anchors: every anchor's scores of all rows, sorted in full, and searched for each positive's limits.

1. Components become whole numbers; clean rows are staged with a row number and dealt out evenly, ``ROWS`` to a task.
   Anchors, a stated query set, are staged in files that every task streams, ``ANCHORS`` at a time: a task holds its own rows
   and one block of anchors. Scores are exact integers.
2. A first pass sorts each anchor's scores of a task's rows by score and id and gives the first same-label rows; the first of all
   tasks' are the positives.
3. A second pass sorts again. For a positive, a binary search over the sorted different-label rows finds the upper limit, from
   where the next rows down to the lower limit are read. The first of all tasks' are the negatives: the first k of a sorted
   whole are among the first k of its sorted parts.

Both passes end in a ranking per anchor (and positive), cut to its first rows before the shuffle, so what moves is a few rows
per anchor and task, however skewed the labels are.

Defined results: rows with a null id, label or vector, an empty vector, a null or non-finite component, one too large for
exact scores, or of another length than most (of two as frequent lengths, the larger) take no part; each row stands for
itself, so a repeated row is another row of its label, has results of its own if it is an anchor, and ties with its copy;
equal scores go by id; an anchor without other rows of its label has no result, nor has a positive with a score below zero
(no score lies between its limits); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import open_fs, stage, trimmed
from factloom.llm.vectors import blocks, dimension, usable

POSITIVES, NEGATIVES = 5, 3
#: Limits of a negative's score in hundredths of the positive's.
LOWER, UPPER = 50, 95
SCALE = 256
#: Rows of a task, and anchors scored against them at a time.
ROWS, ANCHORS = 16_384, 256
_POSITIVE = "anchor long, anchor_id long, score long, id long"
_NEGATIVE = "anchor long, anchor_id long, positive long, positive_id long, positive_score long, score long, id long"


def most_component(width: int) -> int:
    """The largest whole-number component for which a hundredfold inner product fits 64 bits."""
    return math.isqrt(((1 << 62) - 1) // (100 * max(1, width)))


def prepare(table: DataFrame, anchors: Column, labels: Column, id: str, vector: str) -> tuple[DataFrame, int, int]:
    """(row, id, label, anchor, v) of the rows that take part, staged in even parts; their dimension and count."""
    rows = table.select(F.col(id).cast("long").alias("id"), labels.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    width = dimension(rows, "v")
    most = float(most_component(width)) / SCALE
    rows = rows.filter((F.size("v") == width) & F.forall("v", lambda x: F.abs(x) < most))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(SCALE * x).cast("long")))
    staged = stage(rows, "vectors")
    n = staged.count()
    parts = max(table.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS))
    dealt = stage(staged.repartition(parts).withColumn("row", F.monotonically_increasing_id()), "vectors")
    return dealt, width, n


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in double precision where that is exact, else in 64-bit integers."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    if float(np.abs(anchors).max()) * float(np.abs(rows).max()) * rows.shape[1] < 1 << 53:
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return anchors @ rows.T


def anchor_blocks(folder: str, columns: list[str]) -> Iterator[pa.Table]:
    """The staged anchors, ``ANCHORS`` at a time, one file after another."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = open_fs(folder)
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
    for name in names:
        with store.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(ANCHORS, columns=columns):
                yield pa.Table.from_batches([batch])


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _ints(table: pa.Table, name: str, width: int) -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy().reshape(-1, width)


def _first_positives(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    for rows in blocks(batches, ROWS):
        ids, labels, numbers, vectors = _column(rows, "id"), _column(rows, "label"), _column(rows, "row"), _ints(rows, "v", width)
        for block in anchor_blocks(folder, ["row", "id", "label", "v"]):
            found = scores(_ints(block, "v", width), vectors)
            out: list[tuple] = []
            for k, (row, anchor_id, label) in enumerate(zip(_column(block, "row").tolist(), _column(block, "id").tolist(), _column(block, "label").tolist(), strict=True)):
                order = np.lexsort((ids, -found[k]))
                same = order[(labels[order] == label) & (numbers[order] != row)][:POSITIVES]
                out += zip([row] * len(same), [anchor_id] * len(same), found[k, same].tolist(), ids[same].tolist(), strict=True)
            yield _batch(out, ["anchor", "anchor_id", "score", "id"])


def _first_negatives(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    for rows in blocks(batches, ROWS):
        ids, labels, vectors = _column(rows, "id"), _column(rows, "label"), _ints(rows, "v", width)
        for block in anchor_blocks(folder, ["row", "id", "label", "v", "positives"]):
            found = scores(_ints(block, "v", width), vectors)
            out: list[tuple] = []
            for k, (row, anchor_id, label, positives) in enumerate(zip(_column(block, "row").tolist(), _column(block, "id").tolist(), _column(block, "label").tolist(), block["positives"].to_pylist(), strict=True)):
                order = np.lexsort((ids, -found[k]))
                other = order[labels[order] != label]
                falling = -found[k, other]
                for p in positives:
                    at = int(np.searchsorted(falling, -(UPPER * p["score"] // 100), "left"))
                    for j in range(at, min(at + NEGATIVES, len(other))):
                        if -100 * int(falling[j]) < LOWER * p["score"]:
                            break
                        out.append((row, anchor_id, p["place"], p["id"], p["score"], -int(falling[j]), int(ids[other[j]])))
            yield _batch(out, ["anchor", "anchor_id", "positive", "positive_id", "positive_score", "score", "id"])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _ranked(found: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """The first rows by score and id of each key; each task of a shuffle sends that many at most."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= most)


def mine(table: DataFrame, anchors: Column, labels: Column, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The first negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: which rows are anchors; labels: every row's label, null for a row that takes no part.
    """
    rows, width, _ = prepare(table, anchors, labels, id, vector)
    chosen = stage(rows.filter("anchor").select("row", "id", "label", "v"), "anchors")
    folder = chosen._staged_at
    first = rows.mapInArrow(trimmed(lambda b: _first_positives(b, folder, width)), _POSITIVE)
    positives = _ranked(first, ["anchor", "anchor_id"], POSITIVES, "place").groupBy("anchor").agg(F.collect_list(F.struct("place", "id", "score")).alias("positives"))
    ready = stage(chosen.join(positives.withColumnRenamed("anchor", "row"), "row"), "anchors")
    folder_2 = ready._staged_at
    second = rows.mapInArrow(trimmed(lambda b: _first_negatives(b, folder_2, width)), _NEGATIVE)
    out = _ranked(second, ["anchor", "positive"], NEGATIVES, "rank")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
