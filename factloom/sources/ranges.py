"""Records of large files by byte ranges: one quoted CSV or one JSON array is read by many tasks, in order.

Spark's text source cuts a file into ranges and hands out pieces that end in a line feed (CSV) or a closing brace (JSON). Whether
a piece ends a record depends on everything before it: on the parity of quotes and, in JSON, on the depth of brackets.

1. One pass gives each range's effect on that state: whether it flips the parity, and by how much it moves the depth if it
   starts outside or inside a string. A window over the ranges of a file, a row each, combines them into the state in
   which each range starts.
2. A second pass reads records off each range from that state. What stands before a range's first border and after its last is a
   fragment; a record's fragments, of two ranges or more, are put together by a window over the fragments alone.

Nothing holds more than a record. A file that can't be split (compressed) is one range.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Start states of so many ranges at most are sent to every task; beyond that ranges meet theirs by a sorted shuffle.
_BROADCAST_RANGES = 50_000
_RANGE = ("file", "start")


def _csv_effect(piece: str) -> tuple[int, int, int]:
    return piece.count('"') & 1, 0, 0


_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _json_effect(piece: str) -> tuple[int, int, int]:
    """(flips, change of depth from outside, from inside a string) of a piece with its closing brace."""
    parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    parts[-1] += "}"
    moves = [p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in parts]
    return (len(parts) - 1) & 1, sum(moves[::2]), sum(moves[1::2])


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, start, id, piece): what the ranges hold, in the order of ``id`` within a range."""
    at = F.col("_metadata")
    return spark.read.text(path, lineSep=separator).select(at["file_path"].alias("file"), at["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("piece"))


def _starts(pieces: DataFrame, effect: Callable[[str], tuple[int, int, int]]) -> DataFrame:
    """(file, start, odd, depth): the state in which each range starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        for batch in batches:
            for file, start, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "piece")), strict=True):
                state = held.setdefault((file, start), [0, 0, 0])
                flips, outside, inside = effect(piece)
                moves = (inside, outside) if state[0] else (outside, inside)
                state[0], state[1], state[2] = state[0] ^ flips, state[1] + moves[0], state[2] + moves[1]
        columns = list(zip(*((*k, *v) for k, v in held.items()), strict=True)) if held else [()] * 5
        types = (pa.string(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "start", "flips", "outside", "inside"])

    effects = pieces.select("file", "start", "piece").mapInArrow(run, "file string, start long, flips long, outside long, inside long")
    # A range's rows are in one task, and nothing but ranges is ordered here.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = effects.withColumn("odd", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    moved = odd.withColumn("move", F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")))
    return moved.select("file", "start", F.col("odd").cast("int").alias("odd"), F.coalesce(F.sum("move").over(before), F.lit(0)).alias("depth"))


def _records(spark: SparkSession, path: str, separator: str, effect: Callable, ends: Callable[[int, int], bool]) -> DataFrame:
    """(file, start, seq, text): whole records, in the order of these three; a record stands where it starts."""
    pieces = _pieces(spark, path, separator)
    states = _starts(pieces, effect)
    few = states.count() <= _BROADCAST_RANGES
    ready = pieces.join(F.broadcast(states) if few else states, list(_RANGE))
    if not few:
        ready = ready.repartition(*_RANGE).sortWithinPartitions(*_RANGE, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seq, first, odd, depth = None, [], 0, True, 0, 0
        out: list[tuple] = []

        def close(last: bool) -> None:
            nonlocal held, seq, first
            # What the range's first record is made of may begin in an earlier range; what is left at its end goes on.
            kind = 0 if last and first else 1 if first else 2 if last else 3
            out.append((*key, seq, kind, "".join(held)))
            held, seq, first = [], seq + 1, False

        for batch in batches:
            for file, start, piece, odd_0, depth_0 in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "piece", "odd", "depth")), strict=True):
                if (file, start) != key:
                    if key is not None:
                        close(True)
                    key, held, seq, first, odd, depth = (file, start), [], 0, True, odd_0, depth_0
                flips, outside, inside = effect(piece)
                depth += inside if odd else outside
                odd ^= flips
                held += (piece, separator)
                if not odd and ends(odd, depth):
                    close(False)
            if out:
                yield _batch(out)
        if key is not None:
            close(True)
        yield _batch(out)

    # kinds: 0 goes on from and into other ranges, 1 ends what an earlier range began, 2 begins what a later one ends, 3 is whole.
    found = ready.select("file", "start", "piece", "odd", "depth").mapInArrow(run, "file string, start long, seq long, kind int, text string")
    parts = found.filter("kind < 3")
    order = Window.partitionBy("file").orderBy("start", "seq")
    # A record begins after each border: with a fragment of kind 2, or with the file.
    group = F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).over(order)
    joined = parts.withColumn("group", group).groupBy("file", "group").agg(
        F.min_by("start", F.struct("start", "seq")).alias("start"), F.min_by("seq", F.struct("start", "seq")).alias("seq"), F.array_sort(F.collect_list(F.struct("start", "seq", "text"))).alias("parts")
    )
    whole = joined.select("file", "start", "seq", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    return found.filter("kind = 3").drop("kind").unionByName(whole)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    rows.clear()
    types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "start", "seq", "kind", "text"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, seq, text) of the records of quoted CSV files, header included; records without a character are left out."""
    text = F.regexp_replace(F.regexp_replace("text", r"\r?\n\z", ""), "^﻿", "")
    return _records(spark, path, "\n", _csv_effect, lambda odd, depth: True).withColumn("text", text).filter("text <> ''")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, seq, text) of the objects of files that hold a JSON array of objects each."""
    text = F.regexp_replace("text", r"^[﻿\s,\[]+", "")
    found = _records(spark, path, "}", _json_effect, lambda odd, depth: depth == 1).withColumn("text", text)
    return found.filter(F.startswith("text", F.lit("{")))
