"""SentencePiece encoding over a relational lattice, and decoding.

The distinct units of the corpus (see ``unitmap``) are exploded into their substrings of bounded length, which are
equi-joined to the piece table (a vocabulary, so bounded; broadcast). The edges are grouped by unit and folded with
``aggregate``:

* unigram models: Viterbi over positions, best score first, then fewer pieces;
* BPE models: the public files here are of this kind, whose tokens are defined by merges and not by the best sum of
  scores, so Viterbi gives other ids than the model's own. Their fold takes the edges in the order of their scores,
  then from left to right, and joins two neighbours wherever an edge covers exactly both.

Units of more than ``unitmap.LONG_UNIT`` characters are resolved alone, by the same rules, with a heap or a table of
positions: a fold over their edges would take the square of their length. Characters without a piece become their
UTF-8 bytes. Defined results: null and empty texts have no ids; repeated ids
keep a row each; a null id stays null; an empty table gives an empty result; texts are whole whatever their length; other
columns are not looked at; decoding gives back the text exactly, but for U+2581, which pieces write for a blank and which comes
back as one.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.unitmap import Pieces, load_pieces, located, resolve, row_values

#: A character without a piece scores this much less than the worst piece in a unigram model.
UNKNOWN_PENALTY = 10.0


def piece_table(spark, vocabulary: Pieces) -> DataFrame:
    """(piece, id, score), and an empty piece of id -1 that gives every unit a row."""
    rows = [*zip(vocabulary.pieces, vocabulary.ids, map(float, vocabulary.scores), strict=True), ("", -1, 0.0)]
    table = pa.table({"piece": [r[0] for r in rows], "id": pa.array([r[1] for r in rows], pa.int32()), "score": [r[2] for r in rows]})
    return spark.createDataFrame(table)


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, edges): edges (s, e, id, score) from character s up to e; one of id -1 stands in every lattice.

    The explosion and the grouping stay in the partitioning of ``units`` by unit.
    """
    n = F.length("unit")
    lengths = F.when(F.col("s") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("s"))))
    at = units.select("unit", F.explode(F.sequence(F.lit(-1), n - 1)).alias("s")).select("unit", "s", F.explode(lengths).alias("l"))
    parts = at.select("unit", "s", (F.col("s") + F.col("l")).alias("e"), F.substr("unit", F.col("s") + 1, F.col("l")).alias("piece"))
    edges = parts.join(F.broadcast(pieces), "piece")
    return edges.groupBy("unit").agg(F.collect_list(F.struct((-F.col("score")).alias("cost"), "s", "e", "id")).alias("edges"))


def _bytes_of(unit: Column, at: Column, byte_base: int) -> Column:
    """Ids of the UTF-8 bytes of one character."""
    digits = F.hex(F.encode(F.substr(unit, at + 1, F.lit(1)), "UTF-8"))
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(digits) / 2).cast("int") - 1), lambda k: (F.conv(F.substr(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("int") + byte_base))


def _with(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def bpe_fold(byte_base: int) -> Column:
    """Ids of a unit by merges. The state is a string with a 1 at every boundary between two symbols."""
    unit, edges = F.col("unit"), F.col("edges")
    n = F.length(unit)
    one = F.lit("1")

    def free(mask: Column, e: Column, inside: int) -> Column:
        between = F.substr(mask, e["s"] + 2, e["e"] - e["s"] - 1)
        ones = F.length(F.replace(between, F.lit("0"), F.lit("")))
        return (F.substr(mask, e["s"] + 1, F.lit(1)) == one) & (F.substr(mask, e["e"] + 1, F.lit(1)) == one) & (ones == inside)

    def merge(mask: Column, e: Column) -> Column:
        joined = F.concat(F.substr(mask, F.lit(1), e["s"] + 1), F.repeat(F.lit("0"), e["e"] - e["s"] - 1), F.substr(mask, e["e"] + 1))
        return F.when(free(mask, e, 1), joined).otherwise(mask)

    long = F.sort_array(F.filter(edges, lambda e: e["e"] - e["s"] > 1))
    masked = F.aggregate(long, F.repeat(one, n + 1), merge)

    def tokens(mask: Column) -> Column:
        chosen = F.filter(edges, lambda e: (e["id"] >= 0) & free(mask, e, 0))
        chosen = F.transform(chosen, lambda e: F.struct(e["s"].alias("s"), e["e"].alias("e"), F.array(e["id"]).alias("ids")))

        def whole(found: Column) -> Column:
            covered = F.aggregate(found, F.lit(0), lambda a, x: a + x["e"] - x["s"])
            bare = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.exists(found, lambda x: (x["s"] <= i) & (i < x["e"])))
            spelled = F.transform(bare, lambda i: F.struct(i.alias("s"), (i + 1).alias("e"), _bytes_of(unit, i, byte_base).alias("ids")))
            every = F.when(covered == n, found).otherwise(F.concat(found, spelled))
            return F.flatten(F.transform(F.sort_array(every), lambda x: x["ids"]))

        return _with(chosen, whole)

    return _with(masked, tokens)


def viterbi_fold(byte_base: int, unknown: float) -> Column:
    """Ids of a unit by the best sum of scores, then fewer pieces, then the shorter last piece.

    The state holds for each position the best (cost, pieces, start of the last piece, its ids).
    """
    unit = F.col("unit")
    n = F.length(unit)
    bare = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.exists("edges", lambda e: (e["s"] == i) & (e["e"] == i + 1)))
    known = F.transform(F.filter("edges", lambda e: e["id"] >= 0), lambda e: F.struct(e["s"].alias("s"), e["e"].alias("e"), e["cost"].alias("cost"), F.array(e["id"]).alias("ids")))
    spelled = F.transform(bare, lambda i: F.struct(i.alias("s"), (i + 1).alias("e"), F.lit(-unknown).alias("cost"), _bytes_of(unit, i, byte_base).alias("ids")))
    state = "struct<cost:double,n:int,s:int,ids:array<int>>"
    start = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("n"), F.lit(0).alias("s"), F.array().cast("array<int>").alias("ids")).cast(state)).otherwise(F.lit(None).cast(state)))

    def step(best: Column, e: Column) -> Column:
        before = F.get(best, e["s"])
        new = F.struct((before["cost"] + e["cost"]).alias("cost"), (before["n"] + F.size(e["ids"])).alias("n"), e["s"].alias("s"), e["ids"].alias("ids")).cast(state)

        def better(old: Column) -> Column:
            return old.isNull() | (new["cost"] < old["cost"]) | ((new["cost"] == old["cost"]) & (new["n"] < old["n"]))

        return F.when(before.isNull(), best).otherwise(F.transform(best, lambda old, i: F.when((i == e["e"]) & better(old), new).otherwise(old)))

    def back(best: Column) -> Column:
        walked = F.aggregate(
            F.sequence(F.lit(1), n),
            F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids")),
            lambda a, _: F.when(a["at"] <= 0, a).otherwise(F.struct(F.get(best, a["at"])["s"].alias("at"), F.concat(F.get(best, a["at"])["ids"], a["ids"]).alias("ids"))),
        )
        return walked["ids"]

    return _with(F.aggregate(F.sort_array(F.concat(known, spelled)), start, step), back)


def unit_ids(units: DataFrame, vocabulary: Pieces, model: str = "bpe") -> DataFrame:
    """(unit, ids) of distinct units. model: ``bpe`` or ``unigram``."""
    edges = lattice(units, piece_table(units.sparkSession, vocabulary), max(map(len, vocabulary.pieces)))
    fold = bpe_fold(vocabulary.byte_base) if model == "bpe" else viterbi_fold(vocabulary.byte_base, min(vocabulary.scores) - UNKNOWN_PENALTY)
    return edges.select("unit", fold.alias("ids"))


_tables: dict[int, tuple[Pieces, dict[str, tuple[int, float]]]] = {}


def _table(vocabulary: Pieces) -> dict[str, tuple[int, float]]:
    """(id, score) of each piece, made once for a vocabulary."""
    if id(vocabulary) not in _tables:
        pairs = zip(vocabulary.ids, vocabulary.scores, strict=True)
        _tables[id(vocabulary)] = (vocabulary, dict(zip(vocabulary.pieces, pairs, strict=True)))
    return _tables[id(vocabulary)][1]


def _spelled(parts: list[str], vocabulary: Pieces) -> list[int]:
    table = _table(vocabulary)
    return [i for p in parts for i in ([table[p][0]] if p in table else [vocabulary.byte_base + b for b in p.encode()])]


def merged(unit: str, vocabulary: Pieces) -> list[int]:
    """Ids of one long unit by merges, the best score first, then the leftmost: a heap over a linked list of symbols."""
    table, n = _table(vocabulary), len(unit)
    after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, int]] = []

    def offer(a: int) -> None:
        b = after[a] if a >= 0 else n
        if b < n and (found := table.get(unit[a : stop[b]])):
            heapq.heappush(heap, (-found[1], a, stop[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, end = heapq.heappop(heap)
        # A symbol that has gone has no end; one that has grown ends elsewhere.
        b = after[a]
        if not stop[a] or b >= n or stop[b] != end:
            continue
        stop[a], stop[b], after[a] = end, 0, after[b]
        if after[b] < n:
            before[after[b]] = a
        offer(before[a])
        offer(a)
    parts, a = [], 0
    while a < n:
        parts.append(unit[a : stop[a]])
        a = after[a]
    return _spelled(parts, vocabulary)


def best_path(unit: str, vocabulary: Pieces) -> list[int]:
    """Ids of one long unit by the best sum of scores, with the ties of ``viterbi_fold``."""
    table, unknown = _table(vocabulary), min(vocabulary.scores) - UNKNOWN_PENALTY
    longest = max(map(len, table))
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for e in range(1, len(unit) + 1):
        options = []
        for s in range(max(0, e - longest), e):
            if found := table.get(unit[s:e]):
                options.append((best[s][0] - found[1], best[s][1] + 1, s))
        if unit[e - 1] not in table:
            options.append((best[e - 1][0] - unknown, best[e - 1][1] + len(unit[e - 1].encode()), e - 1))
        best.append(min(options, key=lambda o: o[:2]))
    parts, e = [], len(unit)
    while e:
        parts.append(unit[best[e][2] : e])
        e = best[e][2]
    return _spelled(parts[::-1], vocabulary)


def _map_ids(docs: DataFrame, path: str, model: str, id: str, text: str, finish, schema: str) -> DataFrame:
    placed, vocabulary = located(docs, id, text), load_pieces(path)
    folder = resolve(placed, path, lambda units: unit_ids(units, vocabulary, model))
    alone = merged if model == "bpe" else best_path
    return row_values(placed, path, folder, lambda unit: alone(unit, load_pieces(path)), finish, schema)


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str, model: str = "bpe", id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id and its ids."""
    return _map_ids(docs, path, model, id, text, lambda ids, bounds: [_lists(ids, bounds)], "doc_id long, ids array<int>")


def decoder(vocabulary: Pieces):
    """A function from ids and n + 1 bounds to the texts' bytes and their n + 1 bounds."""
    sizes = np.array([len(x) for x in vocabulary.decoded], np.int64)
    flat = np.frombuffer(b"".join(vocabulary.decoded), np.uint8)
    first = np.cumsum(sizes) - sizes

    def decode(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = sizes[ids]
        stop = np.cumsum(n)
        out = flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(first[ids] - (stop - n), n)]
        rows = np.concatenate([[0], stop])[bounds]
        full = np.diff(rows) > 0
        return np.delete(out, rows[:-1][full]), rows - np.concatenate([[0], np.cumsum(full)])

    return decode


def _texts(out: np.ndarray, rows: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(rows) - 1, pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, ids and the text that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(load_pieces(path))
        for batch in batches:
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            out, rows = back(lists.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, _texts(out, rows)], names=["doc_id", "ids", "text"])

    return encoded.mapInArrow(run, "doc_id long, ids array<int>, text string")


@cache
def _decoder(path: str):
    return decoder(load_pieces(path))


def encode_decode(docs: DataFrame, path: str, model: str = "bpe", id: str = "doc_id", text: str = "text") -> DataFrame:
    """``decode(encode(docs))`` with n_pieces, in one pass over the texts."""

    def finish(ids: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        out, rows = _decoder(path)(ids, bounds)
        return [pa.array(np.diff(bounds)), _lists(ids, bounds), _texts(out, rows)]

    return _map_ids(docs, path, model, id, text, finish, "doc_id long, n_pieces long, ids array<int>, text string")


def encode_digest(docs: DataFrame, path: str, model: str = "bpe", id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document, of encoding and decoding it: n_pieces, ids_crc32 (of the ids as 32-bit little-endian integers) and
    text_sha256 of the decoded text."""

    def finish(ids: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        out, rows = _decoder(path)(ids, bounds)
        raw, text_ = ids.astype("<i4").tobytes(), out.tobytes()
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        shas = [hashlib.sha256(text_[a:b]).hexdigest() for a, b in zip(rows.tolist(), rows[1:].tolist())]
        return [pa.array(np.diff(bounds)), pa.array(crcs, pa.int64()), pa.array(shas, pa.string())]

    return _map_ids(docs, path, model, id, text, finish, "doc_id long, n_pieces long, ids_crc32 long, text_sha256 string")
