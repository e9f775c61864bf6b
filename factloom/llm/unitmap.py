"""Tokenising whole corpora by their distinct units.

A unit is a stretch of a text that no vocabulary piece can cross: texts are cut between two characters wherever no
piece holds them side by side, so a text's tokens are those of its units, one after another. Documents are grouped
into blocks of ``BLOCK_ROWS`` rows of their file; each block gives its distinct units, the distinct units of all blocks
are resolved once, and every block gets a dictionary of its own units back, as a compressed file in the shared folder.
A task then needs the dictionary of the block at hand only, whatever the size of the corpus. A unit has at most one row
per block, so no key is hot. A unit of more than ``LONG_UNIT`` characters (a stretch of encoded data, say) is in no
dictionary: it is resolved where it stands, in a time that grows with its length. Units are known by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cleaning, doc_chunks, drop_staged, partitions, read_bytes, shared_dir, stage, string_bytes, trimmed, write_bytes
from factloom.llm.wordhash import mix

BLOCK_ROWS = 1 << 14
LONG_UNIT = 256
_CHUNK = 1 << 18
_U = np.uint64
SPACE = 0x2581


class Pieces(NamedTuple):
    """The ordinary pieces of a vocabulary with their ids and scores; id of the piece for byte 0; decoded bytes by id."""

    pieces: list[str]
    ids: list[int]
    scores: list[float]
    byte_base: int
    decoded: list[bytes]


@cache
def load_pieces(path: str) -> Pieces:
    """Read a model file of the sentencepiece library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ids, scores, decoded = [], [], [], []
    for i in range(len(model)):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            decoded.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            decoded.append(b"")
        else:
            pieces.append(piece)
            ids.append(i)
            scores.append(model.get_score(i))
            decoded.append(piece.replace(chr(SPACE), " ").encode())
    return Pieces(pieces, ids, scores, model.piece_to_id("<0x00>"), decoded)


class Cutter:
    """Cuts texts into units."""

    def __init__(self, pieces: list[str]) -> None:
        letters = sorted({c for p in pieces if len(p) > 1 for c in p})
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        number = {c: k + 1 for k, c in enumerate(letters)}
        for p in pieces:
            for a, b in zip(p, p[1:]):
                self.beside[number[a], number[b]] = True

    def points(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points with the space mark for blanks, one put before each row that isn't empty, and row offsets."""
        text = buf.tobytes().decode(errors="replace")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        count = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=count[1:])
        rows = count[offsets]
        full = np.diff(rows) > 0
        points = np.insert(np.where(points == 32, np.uint32(SPACE), points), rows[:-1][full], SPACE)
        return points, rows + np.concatenate([[0], np.cumsum(full)])

    def starts(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        kind = self.letter[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.beside[kind[:-1], kind[1:]]
        cut[rows[:-1][rows[:-1] < len(points)]] = True
        return np.flatnonzero(cut)


_tables: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def unit_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of stretches of code points."""
    if len(_tables[0]) < len(points) + 1:
        n = max(len(points) + 1, _CHUNK + 4096)
        for k, x in enumerate((0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64))):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            _tables[k] = np.multiply.accumulate(steps)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + _U(1)) * _tables[0][: len(points)], out=total[1:])
    return mix((total[ends] - total[starts]) * _tables[1][starts] + (ends - starts).astype(np.uint64))


@cache
def cutter(path: str) -> Cutter:
    return Cutter(load_pieces(path).pieces)


def located(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(block, id, text): the block follows from a row's place in its file. Rows that aren't read from files are
    staged first."""
    try:
        return _placed(docs, id, text)
    except AnalysisException:
        return _placed(stage(docs.select(F.col(id), F.col(text)), "units"), id, text)


def _placed(docs: DataFrame, id: str, text: str) -> DataFrame:
    block = F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / BLOCK_ROWS))
    out = docs.select(block.alias("block"), F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    out.schema  # noqa: B018  resolves the metadata columns
    return out


def _runs(blocks: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(blocks)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True)


def block_units(placed: DataFrame, path: str) -> DataFrame:
    """(block, unit): the distinct units of each block, once per task that reads a part of it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = cutter(path)
        now, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column(0).to_numpy()
            buf, offsets = string_bytes(batch.column(2))
            for a, b in _runs(blocks):
                if blocks[a] != now:
                    now, known = blocks[a], np.zeros(0, np.uint64)
                for i, j in doc_chunks(offsets[a : b + 1], _CHUNK):
                    part = offsets[a + i : a + j + 1]
                    points, rows = cuts.points(buf[part[0] : part[-1]], part - part[0])
                    if not len(points):
                        continue
                    starts = cuts.starts(points, rows)
                    ends = np.append(starts[1:], len(points))
                    short = ends - starts <= LONG_UNIT
                    starts, ends = starts[short], ends[short]
                    keys, where = np.unique(unit_keys(points, starts, ends), return_index=True)
                    at = np.searchsorted(known, keys)
                    new = known[np.minimum(at, len(known) - 1)] != keys if len(known) else np.ones(len(keys), bool)
                    known = np.insert(known, at[new], keys[new])
                    s, e = starts[where[new]], ends[where[new]]
                    text = points.tobytes().decode("utf-32-le")
                    units = [text[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(units), now, np.int64)), pa.array(units, pa.string())], names=["block", "unit"])

    return placed.select("block", "id", "text").mapInArrow(trimmed(cut), "block long, unit string")


def resolve(placed: DataFrame, path: str, answer: Callable[[DataFrame], DataFrame]) -> str:
    """Answer all distinct units and write each block's dictionary; returns the folder.

    answer: from (unit), distinct and so dealt out by unit, to (unit, ids array<int>), one row for each.
    """
    folder = shared_dir(placed.sparkSession, "dictionaries")
    pairs = stage(block_units(placed, path), "units", "zstd")
    # A unit stands once in a block, so few would be merged before the shuffle.
    answered = answer(pairs.select("unit").repartition(partitions(placed.sparkSession), "unit").distinct())
    given = pairs.join(answered, "unit").select("block", "unit", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> list[int]:
            if not held:
                return []
            keys = np.concatenate([k for k, _ in held])
            ids = pa.concat_arrays([x for _, x in held])
            keys, first = np.unique(keys, return_index=True)
            ids = ids.take(pa.array(first))
            values, lengths = ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())
            narrow = lambda x: x.astype(np.uint16) if not len(x) or int(x.max()) < 1 << 16 and int(x.min()) >= 0 else x
            sink = pa.BufferOutputStream()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(narrow(values)))
            table = pa.RecordBatch.from_arrays([pa.array(keys), lists], names=["key", "ids"])
            with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(table)
            write_bytes(_dictionary_uri(folder, now), sink.getvalue())
            held.clear()
            return [now]

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for a, b in _runs(blocks) if len(blocks) else ():
                if blocks[a] != now:
                    close()
                    now = int(blocks[a])
                buf, offsets = string_bytes(batch.column(1).slice(a, b - a))
                text = buf.tobytes().decode()
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                count = np.zeros(len(buf) + 1, np.int64)
                np.cumsum((buf & 0xC0) != 0x80, out=count[1:])
                rows = count[offsets]
                held.append((unit_keys(points, rows[:-1], rows[1:]), batch.column(2).slice(a, b - a).cast(pa.list_(pa.int32()))))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["block"])

    with cleaning(placed.sparkSession):
        given.repartition("block").sortWithinPartitions("block").mapInArrow(trimmed(write), "block long").write.format("noop").mode("overwrite").save()
    drop_staged(pairs)
    return folder


def _dictionary_uri(folder: str, block: int) -> str:
    return f"{folder}/{block & (1 << 64) - 1:016x}.arrow"


class Dictionary:
    def __init__(self, uri: str) -> None:
        table = pa.ipc.open_file(pa.BufferReader(read_bytes(uri))).read_all().combine_chunks()
        self.keys = table.column("key").to_numpy()
        lists = table.column("ids").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.values, self.offsets = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)

    def spans(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        if len(keys) and (not len(self.keys) or (at >= len(self.keys)).any() or (self.keys[np.minimum(at, len(self.keys) - 1)] != keys).any()):
            raise KeyError("a unit is missing from its block's dictionary")
        return self.offsets[at], self.offsets[at + 1] - self.offsets[at]


def row_values(placed: DataFrame, path: str, folder: str, long_unit: Callable[[str], list[int]], finish: Callable, schema: str) -> DataFrame:
    """Per row what ``finish(ids, bounds)`` makes of the values of its units, one after another.

    long_unit: the values of a unit that is in no dictionary. finish gets, for some rows, all values in order and n + 1
    bounds, and returns a list of Arrow arrays, which follow the id in ``schema``.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def spans(known: Dictionary | None, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, where those of each unit begin, how many they are)"""
        at, sizes = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = ends - starts <= LONG_UNIT
        values = [np.zeros(0, np.int32)] if known is None else [known.values]
        if known is not None:
            keys, back = np.unique(unit_keys(points, starts[short], ends[short]), return_inverse=True)
            at[short], sizes[short] = (x[back] for x in known.spans(keys))
        n = len(values[0])
        for k in np.flatnonzero(~short).tolist():
            values.append(np.array(long_unit(points[starts[k] : ends[k]].tobytes().decode("utf-32-le")), np.int32))
            at[k], sizes[k] = n, len(values[-1])
            n += sizes[k]
        return np.concatenate(values) if len(values) > 1 else values[0], at, sizes

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, now, known = cutter(path), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column(0).to_numpy()
            buf, offsets = string_bytes(batch.column(2))
            for a, b in _runs(blocks):
                for i, j in doc_chunks(offsets[a : b + 1], _CHUNK):
                    part = offsets[a + i : a + j + 1]
                    points, rows = cuts.points(buf[part[0] : part[-1]], part - part[0])
                    values, bounds = np.zeros(0, np.int32), np.zeros(j - i + 1, np.int64)
                    if len(points):
                        starts = cuts.starts(points, rows)
                        ends = np.append(starts[1:], len(points))
                        if blocks[a] != now and (ends - starts <= LONG_UNIT).any():
                            now, known = blocks[a], Dictionary(_dictionary_uri(folder, int(blocks[a])))
                        values, at, sizes = spans(known if blocks[a] == now else None, points, starts, ends)
                        stop = np.cumsum(sizes)
                        values = values[np.arange(stop[-1]) + np.repeat(at - (stop - sizes), sizes)]
                        bounds = np.concatenate([[0], stop])[np.searchsorted(starts, rows)]
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(a + i, j - i), *finish(values, bounds)], names=names)

    return placed.select("block", "id", "text").mapInArrow(trimmed(apply), schema)
