"""Token counts of documents under a unigram piece model, by dynamic programming shared along a trie.

The distinct units of the corpus (see ``unitmap``) are dealt out by range and sorted, so the trie of a partition is
walked depth first: what two neighbours share is one path, whose forward scores (best sum of scores and its number of
pieces, for every prefix) are computed once and kept while it is open. Only the open path is held. The count of a unit
is that of its last node; a document's count is the sum over its units.

A piece scores what its model file says; a character without a piece costs its UTF-8 bytes as tokens and scores 10 less
than the worst piece. Ties go to fewer tokens. Defined results: null and empty texts have no tokens; repeated ids keep
a row each; an empty table gives an empty result; texts are whole whatever their length; other columns are not looked
at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import partitions
from factloom.llm.unitmap import Pieces, load_pieces, located, resolve, row_values

UNKNOWN_PENALTY = 10.0


class TrieWalk:
    """Counts of units given in sorted order; ``steps`` counts the nodes computed."""

    def __init__(self, vocabulary: Pieces) -> None:
        self.scores = dict(zip(vocabulary.pieces, vocabulary.scores, strict=True))
        self.longest = max(map(len, self.scores))
        self.unknown = min(vocabulary.scores) - UNKNOWN_PENALTY
        self.last = ""
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]
        self.steps = 0

    def __call__(self, unit: str) -> int:
        shared = len(os.path.commonprefix((self.last, unit)))
        best, count, scores = self.best, self.count, self.scores
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(unit) + 1):
            top, least = None, 0
            for start in range(max(0, end - self.longest), end):
                score = scores.get(unit[start:end])
                if score is None:
                    continue
                score += best[start]
                if top is None or score > top or (score == top and count[start] + 1 < least):
                    top, least = score, count[start] + 1
            if unit[end - 1] not in scores:
                score, n = best[end - 1] + self.unknown, count[end - 1] + len(unit[end - 1].encode())
                if top is None or score > top or (score == top and n < least):
                    top, least = score, n
            best.append(top)
            count.append(least)
        self.steps += len(unit) - shared
        self.last = unit
        return count[-1]


def unit_counts(units: DataFrame, path: str) -> DataFrame:
    """(unit, ids) with the one count of each distinct unit."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TrieWalk(load_pieces(path))
        for batch in batches:
            counts = np.array([trie(u) for u in batch.column(0).to_pylist()], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1), pa.int32()), pa.array(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["unit", "ids"])

    # Ranges keep neighbours together, however many partitions there are.
    return units.repartitionByRange(partitions(units.sparkSession), "unit").sortWithinPartitions("unit").mapInArrow(walk, "unit string, ids array<int>")


def count_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens and n_units."""
    placed = located(docs, id, text)
    folder = resolve(placed, path, lambda units: unit_counts(units, path))

    def finish(values: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])[bounds]
        return [pa.array(np.diff(total)), pa.array(np.diff(bounds))]

    return row_values(placed, path, folder, lambda unit: [TrieWalk(load_pieces(path))(unit)], finish, "doc_id long, n_tokens long, n_units long").select("doc_id", F.col("n_tokens"), F.col("n_units"))
