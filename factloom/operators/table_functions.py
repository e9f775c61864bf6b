"""Table functions for SQL users: ``SELECT ... FROM outputs o, LATERAL claim_rows(o.output) c``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from factloom.functions import text as T


@udtf(returnType="pos int, sentence int, unit string")
class ClaimRows:
    """A row per claim unit of a text: its place, the place of its sentence and its words; none for null and empty texts."""

    def __init__(self) -> None:
        import regex

        # The patterns of ``functions.text``, which define the result; their white space is ASCII's, as on the JVM.
        self.sentence, self.unit, self.word = (regex.compile(p, regex.ASCII) for p in (T.SENTENCE_BREAK, T.UNIT_BREAK, "[A-Za-z]{2,}"))
        self.edges = regex.compile(rf"^[{T.SPACE_CHARS}]+|[{T.SPACE_CHARS}]+$")

    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        pos = 0
        sentences = (self.edges.sub("", s) for s in self.sentence.split(self.edges.sub("", text or "")))
        for k, sentence in enumerate(s for s in sentences if s):
            for piece in self.unit.split(sentence):
                unit = piece.strip(" ,")
                if unit and len(self.word.findall(unit)) >= 3:
                    yield pos, k, unit
                    pos += 1


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    spark.udtf.register("claim_rows", ClaimRows)
