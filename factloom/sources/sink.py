"""A sink of JSON lines that takes batches whole and once.

A batch is written to a folder of its own and counts from the moment when an entry that names the folder stands in the log.
Entries are numbered, and one is published by a rename that fails if the number is taken: a writer that loses looks at what
came in between and tries again, so keys stay unique whoever writes. What a failed or repeated batch leaves is named by no
entry and is read by nobody.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.sources import files

LOG, DATA = "_log", "data"


class Sink:
    """Batches of rows of ``schema`` below ``path``; ``key`` is unique over all of them."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id") -> None:
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def entries(self) -> list[dict]:
        """What is published: one entry per batch, in order."""
        folder = files.join(self.path, LOG)
        found = [n for n in files.names(self.spark, folder) if n.endswith(".json") and n[0].isdigit()]
        return [json.loads(files.read_text(self.spark, files.join(folder, n))) for n in found]

    def read(self, entries: list[dict] | None = None) -> DataFrame:
        """All published rows."""
        folders = [files.join(self.path, DATA, e["folder"]) for e in (self.entries() if entries is None else entries)]
        return self.spark.read.schema(self.schema).json(folders) if folders else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, batch: str | None = None) -> int:
        """Publish the rows whose key is new, one per key; returns how many. A batch that is published already adds nothing."""
        batch = batch or uuid.uuid4().hex
        while True:
            entries = self.entries()
            if any(e["batch"] == batch for e in entries):
                return 0
            folder = f"{len(entries):010d}-{uuid.uuid4().hex}"
            where = files.join(self.path, DATA, folder)
            new = rows.dropDuplicates([self.key]).join(self.read(entries).select(self.key).distinct(), self.key, "left_anti")
            new.write.json(where)
            n = self.spark.read.schema(self.schema).json(where).count()
            if self._publish(len(entries), {"batch": batch, "folder": folder, "rows": n}):
                return n
            files.delete(self.spark, where)

    def _publish(self, number: int, entry: dict) -> bool:
        return files.write_text(self.spark, files.join(self.path, LOG, f"{number:010d}.json"), json.dumps(entry), replace=False)
