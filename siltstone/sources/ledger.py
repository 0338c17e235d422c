"""A table that numbered batches write, each exactly once.

A batch writes its rows as a part of its own and then a commit of one row that names the part.  Only committed parts are
read, so a batch that broke off leaves nothing to see, and one that comes again finds its commit and writes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_COMMIT = "batch long, part string, whole boolean"


class Ledger:
    """Parts under `path`, a folder that driver and executors share; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def commits(self) -> list:
        """All commits (batch, part, whole) in the order of their batches."""
        try:
            return sorted(self.spark.read.schema(_COMMIT).option("recursiveFileLookup", True).parquet(f"{self.path}/commits").collect())
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def has(self, batch: int) -> bool:
        return any(c.batch == batch for c in self.commits())

    def append(self, batch: int, rows: DataFrame, whole: bool = False) -> bool:
        """Commits the rows as this batch, unless it was committed before.  `whole`: they stand for all earlier batches too."""
        if self.has(batch):
            return False
        part = f"{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/parts/{part}")
        # what a broken-off commit may have left has no row, and is replaced
        self.spark.createDataFrame([(batch, part, whole)], _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch}")
        return True

    def read(self, batch: int | None = None) -> DataFrame:
        """The rows of all committed batches, or of one."""
        found = [c for c in self.commits() if batch is None or c.batch == batch]
        last = max((n for n, c in enumerate(found) if c.whole), default=0)
        parts = [f"{self.path}/parts/{c.part}" for c in found[last:]]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
