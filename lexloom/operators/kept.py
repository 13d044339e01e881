"""Index folders that grow by committed segments.

A segment is a folder with the parts of one write. It counts once its name stands in the
list of segments, which is written last, so a job that dies leaves nothing that is read and
can be run again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeptFolder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def segments(self) -> list[str]:
        """Names of the committed segments in their order: one for each write."""
        try:
            rows = self.spark.read.schema("at long, segment string").parquet(f"{self.path}/segments").orderBy("at", "segment").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return [r.segment for r in rows]

    def part(self, name: str, among: list[str] | None = None) -> DataFrame | None:
        """One part of all segments that have it (those of ``among``, named ``<kind>-...``); None without any."""
        tables = [t for t in (self._table(f"{self.path}/{s}/{name}") for s in (self.segments() if among is None else among)) if t is not None]
        return reduce(DataFrame.unionByName, tables) if tables else None

    def _table(self, folder: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(folder)
        except Exception as e:
            if "UNABLE_TO_INFER_SCHEMA" in str(e):  # no rows, no files
                return None
            raise

    def new_segment(self, kind: str = "segment") -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def commit(self, segment: str) -> None:
        n = len(self.segments())
        self.spark.range(1).select(F.lit(n).cast("long").alias("at"), F.lit(segment).alias("segment")).coalesce(1).write.mode("append").parquet(f"{self.path}/segments")
