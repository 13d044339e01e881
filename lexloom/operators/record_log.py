"""Keyed records as a log of changes: a batch writes what it changed, readers merge.

A delta holds a batch's changed rows, in folders by a hash of the key. The state is the last row
of each key. Buckets with many deltas are compacted on their own: a base holds their state up to a
batch, older deltas of these buckets are no longer read, and no other bucket is touched. A batch
that is run again replaces its delta.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .kept import KeptFolder


class RecordLog(KeptFolder):
    """Log at ``path`` of rows with the columns of ``schema``, one of which is ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "url", buckets: int = 32):
        super().__init__(spark, path)
        self.schema, self.key, self.buckets = schema, key, buckets
        self._stored = StructType([*schema.fields, StructField("_bucket", IntegerType())])

    def _live(self) -> dict[tuple[str, int], str]:
        """(delta or base, batch) to its folder in use."""
        out: dict[tuple[str, int], str] = {}
        for s in self.segments():
            kind, batch, _ = s.split("-")
            out[kind, int(batch) - 1] = s  # names count from 0, batches from -1: the records before the first
        return out

    def batches(self) -> list[int]:
        return sorted(b for kind, b in self._live() if kind == "delta")

    def append(self, changed: DataFrame, batch: int) -> None:
        """Write the rows that ``batch`` changed."""
        self._write(self.new_segment(f"delta-{batch + 1}"), changed)

    def _write(self, segment: str, rows: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        out = rows.select(*self.schema.names).withColumn("_bucket", bucket)
        # few files a bucket, and a bucket of any size goes to as many tasks as it needs
        out.repartitionByRange("_bucket", self.key).write.partitionBy("_bucket").parquet(f"{self.path}/{segment}/rows")
        self.commit(segment)

    def _bases(self, before: int | None = None) -> dict[int, int]:
        """Per bucket, the batch that its newest base holds (of those up to the batch ``before``)."""
        out: dict[int, int] = {}
        for (kind, batch), s in sorted(self._live().items()):
            if kind == "base" and (before is None or batch < before):
                hit = [r._bucket for r in self._read(s).select("_bucket").distinct().collect()]  # from folder names
                out.update(dict.fromkeys(hit, batch))
        return out

    def _read(self, segment: str) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(f"{self.path}/{segment}/rows")

    def state(self, before: int | None = None) -> DataFrame:
        """The last row of each key, of all batches or of those before ``before``."""
        live, bases = self._live(), self._bases(before)
        parts = []
        for (kind, batch), s in sorted(live.items()):
            if before is not None and batch >= before:
                continue
            hidden = [b for b, upto in bases.items() if (batch <= upto if kind == "delta" else batch < upto)]
            rows = self._read(s)
            parts.append((rows.where(~F.col("_bucket").isin(hidden)) if hidden else rows).withColumn("_batch", F.lit(batch)))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        values = [c for c in self.schema.names if c != self.key]
        last = reduce(DataFrame.unionByName, parts).groupBy(self.key).agg(F.max_by(F.struct(*values), "_batch").alias("_v"))
        return last.select(self.key, "_v.*").select(*self.schema.names)

    def compact(self, least: int = 8) -> list[int]:
        """Rewrite the state of the buckets that have ``least`` deltas or more behind their base; returns these buckets."""
        live, bases = self._live(), self._bases()
        behind: dict[int, int] = {}
        for (kind, batch), s in live.items():
            if kind == "delta":
                for r in self._read(s).select("_bucket").distinct().collect():
                    behind[r._bucket] = behind.get(r._bucket, 0) + (batch > bases.get(r._bucket, -2))
        hit = sorted(b for b, n in behind.items() if n >= least)
        if hit:
            bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
            self._write(self.new_segment(f"base-{max(self.batches()) + 1}"), self.state().where(bucket.isin(hit)))
        return hit
