"""Two-sided work in groups of bounded size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_ROWS = 50_000


def bounded_grid(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_rows: int, meet, schema: str,
                 slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Apply ``meet`` (two Arrow tables to one) to every pair of a left block and a right slice.

    Both sides are hashed into blocks of about ``left_rows`` and ``slice_rows`` rows, so
    no group grows with the data; only their number does.
    """
    blocks = max(1, math.ceil(left.count() / max(1, left_rows)))
    slices = max(1, math.ceil(right.count() / slice_rows))
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("long")
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    a = left.withColumn("_lb", part(left_key, blocks)).withColumn("_rs", every(slices))
    b = right.withColumn("_rs", part(right_key, slices)).withColumn("_lb", every(blocks))
    return a.groupBy("_lb", "_rs").cogroup(b.groupBy("_lb", "_rs")).applyInArrow(meet, schema)
