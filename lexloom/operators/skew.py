"""Ranking and look-back that never put a whole hot key into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import materialise


def split_rank(df: DataFrame, keys: list[str], order: list, bucket: Column, name: str) -> DataFrame:
    """1-based rank of each row within ``keys``.

    ``bucket`` must grow with ``order`` (a day, a block of ids). Rows are sorted
    only within (keys, bucket); a small table of bucket counts supplies how many
    rows come before. A key holding a third of all rows is thus spread over
    its buckets. Rows whose keys are null form a group of their own.
    """
    b = df.withColumn("_bucket", bucket)
    counts = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    group = [*keys, "_bucket"]
    offsets = counts.select(*[F.col(k).alias(f"_o_{k}") for k in group], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_o_{k}")), group[1:], F.col(group[0]).eqNullSafe(F.col(f"_o_{group[0]}")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        b.withColumn("_local", F.row_number().over(inside))
        .join(offsets, same)
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_bucket", "_local", "_before", *[f"_o_{k}" for k in group])
    )


def arrival_bucket(df: DataFrame, order: str, width: int, buckets: int = 256) -> Column:
    """Bucket that grows with the order column: blocks of numbers, or ranges of text ids.

    Ranges of other ids lie between values of the column itself, chosen evenly from a
    bounded sample, so ids that begin alike are spread too. The choice moves rows
    between buckets only; ranks do not depend on it. Null comes before all values.
    """
    if isinstance(df.schema[order].dataType, NumericType):
        return F.floor(F.col(order) / width)
    ids = df.select(F.col(order).alias("_id")).where("_id is not null")
    seen = sorted(r._id for r in ids.orderBy(F.rand(7)).limit(16 * buckets).collect())  # each task keeps that many rows at most
    step = max(1, -(-len(seen) // buckets))
    return _range_of(F.col(order), sorted(set(seen[step::step])), 1)


def _range_of(c: Column, bounds: list, first: int) -> Column:
    """Number of the range of ``c``: ``first`` plus how many bounds it has reached, by halving; 0 for null."""
    if not bounds:
        return F.when(c.isNull(), 0).otherwise(first)
    half = len(bounds) // 2
    below, above = _range_of(c, bounds[:half], first), _range_of(c, bounds[half + 1 :], first + half + 1)
    return F.when(c < F.lit(bounds[half]), below).when(c.isNull(), 0).otherwise(above)


def lookback_blocks(df: DataFrame, rank: str, lookback: int, block: int = 10_000) -> DataFrame:
    """Cut ranked groups into blocks and repeat the last ``lookback`` rows in the next block.

    Adds ``_block`` and ``_context`` (true for repeated rows). Windows over
    (keys, _block) that look at most ``lookback`` rows back are then exact for
    rows that are not context, and no window partition exceeds block + lookback.
    """
    zero = F.col(rank) - 1
    own = F.floor(zero / block)
    tail = (zero % block) >= (block - lookback)
    copies = F.array(
        F.struct(own.alias("b"), F.lit(False).alias("c")),
        F.struct(F.when(tail, own + 1).alias("b"), F.lit(True).alias("c")),
    )
    return (
        df.withColumn("_copy", F.explode(F.filter(copies, lambda x: x["b"].isNotNull())))
        .withColumn("_block", F.col("_copy.b"))
        .withColumn("_context", F.col("_copy.c"))
        .drop("_copy")
    )


def spread_left_join(left: DataFrame, right: DataFrame, key: str, by: Column, most: int = 200_000) -> DataFrame:
    """Left join on ``key`` that deals the left rows of a frequent key over several tasks.

    Keys of more than ``most`` left rows are counted, null included, and stored; there are at most
    rows / ``most`` of them. Their left rows fall into parts by a hash of ``by``, their right rows
    are repeated for each part, so every left row meets the same right rows as before.
    """
    counts = left.groupBy(F.col(key).alias("_often")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    often = F.broadcast(materialise(counts.select("_often", F.ceil(F.col("_n") / most).cast("int").alias("_parts")), "frequent-keys"))
    dealt = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).otherwise(0)
    copies = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    rows = left.join(often, F.col(key).eqNullSafe(F.col("_often")), "left").withColumn("_part", dealt).drop("_often", "_parts")
    found = right.join(often, F.col(key) == F.col("_often"), "left").withColumn("_part", F.explode(copies)).drop("_often", "_parts")
    return rows.join(found, [key, "_part"], "left").drop("_part")


def first_per_key(df: DataFrame, keys: list[str], order: list, n: int = 1, name: str = "_rn", keep: bool = False) -> DataFrame:
    """The first ``n`` rows per key.

    ``row_number() <= n`` is cut per task before the exchange (window group
    limit), so a hot key sends at most ``n`` rows from each task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if keep else out.drop(name)


def one_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key where keys hardly ever repeat: only rows of repeated keys move.

    The repeated keys are found from the keys alone and stored, so their size is known when
    the rows are split by them. Rows with a null key stay.
    """
    often = materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys), "repeated-keys")
    return df.join(often, keys, "left_anti").unionByName(first_per_key(df.join(often, keys, "left_semi"), keys, order))
