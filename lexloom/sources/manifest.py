"""The list of chapter URLs a crawl should cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import domain as D


def expand(parts: DataFrame, prefix: str = D.CHAPTER_URL_PREFIX) -> DataFrame:
    """One URL per chapter of (volume, part, n_chapters)."""
    chapters = parts.select("volume", "part", F.explode(F.sequence(F.lit(1), F.col("n_chapters").cast("int"))).alias("chapter"))
    return chapters.select(
        F.concat(
            F.lit(prefix), F.col("volume").cast("string"), F.lit("-part-"), F.col("part"), F.lit("-chapter-"),
            F.col("chapter").cast("string"),
        ).alias("url")
    )


def union(*urls: DataFrame) -> DataFrame:
    out = urls[0]
    for u in urls[1:]:
        out = out.unionByName(u)
    return out.distinct()


def difference(known: DataFrame, done: DataFrame) -> DataFrame:
    return known.select("url").subtract(done.select("url"))
