"""Change detection and the crawl record snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..rules import domain as D
from .skew import arrival_bucket, first_per_key, lookback_blocks, split_rank

RECORD_COLUMNS = [
    "url", "content_hash", "source_type", "doc_type", "title", "status", "error_message",
    "last_scraped_at", "last_changed_at", "scrape_count",
]


def detect_changes(pages: DataFrame, previous: DataFrame, order: str = "page_id", width: int = 100_000,
                   block: int = 10_000) -> DataFrame:
    """new / changed / unchanged per fetched page.

    A page fetched again in the same batch is compared with its fetch before;
    the first fetch is compared with the snapshot. An equal hash after a failed
    run counts as changed. A URL that fills a third of the batch is cut into blocks.
    """
    hashed = pages.withColumn("new_hash", content_hash("content"))
    slim = hashed.select("url", order, "new_hash")
    ranked = split_rank(slim, ["url"], [order], arrival_bucket(slim, order, width), "_rank")
    blocks = lookback_blocks(ranked, "_rank", 1, block)
    w = Window.partitionBy("url", "_block").orderBy("_rank")
    chained = blocks.withColumn("_before", F.lag("new_hash").over(w)).where(~F.col("_context"))
    snapshot = previous.select("url", F.col("content_hash").alias("_old"), F.col("status").alias("_status"))
    old = F.when(F.col("_rank") > 1, F.col("_before")).otherwise(F.col("_old"))
    failed_before = (F.col("_rank") == 1) & (F.col("_status") == "failed")
    kind = (
        F.when(old.isNull(), "new")
        .when((old == F.col("new_hash")) & ~F.coalesce(failed_before, F.lit(False)), "unchanged")
        .otherwise("changed")
    )
    return chained.join(snapshot, "url", "left").select(
        "url", order, kind.alias("change_type"), old.alias("old_hash"), "new_hash",
        (kind != "unchanged").alias("should_process"),
    )


def upsert_records(previous: DataFrame, results: DataFrame, at: Column, order: str = "page_id") -> DataFrame:
    """Record snapshot after a batch of results.

    ``results`` has one row per fetch: url, content_hash, source_type, doc_type,
    title, status, error_message and the order column. The last fetch supplies the
    values, the count grows by the number of fetches, and the change time moves
    only if a hash differs from the one before.
    """
    values = [c for c in RECORD_COLUMNS if c in results.columns and c != "url"]
    arrived = results.groupBy("url").agg(
        F.max_by(F.struct(*values), F.col(order)).alias("_last"),
        F.min_by("content_hash", F.col(order)).alias("_first_hash"),
        F.count(F.lit(1)).alias("_n"),
        F.min("content_hash").alias("_lo"), F.max("content_hash").alias("_hi"),
    )
    p = previous.select("url", *[F.col(c).alias(f"_p_{c}") for c in RECORD_COLUMNS if c != "url"])
    seen, came = F.col("_p_content_hash").isNotNull(), F.col("_n").isNotNull()
    moved = (F.col("_first_hash") != F.col("_p_content_hash")) | (F.col("_lo") != F.col("_hi"))
    fill = {
        "last_scraped_at": F.when(came, at).otherwise(F.col("_p_last_scraped_at")),
        "last_changed_at": F.when(came & (~seen | moved), at).otherwise(F.col("_p_last_changed_at")),
        "scrape_count": (F.coalesce("_p_scrape_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int"),
    }
    for c in values:
        fill[c] = F.when(came, F.col(f"_last.{c}")).otherwise(F.col(f"_p_{c}"))
    return p.join(arrived, "url", "full").select("url", *[fill[c].alias(c) for c in RECORD_COLUMNS if c != "url"])


def failure_results(urls: DataFrame, source_type: str, doc_type: str, message: str = D.SCRAPE_FAILURE_MESSAGE,
                    order: str = "page_id") -> DataFrame:
    """Result rows for pages that could not be fetched: empty hash, last path part as title."""
    return urls.select(
        "url", order, F.lit("").alias("content_hash"), F.lit(source_type).alias("source_type"),
        F.lit(doc_type).alias("doc_type"), F.substring_index("url", "/", -1).alias("title"),
        F.lit("failed").alias("status"), F.lit(message).alias("error_message"),
    )


def missing_urls(manifest: DataFrame, discovered: DataFrame, records: DataFrame) -> DataFrame:
    """Known URLs without a successful record, sorted."""
    done = records.where(F.col("status").isin("new", "changed", "unchanged")).select("url")
    known = manifest.select("url").union(discovered.select("url")).distinct()
    return known.join(done, "url", "left_anti").orderBy("url")


def assign_versions(arrivals: DataFrame, existing: DataFrame | None = None, order: str = "document_id",
                    width: int = 100_000) -> DataFrame:
    """Next version per (filename, doc_type), in arrival order, on top of stored versions."""
    keys = ["filename", "doc_type"]
    ranked = split_rank(arrivals, keys, [order], arrival_bucket(arrivals, order, width), "_rank")
    if existing is None:
        return ranked.withColumnRenamed("_rank", "version")
    base = existing.groupBy(*keys).agg(F.max("version").alias("_base"))
    return ranked.join(base, keys, "left").withColumn(
        "version", F.col("_rank") + F.coalesce("_base", F.lit(0))
    ).drop("_rank", "_base")


def mark_latest(versioned: DataFrame, keys=("filename",)) -> DataFrame:
    """Adds ``is_latest``; the maximum is aggregated first, so a hot file name stays spread out."""
    keys = list(keys)
    top = versioned.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max("version").alias("_top"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return versioned.join(top, same).withColumn("is_latest", F.col("version") == F.col("_top")).drop("_top", *[f"_k_{k}" for k in keys])


def dedupe_by_id(df: DataFrame, key: str, order: list) -> DataFrame:
    """First occurrence per id; rows without an id are dropped."""
    return first_per_key(df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != ""), [key], order)
