"""Streaming jobs, run over everything available and checked against batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.topics import session_topic
from ..operators import metrics as M
from ..rules import sample as X
from ..streaming import jobs as J
from .analytics import stamp, stamp_sql
from .conversation import over_history
from .corpus import with_crawl
from .registry import ORACLES, query
from .views import AS_OF, VIEWS, check, view


def _events(spark, sf):
    schema = view(spark, sf, "events").schema
    return J.read_stream(spark, sf, "events.parquet", schema).withColumn("created_at", F.col("ts").cast("timestamp"))


@query("stream_volume", check("""
    select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n_queries from {events} group by 1"""))
def stream_volume(spark, sf):
    out = J.latest(J.run_to_updates(J.volume(_events(spark, sf)), "volume"), ["start"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n_queries")


@query("stream_rate_limit", ORACLES["rate_limit_violations"])
def stream_rate_limit(spark, sf):
    out = J.run_to_table(J.rate_limit(_events(spark, sf), ["event_type", "user_id"], "created_at", 1, 21_600), "limit")
    return out.groupBy("event_type", "user_id", "second").agg(F.max("n_seconds").alias("n_seconds"))


@query("stream_cache_ttl", check("""
    with recursive e as (select event_type || user_id as cache_key, cast(epoch_us(ts) as bigint) as us from {events}),
    m as (select cache_key, min(us) as computed_us from e group by 1
          union all
          select cache_key, nxt from (select m.cache_key, (select min(us) from e where e.cache_key = m.cache_key and e.us >= m.computed_us + 86400000000) as nxt
                                      from m) where nxt is not null)
    select cache_key, computed_us from m"""))
def stream_cache_ttl(spark, sf):
    calls = _events(spark, sf).withColumn("cache_key", F.concat("event_type", F.col("user_id").cast("string")))
    return J.run_to_table(J.cache_misses(calls, "cache_key", "created_at", 86_400), "cache")


@query("stream_session_state", over_history(
    " select session_id as conv_id, turn, turn_count, last_query, last_topic, history_text from h"))
def stream_session_state(spark, sf):
    schema = view(spark, sf, "conversations").schema
    turns = J.read_stream(spark, sf, "conversations.parquet", schema).withColumn("topic", session_topic("text", X.TOPICS, ""))
    return J.run_to_table(J.session_memory(turns), "sessions")


@query("stream_changes", with_crawl(" select page_id, url, result, title from results"))
def stream_changes(spark, sf):
    at = M.ts("2024-01-01 00:00:00")
    prev = view(spark, sf, "crawl_prev").select(
        "url", "content_hash", F.lit("old").alias("source_type"), F.lit("LAW").alias("doc_type"), F.lit("t").alias("title"), "status",
        F.lit(None).cast("string").alias("error_message"), at.alias("last_scraped_at"), at.alias("last_changed_at"), "scrape_count")
    split = F.col("url").contains("page=")
    pages = J.read_stream(spark, sf, "pages.parquet", view(spark, sf, "pages").schema).select(
        "page_id", "url", F.when(F.col("url").like("https%"), "uscis_news").otherwise("bia").alias("source_type"), F.lit("LAW").alias("doc_type"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.when(~split & ~F.col("url").contains("#"), F.col("html")).alias("content"), F.when(split, F.col("html")).alias("clean_text"))
    return J.crawl_changes(pages, prev, M.ts(AS_OF))[0]


@query("stream_review_queue", check(f"select audit_id, 'pending' as status, {stamp_sql()} from {{query_meta}} where needs_review"))
def stream_review_queue(spark, sf):
    events = J.read_stream(spark, sf, "events.parquet", view(spark, sf, "events").schema)
    answers = spark.sql(VIEWS["query_meta"], events=events)
    return J.run_to_table(J.review_queue(answers), "reviews").withColumn("created_at", stamp())
