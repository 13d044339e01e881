"""Operational metrics over question logs, feedback and the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import grade
from ..rules import domain as D


def ts(value: str | Column) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, one decimal, exact halves up; null over an empty whole."""
    return F.when(whole > 0, F.round(part.cast("decimal(20,6)") * 100 / whole.cast("decimal(20,0)"), 1)).cast("double")


def volume_counts(audit: DataFrame, as_of) -> DataFrame:
    at, now = F.col("created_at"), ts(as_of)
    return audit.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(at >= F.date_trunc("day", now)).alias("queries_today"),
        F.count_if(at >= now - F.expr("interval 24 hours")).alias("queries_last_24h"),
        F.count_if(at >= now - F.expr("interval 1 hour")).alias("queries_last_hour"),
    )


def avg_latency(audit: DataFrame) -> DataFrame:
    mean = F.avg("response_time_ms")
    return audit.agg(
        F.coalesce(mean.cast("bigint"), F.lit(0)).alias("avg_response_time_ms"),
        F.round(mean, 0).alias("avg_response_time_rounded"),
    )


def latency_percentiles(audit: DataFrame, points=(0.5, 0.95)) -> DataFrame:
    """Exact interpolated percentiles, cut to whole milliseconds.

    Latencies are counted per value first, so the final state holds one entry
    per distinct millisecond and not one per row.
    """
    per_value = (
        audit.where(F.col("response_time_ms").isNotNull()).groupBy("response_time_ms").agg(F.count(F.lit(1)).alias("n"))
    )
    out = [
        F.coalesce(F.percentile("response_time_ms", F.lit(p), F.col("n")).cast("bigint"), F.lit(0)).alias(
            f"latency_p{int(p * 100)}_ms"
        )
        for p in points
    ]
    return per_value.agg(*out)


def satisfaction(feedback: DataFrame) -> DataFrame:
    pos, neg = F.count_if(F.col("is_positive")), F.count_if(~F.col("is_positive"))
    return feedback.agg(
        pos.alias("feedback_positive"), neg.alias("feedback_negative"), percent(pos, pos + neg).alias("satisfaction_rate")
    )


def confidence_distribution(meta: DataFrame) -> DataFrame:
    """Rows per level, and the mean score over all rows repeated on each.

    Both come from one grouped pass: the mean is rebuilt from the level sums.
    """
    per_level = meta.groupBy("confidence_level").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.sum(F.col("confidence_score").cast("decimal(20,6)")).alias("s"),
        F.count("confidence_score").alias("c"),
    )
    mean = per_level.agg(F.round(F.sum("s") / F.sum("c"), 3).cast("double").alias("avg_confidence_score"))
    # the right side is one row by construction
    return per_level.where(F.col("confidence_level").isNotNull()).select("confidence_level", "n_queries").join(
        F.broadcast(mean)
    )


def review_and_cache_rates(meta: DataFrame) -> DataFrame:
    hits = F.count_if(F.col("from_cache"))
    return meta.agg(
        F.count_if(F.col("needs_review")).alias("needs_review_count"),
        hits.alias("cache_hits"),
        F.coalesce(percent(hits, F.count(F.lit(1))), F.lit(0.0)).alias("cache_hit_rate"),
    )


def mode_distribution(meta: DataFrame) -> DataFrame:
    return meta.groupBy(F.coalesce("query_mode", F.lit("standard")).alias("query_mode")).agg(
        F.count(F.lit(1)).alias("n_queries")
    )


def top_topics(audit: DataFrame, n: int = 8) -> DataFrame:
    return (
        audit.where(F.col("topic").isNotNull())
        .groupBy("topic").agg(F.count(F.lit(1)).alias("n_queries"))
        .orderBy(F.desc("n_queries"), "topic").limit(n)
        .select(F.upper("topic").alias("topic"), "n_queries")
    )


def review_status(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("status").agg(F.count(F.lit(1)).alias("n_items"))


def _calendar(df: DataFrame, start: Column, stop: Column, step: str, fmt: str, name: str) -> DataFrame:
    """Every period of a fixed span; built from literals, not from the data or the clock."""
    return df.sparkSession.range(1).select(
        F.explode(F.sequence(start, stop, F.expr(f"interval {step}"))).alias("_t")
    ).select(F.date_format("_t", fmt).alias(name))


def daily_volume(audit: DataFrame, as_of, days: int = 14) -> DataFrame:
    now = ts(as_of)
    today = F.date_trunc("day", now)
    counts = (
        audit.where(F.col("created_at") >= now - F.expr(f"interval {days} days"))
        .groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    )
    cal = _calendar(audit, today - F.expr(f"interval {days - 1} days"), today, "1 day", "yyyy-MM-dd", "date")
    return cal.join(counts, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n_queries"))


def hourly_activity(audit: DataFrame, as_of, hours: int = 24) -> DataFrame:
    now = ts(as_of)
    this_hour = F.date_trunc("hour", now)
    fmt = "yyyy-MM-dd'T'HH:00"
    counts = (
        audit.where(F.col("created_at") >= now - F.expr(f"interval {hours} hours"))
        .groupBy(F.date_format("created_at", fmt).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    )
    cal = _calendar(audit, this_hour - F.expr(f"interval {hours - 1} hours"), this_hour, "1 hour", fmt, "hour")
    return cal.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n_queries"))


def feedback_trend(feedback: DataFrame, as_of, days: int = 7) -> DataFrame:
    now = ts(as_of)
    today = F.date_trunc("day", now)
    counts = (
        feedback.where(F.col("created_at") >= now - F.expr(f"interval {days} days"))
        .groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date"))
        .pivot("is_positive", [True, False]).agg(F.count(F.lit(1)))
    )
    cal = _calendar(feedback, today - F.expr(f"interval {days - 1} days"), today, "1 day", "yyyy-MM-dd", "date")
    return cal.join(counts, "date", "left").select(
        "date", F.coalesce("true", F.lit(0)).alias("positive"), F.coalesce("false", F.lit(0)).alias("negative")
    )


def recent_activity(audit: DataFrame, meta: DataFrame, n: int = 8) -> DataFrame:
    """Newest rows with their meta values; the limit is taken before the join."""
    newest = audit.orderBy(F.desc("created_at"), F.desc("audit_id")).limit(n)
    return newest.join(meta.select("audit_id", "confidence_level", "from_cache"), "audit_id", "left").select(
        "audit_id", F.left(F.coalesce("query", F.lit("")), F.lit(120)).alias("query"), "topic", "confidence_level",
        F.coalesce("response_time_ms", F.lit(0)).alias("response_time_ms"),
        F.coalesce("from_cache", F.lit(False)).alias("from_cache"), "created_at",
    )


def system_stats(users: DataFrame, corpus: DataFrame, chunks: DataFrame, audit: DataFrame, feedback: DataFrame) -> DataFrame:
    """Long table (metric, value) of entity counts."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
    by_status = corpus.groupBy("status").agg(F.count(F.lit(1)).alias("value")).select(
        F.concat(F.lit("documents_"), "status").alias("metric"), "value"
    )
    rated = feedback.groupBy("is_positive").agg(F.count(F.lit(1)).alias("value")).select(
        F.when(F.col("is_positive"), "feedback_positive").otherwise("feedback_negative").alias("metric"), "value"
    )
    return (
        count(users, "users").unionByName(by_status).unionByName(count(chunks, "chunks"))
        .unionByName(count(audit, "queries")).unionByName(rated)
    )


def corpus_completeness(corpus: DataFrame, chunk_counts: DataFrame, targets: dict = D.CORPUS_TARGETS) -> DataFrame:
    """Completed documents and chunks per type and in total against targets."""
    spark = corpus.sparkSession
    goal = spark.createDataFrame(
        [(k, d, c) for k, (d, c) in targets.items()], "doc_type string, target int, chunk_target int"
    )
    have = (
        corpus.where(F.col("status") == "completed")
        .join(chunk_counts, "document_id", "left")
        .groupBy("doc_type")
        .agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.coalesce("n_chunks", F.lit(0))).alias("n_chunks"))
    )
    per_type = goal.join(have, "doc_type", "left").na.fill(0, ["n_documents", "n_chunks"])
    grouped = per_type.rollup("doc_type").agg(
        *[F.sum(c).alias(c) for c in ("n_documents", "target", "n_chunks", "chunk_target")]
    )
    return grouped.select(
        F.coalesce("doc_type", F.lit("total")).alias("doc_type"), "n_documents", "target",
        F.greatest(F.lit(0), F.col("target") - F.col("n_documents")).alias("missing"), "n_chunks", "chunk_target",
        F.coalesce(percent(F.col("n_chunks"), F.col("chunk_target")), F.lit(0.0)).alias("completeness_pct"),
    )


def scrape_status_matrix(records: DataFrame, statuses=("new", "changed", "unchanged", "failed")) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    return records.groupBy("source_type").agg(*counts)


def crawl_run_summary(processed: DataFrame) -> DataFrame:
    """Totals of one crawl: each page carries its result and whether it is a retry."""
    r = F.col("result")
    return processed.agg(
        F.count(F.lit(1)).alias("total_scraped"),
        F.count_if(r == "new").alias("new_pages"),
        F.count_if(r == "changed").alias("changed_pages"),
        F.count_if(r == "unchanged").alias("unchanged_pages"),
        F.count_if(r == "failed").alias("failed_pages"),
        F.count_if(r.isin("new", "changed")).alias("ingestion_triggered"),
        F.count_if(F.col("is_retry")).alias("retried_urls"),
    )


def satisfaction_by_topic(feedback: DataFrame, audit: DataFrame) -> DataFrame:
    joined = feedback.select("audit_id", "is_positive").join(audit.select("audit_id", "topic"), "audit_id")
    pos, total = F.count_if(F.col("is_positive")), F.count(F.lit(1))
    return joined.groupBy(F.coalesce("topic", F.lit("unknown")).alias("topic")).agg(
        total.alias("total"), pos.alias("positive"), (total - pos).alias("negative"),
        percent(pos, total).alias("satisfaction_rate"),
    )


def low_satisfaction_alerts(by_topic: DataFrame, min_total: int = D.LOW_SATISFACTION[0], below: float = D.LOW_SATISFACTION[1]) -> DataFrame:
    return by_topic.where((F.col("total") >= min_total) & (F.col("satisfaction_rate") < below))


def recent_negative_queries(feedback: DataFrame, audit: DataFrame, n: int = 10) -> DataFrame:
    bad = feedback.where(~F.col("is_positive")).select("audit_id", "feedback_id")
    return (
        bad.join(audit.select("audit_id", "query", "topic", "created_at"), "audit_id")
        .orderBy(F.desc("created_at"), F.desc("feedback_id")).limit(n)
        .select("audit_id", F.left("query", F.lit(100)).alias("query"), "topic")
    )


def document_rollup(chunks: DataFrame) -> DataFrame:
    """Chunks per document and all cited references in chunk order, duplicates kept."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "cited_sections")))
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.flatten(F.transform(ordered, lambda x: x["cited_sections"])).alias("cited_sections"),
    )


def eval_rollup(scores: DataFrame, first_n: int | None = None) -> DataFrame:
    """Mean of the per-question scores, or of the first ``first_n``, and its grade band."""
    rows = scores.orderBy("item_id").limit(first_n) if first_n else scores
    mean = rows.agg(
        F.count(F.lit(1)).alias("num_questions"), F.avg(F.col("score").cast("decimal(20,6)")).cast("double").alias("m")
    )
    return mean.select("num_questions", F.round("m", 3).alias("average"), grade("m").alias("grade"))


def corpus_counts(corpus: DataFrame, users: DataFrame) -> DataFrame:
    s = F.col("status")
    docs = corpus.agg(
        F.count_if(s == "completed").alias("completed"), F.count_if(s.isin("processing", "pending")).alias("in_progress")
    )
    active = users.agg(F.count_if(F.col("is_active")).alias("active_users"))
    return docs.join(F.broadcast(active))  # one row each
