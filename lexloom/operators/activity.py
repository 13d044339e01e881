"""History, listings, alerts, reviews, invites and access checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..rules import domain as D
from .skew import first_per_key, spread_left_join


def owned_by(df: DataFrame, user_id) -> DataFrame:
    return df.where(F.col("user_id") == user_id)


def audit_with_meta(audit: DataFrame, meta: DataFrame) -> DataFrame:
    """Each audit row with its meta values, where it has any."""
    extra = [c for c in meta.columns if c not in audit.columns]
    return audit.join(meta.select("audit_id", *extra), "audit_id", "left")


def history_by_matter(audit: DataFrame, meta: DataFrame, matter_id=None) -> DataFrame:
    """Rows linked to a matter; the predicate on the meta side turns the join into an inner one."""
    rows = audit_with_meta(audit, meta)
    cond = F.col("matter_id") == matter_id if matter_id is not None else F.col("matter_id").isNotNull()
    return rows.where(cond)


def query_history(audit: DataFrame, meta: DataFrame, n: int = 30, matter_only: bool = False) -> DataFrame:
    """Each user's newest ``n`` questions with a preview of the answer."""
    rows = history_by_matter(audit, meta) if matter_only else audit
    newest = first_per_key(rows, ["user_id"], [F.desc("created_at"), F.desc("audit_id")], n)
    if not matter_only:
        newest = audit_with_meta(newest, meta)
    return newest.select(
        "user_id", "audit_id", "query", F.left(F.coalesce("answer", F.lit("")), F.lit(200)).alias("answer_preview"),
        "topic", "response_time_ms", "confidence_level", "matter_id", "created_at",
    )


def json_list(c) -> Column:
    """Decode a JSON list of strings; missing or broken means empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def history_detail(audit: DataFrame, meta: DataFrame, lists=("next_steps", "risks", "related_forms")) -> DataFrame:
    rows = audit_with_meta(audit, meta)
    return rows.select(
        "audit_id", "query", "answer", "topic", "response_time_ms", "confidence_score", "confidence_level",
        *[json_list(c).alias(c) for c in lists], "created_at",
    )


def audit_log_preview(audit: DataFrame, n: int = 50) -> DataFrame:
    q = F.col("query")
    return (
        audit.orderBy(F.desc("created_at"), F.desc("audit_id")).limit(n)
        .withColumn("query", F.when(F.length(q) > 100, F.concat(F.left(q, F.lit(100)), F.lit("..."))).otherwise(q))
        .select("audit_id", "user_id", "query", "topic", "response_time_ms", "token_count", "created_at")
    )


def audit_search(audit: DataFrame, needle: str) -> DataFrame:
    """Matches of a case-insensitive search and the rounded mean latency of the whole log."""
    wanted = needle.strip().lower()
    hit = F.lower("query").contains(wanted) if wanted else F.lit(True)
    mean = F.round(F.sum(F.coalesce("response_time_ms", F.lit(0))).cast("double") / F.count(F.lit(1)), 0)
    return audit.agg(
        F.count_if(hit).alias("n_matches"), F.coalesce(mean, F.lit(0.0)).cast("bigint").alias("avg_ms"),
        F.max(F.when(hit, F.col("audit_id"))).alias("newest_match"),
    )


def make_alerts(processed: DataFrame, sources=D.ALERT_SOURCES) -> DataFrame:
    """Alerts for new or changed pages of the alerting sources."""
    summary = strip(F.replace(F.left("content", F.lit(300)), F.lit("\n"), F.lit(" ")))
    return processed.where(F.col("result").isin("new", "changed") & F.col("source_type").isin(*sources)).select(
        "page_id", F.left("title", F.lit(500)).alias("title"), "url", "source_type", summary.alias("summary"),
    )


def newest_alerts(alerts: DataFrame, order: str, n: int = 50) -> DataFrame:
    return alerts.orderBy(F.desc(order)).limit(n)


def apply_updates(target: DataFrame, updates: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """New snapshot after a batch of keyed updates; the latest update of a key wins."""
    last = first_per_key(updates.select(key, at, *columns), [key], [F.desc(at)])
    changed = last.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    kept = [c for c in target.columns if c not in columns]
    return target.join(changed, key, "left").select(
        *kept, *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    )


def ordered_listing(df: DataFrame, order: list[str], columns: list[str], nulls_last: bool = False) -> DataFrame:
    """Newest first; a range-partitioned sort, so no single task sees everything."""
    desc = F.desc_nulls_last if nulls_last else F.desc
    return df.select(*columns).orderBy(*[desc(c) for c in order])


def pending_reviews(reviews: DataFrame, audit: DataFrame, n: int = 50) -> DataFrame:
    """Newest open reviews that have an audit row."""
    open_items = reviews.where(F.col("status") == "pending").select("review_id", "audit_id", "status", "created_at")
    text = audit.select("audit_id", "query", F.left(F.coalesce("answer", F.lit("")), F.lit(300)).alias("answer_preview"))
    return open_items.join(text, "audit_id").orderBy(F.desc("created_at"), F.desc("review_id")).limit(n)


def invite_status(requests: DataFrame, invites: DataFrame, as_of: Column) -> DataFrame:
    """unknown / used / expired / email_mismatch / valid, in this order; a token of many requests is spread over tasks."""
    known = invites.withColumn("_known", F.lit(True)).withColumnRenamed("email", "_invited")
    mismatch = (F.coalesce("_invited", F.lit("")) != "") & (F.col("_invited") != F.col("email"))
    return spread_left_join(requests, known, "token", F.col("request_id")).select(
        "request_id", "token",
        F.when(F.col("_known").isNull(), "unknown")
        .when(F.col("is_used"), "used")
        .when(F.col("expires_at") < as_of, "expired")
        .when(F.coalesce(mismatch, F.lit(True)), "email_mismatch")
        .otherwise("valid").alias("status"),
    )


def role_rank(c: Column, ranks: dict = D.ROLE_RANKS) -> Column:
    m = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(F.element_at(m, c), F.lit(0))


def role_access(users: DataFrame, required: str, ranks: dict = D.ROLE_RANKS) -> DataFrame:
    """Users whose role reaches the required one; unknown roles rank lowest."""
    return users.where(role_rank(F.col("role"), ranks) >= ranks.get(required, 0))


def matters_with_counts(matters: DataFrame, meta: DataFrame) -> DataFrame:
    """Question count per matter; questions are counted before the join, so a busy matter is one row."""
    counts = meta.where(F.col("matter_id").isNotNull()).groupBy("matter_id").agg(F.count("audit_id").alias("n"))
    return (
        matters.join(counts, "matter_id", "left")
        .select(*matters.columns, F.coalesce("n", F.lit(0)).alias("query_count"))
        .orderBy(F.desc_nulls_last("updated_at"), F.desc("created_at"), "matter_id")
    )


def session_logs(audit: DataFrame, meta: DataFrame) -> DataFrame:
    """Audit rows of sessions, for their own user."""
    links = meta.where(F.col("session_id").isNotNull()).select("audit_id", "session_id", F.col("user_id").alias("_u"))
    return audit.join(links, "audit_id").where(F.col("user_id") == F.col("_u")).drop("_u")


def attach_research(meta: DataFrame, audit: DataFrame, requests: DataFrame) -> DataFrame:
    """Meta snapshot after linking questions to matters.

    ``requests`` has (audit_id, matter_id, user_id, session_id, requested_at). Only a
    question's owner can link it; the latest request of a question wins; a meta
    row is added where there is none.
    """
    owned = requests.join(audit.select("audit_id", F.col("user_id").alias("_owner")), "audit_id").where(
        F.col("user_id") == F.col("_owner")
    )
    last = first_per_key(owned, ["audit_id"], [F.desc("requested_at")]).select(
        "audit_id", F.col("matter_id").alias("_m"), F.col("session_id").alias("_s")
    )
    joined = meta.withColumn("_old", F.lit(True)).join(last, "audit_id", "full")
    fill = {
        "matter_id": F.coalesce("_m", "matter_id"),
        "session_id": F.when(F.col("_old"), F.col("session_id")).otherwise(F.col("_s")),
        "query_mode": F.when(F.col("_old"), F.col("query_mode")).otherwise(F.lit("standard")),
    }
    return joined.select(*[fill.get(c, F.col(c)).alias(c) for c in meta.columns])


def feedback_validate(submissions: DataFrame, audit: DataFrame, existing: DataFrame) -> DataFrame:
    """Submissions for known answers that the user has not rated yet; the first of a pair wins."""
    known = submissions.join(audit.select("audit_id"), "audit_id", "left_semi")
    fresh = known.join(existing.select("audit_id", "user_id"), ["audit_id", "user_id"], "left_anti")
    return first_per_key(fresh, ["audit_id", "user_id"], ["created_at", "feedback_id"])


def attach_filenames(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds the document's file name, '' where the document is not stored."""
    names = documents.select("document_id", "filename")
    return chunks.drop("filename").join(names, "document_id", "left").na.fill("", ["filename"])
