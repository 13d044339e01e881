"""Metrics, listings, reviews, matters and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators import metrics as M
from ..operators import sessions as S
from .registry import query
from .views import AS_OF, check, view, views

NOW = f"timestamp '{AS_OF}'"


def stamp(c="created_at"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def stamp_sql(c="created_at", alias=None):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {alias or c.split('.')[-1]}"


def joined(c):
    """Lists are shown as text, so that both engines' values compare."""
    return F.array_join(c, "|").alias(c if isinstance(c, str) else "list")


# --- dashboard ---------------------------------------------------------------
@query("volume_counts", check(f"""
    select count(*) as total_queries, count(*) filter (created_at >= date_trunc('day', {NOW})) as queries_today,
           count(*) filter (created_at >= {NOW} - interval 24 hour) as queries_last_24h,
           count(*) filter (created_at >= {NOW} - interval 1 hour) as queries_last_hour
    from {{audit_logs}}"""))
def volume_counts(spark, sf):
    return M.volume_counts(view(spark, sf, "audit_logs"), AS_OF)


@query("avg_latency", check("""
    select cast(trunc(avg(response_time_ms)) as bigint) as avg_response_time_ms,
           round(avg(response_time_ms), 0) as avg_response_time_rounded from {audit_logs}"""))
def avg_latency(spark, sf):
    return M.avg_latency(view(spark, sf, "audit_logs"))


@query("latency_percentiles", check("""
    select cast(trunc(quantile_cont(response_time_ms, 0.5)) as bigint) as latency_p50_ms,
           cast(trunc(quantile_cont(response_time_ms, 0.95)) as bigint) as latency_p95_ms from {audit_logs}"""))
def latency_percentiles(spark, sf):
    return M.latency_percentiles(view(spark, sf, "audit_logs"))




def pct(p, w):
    """Share in percent with one decimal, halves up, in whole numbers."""
    return f"cast(case when {w} > 0 then (2000 * ({p}) + ({w})) // (2 * ({w})) end as double) / 10"


@query("satisfaction", check(f"""
    select p as feedback_positive, n as feedback_negative, {pct('p', 'p + n')} as satisfaction_rate
    from (select count(*) filter (is_positive) as p, count(*) filter (not is_positive) as n from {{feedback}})"""))
def satisfaction(spark, sf):
    return M.satisfaction(view(spark, sf, "feedback"))


@query("confidence_distribution", check("""
    select confidence_level, count(*) as n_queries,
           (select round(cast(sum(cast(confidence_score as decimal(10,2))) as double) / count(confidence_score), 3)
            from {query_meta}) as avg_confidence_score
    from {query_meta} where confidence_level is not null group by 1"""))
def confidence_distribution(spark, sf):
    return M.confidence_distribution(view(spark, sf, "query_meta"))


@query("review_and_cache_rates", check(f"""
    select r as needs_review_count, h as cache_hits, coalesce({pct('h', 'n')}, 0) as cache_hit_rate
    from (select count(*) filter (needs_review) as r, count(*) filter (from_cache) as h, count(*) as n from {{query_meta}})"""))
def review_and_cache_rates(spark, sf):
    return M.review_and_cache_rates(view(spark, sf, "query_meta"))


@query("mode_distribution", check(
    "select coalesce(query_mode, 'standard') as query_mode, count(*) as n_queries from {query_meta} group by 1"))
def mode_distribution(spark, sf):
    return M.mode_distribution(view(spark, sf, "query_meta"))


@query("top_topics", check("""
    select upper(topic) as topic, count(*) as n_queries from {audit_logs} where topic is not null
    group by topic order by n_queries desc, topic limit 8"""))
def top_topics(spark, sf):
    return M.top_topics(view(spark, sf, "audit_logs"))


@query("review_status", check("select status, count(*) as n_items from {review_items} group by 1"))
def review_status(spark, sf):
    return M.review_status(view(spark, sf, "review_items"))


@query("daily_volume", check(f"""
    select strftime(d, '%Y-%m-%d') as date, count(audit_id) as n_queries
    from (select unnest(generate_series(date_trunc('day', {NOW}) - interval 13 day, date_trunc('day', {NOW}), interval 1 day)) as d)
    left join (select * from {{audit_logs}} where created_at >= {NOW} - interval 14 day) a on date_trunc('day', a.created_at) = d
    group by 1"""))
def daily_volume(spark, sf):
    return M.daily_volume(view(spark, sf, "audit_logs"), AS_OF)


@query("hourly_activity", check(f"""
    select strftime(h, '%Y-%m-%dT%H:00') as hour, count(audit_id) as n_queries
    from (select unnest(generate_series({NOW} - interval 23 hour, {NOW}, interval 1 hour)) as h)
    left join (select * from {{audit_logs}} where created_at >= {NOW} - interval 24 hour) a on date_trunc('hour', a.created_at) = h
    group by 1"""))
def hourly_activity(spark, sf):
    return M.hourly_activity(view(spark, sf, "audit_logs"), AS_OF)


@query("feedback_trend", check(f"""
    select strftime(d, '%Y-%m-%d') as date, count(*) filter (is_positive) as positive,
           count(*) filter (not is_positive) as negative
    from (select unnest(generate_series({NOW} - interval 6 day, {NOW}, interval 1 day)) as d)
    left join (select * from {{feedback}} where created_at >= {NOW} - interval 7 day) f on date_trunc('day', f.created_at) = d
    group by 1"""))
def feedback_trend(spark, sf):
    return M.feedback_trend(view(spark, sf, "feedback"), AS_OF)


@query("recent_activity", check(f"""
    select a.audit_id, left(a.query, 120) as query, a.topic, m.confidence_level,
           coalesce(a.response_time_ms, 0) as response_time_ms, coalesce(m.from_cache, false) as from_cache,
           {stamp_sql('a.created_at')}
    from {{audit_logs}} a left join {{query_meta}} m on m.audit_id = a.audit_id order by a.created_at desc, a.audit_id desc limit 8"""))
def recent_activity(spark, sf):
    audit, meta = views(spark, sf, "audit_logs", "query_meta")
    return M.recent_activity(audit, meta).withColumn("created_at", stamp())


@query("system_stats", check("""
    select 'users' as metric, count(*) as value from {users}
    union all select 'documents_' || status, count(*) from {corpus} group by status
    union all select 'chunks', count(*) from {lines}
    union all select 'queries', count(*) from {audit_logs}
    union all select case when is_positive then 'feedback_positive' else 'feedback_negative' end, count(*)
    from {feedback} group by is_positive"""))
def system_stats(spark, sf):
    return M.system_stats(*views(spark, sf, "users", "corpus", "lines", "audit_logs", "feedback"))


@query("corpus_completeness", check(f"""
    with goal(doc_type, target, chunk_target) as (values ('law', 260, 2120), ('case', 244, 5860)),
    pieces as (select document_id, count(*) as n from {{lines}} group by 1),
    have as (select doc_type, count(*) as d, sum(coalesce(n, 0)) as c from {{corpus}} left join pieces using (document_id)
             where status = 'completed' group by 1),
    per as (select g.doc_type, coalesce(d, 0) as d, target, coalesce(c, 0) as c, chunk_target
            from goal g left join have using (doc_type)),
    alls as (select * from per union all select 'total', sum(d), sum(target), sum(c), sum(chunk_target) from per)
    select doc_type, cast(d as bigint) as n_documents, cast(target as bigint) as target,
           cast(greatest(0, target - d) as bigint) as missing, cast(c as bigint) as n_chunks,
           cast(chunk_target as bigint) as chunk_target,
           {pct('cast(c as bigint)', 'cast(chunk_target as bigint)')} as completeness_pct from alls"""))
def corpus_completeness(spark, sf):
    corpus, lines = views(spark, sf, "corpus", "lines")
    counts = lines.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return M.corpus_completeness(corpus, counts)


@query("satisfaction_by_topic", check(f"""
    select topic, total, positive, total - positive as negative, {pct('positive', 'total')} as satisfaction_rate
    from (select coalesce(a.topic, 'unknown') as topic, count(*) as total, count(*) filter (f.is_positive) as positive
          from {{feedback}} f join {{audit_logs}} a on a.audit_id = f.audit_id group by 1)"""))
def satisfaction_by_topic(spark, sf):
    return M.satisfaction_by_topic(*views(spark, sf, "feedback", "audit_logs"))


@query("low_satisfaction_alerts", check(f"""
    select * from (select topic, total, positive, total - positive as negative, {pct('positive', 'total')} as satisfaction_rate
    from (select coalesce(a.topic, 'unknown') as topic, count(*) as total, count(*) filter (f.is_positive) as positive
          from {{feedback}} f join {{audit_logs}} a on a.audit_id = f.audit_id group by 1))
    where total >= 5 and satisfaction_rate < 60"""))
def low_satisfaction_alerts(spark, sf):
    return M.low_satisfaction_alerts(satisfaction_by_topic(spark, sf))


@query("recent_negative_queries", check("""
    select a.audit_id, left(a.query, 100) as query, a.topic from {feedback} f join {audit_logs} a on a.audit_id = f.audit_id
    where not f.is_positive order by a.created_at desc, f.feedback_id desc limit 10"""))
def recent_negative_queries(spark, sf):
    return M.recent_negative_queries(*views(spark, sf, "feedback", "audit_logs"))


@query("corpus_counts", check("""
    select (select count(*) from {corpus} where status = 'completed') as completed,
           (select count(*) from {corpus} where status in ('processing', 'pending')) as in_progress,
           (select count(*) from {users} where is_active) as active_users"""))
def corpus_counts(spark, sf):
    return M.corpus_counts(*views(spark, sf, "corpus", "users"))


@query("eval_rollup", check("""
    select count(*) as num_questions, round(avg(s), 3) as average,
           case when avg(s) >= 0.8 then 'EXCELLENT' when avg(s) >= 0.7 then 'GOOD' when avg(s) >= 0.6 then 'ACCEPTABLE'
                else 'NEEDS IMPROVEMENT' end as grade
    from (select least(length(text), 300) / 300.0 as s from {benchmark})"""))
def eval_rollup(spark, sf):
    scores = view(spark, sf, "benchmark").select("item_id", (F.least(F.length("text"), F.lit(300)) / 300).alias("score"))
    return M.eval_rollup(scores, first_n=None)


# --- history, listings, alerts -------------------------------------------------
@query("audit_left_meta", check("""
    select a.audit_id, a.user_id, a.topic, m.session_id, m.confidence_level, m.query_mode
    from {audit_logs} a left join {query_meta} m on m.audit_id = a.audit_id"""))
def audit_left_meta(spark, sf):
    audit, meta = views(spark, sf, "audit_logs", "query_meta")
    return A.audit_with_meta(audit, meta).select("audit_id", "user_id", "topic", "session_id", "confidence_level", "query_mode")


@query("history_by_matter", check("""
    select a.audit_id, a.user_id, m.matter_id, m.confidence_level
    from {audit_logs} a join {query_meta} m on m.audit_id = a.audit_id where m.matter_id is not null"""))
def history_by_matter(spark, sf):
    audit, meta = views(spark, sf, "audit_logs", "query_meta")
    return A.history_by_matter(audit, meta).select("audit_id", "user_id", "matter_id", "confidence_level")


@query("query_history", check(f"""
    select a.user_id, a.audit_id, a.query, left(coalesce(a.answer, ''), 200) as answer_preview, a.topic, a.response_time_ms,
           m.confidence_level, m.matter_id, {stamp_sql('a.created_at')}
    from {{audit_logs}} a left join {{query_meta}} m on m.audit_id = a.audit_id
    qualify row_number() over (partition by a.user_id order by a.created_at desc, a.audit_id desc) <= 30"""))
def query_history(spark, sf):
    audit, meta = views(spark, sf, "audit_logs", "query_meta")
    return A.query_history(audit, meta).withColumn("created_at", stamp())


@query("history_detail", check(f"""
    select a.audit_id, a.query, a.answer, a.topic, a.response_time_ms, m.confidence_score, m.confidence_level,
           coalesce(array_to_string(from_json(m.next_steps, '["varchar"]'), '|'), '') as next_steps,
           coalesce(array_to_string(from_json(m.risks, '["varchar"]'), '|'), '') as risks,
           coalesce(array_to_string(from_json(m.related_forms, '["varchar"]'), '|'), '') as related_forms,
           {stamp_sql('a.created_at')}
    from {{audit_logs}} a left join {{query_meta}} m on m.audit_id = a.audit_id"""))
def history_detail(spark, sf):
    audit, meta = views(spark, sf, "audit_logs", "query_meta")
    d = A.history_detail(audit, meta)
    lists = ("next_steps", "risks", "related_forms")
    return d.select(*[c for c in d.columns if c not in (*lists, "created_at")], *[joined(c) for c in lists], stamp())


@query("audit_log_preview", check(f"""
    select audit_id, user_id, case when length(query) > 100 then left(query, 100) || '...' else query end as query, topic,
           response_time_ms, token_count, {stamp_sql()}
    from {{audit_logs}} order by audit_logs.created_at desc, audit_id desc limit 50"""))
def audit_log_preview(spark, sf):
    return A.audit_log_preview(view(spark, sf, "audit_logs")).withColumn("created_at", stamp())


@query("audit_search", check("""
    select count(*) filter (contains(lower(query), 'purchase {{"k": 1')) as n_matches,
           cast(floor(sum(coalesce(response_time_ms, 0)) * 1.0 / count(*) + 0.5) as bigint) as avg_ms,
           max(audit_id) filter (contains(lower(query), 'purchase {{"k": 1')) as newest_match
    from {audit_logs}""".replace("{{", "\u0002")).replace("\u0002", "{"))
def audit_search(spark, sf):
    return A.audit_search(view(spark, sf, "audit_logs"), ' Purchase {"k": 1')


@query("apply_status_updates", check(f"""
    with updates as (
        select event_id as review_id, case event_type when 'click' then 'approved' when 'view' then 'rejected' end as status,
               event_type as notes, user_id as reviewer, ts as upd_at
        from (select cast(floor(event_id / 2) as bigint) as event_id, event_type, user_id, ts from {{events}}
              where event_type in ('click', 'view'))),
    last as (select * from updates qualify row_number() over (partition by review_id order by upd_at desc) = 1)
    select r.review_id, r.audit_id, case when l.review_id is not null then l.status else r.status end as status,
           l.notes, l.reviewer, {stamp_sql('r.created_at')}
    from {{review_items}} r left join last l on l.review_id = r.review_id"""))
def apply_status_updates(spark, sf):
    reviews, events = views(spark, sf, "review_items", "events")
    updates = events.where(F.col("event_type").isin("click", "view")).select(
        F.floor(F.col("event_id") / 2).alias("review_id"),
        F.when(F.col("event_type") == "click", "approved").otherwise("rejected").alias("status"),
        F.col("event_type").alias("notes"), F.col("user_id").alias("reviewer"), F.col("ts").alias("at"),
    )
    target = reviews.withColumn("notes", F.lit(None).cast("string")).withColumn("reviewer", F.lit(None).cast("bigint"))
    out = A.apply_updates(target, updates, "review_id", "at", ["status", "notes", "reviewer"])
    return out.select("review_id", "audit_id", "status", "notes", "reviewer", stamp())


@query("ordered_listing", check(f"""
    select feedback_id, audit_id, is_positive, {stamp_sql()} from {{feedback}} order by feedback.created_at desc"""))
def ordered_listing(spark, sf):
    out = A.ordered_listing(view(spark, sf, "feedback"), ["created_at", "feedback_id"],
                            ["feedback_id", "audit_id", "is_positive", "created_at"])
    return out.withColumn("created_at", stamp())


@query("pending_reviews", check(f"""
    select r.review_id, r.audit_id, a.query, left(coalesce(a.answer, ''), 300) as answer_preview, r.status,
           {stamp_sql('r.created_at')}
    from {{review_items}} r join {{audit_logs}} a on a.audit_id = r.audit_id where r.status = 'pending'
    order by r.created_at desc, r.review_id desc limit 50"""))
def pending_reviews(spark, sf):
    return A.pending_reviews(*views(spark, sf, "review_items", "audit_logs")).withColumn("created_at", stamp())


@query("invite_status", check("""
    select request_id, r.token,
           case when i.token is null then 'unknown' when is_used then 'used'
                when expires_at < timestamp '1998-01-01' then 'expired'
                when coalesce(i.email, '') <> '' and i.email <> r.email then 'email_mismatch' else 'valid' end as status
    from (select l_orderkey * 10 + l_linenumber as request_id, case when l_linestatus = 'F' then -1 else l_orderkey end as token,
                 case when l_returnflag = 'A' then '1-URGENT@x.org' else '5-LOW@x.org' end as email from {lineitem}) r
    left join {invites} i on i.token = r.token"""))
def invite_status(spark, sf):
    lineitem, invites = views(spark, sf, "lineitem", "invites")
    requests = lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"),
        F.when(F.col("l_linestatus") == "F", -1).otherwise(F.col("l_orderkey")).alias("token"),
        F.when(F.col("l_returnflag") == "A", "1-URGENT@x.org").otherwise("5-LOW@x.org").alias("email"),
    )
    return A.invite_status(requests, invites, M.ts("1998-01-01 00:00:00"))


@query("role_access_filter", check("""
    select user_id, role, is_active from {users}
    where case role when 'super_admin' then 4 when 'admin' then 3 when 'attorney' then 2 when 'junior_associate' then 1 else 0 end >= 2"""))
def role_access_filter(spark, sf):
    return A.role_access(view(spark, sf, "users"), "attorney").select("user_id", "role", "is_active")


@query("owner_scope", check("select matter_id, user_id, title, status from {matters} where user_id = 7"))
def owner_scope(spark, sf):
    return A.owned_by(view(spark, sf, "matters"), 7).select("matter_id", "user_id", "title", "status")


# --- joins -----------------------------------------------------------------------
@query("matters_with_counts", check(f"""
    select m.matter_id, m.user_id, m.title, m.status, {stamp_sql('m.created_at')}, {stamp_sql('m.updated_at')},
           count(q.audit_id) as query_count
    from {{matters}} m left join {{query_meta}} q on q.matter_id = m.matter_id group by all"""))
def matters_with_counts(spark, sf):
    out = A.matters_with_counts(*views(spark, sf, "matters", "query_meta"))
    return out.select("matter_id", "user_id", "title", "status", stamp(), stamp("updated_at"), "query_count")


@query("session_logs", check(f"""
    select a.audit_id, a.user_id, m.session_id, a.topic, {stamp_sql('a.created_at')}
    from {{audit_logs}} a join {{query_meta}} m on m.audit_id = a.audit_id and m.user_id = a.user_id
    where m.session_id is not null"""))
def session_logs(spark, sf):
    return A.session_logs(*views(spark, sf, "audit_logs", "query_meta")).select(
        "audit_id", "user_id", "session_id", "topic", stamp())


@query("feedback_validate", check("""
    with sub as (select event_id as feedback_id, cast(floor(event_id / 2) as bigint) * 3 as audit_id, user_id, ts as created_at
                 from {events} where event_type in ('click', 'view', 'purchase'))
    select feedback_id, s.audit_id, s.user_id from sub s
    where s.audit_id in (select audit_id from {audit_logs})
      and not exists (select 1 from {feedback} f where f.audit_id = s.audit_id and f.user_id = s.user_id)
    qualify row_number() over (partition by s.audit_id, s.user_id order by s.created_at, feedback_id) = 1"""))
def feedback_validate(spark, sf):
    events, audit, existing = views(spark, sf, "events", "audit_logs", "feedback")
    sub = events.where(F.col("event_type").isin("click", "view", "purchase")).select(
        F.col("event_id").alias("feedback_id"), (F.floor(F.col("event_id") / 2) * 3).alias("audit_id"), "user_id",
        F.col("ts").alias("created_at"),
    )
    return A.feedback_validate(sub, audit, existing).select("feedback_id", "audit_id", "user_id")


@query("attach_research", check("""
    with req as (select event_id as audit_id, cast(floor(value) as bigint) as matter_id,
                        case when event_type = 'signup' then user_id + 1 else user_id end as user_id,
                        user_id * 1000 as session_id, ts as requested_at from {events} where value >= 45),
    own as (select r.* from req r join {audit_logs} a on a.audit_id = r.audit_id and a.user_id = r.user_id),
    last as (select * from own qualify row_number() over (partition by audit_id order by requested_at desc) = 1)
    select coalesce(m.audit_id, l.audit_id) as audit_id, coalesce(l.matter_id, m.matter_id) as matter_id,
           case when m.audit_id is not null then m.session_id else l.session_id end as session_id,
           case when m.audit_id is not null then m.query_mode else 'standard' end as query_mode
    from {query_meta} m full join last l on l.audit_id = m.audit_id"""))
def attach_research(spark, sf):
    meta, audit, events = views(spark, sf, "query_meta", "audit_logs", "events")
    req = events.where(F.col("value") >= 45).select(
        F.col("event_id").alias("audit_id"), F.floor("value").alias("matter_id"),
        F.when(F.col("event_type") == "signup", F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        (F.col("user_id") * 1000).alias("session_id"), F.col("ts").alias("requested_at"),
    )
    slim = meta.select("audit_id", "matter_id", "session_id", "query_mode")
    return A.attach_research(slim, audit, req)


# --- windows over logs ------------------------------------------------------------
@query("rate_limit_violations", check("""
    with s as (select distinct event_type, user_id, cast(epoch(date_trunc('second', ts)) as bigint) as second from {events})
    select * from (select event_type, user_id, second,
                          count(*) over (partition by event_type, user_id order by second
                                         range between 21599 preceding and current row) as n_seconds from s)
    where n_seconds > 1"""))
def rate_limit_violations(spark, sf):
    events = view(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return S.rate_limit_violations(events, ["event_type", "user_id"], "at", 1, 21_600)


@query("cases_by_date", check("""
    select o_orderkey as case_id, case when o_orderstatus = 'P' then null else strftime(o_orderdate, '%Y-%m-%d') end as date_decided
    from {orders}"""))
def cases_by_date(spark, sf):
    cases = view(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_decided"),
    )
    return cases.orderBy(F.coalesce("date_decided", F.lit("")).desc(), "case_id")


