"""The engine's input tables as views of the driver's tables.

Each view is one SQL text that both engines run: Spark binds the names in braces
to DataFrames, the SQL checks inline them as common table expressions. Every view
reads its whole base table; ``where`` clauses are natural predicates of the view.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import spread

AS_OF = "2024-01-31 00:00:00"

BASE = {
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
}

# tables whose rows cost much more to process than to read
TEXT_TABLES = {"documents", "pages", "conversations"}

VIEWS = {
    # one row per answered question
    "audit_logs": """
        select event_id as audit_id, user_id,
               trim(repeat(concat(event_type, ' ', props, ' '), cast(floor(value / 10) as int) + 1)) as query,
               concat('Answer ', event_type, ' ', repeat(concat(props, '. '), cast(floor(value / 5) as int))) as answer,
               cast(ts as timestamp) as created_at,
               case when value >= 40 and value < 44 then null else event_type end as topic,
               case when value >= 150 then null else cast(floor(value * 100) as int) end as response_time_ms,
               cast(floor(value * 13) as int) as token_count
        from {events}""",
    # at most one row per audit row; cheap errors have none
    "query_meta": """
        select event_id as audit_id, user_id, user_id * 100 + day(ts) as session_id,
               case when event_type = 'purchase' then user_id end as matter_id,
               floor(least(value, 100.0)) / 100 as confidence_score,
               case when floor(least(value, 100.0)) >= 72 then 'high' when floor(least(value, 100.0)) >= 45 then 'medium'
                    when value < 1 then null else 'low' end as confidence_level,
               case event_type when 'signup' then null when 'view' then 'compare' when 'click' then 'doc_review'
                    else 'standard' end as query_mode,
               value >= 10 and value < 20 as from_cache, floor(least(value, 100.0)) < 45 as needs_review,
               case when value < 50 then concat('["step ', event_type, '", "check"]') end as next_steps,
               case when value < 30 then concat('["risk ', event_type, '"]') end as risks,
               case when event_type = 'view' then '[]' when event_type = 'click' then '["form"]' end as related_forms,
               cast(ts as timestamp) as created_at
        from {events} where event_type <> 'error' or value >= 50""",
    "feedback": """
        select event_id as feedback_id, event_id as audit_id, user_id,
               value < case when event_type = 'error' then 55 else 110 end as is_positive,
               cast(ts as timestamp) as created_at
        from {events} where value >= 30""",
    "review_items": """
        select audit_id as review_id, audit_id,
               case when confidence_score < 0.1 then 'rejected' when confidence_score < 0.2 then 'approved'
                    else 'pending' end as status, created_at
        from {query_meta} where needs_review""",
    "users": """
        select c_custkey as user_id, c_name as name, c_nationkey as nation,
               case c_mktsegment when 'AUTOMOBILE' then 'super_admin' when 'BUILDING' then 'admin'
                    when 'FURNITURE' then 'attorney' when 'HOUSEHOLD' then 'junior_associate' else 'guest' end as role,
               c_acctbal > 0 as is_active
        from {customer}""",
    "matters": """
        select o_orderkey as matter_id, o_custkey as user_id, o_orderpriority as title, o_orderstatus as status,
               cast(o_orderdate as timestamp) as created_at,
               case when o_orderstatus = 'O' then null else cast(o_orderdate as timestamp) end as updated_at
        from {orders}""",
    "invites": """
        select o_orderkey as token, concat(o_orderpriority, '@x.org') as email, o_orderstatus = 'F' as is_used,
               cast(o_orderdate as timestamp) as expires_at
        from {orders}""",
    # stored documents; repeated file names, so versions exist
    "corpus": """
        select doc_id as document_id, concat(source, '_', lang, '.txt') as filename,
               case when n_chars > 1500 then 'case' else 'law' end as doc_type, lang as topic, text, n_chars,
               case when n_chars < 200 then 'failed' when n_chars > 20000 then 'pending' else 'completed' end as status
        from {documents}""",
    # one piece per line of a document
    "lines": """
        select document_id, doc_type, filename, topic, status, chunk_index, text from (
            select document_id, doc_type, filename, topic, status,
                   {{explode_lines}}
            from {corpus})""",
    "crawl_now": """
        select page_id, url, html as content,
               case when url like 'https%' then 'uscis_news' else 'bia' end as source_type
        from {pages}""",
    # the snapshot before: pages of long URLs were not known, some have changed, some had failed
    "crawl_prev": """
        select url, min(md5(case when length(html) > 12000 then concat(html, 'x') else html end)) as content_hash,
               max(case when html like '%&amp;&amp;%' then 'failed' else 'unchanged' end) as status,
               cast(count(*) as int) as scrape_count
        from {pages} where length(url) < 42 group by url""",
    # questions: every benchmark text that has a vector
    "questions": """
        select b.item_id as query_id, b.text as query_text, e.embedding, e.label
        from {benchmark} b join {embeddings} e on e.vec_id = b.item_id""",
    # passages: every vector that has a text; five to a document
    "passages": """
        select e.vec_id as chunk_id, cast(floor(e.vec_id / 5) as bigint) as document_id, e.embedding, e.label, d.text,
               d.lang as chunk_topic, c.doc_type, c.filename, cast(null as string) as section, cast(null as string) as clause,
               '1' as doc_version
        from {embeddings} e join {documents} d on d.doc_id = e.vec_id
        join {corpus} c on c.document_id = cast(floor(e.vec_id / 5) as bigint)""",
    "turn_pairs": """
        select u.conv_id as session_id, u.turn, u.text as query, a.text as answer
        from {conversations} u
        left join {conversations} a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
        where u.role = 'user'""",
    # generated answers in the structured form; some languages lack the answer header
    "answers": """
        select doc_id as answer_id, lang as topic,
               concat(case when lang = 'es' then '' else '**ANSWER:** ' end, text, '\n**CITED LAWS:**\n- ', source,
                      '\n- ', source, '\n**IMPORTANT NOTES:**\n* note ', lang, '\n\n1. second',
                      case when lang = 'en' then '\n**NEXT STEPS:**\n1. one\n2. two\n3. three' else '' end,
                      case when n_chars > 1000 then '\n**RISKS & CONSIDERATIONS:**\n- late' else '' end,
                      case when lang = 'de' then '\n**RELATED FORMS:**\n- F1' else '' end) as content
        from {documents}""",
}
# the one place where the engines' spelling differs
LINES = {
    "spark": "posexplode(split(text, '\\n')) as (chunk_index, text)",
    "duckdb": "unnest(range(len(string_split(text, chr(10))))) as chunk_index, unnest(string_split(text, chr(10))) as text",
}
_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


@lru_cache(maxsize=None)
def _closure(name: str) -> tuple[str, ...]:
    out: list[str] = []
    for dep in needs(VIEWS[name]):
        if dep in VIEWS:
            out += [d for d in _closure(dep) if d not in out]
    return tuple([*out, name])


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the files once per process."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_SCHEMAS[path]).parquet(path)
    return spread(df) if name in TEXT_TABLES else df


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view or driver table as a DataFrame, with UTC time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if name in BASE:
        return table(spark, sf, name)
    sql = VIEWS[name].replace("{{explode_lines}}", LINES["spark"])
    return spark.sql(sql, **{d: view(spark, sf, d) for d in needs(sql)})


def views(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf, n) for n in names]


def check(sql: str) -> str:
    """SQL check with the views it names in braces inlined."""
    order: list[str] = []
    for n in needs(sql):
        if n in VIEWS:
            order += [d for d in _closure(n) if d not in order]
    plain = lambda s: _NAME.sub(lambda m: m.group(1), s)
    ctes = [
        f"{n} as ({plain(VIEWS[n].replace('{{explode_lines}}', LINES['duckdb'])).strip()})" for n in order
    ]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + body
