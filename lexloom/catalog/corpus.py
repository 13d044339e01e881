"""Sources, sinks, crawl state, versions and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import activity as A
from ..operators import chunking as CH
from ..operators import crawl_state as CS
from ..operators import metrics as M
from ..plans import ingestion as I
from ..rules import domain as D
from ..rules import sample as X
from ..session import scratch_dir
from ..sources import decisions as DE
from ..sources import documents as DO
from ..sources import manifest as MA
from ..sources import pages as PA
from ..sources import sinks as SI
from .registry import query
from .text import hits_sql, quoted, rule_sql, strip_sql, sub_sql
from .views import AS_OF, check, view, views

RULE = "=" * 60


def plain(sql: str) -> str:
    """Inline views into SQL that has regular-expression braces: names come as «name»."""
    return check(sql.replace("{", "\u0002").replace("}", "\u0003").replace("«", "{").replace("»", "}")).replace(
        "\u0002", "{").replace("\u0003", "}")


# --- text documents ------------------------------------------------------------
@query("scan_corpus", check(
    "select doc_id, source || '_' || doc_id as title, length(text) as n_chars, 1 as total_pages from {documents}"))
def scan_corpus(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("_"), "doc_id", F.lit(".txt")).alias("filename"), "text")
    return d.select(
        "doc_id", F.replace(F.substring_index("filename", "/", -1), F.lit(".txt"), F.lit("")).alias("title"),
        F.length("text").alias("n_chars"), F.lit(1).alias("total_pages"))


HEADED = ("concat(case when lang = 'es' then '' else concat('TITLE: ', case when lang = 'de' then '' else source end, '\nSOURCE: ', lang, "
          "'\nOther: x: y\n POLICY_TITLE : P ', source, '\n\n', '" + RULE + "', '\n\n') end, text)")


@query("parse_headers", plain(f"""
    select doc_id, case when lang = 'es' then null when lang = 'de' then 'P ' || source else source end as title,
           case when lang <> 'es' then lang end as header_source,
           case when lang = 'es' then 0 else 3 end as n_headers, {strip_sql('text')} as body from «documents»"""))
def parse_headers(spark, sf):
    h = DO.header_struct(F.expr(HEADED))
    return view(spark, sf, "documents").withColumn("h", h).select(
        "doc_id", F.element_at("h.headers", "title").alias("title"), F.element_at("h.headers", "source").alias("header_source"),
        F.size("h.headers").alias("n_headers"), F.regexp_replace("h.body", r"^\s+|\s+$", "").alias("body"))


@query("serialize_scraped", check(f"""
    select page_id, concat('TITLE: p', page_id, chr(10), 'SOURCE: ', source_type, chr(10), 'URL: ', url, chr(10), 'DOC_TYPE: LAW', chr(10),
           'SOURCE_URL: ', url, chr(10), chr(10), '{RULE}', chr(10), chr(10), content) as text from {{crawl_now}}"""))
def serialize_scraped(spark, sf):
    p = view(spark, sf, "crawl_now").withColumn("meta", L.policy_url("url"))
    title = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    return p.select("page_id", DO.serialise(title, "source_type", "url", F.lit("LAW"), "content", "meta").alias("text"))


# --- pages -------------------------------------------------------------------------
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _page_sql():
    h = "html"
    h = sub_sql(h, [("(?s)<!--.*?-->|<![^>]*>", "")])
    for tag in D.REMOVED_TAGS:
        h = sub_sql(h, [(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", ""), (rf"(?is)</?{tag}\b[^>]*>", "")])
    h = sub_sql(h, [(r'(?is)<div\b[^>]*\bclass\s*=\s*"[^"]*ad[^"]*"[^>]*>.*?</div\s*>', "")])

    def text(e):
        e = sub_sql(e, [("(?s)<[^>]*>", "\u0001")])
        for a, b in ENTITIES:
            e = f"replace({e}, {quoted(a)}, {quoted(b)})"
        nodes = f"array_to_string([x for x in [{strip_sql('n')} for n in string_split({e}, chr(1))] if x <> ''], chr(10))"
        return strip_sql(sub_sql(nodes, [(" {2,}", " "), ("\n{3,}", "\n\n"), (r"(?m)^\d+\s*$", "")]))

    return rf"""
    with h as (select page_id, {h} as h from pages),
    r as (select page_id, regexp_extract(h, '(?is)<body\b[^>]*>(.*)</body\s*>', 1) as body,
                 regexp_extract(h, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1) as art, h from h),
    t as (select page_id, {text("case when art <> '' then art when body <> '' then body else h end")} as a,
                 {text("case when body <> '' then body else h end")} as b from r)
    select page_id, case when length(a) >= 50 then a when length(b) >= 50 then b else '' end as text from t"""


@query("extract_page_text", _page_sql())
def extract_page_text(spark, sf):
    return view(spark, sf, "pages").select("page_id", PA.page_text("html", classes=X.CHROME).alias("text"))


@query("extract_links", plain(r"""
    select distinct regexp_replace(u, '[#?].*$', '') as url
    from (select unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*"([^"]+)"', 1)) as u from pages)
    where contains(u, '/th') or contains(u, '/sch')"""))
def extract_links(spark, sf):
    return PA.links(view(spark, sf, "pages"), any_of=["/th", "/sch"], cut_suffix=True)


PARTS = "select l_linenumber as volume, lower(l_returnflag) as part, max(l_suppkey) as n_chapters from {lineitem} group by 1, 2"


@query("crawl_manifest", check("""
    with parts as (select l_linenumber as volume, lower(l_returnflag) as part, max(l_suppkey) as n from {lineitem} group by 1, 2)
    select 'https://www.uscis.gov/policy-manual/volume-' || volume || '-part-' || part || '-chapter-' || c as url
    from (select *, unnest(range(1, n + 1)) as c from parts)
    union select url from {pages}"""))
def crawl_manifest(spark, sf):
    parts = spark.sql(PARTS, lineitem=view(spark, sf, "lineitem"))
    return MA.union(MA.expand(parts), view(spark, sf, "pages").select("url"))


@query("manifest_union", check("""
    select url from {pages} where url like 'http:%' union select url from {pages} where length(url) < 42"""))
def manifest_union(spark, sf):
    p = view(spark, sf, "pages").select("url")
    return MA.union(p.where(F.col("url").like("http:%")), p.where(F.length("url") < 42))


@query("manifest_except", check("select url from {pages} except select url from {crawl_prev}"))
def manifest_except(spark, sf):
    return MA.difference(view(spark, sf, "pages"), view(spark, sf, "crawl_prev"))


@query("missing_urls", check(r"""
    select url from (select url from {pages} union
      select distinct unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as url from {pages})
    where url not in (select url from {crawl_prev} where status in ('new', 'changed', 'unchanged'))"""))
def missing_urls(spark, sf):
    pages, prev = views(spark, sf, "pages", "crawl_prev")
    return CS.missing_urls(pages, PA.links(pages), prev)


# --- decisions ------------------------------------------------------------------------
RESULT = """to_json(named_struct(
    'caseName', case when lang = 'es' then '' else concat(source, ' v. ', lang) end,
    'caseNameFull', case when lang = 'es' and source <> 'src3' then concat('Full ', source) end,
    'cluster_id', case when n_chars > 1000 then cast(doc_id as string) end, 'id', concat('i', cast(doc_id as string)),
    'court_id', case lang when 'en' then 'bia' when 'de' then 'ca9' when 'fr' then 'zz' end,
    'court', case lang when 'fr' then 'Court Fr' when 'es' then 'scotus' else 'plain' end,
    'dateFiled', case when source = 'src1' then '' else '2001-02-03' end,
    'date_decided', '1999-01-01',
    'citation', case when n_chars > 3000 then array(concat('C', source)) else array() end,
    'docketNumber', concat('D', source),
    'snippet', case when lang = 'de' then '' else concat('<b>', text, '</b> ') end,
    'syllabus', case when lang = 'fr' then concat('<i>Syl ', source, '</i>') end,
    'opinions', array(named_struct('id', '1', 'snippet', concat(' <p>op ', source, '</p>'))),
    'absolute_url', case when lang = 'fr' then concat('/opinion/', source, '/') end,
    'meta', case when lang = 'en' then named_struct('score', named_struct('bm25', n_chars / 1000.0d)) end,
    'plain_text', case when lang = 'en' then text end, 'html', case when lang <> 'fr' then concat('<p>', text, '</p>') end))"""

DECISION_CTE = rf"""
    with r as (select doc_id, lang, source, n_chars, text,
        case when lang <> 'es' then source || ' v. ' || lang when source <> 'src3' then 'Full ' || source else 'Unknown Case' end as name,
        case when n_chars > 1000 then '' || doc_id else 'i' || doc_id end as case_id,
        {strip_sql("case when lang = 'de' then 'op ' || source else regexp_replace(text, '<[^>]+>', '', 'g') end")} as snip,
        case when source = 'src1' then '1999-01-01' else '2001-02-03' end as decided from documents)"""


@query("parse_search_results", DECISION_CTE + f""",
    s as (select *, case when length(snip) > 300 then left(snip, 300) || '...' else snip end as summary from r)
    select doc_id, name as case_name, case_id, case lang when 'en' then 'bia' when 'de' then 'ca9' when 'fr' then 'zz' else 'scotus' end as court,
           case lang when 'en' then 'Board of Immigration Appeals' when 'de' then '9th Circuit' when 'fr' then 'Court Fr' else 'Supreme Court' end as court_name,
           decided as date_decided, case when n_chars > 3000 then 'C' || source else 'D' || source end as citation, summary,
           case when lang = 'fr' then 'https://www.courtlistener.com/opinion/' || source || '/' else 'https://www.courtlistener.com/opinion/' || case_id || '/' end as url,
           case when lang = 'en' then round(n_chars / 1000.0, 6) else 0.5 end as prior,
           array_to_string([t for t in [{', '.join(f"case when contains(lower(concat(name, ' ', snip)), {quoted(w[0])}) then {quoted(t)} end" for t, w in X.COURT_TOPIC_WORDS.items())}] if t is not null], '|') as case_topics,
           case {' '.join(f"when {' or '.join(f'contains(lower(snip), {quoted(w)})' for w in ws)} then {quoted(v)}" for v, ws in X.OUTCOMES)} end as outcome
    from s""")
def parse_search_results(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.expr(RESULT).alias("result"))
    out = DE.parse_search_results(d, topic_words=X.COURT_TOPIC_WORDS, outcomes=X.OUTCOMES)
    return out.drop("search_text").withColumn("case_topics", F.array_join("case_topics", "|")).withColumn("prior", F.round("prior", 6))


@query("parse_decisions", DECISION_CTE + rf""",
    s as (select *, case when lang = 'fr' then 'https://www.courtlistener.com/opinion/' || source || '/' else 'https://www.courtlistener.com/opinion/' || case_id || '/' end as url,
        case when lang = 'fr' then 'Syl ' || source end as syl,
        case when lang = 'en' and length(text) > 500 then text when lang <> 'fr' then regexp_replace('<p>' || text || '</p>', '<[^>]+>', ' ', 'g') else '' end as op,
        case when n_chars > 3000 then 'C' || source else '' end as cit,
        case when source = 'src1' then '' else '2001-02-03' end as filed from r),
    o as (select *, case {' '.join(f"when {' or '.join(f'contains(lower(concat(snip, chr(32), syl, chr(32), op)), {quoted(w)})' for w in ws)} then {quoted(v)}" for v, ws in X.OUTCOMES)} end as outcome from s),
    c as (select *, array_to_string([x for x in ['CASE: ' || name, 'SOURCE: BIA Decision', 'COURT: ' || case lang when 'fr' then 'Court Fr' when 'es' then 'scotus' else 'plain' end,
        'DATE: ' || filed, 'CITATION: ' || cit, 'OUTCOME: ' || coalesce(outcome, 'unknown'), 'URL: ' || url, '', '{RULE}', '',
        case when syl is not null then 'SYLLABUS:' || chr(10) || syl || chr(10) || chr(10) end,
        case when op <> '' then 'FULL OPINION:' || chr(10) || op when snip <> '' then 'DECISION EXCERPT:' || chr(10) || snip end] if x is not null], chr(10)) as content from o)
    select doc_id, name || ' (' || case when cit <> '' then cit else case_id end || ')' as title, url, outcome, md5(content) as content_md5
    from c where length(content) >= 100""")
def parse_decisions(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.expr(RESULT).alias("result"))
    return DE.parse_decisions(d, "bia", outcomes=X.OUTCOMES).select("doc_id", "title", "url", "outcome", F.md5("content").alias("content_md5"))


@query("select_opinion_text", r"""
    select doc_id, case when length(text) > 500 then text else regexp_replace('<p>' || text || '</p>', '<[^>]+>', ' ', 'g') end as text
    from documents""")
def select_opinion_text(spark, sf):
    return view(spark, sf, "documents").select(
        "doc_id", DE.opinion_text("text", F.concat(F.lit("<p>"), "text", F.lit("</p>"))).alias("text"))


@query("dedupe_by_id", check("""
    select case_id, first_doc from (
      select l_partkey as case_id, l_orderkey * 10 + l_linenumber as first_doc,
             row_number() over (partition by l_partkey order by l_linenumber, l_orderkey, l_suppkey) as rn from {lineitem}) where rn = 1"""))
def dedupe_by_id(spark, sf):
    hits = view(spark, sf, "lineitem").withColumnRenamed("l_partkey", "case_id")
    return CS.dedupe_by_id(hits, "case_id", ["l_linenumber", "l_orderkey", "l_suppkey"]).select(
        "case_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_doc"))


# --- sinks -------------------------------------------------------------------------------
@query("write_corpus", check("""
    select document_id, chunk_index, doc_type, text, coalesce(filename, '') as section, coalesce(topic, '') as topic
    from {lines}"""))
def write_corpus(spark, sf):
    lines = view(spark, sf, "lines").select("document_id", "chunk_index", "doc_type", "text", F.col("filename").alias("section"), "topic")
    path = scratch_dir(spark, "corpus")
    SI.write_corpus(lines, path)
    return spark.read.schema(lines.schema).parquet(path)


@query("fan_out_answer_log", check("""
    select 'audit' as target, audit_id, cast(null as varchar) as detail from {audit_logs} join {query_meta} using (audit_id)
    union all select 'meta', audit_id, coalesce('["' || query_mode || '"]', '[]') from {audit_logs} join {query_meta} using (audit_id)
    union all select 'review', audit_id, 'pending' from {audit_logs} join {query_meta} using (audit_id) where needs_review"""))
def fan_out_answer_log(spark, sf):
    audit, meta = views(spark, sf, "audit_logs", "query_meta")
    none = F.array().cast("array<string>")
    rows = audit.join(meta.drop("user_id", "created_at", "next_steps", "risks", "related_forms"), "audit_id").select(
        "*", none.alias("law_chunk_ids"), none.alias("case_chunk_ids"), none.alias("risks"), none.alias("related_forms"),
        F.filter(F.array("query_mode"), lambda x: x.isNotNull()).alias("next_steps"))
    t = SI.answer_log_tables(rows)
    return (
        t["audit"].select(F.lit("audit").alias("target"), "audit_id", F.lit(None).cast("string").alias("detail"))
        .unionByName(t["meta"].select(F.lit("meta").alias("target"), "audit_id", F.col("next_steps").alias("detail")))
        .unionByName(t["review"].select(F.lit("review").alias("target"), "audit_id", F.col("status").alias("detail"))))


@query("export_memo", check(r"""
    with p as (select conv_id, max_by(text, turn) filter (role = 'user') as q, max_by(text, turn) filter (role = 'assistant') as a
               from {conversations} group by 1)
    select conv_id, case when a is null then '' else concat('# Research Memo', chr(10), chr(10), '**Date:** 2024-01-31', chr(10), '**Query:** ', q, chr(10), chr(10),
           '## Answer', chr(10), a, chr(10), chr(10), '---', chr(10), '*Not legal advice — verify with a qualified attorney.*') end as memo from p"""))
def export_memo(spark, sf):
    return SI.conversation_memos(view(spark, sf, "conversations"), AS_OF[:10])


@query("last_message_per_role", check("""
    select conv_id, max_by(text, turn) filter (role = 'user') as last_user, max_by(text, turn) filter (role = 'assistant') as last_assistant,
           case when length(min_by(text, turn) filter (role = 'user')) > 60 then left(min_by(text, turn) filter (role = 'user'), 57) || '...'
                else min_by(text, turn) filter (role = 'user') end as title
    from {conversations} group by 1"""))
def last_message_per_role(spark, sf):
    from ..operators.sessions import last_messages

    return last_messages(view(spark, sf, "conversations"))


# --- codes and forms ------------------------------------------------------------------------
FORM_LISTS = {t: [f"{f} — {n}" for tt, _, f, n in D.TOPIC_FORMS if tt == t] for t in dict.fromkeys(x[0] for x in D.TOPIC_FORMS)}
EAD_FORM = FORM_LISTS["h4_ead"][0]


@query("join_forms", check(f"""
    with d as (select doc_id, case lang when 'en' then 'H1B' when 'fr' then 'asylum' when 'de' then 'h4_ead' end as topic,
                      case when n_chars > 1000 then [{quoted(EAD_FORM)}, 'own'] else [] end as own from {{documents}}),
    f(topic, forms) as (values {', '.join(f"({quoted(t)}, [{', '.join(quoted(x) for x in xs)}])" for t, xs in FORM_LISTS.items())})
    select doc_id, array_to_string(own || [x for x in coalesce(f.forms, []) if not list_contains(own, x)], '|') as forms
    from d left join f on f.topic = lower(d.topic)"""))
def join_forms(spark, sf):
    d = view(spark, sf, "documents")
    topic = F.expr("case lang when 'en' then 'H1B' when 'fr' then 'asylum' when 'de' then 'h4_ead' end")
    own = F.when(F.col("n_chars") > 1000, F.array(F.lit(EAD_FORM), F.lit("own"))).otherwise(F.array().cast("array<string>"))
    return d.select("doc_id", F.array_join(L.topic_forms(topic, own), "|").alias("forms"))


@query("label_from_codes", check(f"""
    with c(court, court_name) as (values {', '.join(f"({quoted(k)}, {quoted(v)})" for k, v in D.COURT_NAMES.items())}),
    t(v, p, topic) as (values {', '.join(f"({v}, {quoted(p)}, {quoted(t)})" for v, p, t in D.VOLUME_PART_TOPICS)}),
    s(v, subject) as (values {', '.join(f"({k}, {quoted(v)})" for k, v in D.VOLUME_SUBJECTS.items())})
    select l_orderkey, l_linenumber, coalesce(court_name, 'Federal Court') as court_name, topic, coalesce(subject, '') as subject
    from (select *, 'ca' || l_suppkey as court_id, l_linenumber as volume, lower(l_returnflag) as part from {{lineitem}})
    left join c on c.court = court_id left join t on t.v = volume and t.p = part left join s on s.v = volume"""))
def label_from_codes(spark, sf):
    li = view(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", L.lookup(F.concat(F.lit("ca"), F.col("l_suppkey").cast("string")), D.COURT_NAMES, "Federal Court").alias("court_name"),
        L.topic_of_part("l_linenumber", F.lower("l_returnflag")).alias("topic"),
        L.lookup(F.col("l_linenumber").cast("string"), D.VOLUME_SUBJECTS, "").alias("subject"))


# --- crawl state --------------------------------------------------------------------------------
CHANGES = """
    hashed as (select page_id, url, md5(content) as new_hash, row_number() over (partition by url order by page_id) as rn,
                      lag(md5(content)) over (partition by url order by page_id) as before from crawl_now),
    kinds as (select h.*, case when rn > 1 then before else p.content_hash end as old_hash,
                     rn = 1 and coalesce(p.status = 'failed', false) as retry from hashed h left join crawl_prev p using (url)),
    changes as (select url, page_id, old_hash, new_hash,
                       case when old_hash is null then 'new' when old_hash = new_hash and not retry then 'unchanged' else 'changed' end as change_type
                from kinds)"""


def with_changes(sql):
    return check("with refs as (select 1 from {crawl_now}, {crawl_prev} where false),\n" + CHANGES + sql)


@query("detect_changes", with_changes(
    " select url, page_id, change_type, old_hash, new_hash, change_type <> 'unchanged' as should_process from changes"))
def detect_changes(spark, sf):
    return CS.detect_changes(*views(spark, sf, "crawl_now", "crawl_prev"))


def _crawl(spark, sf):
    """Pages with a title; the body of framed pages is only in the older text field, empty pages fail."""
    now, prev = views(spark, sf, "crawl_now", "crawl_prev")
    at = M.ts("2024-01-01 00:00:00")
    prev = prev.select("url", "content_hash", F.lit("old").alias("source_type"), F.lit("LAW").alias("doc_type"), F.lit("t").alias("title"),
                       "status", F.lit(None).cast("string").alias("error_message"), at.alias("last_scraped_at"),
                       at.alias("last_changed_at"), "scrape_count")
    split = F.col("url").contains("page=")
    pages = now.select(
        "page_id", "url", "source_type", F.lit("LAW").alias("doc_type"), F.regexp_extract("content", "<title>(.*?)</title>", 1).alias("title"),
        F.when(~split & ~F.col("url").contains("#"), F.col("content")).alias("content"), F.when(split, F.col("content")).alias("clean_text"))
    return I.process_crawl(pages, prev, M.ts(AS_OF)), prev


CRAWLED = CHANGES.replace("from crawl_now)", "from crawl_now where contains(url, 'page=') or not contains(url, '#'))")


def with_crawl(sql):
    return check("with refs as (select 1 from {crawl_now}, {crawl_prev} where false),\n" + CRAWLED + """,
    results as (select n.page_id, n.url, n.source_type, n.content, c.new_hash, regexp_extract(n.content, '<title>(.*?)</title>', 1) as title,
                       coalesce(c.change_type, 'failed') as result from crawl_now n left join changes c using (page_id, url))""" + sql)


@query("process_crawl", with_crawl(" select page_id, url, result, title from results"))
def process_crawl(spark, sf):
    return _crawl(spark, sf)[0]["results"].select("page_id", "url", "result", "title")


@query("upsert_scrape_records", with_crawl("""
    , ok as (select * from results where result <> 'failed'),
    per as (select url, max_by(new_hash, page_id) as h, max_by(result, page_id) as status, max_by(title, page_id) as title,
                   max_by(source_type, page_id) as src, count(*) as n, min_by(new_hash, page_id) as first_h, min(new_hash) as lo, max(new_hash) as hi
            from ok group by 1)
    select coalesce(p.url, o.url) as url, coalesce(o.h, p.content_hash) as content_hash, coalesce(o.status, p.status) as status,
           coalesce(o.title, 't') as title, coalesce(o.src, 'old') as source_type,
           cast(coalesce(p.scrape_count, 0) + coalesce(o.n, 0) as int) as scrape_count,
           case when o.url is not null then '2024-01-31' else '2024-01-01' end as last_scraped,
           case when o.url is not null and (p.url is null or o.first_h <> p.content_hash or lo <> hi) then '2024-01-31' else '2024-01-01' end as last_changed
    from crawl_prev p full join per o on o.url = p.url"""))
def upsert_scrape_records(spark, sf):
    r = _crawl(spark, sf)[0]["records"]
    day = lambda c, n: F.date_format(c, "yyyy-MM-dd").alias(n)
    return r.select("url", "content_hash", "status", "title", "source_type", "scrape_count",
                    day("last_scraped_at", "last_scraped"), day("last_changed_at", "last_changed"))


@query("record_failures", with_crawl("""
    select coalesce(p.url, f.url) as url, case when f.url is not null then 'failed' else p.status end as status,
           case when f.url is not null then '' else p.content_hash end as content_hash,
           case when f.url is not null then string_split(f.url, '/')[-1] else 't' end as title,
           case when f.url is not null then 'Page scrape failed after retries' end as error_message
    from crawl_prev p full join (select distinct url from results where result = 'failed') f on f.url = p.url"""))
def record_failures(spark, sf):
    out, prev = _crawl(spark, sf)
    failed = CS.failure_results(out["results"].where(F.col("result") == "failed"), "uscis_policy", "LAW")
    return CS.upsert_records(prev, failed, M.ts(AS_OF)).select("url", "status", "content_hash", "title", "error_message")


@query("alerts_feed", with_crawl(r"""
    select page_id, left(title, 500) as title, url, source_type,
           regexp_replace(replace(left(content, 300), chr(10), ' '), '^\s+|\s+$', '', 'g') as summary
    from results where result in ('new', 'changed') and source_type = 'uscis_news' order by page_id desc limit 50"""))
def alerts_feed(spark, sf):
    return A.newest_alerts(_crawl(spark, sf)[0]["alerts"], "page_id")


@query("scrape_status_matrix", with_crawl("""
    select source_type, count(*) filter (result = 'new') as new, count(*) filter (result = 'changed') as changed,
           count(*) filter (result = 'unchanged') as unchanged, count(*) filter (result = 'failed') as failed
    from results group by 1"""))
def scrape_status_matrix(spark, sf):
    r = _crawl(spark, sf)[0]["results"].select("source_type", F.col("result").alias("status"))
    return M.scrape_status_matrix(r)


@query("crawl_run_summary", with_crawl("""
    select count(*) as total_scraped, count(*) filter (result = 'new') as new_pages, count(*) filter (result = 'changed') as changed_pages,
           count(*) filter (result = 'unchanged') as unchanged_pages, count(*) filter (result = 'failed') as failed_pages,
           count(*) filter (result in ('new', 'changed')) as ingestion_triggered, count(*) filter (p.status = 'failed') as retried_urls
    from results r left join crawl_prev p using (url)"""))
def crawl_run_summary(spark, sf):
    out, prev = _crawl(spark, sf)
    known = prev.select("url", (F.col("status") == "failed").alias("is_retry"))
    return M.crawl_run_summary(out["results"].join(known, "url", "left"))


# --- versions -------------------------------------------------------------------------------------
VERSIONS = """
    old as (select filename, doc_type, count(*) as base from corpus where status = 'failed' group by 1, 2),
    ver as (select document_id, filename, doc_type, row_number() over (partition by filename, doc_type order by document_id)
                   + coalesce((select base from old where old.filename = c.filename and old.doc_type = c.doc_type), 0) as version
            from corpus c)"""


def _versions(spark, sf):
    corpus = view(spark, sf, "corpus").select("document_id", "filename", "doc_type", "status")
    stored = corpus.where(F.col("status") == "failed").groupBy("filename", "doc_type").agg(F.count(F.lit(1)).alias("version"))
    return CS.assign_versions(corpus.drop("status"), stored)


@query("assign_versions", check("with refs as (select 1 from {corpus} where false)," + VERSIONS + " select * from ver"))
def assign_versions(spark, sf):
    return _versions(spark, sf).select("document_id", "filename", "doc_type", "version")


@query("latest_versions", check("with refs as (select 1 from {corpus} where false)," + VERSIONS + """
    select document_id, version, version = max(version) over (partition by filename) as is_latest from ver"""))
def latest_versions(spark, sf):
    return CS.mark_latest(_versions(spark, sf)).select("document_id", "version", "is_latest")


# --- chunks -----------------------------------------------------------------------------------------


@query("forward_fill_section", plain(r"""
    select document_id, chunk_index, last_value(nullif(regexp_extract(text, '^(The|La|Der) [a-z]+'), '') ignore nulls)
           over (partition by document_id order by chunk_index rows between unbounded preceding and current row) as section
    from «lines»"""))
def forward_fill_section(spark, sf):
    lines = view(spark, sf, "lines").withColumn("section", F.nullif(F.regexp_extract("text", "^(The|La|Der) [a-z]+", 0), F.lit("")))
    return CH.forward_fill(lines, "document_id", "chunk_index", "section").select("document_id", "chunk_index", "section")


@query("document_rollup", plain(f"""
    select document_id, count(*) as total_chunks,
           array_to_string(flatten(list(regexp_extract_all(text, {quoted(X.SECTION_REF)}) order by chunk_index)), '|') as cited_sections
    from «lines» group by 1"""))
def document_rollup(spark, sf):
    lines = view(spark, sf, "lines").withColumn("cited_sections", F.regexp_extract_all("text", F.lit(f"({X.SECTION_REF})"), F.lit(1)))
    return M.document_rollup(lines).withColumn("cited_sections", F.array_join("cited_sections", "|"))


def pack_sql(text: str, limit: int, sep: str = "chr(10) || chr(10)") -> str:
    done = "list_append(acc.done, " + strip_sql("acc.cur") + ")"
    step = (f"case when length(acc.cur) + length(x.cur) > {limit} and acc.cur <> '' then {{'cur': x.cur, 'done': {done}}} "
            f"else {{'cur': acc.cur || {sep} || x.cur, 'done': acc.done}} end")
    start = "{'cur': '', 'done': []::varchar[]}"
    items = f"[{{'cur': p, 'done': []::varchar[]}} for p in string_split({text}, {sep})]"
    folded = f"list_reduce(list_prepend({start}, {items}), lambda acc, x: {step})"
    return (f"case when length({text}) <= {limit} then [{text}] else "
            f"[y for y in (select list_append(r.done, {strip_sql('r.cur')}) from (select {folded} as r)) if y <> ''] end")


PARAGRAPHS = "replace(text, '. ', '.\n\n')"


@query("pack_paragraphs", f"""
    select doc_id, generate_subscripts(pieces, 1) - 1 as chunk_index, unnest(pieces) as text
    from (select doc_id, {pack_sql('t', 2048)} as pieces from (select doc_id, {PARAGRAPHS} as t from documents))""")
def pack_paragraphs(spark, sf):
    return view(spark, sf, "documents").select(
        "doc_id", F.posexplode(CH.pack_paragraphs(F.expr(PARAGRAPHS), D.LAW_CHUNK_TOKENS)).alias("chunk_index", "text"))


LAW_TEXT = "replace(replace(replace(text, '. ', '.\nClause 3.1 '), ', th', concat(',\nSection ', replace(source, 'src', ''), '.2 th')), '.\n', '.\n\n')"
CASE_TEXT = "replace(replace(text, '. Th', '.\nOpinion Th'), ', ', ',\n\n held ')"
ORDERED = "generate_subscripts(p, 1) as i, unnest(p) as piece"
CLAUSE_SQL, SECTION_SQL = "(?i)(Clause\\s+\\d+[\\.\\d]*|§\\s*\\d+[\\.\\d]*)", "(?i)(Section\\s+\\d+[\\.\\d]*)"


def _cut(e, p):
    return f"string_split(regexp_replace({e}, {quoted(p)}, chr(1) || '\\1', 'g'), chr(1))"


def _law_sql(source):
    return rf"""
    with s as (select doc_id, case when len({_cut('t', CLAUSE_SQL)}) <= 2 then {_cut('t', SECTION_SQL)} else {_cut('t', CLAUSE_SQL)} end as p from {source}),
    u as (select doc_id, {ORDERED} from (select doc_id, [y for y in [{strip_sql('x')} for x in p] if length(y) >= 50] as p from s)),
    l as (select *, nullif(regexp_extract(piece, '(?im)^(Section\s+\d+[\.\d]*)', 1), '') as sec,
                 nullif(regexp_extract(piece, '(?im)^(Clause\s+\d+[\.\d]*|§\s*\d+[\.\d]*)', 1), '') as clause from u),
    f as (select *, last_value(sec ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and current row) as section from l),
    k as (select doc_id, i, section, clause, {ORDERED.replace('i,', 'j,', 1).replace('piece', 'text').replace('p, 1', 'p, 1')}
          from (select *, {pack_sql('piece', 2048)} as p from f))
    select doc_id, row_number() over (partition by doc_id order by i, j) - 1 as chunk_index, text, section, clause from k"""


@query("chunk_law", f"with t as (select doc_id, {LAW_TEXT} as t from documents) select * from ({_law_sql('t')})")
def chunk_law(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.lit("law").alias("doc_type"), F.expr(LAW_TEXT).alias("text"))
    return CH.chunk_documents(d).select("doc_id", "chunk_index", "text", "section", "clause")


def _case_sql(source):
    return rf"""
    with m as (select doc_id, t, regexp_matches(t, '(?i){"|".join(p for _, p in D.CASE_BLOCK_MARKERS)}') as found from {source}),
    s as (select doc_id, found, case when found then {_cut('t', '(?i)(' + '|'.join(p for _, p in D.CASE_BLOCK_MARKERS) + ')')}
                 else string_split(t, chr(10) || chr(10)) end as p from m),
    u as (select doc_id, found, {ORDERED} from (select doc_id, found, [{strip_sql('x')} for x in p] as p from s)),
    b as (select *, case {' '.join(f"when regexp_matches(piece, '(?i)^({p})') then '{n}'" for n, p in D.CASE_BLOCK_MARKERS)} end as kind from u),
    k as (select doc_id, i, case when found then kind else 'paragraph' end as block_type, {ORDERED.replace('i,', 'j,', 1).replace('piece', 'text')}
          from (select *, case when found then {pack_sql('piece', 3072)} else [piece] end as p from b
                where (found and kind is not null and length(piece) >= 50) or (not found and length(piece) > 100)))
    select doc_id, row_number() over (partition by doc_id order by i, j) - 1 as chunk_index, text, block_type from k"""


@query("chunk_case", f"with t as (select doc_id, {CASE_TEXT} as t from documents) select * from ({_case_sql('t')})")
def chunk_case(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.lit("case").alias("doc_type"), F.expr(CASE_TEXT).alias("text"))
    return CH.chunk_documents(d).select("doc_id", "chunk_index", "text", "block_type")


@query("chunk_index", plain("""
    select doc_id, row_number() over (partition by doc_id order by i) - 1 as chunk_index, length(piece) as n_chars
    from (select doc_id, generate_subscripts(p, 1) as i, unnest(p) as piece from (select doc_id, string_split(text, chr(10)) as p from «documents»))"""))
def chunk_index(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "piece"))
    return d.select("doc_id", "chunk_index", F.length("piece").alias("n_chars"))


# --- whole ingestion -----------------------------------------------------------------------------------
# a register of files: every document, and parts of which no text has come, so that their ingestion fails
REGISTER = f"""
    select coalesce(doc_id, p_partkey) as document_id, case when doc_id is null then concat(p_brand, '.txt') else concat(source, '_', lang, '.txt') end as filename,
           {LAW_TEXT} as text from documents full join part on doc_id = p_partkey"""
INGEST_RULES = dict(
    classify_rules=dict(law_words=X.LAW_WORDS, case_words=X.CASE_WORDS, topic_patterns=X.TOPICS, flags=""),
    metadata_rules=dict(topic_patterns=X.TOPICS, section=X.SECTION_REF, form=X.FORM_REF, year=X.YEAR_REF, flags=""))
CLEANING = [(" {2,}", " "), ("\n{3,}", "\n\n"), (r"(?m)^\d+\s*$", "")]


def _ingest_sql():
    kinds = (f"[case when starts_with(s, '{DO.RULE}') then 'rule' when contains(s, ':') and i <= {D.HEADER_MAX_LINES} then 'header' "
             "when s = '' or starts_with(s, '=') then 'blank' else 'body' end for s, i in trimmed]")
    listed = lambda p: f"list_sort(list_distinct(regexp_extract_all(text, {quoted(p)})))"
    return f"""
    with raw as ({REGISTER}),
    r1 as (select document_id, filename, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as lines from raw),
    r2 as (select *, [{strip_sql('x')} for x in lines] as trimmed from r1),
    r3 as (select *, {kinds} as kinds from r2),
    r4 as (select *, coalesce(list_position(kinds, 'rule'), 0) as rule, coalesce(list_position(kinds, 'body'), 0) as body from r3),
    r5 as (select *, case when rule > 0 and (body = 0 or rule < body) then rule when body > 1 then body - 1 else 0 end as start from r4),
    r6 as (select document_id, filename, case when start > 0 then {strip_sql("array_to_string(lines[start + 1:], chr(10))")} else t end as t from r5),
    parsed as (select document_id, filename, {strip_sql(sub_sql('t', CLEANING))} as text from r6),
    s as (select *, {hits_sql('lower(text)', X.LAW_WORDS)} as l, {hits_sql('lower(text)', X.CASE_WORDS)} as c from parsed),
    typed as (select document_id, filename, text, case when l >= c then 'law' else 'case' end as doc_type, case when l + c > 0 then {rule_sql('text', X.TOPICS)} end as topic,
                     case when text = '' then 'failed' else 'completed' end as status, case when text = '' then 'No text found' end as error_message from s),
    docs as (select *, version = max(version) over (partition by filename) as is_latest from (
               select *, row_number() over (partition by filename, doc_type order by document_id) as version from typed)),
    laws as (select document_id as doc_id, text as t from docs where doc_type = 'law' and status = 'completed'),
    cases as (select document_id as doc_id, text as t from docs where doc_type = 'case' and status = 'completed'),
    law_chunks as ({_law_sql('laws')}),
    case_chunks as ({_case_sql('cases')}),
    pieces as (select doc_id as document_id, chunk_index, text, section, clause, null as block_type from law_chunks
               union all select doc_id, chunk_index, text, null, null, block_type from case_chunks),
    chunks as (select sha256(concat_ws(':', document_id, version, chunk_index)) as chunk_id, document_id, chunk_index, coalesce(section, '') as section, coalesce(clause, '') as clause,
                      block_type, coalesce({rule_sql('p.text', X.TOPICS)}, d.topic, '') as topic, length(p.text) // 4 as token_count, md5(p.text) as text_md5,
                      {listed(X.SECTION_REF).replace('(text', '(p.text')} as cited, array_to_string({listed(X.FORM_REF).replace('(text', '(p.text')}, '|') as form_references
               from pieces p join docs d using (document_id)),
    total as (select document_id, count(*) as total_chunks, array_to_string(flatten(list(cited order by chunk_index)), '|') as document_cited from chunks group by 1)
    select d.document_id, d.filename, d.doc_type, d.version, d.is_latest, d.status, d.error_message, coalesce(total_chunks, 0) as total_chunks, document_cited,
           chunk_id, chunk_index, section, clause, block_type, c.topic, token_count, array_to_string(cited, '|') as cited_sections, form_references, text_md5
    from docs d left join total using (document_id) left join chunks c using (document_id)"""


@query("ingest_corpus", _ingest_sql())
def ingest_corpus(spark, sf):
    """Documents, failed ones too, with their roll-up and chunks, read back from the corpus tables of a committed run."""
    documents, part = view(spark, sf, "documents"), view(spark, sf, "part")
    raw = spark.sql(REGISTER.replace("from documents", "from {documents}").replace("join part", "join {part}"), documents=documents, part=part)
    store = I.CorpusStore(spark, scratch_dir(spark, "corpus"))
    store.ingest(raw, "first", **INGEST_RULES)
    # hashed before the join, which then moves no text
    chunks = store.chunks().drop("doc_type", "doc_version", "year_references").withColumn("text_md5", F.md5("text")).drop("text")
    docs = store.documents().select(
        "document_id", "filename", "doc_type", "version", "is_latest", "status", "error_message", "total_chunks", F.array_join("cited_sections", "|").alias("document_cited"))
    return docs.join(chunks, "document_id", "left").select(
        *docs.columns, "chunk_id", "chunk_index", "section", "clause", "block_type", "topic", "token_count",
        F.array_join("cited_sections", "|").alias("cited_sections"), F.array_join("form_references", "|").alias("form_references"), "text_md5")
