"""Scopes, vector search, lexical rescoring, fusion and contexts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import relevance as R
from ..functions import topics as TO
from ..operators import ranking as RA
from ..operators import sections as SE
from ..operators import vectors as V
from ..operators.activity import attach_filenames as attach
from ..operators.cells import CellIndex
from ..plans import context as CO
from ..plans import court_search as CS
from ..plans import retrieval as RE
from ..rules import domain as D
from ..rules import sample as X
from ..session import materialise, scratch_dir
from ..sources.decisions import parse_search_results
from .corpus import DECISION_CTE, RESULT, plain
from .registry import query
from .text import RELEVANCE_RULES, _terms_sql, quoted, relevance_sql, rule_sql, strip_sql, tokens_sql
from .views import VIEWS, check, view, views


def _topic(c="query_text"):
    return TO.question_topic(c, X.QUESTION_TOPICS, X.IMPLIED[1:], "")


TOPIC_SQL = f"coalesce({rule_sql('query_text', X.QUESTION_TOPICS)}, {rule_sql('lower(query_text)', X.IMPLIED[1:])})"
FALLBACK = "case when label <= 3 then 'es' when label <= 6 then 'zz' end"

SCOPE_CTES = """
    own as (select query_id, query_text, embedding, label, TOPIC as own, FALLBACKSQL as fb from questions),
    eff as (select *, coalesce(own, fb) as topic from own),
    present as (select topic, count(*) filter (doc_type = 'law') as laws, count(*) filter (doc_type = 'case') as cases from corpus group by 1),
    scoped as (select e.*, case when coalesce(laws, 0) > 0 then e.topic else '*' end as law_scope,
                      case when coalesce(cases, 0) > 0 then e.topic when own is null then '*' end as case_scope
               from eff e left join present p on p.topic = e.topic),
    members as (select * from (select doc_type, scope, document_id, row_number() over (partition by doc_type, scope order by document_id) as rn
                from (select doc_type, topic as scope, document_id from corpus union all select doc_type, '*', document_id from corpus)))"""


def with_scopes(sql: str, fallback: str = "null") -> str:
    body = SCOPE_CTES.replace("TOPIC", TOPIC_SQL).replace("FALLBACKSQL", fallback)
    return plain("with refs as (select 1 from «questions», «passages», «corpus» where false),\n" + body + sql)


def _scoped(spark, sf, fallback=None):
    questions, corpus = views(spark, sf, "questions", "corpus")
    return RE.question_scopes(questions, corpus, _topic(), F.expr(fallback) if fallback else None)


@query("filter_by_type_topic", check("select document_id from {corpus} where doc_type = 'case' and topic = 'de'"))
def filter_by_type_topic(spark, sf):
    return RE.documents_of(view(spark, sf, "corpus"), "case", "de")


COUNTED = """
    , per as (select doc_type, topic as scope, count(*) as n from corpus group by all union all select doc_type, '*', count(*) from corpus group by all)
    select query_id, s.topic, law_scope, case_scope, coalesce(l.n, 0) as n_laws, coalesce(c.n, 0) as n_cases from scoped s
    left join per l on l.doc_type = 'law' and l.scope = law_scope left join per c on c.doc_type = 'case' and c.scope = case_scope"""


def _counted(spark, sf, scoped):
    corpus = view(spark, sf, "corpus")
    n = F.count(F.lit(1)).alias("n")
    per = corpus.groupBy("doc_type", F.col("topic").alias("scope")).agg(n).unionByName(
        corpus.groupBy("doc_type").agg(n).withColumn("scope", F.lit("*")))
    out = scoped
    for kind in ("law", "case"):
        out = out.join(per.where(F.col("doc_type") == kind).select(F.col("scope").alias(f"{kind}_scope"), F.col("n").alias(f"n_{kind}s")),
                       f"{kind}_scope", "left")
    return out.select("query_id", "topic", "law_scope", "case_scope", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_laws", "n_cases")])


@query("filter_with_fallback", with_scopes(COUNTED))
def filter_with_fallback(spark, sf):
    return _counted(spark, sf, _scoped(spark, sf))


@query("apply_topic_override", with_scopes(COUNTED, FALLBACK))
def apply_topic_override(spark, sf):
    return _counted(spark, sf, _scoped(spark, sf, FALLBACK))


@query("cap_candidate_docs", with_scopes(f" select doc_type, scope, document_id from members where rn <= {D.MAX_SCOPED_DOCS}"))
def cap_candidate_docs(spark, sf):
    return RE.scope_members(view(spark, sf, "corpus").select("doc_type", "topic", "document_id"), D.MAX_SCOPED_DOCS)


# --- vector search ---------------------------------------------------------------
COS = "round(list_cosine_similarity(q.embedding::double[], p.embedding::double[]), 9)"


def dense_sql(k: int = 16, where: str = "true", q: str = "questions", p: str = "passages") -> str:
    return (f"(select * from (select q.query_id, p.chunk_id, {COS} as vector_score, row_number() over (partition by q.query_id "
            f"order by {COS} desc, p.chunk_id) as dense_pos from {q} q join {p} p on {where}) where dense_pos <= {k})")


REFS = "with refs as (select 1 from {questions}, {passages} where false),\n"


@query("knn_cosine", check(REFS + "d as " + dense_sql() + " select query_id, chunk_id, dense_pos, round(vector_score, 6) as vector_score from d"))
def knn_cosine(spark, sf):
    return V.knn(*views(spark, sf, "questions", "passages"), 16).withColumn("vector_score", F.round("vector_score", 6))


@query("knn_approx")
def knn_approx(spark, sf):
    questions, passages = views(spark, sf, "questions", "passages")
    index = CellIndex(spark, scratch_dir(spark, "cell-index"))
    index.build(passages.select("chunk_id", "embedding"))
    return index.search(questions, 16)


def bm25_ctes(cands: str = "cands") -> str:
    w = lambda e: rf"[w for w in string_split_regex(lower({e}), '\s+') if w <> '']"
    return f"""
    bdocs as (select query_id, chunk_id, {w('text')} as t, {w('query_text')} as q from {cands}),
    bstats as (select query_id, count(*) as n, avg(len(t)) as al from bdocs group by 1),
    bdf as (select query_id, w, count(*) as df from (select query_id, unnest(list_distinct(t)) as w from bdocs) group by 1, 2),
    bidf as (select query_id, w, ln(n - df + 0.5) - ln(df + 0.5) as idf from bdf join bstats using (query_id)),
    beps as (select query_id, avg(idf) * 0.25 as eps from bidf group by 1),
    bask as (select query_id, chunk_id, len(t) as dl, w, len([x for x in t if x = w]) as tf
             from (select query_id, chunk_id, t, unnest(q) as w from bdocs)),
    bm as (select d.query_id, d.chunk_id, round(coalesce(s, 0), 9) as bm25 from bdocs d left join (
        select query_id, chunk_id, sum(case when idf < 0 then eps else idf end * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / al))) as s
        from bask join bidf using (query_id, w) join beps using (query_id) join bstats using (query_id) where tf > 0 group by 1, 2) x
        on x.query_id = d.query_id and x.chunk_id = d.chunk_id)"""


def fused_ctes(k: int = 8) -> str:
    return f"""
    norm as (select c.*, bm25, case when max(bm25) over (partition by c.query_id) > 0 then bm25 / max(bm25) over (partition by c.query_id)
                    else bm25 end as bm25_score from cands c join bm using (query_id, chunk_id)),
    ranks as (select *, row_number() over (partition by query_id order by vector_score desc, dense_pos) as r1,
                     row_number() over (partition by query_id order by bm25_score desc, dense_pos) as r2 from norm),
    fused as (select *, 1.0::double / (60 + r1) + 1.0::double / (60 + r2) as score from ranks),
    best as (select * from (select *, row_number() over (partition by query_id order by score desc, dense_pos) as pos from fused) where pos <= {k})"""


CANDS = "cands as (select d.*, p.document_id, p.doc_type, p.text, p.label, q.query_text from dense d join passages p using (chunk_id) join questions q using (query_id))"


def over_dense(sql: str) -> str:
    return plain(REFS.replace("{", "«").replace("}", "»") + "dense as " + dense_sql() + ", " + CANDS + "," + bm25_ctes() + ", " + fused_ctes() + sql)


def _passages_of(spark, sf, ids):
    """The passages whose ``chunk_id`` is among ``ids``: the tables are cut down to them first, so that no other text moves."""
    ids = materialise(ids.select(F.col("chunk_id").alias("_id")).distinct(), "wanted-ids")
    e, d, corpus = views(spark, sf, "embeddings", "documents", "corpus")
    return spark.sql(VIEWS["passages"], embeddings=e.join(ids, e["vec_id"] == ids["_id"], "left_semi"), documents=d.join(ids, d["doc_id"] == ids["_id"], "left_semi"), corpus=corpus)


def _cands(spark, sf):
    questions, passages = views(spark, sf, "questions", "passages")
    dense = V.knn(questions, passages, 16)
    rows = dense.join(_passages_of(spark, sf, dense).drop("embedding", "label"), "chunk_id").join(questions.select("query_id", "query_text"), "query_id")
    return materialise(rows, "candidates")


@query("bm25_rescore", over_dense(" select query_id, chunk_id, round(bm25, 6) as bm25 from bm"))
def bm25_rescore(spark, sf):
    return RA.bm25(_cands(spark, sf), ["query_id"], "chunk_id").select(
        "query_id", "chunk_id", F.round("bm25", 6).alias("bm25"))


def _normed(spark, sf):
    return RA.normalise_by_max(RA.bm25(_cands(spark, sf), ["query_id"], "chunk_id"), ["query_id"], "bm25", "bm25_score")


@query("normalise_by_max", over_dense(" select query_id, chunk_id, round(bm25_score, 6) as bm25_score from norm"))
def normalise_by_max(spark, sf):
    return _normed(spark, sf).select("query_id", "chunk_id", F.round("bm25_score", 6).alias("bm25_score"))


@query("rrf_fuse", over_dense(" select query_id, chunk_id, r1 as dense_rank, r2 as sparse_rank, round(score, 6) as score from fused"))
def rrf_fuse(spark, sf):
    return RA.rrf_fuse(_normed(spark, sf), ["query_id"]).select(
        "query_id", "chunk_id", "dense_rank", "sparse_rank", F.round("score", 6).alias("score"))


@query("hybrid_search", over_dense(
    " select query_id, chunk_id, pos, round(vector_score, 6) as vector_score, round(bm25_score, 6) as bm25_score, round(score, 6) as score from best"))
def hybrid_search(spark, sf):
    out = RE.hybrid_search(*views(spark, sf, "questions", "passages"))
    return out.select("query_id", "chunk_id", "pos", *[F.round(c, 6).alias(c) for c in ("vector_score", "bm25_score", "score")])


def _side_sql(kind: str) -> str:
    """Scoped hybrid search of one source, with its own names for the steps."""
    steps = (
        f"dense as {dense_sql(16, f'p.cell = q.{kind}_scope', 'scoped', f'side_{kind}')}, "
        + CANDS.replace("questions q", "scoped q") + "," + bm25_ctes() + ", " + fused_ctes())
    names = ["dense", "cands", "bdocs", "bstats", "bdf", "bidf", "beps", "bask", "bm", "norm", "ranks", "fused", "best"]
    for n in names:
        steps = re.sub(rf"\b{n}\b(?! as bm25)", f"{n}_{kind}", steps) if n != "dense" else re.sub(r"\bdense\b", f"dense_{kind}", steps)
    side = f"side_{kind} as (select p.*, m.scope as cell from passages p join members m on m.document_id = p.document_id and m.doc_type = '{kind}')"
    return f", {side}, {steps}"


@query("retrieve", with_scopes(_side_sql("law") + _side_sql("case") + """
    select query_id, 'law' as source, chunk_id, pos, round(score, 6) as score from best_law
    union all select query_id, 'case', chunk_id, pos, round(score, 6) from best_case""", FALLBACK))
def retrieve(spark, sf):
    corpus, passages = views(spark, sf, "corpus", "passages")
    out = RE.retrieve(_scoped(spark, sf, FALLBACK), corpus, passages)
    return out.select("query_id", "source", "chunk_id", "pos", F.round("score", 6).alias("score"))


@query("best_chunk_per_doc", over_dense("""
    , n as (select *, count(*) over (partition by query_id) as n, row_number() over (partition by query_id, document_id order by vector_score desc, dense_pos) as rn,
                   min(dense_pos) over (partition by query_id, document_id) as seen from cands)
    select query_id, chunk_id, pos from (select query_id, chunk_id, row_number() over (partition by query_id order by vector_score desc, seen) as pos
    from n where rn = 1) where pos <= 5"""))
def best_chunk_per_doc(spark, sf):
    c = _cands(spark, sf).withColumn("score", F.col("vector_score")).withColumnRenamed("dense_pos", "pos")
    return RA.best_chunk_per_doc(c, ["query_id"]).select("query_id", "chunk_id", "pos")


@query("rerank_top_n", over_dense("""
    , g as (select *, length(text) / 1000.0 as ext, count(*) over (partition by query_id, label) as n from cands)
    select query_id, label, chunk_id, new_pos as pos, round(case when n > 2 then ext else vector_score end, 6) as score
    from (select *, row_number() over (partition by query_id, label order by case when n > 2 then -ext end, dense_pos) as new_pos from g) where new_pos <= 6"""))
def rerank_top_n(spark, sf):
    labels = view(spark, sf, "passages").select("chunk_id", "label")
    c = _cands(spark, sf).join(labels, "chunk_id").withColumn("score", F.col("vector_score")).withColumnRenamed("dense_pos", "pos")
    out = RA.rerank_top_n(c.withColumn("ext", F.length("text") / 1000), ["query_id", "label"], scorer="ext")
    return out.select("query_id", "label", "chunk_id", "pos", F.round("score", 6).alias("score"))


@query("attach_filenames", check("""
    select p.chunk_id, p.document_id, coalesce(c.filename, '') as filename
    from {passages} p left join (select * from {corpus} where status = 'completed') c on c.document_id = p.document_id"""))
def attach_filenames(spark, sf):
    passages, corpus = views(spark, sf, "passages", "corpus")
    return attach(passages.select("chunk_id", "document_id"), corpus.where(F.col("status") == "completed"))


@query("merge_case_sources", check("""
    with h as (select user_id, cast(floor(value) as bigint) as case_id, event_id as pos, case event_type when 'purchase' then 0 else 1 end as p
               from {events} where event_type in ('purchase', 'view')),
    f as (select * from h qualify row_number() over (partition by user_id, case_id order by p, pos) = 1),
    n as (select *, count(*) filter (p = 0) over (partition by user_id) as n from f)
    select user_id, case_id, row_number() over (partition by user_id order by p, pos) as pos from n where p = 0 or n < 12"""))
def merge_case_sources(spark, sf):
    e = view(spark, sf, "events").select("user_id", F.floor("value").alias("case_id"), F.col("event_id").alias("pos"), "event_type")
    side = lambda t: e.where(F.col("event_type") == t).drop("event_type")
    return RA.merge_sources(side("purchase"), side("view"), "user_id", "case_id", "pos", 12)


# --- sections -----------------------------------------------------------------------
REF = "(?i)" + X.SECTION_REF
MAPS = f"""
    found as (select chunk_id, unnest(list_distinct(regexp_extract_all(text, {quoted(REF)}))) as ref from passages),
    refs_new as (select ref, min(chunk_id) as c from found where ref not like 'El%' group by 1),
    vecs as (select ref as query_id, embedding from refs_new join passages on chunk_id = c),
    laws as (select * from passages where doc_type = 'law'),
    near as {dense_sql(1, "true", "vecs", "laws")},
    maps as (select query_id as old_section_ref, chunk_id as current_chunk_id, filename as current_section, '1' as current_doc_version, vector_score as similarity_score
             from near join passages using (chunk_id) where vector_score > 0.75)"""


def _referring(spark, sf):
    """Passages with the distinct references of their texts in place of the texts, which are read where they lie."""
    e, d, corpus = views(spark, sf, "embeddings", "documents", "corpus")
    found = d.withColumn("text", F.array_distinct(TO.section_refs("text", X.SECTION_REF)))
    rows = spark.sql(VIEWS["passages"], embeddings=e, documents=found, corpus=corpus)
    return materialise(rows.withColumnRenamed("text", "refs").withColumn("section", F.col("filename")).drop("label"), "chunks")


def _mappings(spark, sf):
    passages = _referring(spark, sf)
    refs = SE.reference_list(passages, None, X.SECTION_REF)
    known = refs.where(F.col("ref").startswith("El")).select(F.col("ref").alias("old_section_ref"))
    new = SE.reference_list(passages, known, X.SECTION_REF)
    first = passages.select("chunk_id", F.explode("refs").alias("ref")).groupBy("ref").agg(F.min("chunk_id").alias("chunk_id"))
    vecs = first.join(passages.select("chunk_id", "embedding"), "chunk_id").select("ref", "embedding")
    return SE.map_sections(new, vecs, passages.where(F.col("doc_type") == "law"))


@query("map_sections", plain(REFS.replace("{", "«").replace("}", "»") + MAPS + """
    select old_section_ref, current_chunk_id, current_section, current_doc_version, round(similarity_score, 6) as similarity_score from maps"""))
def map_sections(spark, sf):
    return _mappings(spark, sf).withColumn("similarity_score", F.round("similarity_score", 6))


# a run that brings the French passages and replaces the law files of some sources; mappings are left from the run before
_OLD, _STAYS = "chunk_topic <> 'fr'", "not (doc_type = 'law' and filename like 'src2%')"


def _remap_sql():
    pick = "query_id as old_section_ref, chunk_id as current_chunk_id, filename as current_section, vector_score as similarity_score"
    best = lambda refs, laws: (
        f"(select {pick} from {dense_sql(1, 'true', f'(select * from vecs where query_id in (select ref from {refs}))', laws)} join passages using (chunk_id) where vector_score > 0.75)")
    return plain(REFS.replace("{", "«").replace("}", "»") + f"""
    found as (select chunk_id, chunk_topic, unnest(list_distinct(regexp_extract_all(text, {quoted(REF)}))) as ref from passages),
    vecs as (select ref as query_id, embedding from (select ref, min(chunk_id) as c from found group by 1) join passages on chunk_id = c),
    before_refs as (select distinct ref from found where {_OLD}),
    before_laws as (select * from passages where doc_type = 'law' and {_OLD}),
    laws as (select * from passages where doc_type = 'law' and {_STAYS}),
    added as (select * from laws where not ({_OLD})),
    maps as (select * from {best('before_refs', 'before_laws')}),
    live as (select * from maps where current_chunk_id in (select chunk_id from laws)),
    gone as (select * from maps where current_chunk_id not in (select chunk_id from laws)),
    unmapped as (select distinct ref, ref in (select ref from before_refs) and ref not in (select old_section_ref from gone) as waits
                 from found where ref not in (select old_section_ref from live)),
    fresh as (select * from {best('(select ref from unmapped where not waits)', 'laws')} union all select * from {best('(select ref from unmapped where waits)', 'added')}),
    result as (select *, 'kept' as change from live
               union all select *, case when old_section_ref in (select old_section_ref from gone) then 'moved' else 'added' end from fresh
               union all select *, 'retracted' from gone where old_section_ref not in (select old_section_ref from fresh))
    select old_section_ref, current_chunk_id, current_section, round(similarity_score, 6) as similarity_score, change from result""")


@query("remap_after_ingest", _remap_sql())
def remap_after_ingest(spark, sf):
    """Mappings after a run that added and replaced law chunks, from those before it."""
    chunks = _referring(spark, sf)
    found = chunks.select("chunk_id", "chunk_topic", F.explode("refs").alias("ref"))
    first = found.groupBy("ref").agg(F.min("chunk_id").alias("chunk_id"))
    vecs = materialise(first.join(chunks.select("chunk_id", "embedding"), "chunk_id").select("ref", "embedding"), "ref-vectors")
    law = chunks.where(F.col("doc_type") == "law")
    known = found.where(_OLD).select("ref").distinct()
    before = materialise(SE.map_sections(known, vecs, law.where(_OLD)), "mappings")
    now = law.where(_STAYS)
    out = SE.refresh_mappings(before, known, found.select("ref"), vecs, now, now.where(f"not ({_OLD})"))
    return out.select("old_section_ref", "current_chunk_id", "current_section", F.round("similarity_score", 6).alias("similarity_score"), "change")


@query("resolve_section_refs", plain(REFS.replace("{", "«").replace("}", "»") + MAPS + f"""
    , dense as {dense_sql()}, {CANDS},
    one as (select *, regexp_extract_all(text, {quoted(REF)})[1] as ref from cands),
    j as (select o.*, m.current_section, p.text as now, m.old_section_ref is not null as hit,
                 sum((m.old_section_ref is not null)::int) over (partition by query_id order by dense_pos) as nth
          from one o left join maps m on m.old_section_ref = o.ref left join passages p on p.chunk_id = m.current_chunk_id)
    select query_id, chunk_id, hit and nth <= 2 as resolved, md5(case when hit and nth <= 2 then text || chr(10) || chr(10) || '[CURRENT EQUIVALENT OF ''' || ref || ''': '
           || current_section || ' (v1)]' || chr(10) || '[CURRENT POLICY TEXT: ' || left(now, 500) || '...]' else text end) as text_md5 from j"""))
def resolve_section_refs(spark, sf):
    cands, maps = _cands(spark, sf), materialise(_mappings(spark, sf), "mappings")
    asked = cands.select(F.explode(TO.section_refs("text", X.SECTION_REF)).alias("old_section_ref"))
    targets = maps.join(asked, "old_section_ref", "left_semi").select(F.col("current_chunk_id").alias("chunk_id"))
    out = SE.resolve_refs(cands, maps, _passages_of(spark, sf, targets), pos="dense_pos", pattern=X.SECTION_REF)
    return out.select("query_id", "chunk_id", "resolved", F.md5("text").alias("text_md5"))


# --- contexts ------------------------------------------------------------------------
def trim_sql(t, n):
    cut = f"left({t}, {n})"
    last = f"(length({cut}) - strpos(reverse({cut}), chr(10) || chr(10)) - 1)"
    ok = f"strpos(reverse({cut}), chr(10) || chr(10)) > 0 and {last} > {n} * 0.8"
    return (f"case when length({t}) <= {n} then {t} else case when {ok} then left({cut}, {last}) else {cut} end "
            f"|| chr(10) || chr(10) || '[Context trimmed due to length limit]' end")


PARAS = "replace(text, '. ', '.\n\n')"


@query("trim_context", f"select doc_id, {trim_sql('t', 2000)} as text from (select doc_id, {PARAS} as t from documents)")
def trim_context(spark, sf):
    return view(spark, sf, "documents").select("doc_id", CO.trim_context(F.expr(PARAS), 2000).alias("text"))


@query("build_context", over_dense(f"""
    , l as (select query_id, string_agg('[LAW ' || rn || '] USCIS Policy Manual' || chr(10) || {strip_sql('text')}, chr(10) || chr(10) order by rn) as t, count(*) as n
            from (select *, row_number() over (partition by query_id order by dense_pos) as rn from cands where doc_type = 'law') group by 1),
    c as (select query_id, string_agg('[CASE ' || rn || '] Matter of Decision  (BIA)' || chr(10) || {strip_sql('text')}, chr(10) || chr(10) order by rn) as t, count(*) as n
          from (select *, row_number() over (partition by query_id order by dense_pos) as rn from cands where doc_type = 'case') group by 1),
    f as (select q.query_id, coalesce('## RELEVANT LAWS AND POLICIES' || chr(10) || chr(10) || l.t || chr(10) || chr(10), '')
            || coalesce('## RELEVANT CASE PRECEDENTS' || chr(10) || chr(10) || c.t || chr(10) || chr(10), '') as t,
            coalesce(l.n, 0) as n_laws, coalesce(c.n, 0) as n_cases from questions q left join l using (query_id) left join c using (query_id))
    select query_id, n_laws, n_cases, {trim_sql('t', 36000)} as context_text from f"""))
def build_context(spark, sf):
    c = _cands(spark, sf).withColumnRenamed("dense_pos", "pos").withColumn("topic", F.col("chunk_topic")).withColumn("score", F.col("vector_score"))
    out = CO.build_context(view(spark, sf, "questions"), c.where(F.col("doc_type") == "law"), c.where(F.col("doc_type") == "case"))
    size = lambda x, n: F.coalesce(F.size(F.when(F.col(x).isNotNull(), F.col(x))), F.lit(0)).alias(n)
    return out.select("query_id", F.greatest(size("law_refs", "n_laws"), F.lit(0)).alias("n_laws"),
                      F.greatest(size("case_refs", "n_cases"), F.lit(0)).alias("n_cases"), "context_text")


def contexts(spark, sf):
    corpus, passages = views(spark, sf, "corpus", "passages")
    scoped = _scoped(spark, sf, FALLBACK).withColumn("search_text", F.col("query_text"))
    return RE.answer_contexts(scoped, corpus, passages, _mappings(spark, sf), section_pattern=X.SECTION_REF, **RELEVANCE_RULES)


def _numbered_sql(table, tag, label, text="text"):
    body = f"'[{tag} ' || nth_row || '] {label}' || chr(10) || {strip_sql(text)}"
    return (f"(select query_id, string_agg({body}, chr(10) || chr(10) order by nth_row) as t, count(*) as n "
            f"from (select *, row_number() over (partition by query_id order by pos) as nth_row from {table}) group by 1)")


def _contexts_sql():
    score = lambda text: relevance_sql(text, "query_text", "topic", "chunk_topic")
    named = "filename || ' ' || text2"
    steps = f"""
    , six as (select b.query_id, b.chunk_id, b.document_id, b.score, b.pos, b.text, b.query_text, s.topic, p.chunk_topic, p.filename
              from best_case b join scoped s using (query_id) join passages p using (chunk_id) where b.pos <= 6),
    cn as (select *, count(*) over (partition by query_id) as n, row_number() over (partition by query_id, document_id order by score desc, pos) as rn,
                  min(pos) over (partition by query_id, document_id) as seen from six),
    co as (select * exclude (pos), row_number() over (partition by query_id order by case when n > 5 then -score end, case when n > 5 then seen else pos end) as pos
           from cn where n <= 5 or rn = 1),
    c1 as (select * from (select *, {score('text')} as r1 from co where n <= 5 or pos <= 5) where r1 >= 28),
    cr as (select c1.*, m.current_section, now.text as now_text, m.old_section_ref is not null as hit,
                  sum((m.old_section_ref is not null)::int) over (partition by c1.query_id order by c1.pos) as nth
           from (select *, regexp_extract_all(text, {quoted(REF)})[1] as ref from c1) c1
           left join maps m on m.old_section_ref = c1.ref left join passages now on now.chunk_id = m.current_chunk_id),
    c2 as (select *, case when hit and nth <= 2 then text || chr(10) || chr(10) || '[CURRENT EQUIVALENT OF ' || chr(39) || ref || chr(39) || ': ' || current_section
                     || ' (v1)]' || chr(10) || '[CURRENT POLICY TEXT: ' || left(now_text, 500) || '...]' else text end as text2 from cr),
    c3 as (select * from (select *, {score(named)} as r2 from c2) where r2 >= 28),
    l3 as (select query_id, text, pos from best_law where pos <= 6),
    lt as {_numbered_sql('l3', 'LAW', 'USCIS Policy Manual')},
    ct as {_numbered_sql('c3', 'CASE', 'Matter of Decision  (BIA)', 'text2')},
    f as (select s.query_id, coalesce('## RELEVANT LAWS AND POLICIES' || chr(10) || chr(10) || lt.t || chr(10) || chr(10), '')
            || coalesce('## RELEVANT CASE PRECEDENTS' || chr(10) || chr(10) || ct.t || chr(10) || chr(10), '') as t,
            coalesce(lt.n, 0) as n_laws, coalesce(ct.n, 0) as n_cases from scoped s left join lt using (query_id) left join ct using (query_id))
    select query_id, n_laws, n_cases, length(context_text) // 4 as tokens, context_text
    from (select query_id, n_laws, n_cases, {trim_sql('t', 36000)} as context_text from f)"""
    return with_scopes(_side_sql("law") + _side_sql("case") + ", " + MAPS + steps, FALLBACK)


@query("answer_contexts", _contexts_sql())
def answer_contexts(spark, sf):
    c = contexts(spark, sf)
    n = lambda x: F.greatest(F.size(x), F.lit(0))
    return c.select("query_id", n("law_refs").alias("n_laws"), n("case_refs").alias("n_cases"), "tokens", "context_text")


# --- court decisions -------------------------------------------------------------------
COURT_RULES = dict(
    text_rules={k: v for k, v in RELEVANCE_RULES.items() if k != "flags"},
    court_rules=dict(stop_words=X.STOP_WORDS, anchors=X.ANCHORS, mismatch=X.COURT_MISMATCH),
    token_rules=dict(stop_words=X.STOP_WORDS, anchors=X.ANCHORS), flags="", pathway=X.PATHWAY,
)


def _court_parts():
    def plain_tokens(words):
        out = []
        for w in words:
            out += [t for t in re.sub(r"[^\w\s-]", " ", w.lower()).split() if len(t.strip("-")) >= 3 and t not in X.STOP_WORDS]
        return list(dict.fromkeys(out))

    extra = "case topic " + " ".join(
        f"when {quoted(t)} then [{', '.join(quoted(x) for x in plain_tokens(ws))}]" for t, ws in X.ANCHORS.items()) + " else [] end"
    phrase = " + ".join("case " + " ".join(
        f"when contains(low, {quoted(p.lower())}) then case when len([t for t in asked if contains({quoted(p.lower())}, t)]) > 0 then 0.2::double else 0 end"
        for p in ps) + " else 0 end" for ps in X.ANCHORS.values())
    wrong = "case topic " + " ".join(
        f"when {quoted(t)} then " + " + ".join(f"regexp_matches(low, {quoted(p)})::int" for p in ps) for t, ps in X.COURT_MISMATCH.items()) + " else 0 end"
    cites = "[t for t in [" + ", ".join(f"case when contains(lower(answer), {quoted(w[0])}) then {quoted(t)} end" for t, w in X.COURT_TOPIC_WORDS.items()) + "] if t is not null]"
    return extra, phrase, wrong, cites


_EXTRA, _PHRASE, _WRONG, _CITES = _court_parts()
COURT_SQL = plain("""
    with refs as (select 1 from «turn_pairs» where false),
    t as (select session_id, turn, query as q, answer, 'case ' || session_id || ' ' || answer as a, lower('case ' || session_id || ' ' || answer) as low,
        QTOPIC as topic, CITES as cites, case when length(answer) > 600 then 'bia' else 'ca9' end as court, length(answer) / 1000.0::double as prior
        from turn_pairs where answer is not null),
    k as (select *, list_distinct(TOKQ || EXTRA) as asked from t),
    s as (select *, SCORE / 100.0::double as ts,
        case when len(asked) = 0 then 0 else greatest(0, least(len(list_intersect(asked, TOKA)) * 0.12::double, 0.48::double) + PHRASE - 0.45::double * (WRONG)
          + case when topic is null then 0 when list_contains(cites, topic) then 0.28::double when len(cites) > 0 then -0.15::double else 0 end
          + case when court = 'bia' then 0.08::double else 0 end
          + case when len([x for x in asked if contains(lower(answer), x)]) > 0 then 0.1::double else 0 end + least(prior * 0.05::double, 0.1::double)) end as cs from k),
    r as (select *, round(greatest(ts, cs * 0.85::double), 9) as score, topic = 'de' and regexp_matches(q, 'pf') as strict from s)
    select session_id, turn, rank, round(score, 3) as relevance_score from (
      select *, row_number() over (partition by session_id order by score desc, turn) as rank from r
      where score >= case when coalesce(strict, false) then 0.30 else 0.22 end) where rank <= 2"""
    .replace("QTOPIC", rule_sql("query", X.TOPICS)).replace("CITES", _CITES).replace("EXTRA", _EXTRA).replace("PHRASE", f"({_PHRASE})")
    .replace("WRONG", _WRONG).replace("TOKQ", tokens_sql("q", X.STOP_WORDS)).replace("TOKA", tokens_sql("low", X.STOP_WORDS))
    .replace("SCORE", relevance_sql("a", "q", "topic", "null")))


@query("score_court_cases", COURT_SQL)
def score_court_cases(spark, sf):
    t = view(spark, sf, "turn_pairs").where(F.col("answer").isNotNull())
    low = F.lower("answer")
    cites = F.filter(F.array(*[F.when(low.contains(w[0]), F.lit(k)) for k, w in X.COURT_TOPIC_WORDS.items()]), lambda x: x.isNotNull())
    cands = t.select(
        "session_id", "turn", F.col("turn").alias("pos"), F.col("query").alias("query_text"),
        TO.detect_topic("query", X.TOPICS, flags="").alias("topic"), F.concat(F.lit("case "), F.col("session_id").cast("string")).alias("case_name"),
        F.col("answer").alias("summary"), F.when(F.length("answer") > 600, "bia").otherwise("ca9").alias("court"), cites.alias("case_topics"),
        (F.length("answer") / 1000).alias("prior"))
    return CS.rank_decisions(cands, 2, "session_id", **COURT_RULES).select("session_id", "turn", "rank", "relevance_score")


# the words a search compares, and the same pieces of ranking as above over questions and decisions
SEARCH_WORDS = """list_distinct([w for w in [regexp_replace(x, '["(),.]', '', 'g') for x in string_split_regex(lower(TEXT), '\\s+')] if w <> ''])"""
COURT_LISTS = {"near": ["bia"], "far": ["ca9", "bia", "zz"], "open": ["ca9", "bia", "zz", "scotus"], "second": ["bia", "ca9"]}
SECOND_TERMS = "keit ung die"


def _search_sql():
    cites = _CITES.replace("lower(answer)", "lower(name || ' ' || snip)")
    courts = " union all ".join(f"select '{side}' as side, '{c}' as court" for side, ids in COURT_LISTS.items() for c in ids)
    ranked = lambda raw: f"""(
        select query_id, case_id, name, court, row_number() over (partition by query_id order by score desc, pos) as rank, round(score, 3) as relevance_score from (
          select *, round(greatest(ts, cs * 0.85::double), 9) as score from (
            select *, {relevance_sql('a', 'q', 'topic', 'null')} / 100.0::double as ts,
              case when len(asked) = 0 then 0 else greatest(0, least(len(list_intersect(asked, {tokens_sql('low', X.STOP_WORDS)})) * 0.12::double, 0.48::double) + ({_PHRASE}) - 0.45::double * ({_WRONG})
                + case when topic is null then 0 when list_contains(cites, topic) then 0.28::double when len(cites) > 0 then -0.15::double else 0 end
                + case when court = 'bia' then 0.08::double else 0 end
                + case when len([x for x in asked if contains(lower(snip), x)]) > 0 then 0.1::double else 0 end + least(prior * 0.05::double, 0.1::double)) end as cs
            from (select w.query_id, w.pos, asked.*, d.* from {raw} w join asked on asked.item_id = w.query_id join d using (case_id))))
        where score >= case when coalesce(strict, false) then 0.30 else 0.22 end qualify rank <= 5)"""
    return DECISION_CTE + f""",
    d as (select case_id, name, snip, name || ' ' || snip as a, lower(name || ' ' || snip) as low, {cites} as cites,
                 case lang when 'en' then 'bia' when 'de' then 'ca9' when 'fr' then 'zz' else 'scotus' end as court,
                 case when lang = 'en' then n_chars / 1000.0::double else 0.5::double end as prior from r),
    terms as ({_terms_sql('')}),
    asked as (select item_id, text as q, terms, topic, coalesce(topic = 'de' and regexp_matches(text, 'pf'), false) as strict,
                     list_distinct({tokens_sql('text', X.STOP_WORDS)} || {_EXTRA}) as asked from terms join benchmark using (item_id)),
    searches as (select item_id as query_id, side, words from (select item_id, unnest(case when topic in ('en', 'fr', 'de') then ['near', 'far'] else ['open'] end) as side, {SEARCH_WORDS.replace('TEXT', 'terms')} as words from asked)
                 union all select item_id, 'second', {SEARCH_WORDS.replace('TEXT', quoted(SECOND_TERMS))} from asked where strict),
    lists as ({courts}),
    dw as (select case_id, court, unnest({SEARCH_WORDS.replace('TEXT', 'a')}) as word from d),
    hits as (select query_id, side, case_id, row_number() over (partition by query_id, side order by count(*) desc, case_id) as pos
             from (select query_id, side, unnest(words) as word from searches) s join lists using (side) join dw using (court, word)
             group by query_id, side, case_id qualify pos <= 20),
    near as (select query_id, count(*) as n from hits where side = 'near' group by 1),
    raw as (select query_id, case_id, row_number() over (partition by query_id order by p, pos) as pos from (
              select *, row_number() over (partition by query_id, case_id order by p, pos) as rn from (
                select query_id, case_id, pos, 0 as p from hits where side = 'near' union all
                select query_id, case_id, pos, 1 from hits left join near using (query_id) where side = 'far' and coalesce(n, 0) < 5)) where rn = 1
            union all select query_id, case_id, pos from hits where side = 'open'),
    first_pass as materialized {ranked('raw')},
    short as (select item_id as query_id from asked left join (select query_id, count(*) as n from first_pass group by 1) on query_id = item_id where strict and coalesce(n, 0) < 5),
    more as (select query_id, case_id, row_number() over (partition by query_id order by p, pos) as pos from (
               select *, row_number() over (partition by query_id, case_id order by p, pos) as rn from (
                 select *, 0 as p from raw semi join short using (query_id) union all
                 select query_id, case_id, pos, 1 from hits semi join short using (query_id) where side = 'second')) where rn = 1)
    select query_id, case_id, name as case_name, court, rank, relevance_score from first_pass anti join short using (query_id)
    union all select query_id, case_id, name, court, rank, relevance_score from {ranked('more')}"""


@query("search_cases", _search_sql())
def search_cases(spark, sf):
    questions = view(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    questions = questions.withColumn("topic", TO.detect_topic("query_text", X.TOPICS, flags="")).withColumn(
        "terms", R.search_terms("query_text", "topic", anchors=X.ANCHORS, phrases=X.PHRASES, stop_words=X.STOP_WORDS, pathway={}, flags=""))
    decisions = materialise(parse_search_results(
        view(spark, sf, "documents").select(F.expr(RESULT).alias("result")), topic_words=X.COURT_TOPIC_WORDS, outcomes=X.OUTCOMES), "decisions")
    out = CS.search_decisions(questions, decisions, ["en", "fr", "de"], primary=COURT_LISTS["near"], broader=COURT_LISTS["far"], every=COURT_LISTS["open"],
                              second=COURT_LISTS["second"], second_terms=SECOND_TERMS, **COURT_RULES)
    return out.select("query_id", "case_id", "case_name", "court", "rank", "relevance_score")
