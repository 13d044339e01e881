"""Text operators over whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as AN
from ..functions import labels as L
from ..functions import moderation as MO
from ..functions import privacy as P
from ..functions import relevance as R
from ..functions import text as T
from ..functions import topics as TO
from ..rules import domain as D
from ..rules import sample as X
from ..session import spread
from .registry import query
from .views import check, view


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_sql(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def sub_sql(e: str, rules) -> str:
    for p, r in rules:
        e = f"regexp_replace({e}, {quoted(p)}, {quoted(r)}, 'g')"
    return e


def rule_sql(e: str, rules, otherwise: str = "null") -> str:
    arms = " ".join(f"when regexp_matches({e}, {quoted(p)}) then {quoted(v)}" for v, p in rules)
    return f"case {arms} else {otherwise} end"


def any_sql(e: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({e}, {quoted(p)})" for p in patterns) + ")"


def hits_sql(e: str, words) -> str:
    return "(" + " + ".join(f"contains({e}, {quoted(w)})::int" for w in words) + ")"


def tokens_sql(e: str, stops) -> str:
    stop = "(" + ", ".join(quoted(s) for s in stops) + ")"
    clean = rf"regexp_replace(lower({e}), '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g')"
    return (f"list_distinct([w for w in [regexp_replace(x, '^-+|-+$', '', 'g') for x in "
            rf"string_split_regex({clean}, '\s+')] if length(w) >= 3 and w not in {stop}])")


PII_RULES = [(p, f"[REDACTED-{label}]") for label, p in D.PII_PATTERNS]
DIRTY = "replace(replace(text, ', ', ',   '), '. ', '.\n\n\n\n12 \n')"


def documents(spark, sf):
    return view(spark, sf, "documents")


@query("clean_text", check(rf"""
    select doc_id, {strip_sql(sub_sql(DIRTY, [(' {2,}', ' '), ('\n{3,}', '\n\n'), (r'(?m)^\d+\s*$', '')]))} as text from {{documents}}"""
    .replace("{2,}", "{{2,}}").replace("{3,}", "{{3,}}")).replace("{{", "{").replace("}}", "}"))
def clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", T.clean_text(F.expr(DIRTY)).alias("text"))


@query("strip_noise", check(
    "select doc_id, " + strip_sql(sub_sql("text", [("(?i)" + p, "") for p in X.NOISE])) + " as text from {documents}"))
def strip_noise(spark, sf):
    return documents(spark, sf).select("doc_id", T.strip_noise("text", X.NOISE).alias("text"))


@query("extract_headings", check(
    f"select doc_id, array_to_string(regexp_extract_all(text, {quoted('(?i)' + X.CLAUSE)}), '|') as headings, "
    f"len(regexp_extract_all(text, {quoted('(?i)' + X.CLAUSE)})) as n from {{documents}}"))
def extract_headings(spark, sf):
    h = T.headings("text", X.CLAUSE)
    return documents(spark, sf).select("doc_id", F.array_join(h, "|").alias("headings"), F.size(h).alias("n"))


@query("classify_documents", check(f"""
    with s as (select doc_id, text, source, {hits_sql('lower(text)', X.LAW_WORDS)} as l,
                      {hits_sql('lower(text)', X.CASE_WORDS)} as c,
                      case when source = 'src3' then 'given' end as head,
                      case when source = 'src5' then 'uscis_policy' else source end as head_source from {{documents}})
    select doc_id, case when head_source = 'uscis_policy' or l >= c then 'law' else 'case' end as doc_type,
           round(case when head_source = 'uscis_policy' then 0.95 when l + c = 0 then 0.5
                      else greatest(l, c) * 1.0 / (l + c) end, 6) as confidence,
           case when head_source <> 'uscis_policy' and l + c = 0 then null
                else coalesce(head, {rule_sql('text', X.TOPICS)}) end as topic from s"""))
def classify_documents(spark, sf):
    head = F.when(F.col("source") == "src3", "given")
    source = F.when(F.col("source") == "src5", D.TRUSTED_LAW_SOURCE).otherwise(F.col("source"))
    k = TO.classify("text", head, source, X.LAW_WORDS, X.CASE_WORDS, X.TOPICS, flags="")
    return documents(spark, sf).withColumn("k", k).select(
        "doc_id", "k.doc_type", F.round("k.confidence", 6).alias("confidence"), "k.topic")


@query("detect_topic", check(f"select doc_id, {rule_sql('text', X.TOPICS)} as topic from {{documents}}"))
def detect_topic(spark, sf):
    return documents(spark, sf).select("doc_id", TO.detect_topic("text", X.TOPICS, flags="").alias("topic"))


@query("infer_topic", check(f"select doc_id, {rule_sql('lower(text)', X.IMPLIED)} as topic from {{documents}}"))
def infer_topic(spark, sf):
    return documents(spark, sf).select("doc_id", TO.infer_topic("text", X.IMPLIED, "").alias("topic"))


# a question about years from every order
ASK = ("concat(case o_orderpriority when '1-URGENT' then 'cases after ' when '2-HIGH' then 'cases before ' "
       "when '3-MEDIUM' then 'recent cases' when '4-NOT SPECIFIED' then 'cases between ' else 'any case ' end, "
       "case when o_orderpriority in ('3-MEDIUM', '5-LOW') then '' else cast(year(o_orderdate) as string) end, "
       "case when o_orderpriority = '4-NOT SPECIFIED' then concat(' and ', cast(2031 - year(o_orderdate) + 1970 as string)) else '' end)")


@query("detect_year_range", check("""
    select o_orderkey, case o_orderpriority when '1-URGENT' then y when '3-MEDIUM' then 2020
                            when '4-NOT SPECIFIED' then least(y, 4001 - y) end as year_min,
           case o_orderpriority when '2-HIGH' then y when '4-NOT SPECIFIED' then greatest(y, 4001 - y) end as year_max
    from (select o_orderkey, o_orderpriority, year(o_orderdate) as y from {orders})"""))
def detect_year_range(spark, sf):
    y = TO.year_range(F.expr(ASK))
    return view(spark, sf, "orders").withColumn("y", y).select("o_orderkey", "y.year_min", "y.year_max")


@query("extract_chunk_metadata", check(
    "select doc_id, " + rule_sql("text", X.TOPICS) + " as topic, " + ", ".join(
        f"array_to_string(list_sort(list_distinct(regexp_extract_all(text, {quoted(p)}))), '|') as {n}"
        for n, p in (("cited_sections", X.SECTION_REF), ("form_references", X.FORM_REF), ("year_references", X.YEAR_REF)))
    .replace("{2}", "{{2}}").replace("{4}", "{{4}}") + " from {documents}").replace("{{", "{").replace("}}", "}"))
def extract_chunk_metadata(spark, sf):
    m = TO.chunk_metadata("text", X.TOPICS, X.SECTION_REF, X.FORM_REF, X.YEAR_REF, "")
    return documents(spark, sf).withColumn("m", m).select(
        "doc_id", "m.topic", *[F.array_join(f"m.{c}", "|").alias(c) for c in ("cited_sections", "form_references", "year_references")])


@query("token_estimate", check("select doc_id, length(text) // 4 as tokens from {documents}"))
def token_estimate(spark, sf):
    return documents(spark, sf).select("doc_id", T.token_estimate("text").alias("tokens"))


@query("min_length_filters", check(r"""
    select document_id, chunk_index, kind, length(text) as n_chars
    from (select *, case document_id % 4 when 0 then 'chunk' when 1 then 'page' when 2 then 'article' else 'chapter' end as kind from {lines})
    where length(text) >= case kind when 'chunk' then 50 when 'page' then 20 when 'article' then 100 else 200 end"""))
def min_length_filters(spark, sf):
    from ..operators.chunking import long_enough_by_kind

    kinds = F.array(*[F.lit(k) for k in ("chunk", "page", "article", "chapter")])
    lines = view(spark, sf, "lines").withColumn("kind", F.get(kinds, (F.col("document_id") % 4).cast("int")))
    return long_enough_by_kind(lines, "text", "kind").select("document_id", "chunk_index", "kind", F.length("text").alias("n_chars"))


# --- personal data ------------------------------------------------------------
@query("redact_pii", "select doc_id, " + sub_sql("text", PII_RULES) + " as text from documents")
def redact_pii(spark, sf):
    return documents(spark, sf).select("doc_id", P.redact("text").alias("text"))


def _count_sql():
    cols, e = [], "text"
    for (label, p), (_, r) in zip(D.PII_PATTERNS, PII_RULES):
        cols.append(f"len(regexp_extract_all({e}, {quoted(p)})) as n_{label.lower()}")
        e = sub_sql(e, [(p, r)])
    return "select doc_id, " + ", ".join(cols) + " from documents"


@query("pii_entity_counts", _count_sql())
def pii_entity_counts(spark, sf):
    counts = P.entity_counts("text")
    return documents(spark, sf).select("doc_id", counts.alias("c")).select(
        "doc_id", *[F.col("c")[label].alias(f"n_{label.lower()}") for label, _ in D.PII_PATTERNS])


@query("detect_pii_entities")
def detect_pii_entities(spark, sf):
    return P.detect_entities(documents(spark, sf), "doc_id", "text")


@query("pii_prescreen", "select doc_id, " + any_sql("text", [p for _, p in D.PII_PATTERNS]) + " or "
       + " or ".join(f"contains(lower(text), {quoted(w)})" for w in D.PII_PHRASES) + " as suspect from documents")
def pii_prescreen(spark, sf):
    return documents(spark, sf).select("doc_id", P.looks_personal("text").alias("suspect"))


# --- moderation -----------------------------------------------------------------
ALONE = r"(^|[^\p{L}\p{N}_])%s([^\p{L}\p{N}_]|$)"


def _scope_sql(e):
    return "(" + " + ".join(
        f"regexp_matches(lower({e}), {quoted(ALONE % w)})::int" if len(w) <= 4 else f"contains(lower({e}), {quoted(w)})::int"
        for w in X.SCOPE_WORDS) + ")"


@query("scope_score", f"select doc_id, {_scope_sql('text')} as score from documents")
def scope_score(spark, sf):
    return documents(spark, sf).select("doc_id", MO.scope_score("text", X.SCOPE_WORDS, []).alias("score"))


KEYWORDS = list(dict.fromkeys(X.SCOPE_WORDS))


@query("keyword_join", check(f"""
    with k(keyword) as (values {', '.join(f"({quoted(w)})" for w in KEYWORDS)})
    select doc_id, keyword from {{documents}} join k on case when length(keyword) <= 4
      then regexp_matches(lower(text), '(^|[^PLN])' || keyword || '([^PLN]|$)') else contains(lower(text), keyword) end""")
       .replace("PLN", r"\p{L}\p{N}_"))
def keyword_join(spark, sf):
    return documents(spark, sf).select("doc_id", F.explode(MO.matching_keywords("text", KEYWORDS)).alias("keyword"))


@query("moderate_queries", rf"""
    with q as (select doc_id, case when n_chars < 150 then '  ' else text end as q from documents),
    v as (select doc_id, case when {strip_sql('q')} = '' then 'empty' when {any_sql('q', X.BLOCKED)} then 'blocked'
              when len([w for w in string_split_regex(q, '\s+') if w <> '']) > 6 and {_scope_sql('q')} = 0
                   and not {any_sql('q', X.SCOPE_TOPICS)} then 'scope'
              when {any_sql('q', X.WARNING)} then 'warning' else 'safe' end as v from q)
    select doc_id, case when v in ('warning', 'safe') then v else 'blocked' end as status,
           case v when 'empty' then {quoted(D.MODERATION_REASONS['empty'])} when 'blocked' then {quoted(D.MODERATION_REASONS['blocked'])}
                  when 'scope' then {quoted(D.MODERATION_REASONS['scope'])} when 'warning' then {quoted(D.MODERATION_REASONS['warning'])}
           end as reason, v in ('warning', 'safe') as is_safe from v""")
def moderate_queries(spark, sf):
    q = F.when(F.col("n_chars") < 150, "  ").otherwise(F.col("text"))
    m = MO.moderate(q, X.BLOCKED, X.WARNING, X.SCOPE_WORDS, X.SCOPE_TOPICS, [], flags="")
    return documents(spark, sf).withColumn("m", m).select("doc_id", "m.status", "m.reason", "m.is_safe")


# --- answers -----------------------------------------------------------------------
MARKED = ("concat(replace(replace(text, ', ', ', LAW 3 '), ' the ', ' the [CASE 2] ,'), ' certain 555-123-4567 (COURT 1 , ) .')")


@query("sanitize_answers", "select doc_id, " + sub_sql(
    sub_sql(MARKED, PII_RULES),
    [*D.ANSWER_REPAIRS, *[(p, "") for p in D.ANSWER_LABEL_REMOVALS], *D.ANSWER_PUNCTUATION],
) + f" || {quoted(D.DISCLAIMER)} as answer from documents")
def sanitize_answers(spark, sf):
    return documents(spark, sf).select("doc_id", AN.sanitize(F.expr(MARKED)).alias("answer"))


@query("parse_answer_sections", check(rf"""
    with a as (select answer_id, topic, content, {strip_sql('content')} as whole from {{answers}}),
    s as (select answer_id, topic, whole,
      case when topic <> 'es' then {strip_sql(r"regexp_extract(content, '(?s)\*\*ANSWER:\*\*\s*(.*?)\*\*CITED LAWS', 1)")} end as answer,
      {strip_sql(r"regexp_extract(content, '(?s)\*\*CITED LAWS:\*\*\s*(.*?)\*\*IMPORTANT NOTES', 1)")} as laws,
      {strip_sql(r"regexp_extract(content, '(?s)\*\*IMPORTANT NOTES:\*\*\s*(.*?)(\*\*NEXT STEPS:\*\*|\*\*RISKS|\*\*RELATED FORMS:\*\*|$)', 1)")} as notes
      from a)
    select answer_id, coalesce(answer, whole) as answer, answer is not null as is_well_formed,
           case when answer is null then 0 else len(string_split(laws, chr(10))) end as n_laws,
           case when answer is null then '' else 'note ' || topic || '|second' end as notes,
           case when answer is null or topic <> 'en' then 0 else 3 end as n_steps from s"""))
def parse_answer_sections(spark, sf):
    p = AN.parse_sections("content")
    return view(spark, sf, "answers").withColumn("p", p).select(
        "answer_id", "p.answer", "p.is_well_formed", F.size("p.cited_laws").alias("n_laws"),
        F.array_join("p.important_notes", "|").alias("notes"), F.size("p.next_steps").alias("n_steps"))


LIST_TEXT = r"concat('- ', replace(text, '. ', '.\n* '), '\n\n 3. last')"


@query("parse_bullets", rf"""
    select doc_id, array_to_string([i for i in [regexp_replace(regexp_replace(l, '^[-*•]\s+', ''), '^\d+\.\s+', '')
             for l in [{strip_sql('x')} for x in string_split(concat('- ', replace(text, '. ', '.' || chr(10) || '* '), chr(10) || chr(10) || ' 3. last'), chr(10))]
             if l <> ''] if i <> ''], '|') as items from documents""")
def parse_bullets(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(T.bullets(F.expr(LIST_TEXT)), "|").alias("items"))


def _gap_sql():
    g = D.QUALITY_GAPS
    low = "replace(lower(answer), ',', '')"
    gaps = [
        f"case when n_steps = 0 then {quoted(g['no_steps'])} when n_steps < 3 then {quoted(g['few_steps'])} end",
        f"case when n_risks = 0 then {quoted(g['no_risks'])} end",
        f"case when n_forms = 0 then {quoted(g['no_forms'])} end",
        f"case when n_notes = 0 then {quoted(g['no_notes'])} end",
        f"case when law_count = 0 then {quoted(g['no_laws'])} end",
        f"case when case_count = 0 and court_count = 0 then {quoted(g['no_cases'])} end",
    ]
    gaps[2] = gaps[2].replace("{topic}", "' || upper(topic) || '")
    for qp, tp, facts in X.FACTS:
        for fact in facts:
            words = [w for w in fact.split() if len(w) > 3]
            cond = f"regexp_matches(q, {quoted(qp)})" + (f" and regexp_matches(q, {quoted(tp)})" if tp else "")
            gaps.append(f"case when {cond} and {hits_sql(low, words)} < 2 then {quoted(g['fact'].format(fact=fact))} end")
    figs = " or ".join(f"contains({low}, {quoted(x)})" for x in X.FIGURE[1])
    asked = " and ".join(f"regexp_matches(q, {quoted(p)})" for p in X.FIGURE[0])
    gaps.append(f"case when {asked} and not ({figs}) then {quoted(g['figure'])} end")
    return "[g for g in [" + ", ".join(gaps) + "] if g is not null]"


QUALITY_CTES = rf"""
    with base as (select doc_id, text as q, lang as topic, text as answer, lang <> 'es' as formed, n_chars,
        case when lang = 'es' then 0 when lang = 'en' then 3 when lang = 'fr' then 1 else 0 end as n_steps,
        case when lang <> 'es' and n_chars > 1000 then 1 else 0 end as n_risks,
        case when lang = 'de' then 1 else 0 end as n_forms, case when lang = 'es' then 0 else 1 end as n_notes,
        least(n_chars // 1000, 7) as law_count, least(n_chars // 700, 6) as case_count, least(n_chars // 3000, 4) as court_count
        from documents),
    gaps as (select *, {_gap_sql()} as raw_gaps from base),
    scored as (select *, case when formed then raw_gaps else list_prepend({quoted(D.QUALITY_GAPS['malformed'])}, raw_gaps) end as gaps,
        greatest(0::decimal(5,2), 1.00::decimal(5,2) - least(0.08::decimal(5,2) * len(raw_gaps), 0.50::decimal(5,2))
            - case when formed then 0 else 0.2::decimal(5,2) end) as completeness from gaps)"""


def _quality_input(spark, sf):
    words = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("s"), i.cast("string")))
    none = F.array().cast("array<string>")
    some = lambda cond, n=1: F.when(cond, words(F.lit(n))).otherwise(none)
    lang, n = F.col("lang"), F.col("n_chars")
    d = documents(spark, sf)
    part = lambda step, cap: F.least(F.floor(n / step), F.lit(cap))
    return d.select(
        "doc_id", "n_chars", lang.alias("topic"), F.col("text").alias("query"),
        F.struct(
            F.col("text").alias("answer"),
            F.when(lang == "en", words(F.lit(3))).otherwise(some(lang == "fr")).alias("next_steps"),
            some((lang != "es") & (n > 1000)).alias("risks"), some(lang == "de").alias("related_forms"),
            some(lang != "es").alias("important_notes"), (lang != "es").alias("is_well_formed"),
        ).alias("parsed"),
        part(1000, 7).alias("law_count"), part(700, 6).alias("case_count"), part(3000, 4).alias("court_count"),
    )


def _assessed(spark, sf):
    a = AN.assess("query", "topic", "law_count", "case_count", "court_count", fact_checks=X.FACTS, figure_check=X.FIGURE, flags="")
    return _quality_input(spark, sf).withColumn("a", a)


@query("answer_quality", QUALITY_CTES + rf"""
    select doc_id, array_to_string(gaps, '|') as gaps, cast(completeness as double) as completeness,
           case when law_count + case_count + court_count = 0 then 'limited sources' else array_to_string([x for x in [
              case when law_count > 0 then law_count || ' policy source' || case when law_count <> 1 then 's' else '' end end,
              case when case_count > 0 then case_count || ' case precedent' || case when case_count <> 1 then 's' else '' end end,
              case when court_count > 0 then court_count || ' court decision' || case when court_count <> 1 then 's' else '' end end]
              if x is not null], ', ') end as source_summary,
           len(gaps) + n_notes as n_notes from scored""")
def answer_quality(spark, sf):
    return _assessed(spark, sf).select(
        "doc_id", F.array_join("a.gaps", "|").alias("gaps"), F.col("a.completeness").cast("double").alias("completeness"),
        "a.source_summary", F.size("a.notes").alias("n_notes"))


@query("confidence_score", QUALITY_CTES + r""",
    c as (select doc_id, len(gaps) as n_gaps, cast(least(1, greatest(0, round(
        least(law_count, 6) * 0.10::decimal(12,4) + least(case_count, 5) * 0.07::decimal(12,4) + least(court_count, 3) * 0.06::decimal(12,4)
        + case when formed then 0.20::decimal(12,4) else 0 end + case when law_count >= 2 then 0.10::decimal(12,4) else 0 end
        + case when case_count >= 1 or court_count >= 1 then 0.08::decimal(12,4) else 0 end
        + cast(completeness * 0.15::decimal(12,4) as decimal(12,4)) - least(len(gaps) * 0.04::decimal(12,4), 0.20::decimal(12,4)), 2))) as double) as score from scored)
    select doc_id, score,
           case when score >= 0.72 and n_gaps <= 1 then 'high' when score >= 0.45 then 'medium' else 'low' end as level,
           case when score >= 0.72 and n_gaps <= 1 then false when score >= 0.45 then n_gaps >= 3 else true end as needs_review from c""")
def confidence_score(spark, sf):
    c = AN.confidence("law_count", "case_count", "court_count", F.col("parsed.is_well_formed"), F.col("a.completeness"), F.size("a.gaps"))
    return _assessed(spark, sf).withColumn("c", c).select(
        "doc_id", F.col("c.score").cast("double").alias("score"), "c.level", "c.needs_review")


# --- relevance ------------------------------------------------------------------------
@query("tokenize", check("select doc_id, array_to_string(list_sort(" + tokens_sql("text", X.STOP_WORDS)
                         .replace("{", "{{").replace("}", "}}") + "), ' ') as tokens from {documents}").replace("{{", "{").replace("}}", "}"))
def tokenize(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(F.array_sort(T.tokens("text", X.STOP_WORDS)), " ").alias("tokens"))


def _flat(view_sql):
    return check(view_sql)


@query("token_overlap", check("""
    select session_id, turn, len(list_intersect(TQ, TA)) as shared from {turn_pairs} where answer is not null""")
       .replace("TQ", tokens_sql("query", X.STOP_WORDS)).replace("TA", tokens_sql("answer", X.STOP_WORDS)))
def token_overlap(spark, sf):
    shared = F.size(F.array_intersect(T.tokens("query", X.STOP_WORDS), T.tokens("answer", X.STOP_WORDS)))
    return view(spark, sf, "turn_pairs").where(F.col("answer").isNotNull()).select("session_id", "turn", shared.alias("shared"))


RELEVANCE_RULES = dict(stop_words=X.STOP_WORDS, topic_patterns=X.TEXT_PATTERNS, mismatch=X.MISMATCH,
                       question_mismatch=X.QUESTION_MISMATCH, pathway=X.PATHWAY, flags="")


def relevance_sql(text, q, topic, chunk_topic):
    """Score in whole hundredths, so that both engines add exactly."""
    hay = f"regexp_replace(lower({text}), '[_-]+', ' ', 'g')"
    case = lambda table, f, other: "case " + topic + " " + " ".join(
        f"when {quoted(k)} then {f(v)}" for k, v in table.items()) + f" else {other} end"
    count = lambda ps: "(" + " + ".join(f"regexp_matches({hay}, {quoted(p)})::int" for p in ps) + ")"
    about = case(X.TEXT_PATTERNS, lambda ps: any_sql(hay, ps), "null")
    qt, tt = tokens_sql(q, X.STOP_WORDS), tokens_sql(text, X.STOP_WORDS)
    off = " + ".join(f"case when regexp_matches({q}, {quoted(p)}) then {count(ps)} else 0 end" for p, ps in X.QUESTION_MISMATCH)
    gate = case(X.PATHWAY, lambda p: f"regexp_matches({q}, {quoted(p)})", "false")
    return (f"case when len({qt}) = 0 or (coalesce({gate}, false) and not coalesce({about}, false)) then 0 else "
            f"greatest(0, least(len(list_intersect({qt}, {tt})) * 14, 42)"
            f" + case when {about} then 32 when not {about} and {chunk_topic} = {topic} then 22"
            f" when not {about} and {chunk_topic} <> {topic} then -20 else 0 end"
            f" - 50 * coalesce(case when {about} is not null then {case(X.MISMATCH, count, 'null')} end, 0) - 55 * ({off})) end")


@query("score_relevance", check(f"""
    with t as (select session_id, turn, query as q, answer as a, {rule_sql('query', X.TOPICS)} as topic,
                      {rule_sql('answer', X.TOPICS)} as chunk_topic from {{turn_pairs}} where answer is not null)
    select session_id, turn, topic, SCORE / 100.0 as score from t""").replace("SCORE", relevance_sql("a", "q", "topic", "chunk_topic")))
def score_relevance(spark, sf):
    t = view(spark, sf, "turn_pairs").where(F.col("answer").isNotNull())
    topic, chunk = TO.detect_topic("query", X.TOPICS, flags=""), TO.detect_topic("answer", X.TOPICS, flags="")
    return t.withColumn("topic", topic).withColumn("chunk_topic", chunk).select(
        "session_id", "turn", "topic",
        R.score_text("answer", "query", "topic", "chunk_topic", **RELEVANCE_RULES).cast("double").alias("score"))


@query("filter_relevant", check(f"""
    with t as (select session_id, turn, query as q, concat('session_', session_id % 7, ' ', answer) as a,
                      {rule_sql('query', X.TOPICS)} as topic, {rule_sql('answer', X.TOPICS)} as chunk_topic
               from {{turn_pairs}} where answer is not null)
    select * from (select session_id, turn, SCORE / 100.0 as relevance from t) where relevance >= 0.28""")
       .replace("SCORE", relevance_sql("a", "q", "topic", "chunk_topic")))
def filter_relevant(spark, sf):
    from ..plans.retrieval import filter_relevant as keep

    t = view(spark, sf, "turn_pairs").where(F.col("answer").isNotNull()).select(
        "session_id", "turn", F.col("query").alias("query_text"), F.col("answer").alias("text"),
        F.concat(F.lit("session_"), F.col("session_id") % 7).alias("filename"),
        TO.detect_topic("query", X.TOPICS, flags="").alias("topic"), TO.detect_topic("answer", X.TOPICS, flags="").alias("chunk_topic"))
    return keep(t, prefix="filename", **RELEVANCE_RULES).select(
        "session_id", "turn", F.col("relevance").cast("double").alias("relevance"))


def _terms_sql(part="[1:10]"):
    strings = lambda ws: "[" + ", ".join(quoted(w) for w in ws) + "]::varchar[]"
    anchors = "case topic " + " ".join(f"when {quoted(t)} then {strings(ws)}" for t, ws in X.ANCHORS.items()) + " else []::varchar[] end"
    phrases = "".join(f" || case when regexp_matches(text, {quoted(p)}) then {strings(ws)} else []::varchar[] end" for p, ws in X.PHRASES)
    in_order = tokens_sql("text", X.STOP_WORDS).removeprefix("list_distinct(")[:-1]
    step = "case when len([t for t in acc if contains(lower(t), x[1])]) > 0 then acc else list_concat(acc, x) end"
    return f"""
    with q as (select item_id, text, {rule_sql('text', X.TOPICS)} as topic from benchmark),
    s as (select item_id, topic, {anchors}{phrases} as seed, {in_order} as words from q),
    t as (select item_id, topic, list_reduce(list_prepend(seed, [[w] for w in words]), lambda acc, x: {step}) as terms from s)
    select item_id, topic, case when len(terms) = 0 then 'immigration visa' else array_to_string(terms{part}, ' ') end as terms from t"""


@query("build_search_terms", _terms_sql())
def build_search_terms(spark, sf):
    topic = TO.detect_topic("text", X.TOPICS, flags="")
    terms = R.search_terms("text", "topic", anchors=X.ANCHORS, phrases=X.PHRASES, stop_words=X.STOP_WORDS, pathway={}, limit=10, flags="")
    return view(spark, sf, "benchmark").withColumn("topic", topic).select("item_id", "topic", terms.alias("terms"))


# --- labels, keys ---------------------------------------------------------------------
@query("detect_outcome", check("select doc_id, " + "case " + " ".join(
    f"when {' or '.join(f'contains(lower(text), {quoted(w)})' for w in ws)} then {quoted(v)}" for v, ws in X.OUTCOMES)
    + " end as outcome from {documents}"))
def detect_outcome(spark, sf):
    return documents(spark, sf).select("doc_id", TO.outcome("text", X.OUTCOMES).alias("outcome"))


@query("alert_type", check("""
    select page_id, case when contains(url, '/en/') then 'Alert' when contains(url, 'page=') then 'News Release'
           when contains(lower(html), '%%%') then 'Fee Update'
           when contains(lower(html), 'the ') or contains(lower(html), 'und ') then 'Form Update' else 'News' end as alert_type
    from {pages}"""))
def alert_type(spark, sf):
    return view(spark, sf, "pages").select(
        "page_id", TO.alert_type("url", F.lit(""), "html", X.URL_ALERTS, X.TEXT_ALERTS).alias("alert_type"))


# a chapter URL for every order line
CHAPTER = ("concat('https://www.uscis.gov/policy-manual/volume-', cast(l_linenumber + 1 as string), '-part-', "
           "lower(case when l_returnflag = 'R' then 'h' else l_returnflag end), "
           "case when l_linestatus = 'F' then '-chapter-' else '-note-' end, cast(l_suppkey as string))")


@query("parse_policy_url", check(f"""
    with u as (select l_orderkey, l_linenumber, l_linestatus = 'F' as ok, l_linenumber + 1 as vol,
                      lower(case when l_returnflag = 'R' then 'h' else l_returnflag end) as part, l_suppkey as chap from {{lineitem}})
    select l_orderkey, l_linenumber, case when ok then cast(vol as varchar) end as volume, case when ok then part end as part,
           case when ok then cast(chap as varchar) end as chapter,
           case when ok then case concat(vol, part) {' '.join(f"when '{v}{p}' then '{t}'" for v, p, t in D.VOLUME_PART_TOPICS)} end end as topic,
           case when ok then case when concat(vol, part) in ({', '.join(f"'{v}{p}'" for v, p, _ in D.VOLUME_PART_TOPICS)}) then 5 else 4 end else 1 end as n_keys
    from u"""))
def parse_policy_url(spark, sf):
    m = L.policy_url(F.expr(CHAPTER))
    get = lambda k, n: F.element_at("m", k).alias(n)
    return spread(view(spark, sf, "lineitem")).withColumn("m", m).select(
        "l_orderkey", "l_linenumber", get("policy_volume", "volume"), get("policy_part", "part"),
        get("policy_chapter", "chapter"), get("visa_type", "topic"), F.size("m").alias("n_keys"))


@query("url_to_filename", check(
    r"select page_id, regexp_replace(replace(replace(url, 'https://', ''), 'http://', ''), '[^\p{{L}}\p{{N}}_]', '_', 'g') as filename from {pages}"
    .replace("{{", "\u0002").replace("}}", "\u0003")).replace("\u0002", "{").replace("\u0003", "}"))
def url_to_filename(spark, sf):
    return view(spark, sf, "pages").select("page_id", L.url_to_filename("url").alias("filename"))


MANUAL_FILE = ("case when l_returnflag = 'N' then '' when l_linestatus = 'F' then concat('uscis_policy_www_uscis_gov_policy_manual_volume_', "
               "cast(l_linenumber as string), '_part_', lower(l_returnflag), '_chapter_', cast(l_suppkey as string), '.txt') "
               "else concat('Other_volume_', cast(l_linenumber as string), '_x.txt') end")


@query("filename_labels", check(f"""
    with s(v, subject) as (values {', '.join(f"({k}, {quoted(v)})" for k, v in D.VOLUME_SUBJECTS.items())})
    select l_orderkey, l_linenumber,
           case when l_returnflag = 'N' then 'USCIS ' || l_linestatus || ' Policy Manual' else
             'USCIS Policy Manual — Vol. ' || l_linenumber || coalesce(' (' || subject || ')', '') ||
             case when l_linestatus = 'F' then ' — Part ' || l_returnflag || ' — Ch. ' || l_suppkey else '' end end as label
    from {{lineitem}} left join s on s.v = l_linenumber"""))
def filename_labels(spark, sf):
    return spread(view(spark, sf, "lineitem")).select(
        "l_orderkey", "l_linenumber", L.manual_label(F.expr(MANUAL_FILE), "l_linestatus").alias("label"))


CASE_FILE = ("case when l_returnflag = 'N' then '' when l_linestatus = 'F' then concat('aao_www_courtlistener_com_opinion_', "
             "cast(l_orderkey as string), '_matter_of_', lower(l_returnflag), '_', cast(l_suppkey as string), '_.txt') "
             "else concat('bia_decision_', lower(l_returnflag), '.txt') end")


@query("case_labels", check("""
    select l_orderkey, l_linenumber,
           case when l_returnflag = 'N' then 'Immigration Case Precedent'
                when l_linestatus = 'F' then 'Matter of Matter Of ' || l_returnflag || ' ' || l_suppkey || ' (AAO)'
                else 'Matter of Decision  (BIA)' end as label,
           case when l_returnflag <> 'N' and l_linestatus = 'F' then 'https://www.courtlistener.com/opinion/' || l_orderkey || '/matter-of-'
                || lower(l_returnflag) || '-' || l_suppkey || '/' end as url
    from {lineitem}"""))
def case_labels(spark, sf):
    return spread(view(spark, sf, "lineitem")).withColumn("c", L.case_label(F.expr(CASE_FILE))).select(
        "l_orderkey", "l_linenumber", "c.label", "c.url")


@query("content_hash", "select page_id, md5(html) as content_hash from pages")
def content_hash(spark, sf):
    return view(spark, sf, "pages").select("page_id", T.content_hash("html").alias("content_hash"))


@query("query_cache_key", check(r"""
    select audit_id, 'query_cache:' || left(sha256(concat('v2:', coalesce(m.query_mode, 'standard'), ':', trim(lower(a.query)))), 32) as cache_key
    from {audit_logs} a left join {query_meta} m using (audit_id)"""))
def query_cache_key(spark, sf):
    audit, meta = view(spark, sf, "audit_logs"), view(spark, sf, "query_meta")
    rows = audit.select("audit_id", "query").join(meta.select("audit_id", "query_mode"), "audit_id", "left")
    return rows.select("audit_id", T.cache_key("query", F.coalesce("query_mode", F.lit("standard"))).alias("cache_key"))
