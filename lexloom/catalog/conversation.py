"""Session context, follow-ups, citations and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as AN
from ..functions import conversation as C
from ..functions import topics as TO
from ..operators.sessions import session_context as context_of
from ..plans import prompts as P
from ..rules import sample as X
from .corpus import plain
from .registry import query
from .text import quoted, rule_sql
from .views import check, view

Q_TOPIC = rule_sql("lower(query)", X.TOPICS)
HISTORY = """
    with t as (select session_id, turn, query, answer, TOPIC as topic,
                      'Q: ' || query || chr(10) || 'A: ' || left(coalesce(answer, ''), 1200) as line from {turn_pairs}),
    h as (select session_id, turn, query, topic, coalesce(array_to_string(list(line) over w, chr(10) || chr(10)), '') as history_text,
                 last_value(query) over w as last_query, last_value(topic ignore nulls) over w as last_topic,
                 cast(count(*) over w as int) as turn_count from t
          window w as (partition by session_id order by turn rows between 10 preceding and 1 preceding))""".replace(
    "TOPIC", Q_TOPIC.replace("{", "\u0002").replace("}", "\u0003"))


def over_history(sql: str) -> str:
    return check(HISTORY + sql.replace("{", "\u0002").replace("}", "\u0003")).replace("\u0002", "{").replace("\u0003", "}")


RULES = dict(deictic=X.DEICTIC, question=X.QUESTION, topics=X.TOPICS, flags="")
WORDS = r"len([w for w in string_split_regex(query, '\s+') if w <> ''])"
DEICTIC = f"regexp_matches(query, {quoted(X.DEICTIC)})"
FOLLOWS = f"({DEICTIC} or ({WORDS} <= 12 and topic is null and regexp_matches(query, {quoted(X.QUESTION)})))"


def family(e):
    return f"coalesce(case {e} {' '.join(f'when {quoted(k)} then {quoted(v)}' for k, v in X.FAMILIES.items())} end, {e})"


NEW = (f"(turn_count = 0 or regexp_matches(query, {quoted(X.COMPARE)}) or coalesce({family('topic')} <> {family('last_topic')}, false)"
       f" or ({WORDS} > 12 and not {DEICTIC} and topic is not null))")


def _sessions(spark, sf):
    t = view(spark, sf, "turn_pairs").withColumn("topic", TO.session_topic("query", X.TOPICS, ""))
    return context_of(t)


@query("session_context", over_history(" select session_id, turn, turn_count, last_query, last_topic, history_text from h"))
def session_context(spark, sf):
    return _sessions(spark, sf).select("session_id", "turn", "turn_count", "last_query", "last_topic", "history_text")


@query("session_topic", plain(f"select session_id, turn, {Q_TOPIC} as topic from «turn_pairs»"))
def session_topic(spark, sf):
    return view(spark, sf, "turn_pairs").select("session_id", "turn", TO.session_topic("query", X.TOPICS, "").alias("topic"))


@query("detect_follow_up", over_history(f" select session_id, turn, turn_count > 0 and {FOLLOWS} as is_follow_up from h"))
def detect_follow_up(spark, sf):
    return _sessions(spark, sf).select("session_id", "turn", C.is_follow_up("query", "turn_count", **RULES).alias("is_follow_up"))


def _new_topic(df):
    return df.withColumn("new_topic", C.is_new_topic(
        "query", "turn_count", "last_topic", deictic=X.DEICTIC, compare=X.COMPARE, topics=X.TOPICS, families=X.FAMILIES, flags=""))


@query("detect_new_topic", over_history(f" select session_id, turn, {NEW} as new_topic from h"))
def detect_new_topic(spark, sf):
    return _new_topic(_sessions(spark, sf)).select("session_id", "turn", "new_topic")


SUB = rule_sql("query", [(t, p) for p, t in X.SUBTOPICS])


def _expanded(df):
    return df.withColumn("search_text", C.expand_query("query", "turn_count", "last_query", "new_topic", contexts=X.SUBTOPICS, **RULES))


@query("expand_query", over_history(f"""
    select session_id, turn, case when {NEW} then query when {SUB} is not null then {SUB} || ' ' || query
           when turn_count > 0 and last_query <> '' and ({FOLLOWS} or topic is null) then last_query || ' ' || query else query end as search_text from h"""))
def expand_query(spark, sf):
    return _expanded(_new_topic(_sessions(spark, sf))).select("session_id", "turn", "search_text")


MODE = "case when session_id % 5 = 0 then 'doc_review' when session_id % 5 = 1 then 'compare' else 'standard' end"
FLAGS = f"""
    , f as (select *, {MODE} as mode, {NEW} as new_topic, turn_count > 0 and {MODE} <> 'doc_review' as has_conversation from h),
    g as (select *, has_conversation and not new_topic and {FOLLOWS} as is_follow_up from f),
    k as (select *, is_follow_up and regexp_matches(query, {quoted(X.FORMS_ASKED)}) as is_forms from g)"""


def _flagged(spark, sf):
    d = _new_topic(_sessions(spark, sf)).withColumn("mode", F.expr(MODE))
    return d.withColumn("f", C.flags_struct("query", "turn_count", "new_topic", "mode", forms=X.FORMS_ASKED, **RULES))


@query("conversation_flags", over_history(FLAGS + " select session_id, turn, has_conversation, is_follow_up, is_forms as is_forms_follow_up from k"))
def conversation_flags(spark, sf):
    return _flagged(spark, sf).select("session_id", "turn", "f.*")


@query("forms_follow_up", over_history(f" select session_id, turn, turn_count > 0 and regexp_matches(query, {quoted(X.FORMS_ASKED)}) as forms_follow_up from h"))
def forms_follow_up(spark, sf):
    asks = (F.col("turn_count") > 0) & C.asks_for_forms("query", X.FORMS_ASKED, "")
    return _sessions(spark, sf).select("session_id", "turn", asks.alias("forms_follow_up"))


@query("explicit_subtopic", check(f"""
    select session_id, turn, regexp_matches(query, {quoted('thth|eaueau')}) as names_subtopic,
           regexp_matches(query, {quoted(X.FORMS_ASKED)}) as asks_for_forms from {{turn_pairs}}"""))
def explicit_subtopic(spark, sf):
    return view(spark, sf, "turn_pairs").select(
        "session_id", "turn", C.explicit_subtopic("query", "thth|eaueau", "").alias("names_subtopic"),
        C.asks_for_forms("query", X.FORMS_ASKED, "").alias("asks_for_forms"))


# --- citations: one reference per line of a document -------------------------------
LINE_LABEL = "^(The|La|Der|Le) [a-z]+"


def _lines(make):
    return F.transform(F.split("text", "\n"), make)


@query("dedupe_citations", plain(rf"""
    with r as (select doc_id, lang, [case when regexp_extract(l, '{LINE_LABEL}') <> '' then regexp_extract(l, '{LINE_LABEL}')
                                     else 'USCIS ' || upper(lang) || ' Policy Manual' end for l in string_split(text, chr(10))] as labels from «documents»)
    select doc_id, array_to_string(list_transform(list_filter(list_zip(labels, range(1, len(labels) + 1)), lambda z: list_position(labels, z[1]) = z[2]), lambda z: z[1]), '|') as laws
    from r"""))
def dedupe_citations(spark, sf):
    refs = _lines(lambda x: F.struct(F.regexp_extract(x, LINE_LABEL, 0).alias("label"), F.col("lang").alias("topic")))
    return view(spark, sf, "documents").select("doc_id", F.array_join(AN.law_citations(refs), "|").alias("laws"))


CASE_NAME = "^[A-Z][a-z]{1,2}"


@query("format_citations", plain(rf"""
    with r as (select doc_id, [{{'label': case when regexp_extract(l, '{CASE_NAME}') <> '' then regexp_extract(l, '{CASE_NAME}') else 'Case Ref: ' || left('chunk' || length(l), 8) || '...' end,
                                'url': case when contains(l, 'tion') then 'u/' || (length(l) % 7) else '' end,
                                'name': regexp_extract(l, '{CASE_NAME}'), 'cit': case when contains(l, 'que') then 'C1' else '' end}} for l in string_split(text, chr(10))] as refs from «documents»),
    i as (select doc_id, refs, [x.label for x in refs] as labels from r)
    select doc_id, array_to_string([z[1].label || case when z[1].url <> '' then '|' || z[1].url else '' end
             for z in list_zip(refs, range(1, len(refs) + 1)) if list_position(labels, z[1].label) = z[2]], chr(10)) as cases,
           array_to_string([concat_ws(' — ', nullif(x.name, ''), nullif(x.cit, ''), '2001') for x in refs], chr(10)) as courts from i""".replace("{{", "{").replace("}}", "}")))
def format_citations(spark, sf):
    empty = F.lit("")
    cases = _lines(lambda x: F.struct(
        F.regexp_extract(x, CASE_NAME, 0).alias("label"),
        F.when(x.contains("tion"), F.concat(F.lit("u/"), (F.length(x) % 7).cast("string"))).otherwise(empty).alias("url"),
        F.concat(F.lit("chunk"), F.length(x).cast("string")).alias("chunk_id")))
    courts = _lines(lambda x: F.struct(
        F.regexp_extract(x, CASE_NAME, 0).alias("case_name"), F.when(x.contains("que"), F.lit("C1")).otherwise(empty).alias("citation"),
        empty.alias("court"), F.lit("2001-05-06").alias("date")))
    return view(spark, sf, "documents").select(
        "doc_id", F.array_join(AN.case_citations(cases), "\n").alias("cases"), F.array_join(AN.court_citations(courts), "\n").alias("courts"))


# --- prompts -------------------------------------------------------------------------------
HINT_PATTERNS = {
    "ac21": ["thth"], "i140": ["ing", "tion"], "cap": ["ered"], "cap_topic": ["onth"], "ead": ["eaux"], "eligibility": ["ung"],
    "compare": ["heit"], "filing": ["que"],
}
W = P.WORDING


def _prompt_sql():
    h = P.HEADINGS
    nl = "chr(10)"
    m = lambda ps: " and ".join(f"regexp_matches(query, {quoted(p)})" for p in ps)
    conds = {n: m(ps) for n, ps in HINT_PATTERNS.items()}
    conds["forms"] = "is_forms"
    conds["cap"] = f"{conds['cap']} and ({conds['cap_topic']} or coalesce(topic = 'en', false))"
    hints = f"array_to_string([x for x in [{', '.join(f'case when {conds[n]} then {quoted(chr(45) + chr(32) + t)} end' for n, t in P.HINTS)}] if x is not null], {nl})"
    para = f"{nl} || {nl}"
    system = ("array_to_string([x for x in [" + quoted(W["system"]) + f", case when mode = 'compare' then {quoted(W['compare'])} end, case when mode = 'doc_review' then {quoted(W['doc_review'])} end,"
              f" case when mode = 'standard' and has_conversation then {quoted(W['conversation'])} end, case when mode = 'standard' and is_follow_up then {quoted(W['follow_up'])} end,"
              f" case when mode = 'standard' and is_forms then {quoted(W['forms'])} end] if x is not null], {para})")
    ask = (f"case when mode = 'doc_review' then {quoted(h['review'])} || {nl} || query || {para} || {quoted(W['ask_review'])}"
           f" when is_follow_up then {quoted(h['question'])} || {nl} || query || {para} || {quoted(W['ask_follow_up'])} || case when is_forms then {quoted(W['ask_forms'])} else {quoted(W['ask_no_forms'])} end"
           f" else {quoted(h['question'])} || {nl} || query || {para} || {quoted(W['ask'])} end")
    ctx = "regexp_replace(coalesce(answer, ''), '^\\s+|\\s+$', '', 'g')"
    ref = (f"case when {ctx} <> '' then {quoted(h['reference'] + ' (')} || (length(query) % 4) || ' law sources, 0 case sources)' || {nl} || {quoted(W['use_all'])} || {para} || {ctx}"
           f" else {quoted(h['reference'])} || {nl} || {quoted(W['no_sources'])} end")
    user = ("array_to_string([x for x in [" + f"case when topic is not null then {quoted(h['query'])} || {nl} || 'Visa Category: ' || upper(topic) || {nl} end,"
            f" case when session_id % 3 = 0 then {quoted(h['matter'])} || {nl} || {quoted(W['matter'])} end,"
            f" case when has_conversation and not is_follow_up then {quoted(h['conversation'])} || {nl} || 'Most recent question: ' || last_query || {nl} || {quoted(W['thread'])} end,"
            f" case when is_follow_up then {quoted(h['follow_up'])} || {nl} || 'Prior question: ' || last_query || {nl} || {quoted(W['direct'])} end,"
            f" case when {hints} <> '' then {quoted(h['checklist'])} || {nl} || {hints} end, {ref}, {ask}] if x is not null], {para})")
    return f" select session_id, turn, {system} as system_message, {user} as user_message, length({system}) + length({user}) as total_chars from k join turn_pairs using (session_id, turn, query)"


@query("assemble_prompts", over_history(FLAGS + _prompt_sql()))
def assemble_prompts(spark, sf):
    d = _flagged(spark, sf)
    laws = F.slice(F.sequence(F.lit(1), F.lit(4)), F.lit(1), (F.length("query") % 4).cast("int"))
    p = P.assemble(
        "query", "answer", laws, F.array().cast("array<int>"), "topic", "mode", F.col("f.has_conversation"), F.col("f.is_follow_up"),
        F.col("f.is_forms_follow_up"), "last_query", F.col("session_id") % 3 == 0, patterns=HINT_PATTERNS, cap_topic="en", flags="")
    return d.withColumn("p", p).select("session_id", "turn", "p.system_message", "p.user_message", "p.total_chars")

