"""Search and ranking of court decisions for whole tables of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.relevance import court_overlap_score, court_query_tokens, score_text
from ..functions.text import lit_or_col, strip
from ..operators.postings import WordIndex
from ..operators.ranking import merge_sources
from ..operators.skew import first_per_key, one_per_key
from ..rules import domain as D
from ..session import materialise, scratch_dir


def rank_decisions(cands: DataFrame, wanted: int = 5, group: str = "query_id", pathway=D.REQUIRED_PATHWAY,
                   min_score: str = D.MIN_COURT_SCORE, min_pathway_score: str = D.MIN_PATHWAY_COURT_SCORE,
                   text_rules: dict | None = None, court_rules: dict | None = None, token_rules: dict | None = None,
                   flags: str = D.I) -> DataFrame:
    """Score each (question, decision), drop weak ones, keep the best ``wanted`` per question.

    The score is the larger of text relevance and 85 % of the word, phrase and topic evidence.
    """
    text = F.concat_ws(" ", F.coalesce("case_name", F.lit("")), F.coalesce("summary", F.lit("")))
    scored = cands.withColumn(
        "_asked", court_query_tokens("query_text", "topic", **(token_rules or {}))
    ).withColumn("_text_score", score_text(text, "query_text", "topic", flags=flags, **(text_rules or {})).cast("double")).withColumn(
        "_court_score",
        court_overlap_score("case_name", "summary", "court", "case_topics", "prior", "_asked", "topic", flags=flags,
                            **(court_rules or {})),
    )
    strict = F.lit(False)
    for t, p in (pathway or {}).items():
        strict = strict | F.coalesce((F.col("topic") == t) & F.col("query_text").rlike(flags + p), F.lit(False))
    floor = F.when(strict, F.lit(float(min_pathway_score))).otherwise(F.lit(float(min_score)))
    score = F.round(F.greatest(F.col("_text_score"), F.col("_court_score") * 0.85), 9)
    # the floor sits inside the expression, so that no pushed-down filter scores the text twice
    best = scored.withColumn("relevance_score", F.explode(F.filter(F.array(score), lambda s: s >= floor)))
    kept = first_per_key(best, [group], [F.desc("relevance_score"), "pos"], wanted, "rank", keep=True)
    return kept.withColumn("relevance_score", F.round("relevance_score", 3)).drop("_asked", "_text_score", "_court_score")


def search_words(c):
    """Distinct words of a text as the search sees them: lower case, without quotes, brackets, commas and full stops."""
    bare = F.translate(F.lower(lit_or_col(c)), '"(),.', "")  # none of them is white space, so words end where they did
    return F.array_distinct(F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != ""))


def decision_index(decisions: DataFrame, path: str | None = None, text: str = "search_text") -> WordIndex:
    """Index of decisions by court over name and whole text; a ``path`` that holds an index already gets the decisions it lacks."""
    spark = decisions.sparkSession
    index = WordIndex(spark, path or scratch_dir(spark, "decision-index"), "case_id", "court", "_words")
    whole = F.concat_ws(" ", "case_name", text if text in decisions.columns else "summary")
    index.append(decisions.select("case_id", "court", search_words(whole).alias("_words")))
    return index


def lexical_hits(queries: DataFrame, index: WordIndex, terms: str, courts: dict, fetch: int, group: str = "query_id") -> DataFrame:
    """Decisions by number of shared search words, best ``fetch`` per question and list of courts.

    Stands in for the outside search service. ``courts`` maps a ``side`` to its court ids; all sides
    are searched in one pass. A question has the sides in its column ``sides``.
    """
    lists = F.create_map(*[x for side, ids in courts.items() for x in (F.lit(side), F.array(*[F.lit(c) for c in ids]))])
    asked = queries.select(group, search_words(F.col(terms)).alias("words"), F.explode("sides").alias("side")).withColumn("scopes", F.try_element_at(lists, F.col("side")))
    return index.search(asked, [group, "side"], fetch)


def court_topic(query, topic, pattern: str = D.EAD_QUESTION, base: str = "h4", own: str = "h4_ead", flags: str = D.I):
    """Topic of a court search: questions on the base topic that ask about work permits are a topic of their own."""
    return F.when((lit_or_col(topic) == base) & lit_or_col(query).rlike(flags + pattern), F.lit(own)).otherwise(lit_or_col(topic))


def search_decisions(queries: DataFrame, decisions: DataFrame, known_topics, terms: str = "terms", wanted: int = 5,
                     fetch: int = 20, primary=D.PRIMARY_COURTS, broader=D.BROADER_COURTS, every=D.ALL_COURTS,
                     second=D.SECOND_PASS_COURTS, second_terms: str = D.SECOND_PASS_TERMS, pathway=D.REQUIRED_PATHWAY,
                     flags: str = D.I, index: WordIndex | None = None, **rank_rules) -> DataFrame:
    """Best decisions per question.

    Questions on a known topic search the home court, then other courts if too few
    came back; other questions search all courts. Pathway questions whose ranking
    is short get a second, fixed search whose results join the candidates. All searches run
    together over ``index``, built here if none is given. Decisions are searched and
    ranked on their whole text (``search_text``, where there is that column). Of decisions with one
    case_id the first by court and name counts.
    """
    queries = queries.withColumn("topic", court_topic("query_text", "topic"))
    decisions = one_per_key(decisions, ["case_id"], ["court", "case_name", "url"] if "url" in decisions.columns else ["court", "case_name"])
    known = F.coalesce(F.col("topic").isin(*known_topics), F.lit(False))
    strict = F.lit(False)
    for t, p in (pathway or {}).items():
        strict = strict | F.coalesce((F.col("topic") == t) & strip("query_text").rlike(flags + p), F.lit(False))
    index = index or decision_index(decisions)
    asked = queries.withColumn("sides", F.when(known, F.array(F.lit("near"), F.lit("far"))).otherwise(F.array(F.lit("open")))).select("query_id", F.col(terms).alias("_terms"), "sides")
    again = queries.where(strict).select("query_id", F.lit(second_terms).alias("_terms"), F.array(F.lit("second")).alias("sides"))
    # the searches are stored before their results are ranked and re-ranked
    found = materialise(lexical_hits(asked.unionByName(again), index, "_terms", {"near": primary, "far": broader, "open": every, "second": second}, fetch), "hits")
    side = lambda name: found.where(F.col("side") == name).select("query_id", "case_id", "pos")
    raw = merge_sources(side("near"), side("far"), "query_id", "case_id", "pos", wanted).unionByName(side("open"))
    texts = decisions.withColumn("summary", F.col("search_text")) if "search_text" in decisions.columns else decisions
    attach = lambda c: c.join(texts, "case_id").join(queries, "query_id")
    ranked = materialise(rank_decisions(attach(raw), wanted, pathway=pathway, flags=flags, **rank_rules), "ranked")
    if not pathway:
        return ranked
    n = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    short = queries.where(strict).join(n, "query_id", "left").where(F.coalesce("_n", F.lit(0)) < wanted).select("query_id")
    more = merge_sources(
        raw.join(short, "query_id", "left_semi"), side("second").join(short, "query_id", "left_semi"), "query_id", "case_id", "pos", 1 << 30)
    reranked = rank_decisions(attach(more), wanted, pathway=pathway, flags=flags, **rank_rules)
    return ranked.join(short, "query_id", "left_anti").unionByName(reranked)
