"""Relevance of passages and court decisions to a question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import domain as D
from .answers import dec
from .text import any_match, let, lit_or_col, tokens


def _for_topic(topic: Column, table: dict, make) -> Column:
    """Expression of the topic's own rules; null for topics without rules."""
    expr = None
    for name, rules in table.items():
        expr = F.when(topic == name, make(rules)) if expr is None else expr.when(topic == name, make(rules))
    return expr if expr is not None else F.lit(None)


def _hits(text: Column, patterns, flags) -> Column:
    return sum([text.rlike(flags + p).cast("int") for p in patterns], F.lit(0))


def _any_inside(words: Column, phrase: str) -> Column:
    return F.exists(words, lambda w: F.contains(F.lit(phrase), w))


def _stem(topic: Column) -> Column:
    return F.replace(topic, F.lit("_ead"), F.lit(""))


def score_text(text, query, topic=None, chunk_topic=None, *, stop_words=D.RELEVANCE_STOP_WORDS,
               topic_patterns=D.TOPIC_TEXT_PATTERNS, mismatch=D.TOPIC_MISMATCH, question_mismatch=D.QUESTION_MISMATCH,
               pathway=D.REQUIRED_PATHWAY, flags: str = D.I) -> Column:
    """Relevance (exact decimal, at least 0) of a text to a question on a topic."""
    text, query = lit_or_col(text), lit_or_col(query)
    none = F.lit(None).cast("string")
    topic = F.nullif(lit_or_col(topic), F.lit("")) if topic is not None else none
    chunk_topic = F.nullif(lit_or_col(chunk_topic), F.lit("")) if chunk_topic is not None else none
    prepared = F.struct(
        F.regexp_replace(F.lower(text), "[_-]+", " ").alias("hay"),
        tokens(query, stop_words).alias("asked"), tokens(text, stop_words).alias("has"),
    )

    def measured(p):
        return F.struct(
            F.size(p["asked"]).alias("n_asked"),
            F.size(F.array_intersect(p["asked"], p["has"])).alias("shared"),
            _for_topic(topic, topic_patterns, lambda ps: any_match(p["hay"], ps, flags)).cast("boolean").alias("about"),
            F.coalesce(_for_topic(topic, mismatch, lambda ps: _hits(p["hay"], ps, flags)), F.lit(0)).alias("wrong"),
            sum([
                F.when(query.rlike(flags + q), _hits(p["hay"], ps, flags)).otherwise(0) for q, ps in question_mismatch
            ], F.lit(0)).alias("off"),
        )

    gate = _for_topic(topic, pathway, lambda p: query.rlike(flags + p)) if pathway else F.lit(False)

    def total(m):
        about = m["about"]
        score = F.least(dec(m["shared"]) * dec("0.14"), dec("0.42")) + F.coalesce(
            F.when(about, dec("0.32"))
            .when(~about & (_stem(chunk_topic) == _stem(topic)), dec("0.22"))
            .when(~about & (chunk_topic != topic), dec("-0.2")),
            dec("0"),
        )
        wrong = F.when(about.isNotNull(), m["wrong"]).otherwise(0)
        score = score - dec("0.5") * dec(wrong) - dec("0.55") * dec(m["off"])
        blocked = F.coalesce(gate, F.lit(False)) & ~F.coalesce(about, F.lit(False))
        return F.when((m["n_asked"] == 0) | blocked, dec("0")).otherwise(F.greatest(score, dec("0"))).cast("decimal(12,4)")

    return let(let(prepared, measured), total)


def court_query_tokens(query, topic, stop_words=D.SEARCH_STOP_WORDS, anchors=D.COURT_ANCHORS) -> Column:
    """Question words plus the words of the topic's anchors."""
    extra = _for_topic(
        lit_or_col(topic), anchors, lambda ws: F.array_distinct(F.flatten(F.array(*[tokens(F.lit(w), stop_words) for w in ws])))
    )
    return F.array_union(
        tokens(query, stop_words), F.coalesce(extra, F.array().cast("array<string>"))
    )


def court_overlap_score(name, summary, court, case_topics, prior, query_tokens, topic, *, stop_words=D.SEARCH_STOP_WORDS,
                        anchors=D.COURT_ANCHORS, mismatch=D.COURT_MISMATCH, home_court: str = "bia",
                        flags: str = D.I) -> Column:
    """Word, phrase, topic, court and prior evidence for one decision."""
    summary, asked, topic = lit_or_col(summary), lit_or_col(query_tokens), lit_or_col(topic)
    cites = lit_or_col(case_topics)
    text = F.lower(F.concat_ws(" ", F.coalesce(lit_or_col(name), F.lit("")), F.coalesce(summary, F.lit(""))))

    def evidence(text):
        score = F.least(F.size(F.array_intersect(asked, tokens(text, stop_words))) * F.lit(0.12), F.lit(0.48))
        for phrases in anchors.values():
            first = None
            for p in (x.lower() for x in phrases):
                wanted = _any_inside(asked, p)
                first = F.when(text.contains(p), wanted) if first is None else first.when(text.contains(p), wanted)
            score = score + F.when(first, 0.2).otherwise(0.0)
        wrong = _for_topic(topic, mismatch, lambda ps: _hits(text, ps, flags))
        return score - F.lit(0.45) * F.coalesce(wrong, F.lit(0))

    own = F.array_contains(cites, topic) | F.array_contains(cites, _stem(topic))
    low = F.lower(F.coalesce(summary, F.lit("")))
    score = (
        let(text, evidence)
        + F.when(topic.isNull(), 0.0).when(own, 0.28).when(F.size(cites) > 0, -0.15).otherwise(0.0)
        + F.when(F.lower(lit_or_col(court)) == home_court, 0.08).otherwise(0.0)
        + F.when(F.exists(asked, lambda t: F.contains(low, t)), 0.1).otherwise(0.0)
        + F.least(lit_or_col(prior) * F.lit(0.05), F.lit(0.1))
    )
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.greatest(score, F.lit(0.0)))


def search_terms(query, topic, *, anchors=D.COURT_ANCHORS, phrases=D.SEARCH_PHRASES, stop_words=D.SEARCH_STOP_WORDS,
                 pathway=D.REQUIRED_PATHWAY, pathway_terms: str = D.PATHWAY_SEARCH_TERMS,
                 default_terms=D.DEFAULT_SEARCH_TERMS, limit: int | None = None, flags: str = D.I) -> Column:
    """Search string: topic anchors, phrases the question calls for, then its own unseen words."""
    query, topic = lit_or_col(query), lit_or_col(topic)
    none = F.array().cast("array<string>")
    strings = lambda ws: F.array(*[F.lit(w) for w in ws]) if ws else none
    seed = F.coalesce(_for_topic(topic, anchors, strings), none) if anchors else none
    for pattern, words in phrases:
        seed = F.concat(seed, F.when(query.rlike(flags + pattern), strings(words)).otherwise(none))
    words = tokens(query, stop_words)
    terms = F.aggregate(
        words, seed,
        lambda acc, w: F.when(F.exists(acc, lambda t: F.contains(F.lower(t), w)), acc)
        .otherwise(F.concat(acc, F.array(w))),
    )
    terms = F.when(F.size(terms) == 0, strings(default_terms)).otherwise(terms)
    text = F.array_join(terms if limit is None else F.slice(terms, 1, limit), " ")
    gate = _for_topic(topic, pathway, lambda p: query.rlike(flags + p)) if pathway else F.lit(False)
    return F.when(gate, F.lit(pathway_terms)).otherwise(text)
