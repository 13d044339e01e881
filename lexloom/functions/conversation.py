"""Follow-up, topic-change and expansion rules of a conversation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import domain as D
from .text import first_rule, lit_or_col, strip, word_count
from .topics import session_topic, topic_family


def is_follow_up(query, turn_count, *, deictic=D.FOLLOW_UP_PATTERN, question=D.QUESTION_WORDS_PATTERN,
                 topics=D.SESSION_TOPIC_PATTERNS, max_words: int = D.FOLLOW_UP_MAX_WORDS, flags: str = D.I) -> Column:
    """Refers to the exchange before: deictic words, or a short question without a topic."""
    q = strip(query)
    short = (word_count(q) <= max_words) & session_topic(q, topics, flags).isNull() & q.rlike(flags + question)
    return (lit_or_col(turn_count) > 0) & (q.rlike(flags + deictic) | short)


def is_new_topic(query, turn_count, last_topic, *, deictic=D.FOLLOW_UP_PATTERN, compare=D.COMPARE_PATTERN,
                 topics=D.SESSION_TOPIC_PATTERNS, families=D.TOPIC_FAMILIES,
                 max_words: int = D.FOLLOW_UP_MAX_WORDS, flags: str = D.I) -> Column:
    q = strip(query)
    found, last = session_topic(q, topics, flags), F.nullif(lit_or_col(last_topic), F.lit(""))
    moved = F.coalesce(topic_family(found, families) != topic_family(last, families), F.lit(False))
    long_standalone = (word_count(q) > max_words) & ~q.rlike(flags + deictic) & found.isNotNull()
    return (lit_or_col(turn_count) == 0) | q.rlike(flags + compare) | moved | long_standalone


def expand_query(query, turn_count, last_query, new_topic, *, contexts=D.SUBTOPIC_CONTEXT, flags: str = D.I,
                 **rules) -> Column:
    """Put the known context in front of a question that continues a thread."""
    q, last = lit_or_col(query), F.nullif(lit_or_col(last_query), F.lit(""))
    sub = first_rule(q, [(text, p) for p, text in contexts], lambda c, p: c.rlike(flags + p))
    has_prior = (lit_or_col(turn_count) > 0) & last.isNotNull()
    topics = rules.get("topics", D.SESSION_TOPIC_PATTERNS)
    continues = is_follow_up(q, F.lit(1), flags=flags, **rules) | session_topic(q, topics, flags).isNull()
    return (
        F.when(lit_or_col(new_topic), q)
        .when(sub.isNotNull(), F.concat_ws(" ", sub, q))
        .when(has_prior & continues, F.concat_ws(" ", last, q))
        .otherwise(q)
    )


def flags_struct(query, turn_count, new_topic, query_mode, *, forms=D.FORMS_FOLLOW_UP_PATTERN, flags: str = D.I,
                 **rules) -> Column:
    """STRUCT(has_conversation, is_follow_up, is_forms_follow_up)."""
    q = lit_or_col(query)
    has = (lit_or_col(turn_count) > 0) & (lit_or_col(query_mode) != "doc_review")
    follow = has & ~lit_or_col(new_topic) & is_follow_up(q, F.lit(1), flags=flags, **rules)
    return F.struct(
        has.alias("has_conversation"),
        follow.alias("is_follow_up"),
        (follow & q.rlike(flags + forms)).alias("is_forms_follow_up"),
    )


def explicit_subtopic(query, pattern: str = D.SUBTOPIC_PATTERN, flags: str = D.I) -> Column:
    return lit_or_col(query).rlike(flags + pattern)


def asks_for_forms(query, pattern: str = D.FORMS_FOLLOW_UP_PATTERN, flags: str = D.I) -> Column:
    return lit_or_col(query).rlike(flags + pattern)
