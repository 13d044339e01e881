"""Rule-based screening of questions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import domain as D
from .text import any_match, let, lit_or_col, replace_all, strip, word_count


def keyword_condition(c: Column, word: str) -> Column:
    """Words of up to four characters must stand alone; longer ones may be inside a word."""
    if len(word) <= 4:
        return c.rlike(r"(?U)(^|\W)" + re.sub(r"([^\w\s])", r"\\\1", word) + r"(\W|$)")
    return c.contains(word)


def scope_score(c, words=D.SCOPE_KEYWORDS, spellings=D.CODE_SPELLINGS) -> Column:
    text = replace_all(F.lower(lit_or_col(c)), [(D.I + p, r) for p, r in spellings])
    return let(text, lambda t: sum([keyword_condition(t, w).cast("int") for w in words], F.lit(0)))


def moderate(c, blocked=D.BLOCKED_PATTERNS, warning=D.WARNING_PATTERNS, words=D.SCOPE_KEYWORDS,
             topic_patterns=D.SCOPE_TOPIC_PATTERNS, spellings=D.CODE_SPELLINGS, reasons=D.MODERATION_REASONS,
             short_words: int = D.SHORT_QUERY_WORDS, flags: str = D.I) -> Column:
    """STRUCT(status, reason, is_safe)."""
    c = lit_or_col(c)
    empty = F.coalesce(strip(c) == "", F.lit(True))
    off_topic = (
        (word_count(c) > short_words)
        & (scope_score(c, words, spellings) == 0)
        & ~any_match(c, topic_patterns, flags)
    )
    verdict = (
        F.when(empty, "empty")
        .when(any_match(c, blocked, flags), "blocked")
        .when(off_topic, "scope")
        .when(any_match(c, warning, flags), "warning")
        .otherwise("safe")
    )
    table = F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv])
    return let(verdict, lambda v: F.struct(
        F.when(v.isin("warning", "safe"), v).otherwise(F.lit("blocked")).alias("status"),
        F.element_at(table, v).alias("reason"),
        v.isin("warning", "safe").alias("is_safe"),
    ))


def matching_keywords(c, words=D.SCOPE_KEYWORDS) -> Column:
    """ARRAY of the lexicon's words that a text contains, in lexicon order.

    The lexicon is folded into the expression, so a text meets it without a join.
    """
    return let(F.lower(lit_or_col(c)), lambda t: F.filter(
        F.array(*[F.when(keyword_condition(t, w), F.lit(w)) for w in words]), lambda w: w.isNotNull()
    ))
