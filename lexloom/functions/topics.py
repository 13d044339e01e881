"""Topic, year, reference and outcome detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import domain as D
from .text import any_contains, any_match, first_rule, let, lit_or_col, strip


def _pattern_test(flags):
    return lambda c, p: c.rlike(flags + p)


def detect_topic(c, patterns=D.CORPUS_TOPIC_PATTERNS, sample: int | None = None, flags: str = D.I) -> Column:
    """First topic whose pattern occurs, in the whole text or its first ``sample`` characters."""
    c = lit_or_col(c)
    return first_rule(F.left(c, F.lit(sample)) if sample else c, patterns, _pattern_test(flags))


def infer_topic(c, patterns=D.IMPLIED_TOPIC_PATTERNS, flags: str = D.I) -> Column:
    return first_rule(F.lower(lit_or_col(c)), patterns, _pattern_test(flags))


def question_topic(c, patterns=D.QUERY_TOPIC_PATTERNS, implied=D.IMPLIED_TOPIC_PATTERNS, flags: str = D.I) -> Column:
    """Explicit topic of a question, else the one its vocabulary implies."""
    return F.coalesce(detect_topic(c, patterns, flags=flags), infer_topic(c, implied, flags=flags))


def session_topic(c, patterns=D.SESSION_TOPIC_PATTERNS, flags: str = D.I) -> Column:
    return first_rule(F.lower(lit_or_col(c)), patterns, _pattern_test(flags))


def topic_family(c, families=D.TOPIC_FAMILIES) -> Column:
    c = lit_or_col(c)
    table = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    return F.coalesce(F.element_at(table, c), c)


def year_range(c, year=D.YEAR_REF, after=D.AFTER_PATTERN, before=D.BEFORE_PATTERN,
               recent=D.RECENT_PATTERN, recent_from: int = D.RECENT_YEAR, flags: str = D.I) -> Column:
    """STRUCT(year_min, year_max) asked for by a question.

    Full four-digit years are read, which is the documented intent.
    """
    c = lit_or_col(c)
    years = F.transform(F.regexp_extract_all(c, F.lit(year), F.lit(0)), lambda y: y.cast("int"))
    none = F.lit(None).cast("int")

    def bounds(ys):
        lo, hi, n = F.array_min(ys), F.array_max(ys), F.size(ys)
        only_before = c.rlike(flags + before) & ~c.rlike(flags + after)
        return F.struct(
            F.when(n == 0, F.when(c.rlike(flags + recent), F.lit(recent_from)))
            .when((n == 1) & only_before, none)
            .otherwise(lo).alias("year_min"),
            F.when(n == 0, none).when(n == 1, F.when(only_before, lo)).otherwise(hi).alias("year_max"),
        )

    return let(years, bounds)


def section_refs(c, pattern: str = D.SECTION_REF) -> Column:
    """Section references in order of appearance, duplicates kept."""
    return F.regexp_extract_all(lit_or_col(c), F.lit(f"{D.I}({pattern})"), F.lit(1))


def chunk_metadata(c, topic_patterns=D.QUERY_TOPIC_PATTERNS, section=D.SECTION_REF, form=D.FORM_REF,
                   year=D.YEAR_REF, flags: str = D.I) -> Column:
    """STRUCT(topic, cited_sections, form_references, year_references); lists are sorted and distinct."""
    c = lit_or_col(c)

    def distinct(p):
        found = F.regexp_extract_all(c, F.lit(f"{flags}({p})"), F.lit(1))
        return F.array_sort(F.array_distinct(F.transform(found, strip)))

    return F.struct(
        detect_topic(c, topic_patterns, flags=flags).alias("topic"),
        distinct(section).alias("cited_sections"),
        distinct(form).alias("form_references"),
        distinct(year).alias("year_references"),
    )


def keyword_hits(c, words) -> Column:
    """How many of the words occur as substrings."""
    c = lit_or_col(c)
    return sum([c.contains(w).cast("int") for w in words], F.lit(0))


def classify(text, header_topic=None, header_source=None, law_words=D.LAW_KEYWORDS, case_words=D.CASE_KEYWORDS,
             topic_patterns=D.CORPUS_TOPIC_PATTERNS, flags: str = D.I, sample: int | None = None) -> Column:
    """STRUCT(doc_type, confidence, topic) of a document, from its whole text or its first ``sample`` characters."""
    text = lit_or_col(text)
    none = F.lit(None).cast("string")
    head_topic = F.nullif(header_topic, F.lit("")) if header_topic is not None else none
    trusted = F.coalesce(header_source == D.TRUSTED_LAW_SOURCE, F.lit(False)) if header_source is not None else F.lit(False)
    opening = F.lower(text if sample is None else F.left(text, F.lit(sample)))
    topic = F.coalesce(head_topic, detect_topic(text, topic_patterns, sample, flags))
    scores = let(opening, lambda s: F.struct(keyword_hits(s, law_words).alias("law"), keyword_hits(s, case_words).alias("case")))

    def verdict(k):
        law, case = k["law"], k["case"]
        silent = law + case == 0
        return F.struct(
            F.when(trusted | (law >= case), F.lit("law")).otherwise(F.lit("case")).alias("doc_type"),
            F.when(trusted, F.lit(0.95)).when(silent, F.lit(0.5))
            .otherwise(F.greatest(law, case) / (law + case)).alias("confidence"),
            F.when(~trusted & silent, none).otherwise(topic).alias("topic"),
        )

    return let(scores, verdict)


def outcome(c, rules=D.DECISION_OUTCOMES) -> Column:
    return first_rule(F.lower(lit_or_col(c)), rules, any_contains)


def alert_type(url, title, content, url_rules=D.URL_ALERT_TYPES, text_rules=D.TEXT_ALERT_TYPES,
               default: str = D.DEFAULT_ALERT_TYPE) -> Column:
    by_url = first_rule(url, [(v, w) for w, v in url_rules], lambda c, w: c.contains(w))
    by_text = first_rule(
        F.lower(F.concat(lit_or_col(title), lit_or_col(content))), [(v, w) for w, v in text_rules], any_contains
    )
    return F.coalesce(by_url, by_text, F.lit(default))

