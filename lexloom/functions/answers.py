"""Parsing, checking, cleaning and scoring of generated answers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import domain as D
from . import privacy
from .text import any_contains, bullets, let, lit_or_col, replace_all, strip

DEC = "decimal(12,4)"


def dec(x) -> Column:
    """Exact decimal, so that rounding does not depend on binary fractions."""
    return (F.lit(x) if isinstance(x, (str, int, float)) else x).cast(DEC)


def section_text(c, header: str, ends) -> Column:
    """Text between a header and the next of its end headers; null if absent or blank."""
    stop = "|".join([*ends, "$"])
    return F.nullif(strip(F.regexp_extract(lit_or_col(c), rf"(?isU){header}\s*(.*?)(?={stop})", 1)), F.lit(""))


def parse_sections(c, sections=D.ANSWER_SECTIONS) -> Column:
    """STRUCT(answer, list sections …, is_well_formed).

    An answer without an answer header is kept whole and has no lists.
    """
    c = F.coalesce(lit_or_col(c), F.lit(""))
    raw = F.struct(*[section_text(c, header, ends).alias(name) for name, header, ends in sections])
    none = F.array().cast("array<string>")

    def build(r):
        formed, blank = r["answer"].isNotNull(), strip(c) == ""
        fields = [
            F.when(blank, F.lit(D.EMPTY_ANSWER)).when(formed, r["answer"]).otherwise(strip(c)).alias("answer")
        ]
        for name, _, _ in sections[1:]:
            items = F.when(formed, bullets(F.coalesce(r[name], F.lit("")))).otherwise(none)
            if name == "important_notes":
                items = F.when(blank, F.array(F.lit(D.EMPTY_ANSWER_NOTE))).otherwise(items)
            fields.append(items.alias(name))
        return F.struct(*fields, formed.alias("is_well_formed"))

    return let(raw, build)


def quality_gaps(answer, next_steps, risks, related_forms, important_notes, query, topic, law_count, case_count,
                 court_count, fact_checks=D.FACT_CHECKS, figure_check=D.FIGURE_CHECK, flags: str = D.I) -> Column:
    """ARRAY of gap messages, in a fixed order, before the format gap is added."""
    answer, query, topic = lit_or_col(answer), lit_or_col(query), lit_or_col(topic)
    g = D.QUALITY_GAPS
    n_steps = F.size(lit_or_col(next_steps))
    forms_gap = g["no_forms"].split("{topic}")
    checks = [
        F.when(n_steps == 0, F.lit(g["no_steps"])).when(n_steps < 3, F.lit(g["few_steps"])),
        F.when(F.size(lit_or_col(risks)) == 0, F.lit(g["no_risks"])),
        F.when(
            (F.size(lit_or_col(related_forms)) == 0) & (F.coalesce(topic, F.lit("")) != ""),
            F.concat(F.lit(forms_gap[0]), F.upper(topic), F.lit(forms_gap[1])),
        ),
        F.when(F.size(lit_or_col(important_notes)) == 0, F.lit(g["no_notes"])),
        F.when(lit_or_col(law_count) == 0, F.lit(g["no_laws"])),
        F.when((lit_or_col(case_count) == 0) & (lit_or_col(court_count) == 0), F.lit(g["no_cases"])),
    ]
    low_text = F.replace(F.lower(F.coalesce(answer, F.lit(""))), F.lit(","), F.lit(""))
    return F.filter(
        let(low_text, lambda low: F.array(*checks, *_content_gaps(low, query, fact_checks, figure_check, flags))),
        lambda x: x.isNotNull(),
    )


def _content_gaps(low, query, fact_checks, figure_check, flags):
    checks, g = [], D.QUALITY_GAPS
    for query_pattern, topic_pattern, facts in fact_checks:
        asked = query.rlike(flags + query_pattern)
        if topic_pattern:
            asked = asked & query.rlike(flags + topic_pattern)
        for fact in facts:
            words = [w for w in re.split(r"[^a-z0-9]+", fact.lower()) if len(w) > 3][:6]
            hits = sum([low.contains(w).cast("int") for w in words], F.lit(0))
            checks.append(F.when(asked & (hits < 2), F.lit(g["fact"].format(fact=fact))))
    if figure_check:
        patterns, figures = figure_check
        asked = query.rlike(flags + patterns[0])
        for p in patterns[1:]:
            asked = asked & query.rlike(flags + p)
        checks.append(F.when(asked & ~any_contains(low, figures), F.lit(g["figure"])))
    return checks


def completeness(n_gaps, is_well_formed) -> Column:
    """1 less a capped share per gap and a penalty for a broken format."""
    lost = F.least(dec(lit_or_col(n_gaps)) * dec(D.GAP_WEIGHT), dec(D.GAP_CAP))
    penalty = F.when(lit_or_col(is_well_formed), dec("0")).otherwise(dec(D.MALFORMED_PENALTY))
    return F.greatest(F.round(dec("1") - lost - penalty, 2), dec("0")).cast("decimal(5,2)")


def source_summary(law_count, case_count, court_count) -> Column:
    def part(n, noun):
        n = lit_or_col(n)
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + noun), F.when(n != 1, F.lit("s")).otherwise(F.lit(""))))

    text = F.concat_ws(
        ", ", part(law_count, "policy source"), part(case_count, "case precedent"), part(court_count, "court decision")
    )
    return F.when(text == "", F.lit("limited sources")).otherwise(text)


def assess(query, topic, law_count, case_count, court_count, parsed="parsed", **rules) -> Column:
    """STRUCT(gaps, completeness, source_summary, notes) for a parsed answer."""
    p = lit_or_col(parsed)
    found = quality_gaps(
        p["answer"], p["next_steps"], p["risks"], p["related_forms"], p["important_notes"],
        query, topic, law_count, case_count, court_count, **rules,
    )

    def build(gaps):
        with_format = F.when(p["is_well_formed"], gaps).otherwise(
            F.concat(F.array(F.lit(D.QUALITY_GAPS["malformed"])), gaps)
        )
        return F.struct(
            with_format.alias("gaps"),
            completeness(F.size(gaps), p["is_well_formed"]).alias("completeness"),
            source_summary(law_count, case_count, court_count).alias("source_summary"),
            F.concat(p["important_notes"], F.array_except(with_format, p["important_notes"])).alias("notes"),
        )

    return let(found, build)


def confidence(law_count, case_count, court_count, is_well_formed, completeness_score, gap_count,
               weights=D.CONFIDENCE_WEIGHTS, bands=D.CONFIDENCE_BANDS) -> Column:
    """STRUCT(score, level, label, needs_review); exact decimals, halves round up."""
    law, case, court = lit_or_col(law_count), lit_or_col(case_count), lit_or_col(court_count)
    gaps = lit_or_col(gap_count)
    capped = lambda n, w: F.least(dec(n), dec(w[1])) * dec(w[0])
    bonus = lambda cond, w: F.when(cond, dec(w)).otherwise(dec("0"))
    raw = (
        capped(law, weights["law"]) + capped(case, weights["case"]) + capped(court, weights["court"])
        + bonus(lit_or_col(is_well_formed), weights["well_formed"])
        + bonus(law >= 2, weights["two_laws"])
        + bonus((case >= 1) | (court >= 1), weights["any_case"])
        + dec(lit_or_col(completeness_score)) * dec(weights["completeness"])
        - F.least(dec(gaps) * dec(weights["gap"][0]), dec(weights["gap"][1]))
    )
    final = F.least(F.greatest(F.round(raw, 2), dec("0")), dec("1")).cast("decimal(5,2)")
    (high, high_min, high_label), (mid, mid_min, mid_label), (low, _, low_label) = bands

    def build(score):
        is_high = (score >= dec(high_min)) & (gaps <= 1)
        is_mid = ~is_high & (score >= dec(mid_min))
        return F.struct(
            score.alias("score"),
            F.when(is_high, high).when(is_mid, mid).otherwise(low).alias("level"),
            F.when(is_high, high_label).when(is_mid, mid_label).otherwise(low_label).alias("label"),
            F.when(is_high, False).when(is_mid, gaps >= 3).otherwise(True).alias("needs_review"),
        )

    return let(final, build)


def sanitize(c, pii=D.PII_PATTERNS, repairs=D.ANSWER_REPAIRS, labels=D.ANSWER_LABEL_REMOVALS,
             punctuation=D.ANSWER_PUNCTUATION, disclaimer: str = D.DISCLAIMER) -> Column:
    """Redact, mend the grammar around redactions, drop source labels, add the disclaimer."""
    text = privacy.redact(c, pii)
    for rules in (repairs, [(p, "") for p in labels], punctuation):
        text = replace_all(text, [("(?U)" + p, r) for p, r in rules])
    return F.concat(text, F.lit(disclaimer))


def law_citations(refs, manual: str = D.MANUAL_LABEL) -> Column:
    """Distinct labels of ARRAY<STRUCT(label, topic)> in order."""
    head, tail = manual.split(" ", 1)
    fallback = lambda r: F.coalesce(
        F.concat(F.lit(head + " "), F.upper(F.nullif(r["topic"], F.lit(""))), F.lit(" " + tail)), F.lit(manual)
    )
    return F.array_distinct(
        F.transform(lit_or_col(refs), lambda r: F.coalesce(F.nullif(r["label"], F.lit("")), fallback(r)))
    )


def case_citations(refs) -> Column:
    """``label|url`` of ARRAY<STRUCT(label, url, chunk_id)>, first entry per label."""
    named = F.transform(
        lit_or_col(refs),
        lambda r: F.struct(
            F.coalesce(
                F.nullif(r["label"], F.lit("")),
                F.concat(F.lit("Case Ref: "), F.left(F.coalesce(r["chunk_id"], F.lit("")), F.lit(8)), F.lit("...")),
            ).alias("label"),
            F.nullif(r["url"], F.lit("")).alias("url"),
        ),
    )
    seen = F.transform(named, lambda r: r["label"])
    firsts = F.filter(named, lambda r, i: F.array_position(seen, r["label"]) == i + 1)
    return F.transform(firsts, lambda r: F.concat_ws("|", r["label"], r["url"]))


def court_citations(refs) -> Column:
    """Name — citation — court — year of ARRAY<STRUCT(case_name, citation, court, date)>."""
    text = F.transform(
        lit_or_col(refs),
        lambda r: F.concat_ws(
            " — ",
            F.nullif(r["case_name"], F.lit("")), F.nullif(r["citation"], F.lit("")), F.nullif(r["court"], F.lit("")),
            F.nullif(F.left(r["date"], F.lit(4)), F.lit("")),
        ),
    )
    return F.filter(text, lambda x: x != "")


def grade(mean_score, bands=D.EVAL_BANDS) -> Column:
    expr = None
    for name, floor in bands:
        cond = lit_or_col(mean_score) >= F.lit(float(floor))
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr
