"""Text expressions. All are native columns; none leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import domain as D


def lit_or_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: what ``(?U)\s`` matches
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c) -> Column:
    """Trim every kind of white space, not only blanks; only the ends are compared, no pattern runs over the text."""
    return F.btrim(lit_or_col(c).cast("string"), F.lit(WHITE))


def any_match(c, patterns, flags: str = D.I) -> Column:
    """True where any of the patterns occurs."""
    c = lit_or_col(c)
    return reduce(lambda a, b: a | b, [c.rlike(flags + p) for p in patterns], F.lit(False))


def any_contains(c, words) -> Column:
    c = lit_or_col(c)
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words], F.lit(False))


def first_rule(c, rules, test, otherwise=None) -> Column:
    """Value of the first rule whose test holds, in rule order.

    A computed text is bound once; the arms of a ``when`` would each compute it again.
    """
    def arms(v):
        expr = None
        for value, spec in rules:
            cond = test(v, spec)
            expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
        if expr is None:
            return F.lit(otherwise).cast("string")
        return expr.otherwise(F.lit(otherwise).cast("string"))

    return arms(F.col(c)) if isinstance(c, str) else let(c, arms)


def replace_all(c, rules) -> Column:
    """Apply (pattern, replacement) pairs in order."""
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules, lit_or_col(c))


def word_count(c) -> Column:
    return F.size(F.filter(F.split(lit_or_col(c), r"(?U)\s+"), lambda w: w != ""))


def clean_text(c) -> Column:
    """Collapse blanks, keep at most one empty line, drop lines of digits, trim."""
    return strip(
        replace_all(
            c,
            [(r" {2,}", " "), (r"\n{3,}", "\n\n"), (r"(?mU)^\d+\s*$", "")],
        )
    )


def strip_noise(c, patterns=D.POLICY_NOISE) -> Column:
    """Remove boilerplate lines of a crawled page."""
    squeezed = replace_all(c, [(r"\n{3,}", "\n\n"), (r" {2,}", " ")])
    return strip(replace_all(squeezed, [("(?iu)" + p, "") for p in patterns]))


def headings(c, marker: str = D.CLAUSE_MARKER) -> Column:
    """Every clause or paragraph-sign heading, in order, duplicates kept."""
    found = F.regexp_extract_all(lit_or_col(c), F.lit(f"{D.I}({marker})"), F.lit(1))
    return F.transform(found, strip)


def token_estimate(c) -> Column:
    return F.floor(F.length(lit_or_col(c)) / D.CHARS_PER_TOKEN).cast("int")


def tokens(c, stop_words=D.RELEVANCE_STOP_WORDS, min_chars: int = 3) -> Column:
    """Distinct lower-case words: outer hyphens cut, short and stop words left out."""
    kept = F.regexp_replace(F.lower(lit_or_col(c)), r"[^\p{L}\p{N}_\s-]", " ")
    words = F.transform(F.split(kept, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^-+|-+$", ""))
    long_enough = F.filter(words, lambda w: F.length(w) >= min_chars)
    stops = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    return F.array_except(long_enough, stops)


def bullets(c) -> Column:
    """Items of a bullet or numbered list."""
    lines = F.transform(F.split(lit_or_col(c), "\n"), strip)
    items = F.transform(
        F.filter(lines, lambda x: x != ""),
        lambda x: F.regexp_replace(
            F.regexp_replace(x, r"(?U)^[-*•]\s+", ""), r"(?U)^\d+\.\s+", ""
        ),
    )
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def content_hash(c) -> Column:
    return F.md5(F.encode(lit_or_col(c), "UTF-8"))


def cache_key(query, mode="standard", version: str = D.CACHE_VERSION) -> Column:
    mode = F.lit(mode) if isinstance(mode, str) else mode
    text = F.concat(F.lit(version + ":"), mode, F.lit(":"), strip(F.lower(lit_or_col(query))))
    return F.concat(F.lit(D.CACHE_PREFIX), F.left(F.sha2(text, 256), F.lit(32)))
