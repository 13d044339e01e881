"""Personal-data detection and redaction."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import domain as D
from .text import any_contains, any_match, lit_or_col


def placeholder(label: str) -> str:
    return f"[REDACTED-{label}]"


def _stages(c, patterns):
    """Text before each pattern is applied, then the final text."""
    out = [lit_or_col(c)]
    for label, p in patterns:
        out.append(F.regexp_replace(out[-1], "(?U)" + p, placeholder(label)))
    return out


def redact(c, patterns=D.PII_PATTERNS) -> Column:
    """Replace each match by its label; later patterns see the redacted text."""
    return _stages(c, patterns)[-1]


def entity_counts(c, patterns=D.PII_PATTERNS) -> Column:
    """MAP(label, matches), counted on the progressively redacted text."""
    stages = _stages(c, patterns)
    pairs = []
    for (label, p), before in zip(patterns, stages):
        pairs += [F.lit(label), F.regexp_count(before, F.lit("(?U)" + p))]
    return F.create_map(*pairs)


def looks_personal(c, patterns=D.PII_PATTERNS, phrases=D.PII_PHRASES) -> Column:
    c = lit_or_col(c)
    return any_match(c, [p for _, p in patterns], "(?U)") | any_contains(F.lower(c), phrases)


def detect_entities(df: DataFrame, id_col: str, text_col: str, patterns=D.PII_PATTERNS) -> DataFrame:
    """One row per match: (id, label, text, start, end).

    Offsets refer to the text as redacted so far, matches of a label are listed
    from the last to the first. Rows without any match are dropped in the JVM
    before text is handed to Python.
    """
    suspects = df.select(id_col, text_col).where(any_match(text_col, [p for _, p in patterns], "(?U)"))
    id_type = df.schema[id_col].dataType.simpleString()

    def scan(frames):
        compiled = [(label, re.compile(p)) for label, p in patterns]
        for pdf in frames:
            rows = []
            for key, text in zip(pdf[id_col], pdf[text_col]):
                seq = 0
                for label, rx in compiled:
                    for m in reversed(list(rx.finditer(text))):
                        rows.append((key, seq, label, m.group(), m.start(), m.end()))
                        seq += 1
                    text = rx.sub(lambda _: placeholder(label), text)
            yield pd.DataFrame(rows, columns=[id_col, "seq", "label", "match", "start", "end"])

    return suspects.mapInPandas(
        scan, f"{id_col} {id_type}, seq int, label string, match string, start int, end int"
    )
