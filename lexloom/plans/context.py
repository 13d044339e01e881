"""Numbered source blocks, reference lists and the size budget of a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import case_label, manual_label
from ..functions.text import lit_or_col, strip
from ..rules import domain as D


def trim_context(c, max_chars: int = D.CONTEXT_CHARS, note: str = D.CONTEXT_TRIM_NOTE) -> Column:
    """Cut to the budget, at the last empty line if that lies in the last fifth."""
    text = lit_or_col(c)
    cut = F.left(text, F.lit(max_chars))
    from_end = F.instr(F.reverse(cut), "\n\n")
    last = F.when(from_end > 0, F.length(cut) - from_end - 1).otherwise(-1)
    short = F.when(last > max_chars * 0.8, F.left(cut, last)).otherwise(cut)
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(short, F.lit(note)))


def _ordered(df: DataFrame, group: str, columns: list[str], name: str) -> DataFrame:
    """Rows of a question as an array in rank order (a handful per question)."""
    return df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias(name))


def _numbered(items: Column, tag: str, body) -> Column:
    return F.array_join(
        F.transform(items, lambda x, i: F.concat(F.lit(f"[{tag} "), (i + 1).cast("string"), F.lit("] "), body(x))), "\n\n"
    )


def build_context(queries: DataFrame, laws: DataFrame, cases: DataFrame, courts: DataFrame | None = None,
                  group: str = "query_id", max_chars: int = D.CONTEXT_CHARS) -> DataFrame:
    """(query, context_text, law_refs, case_refs, court_refs, tokens) per question.

    Inputs carry ``pos`` and are a few rows per question by then.
    """
    law = laws.withColumn("label", manual_label("filename", "topic"))
    case = cases.withColumn("_c", case_label("filename")).withColumn("label", F.col("_c.label")).withColumn("url", F.col("_c.url"))
    out = queries.select(group).join(
        _ordered(law, group, ["label", "section", "clause", "doc_version", "topic", "filename", "text"], "_law"), group, "left"
    ).join(
        _ordered(case, group, ["label", "url", "chunk_id", "document_id", "score", "topic", "text"], "_case"), group, "left"
    )
    if courts is not None:
        out = out.join(
            _ordered(courts, group, ["case_name", "citation", "court_name", "date_decided", "outcome", "summary", "url"], "_court"),
            group, "left",
        )
    short = lambda c: F.when((F.coalesce(c, F.lit("")) != "") & (F.length(c) < 100), c)
    law_text = _numbered(
        F.col("_law"), "LAW",
        lambda x: F.concat(F.concat_ws(" | ", x["label"], short(x["section"]), short(x["clause"])), F.lit("\n"), strip(x["text"])),
    )
    case_text = _numbered(F.col("_case"), "CASE", lambda x: F.concat(x["label"], F.lit("\n"), strip(x["text"])))
    parts = [("law", law_text), ("case", case_text)]
    if courts is not None:
        given = lambda lead, c, tail="": F.coalesce(F.concat(F.lit(lead), F.nullif(c, F.lit("")), F.lit(tail)), F.lit(""))
        parts.append(("court", _numbered(
            F.col("_court"), "COURT",
            lambda x: F.concat(
                x["case_name"], given(" (", x["citation"], ")"), given("\nCourt: ", x["court_name"]),
                given(" | Date: ", x["date_decided"]), given(" | Outcome: ", x["outcome"]),
                given("\nSummary: ", x["summary"]), F.lit("\nSource: "), x["url"],
            ),
        )))
    full = F.concat(*[
        F.coalesce(
            F.concat(F.lit(D.CONTEXT_HEADINGS[k] + "\n\n"), F.nullif(t, F.lit("")), F.lit("\n\n")), F.lit("")
        ) for k, t in parts
    ])
    refs = lambda c, *names: F.coalesce(
        F.transform(c, lambda x, i: F.struct((i + 1).alias("index"), *[x[n].alias(n) for n in names])),
    )
    out = out.withColumn("context_text", trim_context(full, max_chars))
    cols = [
        group, "context_text",
        refs(F.col("_law"), "label", "section", "clause", "doc_version", "topic", "filename").alias("law_refs"),
        refs(F.col("_case"), "label", "url", "chunk_id", "document_id", "score", "topic").alias("case_refs"),
    ]
    if courts is not None:
        cols.append(refs(F.col("_court"), "case_name", "citation", "court_name", "date_decided", "url", "outcome").alias("court_refs"))
    return out.select(*cols, F.floor(F.length("context_text") / D.CHARS_PER_TOKEN).cast("int").alias("tokens"))
