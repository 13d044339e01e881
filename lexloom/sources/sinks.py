"""Corpus tables, the answer log and memos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lit_or_col
from ..rules import domain as D
from ..session import materialise


def stored_chunks(chunks: DataFrame, columns=tuple(D.STORED_WIDTHS), widths: dict | None = None) -> DataFrame:
    """Chunk rows as the two collections hold them: no nulls in text columns; ``widths`` bounds them for a store that needs it."""
    cols = [
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in columns else F.col(c) for c in chunks.columns
    ]
    out = chunks.select(*cols)
    return out.withColumns({c: F.left(c, F.lit(n)) for c, n in (widths or {}).items() if c in out.columns})


def write_corpus(chunks: DataFrame, path: str) -> None:
    """One parquet table per run, laid out by document type, so that a search reads only its own side."""
    stored_chunks(chunks).write.mode("overwrite").partitionBy("doc_type").parquet(path)


def answer_log_tables(answers: DataFrame) -> dict[str, DataFrame]:
    """Audit, meta and review rows of finished answers.

    The input is written once to the shared scratch folder; the three tables are
    cut from that copy rather than computed three times.
    """
    a = materialise(answers, "answers")
    return answer_log_views(a)


def answer_log_views(a: DataFrame) -> dict[str, DataFrame]:
    return {
        "audit": a.select(
            "audit_id", "user_id", "query", "answer", "law_chunk_ids", "case_chunk_ids", "topic", "response_time_ms",
            "token_count", "created_at",
        ),
        "meta": a.select(
            "audit_id", "matter_id", "session_id", "confidence_score", "confidence_level",
            *[F.to_json(c).alias(c) for c in ("next_steps", "risks", "related_forms")],
            "query_mode", "from_cache", "needs_review", "created_at",
        ),
        "review": a.where("needs_review").select("audit_id", F.lit("pending").alias("status"), "created_at"),
    }


def memo(question, answer, date, confidence=None, laws=None, cases=None, courts=None, steps=None, risks=None, forms=None,
         title: str = "Research Memo", closing: str = "*Not legal advice — verify with a qualified attorney.*") -> Column:
    """Markdown memo; sections without entries are left out. Empty where there is no answer."""
    def block(heading, items):
        if items is None:
            return None
        items = lit_or_col(items)
        lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
        return F.when(F.size(items) > 0, F.concat(F.lit(heading + "\n"), lines, F.lit("\n")))

    parts = [
        F.lit(f"# {title}\n"),
        F.concat(F.lit("**Date:** "), lit_or_col(date)),
        F.concat(F.lit("**Query:** "), F.coalesce(lit_or_col(question), F.lit("")), F.lit("\n")),
        F.concat(F.lit("## Answer\n"), lit_or_col(answer), F.lit("\n")),
    ]
    if confidence is not None:
        parts.append(F.concat(F.lit("**Confidence:** "), F.nullif(lit_or_col(confidence), F.lit("")), F.lit("\n")))
    for heading, items in (
        ("## Cited Laws", laws), ("## Cited Cases", cases), ("## Related Court Cases", courts), ("## Next Steps", steps),
        ("## Risks & Considerations", risks), ("## Related Forms", forms),
    ):
        parts += [b for b in [block(heading, items)] if b is not None]
    parts.append(F.lit("---\n" + closing))
    return F.when(lit_or_col(answer).isNull(), F.lit("")).otherwise(F.concat_ws("\n", *parts))


def conversation_memos(turns: DataFrame, date: str, **kw) -> DataFrame:
    """One memo per conversation from its latest user and assistant messages."""
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    pairs = turns.groupBy("conv_id").agg(last("user").alias("question"), last("assistant").alias("answer"))
    return pairs.select("conv_id", memo("question", "answer", F.lit(date), **kw).alias("memo"))
