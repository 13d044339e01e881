"""Cutting documents into passages. One projection per document, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, lit_or_col, strip
from ..rules import domain as D


def pack_paragraphs(c, max_tokens: int, sep: str = "\n\n") -> Column:
    """ARRAY of pieces: paragraphs joined greedily up to the token limit.

    A text within the limit stays whole. One paragraph above the limit is
    never cut. Empty pieces are left out.
    """
    text = lit_or_col(c)
    limit = max_tokens * D.CHARS_PER_TOKEN
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("cur"), none.alias("done"))

    def add(acc, para):
        full = (F.length(acc["cur"]) + F.length(para) > limit) & (acc["cur"] != "")
        return F.struct(
            F.when(full, para).otherwise(F.concat(acc["cur"], F.lit(sep), para)).alias("cur"),
            F.when(full, F.concat(acc["done"], F.array(strip(acc["cur"])))).otherwise(acc["done"]).alias("done"),
        )

    packed = F.aggregate(
        F.split(text, sep), start, add, lambda acc: F.concat(acc["done"], F.array(strip(acc["cur"])))
    )
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.filter(packed, lambda p: p != ""))


def _label(piece: Column, marker: str) -> Column:
    return F.nullif(strip(F.regexp_extract(piece, rf"(?imU)^({marker})", 1)), F.lit(""))


def law_pieces(c, clause: str = D.CLAUSE_MARKER, section: str = D.SECTION_MARKER, max_tokens: int = D.LAW_CHUNK_TOKENS,
               min_chars: int = D.MIN_CHUNK_CHARS, sep: str = "\n\n") -> Column:
    """ARRAY<STRUCT(text, section, clause, block_type)> of a law text.

    Cut before clause markers, or before section markers where a text has at
    most one clause. The last section heading seen carries on.
    """
    text = lit_or_col(c)
    at_clause, at_section = f"(?iU)(?={clause})", f"(?iU)(?={section})"
    # a text that opens with a marker has no leading piece in Java's split
    opens = text.rlike(f"(?iU)^(?:{clause})").cast("int")
    cut = let(
        F.split(text, at_clause),
        lambda by_clause: F.when(F.size(by_clause) + opens <= 2, F.split(text, at_section)).otherwise(by_clause),
    )
    pieces = F.transform(
        F.filter(F.transform(cut, strip), lambda p: F.length(p) >= min_chars),
        lambda p: F.struct(p.alias("text"), _label(p, section).alias("section"), _label(p, clause).alias("clause")),
    )
    none = F.lit(None).cast("string")
    item = "array<struct<text:string,section:string,clause:string>>"
    filled = F.aggregate(
        pieces,
        F.struct(none.alias("section"), F.array().cast(item).alias("out")),
        lambda acc, p: F.struct(
            F.coalesce(p["section"], acc["section"]).alias("section"),
            F.concat(
                acc["out"],
                F.array(F.struct(
                    p["text"].alias("text"), F.coalesce(p["section"], acc["section"]).alias("section"), p["clause"].alias("clause"),
                )),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.flatten(F.transform(filled, lambda p: F.transform(
        pack_paragraphs(p["text"], max_tokens, sep),
        lambda t: F.struct(t.alias("text"), p["section"].alias("section"), p["clause"].alias("clause"),
                           none.alias("block_type")),
    )))


def case_pieces(c, markers=D.CASE_BLOCK_MARKERS, max_tokens: int = D.CASE_CHUNK_TOKENS, min_chars: int = D.MIN_CHUNK_CHARS,
                min_paragraph: int = D.MIN_PARAGRAPH_CHARS, sep: str = "\n\n", word_boundary: bool = False) -> Column:
    """ARRAY<STRUCT(text, section, clause, block_type)> of a decision.

    Cut before argument headings; text before the first one is dropped. Without
    any heading, long paragraphs are taken.
    """
    text = lit_or_col(c)
    wrap = (lambda p: rf"\b(?:{p})\b") if word_boundary else (lambda p: f"(?:{p})")
    every = "|".join(wrap(p) for _, p in markers)
    none = F.lit(None).cast("string")

    def block_type(piece):
        # of two types opening at one place the later one holds the text
        expr = none
        for name, p in markers:
            expr = F.when(piece.rlike(f"(?iu)^{wrap(p)}"), F.lit(name)).otherwise(expr)
        return expr

    blocks = F.filter(
        F.transform(
            F.split(text, f"(?iu)(?={every})"),
            lambda p: F.struct(strip(p).alias("text"), block_type(p).alias("kind")),
        ),
        lambda b: b["kind"].isNotNull() & (F.length(b["text"]) >= min_chars),
    )
    out = lambda t, kind: F.struct(
        t.alias("text"), none.alias("section"), none.alias("clause"), kind.alias("block_type")
    )
    from_blocks = F.flatten(F.transform(
        blocks, lambda b: F.transform(pack_paragraphs(b["text"], max_tokens, sep), lambda t: out(t, b["kind"]))
    ))
    paragraphs = F.filter(F.transform(F.split(text, sep), strip), lambda p: F.length(p) > min_paragraph)
    fallback = F.transform(paragraphs, lambda p: out(p, F.lit("paragraph")))
    return F.when(text.rlike(f"(?iu){every}"), from_blocks).otherwise(fallback)


def chunk_documents(docs: DataFrame, law: dict | None = None, case: dict | None = None) -> DataFrame:
    """(document_id, doc_type, chunk_index, text, section, clause, block_type) of whole documents."""
    pieces = F.when(F.col("doc_type") == "law", law_pieces("text", **(law or {}))).otherwise(
        case_pieces("text", **(case or {}))
    )
    carried = [c for c in docs.columns if c != "text"]
    return docs.select(*carried, F.posexplode(pieces).alias("chunk_index", "_p")).select(*carried, "chunk_index", "_p.*")


def forward_fill(df: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """Carry the last non-null value of a column forward within one document."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def long_enough(df: DataFrame, column: str, chars: int, strict: bool = False) -> DataFrame:
    n = F.length(column)
    return df.where(n > chars if strict else n >= chars)


def long_enough_by_kind(df: DataFrame, column: str, kind: str, minima: dict = D.MIN_CHARS) -> DataFrame:
    """Rows at least as long as the least length of their kind; kinds without one all stay."""
    least = F.coalesce(*[F.when(F.col(kind) == k, F.lit(n)) for k, n in minima.items()], F.lit(0))
    return df.where(F.length(column) >= least)
