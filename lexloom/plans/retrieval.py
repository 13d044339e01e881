"""Scoping, hybrid search and the question-to-context job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.relevance import score_text
from ..operators.activity import attach_filenames
from ..operators.ranking import best_chunk_per_doc, bm25, normalise_by_max, rerank_top_n, rrf_fuse
from ..operators.sections import resolve_refs
from ..operators.skew import first_per_key
from ..operators.vectors import ALL, knn
from ..rules import domain as D
from ..session import materialise, spread
from .context import build_context


def documents_of(corpus: DataFrame, doc_type: str, topic: str | None = None, latest_only: bool = False) -> DataFrame:
    """Ids of one type, of one topic where given; pushed down to the scan."""
    cond = F.col("doc_type") == doc_type
    if topic is not None:
        cond = cond & (F.col("topic") == topic)
    if latest_only:
        cond = cond & F.col("is_latest")
    return corpus.where(cond).select("document_id")


def question_scopes(queries: DataFrame, corpus: DataFrame, topic: Column, fallback_topic: Column | None = None) -> DataFrame:
    """Adds (topic, law_scope, case_scope) to each question.

    A scope is a topic, '*' for every document of the type, or null for none; it
    stands for the list of documents, which is never written out per question.
    Laws fall back to all laws. Decisions fall back to all only if the question
    itself names no topic. A fallback topic (session or matter) re-scopes
    questions that name none, where it has documents.
    """
    q = queries.withColumn("_own", topic).withColumn(
        "_eff", F.coalesce(F.col("_own"), fallback_topic) if fallback_topic is not None else F.col("_own")
    )
    present = corpus.where(F.col("topic").isNotNull()).groupBy("topic").agg(
        F.count_if(F.col("doc_type") == "law").alias("_laws"), F.count_if(F.col("doc_type") == "case").alias("_cases")
    )
    j = q.join(present.withColumnRenamed("topic", "_eff"), "_eff", "left")
    return j.select(
        *queries.columns, F.col("_eff").alias("topic"),
        F.when(F.coalesce("_laws", F.lit(0)) > 0, F.col("_eff")).otherwise(F.lit(ALL)).alias("law_scope"),
        F.when(F.coalesce("_cases", F.lit(0)) > 0, F.col("_eff"))
        .when(F.col("_own").isNull(), F.lit(ALL)).alias("case_scope"),
    )


def matter_topic(c: Column) -> Column:
    """Topic a matter contributes; the work-permit code counts as its base code."""
    return F.when(c == "h4_ead", F.lit("h4")).otherwise(F.nullif(c, F.lit("")))


def scope_members(corpus: DataFrame, max_docs: int | None = None, latest_only: bool = False) -> DataFrame:
    """(doc_type, scope, document_id): the documents a scope searches: all, or the first ``max_docs`` by id.

    ``latest_only`` leaves out documents without ``is_latest``.
    """
    if latest_only:
        corpus = corpus.where("is_latest")
    by_topic = corpus.where(F.col("topic").isNotNull()).select("doc_type", F.col("topic").alias("scope"), "document_id")
    every = corpus.select("doc_type", F.lit(ALL).alias("scope"), "document_id")
    both = by_topic.unionByName(every)
    return both if max_docs is None else first_per_key(both, ["doc_type", "scope"], ["document_id"], max_docs)


def with_cells(chunks: DataFrame, members: DataFrame) -> DataFrame:
    """Chunks of scoped documents, with the scopes they belong to."""
    cells = members.groupBy("document_id").agg(F.collect_set("scope").alias("cells"))
    return chunks.join(cells, "document_id")


def hybrid_search(queries: DataFrame, chunks: DataFrame, top_k: int = D.TOP_K, query_id: str = "query_id",
                  query_text: str = "query_text") -> DataFrame:
    """Dense candidates (2k), lexical rescoring, rank fusion, best ``k`` with all scores.

    ``queries`` and ``chunks`` may carry ``cells``. Only ids and scores go through
    the search; text is joined to the few candidates afterwards. The candidates are
    stored, so the corpus is searched once however often they are read.
    """
    dense = knn(queries, chunks, top_k * 2, query_id=query_id)
    payload = [c for c in queries.columns if c not in chunks.columns and c != "cells"]
    rows = spread(materialise(
        dense.join(chunks.drop("embedding", "cells"), "chunk_id").join(queries.select(*payload), query_id), "candidates"
    ))
    scored = normalise_by_max(bm25(rows, [query_id], "chunk_id", query_text), [query_id], "bm25", "bm25_score")
    fused = rrf_fuse(scored, [query_id])
    return first_per_key(fused, [query_id], [F.desc("score"), "dense_pos"], top_k, "pos", keep=True)


def retrieve(scoped: DataFrame, corpus: DataFrame, chunks: DataFrame, top_k: int = D.TOP_K,
             max_docs: int | None = None, query_text: str = "query_text", latest_only: bool = False) -> DataFrame:
    """Laws and decisions per question, ``top_k`` each, as rows with ``source``.

    Each question asks once per source; both are answered in one pass over the chunks.
    """
    cell = lambda kind, scope: F.concat_ws("|", kind, scope)
    members = scope_members(corpus, max_docs, latest_only).select("document_id", cell("doc_type", "scope").alias("scope"))
    asks = F.explode(F.filter(
        F.array(*[
            F.struct(F.lit(k).alias("source"), F.col(f"{k}_scope").alias("scope")) for k in ("law", "case")
        ]), lambda a: a["scope"].isNotNull(),
    ))
    q = scoped.select("query_id", "embedding", query_text, asks.alias("_a")).select(
        cell("_a.source", F.col("query_id").cast("string")).alias("_ask"), "query_id", F.col("_a.source").alias("source"),
        "embedding", F.col(query_text).alias("_search"), F.array(cell("_a.source", "_a.scope")).alias("cells"),
    )
    found = hybrid_search(q, with_cells(chunks, members), top_k, "_ask", "_search")
    return found.drop("_ask", "_search")


def filter_relevant(cands: DataFrame, min_score: str = D.MIN_RELEVANCE, prefix: str | None = None,
                    query_text: str = "query_text", **rules) -> DataFrame:
    """Keep candidates relevant to their question; ``prefix`` names a column put before the text."""
    text = F.col("text") if prefix is None else F.concat(F.coalesce(F.col(prefix), F.lit("")), F.lit(" "), F.col("text"))
    score = score_text(text, query_text, "topic", "chunk_topic", **rules)
    return cands.withColumn("relevance", score).where(F.col("relevance") >= F.lit(min_score).cast("decimal(12,4)"))


def answer_contexts(scoped: DataFrame, corpus: DataFrame, chunks: DataFrame, mappings: DataFrame, courts: DataFrame | None = None,
                    scorer: str | None = None, section_pattern: str = D.SECTION_REF, max_docs: int | None = None, latest_only: bool = False,
                    search_text: str = "search_text", user_text: str = "query_text", **rules) -> DataFrame:
    """Questions to contexts: search, rerank, one chunk per decision, relevance, section resolution, assembly.

    Relevance is tested twice, before and after section resolution, the second
    time with the file name in front.
    """
    scoped = materialise(scoped, "scoped")
    found = retrieve(scoped, corpus, chunks, max_docs=max_docs, query_text=search_text, latest_only=latest_only)
    # a few rows per question, read once for laws and once for decisions
    ranked = rerank_top_n(found, ["query_id", "source"], scorer=scorer).join(
        scoped.select("query_id", user_text, "topic"), "query_id"
    )
    found = materialise(attach_filenames(ranked, corpus), "found")
    laws = found.where(F.col("source") == "law")
    cases = best_chunk_per_doc(found.where(F.col("source") == "case"), ["query_id"])
    cases = filter_relevant(cases, query_text=user_text, **rules)
    cases = resolve_refs(cases, mappings, chunks, pattern=section_pattern)
    cases = filter_relevant(cases, prefix="filename", query_text=user_text, **rules)
    shown = lambda df: df.withColumn("topic", F.col("chunk_topic"))
    return build_context(scoped, shown(laws), shown(cases), courts)
