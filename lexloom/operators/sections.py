"""Old section references and their current equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.topics import section_refs
from ..rules import domain as D
from ..session import materialise
from .skew import first_per_key
from .vectors import knn


def reference_list(chunks: DataFrame, existing: DataFrame | None = None, pattern: str = D.SECTION_REF) -> DataFrame:
    """Distinct references of all chunks that are not mapped yet; taken from a column ``refs`` (array of strings), if there is one, else from ``text``."""
    found = F.col("refs") if "refs" in chunks.columns else section_refs("text", pattern)
    refs = chunks.select(F.explode(F.array_distinct(found)).alias("ref")).distinct()
    if existing is None:
        return refs
    return refs.join(existing.select(F.col("old_section_ref").alias("ref")), "ref", "left_anti")


def map_sections(refs: DataFrame, ref_vectors: DataFrame, law_chunks: DataFrame,
                 min_score: float = D.MIN_SECTION_SIMILARITY) -> DataFrame:
    """Nearest law chunk per reference, kept above the similarity floor."""
    q = refs.join(ref_vectors, "ref").select(F.col("ref").alias("query_id"), "embedding")
    near = knn(q, law_chunks, 1).where(F.col("vector_score") > min_score)
    return near.join(law_chunks.select("chunk_id", "section", "doc_version"), "chunk_id").select(
        F.col("query_id").alias("old_section_ref"), F.col("chunk_id").alias("current_chunk_id"),
        F.col("section").alias("current_section"), F.col("doc_version").alias("current_doc_version"),
        F.col("vector_score").alias("similarity_score"),
    )


def refresh_mappings(mappings: DataFrame, known_refs: DataFrame, refs: DataFrame, ref_vectors: DataFrame, law_chunks: DataFrame,
                     added: DataFrame, min_score: float = D.MIN_SECTION_SIMILARITY) -> DataFrame:
    """Mappings after a change of the law chunks, each with its ``change``: kept, added, moved or retracted.

    ``mappings`` and ``known_refs`` (``ref``) are what earlier runs left, ``refs`` are all references now,
    ``law_chunks`` the law chunks now and ``added`` those (``chunk_id``) that came with this run. A mapping
    stays as long as its chunk is there. A reference whose chunk is gone, or that is new, is searched
    among all law chunks; one that found nothing before is compared with the added chunks only, as the
    others were too far already. A retracted mapping keeps its old target and score in the result.
    """
    ids = law_chunks.select(F.col("chunk_id").alias("current_chunk_id"))
    live = mappings.join(ids, "current_chunk_id", "left_semi")
    gone = mappings.join(ids, "current_chunk_id", "left_anti")
    old = lambda df: df.select(F.col("old_section_ref").alias("ref"))
    now = refs.select("ref").distinct().join(old(live), "ref", "left_anti").join(
        known_refs.select("ref", F.lit(True).alias("_known")).distinct(), "ref", "left").join(
        old(gone).distinct().withColumn("_gone", F.lit(True)), "ref", "left")
    now = materialise(now.select("ref", (F.col("_known").isNull() | F.col("_gone").isNotNull()).alias("_all")), "open-refs")
    found = map_sections(now.where("_all"), ref_vectors, law_chunks, min_score).unionByName(
        map_sections(now.where("not _all"), ref_vectors, law_chunks.join(added.select("chunk_id"), "chunk_id", "left_semi"), min_score))
    found = materialise(found, "found-refs")
    lost = gone.join(found.select("old_section_ref"), "old_section_ref", "left_anti")
    fresh = found.join(gone.select("old_section_ref", F.lit("moved").alias("change")).distinct(), "old_section_ref", "left")
    columns = ["old_section_ref", "current_chunk_id", "current_section", "current_doc_version", "similarity_score"]
    return live.select(*columns, F.lit("kept").alias("change")).unionByName(
        fresh.select(*columns, F.coalesce("change", F.lit("added")).alias("change"))).unionByName(
        lost.select(*columns, F.lit("retracted").alias("change")))


def resolve_refs(cands: DataFrame, mappings: DataFrame, law_text: DataFrame, group: str = "query_id", pos: str = "pos",
                 pattern: str = D.SECTION_REF, max_refs: int = D.MAX_RESOLVED_REFS, chars: int = 500) -> DataFrame:
    """Append the current equivalent of each candidate's first reference, at most ``max_refs`` per question."""
    first_ref = F.try_element_at(section_refs("text", pattern), F.lit(1))
    asked = cands.select(first_ref.alias("old_section_ref")).where("old_section_ref is not null").distinct()
    mappings = mappings.join(asked, "old_section_ref", "left_semi")  # text is joined for these only
    best = first_per_key(mappings, ["old_section_ref"], [F.desc("similarity_score"), "current_chunk_id"])
    current = best.join(
        law_text.select(F.col("chunk_id").alias("current_chunk_id"), F.left("text", F.lit(chars)).alias("_now")),
        "current_chunk_id", "left",
    ).select(
        F.col("old_section_ref").alias("_ref"), "_now",
        F.coalesce("current_section", F.lit("None")).alias("_sec"),
        F.coalesce(F.col("current_doc_version").cast("string"), F.lit("None")).alias("_ver"), F.lit(True).alias("_found"),
    )
    joined = cands.withColumn("_ref", first_ref).join(current, "_ref", "left")
    w = Window.partitionBy(group).orderBy(pos)
    nth = F.sum(F.coalesce("_found", F.lit(False)).cast("int")).over(w)
    note = F.concat(
        F.col("text"), F.lit("\n\n[CURRENT EQUIVALENT OF '"), "_ref", F.lit("': "), "_sec", F.lit(" (v"), "_ver", F.lit(")]"),
        F.when(F.coalesce("_now", F.lit("")) != "", F.concat(F.lit("\n[CURRENT POLICY TEXT: "), "_now", F.lit("...]")))
        .otherwise(F.lit("")),
    )
    use = F.coalesce("_found", F.lit(False)) & (F.col("_nth") <= max_refs)
    return (
        joined.withColumn("_nth", nth).withColumn("resolved", use)
        .withColumn("text", F.when(use, note).otherwise(F.col("text")))
        .drop("_ref", "_now", "_sec", "_ver", "_found", "_nth")
    )
