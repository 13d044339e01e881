"""Documents to chunk tables, and pages to crawl records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import url_to_filename
from ..functions.text import strip, token_estimate
from ..functions.topics import chunk_metadata, classify
from ..operators.activity import make_alerts
from ..operators.chunking import chunk_documents
from ..operators.crawl_state import assign_versions, detect_changes, mark_latest, upsert_records
from ..operators.kept import KeptFolder
from ..operators.metrics import document_rollup
from ..rules import domain as D
from ..session import materialise, spread
from ..sources.documents import parse_documents
from ..sources.sinks import stored_chunks


def prepare_documents(raw: DataFrame, existing: DataFrame | None = None, classify_rules: dict | None = None) -> DataFrame:
    """Parse, classify and version (document_id, filename, text) rows.

    A document without usable text is kept with status ``failed`` and a message.
    The parsed rows are written once; versions and chunks start from that table.
    """
    parsed = parse_documents(raw.withColumn("text", F.coalesce("text", F.lit(""))))
    kind = classify(
        "text", F.element_at("headers", "visa_type"), F.element_at("headers", "source"), **(classify_rules or {})
    )
    typed = spread(materialise(parsed.withColumn("_k", kind).select(
        "document_id", "filename", "title", "text", F.col("_k.doc_type").alias("doc_type"),
        F.col("_k.confidence").alias("confidence"), F.col("_k.topic").alias("topic"),
        F.when(F.coalesce(strip("text"), F.lit("")) == "", F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        F.when(F.coalesce(strip("text"), F.lit("")) == "", F.lit("No text found")).alias("error_message"),
    ), "documents"))
    slim = assign_versions(typed.select("document_id", "filename", "doc_type"), existing)
    # stored, so its size is known: text stays in place while the versions are small enough to be sent to it
    versions = materialise(mark_latest(slim).select("document_id", "version", "is_latest"), "versions")
    return typed.join(versions, "document_id")


def chunk_rows(documents: DataFrame, chunk_rules: dict | None = None, metadata_rules: dict | None = None) -> DataFrame:
    """Chunk table of completed documents with one id derived from document, version and position."""
    done = documents.where(F.col("status") == "completed").select(
        "document_id", "doc_type", F.col("topic").alias("_doc_topic"), "version", "text"
    )
    chunks = chunk_documents(done, **(chunk_rules or {})).withColumn("_m", chunk_metadata("text", **(metadata_rules or {})))
    key = F.concat_ws(":", F.col("document_id").cast("string"), F.col("version").cast("string"), F.col("chunk_index").cast("string"))
    return chunks.select(
        F.sha2(key, 256).alias("chunk_id"), "document_id", "doc_type", "chunk_index", "text", "section", "clause", "block_type",
        F.coalesce("_m.topic", "_doc_topic").alias("topic"), F.col("version").cast("string").alias("doc_version"),
        token_estimate("text").alias("token_count"), F.col("_m.cited_sections").alias("cited_sections"),
        F.col("_m.form_references").alias("form_references"), F.col("_m.year_references").alias("year_references"),
    )


class CorpusStore(KeptFolder):
    """Corpus tables of committed runs at ``path``.

    A run writes its documents (failed ones with their message, every one with its roll-up) and
    its chunks, laid out by document type, into a folder of its own, and counts once that is in the
    list of runs. A run repeated under its name, after a kill or to mend it, replaces its own rows:
    readers take the last folder of each name. It numbers versions on top of the runs that
    came before its first commit, so that a repetition gives the same rows.
    """

    def runs(self) -> dict[str, str]:
        """Run name to its folder in use, in order of the runs' first commits."""
        out: dict[str, str] = {}
        for s in self.segments():
            out[s.rsplit("-", 1)[0]] = s
        return out

    def ingest(self, raw: DataFrame, run: str, classify_rules: dict | None = None, chunk_rules: dict | None = None,
               metadata_rules: dict | None = None, widths: dict | None = None) -> str:
        """Parse, classify, version, chunk and roll up (document_id, filename, text) rows, write and commit them as ``run``."""
        known = list(self.runs())
        earlier = known[: known.index(run)] if run in known else known
        existing = self._documents(earlier)
        docs = prepare_documents(raw, existing.select("filename", "doc_type", "version") if existing is not None else None, classify_rules).drop("is_latest")
        segment = self.new_segment(run)
        folder = f"{self.path}/{segment}"
        chunks = stored_chunks(chunk_rows(docs, chunk_rules, metadata_rules), widths=widths)
        chunks.write.partitionBy("doc_type").parquet(f"{folder}/chunks")
        # rolled up from what was written; references only, the text stays where it is
        written = self.spark.read.schema(chunks.schema).parquet(f"{folder}/chunks")
        total = document_rollup(written.select("document_id", "chunk_index", "cited_sections"))
        docs.drop("text").join(total, "document_id", "left").withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0).cast("long"))).write.parquet(f"{folder}/documents")
        self.commit(segment)
        return segment

    def _documents(self, runs: list[str]) -> DataFrame | None:
        folders = self.runs()
        return self.part("documents", [folders[r] for r in runs]) if runs else None

    def documents(self) -> DataFrame:
        """Documents of all runs; ``is_latest`` marks the newest version of each file name."""
        found = self._documents(list(self.runs()))
        if found is None:
            raise ValueError(f"no committed run at {self.path}")
        return mark_latest(found)

    def chunks(self, latest: bool = False) -> DataFrame:
        """Chunks of all runs, or of the latest versions only."""
        found = self.part("chunks", list(self.runs().values()))
        if found is None:
            raise ValueError(f"no committed run at {self.path}")
        if not latest:
            return found
        keep = self.documents().where("is_latest").select("document_id", F.col("version").cast("string").alias("doc_version"))
        return found.join(keep, ["document_id", "doc_version"], "left_semi")

    def changes(self, run: str) -> DataFrame:
        """What ``run`` changed for law documents: ``document_id``, ``version``, ``change`` (added, or superseded by one of the run's)."""
        done = self.documents().where((F.col("doc_type") == "law") & (F.col("status") == "completed")).select("document_id", "version", "filename")
        mine = self._documents([run]).select("document_id", "version", "filename")
        added = done.join(mine, ["document_id", "version", "filename"], "left_semi")
        top = added.groupBy("filename").agg(F.max("version").alias("_new"))
        before = done.join(mine, ["document_id", "version", "filename"], "left_anti").join(top, "filename").where(F.col("version") < F.col("_new"))
        return added.select("document_id", "version", F.lit("added").alias("change")).unionByName(
            before.select("document_id", "version", F.lit("superseded").alias("change")))


def process_crawl(pages: DataFrame, previous: DataFrame, at: Column, order: str = "page_id",
                  alert_sources=D.ALERT_SOURCES) -> dict[str, DataFrame]:
    """Fetched pages to results, the record snapshot and alerts.

    ``pages`` has url, title, source_type, doc_type, content and an optional
    older ``clean_text`` used where content is empty. Pages without either fail.
    """
    body = F.nullif(F.col("content"), F.lit(""))
    if "clean_text" in pages.columns:
        body = F.coalesce(body, F.nullif(F.col("clean_text"), F.lit("")))
    p = pages.withColumn("content", body)
    good = p.where(F.col("content").isNotNull())
    # hashes and kinds are read by every output below; page text stays out of that table
    kinds = materialise(detect_changes(good.select("url", order, "content"), previous, order), "changes")
    keys = ["url", order]
    results = p.drop("content", "clean_text").join(kinds, keys, "left").withColumn(
        "result", F.coalesce("change_type", F.lit("failed"))
    )
    records = upsert_records(
        previous,
        results.where(F.col("result") != "failed").select(
            "url", order, F.col("new_hash").alias("content_hash"), "source_type", "doc_type", "title",
            F.col("result").alias("status"), F.lit(None).cast("string").alias("error_message"),
        ),
        at, order,
    )
    changed = good.join(
        kinds.where("should_process").select(*keys, F.col("change_type").alias("result")), keys
    )
    ingest = changed.select(
        order, "url", F.concat("source_type", F.lit("_"), url_to_filename("url"), F.lit(".txt")).alias("filename"), "content"
    )
    return {
        "results": results, "records": records, "alerts": make_alerts(changed, alert_sources), "to_ingest": ingest,
    }
