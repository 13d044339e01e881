"""Corpus tables of committed runs: repetition, a run that dies, versions and changes."""

import pytest
from pyspark.sql import functions as F

from lexloom.plans.ingestion import CorpusStore

LAW = "Statute text. Clause 1.1 " + "the law says this " * 8 + "\nClause 1.2 " + "and Section 7 that " * 8
CASE = "The court held. Facts " + "what was with this from that court " * 6


def raw(spark, rows):
    return spark.createDataFrame(rows, "document_id long, filename string, text string")


RULES = dict(classify_rules=dict(law_words=["statute"], case_words=["court"], flags=""))


@pytest.fixture()
def store(spark, tmp_path):
    return CorpusStore(spark, str(tmp_path / "corpus"))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_runs_are_read_back_with_failed_documents_and_roll_up(spark, store):
    with pytest.raises(ValueError):
        store.documents()
    store.ingest(raw(spark, [(1, "a.txt", LAW), (2, "b.txt", CASE), (3, "c.txt", None), (4, "d.txt", " \n ")]), "one", **RULES)
    docs = {r.document_id: r for r in store.documents().collect()}
    assert [(docs[i].status, docs[i].error_message, docs[i].version, docs[i].is_latest) for i in (1, 2, 3, 4)] == [
        ("completed", None, 1, True)] * 2 + [("failed", "No text found", 1, True)] * 2
    n = {r.document_id: r["count"] for r in store.chunks().groupBy("document_id").count().collect()}
    assert {i: docs[i].total_chunks for i in docs} == {1: n[1], 2: n[2], 3: 0, 4: 0} and docs[1].cited_sections and docs[3].cited_sections is None
    assert {r.doc_type for r in store.chunks().where("document_id = 1").collect()} == {"law"}


def test_a_repeated_run_replaces_its_rows_and_a_dead_one_is_not_read(spark, store, monkeypatch):
    first = raw(spark, [(1, "a.txt", LAW), (2, "b.txt", CASE)])
    store.ingest(first, "one", **RULES)
    store.ingest(raw(spark, [(11, "a.txt", LAW + " more")]), "two", **RULES)
    before = rows(store.chunks(), "chunk_id", "text"), rows(store.documents(), "document_id", "version", "is_latest")
    assert before[1] == [(1, 1, False), (2, 1, True), (11, 2, True)]
    store.ingest(first, "one", **RULES)  # again, after a later run: same versions, same rows
    assert (rows(store.chunks(), "chunk_id", "text"), rows(store.documents(), "document_id", "version", "is_latest")) == before

    def killed(self, segment):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(CorpusStore, "commit", killed)
        with pytest.raises(RuntimeError):
            store.ingest(raw(spark, [(12, "b.txt", CASE)]), "three", **RULES)
    assert (rows(store.chunks(), "chunk_id", "text"), rows(store.documents(), "document_id", "version", "is_latest")) == before
    store.ingest(raw(spark, [(12, "b.txt", CASE)]), "three", **RULES)
    assert rows(store.documents(), "document_id", "version", "is_latest") == [(1, 1, False), (2, 1, False), (11, 2, True), (12, 2, True)]
    assert {r.document_id for r in store.chunks(latest=True).collect()} == {11, 12}
    store.ingest(raw(spark, [(2, "b.txt", CASE)]), "one", **RULES)  # a corrected run drops what it no longer has
    assert rows(store.documents(), "document_id", "version") == [(2, 1), (11, 2), (12, 2)]


def test_changes_of_a_run(spark, store):
    store.ingest(raw(spark, [(1, "a.txt", LAW), (2, "b.txt", CASE), (3, "e.txt", LAW)]), "one", **RULES)
    store.ingest(raw(spark, [(11, "a.txt", LAW), (12, "b.txt", CASE), (13, "f.txt", LAW), (14, "g.txt", "")]), "two", **RULES)
    assert rows(store.changes("two"), "document_id", "version", "change") == [(1, 1, "superseded"), (11, 2, "added"), (13, 1, "added")]
    assert rows(store.changes("one"), "document_id", "change") == [(1, "added"), (3, "added")]


def test_empty_run(spark, store):
    store.ingest(raw(spark, []), "none", **RULES)
    store.ingest(raw(spark, [(1, "a.txt", LAW)]), "one", **RULES)
    assert store.documents().count() == 1 and store.chunks().where(F.col("doc_type") == "law").count() > 0
