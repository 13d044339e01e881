"""Every registered query against its SQL check on the smallest tables, and the driver contract."""

import duckdb
import pytest
from compare import compare, connect

from lexloom import catalog

SF = "/root/testdata/sf0.001"
# results that must differ between rows, so that a check cannot pass on a constant
VARIED = {
    "classify_documents": "doc_type", "detect_topic": "topic", "moderate_queries": "status", "pii_prescreen": "suspect",
    "detect_changes": "change_type", "process_crawl": "result", "latest_versions": "is_latest", "detect_follow_up": "is_follow_up",
    "detect_new_topic": "new_topic", "conversation_flags": "is_follow_up", "score_relevance": "score", "alert_type": "alert_type",
    "detect_outcome": "outcome", "confidence_score": "level", "invite_status": "status", "resolve_section_refs": "resolved",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    ok, rows, _, note = compare(spark, con, name, SF)
    assert ok is not False, note
    assert rows > 0, name


@pytest.mark.parametrize("name", sorted(VARIED))
def test_result_varies(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.select(VARIED[name]).distinct().count() > 1


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert duckdb.__version__


def test_text_files_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    from lexloom.sources.documents import header_struct, parse_documents, read_text_files, serialise

    df = spark.createDataFrame([("T", "s", "u", "LAW", "Body one.\n\nClause 2.1 text")], "t string, s string, u string, d string, c string")
    text = df.select(serialise("t", "s", "u", "d", "c", F.create_map(F.lit("visa_type"), F.lit("h1b"))).alias("text")).first().text
    (tmp_path / "doc.txt").write_text(text, encoding="utf-8")
    read = read_text_files(spark, str(tmp_path)).withColumn("filename", F.substring_index("path", "/", -1))
    got = parse_documents(read).first()
    assert got.title == "T" and got.headers["visa_type"] == "h1b" and got.headings == ["Clause 2.1"] and got.text.startswith("Body one.")
    head = read.select(header_struct("text").alias("h")).first().h
    assert head.headers["doc_type"] == "LAW"
