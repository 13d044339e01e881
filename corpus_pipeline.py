"""Corpus pipeline: five stages over ``documents``, each written and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of documents; the last returns each document's piece ids and their text.
Defined cases are those of the operators; an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import jaccard, line_dedup, mixture, queries, sentencepiece_scan, toxicity
from lexloom.llm.common import materialise, remainder

TOXIC = 0.7  # documents scored at least so go
#: Expected share of tokens that mixing keeps, and how far sources are levelled (1: not at all).
RATE, ALPHA = 0.8, 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not find toxic; it learns from the labels as op10 does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), labels, remainder(F.col("doc_id"), 3) != 1)
    return toxicity.score(docs, model).where(F.col("score") < TOXIC).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus or differ from such a line by at most two edits.

    A document of which nothing but white space is left goes; one that had no words before stays.
    """
    cut = line_dedup.dedup_lines(docs, threshold=2, least=20, n_chars="n_chars")
    emptied = (F.col("n_dropped") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return cut.where(~emptied).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles that overlap by 0.8 or more.

    The one with the smallest doc_id stays; documents without words or doc_id stay.
    """
    found = jaccard.similar_documents(docs, n=5, percent=80)
    later = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities that bring source, language and topic towards level shares."""
    return mixture.sample(docs, rate=RATE, alpha=ALPHA, seed="pipeline", rounds=20).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the piece ids (little-endian int32) of every document's text and the text decoded from them."""
    model = queries._pieces()
    ids = sentencepiece_scan.decode(sentencepiece_scan.whole(sentencepiece_scan.encode(docs, model, keep=("source", "lang"))), model)
    return ids.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), (F.length("ids") / 4).cast("long").alias("n_ids"), "ids", "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Stages with trained models and byte pieces are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
