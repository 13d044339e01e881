"""The registered queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import scratch_dir

from . import alignment, cap_filters, jaccard, language, line_dedup, mixing_lm, mixture, multi_index, quality, sentencepiece_scan, token_files, toxicity, whitening
from .common import documents, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _vocabulary(name: str) -> bytes:
    """A public vocabulary file; it is read once and shipped with the job."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "token-files")
    manifest = token_files.write_tokens(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), 2, folder)
    return token_files.read_files(manifest, digest=True)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, _labels(spark, sf_dir), remainder(F.col("doc_id"), 3) != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(documents(spark, sf_dir), n=3, percent=90)


@query
def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score(documents(spark, sf_dir), remainder(F.col("doc_id"), 7) == 2)


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query
def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(_embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0, k=20)


@query
def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(_embeddings(spark, sf_dir), 0.93)


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, _labels(spark, sf_dir), remainder(F.col("doc_id"), 4) != 2)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir), threshold=2, least=20, n_chars="n_chars")
    return out.select("doc_id", "n_lines", "n_dropped", "n_chars", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


ORACLES["op7_line_dedup"] = """
with lines as (
    select doc_id, pos - 1 as pos, string_split(text, chr(10))[pos] as line
    from (select doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) as pos from documents)
),
long_lines as (select * from lines where length(line) >= 20),
firsts as (select line, min((doc_id, pos)) as first from long_lines group by line),
pairs as (
    select distinct b.line from firsts a join firsts b
    on length(a.line) between length(b.line) - 2 and length(b.line) + 2 and a.first < b.first and a.line <> b.line
    where levenshtein(a.line, b.line) <= 2
),
kept as (
    select l.doc_id, l.pos, l.line,
        length(l.line) < 20 or (f.first = (l.doc_id, l.pos) and p.line is null) as stays
    from lines l left join firsts f on f.line = l.line left join pairs p on p.line = l.line
)
select doc_id, cast(count(*) as int) as n_lines, cast(count(*) filter (not stays) as int) as n_dropped,
    cast(coalesce(length(string_agg(line, chr(10) order by pos) filter (stays)), 0) as bigint) as n_chars,
    md5(coalesce(string_agg(line, chr(10) order by pos) filter (stays), '')) as kept_md5
from kept group by doc_id
"""


MIX = {"rate": 0.5, "alpha": 0.5, "rounds": 20, "seed": "mix"}


@query
def op2_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture.mix(documents(spark, sf_dir), **MIX)
    return out.withColumns({c: F.round(c, 5) for c in ("weight", "probability")})


ORACLES["op2_mixing_weights"] = mixture.check_sql(**MIX)


def _pieces() -> sentencepiece_scan.Model:
    import public_tokenizers

    return sentencepiece_scan.load(public_tokenizers.path("piece_bpe_32k.model"))


def encoded_digest(docs: DataFrame, model: sentencepiece_scan.Model) -> DataFrame:
    """Per document: n_ids, crc32 of its ids as little-endian int32, length and md5 of the decoded text."""
    out = sentencepiece_scan.decode(sentencepiece_scan.whole(sentencepiece_scan.encode(docs, model)), model)
    return out.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


@query
def op9_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digest(documents(spark, sf_dir), _pieces())


@query
def op11_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.agreement(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


@query
def op12_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs, remainder(F.col("doc_id"), 3) != 1)
    found = language.predict(docs, model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_embeddings(spark, sf_dir))
