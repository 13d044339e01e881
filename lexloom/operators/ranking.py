"""Lexical scores, fusion, reranking and deduplication within one question's candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lit_or_col
from ..rules import domain as D
from .skew import first_per_key


def words(c) -> Column:
    return F.filter(F.split(F.lower(lit_or_col(c)), r"(?U)\s+"), lambda w: w != "")


def bm25(cands: DataFrame, group: list[str], item: str, query_text: str = "query_text", text: str = "text",
         k1: float = D.BM25_K1, b: float = D.BM25_B, epsilon: float = D.BM25_EPSILON) -> DataFrame:
    """Adds ``bm25``: scores with statistics of the candidate set itself.

    A term in more than half of the candidates gets a small share of the mean
    idf in place of a negative weight. A group is a question with its few
    candidates. ``cands`` is read more than once and should be a stored table;
    text never travels with the exploded words.
    """
    docs = cands.select(*group, item, words(text).alias("_t"), words(query_text).alias("_q")).withColumn("_len", F.size("_t"))
    stats = docs.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"))
    n, df, tf = F.col("_n"), F.col("_df"), F.col("_tf")
    idf = (
        docs.select(*group, F.explode(F.array_distinct("_t")).alias("_w"))
        .groupBy(*group, "_w").agg(F.count(F.lit(1)).alias("_df"))
        .join(stats, group)
        .withColumn("_idf", F.log(n - df + 0.5) - F.log(df + 0.5))
    )
    floor = idf.groupBy(*group).agg((F.avg("_idf") * epsilon).alias("_eps"))
    # only the question's own words are counted within a text
    asked = (
        docs.select(*group, item, "_len", "_t", F.explode("_q").alias("_w"))
        .select(*group, item, "_len", "_w", (F.col("_len") - F.size(F.array_remove("_t", F.col("_w")))).alias("_tf"))
        .where(tf > 0)
    )
    weight = F.when(F.col("_idf") < 0, F.col("_eps")).otherwise(F.col("_idf"))
    part = weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    sums = asked.join(idf, [*group, "_w"]).join(floor, group).groupBy(*group, item).agg(F.sum(part).alias("bm25"))
    return cands.join(sums, [*group, item], "left").withColumn("bm25", F.round(F.coalesce("bm25", F.lit(0.0)), 9))


def normalise_by_max(df: DataFrame, group: list[str], column: str, name: str) -> DataFrame:
    """Divide by the group's maximum where that is positive."""
    top = F.max(column).over(Window.partitionBy(*group))
    return df.withColumn(name, F.when(top > 0, F.col(column) / top).otherwise(F.col(column)))


def rrf_fuse(df: DataFrame, group: list[str], dense: str = "vector_score", sparse: str = "bm25_score",
             pos: str = "dense_pos", k: int = D.RRF_K) -> DataFrame:
    """Adds ``score`` = Σ 1 / (k + rank) over both rankings; ties keep the dense order."""
    by = lambda c: F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(c), pos))
    return (
        df.withColumn("dense_rank", by(dense)).withColumn("sparse_rank", by(sparse))
        .withColumn("score", F.lit(1.0) / (F.col("dense_rank") + k) + F.lit(1.0) / (F.col("sparse_rank") + k))
    )


def rerank_top_n(df: DataFrame, group: list[str], pos: str = "pos", scorer: str | None = None,
                 n: int = D.RERANK_TOP_N) -> DataFrame:
    """Order by an outside score where a group has more than two rows, keep ``n``.

    Without a scorer the order stays. ``scorer`` names a column, which a caller may
    fill with a vectorised function over (question, text).
    """
    if scorer is None:
        return first_per_key(df, group, [pos], n, "new_pos", keep=True).drop(pos).withColumnRenamed("new_pos", pos)
    w = Window.partitionBy(*group)
    big = F.count(F.lit(1)).over(w) > 2
    order = F.when(big, -F.col(scorer))
    return (
        df.withColumn("_o", order).withColumn("_big", big)
        .withColumn("_new", F.row_number().over(w.orderBy(F.col("_o"), pos)))
        .where(F.col("_new") <= n)
        .withColumn("score", F.when(F.col("_big"), F.col(scorer)).otherwise(F.col("score")))
        .drop(pos, "_o", "_big").withColumnRenamed("_new", pos)
    )


def best_chunk_per_doc(df: DataFrame, group: list[str], pos: str = "pos", limit: int = D.MAX_CASES) -> DataFrame:
    """Above ``limit`` candidates: the best chunk of each document, then the best ``limit`` of these.

    The first of equal chunks wins; documents of equal score keep the order in
    which they appeared.
    """
    w = Window.partitionBy(*group)
    doc = F.coalesce(F.nullif(F.col("document_id").cast("string"), F.lit("")), F.col("chunk_id").cast("string"))
    d = df.withColumn("_doc", doc).withColumn("_n", F.count(F.lit(1)).over(w))
    per_doc = Window.partitionBy(*group, "_doc")
    d = d.withColumn("_in_doc", F.row_number().over(per_doc.orderBy(F.desc("score"), pos))).withColumn(
        "_seen", F.min(pos).over(per_doc)
    )
    kept = d.where((F.col("_n") <= limit) | (F.col("_in_doc") == 1))
    order = [F.when(F.col("_n") > limit, -F.col("score")), F.when(F.col("_n") > limit, F.col("_seen")).otherwise(F.col(pos))]
    return (
        kept.withColumn("_new", F.row_number().over(w.orderBy(*order)))
        .where((F.col("_n") <= limit) | (F.col("_new") <= limit))
        .drop(pos, "_doc", "_n", "_in_doc", "_seen").withColumnRenamed("_new", pos)
    )


def merge_sources(primary: DataFrame, broader: DataFrame, group: str, key: str, pos: str, wanted: int) -> DataFrame:
    """Primary results of a group, filled up with unseen broader ones where there are fewer than wanted."""
    both = primary.withColumn("_p", F.lit(0)).unionByName(broader.withColumn("_p", F.lit(1)))
    firsts = first_per_key(both, [group, key], ["_p", pos])
    n = primary.select(group, key).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("_n"))  # counted before the rows meet
    merged = firsts.join(n, group, "left").where((F.col("_p") == 0) | (F.coalesce("_n", F.lit(0)) < wanted))
    w = Window.partitionBy(group).orderBy("_p", pos)
    return merged.withColumn("_new", F.row_number().over(w)).drop(pos, "_p", "_n").withColumnRenamed("_new", pos)
