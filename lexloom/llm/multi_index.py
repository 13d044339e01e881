"""Nearest vectors by multi-index hashing of learned rotated binary codes.

Codes are the signs of the vectors after a rotation learned (iterative quantisation) on a
bounded sample. A code is cut into substrings; each task indexes the substrings of its
rows. A code within Hamming distance r of a query has, by the pigeonhole principle, a
substring within r // substrings of the query's, so probing every bucket that near in
each substring index retrieves all of them; these are reranked by the inner product in
double precision. Every row is indexed, none is dropped by a bucket.

The radius is read off the sample: it holds ``COVER`` of its rows' nearest neighbours by
inner product, counted from the code that the row has as a query.
Queries go out in blocks of bounded size, each answered by one pass over the rows; a
query that finds fewer than k rows is answered again with the full radius.

Inner products are made cosines by one more coordinate: rows get sqrt(M^2 - |x|^2) with M
the largest norm, queries 0; the scores come from the vectors themselves.

Defined cases: vectors that are null, zero, of another length than most or with null or
non-finite components take no part, as queries or answers; a null id takes no part;
repeated ids are rows of their own, but never answer a query of their id, and ask once, with
the smallest of their vectors' bytes; equal scores
go by the smaller id; fewer than k candidates give all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cap_filters import clean
from .common import arrow_map, materialise

SAMPLE, COVER, SUBSTRINGS, QUERIES, CHUNK = 4_000, 0.985, 4, 8_192, 8_192
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def rotation(x: np.ndarray, bits: int, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: principal axes, then the rotation whose signs fit best."""
    rng = np.random.default_rng(5)
    _, vectors = np.linalg.eigh(x.T @ x)
    basis = vectors[:, ::-1][:, :bits]
    if basis.shape[1] < bits:  # fewer coordinates than bits: further random directions
        basis = np.hstack([basis, np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]] * (1 + bits // max(1, x.shape[1])))[:, :bits]
    v = x @ basis
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return basis @ turn


def codes(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """SUBSTRINGS 16-bit substrings of each row's code."""
    bits = (x @ turn >= 0).reshape(len(x), SUBSTRINGS, 16)
    return (bits << np.arange(16)).sum(axis=2).astype(np.uint16)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top * top - (x * x).sum(axis=1, keepdims=True), 0))]) / top


def as_query(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.zeros((len(x), 1))])


class Index:
    """Buckets of each substring over some rows."""

    def __init__(self, code: np.ndarray):
        self.code, self.order, self.values, self.starts = code, [], [], []
        for s in range(SUBSTRINGS):
            order = np.argsort(code[:, s], kind="stable")
            values, starts = np.unique(code[order, s], return_index=True)
            self.order.append(order)
            self.values.append(values)
            self.starts.append(np.append(starts, len(order)))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of the query's."""
        hit = np.zeros(len(self.code), bool)
        for s in range(SUBSTRINGS):
            near = _ONES[self.values[s] ^ query[s]] <= radius // SUBSTRINGS
            hit[self.order[s][np.repeat(near, np.diff(self.starts[s]))]] = True
        rows = np.flatnonzero(hit)
        return rows[_ONES[self.code[rows] ^ query].sum(axis=1) <= radius]


def learn(sample: np.ndarray, top: float, k: int) -> tuple[np.ndarray, int]:
    """Rotation, and the radius that holds COVER of the sample's own nearest neighbours, asked and answered as in the search."""
    x = lifted(sample, top)
    turn = rotation(x, 16 * SUBSTRINGS)
    code = codes(x, turn)
    q = np.arange(min(len(x), 500))
    asked = codes(as_query(sample[q]), turn)
    score = sample[q] @ sample.T
    score[q, q] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k, max(1, len(x) - 1))]
    far = _ONES[asked[:, None, :] ^ code[near]].sum(axis=2)
    return turn, int(np.quantile(far, COVER, method="higher")) if len(x) > 1 else 16 * SUBSTRINGS


def _search(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], turn: np.ndarray, top: float, radius: int, k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((*queries, turn))  # at most QUERIES vectors

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        ids, vectors, turn = shared.value
        asked = codes(as_query(vectors), turn) if len(vectors) else []
        best_id = [np.zeros(0, np.int64)] * len(ids)
        best = [np.zeros(0)] * len(ids)
        for b in batches:
            for at in range(0, len(b["vec_id"]), CHUNK):
                own = b["vec_id"].to_numpy()[at : at + CHUNK]
                x = np.frombuffer(b"".join(b["x"][at : at + CHUNK].to_pylist()), np.float64).reshape(len(own), -1)
                index = Index(codes(lifted(x, top), turn))
                for q in range(len(ids)):
                    found = index.within(asked[q], radius)
                    found = found[own[found] != ids[q]]
                    if len(found):
                        n, s = np.concatenate([best_id[q], own[found]]), np.concatenate([best[q], x[found] @ vectors[q]])
                        first = np.lexsort((n, -s))[:k]
                        best_id[q], best[q] = n[first], s[first]
        for at in range(0, len(ids), 512):
            size = [len(n) for n in best_id[at : at + 512]]
            if sum(size):
                yield {"query_id": np.repeat(ids[at : at + 512], size), "vec_id": np.concatenate(best_id[at : at + 512]), "score": np.concatenate(best[at : at + 512])}

    found = arrow_map(rows, run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that ``is_query`` (a condition on the id) picks."""
    every = clean(vectors, key, vector, None).withColumn("size", F.length("x"))
    shape = every.where("x is not null").groupBy("size").count().orderBy(F.desc("count"), "size").first()
    spark, kind = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], kind)
    rows = materialise(every.where(F.col("size") == shape.size).select("vec_id", "x"), "search-rows")

    def norms(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            if len(b["x"]):
                x = np.frombuffer(b"".join(b["x"].to_pylist()), np.float64).reshape(len(b["x"]), -1)
                yield {"top": [float(np.sqrt((x * x).sum(axis=1)).max())]}

    top = arrow_map(rows, norms, "top double").agg(F.max("top")).first()[0]
    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-rows.count() // 2_000)))
    rows = materialise(rows.repartition(parts, "vec_id"), "search-rows")
    array = lambda got: np.array([np.frombuffer(r.x, np.float64) for r in got]).reshape(len(got), shape.size // 8)
    sample = rows.orderBy(F.xxhash64("vec_id"), "x").limit(SAMPLE).collect()
    turn, radius = learn(array(sample), top, k)
    asked = materialise(rows.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 20))), "queries")
    total = asked.count()
    blocks, out = max(1, -(-total // (QUERIES * 3 // 4))), None
    for i in range(blocks):
        got = asked.where(F.pmod("block", F.lit(blocks)) == i).select("vec_id", "x").collect()  # about QUERIES * 3 / 4 rows
        queries = np.array([r.vec_id for r in got], np.int64), array(got)
        found = materialise(_search(rows, queries, turn, top, radius, k), "nearest")
        few = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id").collect()
        short = ~np.isin(queries[0], [r.query_id for r in few])
        if short.any() and radius < 16 * SUBSTRINGS:
            again = materialise(_search(rows, (queries[0][short], queries[1][short]), turn, top, 16 * SUBSTRINGS, k), "nearest")
            found = found.join(F.broadcast(spark.createDataFrame([(int(i),) for i in queries[0][short]], "query_id long")), "query_id", "left_anti").unionByName(again)
        out = found if out is None else out.unionByName(found)
    return out
