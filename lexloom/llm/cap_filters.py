"""Near-duplicate vectors by spherical-cap filters.

A filter is a tuple of codewords, one from a small random code of each block of the
(randomly rotated) coordinates; a vector passes every filter whose direction it exceeds
by a threshold, and these are listed block by block without visiting all of them. Vectors
of one label that pass a common filter meet and are compared in double precision. A pair
with several common filters counts in the smallest only.

The number of filters follows the rows (``plan``): buckets keep about the same size, and
each vector passes about ``PASSES`` filters of each round. Rounds have codes and rotations
of their own, so a pair that one round misses with probability m is missed by r of them
with m^r; there are as many as bring that under ``MISS`` at the least cosine linked.
Buckets longer than ``BLOCK`` are dealt in blocks, each two of which meet in one group.
Equal vectors are one from the start.

Defined cases: a null label, and vectors that are null, zero, of another length than most
or with null or non-finite components, link with nothing but keep their row; a null
vec_id takes part in nothing and gets no row; repeated rows count as further vectors.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise
from .components import components

PASSES, LEAST, BLOCK, BLOCKS = 14, 6, 1024, 2
MISS, PAIRS, SLOW = 0.01, 2_000, 0.9  # allowed miss rate, pairs that measure it, miss of a round from which all pairs are compared


def threshold(dims: int, share: float) -> float:
    """What the first coordinate of a random unit vector exceeds with probability ``share``."""
    if share >= 1:
        return -np.inf
    if dims == 1:
        return 0.5
    angle = np.linspace(0, np.pi, 400_001)
    below = np.cumsum(np.sin(angle) ** (dims - 2))
    return float(np.cos(np.interp(share, below / below[-1], angle)))


@dataclass
class Caps:
    """Random product codes over ``dims`` coordinates, one a round."""

    dims: int
    words: int  # codewords of each block
    share: float  # part of a round's filters that a vector passes
    rounds: int = 1
    seed: int = 11

    def __post_init__(self):
        self.blocks = np.array_split(np.arange(self.dims), min(BLOCKS, self.dims))
        self.codes = []
        for r in range(self.rounds):
            rng = np.random.default_rng(self.seed + r)
            turn = np.linalg.qr(rng.normal(size=(self.dims, self.dims)))[0]
            codes = [rng.normal(size=(len(b), self.words)) for b in self.blocks]
            self.codes.append((turn, [c / np.linalg.norm(c, axis=0) for c in codes]))
        # the blocks' codewords together are a direction of this length
        self.threshold = np.sqrt(len(self.blocks)) * threshold(self.dims, self.share)

    def passed(self, x: np.ndarray) -> list[list[int]]:
        """Sorted numbers of the filters that each unit vector exceeds; the best ``LEAST`` of a round if fewer."""
        out = [[] for _ in x]
        for r in range(self.rounds):
            for all_rounds, own in zip(out, self._round(x, *self.codes[r]), strict=True):
                all_rounds += [r * self.words ** len(self.blocks) + f for f in own]
        return out

    def _round(self, x: np.ndarray, turn: np.ndarray, codes: list[np.ndarray]) -> Iterator[list[int]]:
        scores = [(x @ turn)[:, b] @ c for b, c in zip(self.blocks, codes, strict=True)]
        if len(scores) == 1:
            scores.append(np.zeros((len(x), 1)))
        for first, second in zip(*scores, strict=True):
            best, order = float(second.max()), np.argsort(-second)
            ranked = second[order]
            found = []
            for i in np.flatnonzero(first + best >= self.threshold).tolist():
                found += (i * len(second) + order[: np.searchsorted(-ranked, first[i] - self.threshold, side="right")]).tolist()
            if len(found) < LEAST:
                top = itertools.product(np.argsort(-first)[:LEAST].tolist(), order[:LEAST].tolist())
                found = sorted(top, key=lambda p: -(first[p[0]] + second[p[1]]))[:LEAST]
                found = [i * len(second) + j for i, j in found]
            yield sorted(found)


def missed(caps: Caps, cosine: float, pairs: int = PAIRS, seed: int = 0) -> float:
    """Share of random pairs at ``cosine`` without a common filter."""
    rng = np.random.default_rng(seed)
    x, side = rng.normal(size=(2, pairs, caps.dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * side
    return float(np.mean([set(a).isdisjoint(b) for a, b in zip(caps.passed(x), caps.passed(y), strict=True)]))


def plan(rows: int, dims: int, least: float = 0.93) -> Caps:
    """Filters for the rows of the largest label: one is passed by about 64 of them, but by no more than a hundredth.

    The miss rate of one round is measured at cosine ``least`` and taken three standard
    errors higher; if rounds are too many, every vector passes the one filter there is.
    """
    share = float(np.clip(64 / max(rows, 1), 1e-5, 0.01))
    words = max(2, int(np.ceil(np.sqrt(PASSES / share))))
    m = missed(Caps(dims, words, share), min(least, 1.0))
    m += 3 * np.sqrt(m * (1 - m) / PAIRS) + 3 / PAIRS
    return Caps(dims, 1, 1.0) if m > SLOW else Caps(dims, words, share, max(1, int(np.ceil(np.log(MISS) / np.log(m)))))


def clean(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """vec_id, label, x: the vector as doubles, null where it takes part in nothing."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            x = []
            for v in b["v"].to_pylist():
                a = None if v is None or None in v or not len(v) else np.array(v, np.float64) + 0.0
                x.append(None if a is None or not np.isfinite(a).all() or not a.any() else a.tobytes())
            yield {"vec_id": b["vec_id"], "label": b["label"], "x": x}

    tag = F.col(label).cast("long") if label else F.lit(0).cast("long")
    src = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), tag.alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return arrow_map(src, run, "vec_id long, label long, x binary")


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _group(least: float):
    """Pairs within a group: how many other vectors each links with, and edges that keep components."""

    def run(t: pa.Table) -> pa.Table:
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
        rep, m = t["rep"].to_numpy(), t["m"].to_numpy()
        side, own = t["block"].to_numpy(), int(t["filter"][0].as_py())
        lists = t["filters"].combine_chunks()
        x = unit(t["x"].to_pylist())
        low, high = side == side.min(), side == side.max()
        left, right = np.flatnonzero(low), np.flatnonzero(high)
        if int(t["low"][0].as_py()) != int(t["high"][0].as_py()) and side.min() == side.max():
            return kind.empty_table()
        # smaller filters of each row, as columns: a pair that shares one counts there
        value, offset = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
        row = np.repeat(np.arange(len(rep)), np.diff(offset))
        smaller = value < own
        names, column = np.unique(value[smaller], return_inverse=True)
        has = np.zeros((len(rep), max(1, len(names))), np.float32)
        has[row[smaller], column] = 1
        near = x[left] @ x[right].T >= least
        near &= has[left] @ has[right].T == 0
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        keep = i < j if side.min() == side.max() else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        if not len(i):
            return kind.empty_table()
        links = np.bincount(i, weights=m[j], minlength=len(rep)) + np.bincount(j, weights=m[i], minlength=len(rep))
        root = np.arange(len(rep))
        while True:  # smallest row reachable
            now = root.copy()
            np.minimum.at(now, i, root[j])
            np.minimum.at(now, j, root[i])
            now = now[now]
            if (now == root).all():
                break
            root = now
        some = np.flatnonzero(links > 0)
        return pa.table({"a": rep[some], "b": rep[root[some]], "links": np.round(links[some]).astype(np.int64)}, schema=kind)

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row with a vec_id.

    Vectors of equal label link when their cosine is at least ``least``; pairs are found
    with the probability of a common filter, 1 - ``MISS`` or more, and none below is linked.
    """
    every = materialise(clean(vectors, key, vector, label).withColumn("size", F.length("x")), "vectors")
    shape = every.where("x is not null and label is not null").groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if shape is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    good = (F.col("size") == shape.size) & F.col("label").isNotNull()
    reps = materialise(every.where(good).groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")), "distinct-vectors")
    rows = reps.groupBy("label").count().agg(F.max("count")).first()[0]
    caps = plan(rows, shape.size // 8, least)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, len(b["rep"]), 1024):
                yield {"rep": b["rep"][at : at + 1024], "filters": caps.passed(unit(b["x"][at : at + 1024].to_pylist()))}

    passed = materialise(arrow_map(reps.select("rep", "x").repartition(max(1, -(-reps.count() // 5_000)), "rep"), run, "rep long, filters array<int>"), "filters")
    src = reps.join(passed, "rep").withColumn("filter", F.explode("filters"))
    sizes = src.select("label", "filter").groupBy("label", "filter").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    dealt = (
        src.join(sizes, ["label", "filter"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("label", "filter", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "m", "x", "filters")
    )
    found = dealt.groupBy("label", "filter", "low", "high").applyInArrow(_group(least), "a long, b long, links long")
    found = materialise(found.groupBy("a", "b").agg(F.sum("links").alias("links")), "vector-links")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    tops = components(found.select("a", "b")).select(F.col("node").alias("rep"), "component")
    named = reps.join(links, "rep", "left").join(tops, "rep", "left").select(
        "label", "x", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = every.where(good).join(named, ["label", "x"]).select("vec_id", "n_links", "component_id")
    rest = every.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
