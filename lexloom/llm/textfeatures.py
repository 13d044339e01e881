"""Hashed word and character n-gram features, and bounded training samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, xxmix

_BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def grams(words: list[bytes], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each word as a whole and of its character n-grams (bytes of ``<word>``),
    with the index of the word each belongs to."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64) + np.uint64(1)
    length = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(length)
    starts, owner = ends - length, np.repeat(np.arange(len(words)), length)
    at = np.arange(len(raw))
    left, place = ends[owner] - at, at - starts[owner]
    k = powers(max(int(length.max()), max(sizes, default=0) + 1))
    hashes, owners = [xxmix(np.add.reduceat(raw * k[place], starts))], [np.arange(len(words))]
    for n in sizes:
        from_ = at[left >= n]
        h = np.full(len(from_), n, np.uint64) * np.uint64(0x632BE59BD9B4E019)
        for j in range(n):
            h += raw[from_ + j] * k[j + 1]
        hashes.append(xxmix(h))
        owners.append(owner[from_])
    return np.concatenate(hashes), np.concatenate(owners)


def labelled(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """One row per doc_id of the learning folds with its largest label; null ids and labels drop out."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))


def first_by_hash(df: DataFrame, n: int, seed: int) -> DataFrame:
    """A fixed pseudo-random choice of at most ``n`` rows by their doc_id."""
    return df.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def texts_of(docs: DataFrame, chosen: DataFrame, label: str) -> DataFrame:
    """Texts of the bounded choice ``chosen`` (doc_id, label); a doc_id in several rows counts once for each."""
    ids = F.broadcast(chosen)  # at most as many rows as the sample bound
    return materialise(docs.select(F.col("doc_id"), F.col("text").cast("string")).join(ids, "doc_id"), label)
