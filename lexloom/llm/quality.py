"""Quality classifier: supervised subword embeddings.

Each word, each character n-gram of a word and each pair of neighbouring words is hashed
to a bucket with a learned vector; a document is the average of the vectors of all its
features, and a softmax layer turns it into class probabilities. Vectors and layer are
trained together by numpy stochastic gradient descent on a bounded sample of labelled
documents (``Settings.sample``); every document is scored.

Since the average and the layer are linear, a word adds a fixed number to the logit. It
is worked out once per distinct word.

Defined cases: null or empty text has no features and scores as the class shares of the
sample; without labels of both classes every score is the share of class 1 (0.5 without
any); repeated rows are all scored; extra columns pass through, a column ``score`` is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordTable, arrow_map, words_of, xxmix
from .textfeatures import first_by_hash, grams, labelled, texts_of

SIZES = (1, 3, 4)
BUCKETS = 1 << 16
_PAIR = np.uint64(0x2545F4914F6CDD1D)


@dataclass
class Settings:
    sample: int = 6_000  # labelled documents learned from
    dims: int = 8
    epochs: int = 12
    batch: int = 32
    rate: float = 0.5
    seed: int = 3


@dataclass
class Model:
    adds: np.ndarray  # per bucket: what a feature adds to the logit of class 1
    bias: float


class Features:
    """Bucket lists of words; ``reduce`` turns a word's buckets into one row of values."""

    def __init__(self, adds: np.ndarray | None = None):
        self.adds = adds
        self.table = WordTable(self._values)

    def _values(self, words: list[bytes]) -> np.ndarray:
        h, owner = grams(words, SIZES)
        out = np.empty(len(words), [("sum", "f8"), ("count", "i8"), ("hash", "u8")])
        out["sum"] = np.bincount(owner, weights=self.adds[(h & np.uint64(BUCKETS - 1)).astype(np.int64)], minlength=len(words))
        out["count"], out["hash"] = np.bincount(owner, minlength=len(words)), h[: len(words)]
        return out

    def logit(self, text: str | None) -> float:
        """Average of what the features of a text add."""
        words = words_of(text, fold=False)
        if not words:
            return 0.0
        at = self.table.rows(words)
        v = self.table.values[at]
        pairs = self.adds[pair_buckets(v["hash"])]
        return float((v["sum"].sum() + pairs.sum()) / (v["count"].sum() + len(pairs)))


def pair_buckets(h: np.ndarray) -> np.ndarray:
    return (xxmix(h[:-1] * _PAIR + h[1:]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def buckets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    words = words_of(text, fold=False)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct = list(dict.fromkeys(words))
    place = {w: i for i, w in enumerate(distinct)}
    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    h, owner = grams(distinct, SIZES)
    times = np.bincount(at)[owner]
    found = np.concatenate([(h & np.uint64(BUCKETS - 1)).astype(np.int64), pair_buckets(h[: len(distinct)][at])])
    total = np.bincount(found, weights=np.concatenate([times, np.ones(len(words) - 1)]), minlength=0).astype(np.int64)
    b = np.flatnonzero(total)
    return b, total[b]


def train(found: list[np.ndarray], times: list[np.ndarray], label: np.ndarray, s: Settings) -> Model:
    """Stochastic gradient descent on the vectors and the softmax layer."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dims, 1 / s.dims, (BUCKETS, s.dims))
    layer, bias, n = np.zeros((s.dims, 2)), np.zeros(2), len(label)
    layer += rng.normal(scale=0.1, size=layer.shape)
    steps, step = s.epochs * -(-n // s.batch), 0
    for _ in range(s.epochs):
        order = rng.permutation(n)
        for at in range(0, n, s.batch):
            part = order[at : at + s.batch]
            rate = s.rate * (1 - step / steps)
            step += 1
            share = [times[i] / max(1, times[i].sum()) for i in part]
            size = [len(found[i]) for i in part]
            ids, weight = np.concatenate([found[i] for i in part]).astype(np.int64), np.concatenate(share)
            row = np.repeat(np.arange(len(part)), size)
            picked = vectors[ids]
            x = np.zeros((len(part), s.dims))
            for d in range(s.dims):
                x[:, d] = np.bincount(row, weights=picked[:, d] * weight, minlength=len(part))
            z = x @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), label[part]] -= 1
            back = p @ layer.T
            layer -= rate * 4 * x.T @ p / len(part)
            bias -= rate * 0.2 * p.mean(axis=0)
            # a document's gradient is dealt to its features; scaled up, for each has but a small share
            np.add.at(vectors, ids, -rate * 20 * weight[:, None] * back[row])
    adds = vectors @ (layer[:, 1] - layer[:, 0])
    return Model(adds, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", settings: Settings | None = None) -> Model:
    """Learn from at most ``settings.sample`` labelled rows that ``learn`` (a condition on doc_id) admits."""
    s = settings or Settings()
    chosen = first_by_hash(labelled(labels, label, learn).where("label in (0, 1)"), s.sample, s.seed)
    sample = texts_of(docs, chosen, "quality-sample")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, len(b["label"]), 64):
                got = [buckets(t.as_py()) for t in b["text"][at : at + 64]]
                yield {"doc_id": b["doc_id"][at : at + 64], "label": b["label"][at : at + 64], "found": [f.astype(np.uint16).tobytes() for f, _ in got], "times": [t.astype(np.uint32).tobytes() for _, t in got]}

    rows = arrow_map(sample, run, "doc_id long, label int, found binary, times binary").toPandas()  # bounded by the sample
    rows = rows.sort_values(["doc_id", "found", "label"], kind="stable")
    y = rows["label"].to_numpy(np.int64)
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(BUCKETS), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    found = [np.frombuffer(f, np.uint16) for f in rows["found"]]
    times = [np.frombuffer(t, np.uint32) for t in rows["times"]]
    return train(found, times, y, s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score``, the probability of class 1, to documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        features = Features(shared.value.adds)
        for b in batches:
            z = np.array([features.logit(t.as_py()) for t in b["text"]]).reshape(-1) + shared.value.bias
            yield {**b, "score": 1 / (1 + np.exp(-np.clip(z, -700, 700)))}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "score")
    return arrow_map(docs.drop("score"), run, f"{fields}, score double")
