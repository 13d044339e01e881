"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents, everything else is unlabelled: a label "not
toxic" is never used as a negative. The risk of a classifier g with class prior p is

    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

with the sigmoid loss l(z) = 1 / (1 + exp(z)); where the second term turns negative its gradient is reversed.
Features are the presence of hashed words and character n-grams; those more frequent
among positives than among unlabelled texts are kept. Several classifiers, each on its
own half of the unlabelled sample, are averaged.

Defined cases: null or empty text scores like a text without features; documents without
a label are scored like all others; without a positive in the sample every score is 0.
Extra columns of the documents are ignored; repeated rows are all scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordTable, arrays_of, arrow_map, release, words_of
from .textfeatures import first_by_hash, grams, labelled, texts_of

SIZES = (4, 5)
SLOTS = 1 << 18


@dataclass
class Settings:
    """Bounds of the sample and of the model; none depends on the size of the input."""

    positives: int = 4_000
    unlabelled: int = 16_000
    features: int = 4_096
    least: int = 5  # positives that show a feature
    ratio: float = 3.0  # how much more frequent it is among positives
    members: int = 3
    surplus: float = 4.0  # standard deviations above its share among unlabelled texts
    steps: int = 1_500
    batch: int = 1_024
    rate: float = 0.05
    decay: float = 1e-5
    seed: int = 7


@dataclass
class Model:
    slots: np.ndarray  # sorted hashed features
    weights: np.ndarray  # members x features
    bias: np.ndarray  # per member
    prior: float


def _slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h, owner = grams(words, SIZES)
    return (h & np.uint64(SLOTS - 1)).astype(np.int64), owner


class Presence:
    """Features of a model that a text shows, each word looked up once."""

    def __init__(self, chosen: np.ndarray):
        self.place = np.full(SLOTS, -1, np.int64)
        self.place[chosen] = np.arange(len(chosen))
        self.lists: list[np.ndarray] = []
        self.table = WordTable(self._compute)

    def _compute(self, words: list[bytes]) -> np.ndarray:
        """For each word 0, or the number of its entry in ``lists``."""
        if len(self.table) == len(words):
            self.lists = [np.zeros(0, np.int64)]
        slots, owner = _slots(words)
        found = self.place[slots]
        keep = np.flatnonzero(found >= 0)
        keep = keep[np.argsort(owner[keep], kind="stable")]
        out = np.zeros(len(words), np.int64)
        who, first = np.unique(owner[keep], return_index=True)
        for w, part in zip(who, np.split(found[keep], first[1:]), strict=True) if len(who) else ():
            out[w] = len(self.lists)
            self.lists.append(np.unique(part))
        return out

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.int64)
        at = self.table.rows(words)
        hit = np.unique(self.table.values[at])
        return np.unique(np.concatenate([self.lists[i] for i in hit])) if hit[-1] else np.zeros(0, np.int64)


def _count(texts: DataFrame) -> np.ndarray:
    """Documents that show each slot, for label 0 and 1: sums of one row per task and label."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros((2, SLOTS + 1), np.int64)
        for b in batches:
            for t, y in zip(b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
                words = list(dict.fromkeys(words_of(t)))
                total[y, np.unique(_slots(words)[0])] += 1
                total[y, SLOTS] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield {"slot": at, "n0": total[0, at], "n1": total[1, at]}

    rows = arrow_map(texts, run, "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = arrays_of(rows, {"slot": "<i4", "n0": "<i8", "n1": "<i8"})  # at most SLOTS + 1 rows
    out = np.zeros((2, SLOTS + 1), np.int64)
    out[:, got["slot"]] = got["n0"], got["n1"]
    return out


class _Rows:
    """Dense rows of some documents' features, in one buffer that each step clears and fills anew."""

    def __init__(self, shown: list[np.ndarray], n_features: int, most: int):
        self.length = np.array([len(f) for f in shown], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.features = np.concatenate(shown, dtype=np.int32) if len(shown) else np.zeros(0, np.int32)
        self.x, self.set = np.zeros((most, n_features)), (np.zeros(0, np.int64), np.zeros(0, np.int32))

    def of(self, docs: np.ndarray) -> np.ndarray:
        self.x[self.set] = 0
        n = self.length[docs]
        row = np.repeat(np.arange(len(docs)), n)
        self.set = row, self.features[np.arange(len(row)) + np.repeat(self.start[docs] - (np.cumsum(n) - n), n)]
        self.x[self.set] = 1
        return self.x[: len(docs)]


def train(shown: list[np.ndarray], label: np.ndarray, n_features: int, prior: float, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the members; ``shown`` has each document's features."""
    rng = np.random.default_rng(s.seed)
    pos, unl = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    some_pos, some_unl = (_Rows(shown, n_features, min(len(k), most)) for k, most in ((pos, 512), (unl, s.batch)))
    weights, biases = np.zeros((s.members, n_features)), np.zeros(s.members)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for m in range(s.members):
        own = rng.permutation(unl)[: max(1, (len(unl) + 1) // 2)] if s.members > 1 else unl
        w, b, v, vb = np.zeros(n_features), float(np.log(prior / (1 - prior))), np.zeros(n_features), 0.0
        for step in range(s.steps):
            rate, part = s.rate * (1 - step / s.steps), rng.choice(own, min(len(own), s.batch), replace=False)
            p = rng.choice(pos, min(len(pos), 512), replace=False)
            xp, xu = some_pos.of(p), some_unl.of(part)
            gp, gu = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
            negative = gu.mean() - prior * gp.mean()
            dp, du = gp * (1 - gp) / len(p), gu * (1 - gu) / len(part)
            sign = 1.0 if negative >= 0 else -1.0
            up = (-prior * dp if sign > 0 else 0.0) - sign * prior * dp
            uu = sign * du
            grad, grad_b = xp.T @ up + xu.T @ uu + s.decay * w, up.sum() + uu.sum()
            v, vb = 0.99 * v + 0.01 * grad**2, 0.99 * vb + 0.01 * grad_b**2
            w -= rate * grad / (np.sqrt(v) + 1e-4)
            b -= rate * grad_b / (np.sqrt(vb) + 1e-4)
        weights[m], biases[m] = w, b
    return weights, biases


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", prior: float | None = None, settings: Settings | None = None) -> Model:
    """Learn from the rows that ``learn`` (a condition on doc_id) admits.

    ``prior``: share of toxic documents; by default that among the labelled rows. The
    sample holds at most ``settings.positives`` positives and ``settings.unlabelled``
    others; only its features come to the driver.
    """
    s = settings or Settings()
    known = labelled(labels, label, learn)
    if prior is None:
        n, toxic = known.agg(F.count(F.lit(1)), F.sum(F.when(F.col("label") == 1, 1).otherwise(0))).first()
        prior = float(np.clip((toxic or 0) / max(n, 1), 0.005, 0.5))
    pos = first_by_hash(known.where("label = 1"), s.positives, s.seed)
    rest = docs.where(F.col("doc_id").isNotNull() & learn).select("doc_id")
    unl = first_by_hash(rest.distinct(), s.unlabelled, s.seed + 1)  # positives among them stay: the risk's second term counts on their share
    sample = texts_of(docs, pos.select("doc_id", F.lit(1).alias("label")).unionByName(unl.select("doc_id", F.lit(0).alias("label"))), "toxicity-sample")
    n = _count(sample)
    none = Model(np.zeros(0, np.int64), np.zeros((1, 0)), np.array([-np.inf]), prior)
    if not n[1, SLOTS] or not n[0, SLOTS]:
        return none
    p, u = n[1, :SLOTS] / n[1, SLOTS], n[0, :SLOTS] / n[0, SLOTS]
    signal = (p - u) / np.sqrt((u + 1 / n[0, SLOTS]) / n[1, SLOTS])
    good = np.flatnonzero((n[1, :SLOTS] >= s.least) & (p >= s.ratio * u) & (signal >= s.surplus))
    slots = np.sort(good[np.argsort(-signal[good], kind="stable")[: s.features]])
    if not len(slots):
        return none

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        seen = Presence(slots)
        for b in batches:
            yield {"label": b["label"], "shown": [seen.of(t).astype("<i4").tobytes() for t in b["text"].to_pylist()]}

    rows = arrow_map(sample, run, "label int, shown binary").collect()  # bounded by the sample
    label_, shown = np.array([r.label for r in rows]), [np.frombuffer(r.shown, "<i4") for r in rows]
    del rows
    order = np.lexsort([[len(x) for x in shown], [int(x.sum(dtype=np.int64)) for x in shown], label_])
    weights, bias = train([shown[i] for i in order], label_[order], len(slots), prior, s)
    del shown
    release()  # the driver goes on with other work
    return Model(slots, weights, bias, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score``, 0 to 1, to (doc_id, text); other columns are passed through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``features`` weights per member

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m = shared.value
        seen = Presence(m.slots)
        for b in batches:
            z = np.array([m.weights[:, f].sum(axis=1) + m.bias for f in (seen.of(t.as_py()) for t in b["text"])]).reshape(-1, len(m.bias))
            yield {**b, "score": (1 / (1 + np.exp(-np.clip(z, -700, 700)))).mean(axis=1)}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "score")
    return arrow_map(docs.drop("score"), run, f"{fields}, score double")
