"""Language of texts and of spans in mixed-language texts.

A text's words are runs of letters with their marks, in lower case. A word's script, by ranges
of characters, narrows its candidates to the languages that were seen to write it. Among these,
hashed byte n-grams of the word and the word itself give each language's probability, which
counts down to ``exp(FLOOR)``, so that no single word decides. Viterbi over a text's words adds up the
logarithms and takes off ``penalty`` for every change of language; neighbours with one label
make a span. A text keeps one label without that walk if no stretch of it gains more than one
penalty with any other language, as then no path with changes can be better (each language
visited gains at most one penalty, and costs at least one). The prediction is the language of
most letters, its score these letters' share, each weighted with its word's probability.

Counts come from a bounded sample: at most ``sample`` texts a language (up to 1,000 each task cuts
its own rows to that number before the exchange), by a hash of the id, whole texts. Tasks count, counts are added up by slices; words are scored once per distinct
word and task.

Defined cases: null and empty texts and texts without letters are ``und`` with score 0 and have no
spans, as do all texts if nothing was learned; a script that no language wrote leaves all
candidates; words beyond ``LONGEST`` characters (text without spaces) count in parts of that length;
equal letters go to the language with the larger sum, then to the first by name; rows of a
learning doc_id that repeats count each; null ids stay as rows and are learned from only if
``learn`` holds for them; null languages are never learned. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordTable, arrow_map, materialise, summed
from .textfeatures import grams

SIZES = (2, 3, 4)  # byte n-grams
FLOOR, PENALTY, LONGEST = -6.0, 12.0, 32
SHARE = 0.01  # of a language's letters that a script needs to count as its own
NOTHING = "und"

#: First and last character of the main ranges of each script (Unicode blocks).
RANGES = [
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0700, 0x074F, "Syriac"), (0x0750, 0x077F, "Arabic"), (0x0780, 0x07BF, "Thaana"),
    (0x08A0, 0x08FF, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B00, 0x0B7F, "Oriya"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"),
    (0x0D80, 0x0DFF, "Sinhala"), (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"), (0x0F00, 0x0FFF, "Tibetan"), (0x1000, 0x109F, "Myanmar"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1200, 0x137F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"), (0x1800, 0x18AF, "Mongolian"),
    (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x3130, 0x318F, "Hangul"),
    (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0xF900, 0xFAFF, "Han"), (0xFF21, 0xFF5A, "Latin"), (0x20000, 0x323AF, "Han"),
]
_STARTS = [a for a, _, _ in RANGES]
SCRIPTS = ["other", *dict.fromkeys(s for _, _, s in RANGES)]
_INDEX = {s: i for i, s in enumerate(SCRIPTS)}
_WORD = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{LONGEST - 1}}}")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def script(word: str) -> int:
    """Number of the script that most characters of the word belong to, the first one of equals."""
    if word.isascii():
        return _INDEX["Latin"]
    seen: Counter[str] = Counter()
    for c in word:
        at = bisect_right(_STARTS, ord(c)) - 1
        seen[RANGES[at][2] if at >= 0 and ord(c) <= RANGES[at][1] else "other"] += 1
    return _INDEX[seen.most_common(1)[0][0]]


@dataclass
class Model:
    languages: list[str]
    allowed: np.ndarray  # script x language
    logs: np.ndarray  # bucket x language: log of the share of a language's features
    penalty: float = PENALTY

    def score(self, new: list[str]) -> np.ndarray:
        """Per word, the log probability of each language, not under ``FLOOR``."""
        of = np.fromiter(map(script, new), np.int64, len(new))
        allowed = self.allowed[of]
        open_ = np.flatnonzero(allowed.sum(1) > 1)  # one candidate needs no scoring
        total = np.zeros((len(new), len(self.languages)))
        if len(open_):
            h, owner = features([new[i] for i in open_])
            found = self.logs[h & np.uint64(len(self.logs) - 1)]
            order = np.argsort(owner, kind="stable")
            first = np.searchsorted(owner[order], np.arange(len(open_)))
            # n-grams of several sizes overlap: a letter's evidence counts about once
            total[open_] = np.add.reduceat(found[order].astype(np.float64), first) / (len(SIZES) + 1)
        total[~allowed] = -np.inf
        total -= total.max(1, keepdims=True)
        total -= np.log(np.exp(total).sum(1, keepdims=True))
        return np.maximum(total, FLOOR).astype(np.float32)


def features(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return grams([w.encode("utf-8", "surrogatepass") for w in new], SIZES)


def fit(docs: DataFrame, learn: Column, sample: int = 1_000, key: str = "doc_id", text: str = "text", lang: str = "lang", penalty: float = PENALTY) -> Model:
    """Model of the languages of the rows for which ``learn`` holds; at most ``sample`` texts of each."""
    rows = docs.where(learn & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("_lang"), F.xxhash64(key, F.lit(12)).alias("_h"), F.col(text).cast("string").alias("_text"))
    # one row a language, of which the model has a column each; a language's rows are thinned by their hash to about twice the sample before any text moves, then ranked
    share = rows.groupBy("_lang").agg(((2.0 * sample + 200) / F.count("*")).alias("_share"))
    likely = rows.join(F.broadcast(share), "_lang").where(F.pmod("_h", F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    first = Window.partitionBy("_lang").orderBy("_h", F.md5("_text"))
    chosen = materialise(likely.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample).select("_lang", "_text"), "language-sample")
    languages = sorted(r._lang for r in chosen.select("_lang").distinct().toLocalIterator())
    if not languages:
        return Model([], np.ones((len(SCRIPTS), 0), bool), np.zeros((1, 0)), penalty)
    bits = max(12, min(18, 23 - (len(languages) - 1).bit_length()))
    place = {name: i for i, name in enumerate(languages)}
    buckets, scripts = 1 << bits, len(SCRIPTS)
    width = buckets + scripts

    def count(batches: Iterator[dict]) -> np.ndarray:
        total = np.zeros((len(languages), width), np.float64)
        for b in batches:
            seen: dict[str, Counter[str]] = {}
            for name, t in zip(b["_lang"].to_pylist(), b["_text"].to_pylist(), strict=True):
                seen.setdefault(name, Counter()).update(words(t or ""))
            for name, c in seen.items():
                row, new = total[place[name]], list(c)
                times = np.fromiter(c.values(), np.float64, len(new))
                h, owner = features(new)
                if len(new):
                    row[:buckets] += np.bincount((h & np.uint64(buckets - 1)).astype(np.int64), times[owner], buckets)
                    row[buckets:] += np.bincount(np.fromiter(map(script, new), np.int64, len(new)), times * np.fromiter(map(len, new), np.int64, len(new)), scripts)
        return total.ravel()

    got = summed(chosen, count, len(languages) * width, kind_of="f4").reshape(len(languages), width).astype(np.float64)
    letters = got[:, buckets:]
    own = (letters > 0) & (letters >= SHARE * letters.sum(1, keepdims=True))
    allowed = np.where(own.any(0), own, True).T.copy()
    counts = got[:, :buckets] + 0.1
    logs = np.log(counts / counts.sum(1, keepdims=True))
    return Model(languages, allowed, np.ascontiguousarray(logs.T.astype(np.float32)), penalty)


def best_labels(e: np.ndarray, penalty: float) -> np.ndarray:
    """Label of each row of ``e`` (words x languages) on the path with the largest sum after penalties."""
    top = int(e.sum(0, dtype=np.float64).argmax())
    gain = np.zeros((len(e) + 1, e.shape[1]))
    np.cumsum(e - e[:, top : top + 1], axis=0, dtype=np.float64, out=gain[1:])
    if (gain - np.minimum.accumulate(gain, axis=0)).max(initial=0.0) <= penalty:
        return np.full(len(e), top)
    return viterbi(e, penalty)


def viterbi(e: np.ndarray, penalty: float) -> np.ndarray:
    v = e[0].astype(np.float64)
    best, moved = np.zeros(len(e), np.int64), np.zeros(e.shape, bool)
    for t in range(1, len(e)):
        best[t] = k = int(v.argmax())
        from_best = v[k] - penalty
        moved[t] = v < from_best
        v = np.maximum(v, from_best) + e[t]
    out = np.empty(len(e), np.int64)
    state = int(v.argmax())
    for t in range(len(e) - 1, -1, -1):
        out[t] = state
        if moved[t, state]:
            state = best[t]
    return out


class Reader:
    """Labels texts; distinct words are scored once."""

    def __init__(self, model: Model):
        self.model = model
        self.table = WordTable(model.score)

    def label(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, their labels and the probability that each word has its label."""
        found = words(text) if text and self.model.languages else []
        if not found:
            return [], np.zeros(0, np.int64), np.zeros(0)
        rows = self.table.rows(found)  # first: it may grow the values
        e = self.table.values[rows]
        labels = best_labels(e, self.model.penalty)
        return found, labels, np.exp(e[np.arange(len(e)), labels])

    def predict(self, text: str | None) -> tuple[str, float]:
        found, labels, sure = self.label(text)
        if not found:
            return NOTHING, 0.0
        letters = np.fromiter(map(len, found), np.float64, len(found))
        k = len(self.model.languages)
        each = np.bincount(labels, letters, k)
        weight = np.bincount(labels, letters * sure, k)
        pick = max(range(k), key=lambda i: (each[i], weight[i], -i))
        return self.model.languages[pick], float(min(1.0, weight[pick] / letters.sum()))

    def spans(self, text: str | None) -> list[dict]:
        """Stretches of one label: ``start``, ``end`` (characters, of its first and last word), ``lang``."""
        found, labels, _ = self.label(text)
        if not found:
            return []
        lower = text.lower()
        at = [m.span() for m in _WORD.finditer(lower)]
        if len(lower) != len(text):  # a few capitals become two characters: count back
            back = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
            back = np.append(back, len(text))
            at = [(int(back[s]), int(back[e - 1]) + 1) for s, e in at]
        change = np.flatnonzero(np.diff(labels)) + 1
        return [
            {"start": at[s][0], "end": at[e - 1][1], "lang": self.model.languages[labels[s]]}
            for s, e in zip([0, *change], [*change, len(labels)], strict=True)
        ]


def _mapped(docs: DataFrame, model: Model, key: str, text: str, columns: str, answer) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^23 numbers, see fit

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        reader = Reader(shared.value)
        for b in batches:
            yield {key: b[key]} | answer(reader, b["_text"])

    return arrow_map(docs.select(key, F.col(text).cast("string").alias("_text")), run, f"`{key}` {kind}, {columns}")


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` of every row."""
    def answer(reader: Reader, column: pa.Array) -> dict:
        got = [reader.predict(t.as_py()) for t in column]
        return {"lang_pred": [g for g, _ in got], "score": [s for _, s in got]}

    return _mapped(docs, model, key, text, "lang_pred string, score double", answer)


def spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``spans`` (array of start, end, lang) of every row."""
    def answer(reader: Reader, column: pa.Array) -> dict:
        return {"spans": [reader.spans(t.as_py()) for t in column]}

    return _mapped(docs, model, key, text, "spans array<struct<start int, end int, lang string>>", answer)
