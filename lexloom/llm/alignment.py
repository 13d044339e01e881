"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both tokenizers cut the same bytes. Offsets where a token of each ends are shared cuts; between
two neighbouring ones lies a group, the smallest stretch that both cover with whole tokens.
An interval of the text is divided at a shared cut near its middle: the candidate's offset is
looked up by bisection among the other tokenizer's ends, then those of its neighbours to the
left and right, further and further out. Both halves go on alone; an interval without a cut
inside is a group. All open intervals of a batch of documents take each step together, as
vectors, and documents are intervals from the start, so one very long text is divided as fast
as many short ones.

Inside a group no cut is shared, so its tokens overlap in a staircase of one link fewer than it
has tokens. Links are counted by id pair: tasks count what they hold, Spark adds the counts up,
and the highest count of each B id is taken. Documents keep their distinct pairs with the
number of times. While all counts together are small (``limit`` pairs, checked before) every
task looks them up in one sorted table; beyond that pairs and documents meet by a join.

Defined cases: null and empty texts, and texts that either tokenizer changes (its tokens'
bytes joined are not space + text), have no tokens and zeros; special tokens' strings inside a
text are plain text; repeated rows are aligned and counted each; null ids stay as rows. Very
long texts are one interval like others and are held whole by one task. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise

SPACE = "▁"
BATCH = 1 << 18  # characters tokenized and aligned together
FLUSH = 2_000_000  # distinct pairs a task holds before it hands them on
WORDS = 400_000  # texts between spaces whose ids of side B a worker remembers
LIMIT = 2_000_000  # pairs whose counts every task may hold


@dataclass
class Side:
    """One tokenizer: ids of texts, and bytes of ids."""

    pieces: list[bytes]
    encode: object  # list of texts -> list of id arrays
    size: np.ndarray = field(init=False)

    def __post_init__(self):
        self.size = np.array([len(p) for p in self.pieces], np.int64)

    def faithful(self, ids: np.ndarray, raw: bytes) -> bool:
        return int(self.size[ids].sum()) == len(raw) and b"".join(map(self.pieces.__getitem__, ids.tolist())) == raw


def _alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The byte-level pre-tokenizer's pattern (a fixed value of the vocabulary's format).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_RUN = 10_000
_BLANK = re.compile(rf"\s{{{_RUN}}}")


@lru_cache(maxsize=2)
def byte_level(tokenizer_json: bytes) -> Side:
    """Side A: a byte-level vocabulary file of the tokenizers library, over space + text.

    Where merges are numbered in their order, as usual, ids also follow from ranks, which the faster
    of the two installed libraries takes; texts with very long blank runs, on which its pattern gives
    up, and other vocabularies go through the tokenizers library. Special tokens' strings are plain text in both.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole, alphabet, plan = Tokenizer.from_buffer(tokenizer_json), _alphabet(), json.loads(tokenizer_json)
    whole.encode_special_tokens = True
    names = whole.get_vocab()
    pieces = [b""] * (max(names.values(), default=-1) + 1)
    for name, i in names.items():
        pieces[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()

    def slow(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    ranks = _ranks(plan, pieces)
    if ranks is None:
        return Side(pieces, lambda texts: [slow(" " + t) for t in texts])
    import tiktoken

    fast = tiktoken.Encoding("pairs", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if len(text) > _RUN and _BLANK.search(text):
            return slow(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return Side(pieces, lambda texts: [encode(" " + t) for t in texts])


def _ranks(plan: dict, pieces: list[bytes]) -> dict[bytes, int] | None:
    """Ranks of a vocabulary file whose only rules are byte-level merges numbered in their order; None for others."""
    model, before = plan["model"], plan.get("pre_tokenizer") or {}
    odd = plan.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("ignore_merges")
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    vocab = model["vocab"]
    if odd or model.get("type") != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    return {pieces[i]: i for i in range(256 + len(merges))}


@lru_cache(maxsize=2)
def word_pieces(model: bytes) -> Side:
    """Side B: a SentencePiece model, which puts the space in front itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    pieces = []
    for i, name in enumerate(names):
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", name) if sp.is_byte(i) else None
        pieces.append(bytes([int(byte[1], 16)]) if byte else name.replace(SPACE, " ").encode())
    return Side(pieces, _Words(sp, names).encode)


class _Words:
    """SentencePiece ids of texts, with every distinct stretch between spaces encoded once.

    This holds for models without a piece that crosses into a space, and texts in which each space
    has other characters on both sides; other texts go through the library whole.
    """

    def __init__(self, sp, names: list[str]):
        self.sp, self.known = sp, {}
        self.apart = not any(SPACE in name.lstrip(SPACE) for name in names)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.apart and not (t[0] == " " or t[-1] == " " or "  " in t or SPACE in t) for t in texts]
        cut = [t.split(" ") if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.known) > WORDS:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known))
        self.known.update(zip(new, map(self._packed, self.sp.encode(new, num_threads=1)), strict=True))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, c)) if p else self._packed(self.sp.encode(t)), "<u4") for t, c, p in zip(texts, cut, plain, strict=True)]

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()


def shared_cuts(a: np.ndarray, b: np.ndarray, a_from: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and in ``b`` of all shared ends, rising.

    ``a`` and ``b`` are rising end offsets of one byte sequence; intervals begin at the token
    positions ``a_from`` and ``b_from`` (both have the total number of tokens as last entry) and
    end at shared ends.
    """
    lo, hi = a_from[:-1], a_from[1:] - 1  # the last token of each ends at a shared cut
    some = hi >= lo
    lo, hi = lo[some], hi[some]
    found_a, found_b = [hi], [b_from[1:][some] - 1]
    lo, hi = lo[hi > lo], hi[hi > lo]
    step = np.zeros_like(lo)
    while len(lo):
        # steps 0, 1, 2, 3, 4 ... look at the middle, one left, one right, two left ...
        at = (lo + hi - 1) // 2 + np.where(step % 2 == 1, -((step + 1) // 2), step // 2)
        at = np.minimum(np.maximum(at, lo), hi - 1)
        mark = a[at]
        there = np.searchsorted(b, mark)  # b's last end is a's last, so this is a position
        hit = b[there] == mark
        cut = at[hit]
        found_a.append(cut)
        found_b.append(there[hit])
        more = ~hit & (step < hi - lo)  # else all ends were tried: a leaf
        begin, end = lo[hit], hi[hit]
        left, right = begin < cut, cut + 1 < end  # one token cannot be divided
        step = np.concatenate([step[more] + 1, np.zeros(int(left.sum() + right.sum()), step.dtype)])
        lo, hi = np.concatenate([lo[more], begin[left], cut[right] + 1]), np.concatenate([hi[more], cut[left], end[right]])
    found_a, found_b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(found_a)
    return found_a[order], found_b[order]


@dataclass
class Aligned:
    """A batch's documents one after the other: ids, shared cuts (token positions) and the tokens before each document."""

    a: np.ndarray
    b: np.ndarray
    a_from: np.ndarray
    b_from: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray
    groups_from: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token positions in ``a`` and ``b`` of every pair of tokens whose bytes overlap, along the text, and the links before each document.

        A token of ``a`` meets the tokens of ``b`` from the first that ends behind its start to the first that ends at or behind its end.
        """
        ends_b = np.zeros(int(self.b_end[-1]) + 1 if len(self.b) else 1, bool)
        ends_b[self.b_end] = True
        before = np.cumsum(ends_b, dtype=np.int64)  # tokens of b that end at or before a byte
        upto = before[self.a_end]
        last = upto - ends_b[self.a_end]
        first = np.concatenate([upto[:0], [0], upto[:-1]])[: len(self.a)]
        many = last - first + 1
        start = np.cumsum(many) - many
        at_b = np.arange(int(many.sum())) + np.repeat(first - start, many)
        return np.repeat(np.arange(len(self.a)), many), at_b, np.concatenate([start, [len(at_b)]])[self.a_from]


def align(texts: list[str | None], one: Side, two: Side) -> Aligned:
    good = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b = one.encode([texts[i] for i in good]), two.encode([texts[i] for i in good])
    none = np.zeros(0, np.uint32)
    a, b = [none] * len(texts), [none] * len(texts)
    for i, x, y in zip(good, ids_a, ids_b, strict=True):
        raw = b" " + texts[i].encode()
        if one.faithful(x, raw) and two.faithful(y, raw):  # exactly the bytes of the text on both sides
            a[i], b[i] = x, y
    a_from = np.concatenate([[0], np.cumsum([len(x) for x in a])]).astype(np.int64)
    b_from = np.concatenate([[0], np.cumsum([len(x) for x in b])]).astype(np.int64)
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    a_end, b_end = np.cumsum(one.size[a]), np.cumsum(two.size[b])
    cuts_a, cuts_b = shared_cuts(a_end, b_end, a_from, b_from)
    return Aligned(a, b, a_from, b_from, a_end, b_end, cuts_a, cuts_b, np.searchsorted(cuts_a, a_from))


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    """Runs of rows with about ``BATCH`` characters."""
    texts, at, held = column.to_pylist(), 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= BATCH:
            yield at, i + 1, texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts), texts[at:]


def _sides(one: bytes, two: bytes) -> tuple[Side, Side]:
    return byte_level(one), word_pieces(two)


def groups(docs: DataFrame, one: bytes, two: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``key`` and ``groups``: array of (a, b, start, end), the ids of each side and the byte range in space + text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        sides = _sides(one, two)
        for batch in batches:
            for lo, hi, texts in _texts(batch["_text"]):
                w = align(texts, *sides)
                begin_a, begin_b = np.concatenate([[0], w.cuts_a[:-1] + 1]), np.concatenate([[0], w.cuts_b[:-1] + 1])
                ends = w.a_end[w.cuts_a]
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                shift = np.concatenate([[0], w.a_end])[w.a_from[:-1]]
                out = []
                for d in range(len(texts)):
                    out.append([
                        {"a": w.a[begin_a[g] : w.cuts_a[g] + 1].tolist(), "b": w.b[begin_b[g] : w.cuts_b[g] + 1].tolist(), "start": int(starts[g] - shift[d]), "end": int(ends[g] - shift[d])}
                        for g in range(w.groups_from[d], w.groups_from[d + 1])
                    ])
                yield {key: batch[key].slice(lo, hi - lo), "groups": out}

    return arrow_map(docs.select(key, F.col(text).cast("string").alias("_text")), run, f"`{key}` {kind}, groups array<struct<a array<int>, b array<int>, start long, end long>>")


def _separated(side: Side) -> list[bytes]:
    """Each id as text with a comma, a bar and a semicolon behind it."""
    return [str(i).encode() + s for i in range(len(side.pieces)) for s in (b",", b"|", b";")]


def _written(w: Aligned, sep_a: list[bytes], sep_b: list[bytes]) -> list[str]:
    """SHA-256 of each document's groups as text; '' without tokens."""
    n, m = len(w.a), len(w.b)
    last_a, last_b = np.zeros(n, np.int64), np.zeros(m, np.int64)
    last_a[w.cuts_a], last_b[w.cuts_b] = 1, 2
    # a group's tokens of a, then its tokens of b: each stands behind the other side's tokens of the groups before (a) or up to it (b)
    group_a, group_b = np.cumsum(last_a) - last_a, (np.cumsum(last_b) - last_b) // 2
    words = np.empty(n + m, np.int64)
    words[np.arange(n) + np.concatenate([[0], w.cuts_b + 1])[group_a]] = 3 * w.a.astype(np.int64) + last_a
    words[np.arange(m) + (w.cuts_a + 1)[group_b]] = 3 * w.b.astype(np.int64) + last_b + len(sep_a)
    table = sep_a + sep_b
    out, bounds, words = [], (w.a_from + w.b_from).tolist(), words.tolist()
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        out.append(hashlib.sha256(b"".join(map(table.__getitem__, words[s:e]))[:-1]).hexdigest() if e > s else "")
    return out


def _counted(docs: DataFrame, one: bytes, two: bytes, key: str, text: str) -> DataFrame:
    """Per document the figures that need no other document, its distinct id pairs (a * 2^32 + b, packed) and how often each is linked."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        sides = _sides(one, two)
        sep_a, sep_b = map(_separated, sides)
        width = len(sides[1].pieces)
        for batch in batches:
            for lo, hi, texts in _texts(batch["_text"]):
                w = align(texts, *sides)
                at_a, at_b, bounds = w.links()
                code = w.a[at_a].astype(np.int64) * width + w.b[at_b]
                pairs, times = [], []
                for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                    p, t = np.unique(code[s:e], return_counts=True)
                    pairs.append(p.astype("<u4" if width * len(sides[0].pieces) <= 1 << 32 else "<u8").tobytes())
                    times.append(_packed(t))
                yield {
                    key: batch[key].slice(lo, hi - lo), "n_a": pa.array(np.diff(w.a_from)), "n_b": pa.array(np.diff(w.b_from)),
                    "n_groups": pa.array(np.diff(w.groups_from)), "n_links": pa.array(np.diff(bounds)),
                    "groups_sha256": _written(w, sep_a, sep_b), "_pairs": pairs, "_times": times,
                }

    return arrow_map(
        docs.select(key, F.col(text).cast("string").alias("_text")), run,
        f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _pairs binary, _times binary",
    )


def _packed(times: np.ndarray) -> bytes:
    """Counts as bytes where all are below 255, else as 64-bit numbers behind a byte 255."""
    return times.astype(np.uint8).tobytes() if len(times) == 0 or times.max() < 255 else b"\xff" + times.astype("<i8").tobytes()


def _pairs_of(row_pairs: bytes, row_times: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    p = np.frombuffer(row_pairs, "<u8" if wide else "<u4").astype(np.int64)
    t = np.frombuffer(row_times[1:], "<i8") if row_times[:1] == b"\xff" else np.frombuffer(row_times, np.uint8).astype(np.int64)
    return p, t


def pair_counts(counted: DataFrame, wide: bool, flush: int = FLUSH) -> DataFrame:
    """``pair``, ``count`` over all documents; tasks add up before they hand on."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in batches:
            parts = [held, *(_pairs_of(p, t, wide) for p, t in zip(b["_pairs"].to_pylist(), b["_times"].to_pylist(), strict=True))]
            pairs, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, where, np.concatenate([t for _, t in parts]))
            held = (pairs, sums)
            if len(pairs) > flush:
                yield {"pair": pa.array(pairs), "count": pa.array(sums)}
                held = (pairs[:0], sums[:0])
        if len(held[0]):
            yield {"pair": pa.array(held[0]), "count": pa.array(held[1])}

    return arrow_map(counted.select("_pairs", "_times"), run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def _by_table(counted: DataFrame, marked: DataFrame, key: str, wide: bool) -> DataFrame:
    """Documents with their links' figures; every task holds the counts of all pairs, whose number was checked."""
    spark, kind = counted.sparkSession, counted.schema[key].dataType.simpleString()
    rows = marked.select("pair", "count", "best").toArrow()
    order = np.argsort(rows["pair"].to_numpy())
    table = spark.sparkContext.broadcast(tuple(rows[c].to_numpy()[order] for c in ("pair", "count", "best")))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        pair, count, best = table.value
        for b in batches:
            n_best, count_sum = [], []
            for p, t in zip(b["_pairs"].to_pylist(), b["_times"].to_pylist(), strict=True):
                p, t = _pairs_of(p, t, wide)
                at = np.searchsorted(pair, p)
                n_best.append(int(t[best[at]].sum()))
                count_sum.append(int((count[at] * t).sum()))
            yield {c: b[c] for c in (key, "n_a", "n_b", "n_groups", "n_links")} | {"n_best": n_best, "count_sum": count_sum, "groups_sha256": b["groups_sha256"]}

    return arrow_map(counted, run, f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _by_join(counted: DataFrame, marked: DataFrame, key: str, wide: bool) -> DataFrame:
    """The same by a join of documents' distinct pairs with the counts; rows get a number of their own, as ids may repeat or be null."""
    kept = materialise(counted.withColumn("_row", F.monotonically_increasing_id()), "aligned-rows")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for r, p, t in zip(b["_row"].to_pylist(), b["_pairs"].to_pylist(), b["_times"].to_pylist(), strict=True):
                p, t = _pairs_of(p, t, wide)
                if len(p):
                    yield {"_row": pa.array(np.full(len(p), r)), "pair": pa.array(p), "times": pa.array(t)}

    linked = arrow_map(kept.select("_row", "_pairs", "_times"), run, "_row long, pair long, times long").join(marked, "pair")
    sums = linked.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n_best", "count_sum")}
    out = kept.drop("_pairs", "_times").join(sums, "_row", "left").withColumns(zero)
    return out.select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def agreement(docs: DataFrame, one: bytes, two: bytes, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links of their B id's most frequent pair, sum of the links' counts, digest of the groups."""
    sides = _sides(one, two)
    width, wide = len(sides[1].pieces), len(sides[0].pieces) * len(sides[1].pieces) > 1 << 32
    counted = materialise(_counted(docs, one, two, key, text), "aligned")
    counts = materialise(pair_counts(counted, wide), "pairs")
    top = counts.groupBy((F.col("pair") % width).alias("_b")).agg(F.max("count").alias("_top"))  # at most one row per B id
    marked = counts.join(F.broadcast(top), (F.col("pair") % width) == F.col("_b")).select("pair", "count", (F.col("count") == F.col("_top")).alias("best"))
    return (_by_table if counts.count() <= limit else _by_join)(counted, marked, key, wide)
