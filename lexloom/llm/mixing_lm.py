"""Language-model scoring by logistic context mixing over bits.

Text is lower-cased (A-Z) and cut to words; a word is its bytes and a closing space, a
document's end is the empty word. Each bit of each byte is predicted in several hashed
contexts (the last bytes of the word, or the word so far; some with the class of the four
words before, which mostly tells the language). A context holds how
often the bit was 0 and 1 in training; its prediction is the logit of that share. A gate
(how many contexts have been seen, and the bit's place in the byte) selects the weights
that sum the logits; weights learn online, in small steps over batches, each token being
predicted without its own occurrence. A last table, by partial byte and predicted
logit, moves the mixed prediction towards what was observed there.

Classes come from counts of neighbouring words' endings over all training text, split by
a mixture model. Because nothing else reaches beyond the word, a word's probability is
computed once per distinct word and class: documents become runs of word numbers in
bundles of bounded size; a bundle's words travel packed, by ranges of their hashes, to
where they are counted and scored as a table, and the scores return to the bundles by
range. A range grows with the bundles that hold its words, by a few bytes each. What
is gathered (the word table) grows with the corpus; the hashed context tables have a
fixed size and are broadcast.

Defined cases: null or blank text is the end token alone; a table without training rows
gives every bit one half; repeated rows are scored each; a null doc_id hashes as the
empty text for its fold and is returned as null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise, release, summed, xxmix

#: (bytes of context, -1 for the whole word so far; with the class or not), log2 of the table's slots
CONTEXTS = ((0, True, 16), (1, True, 18), (2, False, 20), (2, True, 20), (3, True, 21), (4, False, 22), (6, False, 22), (-1, False, 22), (-1, True, 22))
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for _, _, b in CONTEXTS])])
K, GATES, STEPS = len(CONTEXTS), (len(CONTEXTS) + 1) * 8, 32
CLASSES, TAILS, BEFORE = 8, 1024, 4
BUNDLE = 16_000_000  # characters of text
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _flat(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z lower-cased, one text's behind the other's; and how many each text has. Null: none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    words = lists.flatten().cast(pa.binary())
    some = pc.binary_length(words).to_numpy() > 0  # white space at either end of a text leaves an empty word there
    length = np.diff(np.concatenate([[0], np.cumsum(some)])[lists.offsets.to_numpy()])
    return words if some.all() else words.filter(pa.array(some)), length


def _slices(b: dict, room: Callable[[], int]) -> Iterator[dict]:
    """Rows of a batch, up to the text that fills the ``room`` (in characters) there is at the time."""
    ends = np.cumsum(pc.utf8_length(b["text"]).fill_null(0).to_numpy().astype(np.int64) + 8)
    at = 0
    while at < len(ends):
        upto = min(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room())) + 1, len(ends))
        yield {n: v.slice(at, upto - at) for n, v in b.items()}
        at = upto


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words, one behind the other, and where each begins (one more: the end)."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def tails(words: pa.Array) -> np.ndarray:
    """Each word's ending: its last two bytes (spaces stand before the word), hashed to TAILS."""
    raw, offsets = _bytes_of(words)
    padded, end = np.concatenate([np.full(2, 32, np.uint8), raw]), offsets[1:]
    size = np.diff(offsets)
    two = [np.where(size >= k, padded[end + 2 - k], 32).astype(np.int64) for k in (2, 1)]
    return _TAIL_OF[two[0] * 256 + two[1]]


_TAIL_OF = (xxmix(np.arange(65_536, dtype=np.uint64)) % np.uint64(TAILS)).astype(np.int64)
SLICE = 2_000_000  # characters of text cut to words at a time


def tail_pairs(docs: DataFrame) -> np.ndarray:
    """How often each two endings follow each other in training text: TAILS x TAILS."""

    def count(batches: Iterator[dict]) -> np.ndarray:
        total = np.zeros(TAILS * TAILS)
        for b in batches:
            for part in _slices(b, lambda: SLICE):
                words, length = _flat(part["text"].filter(pc.invert(part["held"])))
                v, doc = tails(words), np.repeat(np.arange(len(length)), length)
                np.add.at(total, (v[:-1] * TAILS + v[1:])[doc[:-1] == doc[1:]], 1)
        return total

    return summed(docs, count, TAILS * TAILS).reshape(TAILS, TAILS)


def classes_of(pairs: np.ndarray, rounds: int = 60) -> np.ndarray:
    """log P(ending | class), TAILS x CLASSES, by a mixture of pairs: P(a, b) = sum_z p(z) p(a|z) p(b|z)."""
    rng = np.random.default_rng(1)
    share, ends = np.full(CLASSES, 1 / CLASSES), rng.dirichlet(np.full(TAILS, 5.0), CLASSES).T
    pairs = pairs + pairs.T
    a, b = np.nonzero(pairs)
    n = pairs[a, b] / max(pairs.sum(), 1)
    for _ in range(rounds if len(n) else 0):
        post = share * ends[a] * ends[b]
        post *= (n / np.maximum(post.sum(axis=1), 1e-300))[:, None]
        share = post.sum(axis=0)
        ends = np.stack([np.bincount(a, weights=post[:, z], minlength=TAILS) for z in range(CLASSES)], axis=1) + 1e-7
        ends /= ends.sum(axis=0)
    return np.log(ends)


def running_class(tail: np.ndarray, start: np.ndarray, ends: np.ndarray, block: int = 16_384) -> np.ndarray:
    """Class before each word from the ``BEFORE`` words ahead of it in its document; ``start``: words since the document's start.

    Works through ``block`` words at a time, as each takes CLASSES numbers.
    """
    out, by_class = np.zeros(len(tail), np.int64), np.ascontiguousarray(ends.T)
    for at in range(0, len(tail), block):
        lead = min(at, BEFORE)
        now = start[at : at + block]
        near = [now >= k for k in range(1, BEFORE + 1)]
        best = np.full(len(now), -np.inf)
        for z in range(CLASSES):
            own, total = by_class[z].take(tail[at - lead : at + block]), np.zeros(len(now))
            for k in range(1, BEFORE + 1):
                skip = min(max(0, k - lead), len(now))  # no word lies so far ahead
                if skip < len(now):
                    total[skip:] += own[lead + skip - k : len(own) - k] * near[k - 1][skip:]
            ahead = total > best
            out[at : at + block][ahead] = z
            np.maximum(best, total, out=best)
        out[at : at + block][now == 0] = 0
    return out


def _planed(ids: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed byte by byte of the numbers: the upper bytes, mostly 0, take little room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unplaned(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class Bundler:
    """Documents and their words until a bundle is full."""

    def __init__(self):
        self.doc, self.held, self.length, self.words, self.size = [], [], [], [], 0

    def add(self, part: dict) -> None:
        words, length = _flat(part["text"])
        self.doc.append(part["doc_id"])
        self.held.append(part["held"])
        self.length.append(length)
        self.words.append(words)
        self.size += len(length) * 8 + (pc.sum(pc.utf8_length(part["text"])).as_py() or 0)

    def row(self, key: int, ends: np.ndarray) -> dict:
        coded = pa.concat_arrays(self.words).dictionary_encode()
        doc, held, length = pa.concat_arrays(self.doc), pa.concat_arrays(self.held), np.concatenate(self.length)
        self.__init__()
        ids, words = coded.indices.to_numpy().astype(np.int64), pa.concat_arrays([coded.dictionary, pa.array([b""], pa.binary())])
        # each document's end is a word of its own, with a class
        last = np.cumsum(length + 1) - 1
        at = np.ones(len(ids) + len(length), bool)
        at[last] = False
        every = np.full(len(at), len(words) - 1, np.int64)
        every[at] = ids
        length = length + 1
        begin = last - length + 1
        start = np.arange(len(every)) - np.repeat(begin, length)
        size = np.concatenate([[0], np.cumsum((pc.binary_length(words).to_numpy().astype(np.int64) + 1)[every])])
        n_bytes = size[last + 1] - size[begin]
        cell = every * CLASSES + running_class(tails(words)[every], start, ends)
        there = np.zeros(len(words) * CLASSES, bool)
        there[cell] = True
        pair = np.flatnonzero(there)
        ids = (np.cumsum(there) - 1).take(cell)
        taught = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), length)
        tf = np.bincount(ids[taught], minlength=len(pair))
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v))
        return {
            "bundle": [key], "doc": one(doc), "held": one(held), "length": one(length), "bytes": one(n_bytes), "ids": [_planed(ids)],
            "words": one(words.take(pa.array(pair // CLASSES))), "cls": one(pair % CLASSES), "tf": one(tf),
        }


def _bundles(docs: DataFrame, ends: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ends)  # TAILS x CLASSES

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, seq, now = TaskContext.get().partitionId(), 0, Bundler()
        for b in batches:
            for some in _slices(b, lambda: min(BUNDLE - now.size, SLICE)):
                now.add(some)
                if now.size >= BUNDLE:
                    yield now.row((part << 32) + seq, shared.value)
                    seq, now = seq + 1, Bundler()
        if now.doc:
            yield now.row((part << 32) + seq, shared.value)

    kind = "bundle long, doc array<long>, held array<boolean>, length array<long>, bytes array<long>, ids binary, words array<binary>, cls array<int>, tf array<long>"
    return arrow_map(docs, run, kind)


def paths(words: list[bytes], cls: np.ndarray) -> tuple[np.ndarray, ...]:
    """The words' bytes, each with a closing space, as paths of a tree by class.

    Bytes that a word shares with the front of the word before it, in the same class,
    have the same contexts: they are one node. Returns every byte, its word, its place
    there, whether it opens a node, and its node; nodes are numbered in this order.
    """
    raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(length) - length
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(raw)) - starts[word]
    shared = np.zeros(len(words), np.int64)  # bytes that may be those of the word before
    shared[1:] = np.where(cls[1:] == cls[:-1], np.minimum(length[1:], length[:-1]), 0)
    ahead = np.arange(len(raw)) - np.concatenate([[0], length[:-1]])[word]
    same = (place < shared[word]) & (raw[np.maximum(ahead, 0)] == raw)
    opens = place >= np.minimum.reduceat(np.where(same, len(raw), place), starts)[word]
    # among bytes of one place, in order of words, the last one opened is a byte's node
    order = np.argsort(place.astype(np.uint16) if length.max() < 65_536 else place, kind="stable")
    last = np.maximum.accumulate(np.where(opens[order], np.arange(len(raw)), 0))
    node = np.empty(len(raw), np.int64)
    node[order] = (np.cumsum(opens) - 1)[order[last]]
    return raw, word, place, opens, node


def contexts(words: list[bytes], cls: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each bit of each node of the words (see ``paths``): its slot in every table (rows: contexts; the tables lie one behind the other) and the bit; for each byte its node and its word."""
    every, word, place, opens, node = paths(words, cls)
    raw = every.astype(np.uint64)
    power = np.cumprod(np.full(int(place.max()) + 2, _M2, np.uint64), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw + np.uint64(1)) * power[place], dtype=np.uint64)])
    sofar = ((total[:-1] - total[np.flatnonzero(place == 0)][word]) ^ (place.astype(np.uint64) * _M1))[opens]
    behind, h = [np.zeros(len(sofar), np.uint64)], np.zeros(len(raw), np.uint64)
    for n in range(1, 7):  # the last n bytes; a space stands before the word
        b = np.full(len(raw), 32, np.uint64)
        b[n:] = np.where(place[n:] >= n, raw[:-n], 32)
        h = (h + b + np.uint64(1)) * _M1
        behind.append(h[opens])
    style = (cls.astype(np.uint64) + np.uint64(1))[word[opens]] * _M3
    raw = raw[opens]
    partial = ((np.uint64(256) | raw)[:, None] >> np.arange(8, 0, -1, dtype=np.uint64)).astype(np.int32)
    slots = np.empty((K, len(raw), 8), np.int32)
    for k, (order, classed, log2) in enumerate(CONTEXTS):
        h = (sofar if order < 0 else behind[order]) + np.uint64(k + 1)
        base = (xxmix(h ^ style if classed else h) >> np.uint64(64 - log2)).astype(np.int32)
        np.add(base[:, None], partial, out=slots[k])  # the bits of a byte lie close together
        slots[k] &= np.int32((1 << log2) - 1)
        slots[k] += np.int32(OFFSETS[k])
    bits = ((raw[:, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return slots.reshape(K, -1), bits.ravel(), node, word


def _batches(b: dict, counts: str, size: int = 6_000, ordered: bool = False) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Words with their classes and counts (rows and classes where ``counts`` is not 0), about ``size`` bytes at a time, by class and word.

    ``ordered``: over the whole batch, so that neighbours share much; else each part is a share of the batch as it lies.
    """
    words, table = b["word"].to_pylist(), b[counts].flatten().to_numpy().reshape(-1, CLASSES)
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(b["word"]).to_numpy()] = np.arange(len(words))
    row, z = np.nonzero(table)
    length = pc.binary_length(b["word"]).to_numpy().astype(np.int64) + 1
    if ordered:
        cells = np.lexsort((rank[row], z))
        row, z = row[cells], z[cells]
        ends, upto_of = np.cumsum(length[row]), np.arange(1, len(row) + 1)
    else:
        ends = np.cumsum(length * np.maximum((table > 0).sum(axis=1), 1))
        upto_of = np.searchsorted(row, np.arange(len(words)), side="right")
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
        part = slice(upto_of[at - 1] if at else 0, upto_of[upto - 1])
        i, k = row[part], z[part]
        if not ordered:
            cells = np.lexsort((rank[i], k))
            i, k = i[cells], k[cells]
        if len(i):
            yield [words[j] for j in i.tolist()], k, table[i, k], i
        at = upto


def _tables(words: DataFrame, tasks: int) -> np.ndarray:
    """How often each bit followed in each slot of each table: (slots of all, 2) 16-bit counts; larger ones are scaled down in pairs."""

    def count(batches: Iterator[dict]) -> np.ndarray:
        total = np.zeros(2 * int(OFFSETS[-1]), np.float32)
        for b in batches:
            for ws, z, c, _ in _batches(b, "taught", 12_000, ordered=True):
                slots, bit, node, word = contexts(ws, z)
                weight = np.repeat(np.bincount(node, weights=c[word]), 8).astype(np.float32)
                for k in range(K):
                    np.add.at(total, slots[k].astype(np.int64) * 2 + bit, weight)
        return total

    def scaled(v: np.ndarray) -> np.ndarray:
        v = v.reshape(-1, 2)
        top = np.maximum(v.max(axis=1, keepdims=True) / 65_535, 1)
        return np.where(v > 0, np.maximum(np.round(v / top), 1), 0).ravel()

    return summed(words.where("c > 0").coalesce(tasks), count, 2 * int(OFFSETS[-1]), 1 << 18, scaled, "u2", planes=True).reshape(-1, 2)


def _packed(tables: np.ndarray) -> bytes:
    """Compressed tables: at most their fixed size of 4 bytes a slot (81 MB), little while they are empty."""
    return zstandard.ZstdCompressor(level=1).compress(tables.tobytes())


_TABLES: dict[bytes, np.ndarray] = {}


def _unpacked(shared) -> np.ndarray:
    """The tables, unpacked once per worker."""
    key = xxhash.xxh3_128_digest(shared.value)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = np.frombuffer(zstandard.ZstdDecompressor().decompress(shared.value), np.uint16).reshape(-1, 2)
    return _TABLES[key]


def _forget() -> None:
    """Give the worker's tables and freed memory back: the stages behind the scores read neither."""
    _TABLES.clear()
    release()


class Mixer:
    """Gated weights over the contexts' logits, and the final correction table."""

    def __init__(self, tables: np.ndarray):
        self.tables = np.ascontiguousarray(tables, "<u2").view("<u4").ravel()  # both counts of a slot in one number
        self.weights = np.full((GATES, K + 1), 0.3)
        self.weights[:, K] = 0
        self.seen = np.zeros((2, 256 * STEPS))
        self.total = 0.0

    def predict(self, words: list[bytes], cls: np.ndarray, without: int = 0) -> tuple[np.ndarray, ...]:
        slots, bit, node, word = contexts(words, cls)
        x = np.empty((K + 1, len(bit)), np.float32)
        depth = np.zeros(len(bit), np.uint8)
        own = (bit.astype(np.uint32) * np.uint32(65_535) + np.uint32(1)) * np.uint32(without)  # the token itself, counted in all its slots, is not yet known
        for k in range(K):
            n = self.tables.take(slots[k]) - own
            depth += (n != 0).view(np.uint8)
            np.log(((n >> np.uint32(16)).astype(np.float32) + np.float32(0.3)) / ((n & np.uint32(65_535)).astype(np.float32) + np.float32(0.3)), out=x[k])
        x[K] = 1
        gate = depth * np.int64(8) + np.tile(np.arange(8), len(bit) // 8)
        weights, z = np.ascontiguousarray(self.weights.T, np.float32), np.zeros(len(bit), np.float32)
        for k in range(K + 1):
            z += x[k] * weights[k].take(gate)
        z = np.clip(z, -12, 12).astype(np.float64)
        return x, gate, z, bit, node, word

    def place(self, z: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Cell of the correction table: partial byte and step of the logit."""
        b = bit.reshape(-1, 8).astype(np.int64)
        partial = np.ones_like(b)
        for i in range(1, 8):
            partial[:, i] = partial[:, i - 1] * 2 + b[:, i - 1]
        step = np.clip(((z + 12) * (STEPS / 24)).astype(np.int64), 0, STEPS - 1)
        return partial.ravel() * STEPS + step

    def learn(self, words: list[bytes], cls: np.ndarray, counts: np.ndarray, rate: float) -> None:
        x, gate, z, bit, node, word = self.predict(words, cls, without=1)
        c = np.repeat(np.bincount(node, weights=counts[word]), 8)
        cell = self.place(z, bit)
        for v in (0, 1):
            self.seen[v] += np.bincount(cell[bit == v], weights=c[bit == v], minlength=256 * STEPS)
        error = (bit - 1 / (1 + np.exp(-z))) * c
        mass = np.bincount(gate, weights=c, minlength=GATES)
        for k in range(K + 1):
            self.weights[:, k] += rate * np.bincount(gate, weights=error * x[k], minlength=GATES) / (mass + 1)
        self.total += float(counts.sum())

    def logs(self, words: list[bytes], cls: np.ndarray) -> np.ndarray:
        """log10 probability of each word with its closing space."""
        _, _, z, bit, node, word = self.predict(words, cls)
        p = 1 / (1 + np.exp(-z))
        cell = self.place(z, bit)
        n0, n1 = self.seen[0, cell], self.seen[1, cell]
        refined = (n1 + 20 * p) / (n0 + n1 + 20)
        p = np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)
        each = np.log10(np.where(bit == 1, p, 1 - p)).reshape(-1, 8).sum(axis=1)
        return np.bincount(word, weights=each[node], minlength=len(words))


def _mixer(words: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """Every task learns online from its share of the words; weights are averaged by tokens."""
    mixer = Mixer(np.zeros((0, 2), np.uint16))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m, step = Mixer(_unpacked(shared)), 0
        for b in batches:
            for ws, z, c, _ in _batches(b, "taught"):
                m.learn(ws, z, c, max(0.02, 0.5 / (1 + step / 25)))
                step += 1
        if m.total:
            yield {"total": [m.total], "weights": [m.weights.ravel()], "seen": [m.seen.ravel()]}

    each = materialise(arrow_map(words.where("c > 0"), run, "total double, weights array<double>, seen array<double>"), "mixers")
    flat = each.select("total", F.posexplode("weights").alias("i", "w")).groupBy("i").agg((F.sum(F.col("w") * F.col("total")) / F.sum("total")).alias("w"))
    seen = each.select(F.posexplode("seen").alias("i", "w")).groupBy("i").agg(F.sum("w").alias("w"))
    for r in flat.collect():  # GATES * (K + 1) rows
        mixer.weights.ravel()[r.i] = r.w
    for r in seen.collect():  # 512 * STEPS rows
        mixer.seen.ravel()[r.i] = r.w
    return mixer.weights, mixer.seen


RANGE = 400_000  # words of bundles that meet in one group


def _packed_words(bundles: DataFrame, ranges: int) -> DataFrame:
    """Each bundle's words with classes and counts, packed by range of the words' hashes: one row per bundle and range."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for row, key in enumerate(b["bundle"].to_pylist()):
                words, z, n = (b[name].slice(row, 1).flatten() for name in ("words", "cls", "tf"))
                z, n = z.to_numpy().astype(np.uint8), n.to_numpy().astype(np.uint32)
                at = np.fromiter((xxhash.xxh3_64_intdigest(w) % ranges for w in words.to_pylist()), np.int64, len(words))
                order = np.argsort(at, kind="stable")
                bounds = np.concatenate([[0], np.flatnonzero(np.diff(at[order])) + 1, [len(order)]])
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.take(pa.array(order))), b" ")
                parts = [order[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield {
                    "range": [int(at[i[0]]) for i in parts], "bundle": [key] * len(parts),
                    "pos": [pack(np.diff(i, prepend=0).astype(np.uint32).tobytes()) for i in parts],
                    "words": [pack(ws.as_buffer()) for ws in joined],
                    "cls": [pack(z[i].tobytes()) for i in parts], "tf": [pack(n[i].tobytes()) for i in parts],
                }

    return arrow_map(bundles, run, "range long, bundle long, pos binary, words binary, cls binary, tf binary")


def _unpack(blob, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), kind)


def _split(blobs) -> tuple[pa.Array, np.ndarray]:
    """Words of packed rows, one row's behind the other's, and the rows' bounds among them."""
    unpack = zstandard.ZstdDecompressor().decompress
    lists = pc.split_pattern(pa.array([unpack(blob.as_py()) for blob in blobs], pa.binary()), b" ")
    return lists.flatten(), lists.offsets.to_numpy()


def _counted(key, packed):
    """Words of a range over all bundles: how often taught and in how many bundles there, by class."""
    words, bounds = _split(packed["words"])
    coded = words.dictionary_encode()
    known, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    taught, there = np.zeros(len(known) * CLASSES, np.int64), np.zeros(len(known) * CLASSES, np.int64)
    for at, end, z, n in zip(bounds[:-1], bounds[1:], packed["cls"], packed["tf"], strict=True):
        cell = ids[at:end] * CLASSES + _unpack(z, np.uint8)
        np.add.at(taught, cell, _unpack(n, np.uint32).astype(np.int64))
        np.add.at(there, cell, 1)
    bounds = np.arange(0, len(taught) + 1, CLASSES, dtype=np.int32)
    release()  # of the group before
    return pa.table({
        "range": np.full(len(known), key[0].as_py()), "word": known, "c": taught.reshape(-1, CLASSES).sum(axis=1),
        "taught": pa.ListArray.from_arrays(bounds, taught), "there": pa.ListArray.from_arrays(bounds, there),
    })


def _answered(key, packed, scored):
    """Count and score of each packed word, for its bundle."""
    _forget()
    pack = zstandard.ZstdCompressor(level=1).compress
    words, bounds = _split(packed["words"])
    row = pc.index_in(words, scored["word"].combine_chunks()).to_numpy().astype(np.int64)
    c, logs = scored["c"].to_numpy(), scored["logs"].combine_chunks().flatten().to_numpy().reshape(-1, CLASSES)
    counts, values = [], []
    for at, end, z in zip(bounds[:-1], bounds[1:], packed["cls"], strict=True):
        i = row[at:end]
        counts.append(pack(c[i].astype(np.int64).tobytes()))
        values.append(logs[i, _unpack(z, np.uint8)].tobytes())
    return pa.table({"part": packed["bundle"], "pos": packed["pos"], "c": pa.array(counts, pa.binary()), "log": pa.array(values, pa.binary())})


def score(docs: DataFrame, held_out: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row.

    Counts come from the rows where ``held_out`` (a condition) is false. ``base_score``
    is the add-one unigram score; both scores are log10 of the same word sequence.
    """
    src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    bundles = materialise(_bundles(src, classes_of(tail_pairs(src))), "bundles")
    entries = bundles.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    packed = materialise(_packed_words(bundles, max(1, -(-entries // RANGE))), "packed-words")
    counted = packed.groupBy("range").applyInArrow(_counted, "range long, word binary, c long, taught array<long>, there array<long>")
    words = materialise(counted.repartition(max(1, entries // 100_000), "word"), "words")
    distinct, known, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("c") > 0, 1).otherwise(0)), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    tasks = lambda rows: max(1, -(-distinct // rows))
    shared = words.sparkSession.sparkContext.broadcast(_packed(_tables(words, tasks(400_000))))
    weights, observed = _mixer(words, shared)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m = Mixer(_unpacked(shared))
        m.weights, m.seen = weights, observed
        for b in batches:
            logs = np.zeros((len(b["word"]), CLASSES))
            for ws, z, _, i in _batches(b, "there", 12_000, ordered=True):
                logs[i, z] = m.logs(ws, z)
            yield {"range": b["range"], "word": b["word"], "c": b["c"], "logs": list(logs)}

    scored = materialise(arrow_map(words, run, "range long, word binary, c long, logs array<double>"), "word-scores")
    space = tokens + known + 1

    def total(key, left, right):
        _forget()
        base = lambda c: np.log10((c + 1) / space)
        pos, c = (np.concatenate([part(v) for v in right[n]]) for n, part in (("pos", lambda v: np.cumsum(_unpack(v, np.uint32), dtype=np.int64)), ("c", lambda v: _unpack(v, np.int64))))
        values = np.zeros((3, len(pos)))
        values[:, pos] = np.frombuffer(b"".join(right["log"].to_pylist())), base(c), c > 0
        parts = []
        for i in range(left.num_rows):
            length = np.array(left["length"][i].as_py(), np.int64)
            ids, n = _unplaned(left["ids"][i].as_py()), len(length)
            own = np.repeat(np.arange(n), length)
            log, unigram, seen = (np.bincount(own, weights=v[ids], minlength=n) for v in values)
            size = np.array(left["bytes"][i].as_py())
            parts.append(pa.table({
                "doc_id": pa.array(left["doc"][i].as_py(), pa.int64()), "held_out": pa.array(left["held"][i].as_py()), "n_tokens": length,
                "n_known": np.round(seen).astype(np.int64), "train_tokens": np.full(n, tokens, np.int64),
                "base_score": unigram, "score": log, "bits_per_byte": -log * np.log2(10) / size,
            }))
        return pa.concat_tables(parts)

    values = packed.groupBy("range").cogroup(scored.groupBy("range")).applyInArrow(_answered, "part long, pos binary, c binary, log binary")
    left = bundles.select("bundle", "doc", "held", "length", "bytes", "ids")
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return left.groupBy("bundle").cogroup(values.groupBy("part")).applyInArrow(total, kind)
