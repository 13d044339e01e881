"""SentencePiece encoding and decoding by a max-plus parallel scan.

A document is cut into chunks of ``CHUNK`` characters, wherever that falls. The state at a
chunk's border is the piece that covers or ends at it. A chunk's transfer matrix holds, for
each state at its left and each at its right border, the best weight of the pieces between
(minus infinity if none fit). Matrices combine associatively, max for sum and plus for
product, in groups of ``FAN`` until one per document is left; the way down fixes every
border's state, and each chunk is traced back on its own.

Weights are the model's. Unigram models add piece scores. In models of merges (BPE) all
weights are 0 and two pieces may only be neighbours if merging their joined text gives
exactly these two: a sequence of pieces is the model's encoding if and only if all its
neighbours are such pairs, so the one finite path is the encoding.

Borders that no piece of the vocabulary can cross have one state, so inside a chunk the
text between two such borders encodes alone, once per distinct string. A document of one
chunk needs no scan. Ids equal the library's for models without text normalisation
(spaces become U+2581, one is put in front); unknown characters become byte pieces, or the
unknown id in models without them.

Defined cases: null text counts as empty and gives no ids; repeated rows are encoded each;
decoding drops the space in front, takes U+2581 for a space, and replaces bytes that are
not UTF-8; control ids decode to nothing. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise

CHUNK, FAN = 16_384, 64
LONGEST = 256  # characters of a remembered word
SPACE = "▁"
NONE = float("-inf")
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+")


class Words(dict):
    """Ids of words (without the space in front of them), learned as they are met.

    At ``limit`` words these become the words before, which answer until the next turn.
    Words of more than ``LONGEST`` characters are not kept.
    """

    def __init__(self, model: Model, limit: int = 250_000):
        super().__init__()
        self.model, self.limit, self.before = model, limit, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.model.between(SPACE + word)
        if len(word) <= LONGEST:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


@dataclass
class Model:
    """Pieces of a SentencePiece model in plain form."""

    score: dict[str, float]  # of normal pieces
    ids: dict[str, int]
    texts: list[bytes]  # what an id decodes to
    bytes_: list[int] | None  # ids of the 256 byte pieces
    unknown: int
    merges: bool
    pairs: set[str] = field(default_factory=set)  # neighbouring characters inside pieces
    longest: int = 1

    def __post_init__(self):
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.longest = max(map(len, self.score), default=1)
        self.by_words = not any(p[1] == SPACE != p[0] for p in self.pairs)  # no piece crosses into a space
        self.worst = min(self.score.values(), default=0.0) - 10
        self.packed = {p: np.array([i], "<i4").tobytes() for p, i in self.ids.items()}
        self._forget()

    def _forget(self) -> None:
        self.links: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}  # parts of words
        self.words = Words(self)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("links", "known", "words")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def merged(self, text: str) -> list[str]:
        """Best-score, leftmost merges until none is left."""
        get, out = self.score.get, list(text)
        rank = [get(two, NONE) for two in map(add, text, text[1:])]
        while rank:
            best = max(rank)
            if best == NONE:
                break
            i = rank.index(best)
            out[i] = now = out[i] + out.pop(i + 1)
            del rank[i]
            if i:
                rank[i - 1] = get(out[i - 1] + now, NONE)
            if i < len(rank):
                rank[i] = get(now + out[i + 1], NONE)
        return out

    def best_path(self, text: str) -> list[str]:
        """Pieces with the largest sum of scores."""
        best, back = [0.0] + [NONE] * len(text), [0] * (len(text) + 1)
        for s in range(len(text)):
            for t in self.starting(text, s):
                w = best[s] + self.weight(t)
                if w > best[s + len(t)]:
                    best[s + len(t)], back[s + len(t)] = w, s
        out, e = [], len(text)
        while e:
            out.append(text[back[e] : e])
            e = back[e]
        return out[::-1]

    def starting(self, text: str, s: int) -> list[str]:
        """Pieces that start at ``s``; a character that is no piece stands for itself."""
        out = [text[s : s + 1]]
        for e in range(s + 2, min(len(text), s + self.longest) + 1):
            if text[e - 2 : e] not in self.pairs:
                break
            if text[s:e] in self.score:
                out.append(text[s:e])
        return out

    def weight(self, piece: str) -> float:
        return 0.0 if self.merges else self.score.get(piece, self.worst)

    def link(self, a: str | None, b: str) -> bool:
        """May ``b`` follow ``a``? (None: the text starts, or a border no piece crosses)"""
        if not self.merges:
            return True
        if a is None or a[-1] + b[0] not in self.pairs:
            a = ""
        key = (a, b)
        if key not in self.links:
            if len(self.links) > 500_000:
                self.links.clear()
            self.links[key] = self.merged(a + b) == ([a, b] if a else [b])
        return self.links[key]

    def id_bytes(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.packed.__getitem__, pieces))
        except KeyError:  # characters that are no piece
            out: list[int] = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.bytes_:
                out += [self.bytes_[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    def between(self, text: str) -> bytes:
        """Ids of a text that starts and ends at borders no piece crosses."""
        pairs = self.pairs
        cuts = [i for i, two in enumerate(map(add, text, text[1:]), 1) if two not in pairs]
        if not cuts:
            return self._uncut(text)
        return b"".join([self._part(text[i:j]) for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)])

    def _uncut(self, text: str) -> bytes:
        return self.id_bytes(self.merged(text) if self.merges else self.best_path(text))

    def _part(self, part: str) -> bytes:
        """Ids of a part without such borders; a word is remembered once, whatever stands behind it."""
        if part[0] == SPACE and SPACE not in part[1:]:
            return self.words[part[1:]]
        ids = self.known.get(part)
        if ids is None:
            ids = self._uncut(part)
            if len(part) <= LONGEST:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[part] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, without chunks."""
        if not text:
            return b""
        return self.by_space(SPACE + text.replace(" ", SPACE))

    def by_space(self, text: str) -> bytes:
        """``between`` by words, each looked up as a whole."""
        if not self.by_words:
            return self.between(text)
        if SPACE + SPACE in text or text[-1:] == SPACE:
            return b"".join([self.words[w[1:]] if w[0] == SPACE != w[1:2] else self.between(w) for w in _RUNS.findall(text)])
        first, *words = text.split(SPACE)
        return (self.between(first) if first else b"") + b"".join(map(self.words.__getitem__, words))

    def decode(self, ids, first: bool = True) -> str:
        out = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return out[1:] if first and out.startswith(" ") else out


def load(path: str, merges: bool | None = None) -> Model:
    """Read a model file with the sentencepiece library; only its pieces are used afterwards.

    ``merges``: a model of merges rather than of piece scores; by default told from the scores.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    score, ids, texts, raw = {}, {}, [], {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            raw[int(p[3:-1], 16)] = i
            texts.append(bytes([int(p[3:-1], 16)]))
        elif sp.is_control(i):
            texts.append(b"")
        elif sp.is_unknown(i):
            texts.append(" ⁇ ".encode())
        else:
            texts.append(p.encode())
            if not sp.is_unused(i):
                score[p], ids[p] = sp.get_score(i), i
    if merges is None:  # scores of merges are the negative ranks of the pieces
        merges = all(x <= 0 and x == int(x) for x in score.values())
    return Model(score, ids, texts, [raw[b] for b in range(256)] if len(raw) == 256 else None, sp.unk_id(), merges)


State = tuple[int, int] | None


def states(m: Model, text: str, at: int) -> list[State]:
    """States at a border of ``text``: (start, end) of a piece with start < at <= end, relative
    to it; None alone where no piece crosses."""
    if at <= 0 or at >= len(text) or text[at - 1 : at + 1] not in m.pairs:
        return [None]
    out = []
    for s in range(max(0, at - m.longest), at):
        for t in m.starting(text, s):
            if s + len(t) >= at and m.link(None, t):
                out.append((s - at, s + len(t) - at))
    return out


def paths(m: Model, text: str, left: list[State], p: int, q: int) -> list[dict]:
    """By end: by start, the best weight from each left state to the piece that ends there.

    ``left`` are the states at ``p``; pieces start before ``q``.
    """
    n = len(left)
    at: list[dict[int, np.ndarray]] = [{} for _ in range(q - p + m.longest + 1)]
    for i, st in enumerate(left):
        s, e = (0, 0) if st is None else st
        at[e].setdefault(s, np.full(n, NONE))[i] = 0.0
    for e in range(q - p):
        if not at[e]:
            continue
        for t in m.starting(text, p + e):
            best = None
            for s, w in at[e].items():
                before = None if s == e else text[p + s : p + e]
                if m.link(before, t):
                    best = w if best is None else np.maximum(best, w)
            if best is not None and e + len(t) < len(at):
                at[e + len(t)][e] = best + m.weight(t)
    return at


def cuts_of(m: Model, text: str, p: int, q: int) -> tuple[int, int] | None:
    """First and last border within [p, q] that no piece crosses."""
    first = next((i for i in range(p, q + 1) if i <= 0 or i >= len(text) or text[i - 1 : i + 1] not in m.pairs), None)
    if first is None:
        return None
    return first, next(i for i in range(q, p - 1, -1) if i <= 0 or i >= len(text) or text[i - 1 : i + 1] not in m.pairs)


def arrive(at: list[dict], right: list[State], width: int, n: int) -> np.ndarray:
    """Weights from each left state to each right state, ``width`` behind the left border."""
    out = np.full((n, len(right)), NONE)
    for j, st in enumerate(right):
        if st is None:
            for w in at[width].values():
                out[:, j] = np.maximum(out[:, j], w)
        else:
            w = at[width + st[1]].get(width + st[0])
            if w is not None:
                out[:, j] = w
    return out


def transfer(m: Model, text: str, p: int, q: int) -> np.ndarray:
    """Transfer matrix of text[p:q]; ``text`` holds ``longest`` characters more on each side, if there are any."""
    left, right = states(m, text, p), states(m, text, q)
    cut = cuts_of(m, text, p, q)
    if cut is None:
        return arrive(paths(m, text, left, p, q), right, q - p, len(left))
    a, b = cut
    to = arrive(paths(m, text, left, p, a), [None], a - p, len(left)) if a > p else np.zeros((len(left), 1))
    off = arrive(paths(m, text, [None], b, q), right, q - b, 1) if b < q else np.zeros((1, len(right)))
    middle = 0.0 if m.merges else sum(m.weight(t) for t in m.best_path(text[a:b]))
    return to + middle + off


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def trace(m: Model, text: str, p: int, q: int, i: int, j: int) -> bytes:
    """Ids of the pieces that start in text[p:q], from left state ``i`` to right state ``j``."""
    left, right = states(m, text, p), states(m, text, q)
    cut = cuts_of(m, text, p, q)
    if cut is None:
        return m.id_bytes(_walk(m, text, p, q, left[i], right[j]))
    a, b = cut
    head = _walk(m, text, p, a, left[i], None) if a > p else []
    tail = _walk(m, text, b, q, None, right[j]) if b < q else []
    return m.id_bytes(head) + m.by_space(text[a:b]) + m.id_bytes(tail)


def _walk(m: Model, text: str, p: int, q: int, entry: State, leave: State) -> list[str]:
    at, width = paths(m, text, [entry], p, q), q - p
    if leave is None:
        s, e = max(at[width], key=lambda s: (at[width][s][0], -s)), width
    else:
        s, e = width + leave[0], width + leave[1]
    start, out = (0, 0) if entry is None else entry, []
    while (s, e) != start:
        piece = text[p + s : p + e]
        out.append(piece)
        options = [(w[0], -b, b) for b, w in at[s].items() if w[0] != NONE and m.link(None if b == s else text[p + b : p + s], piece)]
        s, e = max(options)[2], s
    return out[::-1]


def _source(docs: DataFrame, doc: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *[F.col(c).cast("string").alias(f"_{c}") for c in keep])


def _short(src: DataFrame, shared, chunk: int, kept: list[str]) -> DataFrame:
    """Documents of one chunk, encoded at once."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, len(b["doc_id"]), 512):
                part = {c: v[at : at + 512] for c, v in b.items()}
                yield {**part, "ids": [shared.value.encode(t.as_py()) for t in part["text"]]}

    made = arrow_map(src.where(F.length("text") < chunk), run, f"doc_id long, ids binary{''.join(f', {c} string' for c in kept)}")
    return made.select(F.lit(None).cast("long").alias("row"), "doc_id", F.lit(0).cast("long").alias("chunk"), F.lit(1).cast("long").alias("chunks"), "ids", *kept)


def _chunks(src: DataFrame, shared, chunk: int, kept: list[str]) -> DataFrame:
    """Chunks of the longer documents, each with the characters around it."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        row, around = TaskContext.get().partitionId() << 32, shared.value.longest
        for b in batches:
            for i in range(len(b["doc_id"])):
                row += 1
                t = SPACE + b["text"][i].as_py().replace(" ", SPACE)
                starts = list(range(0, len(t), chunk))
                n = len(starts)
                yield {
                    "row": [row] * n, "doc_id": [b["doc_id"][i].as_py()] * n, "chunk": list(range(n)), "chunks": [n] * n, "lead": [min(p, around) for p in starts],
                    "size": [min(chunk, len(t) - p) for p in starts], "text": [t[max(0, p - around) : p + chunk + around] for p in starts],
                    **{c: [b[c][i].as_py()] * n for c in kept},
                }

    kind = "row long, doc_id long, chunk long, chunks long, lead int, size int, text string" + "".join(f", {c} string" for c in kept)
    return materialise(arrow_map(src.where(F.length("text") >= chunk), run, kind), "chunks")


def _pack(x: np.ndarray) -> bytes:
    return np.array(x.shape, "<i4").tobytes() + x.astype("<f8").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f8", offset=8).reshape(np.frombuffer(raw, "<i4", 2))


def _up(t: pa.Table) -> pa.Table:
    """One matrix for a group of neighbouring ones."""
    t = t.sort_by("at")
    total = None
    for raw in t["matrix"].to_pylist():
        total = _unpack(raw) if total is None else product(total, _unpack(raw))
    return pa.table({"row": t["row"][:1], "at": t["group"][:1], "matrix": pa.array([_pack(total)], pa.binary())})


def _down(t: pa.Table) -> pa.Table:
    """States at the borders inside a group whose outer states are known."""
    t = t.sort_by("at")
    parts = [_unpack(r) for r in t["matrix"].to_pylist()]
    first, last = t["entry"][0].as_py(), t["leave"][0].as_py()
    behind = [parts[-1][:, [last]]]  # from each border to the group's end
    for x in parts[-2::-1]:
        behind.append(product(x, behind[-1]))
    behind.reverse()
    entry, leave, now = [], [], first
    for k, x in enumerate(parts):
        entry.append(now)
        now = last if k == len(parts) - 1 else int(np.argmax(x[now] + behind[k + 1][:, 0]))
        leave.append(now)
    return pa.table({"row": t["row"], "at": t["at"], "entry": pa.array(entry, pa.int32()), "leave": pa.array(leave, pa.int32())})


def encode(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", chunk: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """row, doc_id, chunk, chunks, ids (little-endian int32 bytes): the ids of each document by chunk.

    ``row`` numbers the documents of several chunks and is null for the others. The
    columns in ``keep`` go along as text, with "_" in front of their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary
    src, kept = _source(docs, doc, text, keep), [f"_{c}" for c in keep]
    done = _short(src, shared, chunk, kept)
    long_ = _chunks(src, shared, chunk, kept)
    most = long_.agg(F.max("chunks")).first()[0]
    if most is None:
        return done
    spread = max(1, long_.count() // 256)

    def matrices(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = [_pack(transfer(shared.value, t, p, p + n)) for t, p, n in zip(b["text"].to_pylist(), b["lead"].to_pylist(), b["size"].to_pylist(), strict=True)]
            yield {"row": b["row"], "at": b["chunk"], "matrix": out}

    dealt = long_.repartition(spread, "row", "chunk")
    levels = [materialise(arrow_map(dealt, matrices, "row long, at long, matrix binary"), "matrices")]
    width = most
    while width > 1:
        width = -(-width // FAN)
        group = levels[-1].withColumn("group", F.floor(F.col("at") / FAN)).groupBy("row", "group")
        levels.append(materialise(group.applyInArrow(_up, "row long, at long, matrix binary"), "matrices"))
    outer = levels[-1].select("row", "at", F.lit(0).alias("entry"), F.lit(0).alias("leave"))  # the whole document: one state at each end
    for level in levels[-2::-1]:
        inside = level.withColumn("group", F.floor(F.col("at") / FAN)).join(outer.withColumnRenamed("at", "group"), ["row", "group"])
        outer = materialise(inside.groupBy("row", "group").applyInArrow(_down, "row long, at long, entry int, leave int"), "states")

    def back(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            got = zip(*(b[c].to_pylist() for c in ("text", "lead", "size", "entry", "leave")), strict=True)
            yield {**b, "ids": [trace(shared.value, t, p, p + n, i, j) for t, p, n, i, j in got]}

    ready = long_.join(outer.withColumnRenamed("at", "chunk"), ["row", "chunk"])
    kind = "row long, doc_id long, chunk long, chunks long, ids binary" + "".join(f", {c} string" for c in kept)
    return done.unionByName(materialise(arrow_map(ready, back, kind), "traced"))


def whole(encoded: DataFrame) -> DataFrame:
    """doc_id, ids (and kept columns), one row per document; only documents of several chunks are grouped."""
    rest = [c for c in encoded.columns if c not in ("row", "chunk", "chunks", "ids")]
    one = encoded.where("chunks = 1").select(*rest, "ids")
    grouped = encoded.where("chunks > 1").groupBy("row").agg(*[F.first(c).alias(c) for c in rest], F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))

    def join(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {**b, "ids": [b"".join(x["ids"] for x in p) for p in b["parts"].to_pylist()]}

    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema}
    return one.unionByName(arrow_map(grouped, join, ", ".join(f"`{c}` {kinds[c]}" for c in [*rest, "ids"])))


def decode(documents: DataFrame, model: Model) -> DataFrame:
    """Adds ``text`` to the rows of ``whole``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, len(b["ids"]), 512):
                part = {c: v[at : at + 512] for c, v in b.items()}
                yield {**part, "text": [shared.value.decode(np.frombuffer(i.as_py(), "<i4").tolist()) for i in part["ids"]]}

    return arrow_map(documents, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + ", text string")
