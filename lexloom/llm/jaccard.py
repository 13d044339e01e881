"""Set-similarity self-join of documents on word shingles, exact, by set-relation skipping.

A document's set holds its distinct word n-grams as 64-bit hashes. Equal sets are one
set from the start. An inverted list holds, for each element of the sets' prefixes, the
sets that have it with their size and the element's position:

1. *Star round.* In each list the set with most shared elements is the hub (in a group of
   copies, the original) and every other set whose size and position allow a link is
   paired with that hub alone. These pairs are verified. They give components and, for
   each set, its exact distance (size of the symmetric difference) to a hub.
2. *Remaining pairs.* Lists whose sets are all of one component are skipped whole, and so
   are blocks of the others; sizes and positions cut the rest to windows. A pair with a
   common hub is settled from the two known distances where the triangle inequality
   decides it; others are compared by fingerprints, whose differing segments bound the
   difference from below; what is left, and shares ``SHARED`` prefix elements, is verified.

So a group of very many near copies costs one pair per member, not all pairs, and no
link between different components is lost. Elements are ordered by a counting sketch of
fixed size (rarer first); the order affects speed only.

Defined cases: null or blank text gives the empty set and links with nothing; fewer words
than the n-gram size give one element, the whole sequence; repeated rows of a document
count as equal sets; a null doc_id takes part in nothing and has no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, arrow_map, materialise, summed, words_of, xxmix
from .components import components

SKETCH = 1 << 20
SLICE = 1 << 16
PARTS = 256  # fingerprint segments
FILTER_BITS = 1 << 24
SHARED = 3  # elements that the extended prefixes of a linked pair have in common


class Shingler:
    """Sorted distinct n-gram hashes of a text."""

    def __init__(self, n: int):
        self.n = n
        self.table = WordTable(self._places, 700_000)

    def _places(self, words: list[bytes]) -> np.ndarray:
        """A word's hash for each place in an n-gram."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        return np.stack([xxmix(h ^ xxmix(np.full(1, k + 1, np.uint64))) for k in range(self.n)], axis=1)

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        at = self.table.rows(words)
        v = self.table.values[at]
        n = min(self.n, len(v))  # a shorter text is one sequence
        total = v[: len(v) - n + 1, 0].copy()
        for k in range(1, n):
            total += v[k : len(v) - n + 1 + k, k]
        total.sort()
        return total[np.concatenate([[True], total[1:] != total[:-1]])]


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def need(na, nb, percent: int):
    """Smallest intersection that links sets of these sizes: 100 * i >= percent * (na + nb - i)."""
    return -(-percent * (na + nb) // (100 + percent))


def fingerprint(s: np.ndarray) -> bytes:
    """A byte per segment of the hash space; equal segments have equal bytes."""
    out = np.zeros(PARTS, np.uint8)
    if len(s):
        segment = (s >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        out[segment[first]] = np.bitwise_xor.reduceat(((s & np.uint64(0xFF)) | np.uint64(1)).astype(np.uint8), first)
    return out.tobytes()


def shared_needed(n, percent: int):
    """Prefix elements that a linked pair has in common: SHARED, or all that must be common."""
    return np.minimum(SHARED, -(-percent * n // 100))


def _texts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _sketch(texts: DataFrame, n: int) -> np.ndarray:
    """Counts of set elements by a slot of their hash: SKETCH numbers, whatever the input."""

    def count(batches: Iterator[dict]) -> np.ndarray:
        shingler, total = Shingler(n), np.zeros(SKETCH, np.int64)
        for b in batches:
            for at in range(0, len(b["text"]), 256):
                sets = [shingler.of(t.as_py()) for t in b["text"][at : at + 256]]
                total += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
        return total

    return summed(texts, count, SKETCH)


def _sets(texts: DataFrame, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """Per document: size, set key, prefix in the common order, fingerprint."""
    shared = texts.sparkSession.sparkContext.broadcast(np.minimum(sketch, 2**32 - 1).astype(np.uint32))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        shingler = Shingler(n)
        for b in batches:
            for at in range(0, len(b["doc_id"]), 512):
                sets = [shingler.of(t.as_py()) for t in b["text"][at : at + 512]]
                prefix = []
                for s in sets:
                    size = len(s) - -(-percent * len(s) // 100) + int(shared_needed(len(s), percent)) if len(s) else 0
                    rare = np.minimum(shared.value[(s >> np.uint64(44)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
                    prefix.append(s[np.argsort((rare << np.uint64(40)) | (s >> np.uint64(24)), kind="stable")[:size]].tobytes())
                yield {"doc_id": b["doc_id"][at : at + 512], "n": [len(s) for s in sets], "key": [set_key(s) for s in sets], "prefix": prefix, "mark": [fingerprint(s) for s in sets]}

    return arrow_map(texts, run, "doc_id long, n long, key binary, prefix binary, mark binary")


_LIST = np.dtype([("token", "<i8"), ("cell", "<i8"), ("block", "<i8"), ("n", "<i8"), ("id", "<i8"), ("pos", "<i8"), ("component", "<i8"), ("hub", "<i8"), ("far", "<i8"), ("mark", "u1", (PARTS,))])
LONG = 1 << 15  # rows of a list that one task holds at once


def _elements(sets: DataFrame) -> DataFrame:
    """One row per prefix element that at least two sets have."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, len(b["id"]), 2048):
                rows = [np.frombuffer(p, np.int64) for p in b["prefix"][at : at + 2048].to_pylist()]
                count = [len(r) for r in rows]
                out = {c: np.repeat(b[c][at : at + 2048].to_numpy(zero_copy_only=False), count) for c in ("n", "id")}
                yield {**out, "token": np.concatenate(rows), "pos": np.concatenate([np.arange(c) for c in count])}

    def shared(batches: Iterator[dict]) -> Iterator[dict]:
        last = None  # the last row, not yet known to be shared
        for b in batches:
            x = {c: v.to_numpy() for c, v in b.items()}
            if last is not None:
                x = {c: np.concatenate([last[c], v]) for c, v in x.items()}
            known = last is not None and last["known"]
            same = x["token"][1:] == x["token"][:-1]
            keep = np.concatenate([[known], same]) | np.concatenate([same, [False]])
            keep[-1] = False
            yield {c: v[keep] for c, v in x.items()}
            last = {c: v[-1:] for c, v in x.items()} | {"known": bool(same[-1]) if len(same) else known}
        if last is not None and last.pop("known"):
            yield last

    flat = arrow_map(sets, run, "token long, n long, id long, pos int")
    return arrow_map(flat.repartition("token").sortWithinPartitions("token"), shared, "token long, n long, id long, pos int")


def _rows(b: dict) -> np.ndarray:
    part = np.zeros(len(b["token"]), _LIST)
    for c in _LIST.names[:-1]:
        if c in b:
            part[c] = b[c].to_numpy(zero_copy_only=False)
    if "mark" in b and len(part):
        part["mark"] = np.frombuffer(b"".join(b["mark"].to_pylist()), np.uint8).reshape(-1, PARTS)
    return part


def _star_pairs(elements: DataFrame, percent: int) -> DataFrame:
    """Each set with the hub of its list; a task walks its lists as a stream, hubs first."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        head = np.zeros(0, _LIST)
        for b in batches:
            r = np.concatenate([head, _rows({c: v for c, v in b.items() if c != "degree"})])
            first = np.concatenate([[True], r["token"][1:] != r["token"][:-1]])
            hub = np.flatnonzero(first)[np.cumsum(first) - 1]
            heads = r[hub]
            ok = ~first & (100 * np.minimum(r["n"], heads["n"]) >= percent * np.maximum(r["n"], heads["n"]))
            ok &= np.minimum(r["n"] - r["pos"], heads["n"] - heads["pos"]) + SHARED - 1 >= need(r["n"], heads["n"], percent)
            if ok.any():
                yield {"a": r["id"][ok], "b": heads["id"][ok]}
            head = heads[-1:]

    degree = elements.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    lists = elements.join(degree, "id").repartition("token").sortWithinPartitions("token", F.desc("degree"), "id")
    # two near sets meet in several lists, others by chance in one
    return arrow_map(lists, run, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("a", "b")


def _other_pairs(elements: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that sizes, positions, distances and fingerprints leave open.

    Lists of one component are skipped whole. A list longer than ``LONG`` is dealt in
    blocks, each two of which meet in one cell. ``settled``: linked by the distances to a
    common hub, so not verified again.
    """
    named = elements.join(known.select("id", "component"), "id")
    mixed = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("length")).where("low <> high")
    blocks = F.ceil(F.col("length") / LONG)
    rows = (
        elements.join(mixed.select("token", blocks.alias("blocks")), "token").join(known.select("id", "component", "hub", "far", "mark"), "id")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("cell", (F.greatest("block", "other") * (F.greatest("block", "other") + 1) / 2 + F.least("block", "other")).cast("long"))
        .drop("other", "blocks")
    )

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rest = np.zeros(0, _LIST)
        for b in batches:
            rest = np.concatenate([rest, _rows(b)])
            cut = np.flatnonzero((rest["token"][1:] != rest["token"][:-1]) | (rest["cell"][1:] != rest["cell"][:-1])) + 1
            for x in np.split(rest, cut)[:-1]:
                yield from _block_pairs(x, percent)
            rest = rest[cut[-1] :] if len(cut) else rest
        if len(rest):
            yield from _block_pairs(rest, percent)

    dealt = rows.repartition("token", "cell").sortWithinPartitions("token", "cell", "n", "id")
    times = F.sum("times")
    return arrow_map(dealt, run, "a long, b long, settled boolean, least int, times int").groupBy("a", "b").agg(F.max("settled").alias("settled"), times.alias("times"), F.max("least").alias("least")).where("times >= least")


def _block_pairs(x: np.ndarray, percent: int, width: int = 256) -> Iterator[dict]:
    """Candidates of one list or cell, sorted by size: windows of sizes, then positions and distances."""
    blocks = len(np.unique(x["block"]))
    upto = np.searchsorted(100 * x["n"], percent * x["n"], side="left")  # first partner that is large enough
    for at in range(0, len(x), width):
        right = x[at : at + width]
        for start in range(int(upto[at]) // width * width, at + 1, width):
            left = x[start : start + width]
            if left["component"].min() == left["component"].max() == right["component"].min() == right["component"].max():
                continue
            i, j = np.nonzero(left["component"][:, None] != right["component"][None, :])
            keep = start + i < at + j
            if blocks > 1:
                keep &= left["block"][i] != right["block"][j]
            a, b = left[i[keep]], right[j[keep]]
            least = need(a["n"], b["n"], percent)
            ok = np.minimum(a["n"] - a["pos"], b["n"] - b["pos"]) + SHARED - 1 >= least
            ok &= 100 * np.minimum(a["n"], b["n"]) >= percent * np.maximum(a["n"], b["n"])
            a, b, least = a[ok], b[ok], least[ok]
            apart = a["n"] + b["n"] - 2 * least  # largest symmetric difference of a link
            common = (a["hub"] == b["hub"]) & (a["far"] >= 0) & (b["far"] >= 0)
            settled = common & (a["far"] + b["far"] <= apart)
            open_ = ~common | (np.abs(a["far"] - b["far"]) <= apart)
            look = np.flatnonzero(open_ & ~settled)
            open_[look] = (a["mark"][look] != b["mark"][look]).sum(axis=1) <= apart[look]
            if open_.any():
                a, b, settled = a[open_], b[open_], settled[open_]
                enough = np.minimum(shared_needed(a["n"], percent), shared_needed(b["n"], percent))
                yield {"a": np.minimum(a["id"], b["id"]), "b": np.maximum(a["id"], b["id"]), "settled": settled, "least": enough, "times": np.ones(len(a), np.int32)}


def _verify(pairs: DataFrame, sets: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Linked pairs with their symmetric difference: a, b, far.

    First by fingerprints (segments that differ bound the difference from below), then
    on whole sets, recomputed for the documents that are left.
    """
    marks = sets.select(F.col("id"), F.col("n"), F.col("mark"))
    ma = marks.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("mark").alias("ma"))
    mb = marks.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("mark").alias("mb"))

    def close(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            if len(b["a"]):
                na, nb = b["na"].to_numpy(), b["nb"].to_numpy()
                ma, mb = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(-1, PARTS) for c in ("ma", "mb"))
                ok = (ma != mb).sum(axis=1) <= na + nb - 2 * need(na, nb, percent)
                yield {"a": b["a"].to_numpy()[ok], "b": b["b"].to_numpy()[ok]}

    left = materialise(arrow_map(pairs.join(ma, "a").join(mb, "b"), close, "a long, b long"), "close-pairs")
    wanted = sets.select("id", "doc", "key").join(left.select(F.col("a").alias("id")).union(left.select("b")).distinct(), "id")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)  # 2 MB: a hashed filter of fixed size, made exact by the joins below
    for r in wanted.select(slot("doc").alias("s")).groupBy((F.col("s") / SLICE).cast("int").alias("k")).agg(F.collect_set((F.col("s") % SLICE).cast("int")).alias("s")).toLocalIterator():
        at = r.k * SLICE + np.array(r.s)
        np.bitwise_or.at(bits, at // 8, (1 << (at % 8)).astype(np.uint8))
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def again(batches: Iterator[dict]) -> Iterator[dict]:
        shingler = Shingler(n)
        for b in batches:
            at = b["slot"].to_numpy()
            for i in np.flatnonzero(shared.value[at // 8] >> (at % 8) & 1).tolist():
                found = shingler.of(b["text"][i].as_py())
                yield {"key": [set_key(found)], "elements": [found.tobytes()]}

    again_ = arrow_map(texts.select("text", slot("doc_id").alias("slot")), again, "key binary, elements binary")
    full = again_.join(wanted.select("id", "key"), "key").groupBy("id").agg(F.first("elements").alias("elements"))
    full = materialise(full, "whole-sets")
    sa, sb = full.select(F.col("id").alias("a"), F.col("elements").alias("sa")), full.select(F.col("id").alias("b"), F.col("elements").alias("sb"))

    def exact(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = []
            for a_, b_, x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), b["sa"].to_pylist(), b["sb"].to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(u) + len(v) - len(np.union1d(u, v))
                if both >= need(len(u), len(v), percent):
                    out.append((a_, b_, len(u) + len(v) - 2 * both))
            if out:
                yield dict(zip(("a", "b", "far"), zip(*out, strict=True), strict=True))

    return arrow_map(left.join(sa, "a").join(sb, "b"), exact, "a long, b long, far long")


def similar_documents(docs: DataFrame, n: int = 3, percent: int = 90, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` with a doc_id: doc_id, n_shingles, component_id.

    Two documents link when ``100 * |A and B| >= percent * |A or B|``; component_id is the
    smallest doc_id reachable by links.
    """
    texts = _texts(docs, doc, text)
    every = materialise(_sets(texts, n, percent, _sketch(texts, n)), "sets")
    filled = every.where("n > 0")
    sets = filled.groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("mark").alias("mark"))
    sets = materialise(sets.withColumn("id", F.monotonically_increasing_id()), "distinct-sets")  # stored, so the numbers hold
    elements = materialise(_elements(sets), "elements")
    none = F.lit(-1).cast("long")
    stars = materialise(_verify(materialise(_star_pairs(elements, percent), "star-pairs"), sets, texts, n, percent), "stars")
    grouped = components(stars)
    # each set's exact distance to one hub; a hub that is no other hub's member has distance 0 to itself
    hubs = stars.groupBy(F.col("a").alias("id")).agg(F.min(F.struct("b", "far")).alias("h")).select("id", F.col("h.b").alias("hub"), F.col("h.far").alias("far"))
    own = stars.select(F.col("b").alias("id")).distinct().join(hubs, "id", "left_anti").select("id", F.col("id").alias("hub"), F.lit(0).cast("long").alias("far"))
    known = materialise(
        sets.select("id", "mark").join(grouped.withColumnRenamed("node", "id"), "id", "left").join(hubs.unionByName(own), "id", "left")
        .select("id", "mark", F.coalesce("component", "id").alias("component"), F.coalesce("hub", none).alias("hub"), F.coalesce("far", none).alias("far")),
        "known",
    )
    rest = materialise(_other_pairs(elements, known, percent), "other-pairs")
    more = _verify(rest.where("not settled").select("a", "b"), sets, texts, n, percent)
    links = stars.select("a", "b").union(more.select("a", "b")).union(rest.where("settled").select("a", "b"))
    label = F.coalesce("component", "id")
    found = materialise(sets.select("id", "doc").join(components(links).withColumnRenamed("node", "id"), "id", "left").select("id", "doc", label.alias("component")), "labels")
    smallest = found.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = found.join(smallest, "component").select("id", "component_id").join(sets.select("id", "key"), "id")
    linked = filled.select("doc_id", F.col("n").alias("n_shingles"), "key").join(named, "key").drop("id", "key")
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(every.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
