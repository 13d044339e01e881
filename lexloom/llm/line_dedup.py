"""Line deduplication by a segment-partition edit join, with DataFrame functions only.

Two lines are near copies when their edit distance is at most ``threshold``. Every line
is cut to threshold + 1 segments; by the pigeonhole principle a near copy of length L
contains one of the segments unchanged. A line therefore offers its own segments and asks,
for each partner length from its own down to ``threshold`` less, for the substrings that
can stand for that length's segments: for segment i and length difference d the offsets
from max(1 - i, d - t - 1 + i) to min(i - 1, d + t + 1 - i) (t: threshold). Only lines
that meet another in some key get their text back, and they are compared by Spark's
banded edit distance, which stops beyond the threshold; each line looks for one earlier
near copy, so that a large group of near copies gives no pairs.

A key with more than ``dense`` lines (a common opening before different texts) is not
compared as it is. First all its lines meet its earliest one, which settles large groups
of near copies. Then the shared segment is taken out: the rests of two near copies differ
by at most the same number of edits, so they too agree in one of their threshold + 1
segments, and key and new segment together are the key of the next level. Levels go on
while such a key still has too many lines; each makes the rests a third shorter. Keys are compared
at once when their rests are short or when a level would multiply the rows (GROWTH),
which changes the cost, not the result.

Which lines go: of equal lines (whole text, at least ``least`` characters) all but the
first by (doc_id, place); and every line that has an earlier line, itself dropped or not,
within the threshold. Shorter lines stay. Lines are cut at line feeds.

Defined cases: null text stays null, empty text is one short line; documents keep their
row even when no line is left (empty text); a null doc_id comes after all others; rows of
one doc_id are one document, so that equal rows are treated alike; extra columns pass
through, whatever their names, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SLOTS = 1 << 20
DENSE = 200  # lines of a key that are compared as they are
LEVELS, GROWTH, SHORT = 8, 16, 4  # levels of keys; rows of a level against the first; least characters of a rest's segment
_LAST = (1 << 63) - 1
#: (doc, pos) as one number, which unlike a struct a hash aggregate can hold.
PLACE = "cast(doc as decimal(20, 0)) * 4294967296 + pos"


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of the i-th of ``parts`` even segments; the last ones are the longer."""
    base = F.floor(length / parts)
    short = parts - (length - base * parts)  # segments of the smaller length
    start = F.lit(1) + base * (i - 1) + F.greatest(F.lit(0), F.lit(i - 1) - short)
    return start.cast("int"), (base + F.when(F.lit(i) > short, 1).otherwise(0)).cast("int")


def kinds(threshold: int) -> list[tuple[int, int, int]]:
    """(segment, length difference, shift) of a line's keys; the first threshold + 1 are its own segments."""
    parts = threshold + 1
    own = [(i, 0, 0) for i in range(1, parts + 1)]
    asked = [
        (i, d, shift)
        for d in range(threshold + 1) for i in range(1, parts + 1)
        for shift in range(max(1 - i, d - (parts - i)), min(i - 1, d + parts - i) + 1)
        if (i, d, shift) not in own
    ]
    return own + asked


def keys(line: Column, length: Column, threshold: int) -> list[Column]:
    """Hashed keys of a line, one for each of ``kinds``."""
    out = []
    for i, d, shift in kinds(threshold):
        start, size = _segment(length - d, i, threshold + 1)
        out.append(F.xxhash64(F.lit(i), length - d, line.substr(start + shift, size)))
    return out


def _without(rest: str, threshold: int) -> list[Column]:
    """``diff`` and ``rest``: the length difference of key ``k`` and the text without its segment."""
    length, every = F.length(rest), kinds(threshold)
    cut = [(*_segment(length - d, i, threshold + 1), shift) for i, d, shift in every]
    start, size = F.get(F.array(*[a + shift for a, _, shift in cut]), F.col("k")), F.get(F.array(*[n for _, n, _ in cut]), F.col("k"))
    left = F.substring(rest, F.lit(1), start - 1)
    return [F.get(F.array(*[F.lit(d) for _, d, _ in every]), F.col("k")).alias("diff"), F.concat(left, F.substring(rest, start + size, length)).alias("rest")]


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows of keys where a line's own segment meets another line and some line still asks; ``n``: rows of the key times those that ask."""
    w = Window.partitionBy("key")
    met = rows.withColumns({
        "low": F.min("id").over(w), "high": F.max("id").over(w), "any": F.max("own").over(w),
        "n": F.count(F.lit(1)).over(w) * F.count_if("seek").over(w),
    })
    return met.where("any and low <> high and n > 0").drop("low", "high", "any")


def _compared(rows: DataFrame, threshold: int) -> DataFrame:
    """id, h2 of the asking lines with an earlier line of the same key within the threshold."""
    a = rows.where("seek")
    b = rows.select(F.col("key").alias("key_b"), F.col("own").alias("own_b"), F.col("first").alias("first_b"), F.col("line").alias("line_b"))
    found = a.join(
        b,
        (F.col("key") == F.col("key_b")) & (F.col("own") | F.col("own_b")) & (F.col("first_b") < F.col("first"))
        & (F.levenshtein("line", "line_b", threshold) >= 0),
        "left_semi",
    )
    return found.select("id", "h2")


def _refined(rows: DataFrame, threshold: int, dense: int) -> DataFrame:
    """id, h2 as ``_compared``, for keys of more than ``dense`` lines; levels stop with the last line that asks; rows: key, id, h2, own, k, first, line, rest, seek."""
    found, most = [], None
    for level in range(LEVELS):
        held = rows.count()
        most = held if most is None else most
        if not held:
            break
        # the earliest line of each key settles the lines near it
        hub = rows.groupBy("key").agg(F.min_by(F.struct("first", "line"), "first").alias("hub"))
        near = rows.join(hub, "key").where((F.col("hub.first") < F.col("first")) & (F.levenshtein("line", F.col("hub.line"), threshold) >= 0))
        near = materialise(near.select("id", "h2").distinct(), "hub-lines")
        found.append(near)
        asks = rows.join(near.withColumn("settled", F.lit(True)), ["id", "h2"], "left").withColumn("seek", F.col("seek") & F.col("settled").isNull()).drop("settled")
        if level == LEVELS - 1 or held > GROWTH * most:
            found.append(_compared(asks, threshold))
            break
        cut = asks.select("key", "id", "h2", "own", "first", "line", "seek", *_without("rest", threshold))
        every, size = keys(F.col("rest"), F.length("rest"), threshold), F.length("rest") - F.col("diff")
        # partners keep their length difference; a line that asked for the segment goes on asking
        made = cut.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("d"), F.xxhash64("key", h).alias("hash")) for k, ((_, d, _), h) in enumerate(zip(kinds(threshold), every, strict=True))])).alias("x"))
        made = made.where("x.d = diff").select(
            F.col("x.hash").alias("key"), "id", "h2", (F.col("own") & (F.col("x.k") <= threshold)).alias("own"), F.col("x.k").alias("k"),
            "first", "line", "rest", "seek", (size < SHORT * (threshold + 1)).alias("short"),
        )
        met = materialise(_grouped(made), "line-rests")
        ready = F.col("short") | (F.col("n") <= dense * dense)
        found.append(_compared(met.where(ready), threshold))
        rows = met.where(~ready).drop("n", "short")
    out = found[0] if found else rows.select("id", "h2")
    for more in found[1:]:
        out = out.union(more)
    return out


def lines_of(docs: DataFrame, least: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, pos, line, length, h, h2, at of every line of at least ``least`` characters; ``at`` orders by (doc, pos)."""
    cut = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(_LAST)).alias("doc"), F.posexplode(F.split(F.col(text).cast("string"), "\n", -1)).alias("pos", "line"))
    return cut.withColumn("length", F.length("line")).where(F.col("length") >= least).withColumn("h", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line")).withColumn("at", F.expr(PLACE))


def near_lines(lines: DataFrame, threshold: int, dense: int = DENSE) -> DataFrame:
    """h, h2 of the distinct lines that have an earlier line within the threshold."""
    made = keys(F.col("line"), F.col("length"), threshold)
    names = [f"k{i}" for i in range(len(made))]  # single columns, so that a hash aggregate can hold them
    distinct = lines.select("h", "h2", *[k.alias(n) for k, n in zip(made, names, strict=True)]).groupBy("h", "h2").agg(*[F.first(n).alias(n) for n in names])
    rows = distinct.select(F.col("h").alias("id"), F.posexplode(F.array(*names)).alias("k", "key")).select("key", "id", "k", (F.col("k") <= threshold).alias("own"), F.lit(True).alias("seek"))
    met = materialise(_grouped(rows), "line-keys")
    # texts of the lines that meet another: a filter of at most SLOTS values, then exactly
    ids = met.select("id").distinct()
    slot = lambda c: F.pmod(F.col(c), F.lit(SLOTS))
    maybe = lines.withColumn("slot", slot("h")).join(F.broadcast(ids.select(slot("id").alias("slot")).distinct()), "slot", "left_semi")
    texts = maybe.groupBy("h", "h2").agg(F.min("at").alias("first"), F.first("line").alias("line")).withColumnRenamed("h", "id")
    full = materialise(met.join(texts, "id"), "line-candidates")
    few = F.col("n") <= dense * dense
    many = full.where(~few).withColumn("rest", F.col("line")).drop("n")
    found = _compared(full.where(few), threshold).union(_refined(many, threshold, dense))
    return found.select(F.col("id").alias("h"), "h2").distinct()


def dedup_lines(docs: DataFrame, threshold: int = 2, least: int = 20, doc: str = "doc_id", text: str = "text", n_chars: str | None = None, dense: int = DENSE) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; adds n_lines and n_dropped.

    ``n_chars`` names a column to set to the new length.
    """
    lines = lines_of(docs, least, doc, text)
    near = materialise(near_lines(lines, threshold, dense), "near-lines")
    places = materialise(lines.select("doc", "pos", "h", "h2"), "places")
    # lines that lose an occurrence, stored: both sides of the join are then plain reads, and a frequent line can be split
    firsts = places.groupBy("h", "h2").agg(F.min(F.expr(PLACE)).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.join(near.withColumn("near", F.lit(True)), ["h", "h2"], "left").where(F.col("near") | (F.col("n") > 1)).drop("n")
    gone = places.join(materialise(firsts, "repeated-lines"), ["h", "h2"]).where(F.col("near") | (F.expr(PLACE) != F.col("first")))
    gone = gone.groupBy("doc").agg(F.collect_set("pos").alias("_gone")).withColumnRenamed("doc", "_doc")
    cut = F.split(F.col(text).cast("string"), "\n", -1)
    every = F.sequence(F.lit(0), F.size(cut) - 1)
    n = F.coalesce(F.size(cut), F.lit(0))
    # the numbers of lost lines travel under a name that no input column has; hashing the few of them saves sorting the texts
    lost = "_gone" + "_" * max(map(len, docs.columns))
    gone = gone.select(F.col("_doc").alias(lost + "doc"), F.col("_gone").alias(lost))
    kept = F.array_join(F.transform(F.array_except(every, F.col(lost)), lambda i: F.get(cut, i)), "\n")
    out = docs.join(gone.hint("shuffle_hash"), F.coalesce(F.col(doc).cast("long"), F.lit(_LAST)) == F.col(lost + "doc"), "left").select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in (text, n_chars, "n_lines", "n_dropped")],
        F.when(F.col(lost).isNull(), F.col(text).cast("string")).otherwise(kept).alias(text),
        F.when(F.col(text).isNull(), 0).otherwise(n).alias("n_lines"),
        F.coalesce(F.size(lost), F.lit(0)).alias("n_dropped"),
    )
    if n_chars:
        out = out.withColumn(n_chars, F.length(text).cast("long"))
    return out
