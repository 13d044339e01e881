"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Documents are summed to cells (source, language, topic) first, so that fitting works on
the cell table whatever the number of documents. In each round the cells' token weights
are scaled to each dimension's target shares in turn. A document's probability follows
from its cell's weight: ``min(1, s * weight)`` with the scale s that makes the expected
number of tokens the budget, cells that reach 1 giving their surplus to the others. A
document is taken when a number between 0 and 1 derived from its id is below it.

All of it are DataFrame functions. Up to ``BROADCAST_CELLS`` cells the cell table is joined
by broadcast and fitted in one partition, since a shuffle for every dimension and round
costs more than its rows; beyond, it is joined by a salted join and fitted by shuffles.

Defined cases: null dimension values form the value "unknown"; documents without words
have 0 tokens and their cell's probability (cells without tokens: the rate); values
without a target keep their natural share, and targets are scaled to 1 over the values
that occur; rows of one doc_id are taken together; a null doc_id hashes as "null"; extra
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"
DIMS = ("source", "lang", "topic")
BROADCAST_CELLS = 100_000
#: Topic rules in order: name and pattern; texts that match none are "prose".
TOPICS = (("table", r" \| "), ("symbols", r"[#$%&*]{3}"), ("license", r"License"), ("shouting", r"[A-Z]{3,}!!"))


def topic(text: Column, rules=TOPICS) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def _dims(df: DataFrame) -> DataFrame:
    return df.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit("unknown")) for d in DIMS})


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def targets_of(cells: DataFrame, alpha: float) -> dict[str, DataFrame]:
    """Default targets: natural token shares to the power ``alpha``, scaled to 1 (below 1 raises small sources)."""
    out = {}
    for d in DIMS:
        t = cells.groupBy(d).agg(F.sum("tokens").alias("t")).withColumn("share", F.pow(F.col("t").cast("double"), F.lit(alpha)))
        out[d] = t.select(d, (F.col("share") / F.lit(_number(t, F.sum("share")) or 1.0)).alias("share"))
    return out


def _number(df: DataFrame, aggregate: Column) -> float | None:
    return df.agg(aggregate.cast("double")).first()[0]


def _together(cells: DataFrame, few: bool) -> DataFrame:
    """A small cell table in one partition, where its sums, joins and windows need no shuffle."""
    return cells.coalesce(1) if few else cells


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 20) -> DataFrame:
    """Adds ``w``: each cell's share of all token weight after ``rounds`` of fitting."""
    few = cells.count() <= BROADCAST_CELLS
    cells = _together(cells, few)
    now = cells.withColumn("w", F.col("tokens") / F.lit(max(_number(cells, F.sum("tokens")) or 0.0, 1.0)))
    for d in DIMS:
        now = now.join(targets[d].select(d, F.col("share").alias(f"_{d}")), d, "left")
    for d in DIMS:  # values without a target keep their natural share; then to 1
        now = now.withColumn(f"_{d}", F.coalesce(f"_{d}", F.sum("w").over(Window.partitionBy(d))))
        sums = now.groupBy(d).agg(F.first(f"_{d}").alias("s"), F.sum("w").alias("n"))
        now = now.withColumn(f"_{d}", F.col(f"_{d}") / F.lit(_number(sums, F.sum(F.when(F.col("n") > 0, F.col("s")))) or 1.0))
    now = _together(materialise(now, "cells"), few)
    for i in range(rounds):
        for d in DIMS:
            own = F.sum("w").over(Window.partitionBy(d))
            now = now.withColumn("w", F.when(own > 0, F.col("w") * F.col(f"_{d}") / own).otherwise(0.0))
        if i % 4 == 3 or i == rounds - 1:
            now = _together(materialise(now, "raked"), few)
    return now.drop(*[f"_{d}" for d in DIMS])


def probabilities(raked: DataFrame, rate: float) -> DataFrame:
    """Adds ``weight`` (w over natural share) and ``probability`` to cells; expects ``rate`` of all tokens."""
    total = _number(raked, F.sum("tokens")) or 0.0
    r = raked.withColumn("weight", F.when(F.col("tokens") > 0, F.col("w") * total / F.col("tokens")).otherwise(1.0))
    order = Window.orderBy(F.desc("weight"), *DIMS)  # the cell table only
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    mass = F.col("tokens") * F.col("weight")
    r = r.withColumn("scale", F.try_divide(F.lit(rate * total) - F.coalesce(F.sum("tokens").over(before), F.lit(0)), F.sum(mass).over(after)))
    scale = _number(r.where(F.col("scale") * F.col("weight") <= 1), F.max("scale"))
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(1e300 if scale is None else scale) * F.col("weight"))).otherwise(rate)
    return r.withColumn("probability", p).select(*DIMS, "tokens", "weight", "probability")


def fit(docs: DataFrame, rate: float, alpha: float = 0.5, rounds: int = 20, targets: dict[str, DataFrame] | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored (per document: doc_id, dimensions, tokens) and (per cell: weight, probability)."""
    narrow = materialise(_dims(docs.select("doc_id", "source", "lang", topic(F.coalesce(F.col(text), F.lit(""))).alias("topic"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))), "documents")
    cells = materialise(narrow.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "cells")
    cells = _together(cells, cells.count() <= BROADCAST_CELLS)
    given = targets_of(cells, alpha) | (targets or {})
    return narrow, materialise(probabilities(rake(cells, given, rounds), rate), "probabilities")


def _with_cells(df: DataFrame, cells: DataFrame) -> DataFrame:
    if cells.count() <= BROADCAST_CELLS:
        return df.join(F.broadcast(cells), list(DIMS))
    salts = 64
    many = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(many, [*DIMS, "_salt"]).drop("_salt")


def mix(docs: DataFrame, rate: float, alpha: float = 0.5, seed: str = "mix", **options) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, sampled for every row."""
    narrow, cells = fit(docs, rate, alpha, **options)
    out = _with_cells(narrow, cells.drop("tokens"))
    return out.withColumn("sampled", uniform(F.col("doc_id"), seed) < F.col("probability"))


def sample(docs: DataFrame, rate: float, alpha: float = 0.5, seed: str = "mix", text: str = "text", **options) -> DataFrame:
    """The sampled rows of ``docs``, with their columns."""
    _, cells = fit(docs, rate, alpha, text=text, **options)
    key = {"_" + d: F.coalesce(c, F.lit("unknown")) for d, c in zip(DIMS, (F.col("source").cast("string"), F.col("lang").cast("string"), topic(F.coalesce(F.col(text), F.lit("")))), strict=True)}
    renamed = cells.select(*[F.col(d).alias("_" + d) for d in DIMS], F.col("probability").alias("_p"))
    tagged = docs.withColumns(key)
    if renamed.count() <= BROADCAST_CELLS:
        joined = tagged.join(F.broadcast(renamed), list(key))
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")
        joined = tagged.withColumn("_salt", salt).join(renamed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63)))), [*key, "_salt"])
    return joined.where(uniform(F.col("doc_id"), seed) < F.col("_p")).select(*docs.columns)


def check_sql(rate: float, alpha: float, rounds: int, seed: str) -> str:
    """The same computation as one SQL statement, rounds written out."""
    case = "case " + " ".join(f"when regexp_matches(t, '{p}') then '{n}'" for n, p in TOPICS) + " else 'prose' end"
    steps, last = [], "r0"
    for i in range(rounds):
        for d in DIMS:
            name = f"r{i}_{d}"
            steps.append(f"{name} as (select source, lang, topic, tokens, s, l, k, case when sum(w) over (partition by {d}) > 0 then w * {dict(zip(DIMS, 'slk', strict=True))[d]} / sum(w) over (partition by {d}) else 0 end as w from {last})")
            last = name
    share = ", ".join(f"t_{d} as (select {d}, sum(tokens)::double ^ {alpha} / sum(sum(tokens)::double ^ {alpha}) over () as share from cells group by {d})" for d in DIMS)
    return f"""
with d as materialized (
    select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang, {case} as topic, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) as tokens
    from (select *, coalesce(text, '') as t from documents)
),
cells as materialized (select source, lang, topic, sum(tokens)::bigint as tokens from d group by all),
{share},
r0 as (
    select source, lang, topic, tokens, tokens::double / sum(tokens) over () as w, a.share as s, b.share as l, c.share as k
    from cells join t_source a using (source) join t_lang b using (lang) join t_topic c using (topic)
),
{", ".join(steps)},
weights as materialized (select source, lang, topic, tokens, sum(tokens) over () as total, case when tokens > 0 then w * sum(tokens) over () / tokens else 1 end as weight from {last}),
scales as (
    select *, ({rate} * total - coalesce(sum(tokens) over (order by weight desc, source, lang, topic rows between unbounded preceding and 1 preceding), 0))
        / sum(tokens * weight) over (order by weight desc, source, lang, topic rows between current row and unbounded following) as scale from weights
),
chosen as (select max(scale) as s from scales where scale * weight <= 1),
p as (select source, lang, topic, weight, case when tokens > 0 then least(1.0::double, coalesce(s, 1e300) * weight) else {rate} end as probability from weights cross join chosen)
select doc_id, source, lang, topic, tokens::bigint as tokens, round(weight, 5) as weight, round(probability, 5) as probability,
    (('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint)::double / {float(1 << 52)} < probability as sampled
from d join p using (source, lang, topic)
"""
