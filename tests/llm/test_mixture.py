"""Raking and sampling against plain loops."""

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from lexloom.llm import mixture


def test_margins_meet_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(s, t, k, int(rng.integers(1, 500))) for s in ("a", "b", "c") for t in ("en", "de") for k in ("prose", "table")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    goal = {"source": {"a": 0.2, "b": 0.5, "c": 0.3}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 0.9, "table": 0.1}}
    targets = {d: spark.createDataFrame([(k, 2 * v) for k, v in g.items()], f"{d} string, share double") for d, g in goal.items()}  # scaled to 1
    raked = mixture.rake(cells, targets, 20).cache()
    for d, g in goal.items():
        got = {r[d]: r.w for r in raked.groupBy(d).agg(F.sum("w").alias("w")).collect()}
        assert got == pytest.approx(g, abs=1e-6)
    p = mixture.probabilities(raked, 0.4).collect()
    total = sum(r.tokens for r in p)
    assert sum(r.tokens * r.probability for r in p) == pytest.approx(0.4 * total)
    assert all(0 <= r.probability <= 1 for r in p)
    scale = {round(r.probability / r.weight, 9) for r in p if r.probability < 1}
    assert len(scale) == 1 and all(next(iter(scale)) * r.weight >= 1 - 1e-6 for r in p if r.probability == 1)


def test_partial_targets_keep_natural_shares(spark):
    cells = spark.createDataFrame([("a", "en", "prose", 60), ("b", "en", "prose", 30), ("c", "en", "prose", 10)], "source string, lang string, topic string, tokens long")
    targets = mixture.targets_of(cells, 1.0) | {"source": spark.createDataFrame([("a", 0.3), ("zz", 0.5)], "source string, share double")}
    got = {r.source: r.w for r in mixture.rake(cells, targets).collect()}
    assert got == pytest.approx({"a": 0.3 / 0.7, "b": 0.3 / 0.7, "c": 0.1 / 0.7})


def test_cases(spark, monkeypatch):
    rows = [(1, "a b c"), (2, None), (3, ""), (None, "x | y"), (1, "a b c"), (5, "word " * 50_000), (6, "License text###")]
    docs = documents(spark, rows)
    got = mixture.mix(docs, 0.5).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    assert {r.topic for r in got} == {"prose", "table", "symbols"} and {r.lang for r in got} == {"en", "de", "unknown"}
    assert {r.doc_id: r.tokens for r in got}[5] == 50_000
    taken = {r.doc_id for r in got if r.sampled}
    kept = mixture.sample(docs, 0.5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == taken
    monkeypatch.setattr(mixture, "BROADCAST_CELLS", 0)  # the salted join
    assert sorted(str(r) for r in mixture.mix(docs, 0.5).collect()) == sorted(str(r) for r in got)
    assert sorted(str(r) for r in mixture.sample(docs, 0.5).collect()) == sorted(str(r) for r in kept.collect())
    assert mixture.mix(documents(spark, []), 0.5).count() == 0
    assert mixture.mix(documents(spark, [(1, None), (2, " ")]), 0.5).count() == 2
    assert mixture.mix(docs, 1.0).where("probability < 0.999999").count() == 0


def test_few_cells_are_fitted_without_a_shuffle(spark, monkeypatch):
    rows = [(f"s{i % 5}", f"l{i % 3}", f"t{i % 2}", 10 + 7 * i) for i in range(30)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").groupBy(*mixture.DIMS).agg(F.sum("tokens").alias("tokens"))
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()

    def fitted(name):
        table = mixture.materialise(cells.repartition(8), name)
        sc.setJobGroup(name, "")
        got = {tuple(r[d] for d in mixture.DIMS): r.w for r in mixture.rake(table, mixture.targets_of(table, 0.5), 8).collect()}
        sc.setLocalProperty("spark.jobGroup.id", None)
        stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
        return got, len(stages)

    got, stages = fitted("together")
    monkeypatch.setattr(mixture, "BROADCAST_CELLS", 0)
    spread, many = fitted("spread")
    assert got == pytest.approx(spread, rel=1e-12) and len(got) == 30
    assert stages < 60 < many, (stages, many)
