"""Near-duplicate vectors and nearest vectors against brute force."""

import tracemalloc

import numpy as np
import pytest
from helpers import groups

from lexloom.llm import cap_filters, multi_index


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, links string")


def vectors(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for i in range(n // 2, n):  # near copies, scaled
        x[i] = (x[i % 10] + rng.normal(scale=rng.choice([0.05, 0.2, 0.4]), size=dims)) * rng.uniform(0.1, 5)
    return x.astype(np.float32)


ODD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [float("inf")] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1), (905, [1.0] * 3, 1), (906, [1.0] * 16, None), (907, [], 1)]


def test_near_duplicates(spark, monkeypatch):
    x = vectors(1, 300)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + ODD + [(500 + i, x[0].tolist(), 0) for i in range(5)] + [(None, x[0].tolist(), 0)]
    monkeypatch.setattr(cap_filters, "BLOCK", 16)
    got = {r.vec_id: r for r in cap_filters.near_duplicates(table(spark, rows).repartition(3), 0.93).collect()}
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if i is not None and i < 900]
    unit = {i: v / np.linalg.norm(v) for i, v, _ in good}
    lab = {i: k for i, _, k in good}
    links = [(a, b) for a in unit for b in unit if a < b and lab[a] == lab[b] and unit[a] @ unit[b] >= 0.93]
    want = groups(unit, links)
    degree = {i: sum(i in p for p in links) for i in unit}
    assert len(got) == len(rows) - 1
    found = sum(got[i].n_links for i in unit)
    assert 0.97 * sum(degree.values()) <= found <= sum(degree.values())
    assert all(got[i].n_links <= degree[i] for i in unit) and got[500].n_links >= 5
    assert np.mean([got[i].component_id == want[i] for i in unit]) > 0.97
    assert all(got[i].n_links == 0 and got[i].kept for i, _, _ in ODD)


def test_filters_find_close_pairs():
    rng = np.random.default_rng(0)
    x = cap_filters.unit([v.tobytes() for v in rng.normal(size=(500, 64))])
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.935 * x + np.sqrt(1 - 0.935**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    for n in (1_000, 100_000):
        caps = cap_filters.plan(n, 64)
        assert np.mean([bool(set(a) & set(b)) for a, b in zip(caps.passed(x), caps.passed(y), strict=True)]) > 0.93
        assert np.mean([len(p) for p in caps.passed(x)]) < 3 * cap_filters.PASSES


@pytest.mark.parametrize("rows", [6_400, 100_000, 1_000_000, 10_000_000])
def test_recall_does_not_fall_with_rows(rows):
    caps = cap_filters.plan(rows, 64, 0.93)
    assert cap_filters.missed(caps, 0.93, 1_000, seed=7) <= 0.02  # 0.01 and chance


def test_low_thresholds_compare_all_pairs():
    caps = cap_filters.plan(100_000, 64, 0.1)
    assert cap_filters.missed(caps, 0.1, 200, seed=7) <= 0.02


def test_threshold_is_exact_and_needs_no_memory():
    tracemalloc.start()
    caps = cap_filters.plan(640_000, 64)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1_000, 64))
    n = [len(p) for p in caps.passed(x / np.linalg.norm(x, axis=1, keepdims=True))]
    assert 0.8 < np.mean(n) / (cap_filters.PASSES * caps.rounds) < 1.3
    u = rng.normal(size=(400_000, 8))
    assert abs(np.mean(u[:, 0] > cap_filters.threshold(8, 0.01) * np.linalg.norm(u, axis=1)) - 0.01) < 0.001
    assert cap_filters.threshold(1, 0.01) < 1


def test_no_vectors(spark):
    assert cap_filters.near_duplicates(table(spark, [])).count() == 0
    assert {r.component_id for r in cap_filters.near_duplicates(table(spark, ODD)).collect()} == {i for i, _, _ in ODD}
    assert multi_index.nearest(table(spark, []), multi_index.F.col("vec_id") % 20 == 0).count() == 0


def test_nearest(spark):
    x = vectors(3, 1_200)
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)] + [(9_000 + i, v, k) for i, v, k in ODD]
    is_query = multi_index.F.col("vec_id") % 20 == 0
    got = multi_index.nearest(table(spark, rows), is_query, 10).collect()
    ids, y = np.arange(len(x)), x.astype(np.float64)
    by: dict = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1_200, 20))
    hits = 0
    for q, found in by.items():
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:10]
        hits += len(set(best.tolist()) & {r.vec_id for r in found})
        assert [r.rank for r in found] == list(range(1, 11)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
    assert hits / (10 * len(by)) >= 0.9


def test_few_candidates_and_ties(spark):
    rows = [(0, [1.0, 0.0], 1), (3, [0.5, 0.0], 1), (2, [0.5, 0.0], 1), (0, [1.0, 0.0], 1)]
    got = multi_index.nearest(table(spark, rows), multi_index.F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 2, 0.5), (0, 2, 3, 0.5)]


@pytest.mark.parametrize("norms", ["uniform", "lognormal"])
def test_radius_holds_neighbours_of_unequal_norms(norms):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= (rng.uniform(0.5, 1.5, len(x)) if norms == "uniform" else rng.lognormal(0, 0.5, len(x)))[:, None]
    top = float(np.linalg.norm(x, axis=1).max())
    turn, radius = multi_index.learn(x[: multi_index.SAMPLE], top, 20)
    index = multi_index.Index(multi_index.codes(multi_index.lifted(x, top), turn))
    asked, hits = multi_index.codes(multi_index.as_query(x[-100:]), turn), 0
    for q in range(100):
        s = x @ x[len(x) - 100 + q]
        s[len(x) - 100 + q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & set(index.within(asked[q], radius).tolist()))
    assert hits / 2_000 >= 0.95
