"""Whitening against numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import whitening

KIND = "vec_id long, embedding array<float>, label int, n long, component string, _x int"


def table(spark, vectors, kind=KIND):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in enumerate(vectors)], kind).repartition(3)


def brute(vectors, k=16):
    """Rows by (vec_id, component) from integers and numpy's symmetric eigensolver."""
    keep = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted(set(map(tuple, keep.values()))))
    n, sums = len(fit), fit.sum(0)
    c = (fit - 1_000_000) - (sums - 1_000_000 * n) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in keep.items():
        dev = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        w = ((np.array(x) - 1_000_000) - (sums - 1_000_000 * n) / n) @ u / np.sqrt(np.maximum(e, 1e-300))
        for j in range(min(k, len(e))):
            out[i, j + 1] = (n, dev, w[j], e[j] / e.sum())
    return out


def check(spark, vectors, k=16):
    want = brute(vectors, k)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(table(spark, vectors), k=k).collect()}
    assert set(got) == set(want)
    signs = {}
    for (i, j), (n, dev, w, share) in want.items():
        r = got[i, j]
        assert (r.n, r.deviation) == (n, dev)
        assert r.explained == pytest.approx(share, rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
        if abs(w) > 0.1:
            signs.setdefault(j, np.sign(w) * np.sign(r.whitened))
        assert r.whitened * signs.get(j, 1) == pytest.approx(w, abs=1e-6) or abs(w) <= 0.1
    return got


def test_against_eigh(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24)) * np.geomspace(3, 0.3, 24)
    vectors = x.tolist() + [x[0].tolist()] * 50 + [None, [None] + [1.0] * 23, [float("nan")] + [0.0] * 23, [float("inf")] + [0.0] * 23]
    assert len(check(spark, vectors)) == 350 * 16


def test_few_dimensions_and_a_dependent_one(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (80, 3)) / 64.0
    vectors = np.column_stack([x, 2 * x[:, 0] - x[:, 1], np.full(80, 7.0)]).tolist()
    got = [r for r in whitening.whiten(table(spark, vectors)).collect()]
    assert {r.component for r in got} == {1, 2, 3}
    assert max(r.identity_error for r in got) < 1e-9


def test_ill_conditioned(spark):
    """Eigenvalues over eleven orders of magnitude in mixed directions are still white."""
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    vectors = ((rng.normal(size=(400, 12)) * np.geomspace(3e5, 1, 12)) @ q.T).tolist()
    got = whitening.whiten(table(spark, vectors, KIND.replace("float", "double"))).collect()
    assert {r.component for r in got} == set(range(1, 13))
    assert max(r.identity_error for r in got) < 1e-8
    w = np.zeros((400, 12))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(w.T @ w / 400 - np.outer(w.mean(0), w.mean(0)) - np.eye(12)).max() < 1e-8


def test_small_and_odd_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [None, [], [1.0, 2.0]])).count() == 0  # one vector has no variance
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 9)).count() == 0
    two = whitening.whiten(table(spark, [[0.0, 0.0], [1.0, 1.0], [1.0, 1.0]])).collect()
    assert [(r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in two] == [(1, 2, 8192, 1.0, pytest.approx(1.0))] * 3
    lengths = whitening.whiten(table(spark, [[0.0], [1.0], [0.0, 0.0], [2.0, 1.0], [4.0, 0.0]])).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in lengths) == [(0, 1, 2), (1, 1, 2), (2, 1, 3), (2, 2, 3), (3, 1, 3), (3, 2, 3), (4, 1, 3), (4, 2, 3)]
    huge = whitening.whiten(table(spark, [[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]])).collect()
    assert {r.vec_id for r in huge} == {0, 1, 2} and all(r.deviation is None or r.deviation >= 0 for r in huge)


def test_jacobi_and_cholesky():
    rng = np.random.default_rng(4)
    for d in (1, 2, 5, 16):
        a = rng.normal(size=(40, d))
        v = a.T @ a
        l = whitening.pivoted_cholesky(v)
        assert np.allclose(l @ l.T, v)
        e, u = whitening.one_sided_jacobi(l)
        assert np.allclose(u @ np.diag(e) @ u.T, v) and np.allclose(u.T @ u, np.eye(d)) and (np.diff(e) <= 0).all()


def test_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, [0.0, 1.0]), (7, [2.0, 1.5]), (7, [2.0, 1.5]), (8, [5.0, 0.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df)
    assert got.where("component = 1").groupBy("vec_id").count().orderBy(F.col("vec_id").asc_nulls_first()).collect() == [(None, 1), (7, 2), (8, 1)]


def test_query(spark):
    from lexloom.llm import queries

    sf = "/root/testdata/sf0.001"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute([v for _, v in vectors])
    got = {(r.vec_id, r.component): r for r in queries.op13_embedding_whitening(spark, sf).collect()}
    assert set(got) == {(vectors[i][0], j) for i, j in want}
    for (i, j), (n, dev, w, share) in want.items():
        r = got[vectors[i][0], j]
        assert (r.n, r.deviation) == (n, dev) and abs(r.whitened) == pytest.approx(abs(w), abs=1e-6) and r.explained == pytest.approx(share, rel=1e-9)


def test_jobs_do_not_follow_partitions(spark):
    """Sums come to the driver in one job each, however many partitions hold them."""
    points = whitening.grid(table(spark, np.random.default_rng(4).normal(size=(60, 6)).tolist()), "embedding", "vec_id").repartition(40)
    spark.sparkContext.setJobGroup("fit-jobs", "fit")
    try:
        whitening.fit(points)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit-jobs")) <= 20
