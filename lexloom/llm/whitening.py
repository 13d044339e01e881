"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Every entry becomes a long on a grid, ``x = floor(scale * c) + shift``. The fit list holds
each distinct grid vector once, so large groups of copies weigh no more than one row. Tasks
add up sums, then centred products (rows are centred before they are multiplied, and a whole
number near the mean is taken off first, so that the shift costs no digits). The driver gets
one matrix of dimensions squared, whatever the rows.

The matrix is factored by Cholesky with the largest remaining diagonal as pivot; a dimension
whose rest is rounding error of its own variance ends as dependent. Rotations of column
pairs (one-sided Jacobi, a round robin of disjoint pairs at once) make the factor's columns
orthogonal: squared norms are the eigenvalues, normalised columns the components. As long as
the whitened rows' own covariance differs from the identity by more than ``TIGHT``, it is
factored in turn and multiplied into the factor, which takes the error of small eigenvalues
from the condition of the covariance to its square root.

Defined cases: null vectors and those with null or non-finite entries have no rows; grid
values are held between -2^53 and 2^53; vectors of each length are a space of their own with
its own fit list, n, components and error; empty vectors and spaces without variance have no
components, hence no rows; repeated rows and null ids get rows each. A deviation beyond a long
is null. Equal eigenvalues leave their components free, as any basis of their plane is one.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise

TIGHT, ROUNDS, SWEEPS = 1e-10, 3, 60
_EPS = np.finfo(np.float64).eps
_GRID = float(2**53)
_LONG = 2**63 - 1


@dataclass
class Space:
    """Model of the vectors of one length."""

    n: int
    sums: np.ndarray  # long
    basis: np.ndarray  # columns: components by falling eigenvalue
    values: np.ndarray  # eigenvalues
    trace: float
    error: float = 0.0  # of the whitened fit list's covariance against the identity

    def centred(self, x: np.ndarray) -> np.ndarray:
        near = self.sums // self.n  # the whole part goes first: both differences are exact or tiny
        return (x - near) - (self.sums - near * self.n) / self.n

    def whitened(self, x: np.ndarray, k: int | None = None) -> np.ndarray:
        return self.centred(x) @ self.basis[:, :k] / np.sqrt(self.values[:k])


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``l`` with ``l @ l.T == v`` and one column per independent dimension."""
    d = len(v)
    rest, least, out = np.diag(v).copy(), np.diag(v) * (4 * d * _EPS), []
    done = np.zeros(d, bool)
    for _ in range(d):
        open_ = np.where(done | (rest <= least), -1.0, rest)
        p = int(open_.argmax())
        if open_[p] <= 0:
            break
        col = v[:, p] - sum((c * c[p] for c in out), np.zeros(d))
        col = np.where(done, 0.0, col / np.sqrt(rest[p]))
        col[p] = np.sqrt(rest[p])
        done[p] = True
        rest = rest - col * col
        out.append(col)
    return np.array(out).T.reshape(d, len(out))


def one_sided_jacobi(l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms (falling) and unit columns of ``l`` after rotations that make its columns orthogonal."""
    a = l.copy()
    r = a.shape[1]
    ring = list(range(r + r % 2))  # an odd one out rests
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(i, j) for i, j in zip(ring[:half], ring[:half - 1:-1], strict=True) if i < r and j < r]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            worst = max(worst, float(np.max(np.abs(xy) / np.where(size > 0, size, 1.0))))
            turn = np.abs(xy) > _EPS * size
            zeta = (yy - xx) / np.where(turn, 2 * xy, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, p], a[:, q] = c * (x - t * y), c * (y + t * x)
        if worst <= r * _EPS:
            break
    e = (a * a).sum(0)
    order = np.argsort(-e, kind="stable")
    return e[order], a[:, order] / np.sqrt(e[order])


def valid(vector: str | Column = "embedding") -> Column:
    """Is the vector there, with finite entries only?"""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def grid(vectors: DataFrame, vector: str, key: str, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """``key`` and grid vector ``_x`` of the rows with usable vectors; the check comes first, since ``scale * c`` may leave the doubles."""
    def at(c: Column) -> Column:
        return F.greatest(F.least(F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-_GRID)), F.lit(_GRID))) + shift, F.lit(2**53)), F.lit(-(2**53)))

    v = F.col(vector)
    return vectors.select(F.col(key).alias(key), F.when(valid(v), v).alias("_v")).where("_v is not null").select(key, F.transform("_v", at).alias("_x"))


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix (long) of the vectors of each length above 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)].astype(np.int64)


def _added(lists: DataFrame, part: Callable[[np.ndarray], np.ndarray | None], dtype: type) -> dict[int, np.ndarray]:
    """Per length, the sum of ``part(matrix)`` over the fit list (None: that length is left out).

    Tasks add up what they hold and rows of the sums meet by (length, row), so neither a task
    nor the driver holds more than one matrix per length.
    """
    def count(batches: Iterator[dict]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _by_length(b["_x"]):
                for at in range(0, len(x), 8192):
                    s = part(x[at : at + 8192])
                    if s is not None:
                        total[x.shape[1]] = total.get(x.shape[1], 0) + s
        for d, m in total.items():
            yield {"d": [d] * len(m), "i": list(range(len(m))), "s": [r.astype(dtype).tobytes() for r in m]}

    def add(batches: Iterator[dict]) -> Iterator[dict]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for d, i, s in zip(b["d"].to_pylist(), b["i"].to_pylist(), b["s"].to_pylist(), strict=True):
                total[d, i] = total.get((d, i), 0) + np.frombuffer(s, dtype)
        for (d, i), s in total.items():
            yield {"d": [d], "i": [i], "s": [s.tobytes()]}

    schema, rows = "d int, i int, s binary", {}
    parts = arrow_map(lists, count, schema).repartition(8, "d", "i")
    for r in arrow_map(parts, add, schema).collect():  # all at once: a row iterator runs a job for each partition
        rows[r.d, r.i] = np.frombuffer(r.s, dtype)
    return {d: np.array([rows[e, i] for e, i in sorted(rows) if e == d]) for d in sorted({d for d, _ in rows})}


def _counts(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x.sum(0), [len(x)]])[None, :]


def _covariances(lists: DataFrame, spaces: dict[int, Space], rows_of: Callable[[Space, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Covariance (divisor n) of ``rows_of(space, matrix)``, whose columns have a mean near 0."""
    def part(x: np.ndarray) -> np.ndarray | None:
        if x.shape[1] not in spaces:
            return None
        y = rows_of(spaces[x.shape[1]], x)
        return np.vstack([y.T @ y, y.sum(0)])  # the last row: what centring leaves over

    got = _added(lists, part, np.float64) if spaces else {}
    return {d: m[:-1] / spaces[d].n - np.outer(m[-1], m[-1]) / spaces[d].n ** 2 for d, m in got.items()}


def fit(points: DataFrame, k: int = 16) -> dict[int, Space]:
    """Models by vector length from the distinct grid vectors ``_x`` of ``points``; ``k`` components are kept and checked."""
    lists = materialise(points.select("_x").distinct(), "fit-list")
    spaces = {d: Space(int(s[0, -1]), s[0, :-1].copy(), np.eye(d), np.ones(d), 1.0) for d, s in _added(lists, _counts, np.int64).items()}
    for d, v in _covariances(lists, spaces, Space.centred).items():
        spaces[d].trace = float(np.trace(v))
        spaces[d].values, spaces[d].basis = one_sided_jacobi(pivoted_cholesky(v))
    spaces = {d: s for d, s in spaces.items() if len(s.values)}
    todo = dict(spaces)
    for left in reversed(range(ROUNDS + 1)):
        for d, c in _covariances(lists, todo, Space.whitened).items():
            s = todo[d]
            s.error = float(np.abs(c[:k, :k] - np.eye(len(c))[:k, :k]).max())
            if s.error <= TIGHT or not left:
                del todo[d]
            else:
                s.values, s.basis = one_sided_jacobi((s.basis * np.sqrt(s.values)) @ pivoted_cholesky(c))
    for s in spaces.values():
        s.values, s.basis = s.values[:k].copy(), s.basis[:, :k].copy()
    return spaces


def deviations(x: np.ndarray, space: Space) -> list[int | None]:
    """Sum of ``(n * x - sums) ** 2`` of each row, exact; None beyond a long."""
    far = int(np.abs(x).max(initial=1)) * space.n + int(np.abs(space.sums).max(initial=0))
    if far * far * x.shape[1] <= _LONG or _near(x, space):
        y = space.n * x - space.sums
        return (y * y).sum(1).tolist()
    n, sums = space.n, space.sums.tolist()
    out = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v <= _LONG else None for v in out]


def _near(x: np.ndarray, space: Space) -> bool:
    """Do the differences themselves fit? (values far from 0 but close to their mean)"""
    if int(np.abs(x).max(initial=1)) * space.n > _LONG // 2:
        return False
    y = np.abs(space.n * x - space.sums).max(initial=0)
    return int(y) ** 2 * x.shape[1] <= _LONG


def transform(points: DataFrame, spaces: dict[int, Space], key: str) -> DataFrame:
    """One row per row of ``points`` and component: ``key``, component, n, deviation, whitened, explained, identity_error."""
    kind = points.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for rows, x in _by_length(b["_x"]):
                s = spaces.get(x.shape[1])
                if s is None:
                    continue
                k, m = len(s.values), len(rows)
                yield {
                    key: b[key].take(pa.array(np.repeat(rows, k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, s.n, np.int64)),
                    "deviation": pa.array([v for v in deviations(x, s) for _ in range(k)], pa.int64()),
                    "whitened": pa.array(s.whitened(x).ravel()),
                    "explained": pa.array(np.tile(s.values / s.trace, m)),
                    "identity_error": pa.array(np.full(m * k, s.error)),
                }

    return arrow_map(points, run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 16, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """Whitened coordinates on the first ``k`` components of every usable vector; see the module for the defined cases."""
    points = grid(vectors, vector, key, scale, shift)
    return transform(points, fit(points, k), key)
