"""Nearest neighbours by cosine.

The corpus streams through Arrow batches where it lies; only the best ``k`` rows
per question leave a task, so neither pairs nor vectors are shuffled. Questions
are broadcast while they stay under a checked size; above it, question blocks
and corpus slices meet in a grid of bounded groups instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .blocks import bounded_grid
from .skew import first_per_key

BROADCAST_BYTES = 64 << 20
ALL = "*"


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = np.unique(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of unequal length: {sizes[:5].tolist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def keep_best(q: np.ndarray, items: np.ndarray, s: np.ndarray, k: int):
    """Best k rows per question; equal scores fall to the smaller id. A row found in several cells counts once."""
    order = np.lexsort((items, -s, q))
    q, items, s = q[order], items[order], s[order]
    if len(q):
        new = np.r_[True, (q[1:] != q[:-1]) | (items[1:] != items[:-1])]
        q, items, s = q[new], items[new], s[new]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    keep = rank < k
    return q[keep], items[keep], s[keep]


def _cell_rows(cells) -> dict:
    rows: dict = {}
    for i, names in enumerate(cells):
        for name in names if names is not None else ():
            rows.setdefault(name, []).append(i)
    return {name: np.asarray(ix) for name, ix in rows.items()}


def _score(qm, q_cells, items, xm, x_cells, k, block=256):
    """Candidates (question row, id, score) of one corpus batch, at most k per question and cell."""
    out_q, out_i, out_s = [], [], []
    for name, rows in x_cells.items():
        asking = q_cells.get(name)
        if asking is None:
            continue
        x = xm[rows].T
        for lo in range(0, len(asking), block):
            part = asking[lo:lo + block]
            s = np.round(qm[part] @ x, 9)
            if s.shape[1] > k:
                floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
                qi, xi = np.nonzero(s >= floor)
            else:
                qi, xi = np.nonzero(np.ones_like(s, dtype=bool))
            out_q.append(part[qi])
            out_i.append(items[rows[xi]])
            out_s.append(s[qi, xi])
    if not out_q:
        return None
    return keep_best(np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s), k)


def _with_cells(df: DataFrame, vec: str, key: str) -> DataFrame:
    cells = F.col("cells") if "cells" in df.columns else F.array(F.lit(ALL))
    return df.where(F.col(vec).isNotNull()).select(key, F.col(vec).alias("vec"), cells.cast("array<string>").alias("cells"))


def knn(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", item_id: str = "chunk_id",
        vec: str = "embedding", max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """Exact top ``k``: (query_id, item_id, vector_score, dense_pos).

    An optional ARRAY<STRING> column ``cells`` on both sides restricts the search:
    a question sees the items that share a cell with it.
    """
    q, x = _with_cells(queries, vec, query_id), _with_cells(corpus, vec, item_id)
    n, dim = q.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if n * (dim or 0) * 8 <= max_broadcast:
        found = _broadcast_knn(q, x, k, query_id, item_id)
    else:
        found = _grid_knn(q, x, k, query_id, item_id, dim, max_broadcast)
    best = first_per_key(found, [query_id], [F.desc("vector_score"), item_id], k, "dense_pos", keep=True)
    # k rows per question from a pass over the whole corpus: stored, so that no later join searches again
    return materialise(best.select(query_id, item_id, "vector_score", "dense_pos"), "neighbours")


def _schema(q, x, query_id, item_id):
    qt, xt = q.schema[query_id].dataType.simpleString(), x.schema[item_id].dataType.simpleString()
    return f"{query_id} {qt}, {item_id} {xt}, vector_score double"


def _broadcast_knn(q, x, k, query_id, item_id):
    rows = q.toArrow()  # size was checked by the caller
    payload = q.sparkSession.sparkContext.broadcast((
        rows[query_id].combine_chunks(),
        _unit(_matrix(rows["vec"].combine_chunks())) if rows.num_rows else np.zeros((0, 1)),
        _cell_rows(rows["cells"].to_pylist()),
    ))

    def scan(batches):
        q_ids, qm, q_cells = payload.value
        best = None
        for b in batches:
            if not b.num_rows or not len(qm):
                continue
            new = _score(
                qm, q_cells, b[item_id].to_numpy(zero_copy_only=False), _unit(_matrix(b["vec"])),
                _cell_rows(b["cells"].to_pylist()), k,
            )
            if new is not None:
                best = new if best is None else keep_best(*(np.concatenate(p) for p in zip(best, new)), k)
        if best is not None:
            yield pa.RecordBatch.from_arrays(
                [q_ids.take(pa.array(best[0])), pa.array(best[1]), pa.array(best[2])],
                names=[query_id, item_id, "vector_score"],
            )

    return x.mapInArrow(scan, _schema(q, x, query_id, item_id))


def _grid_knn(q, x, k, query_id, item_id, dim, max_broadcast):
    names = [query_id, item_id, "vector_score"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        best = None
        if left.num_rows and right.num_rows:
            best = _score(
                _unit(_matrix(left["vec"].combine_chunks())), _cell_rows(left["cells"].to_pylist()),
                right[item_id].to_numpy(), _unit(_matrix(right["vec"].combine_chunks())),
                _cell_rows(right["cells"].to_pylist()), k,
            )
        if best is None:
            types = [left.schema.field(query_id).type, right.schema.field(item_id).type, pa.float64()]
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        return pa.table([left[query_id].take(pa.array(best[0])), pa.array(best[1]), pa.array(best[2])], names=names)

    rows = max(1, max_broadcast // (dim * 8))
    return bounded_grid(q, x, query_id, item_id, rows, meet, _schema(q, x, query_id, item_id))


def train_cells(corpus: DataFrame, n_cells: int, vec: str = "embedding", seed: int = 42, iterations: int = 10) -> np.ndarray:
    """Cell centres of the approximate index (k-means by cosine, run by Spark ML)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = corpus.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=iterations, distanceMeasure="cosine").fit(points)
    return np.vstack(model.clusterCenters())


def assign_cells(df: DataFrame, centres: np.ndarray, n: int = 1, vec: str = "embedding", numbers: np.ndarray | None = None) -> DataFrame:
    """Adds ``cells``: the ``n`` nearest cells of each vector, one pass without shuffle.

    Cells are named by their ``numbers`` (0, 1, ... by default).
    """
    unit = _unit(centres)
    names = [f"c{j}" for j in (range(len(unit)) if numbers is None else numbers.tolist())]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", cells array<string>"

    def nearest(batches):
        for b in batches:
            s = _unit(_matrix(b[vec])) @ unit.T if b.num_rows else np.zeros((0, len(unit)))
            top = np.argsort(-s, axis=1, kind="stable")[:, :n]
            cells = pa.array([[names[j] for j in row] for row in top], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, cells], names=[*b.schema.names, "cells"])

    return df.mapInArrow(nearest, schema)
