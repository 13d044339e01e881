"""A kept cell index for approximate nearest neighbours.

Vectors lie in folders by their cell, the nearest of about sqrt(rows) centres. A search looks up
each question's nearest cells and opens only their folders (partition pruning through the
join with the questions' cells). New vectors are appended to their cells without training;
a cell that has grown far beyond the others is split in two, and only its own vectors are
written again. Centres are trained on a bounded sample, on which the number of cells to probe
is learned too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .kept import KeptFolder
from .skew import first_per_key
from .vectors import _matrix, _unit, assign_cells, knn, train_cells

SAMPLE_PER_CELL, LEARN_ROWS, LEARN_QUESTIONS = 64, 4_000, 200


class CellIndex(KeptFolder):
    """Index folder at ``path``. ``key`` and ``vec`` name the columns; other columns of appended rows are kept beside them."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", vec: str = "embedding"):
        super().__init__(spark, path)
        self.key, self.vec = key, vec

    # -- writing ------------------------------------------------------------------
    def build(self, corpus: DataFrame, n_cells: int | None = None, k: int = 16, recall: float = 0.95) -> int:
        """Train centres on a sample of ``corpus`` and append all of it; an index that exists only gets the rows it lacks."""
        rows = corpus.where(F.col(self.vec).isNotNull())
        if not self.segments():
            n = rows.count()
            if not n:
                return 0
            cells = min(n, n_cells or max(1, round(n**0.5)))
            sample = materialise(rows.select(self.vec).orderBy(F.xxhash64(self.vec)).limit(max(cells * SAMPLE_PER_CELL, LEARN_ROWS)), "cell-sample")
            centres = train_cells(sample, cells, self.vec)
            self._write_centres(self.new_segment("centres"), centres, range(len(centres)), None, self._probes(sample, centres, k, recall))
        return self.append(rows)

    def append(self, rows: DataFrame) -> int:
        """Add rows whose key is not in the index yet (the first of equal keys); returns their number."""
        if not self.segments():
            raise ValueError(f"no index at {self.path}; build it first")
        new = first_per_key(rows.where(F.col(self.vec).isNotNull() & F.col(self.key).isNotNull()), [self.key], [F.xxhash64(self.vec)])
        old = self._vectors()
        if old is not None:
            new = new.join(old.select(self.key), self.key, "left_anti")
        segment = self.new_segment("vectors")
        self._write_vectors(segment, new)
        n = self.spark.read.parquet(f"{self.path}/{segment}/counts").agg(F.sum("n")).first()[0]
        if n:
            self.commit(segment)
        return n or 0

    def split(self, factor: float = 4.0) -> list[int]:
        """Split every cell with more than ``factor`` times the mean number of vectors; returns the cells that were split."""
        counts = self.sizes()
        mean = sum(counts.values()) / max(1, len(counts))
        big = sorted(c for c, n in counts.items() if n > factor * mean)
        for cell in big:
            rows = self._vectors().where(F.col("cell") == cell).drop("cell")
            sample = materialise(rows.select(self.vec).orderBy(F.xxhash64(self.vec)).limit(LEARN_ROWS), "cell-sample")
            halves = train_cells(sample, 2, self.vec)
            if len(halves) < 2:  # equal vectors
                continue
            first = max(self._all_centres()) + 1
            segment = self.new_segment("split")
            names = np.array([first, first + 1])
            self._write_vectors(segment, rows, (names, halves))
            self._write_centres(segment, halves, names.tolist(), cell, self.probes())
        return big

    def _write_vectors(self, segment: str, rows: DataFrame, centres: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        numbers, matrix = centres or self._active()
        placed = assign_cells(rows, matrix, 1, self.vec, numbers).withColumn("cell", _number(F.col("cells")[0])).drop("cells")
        folder = f"{self.path}/{segment}"
        # rows of a cell meet in few files; a large cell is spread over as many tasks as its rows need
        placed.repartitionByRange(F.col("cell"), F.col(self.key)).write.partitionBy("cell").parquet(f"{folder}/vectors")
        written = self.spark.read.schema(placed.schema).parquet(f"{folder}/vectors")
        written.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{folder}/counts")

    def _write_centres(self, segment: str, centres: np.ndarray, names, replaces: int | None, probes: int) -> None:
        rows = [(int(n), c.tolist(), replaces, probes) for n, c in zip(names, centres, strict=True)]
        self.spark.createDataFrame(rows, "cell int, centre array<double>, replaces int, probes int").coalesce(1).write.parquet(f"{self.path}/{segment}/centres")
        self.commit(segment)

    def _probes(self, sample: DataFrame, centres: np.ndarray, k: int, recall: float) -> int:
        """Fewest cells that hold ``recall`` of the ``k`` nearest of some vectors, measured on others of the sample."""
        x = _unit(_matrix(sample.limit(LEARN_ROWS).toArrow()[self.vec].combine_chunks()))  # a bounded number of rows
        q, unit = x[:LEARN_QUESTIONS], _unit(centres)
        near = q @ x.T
        near[np.arange(len(q)), np.arange(len(q))] = -2.0  # not itself
        best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        if not best.size:
            return len(centres)
        place = np.argsort(np.argsort(-(q @ unit.T), axis=1, kind="stable"), axis=1)  # of each cell for each question
        needed = np.take_along_axis(place, (x @ unit.T).argmax(1)[best], axis=1).ravel() + 1
        return int(np.quantile(needed, recall, method="higher"))

    # -- reading ------------------------------------------------------------------
    def _of(self, *kinds: str) -> list[str]:
        return [s for s in self.segments() if s.split("-")[0] in kinds]

    def _all_centres(self) -> dict[int, tuple[np.ndarray, int | None, int]]:
        rows = self.part("centres", self._of("centres", "split"))
        return {r.cell: (np.array(r.centre), r.replaces, r.probes) for r in rows.collect()} if rows is not None else {}

    def _active(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and centres of the cells in use: those that no split has replaced."""
        every = self._all_centres()
        gone = {replaces for _, replaces, _ in every.values()}
        names = sorted(c for c in every if c not in gone)
        return np.array(names, int), np.vstack([every[c][0] for c in names])

    def probes(self) -> int:
        return max(p for _, _, p in self._all_centres().values())

    def _vectors(self) -> DataFrame | None:
        found = self.part("vectors", self._of("vectors", "split"))
        if found is None:
            return None
        names, _ = self._active()
        every = self._all_centres()
        gone = sorted(set(every) - set(names.tolist()))
        return found.where(~F.col("cell").isin(gone)) if gone else found

    def sizes(self) -> dict[int, int]:
        """Vectors per cell in use, from the counts written with each segment."""
        counts = self.part("counts", self._of("vectors", "split"))
        names, _ = self._active()
        have = {r.cell: r.n for r in counts.groupBy("cell").agg(F.sum("n").alias("n")).collect()} if counts is not None else {}
        return {int(c): have.get(int(c), 0) for c in names}

    def search(self, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id", **kw) -> DataFrame:
        """Approximate top ``k``: ``query_id``, key, vector_score, dense_pos. Only vectors in the ``probes`` cells nearest to a question are scored."""
        if not self.segments():
            raise ValueError(f"no index at {self.path}")
        asked, near = self.candidates(queries, probes)
        return knn(asked, near, k, query_id, self.key, self.vec, **kw)

    def candidates(self, queries: DataFrame, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Questions with their cells, and the vectors of all cells that any question asks for."""
        names, centres = self._active()
        asked = materialise(assign_cells(queries.where(F.col(self.vec).isNotNull()), centres, min(probes or self.probes(), len(names)), self.vec, names), "asked")
        wanted = asked.select(F.explode("cells").alias("_c")).distinct().select(_number(F.col("_c")).alias("cell"))
        # at most one row a cell: small enough to go to every task, and to choose the folders by
        found = self._vectors().join(F.broadcast(wanted), "cell", "left_semi")
        return asked, found.withColumn("cells", F.array(F.concat(F.lit("c"), F.col("cell").cast("string"))))


def _number(name: Column) -> Column:
    return F.substring(name, 2, 9).cast("int")
