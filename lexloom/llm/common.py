"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import materialise, scratch_base, ship_package

__all__ = ["WordTable", "arrays_of", "arrow_map", "documents", "materialise", "release", "remainder", "summed", "words_of", "with_checkpoint_dir", "xxmix"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``: the fold of a row."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(modulus)).cast("int")


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the cluster's folder, or one below the shared scratch base."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_base(spark) + "/checkpoints")


def words_of(text: str | bytes | None, fold: bool = True) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as bytes; A-Z lower-cased if ``fold``. Null: no words."""
    if text is None:
        return []
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return (raw.lower() if fold else raw).split()


def xxmix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit hashes over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def release() -> None:
    """Give memory that a task has freed back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over dictionaries: column name to Arrow array in, to list or array out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship_package(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from made(batches)
        release()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def arrays_of(df: DataFrame, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """Number columns of a bounded table in the driver, by their type there; they travel as bytes, not as rows of objects."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {c: [b[c].to_numpy(zero_copy_only=False).astype(kind).tobytes()] for c, kind in kinds.items()}

    rows = arrow_map(df.select(*kinds), run, ", ".join(f"{c} binary" for c in kinds)).collect()
    return {c: np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in kinds.items()}


def summed(df: DataFrame, per_task: Callable[[Iterator[dict]], np.ndarray], size: int, slice_size: int = 1 << 16, finish: Callable[[np.ndarray], np.ndarray] = lambda v: v, kind_of: str = "f8", planes: bool = False) -> np.ndarray:
    """Sum of one vector of ``size`` counts per task.

    Tasks send their non-zero slices, which are added slice by slice and put through
    ``finish``; the driver gets ``size`` numbers of type ``kind_of``, whatever the input.
    With ``planes`` (whole counts below 2^32) slices travel compressed, byte by byte of the counts.
    """

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        total = per_task(batches)
        for at in range(0, size, slice_size):
            part = total[at : at + slice_size]
            if part.any() and planes:
                by_byte = np.ascontiguousarray(part.astype("<u4").view(np.uint8).reshape(-1, 4).T)
                yield {"slice": [at // slice_size], "counts": [zstandard.ZstdCompressor(level=1).compress(by_byte.tobytes())]}
            elif part.any():
                yield {"slice": [at // slice_size], "counts": [np.asarray(part, np.float64).astype(np.uint32 if part.max() < 2**32 else np.float64).tobytes()]}

    def add(batches: Iterator[dict]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b["slice"].to_pylist(), b["counts"].to_pylist(), strict=True):
                width = min(slice_size, size - k * slice_size)
                if planes:
                    by_byte = np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint8).reshape(4, width)
                    c = np.ascontiguousarray(by_byte.T).tobytes()
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.uint32 if len(c) == 4 * width else np.float64).astype(np.float64)
        for k, v in sums.items():
            yield {"slice": [k], "counts": [finish(v).astype(kind_of).tobytes()]}

    kind, out = "slice int, counts binary", np.zeros(size, kind_of)
    parts = min(8, -(-size // slice_size))  # the driver takes one part at a time
    for r in arrow_map(arrow_map(df, count, kind).repartition(parts, "slice"), add, kind).toLocalIterator():
        part = np.frombuffer(r.counts, kind_of)
        out[r.slice * slice_size : r.slice * slice_size + len(part)] = part
    return out


class WordTable(dict):
    """Word -> row of a value table, computed once per distinct word.

    ``compute`` gets the words not yet seen and returns one row of values for
    each. The table is emptied once it holds ``limit`` words, so its memory is
    bounded.
    """

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], limit: int = 400_000):
        super().__init__()
        self.compute, self.limit, self.pending, self.values, self.used = compute, limit, [], None, 0

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.pending.append(word)
        return at

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of ``words``; valid until the next call."""
        if len(self) > self.limit:
            self.clear()
            self.used, self.pending = 0, []
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.pending:
            new = np.asarray(self.compute(self.pending))
            need = self.used + len(new)
            if self.values is None or need > len(self.values) or self.values.dtype != new.dtype:
                grown = np.empty((max(need, 2 * self.used, 1024), *new.shape[1:]), new.dtype)
                if self.used:
                    grown[: self.used] = self.values[: self.used]
                self.values = grown
            self.values[self.used : need] = new
            self.used, self.pending = need, []
        return at
