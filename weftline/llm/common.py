"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

U64 = np.uint64


def documents(df: DataFrame, *others: str) -> DataFrame:
    """doc_id (bigint) and text (string) alone, whatever else the table holds, then ``others`` as they are."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)


def release() -> None:
    """Give memory that a worker holds but does not use back to the system: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str, clear: Callable[[], None]) -> None:
    """Name what a worker remembers between tasks of ``owner``; a task of another owner drops it by ``clear``."""
    _HELD[owner] = clear


def drop_others(owner: str) -> None:
    """Workers outlive their tasks, and one stage's vocabulary or model is of no use to the next one's."""
    others = [name for name in _HELD if name != owner]
    for name in others:
        _HELD.pop(name)()
    if others:
        release()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 6 << 20, owner: str = "") -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``limit`` bytes of ``column``; a longer row comes alone, whole."""
    drop_others(owner)
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = lengths(values)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        release()


def lengths(values: pa.Array) -> np.ndarray:
    """Bytes of each string, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings in a row and the bounds of each (nulls are empty)."""
    joined = pa.array(values.fill_null(""), pa.large_string())
    bounds = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1]
    data = joined.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[bounds[0]:bounds[-1]], bounds - bounds[0]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """SplitMix64 finaliser over unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all runs ``starts[i] .. starts[i] + sizes[i]``, one after another."""
    sizes = np.asarray(sizes, np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.asarray(starts, np.int64) - (np.cumsum(sizes) - sizes)
    return np.repeat(shift, sizes) + np.arange(total)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def text_key() -> Column:
    """Tells apart rows that share a doc_id; null and empty texts are alike."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast side if it has at most ``rows`` narrow rows, else the plain table, which joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(df: DataFrame, rejected: DataFrame, *more: str) -> DataFrame:
    """The rows of ``df``, all columns kept, whose (doc_id, text hash, ``more``) is not in ``rejected``."""
    names = ["doc_id", "_h", *more]
    gone = rejected.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(names)]).distinct()
    mine = [F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), *[F.col(c) for c in more]]
    matched = mine[1] == F.col("_r1")
    for i, c in enumerate(mine):
        matched &= c.eqNullSafe(F.col(f"_r{i}"))
    return df.join(gone, matched, "left_anti")
