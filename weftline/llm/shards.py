"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in doc_id order, the number is permuted on ``[0, n)`` by an
alternating Feistel network on ``a x b >= n`` cells, and cells at or beyond
``n`` are walked on until they fall inside. Shard and slot are the remainder
and the quotient of the permuted place, so both can be computed for any row,
and the row for any (shard, slot), without a table. Only (doc_id, size,
checksum) rows are ever sorted; texts stay where they are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.index import with_row_index
from .common import U64, documents, mix

ROUNDS = 8


def _cells(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _encrypt(x: np.ndarray, a: int, b: int, seed: int) -> np.ndarray:
    left, right = x // U64(b), x % U64(b)
    for r in range(0, ROUNDS, 2):
        left = (left + mix(right, seed * ROUNDS + r) % U64(a)) % U64(a)
        right = (right + mix(left, seed * ROUNDS + r + 1) % U64(b)) % U64(b)
    return left * U64(b) + right


def _decrypt(x: np.ndarray, a: int, b: int, seed: int) -> np.ndarray:
    left, right = x // U64(b), x % U64(b)
    for r in range(ROUNDS - 2, -1, -2):
        right = (right + U64(b) - mix(left, seed * ROUNDS + r + 1) % U64(b)) % U64(b)
        left = (left + U64(a) - mix(right, seed * ROUNDS + r) % U64(a)) % U64(a)
    return left * U64(b) + right


def _walk(rows: np.ndarray, n: int, seed: int, step) -> np.ndarray:
    out = np.asarray(rows, U64).copy()
    if not len(out):
        return out.astype(np.int64)
    a, b = _cells(n)
    out = step(out, a, b, seed)
    # fewer than a of the a x b cells lie outside, so hardly any row walks twice
    outside = np.flatnonzero(out >= U64(n))
    while len(outside):
        out[outside] = step(out[outside], a, b, seed)
        outside = outside[out[outside] >= U64(n)]
    return out.astype(np.int64)


def permuted(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Place of each row number of ``[0, n)`` after the shuffle."""
    return _walk(rows, n, seed, _encrypt)


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """Row number held by each (shard, slot): the inverse of the shuffle."""
    return _walk(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64), n, seed, _decrypt)


def assign(df: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, row, place, shard, slot of every document.

    size is the UTF-8 bytes of the text plus 16, a null text counts as empty.
    Rows are numbered by (doc_id nulls first, checksum, size); rows equal in
    all three are interchangeable and each gets a slot of its own. An empty
    table gives no rows. Shard counts differ by one at most.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    body = F.coalesce("text", F.lit(""))
    slim = documents(df).select("doc_id", (F.octet_length(body) + 16).cast("bigint").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    numbered = with_row_index(slim, ["doc_id", "text_crc32", "size"], "row")
    n = numbered.count()

    @F.pandas_udf("bigint")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permuted(rows.to_numpy(), n, seed))

    placed = numbered.withColumn("place", place("row"))
    return placed.select("*", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / F.lit(shards)).cast("bigint").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 40, seed: int = 7) -> None:
    """The documents as Parquet under ``path/shard=k``, each shard in slot order.

    Texts join their place by (doc_id, checksum, size) and move once. Rows
    equal in all three are dealt to their slots by a rank among equals, which
    a global index gives, so no group of copies meets in one task.
    """
    body = F.coalesce("text", F.lit(""))
    keyed = documents(df).withColumns({"size": (F.octet_length(body) + 16).cast("bigint"), "text_crc32": F.crc32(F.encode(body, "UTF-8"))})
    names = ["doc_id", "text_crc32", "size"]
    slots = assign(df, shards, seed)
    # all rows of a key hold the same digest columns and, but for a checksum clash, the same text: send one text per key
    one = keyed.groupBy(*names).agg(F.min("text").alias("text"))
    out = slots.join(one.withColumnsRenamed({c: f"_{c}" for c in names}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names], "left").drop(*[f"_{c}" for c in names])
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
