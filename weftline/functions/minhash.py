"""MinHash signatures over character shingles."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

PRIME = 2_147_483_647
BASE = 1_000_003


def coefficients(num_perm: int) -> tuple[list[int], list[int]]:
    """Multipliers and shifts of the permutations, drawn from digests."""
    def word(tag, i):
        return int(hashlib.md5(f"{tag}|{i}".encode()).hexdigest()[:8], 16)
    return [1 + word("a", i) % (PRIME - 1) for i in range(num_perm)], [word("b", i) % PRIME for i in range(num_perm)]


def signature(text: Column, num_perm: int = 100, ngram: int = 5) -> Column:
    """Minimum of every permutation over the shingles; null for texts without shingles.

    Hashing hundreds of values per shingle is array arithmetic, so one numpy
    pass per text does it inside the task.
    """
    a, b = (np.array(x, dtype=np.int64)[:, None] for x in coefficients(num_perm))

    def one(s: str | None, wide: np.ndarray, narrow: np.ndarray):
        if s is None:
            return None
        codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        n = len(codes) - ngram
        if n <= 0:
            return None
        h = np.zeros(n, dtype=np.int64)
        for i in range(ngram):
            h = (h * BASE + codes[i:i + n]) % PRIME
        h = np.unique(h)
        low, high = np.full(num_perm, PRIME, dtype=np.uint32), np.zeros(num_perm, dtype=np.uint32)
        for at in range(0, len(h), 512):
            part = h[None, at:at + 512]
            x, y = wide[0][:, :part.shape[1]], wide[1][:, :part.shape[1]]
            z, carry = narrow[0][:, :part.shape[1]], narrow[1][:, :part.shape[1]]
            np.multiply(a, part, out=x)
            x += b
            # remainder by 2**31 - 1 without a division; once folded it fits 32 bits
            np.right_shift(x, 31, out=y)
            x &= PRIME
            np.add(x, y, out=z, casting="unsafe")
            np.right_shift(z, 31, out=carry)
            z &= PRIME
            z += carry
            np.minimum(low, z.min(axis=1), out=low)
            np.maximum(high, z.max(axis=1), out=high)
        # 2**31 - 1 itself stands for zero
        low[high == PRIME] = 0
        low = low.astype(np.int64)
        return low

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def minhash(texts: pd.Series) -> pd.Series:
        # scratch of one batch, small enough to stay in the processor's cache
        wide, narrow = np.empty((2, num_perm, 512), dtype=np.int64), np.empty((2, num_perm, 512), dtype=np.uint32)
        return texts.map(lambda s: one(s, wide, narrow))

    return minhash(text)


def band_buckets(sig: Column, bands: int) -> Column:
    """One digest per band of consecutive signature rows."""
    rows = F.size(sig) / bands
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda i: F.md5(F.array_join(F.slice(sig, (i * rows + 1).cast("int"), rows.cast("int")).cast("array<string>"), ",")))
