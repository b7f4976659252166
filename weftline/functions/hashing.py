"""Seeded draws every engine can repeat: all randomness comes from md5 digests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digest(seed: int | str, *keys: Column | str) -> Column:
    """md5 of ``seed|key|...``; its hex order is a seeded random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def draw(seed: int | str, *keys: Column | str) -> Column:
    """Uniform integer in [0, 2**32) from the first eight hex digits."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """Uniform double in [0, 1)."""
    return draw(seed, *keys) / F.lit(4294967296.0)
