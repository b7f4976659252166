"""Token array functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank_tokens


def let(value: Column, body) -> Column:
    """Bind a value once; inside a lambda an outer expression is evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column | str) -> Column:
    """Sum of an integer array."""
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def word_ids(text: Column) -> Column:
    """Portable word ids: 24 bits of each lower-cased word's digest, plus one (0 is padding)."""
    return F.transform(blank_tokens(text), lambda w: F.conv(F.substring(F.md5(F.lower(w)), 1, 6), 16, 10).cast("bigint") + 1)


def pad_or_truncate(ids: Column, length: int, pad: int = 0, left_pad: bool = True, policy: str = "error") -> tuple[Column, Column]:
    """(ids, mask) of exactly ``length``; ``policy`` keeps the right end (left), the left end (right) or fails."""
    n = F.size(ids)
    short = F.greatest(F.lit(length) - n, F.lit(0))
    if policy == "left":
        kept = F.slice(ids, F.greatest(n - length, F.lit(0)) + 1, F.lit(length))
    elif policy == "right":
        kept = F.slice(ids, 1, length)
    elif policy == "error":
        kept = F.when(n > length, F.raise_error(F.lit(f"sequence is longer than {length}"))).otherwise(ids)
    else:
        raise ValueError(f"unknown policy {policy}")
    blank, zeros = F.array_repeat(F.lit(pad).cast("bigint"), short), F.array_repeat(F.lit(0), short)
    ones = F.array_repeat(F.lit(1), F.least(n, F.lit(length)))
    if left_pad:
        return F.concat(blank, kept), F.concat(zeros, ones)
    return F.concat(kept, blank), F.concat(ones, zeros)


def pair_encode(a: Column, b: Column | None, max_len: int, cls: int, sep: int, pad: int) -> tuple[Column, Column, Column]:
    """(ids, types, mask) of ``[CLS] a [SEP] b [SEP]``, cut to ``max_len - 1`` and closed; types are padded with the pad id."""
    def one(x, t="bigint"):
        return F.array(F.lit(x).cast(t))
    body = F.concat(one(cls), a, one(sep), b) if b is not None else F.concat(one(cls), a, one(sep))
    kinds = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.size(a) + 2), F.array_repeat(F.lit(1).cast("bigint"), F.size(b))) if b is not None else \
        F.array_repeat(F.lit(0).cast("bigint"), F.size(a) + 2)
    cut = F.size(body) >= max_len
    closed = F.lit(True) if b is not None else cut
    ids = F.when(closed, F.concat(F.slice(body, 1, max_len - 1), one(sep))).otherwise(body)
    types = F.when(closed, F.concat(F.slice(kinds, 1, max_len - 1), one(1 if b is not None else 0))).otherwise(kinds)
    short = F.lit(max_len) - F.size(ids)
    return (F.concat(ids, F.array_repeat(F.lit(pad).cast("bigint"), short)), F.concat(types, F.array_repeat(F.lit(pad).cast("bigint"), short)),
            F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), short)))


def whitespace_ints(text: Column) -> Column:
    """Blank-separated integers as ids; anything else is null."""
    return F.transform(blank_tokens(text), lambda w: w.try_cast("bigint"))


def encode_sentences(sentences: Column, eod: int | None = None) -> tuple[Column, Column]:
    """(ids, lengths) of a text's sentences: empty ones are skipped, the end id counts in the last one."""
    parts = F.filter(F.transform(sentences, word_ids), lambda s: F.size(s) > 0)
    ids, lengths = F.flatten(parts), F.transform(parts, F.size)
    if eod is None:
        return ids, lengths
    some = F.size(parts) > 0
    return (F.when(some, F.concat(ids, F.array(F.lit(eod).cast("bigint")))).otherwise(ids),
            let(lengths, lambda x: F.when(F.size(x) > 0, F.concat(F.slice(x, F.lit(1), F.size(x) - 1), F.array(F.element_at(x, -1) + 1))).otherwise(x)))
