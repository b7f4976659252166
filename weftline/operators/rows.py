"""Row shaping: keys, ids, repetition, folding, padding, order and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import digest
from .index import attach_group, attach_single, with_row_index


def rename_keys(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("old and new names differ in number")
    return df.withColumnsRenamed(dict(zip(old, new)))


def pop_keys(df: DataFrame, keys: list[str], row_key: str) -> tuple[DataFrame, DataFrame]:
    """(rest, removed): both keep the row key so they can be joined again."""
    return df.drop(*keys), df.select(row_key, *keys)


def extract_path(col: Column | str, *keys: str, json: bool = False) -> Column:
    """Walk nested keys; arrays of one are unwrapped."""
    col = F.col(col) if isinstance(col, str) else col
    if json:
        return F.get_json_object(col, "$." + ".".join(keys))
    for k in keys:
        col = col[k]
    return col


def add_id(df: DataFrame, prefix: str, order: list) -> DataFrame:
    """``prefix-0000000001`` and up, in input order."""
    numbered = with_row_index(df, order, "_pos")
    return numbered.withColumn("adlr_id", F.format_string(prefix + "-%010d", F.col("_pos") + 1)).drop("_pos")


def subsample(df: DataFrame, rate: float, seed: int, key: str) -> DataFrame:
    """Exactly ``int(n * rate)`` rows, drawn by a seeded hash."""
    if rate >= 1:
        return df
    keep = int(df.count() * rate)
    ranked = with_row_index(df.withColumn("_h", digest(seed, key)), ["_h", key], "_pos")
    return ranked.filter(F.col("_pos") < keep).drop("_h", "_pos")


def repeat_rows(df: DataFrame, n: int) -> DataFrame:
    """Every row ``n`` times with its ``sample_idx``; order by (row, sample) or (sample, row)."""
    return df.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def fold(df: DataFrame, order: list, n: int, cols: list[str]) -> DataFrame:
    """``n`` consecutive rows become one row of arrays; the length must divide."""
    indexed = with_row_index(df, order, "_pos")
    groups = indexed.groupBy(F.floor(F.col("_pos") / n).alias("fold_id")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", *cols))).alias("_rows"))
    whole = F.when(F.size("_rows") != n, F.raise_error(F.lit(f"row count is no multiple of {n}"))).otherwise(F.col("_rows"))
    return groups.select("fold_id", whole.alias("_rows")).select(
        "fold_id", *[F.col(f"_rows.{c}").alias(c) for c in cols])


def unfold(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows of equal-length arrays back to one row per element."""
    return transpose_lists(df, key, cols, strict=True)


def transpose_lists(df: DataFrame, key: str, cols: list[str], strict: bool = True) -> DataFrame:
    """Columns of lists to records; unequal lengths are an error."""
    same = reduce(lambda a, b: a & b, [F.size(cols[0]) == F.size(c) for c in cols])
    zipped = F.arrays_zip(*cols)
    if strict:
        zipped = F.when(same, zipped).otherwise(F.raise_error(F.lit("lists differ in length")))
    return df.select(key, F.posexplode(zipped).alias("pos", "_x")).select(
        key, "pos", *[F.col(f"_x.{c}").alias(c) for c in cols])


def reorder(df: DataFrame, order: list, positions: DataFrame) -> DataFrame:
    """Rows taken by position: ``positions`` holds (out_pos, pos); positions beyond the table give none."""
    wanted = positions.select("out_pos", F.col("pos").cast("bigint").alias("_pos"))
    return with_row_index(df, order, "_pos").join(wanted, "_pos").drop("_pos")


def pad_to_divisor(df: DataFrame, k: int, order: list) -> DataFrame:
    """Append the first rows cyclically until the count divides by ``k``.

    Padding rows carry ``is_pad``; removing them is a filter. At most ``k - 1``
    rows are appended, each copied from a known position.
    """
    n = df.count()
    pad = -n % k
    indexed = with_row_index(df, order, "row_idx")
    copies = F.floor((F.lit(pad - 1) - F.col("row_idx")) / n).cast("int")
    extra = (
        indexed.filter(F.col("row_idx") < pad)
        .withColumn("_c", F.explode(F.sequence(F.lit(0), copies)))
        .withColumn("row_idx", F.lit(n) + F.col("_c") * n + F.col("row_idx")).drop("_c")
    )
    return indexed.withColumn("is_pad", F.lit(False)).unionByName(extra.withColumn("is_pad", F.lit(True)))


def seeded_order(df: DataFrame, seed: int | str, keys: list[str], name: str = "pos") -> DataFrame:
    """Reproducible permutation: position of each row in seeded hash order."""
    return with_row_index(df.withColumn("_h", digest(seed, *keys)), ["_h", *keys], name).drop("_h")


def shuffle_groups(df: DataFrame, seed: int, group: str, inner: list[str], name: str = "pos") -> DataFrame:
    """Permute groups, keep the order inside each."""
    return with_row_index(df.withColumn("_h", digest(seed, group)), ["_h", group, *inner], name).drop("_h")


def sample_generations(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """A seeded sample of ``n`` rows for a generation report."""
    return df.withColumn("_h", digest(seed, *keys)).orderBy("_h", *keys).limit(n).drop("_h")


def cycled_window(df: DataFrame, i: int, n: int, order: list) -> DataFrame:
    """The ``i``-th slice of ``n`` rows, wrapping after the last whole slice."""
    slices = max(df.count() // n, 1)
    start = (i % slices) * n
    return with_row_index(df, order, "row_idx").filter((F.col("row_idx") >= start) & (F.col("row_idx") < start + n))


def chunk_rows(df: DataFrame, k: int, order: list, strict: bool = True) -> DataFrame:
    """``k`` contiguous parts: equal (count must divide) or of ``ceil(n / k)`` rows."""
    n = df.count()
    if strict and n % k:
        raise ValueError(f"{n} rows cannot be cut into {k} equal parts")
    size = -(-n // k)
    return with_row_index(df, order, "row_idx").withColumn("chunk", F.floor(F.col("row_idx") / size))


def partition_input(df: DataFrame, n: int, order: list, sequential: bool = False) -> DataFrame:
    """Round-robin parts, or contiguous blocks of ``ceil(total / n)`` rows."""
    indexed = with_row_index(df, order, "row_idx")
    if not sequential:
        return indexed.withColumn("part", F.col("row_idx") % n)
    return indexed.withColumn("part", F.floor(F.col("row_idx") / (-(-df.count() // n))))


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Every row with ``is_first``: true for the smallest ``order`` of its key."""
    return attach_group(df, [key], F.min(order).alias("_first")).withColumn(
        "is_first", F.col(order) == F.col("_first")).drop("_first")


def difference(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return df.join(used.select(key), key, "left_anti")


def overlap(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def concat(dfs: list[DataFrame]) -> DataFrame:
    """Append batches; their columns must agree."""
    names = {frozenset(d.columns) for d in dfs}
    if len(names) != 1:
        raise ValueError("batches differ in their columns")
    return reduce(DataFrame.unionByName, dfs)


def zip_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Add b's columns to a. Row counts must match; shared columns must be value-equal."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    right = b.withColumnsRenamed({c: f"_b_{c}" for c in shared})
    both = a.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), key, "full")
    clash = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in shared], F.lit(False))
    checked = (
        F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("row keys differ")))
        .when(clash, F.raise_error(F.lit("a shared column differs"))).otherwise(F.col(key))
    )
    return both.withColumn(key, checked).drop("_l", "_r", *[f"_b_{c}" for c in shared])


def attach_by_position(a: DataFrame, a_order: list, b: DataFrame, b_order: list) -> DataFrame:
    """Row i of one table beside row i of the other."""
    return with_row_index(a, a_order).join(with_row_index(b, b_order), "row_idx")


__all__ = [n for n in dir() if not n.startswith("_")]
