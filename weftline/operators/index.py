"""Global and per-group positions without a single-task window.

Rows are range-partitioned on the order, staged once, and numbered as
``offset of the partition + place inside the partition``. Only one row per
partition is ever summed in one task, so the number of rows does not matter,
and a hot group key is cut by the range partitioning like any other data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

_PLACE_BITS = 33


def _placed(df: DataFrame, order: list, unwanted: list[str] | tuple = ()) -> DataFrame:
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # rows are written in their order, so columns that only give it need not be
    marked = ranged.drop(*unwanted).withColumn("_at", F.monotonically_increasing_id())
    return stage(marked, "placed").withColumn("_part", F.shiftright("_at", _PLACE_BITS))


def with_row_index(df: DataFrame, order: list, name: str = "row_idx") -> DataFrame:
    """0-based position under ``order`` (must be a total order)."""
    placed = _placed(df, order)
    # one row per partition: the prefix window and the broadcast are bounded by the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count("*").alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_base") + local)
        .drop("_part", "_at", "_base")
    )


def with_running_totals(df: DataFrame, order: list, totals: dict[str, Column], kind: str = "bigint") -> DataFrame:
    """Exclusive running sums of ``totals`` under ``order``."""
    valued = df.select("*", *[v.cast(kind).alias(f"_v_{n}") for n, v in totals.items()])
    names = list(totals)
    placed = _placed(valued, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    offsets = offsets.select(
        "_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names]
    )
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.join(F.broadcast(offsets), "_part").select(
        "*", *[(F.col(f"_b_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0))).alias(n) for n in names]
    )
    return summed.drop("_part", "_at", *[f"_v_{n}" for n in names], *[f"_b_{n}" for n in names])


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    matched = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, matched, how).drop(*[f"_r_{k}" for k in keys])


def with_group_index(df: DataFrame, keys: list[str], order: list, name: str, unwanted: list[str] | tuple = ()) -> DataFrame:
    """0-based position inside each group; a group of any size is cut by the range partitions.

    ``unwanted`` columns, other than the keys, are left out of the result.
    """
    return with_group_totals(df, keys, order, {name: F.lit(1)}, unwanted=unwanted)


def attach_group(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Group aggregates joined back to the rows.

    The aggregate is combined map-side and the join can be split by adaptive
    skew handling, where ``agg().over(partitionBy)`` would hold a hot group in
    one task.
    """
    return same_keys(df, df.groupBy(*keys).agg(*aggs), keys)


def attach_single(df: DataFrame, one_row: DataFrame, *names: str) -> DataFrame:
    """Columns of a one-row frame as scalar subqueries on every row."""
    bundle = one_row.select(F.struct(*names).alias("_one"))
    return df.withColumn("_one", bundle.scalar()).select(*df.columns, *[F.col(f"_one.{n}").alias(n) for n in names])


def with_last_before(df: DataFrame, keys: list[str], order: list, when: Column, value: Column, name: str) -> DataFrame:
    """Value of the latest earlier row of the group where ``when`` holds.

    It is found inside each range partition and carried over from one row per
    earlier partition.
    """
    hit = F.when(when, F.struct(*keys, value.alias("_val")))
    placed = _placed(df.withColumn("_hit", hit), [F.col(k) for k in keys] + list(order))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("_part").agg(F.max_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("_at"))).alias("_end"))
    carried = carried.select("_part", F.last("_end", ignorenulls=True).over(across).alias("_carry"))
    seen = placed.join(F.broadcast(carried), "_part").withColumn(
        "_last", F.coalesce(F.last("_hit", ignorenulls=True).over(inside), F.col("_carry")))
    same = reduce(lambda a, b: a & b, [F.col(f"_last.{k}").eqNullSafe(F.col(k)) for k in keys])
    return seen.withColumn(name, F.when(same, F.col("_last._val"))).drop("_part", "_at", "_hit", "_carry", "_last")


def with_group_totals(df: DataFrame, keys: list[str], order: list, totals: dict[str, Column], kind: str = "bigint",
                      unwanted: list[str] | tuple = ()) -> DataFrame:
    """Exclusive running sums of ``totals`` inside each group.

    A group is summed inside its range partitions. Only the group that ends a
    partition can go on in the next one, so what is carried over is one row
    per partition; sums never mix with those of other groups.
    """
    names = list(totals)
    valued = df.select("*", *[v.cast(kind).alias(f"_v_{n}") for n, v in totals.items()])
    by = [F.col(k) for k in keys] + list(order)
    placed = _placed(valued, by, unwanted) if unwanted else _placed(valued, by)
    group = F.struct(*keys)
    ends = placed.groupBy("_part").agg(F.min_by(group, "_at").alias("_first"), F.max_by(group, "_at").alias("_last"))
    tails = placed.join(F.broadcast(ends), "_part").filter(group.eqNullSafe(F.col("_last"))).groupBy("_part").agg(
        F.first("_first").alias("first"), F.first("_last").alias("last"), *[F.coalesce(F.sum(f"_v_{n}"), F.lit(0).cast(kind)).alias(n) for n in names])
    carried, last, held = [], None, None
    for row in sorted(tails.collect(), key=lambda r: r["_part"]):
        goes_on = last is not None and row["first"] == last
        before = held if goes_on else [0 * row[n] for n in names]
        carried.append((row["_part"], *before))
        whole = row["first"] == row["last"]
        held = [row[n] + (b if whole else 0 * b) for n, b in zip(names, before)]
        last = row["last"]
    carry = df.sparkSession.createDataFrame(carried, "_part bigint, " + ", ".join(f"`_c_{n}` {kind}" for n in names))
    firsts = ends.select("_part", "_first").join(carry, "_part")
    inside = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(kind)
    seen = placed.join(F.broadcast(firsts), "_part").select(
        "*", *[(F.when(group.eqNullSafe(F.col("_first")), F.col(f"_c_{n}")).otherwise(zero) + F.coalesce(F.sum(f"_v_{n}").over(inside), zero)).cast(kind).alias(n) for n in names])
    return seen.drop("_part", "_at", "_first", *[f"_v_{n}" for n in names], *[f"_c_{n}" for n in names])


def exact_quantile(df: DataFrame, value: str, q: float) -> float | None:
    """Linear-interpolated quantile by position over counted values, so ties are one row; two rows reach the driver."""
    counted = df.groupBy(value).agg(F.count("*").alias("_n"))
    n = df.count()
    if n == 0:
        return None
    at = q * (n - 1)
    low, high = int(at), min(int(at) + 1, n - 1)
    placed = with_running_totals(counted, [value], {"_from": F.col("_n")}).select(value, "_from", (F.col("_from") + F.col("_n")).alias("_to"))

    def holds(p: int) -> Column:
        return (F.col("_from") <= p) & (F.col("_to") > p)

    rows = placed.filter(holds(low) | holds(high)).collect()
    first, second = [next(r[value] for r in rows if r["_from"] <= p < r["_to"]) for p in (low, high)]
    return first + (second - first) * (at - low)
