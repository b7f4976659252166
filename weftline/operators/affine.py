"""Linear recurrences over rows of any number: x = a * x_before + b along an order, by composing affine maps.

Maps compose without commuting: first (a1, b1), then (a2, b2) is (a1 * a2,
a2 * b1 + b2). Rows are numbered under (keys, order); a group's first row has
a = 0, which lets nothing of the group before it through, so groups need no
partition of their own and one that holds most rows is cut like any other.
Blocks of a few rows are composed to one map each, blocks of blocks likewise,
until one is left; on the way back every block knows the value that enters it.
Everything is array expressions, grouped aggregates and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .index import attach_single, same_keys, with_row_index

ROWS = 64  # rows of a block: a fold that lists its steps is quadratic in them


def _entering(maps: DataFrame, rows: int) -> DataFrame:
    """(_pos, _x): the value that enters each of the maps (_pos, _a, _b), numbered without gaps, where 0 enters the first."""
    listed = maps.groupBy(F.expr(f"_pos div {rows}").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_pos", "_a", "_b"))).alias("_m"))
    blocks = stage(listed, "blocks")
    if blocks.limit(2).count() > 1:
        start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
        composed = F.aggregate("_m", start, lambda s, r: F.struct((s["a"] * r["_a"]).alias("a"), (r["_a"] * s["b"] + r["_b"]).alias("b")))
        above = blocks.select(F.col("_block").alias("_pos"), composed.alias("c")).select("_pos", F.col("c.a").alias("_a"), F.col("c.b").alias("_b"))
        blocks = blocks.join(_entering(above, rows).select(F.col("_pos").alias("_block"), "_x"), "_block")
    else:
        blocks = blocks.withColumn("_x", F.lit(0.0))
    start = F.struct(F.col("_x").alias("x"), F.array().cast("array<double>").alias("out"))
    steps = F.aggregate("_m", start, lambda s, r: F.struct((r["_a"] * s["x"] + r["_b"]).alias("x"), F.concat(s["out"], F.array(s["x"])).alias("out")))["out"]
    zipped = F.arrays_zip(F.transform("_m", lambda r: r["_pos"]).alias("p"), steps.alias("x"))
    return blocks.select(F.inline(zipped)).toDF("_pos", "_x")


def with_entering(df: DataFrame, keys: list[str], order: list, a: Column, b: Column, name: str, rows: int = ROWS) -> DataFrame:
    """``name``: the value x of the row before in its group (0 for the first), where x = a * x_before + b.

    ``a`` and ``b`` are finite doubles of the row itself, neither null. ``keys``
    and ``order`` are a total order of the rows.
    """
    mapped = df.select("*", a.cast("double").alias("_a"), b.cast("double").alias("_b"))
    numbered = stage(with_row_index(mapped, [*[F.col(k) for k in keys], *order], "_pos"), "numbered")
    firsts = numbered.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    marked = same_keys(numbered, firsts, keys)
    begins = F.col("_pos") == F.col("_first")
    maps = marked.select("_pos", F.when(begins, 0.0).otherwise(F.col("_a")).alias("_a"), "_b")
    out = marked.join(_entering(maps, rows), "_pos").withColumn(name, F.when(begins, 0.0).otherwise(F.col("_x")))
    return out.drop("_a", "_b", "_pos", "_first", "_x")


def _whitened(value: str) -> Column:
    return (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)


def _with_stats(df: DataFrame, value: str, mask: str) -> DataFrame:
    few = F.raise_error(F.lit("the mask leaves fewer than two tokens")).cast("double")
    kept = df.filter(F.col(mask) != 0).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("_var"))
    return attach_single(df, kept.select(F.when(F.col("n") < 2, few).otherwise(F.col("m")).alias("_mean"), "_var"), "_mean", "_var")


def gae_rows(df: DataFrame, keys: list[str], t: str, reward: str, value: str, mask: str, gamma: float, lam: float) -> DataFrame:
    """``advantages`` and ``returns`` of a table with one row per token, as :func:`.tokens.gae` gives them per response.

    What a token passes on to the one before it is gamma * value + gamma * lam * advantage.
    """
    own = F.col(reward) - F.col(value)
    scanned = with_entering(df, keys, [F.col(t).desc()], F.lit(gamma * lam), gamma * F.col(value) + gamma * lam * own, "_next")
    raw = stage(scanned.withColumn("_adv", own + F.col("_next")).withColumn("returns", F.col("_adv") + F.col(value)).drop("_next"), "returns")
    return _with_stats(raw, "_adv", mask).withColumn("advantages", _whitened("_adv")).drop("_adv", "_mean", "_var")


def reinforce_pp_rows(df: DataFrame, keys: list[str], t: str, reward: str, mask: str, gamma: float) -> DataFrame:
    """``advantages`` and ``returns`` of a table with one row per token, as :func:`.tokens.reinforce_pp` gives them per response."""
    m = F.col(mask).cast("double")
    scanned = with_entering(df, keys, [F.col(t).desc()], gamma * m, gamma * m * F.col(reward), "_next")
    raw = stage(scanned.withColumn("returns", F.col(reward) + F.col("_next")).drop("_next"), "returns")
    return _with_stats(raw, "returns", mask).withColumn("advantages", _whitened("returns") * m).drop("_mean", "_var")
