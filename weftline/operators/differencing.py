"""Balanced k-way splits of batches by largest differencing, merged as a tree over tasks.

A state is a split of some rows into k parts, its sums sorted from the largest
down; its spread is the first sum less the last. The two states of widest
spread are joined, the heaviest part of one with the lightest of the other,
until one is left. A state does not list its members: every join keeps, for
each of its k parts, the part that it took from either side, and the parts of
the rows are read off these from the last join down.

A batch is cut into chunks of bounded size, dealt by place in the order of
lengths, so every chunk has long and short rows. A task differences a chunk to
one state of k sums; up to FAN states of a batch meet in the next level, and
so on until a batch has one. Chunks then learn by joins of these small tables
which part of the batch each of their parts became. A batch of one chunk is
differenced as a whole.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .index import same_keys

FAN = 64


def join_states(sums: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One state out of many (rows of sorted sums): its sums, its marks, and the part each part of each state became.

    Ties have an order: of equal spreads the larger first sum goes first, then
    the smaller mark (the first member of a part, -1 where it is empty); equal
    sums of a state are sorted by mark.
    """
    n, k = sums.shape
    waiting = [(-(s[0] - s[-1]), -s[0], min((x for x in m if x >= 0), default=-1), i) for i, (s, m) in enumerate(zip(sums.tolist(), marks.tolist()))]
    heapq.heapify(waiting)
    held = dict(enumerate(zip(sums, marks)))
    merges = []  # (new state, heavier state, other state, the heavier one's part for each new part)
    while len(waiting) > 1:
        a, b = heapq.heappop(waiting)[3], heapq.heappop(waiting)[3]
        (sa, ma), (sb, mb) = held.pop(a), held.pop(b)
        total, mb = sa + sb[::-1], mb[::-1]
        mark = np.where(ma < 0, mb, np.where(mb < 0, ma, np.minimum(ma, mb)))
        order = np.lexsort((mark, -total))
        new = n + len(merges)
        merges.append((new, a, b, order))
        total, mark = total[order], mark[order]
        held[new] = total, mark
        heapq.heappush(waiting, (-(total[0] - total[-1]), -total[0], min((x for x in mark.tolist() if x >= 0), default=-1), new))
    last = waiting[0][3]
    became = np.empty((n + len(merges), k), np.int64)
    became[last] = np.arange(k)
    for new, a, b, order in reversed(merges):
        became[a][order] = became[new]
        became[b][k - 1 - order] = became[new]
    return *held[last], became[:n]


def first_states(lengths: np.ndarray, places: np.ndarray, k: int, equal_size: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums and marks of the states that differencing begins with, and the state and part of each row: one row each or, for equal sizes, k."""
    many = k if equal_size else 1
    state = np.arange(len(lengths)) // many
    sums, marks = np.zeros((state[-1] + 1, k), np.int64), np.full((state[-1] + 1, k), -1, np.int64)
    # rows come from the longest down: places in a state are sorted by sum and place already
    part = np.arange(len(lengths)) % many
    sums[state, part], marks[state, part] = lengths, places
    return sums, marks, state, part


def lightest_first(lengths: np.ndarray, places: np.ndarray, k: int, equal_size: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row in turn to the part of least sum (the first of equals), by number of rows first for equal sizes: sums, marks and part of each row, sorted as a state."""
    parts = [(0, 0, p) for p in range(k)]
    at = np.empty(len(lengths), np.int64)
    marks = np.full(k, -1, np.int64)
    for row, (size, place) in enumerate(zip(lengths.tolist(), places.tolist())):
        count, total, p = heapq.heappop(parts)
        heapq.heappush(parts, (count + equal_size, total + size, p))
        at[row] = p
        marks[p] = place if marks[p] < 0 else marks[p]
    sums = np.zeros(k, np.int64)
    np.add.at(sums, at, lengths)
    order = np.lexsort((marks, -sums))
    return sums[order], marks[order], np.argsort(order)[at]


def split(placed: DataFrame, batch: str, length: str, equal_size: bool, given: bool, rows_per_task: int) -> DataFrame:
    """``_part`` of rows numbered ``_i`` inside batches of ``_n`` rows that are split into ``_k`` parts, from the heaviest down."""
    unit = F.expr("_i div _k") if equal_size else F.col("_i")
    chunks = F.expr(f"(_n + {rows_per_task - 1}) div {rows_per_task}")
    chunk = F.expr(f"_i div {rows_per_task}") if given and not equal_size else unit % chunks
    rows = placed.withColumn("_chunk", chunk).withColumn("_chunks", chunks)
    kind = dict(rows.dtypes)
    narrow = rows.select(F.col(batch).alias("batch"), F.col("_chunk").alias("chunk"), F.col("_chunks").alias("chunks"), "_i", F.col("_k").alias("k"), F.col(length).cast("bigint").alias("length"))

    def with_state(out: pd.DataFrame, sums: np.ndarray, marks: np.ndarray) -> pd.DataFrame:
        none = [None] * (len(out) - 1)
        return out.assign(sums=pd.Series([sums.tolist(), *none], index=out.index, dtype=object), marks=pd.Series([marks.tolist(), *none], index=out.index, dtype=object))

    def difference(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        sizes, places, k = pdf["length"].to_numpy(np.int64), pdf["_i"].to_numpy(np.int64), int(pdf["k"].iloc[0])
        if given:
            sums, marks, part = lightest_first(sizes, places, k, equal_size)
        else:
            starts, first_marks, state, at = first_states(sizes, places, k, equal_size)
            sums, marks, became = join_states(starts, first_marks)
            part = became[state, at]
        out = pdf[["batch", "chunk", "chunks", "_i", "k"]].assign(at=part)
        return with_state(out, sums, marks)

    key = f"batch {kind[batch]}"
    done = narrow.groupBy("batch", "chunk").applyInPandas(difference, f"{key}, chunk bigint, chunks bigint, _i bigint, k int, at bigint, sums array<bigint>, marks array<bigint>")
    done = stage(done, "chunks")
    states = done.filter("sums is not null").select("batch", "chunk", "chunks", "sums", "marks")
    levels = []  # per level: batch, node, up, became

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        sums, marks, became = join_states(np.stack(pdf["sums"].to_numpy()), np.stack(pdf["marks"].to_numpy()))
        out = pdf[["batch", "chunk", "up", "above"]].assign(became=list(became))
        return with_state(out, sums, marks)

    while not states.filter("chunks > 1").isEmpty():
        # states of one batch are dealt over the groups of the level above
        above = F.expr(f"(chunks + {FAN - 1}) div {FAN}")
        dealt = states.filter("chunks > 1").withColumn("above", above).withColumn("up", F.col("chunk") % F.col("above"))
        level = stage(dealt.groupBy("batch", "up").applyInPandas(join, f"{key}, chunk bigint, up bigint, above bigint, became array<bigint>, sums array<bigint>, marks array<bigint>"), "level")
        levels.append(level.select("batch", "chunk", "up", "became"))
        states = level.filter("sums is not null").select("batch", F.col("up").alias("chunk"), F.col("above").alias("chunks"), "sums", "marks")
    # what each chunk's parts became in the end, from the top level down; batches done at a level have no rows above it
    final = None
    for level in reversed(levels):
        if final is None:
            final = level.select("batch", "chunk", "became")
        else:
            top = final.select("batch", F.col("chunk").alias("up"), F.col("became").alias("top"))
            through = F.transform("became", lambda p: F.element_at("top", (p + 1).cast("int")))
            final = same_keys(level, top, ["batch", "up"], "left").select("batch", "chunk", F.when(F.col("top").isNull(), F.col("became")).otherwise(through).alias("became"))
    parts = done.select("batch", "chunk", "_i", "at")
    if final is None:
        parts = parts.select("batch", "_i", F.col("at").alias("_part"))
    else:
        joined = same_keys(parts, final, ["batch", "chunk"], "left")
        parts = joined.select("batch", "_i", F.when(F.col("became").isNull(), F.col("at")).otherwise(F.element_at("became", (F.col("at") + 1).cast("int"))).alias("_part"))
    back = parts.withColumnsRenamed({"batch": batch})
    return same_keys(placed, back, [batch, "_i"])
