"""Best-fit packing by bin completion: branch and bound over the histogram of lengths.

Pieces are at most ``capacity`` tokens long, so however many there are, their
lengths form a histogram of at most ``capacity`` counts. The driver packs that
histogram: around the largest length left it lists undominated completions
(no left-out length could replace a part of them and fit), best fit first,
uses a completion as often as the counts allow, and prunes branches whose
waste cannot beat the best packing so far. The best-fit descent is the first
incumbent. The plan is a list of patterns, each with its number of copies;
pieces then find their sequence from their rank among equal lengths.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.index import with_row_index
from ..session import stage
from .common import documents, drop_others, slices
from .tokens import crc, encoder, vocabulary_path

CAPACITY = 2048
NODES = 5_000  # branch-and-bound nodes after the first descent; the best packing found so far stands
WIDTH = 96  # completions tried per node


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: volume, and large lengths that cannot share (Martello and Toth's L2)."""
    size = np.arange(len(counts))
    volume = int((counts * size).sum())
    best = -(-volume // capacity)
    number, weight = np.cumsum(counts), np.cumsum(counts * size)
    for k in range(0, capacity // 2 + 1):
        alone = int(number[capacity] - number[capacity - k])
        half = capacity // 2
        medium = int(number[capacity - k] - number[half]) if capacity - k >= half else 0
        room = medium * capacity - (int(weight[capacity - k] - weight[half]) if medium else 0)
        low = int(weight[half] - (weight[k - 1] if k else 0))
        best = max(best, alone + medium + max(0, -(-(low - room) // capacity)))
    return best


def _fills(counts: list[int], lengths: list[int], room: int, waste: int, width: int) -> Iterator[tuple[int, ...]]:
    """Undominated sets of lengths that fit ``room`` and leave at most ``waste``, least waste first; one at least."""
    usable = lengths[:bisect_right(lengths, room)]
    if not usable:
        yield ()
        return
    if usable[-1] == room:  # one length fills the room and dominates every other set
        yield (room,)
        return
    found: set[tuple[int, ...]] = set()
    steps = 0

    def grow(chosen: tuple[int, ...], left: int, top: int) -> None:
        nonlocal steps
        steps += 1
        at = bisect_right(usable, min(left, top)) - 1
        taken = 0
        # at the root as many largest lengths as sets are wanted, below the two best fits
        while at >= 0 and taken < (width if not chosen else 2) and steps < 8 * width:
            x = usable[at]
            if counts[x] > chosen.count(x):
                grow((*chosen, x), left - x, x)
                taken += 1
            at -= 1
        if not taken:
            found.add(chosen)

    grow((), room, room)
    ranked = sorted(found, key=lambda c: (room - sum(c), len(c)))
    given = 0
    for chosen in ranked:
        if given and room - sum(chosen) > waste or given == width:
            break
        if not _dominated(chosen, counts, usable, room):
            given += 1
            yield chosen
    if not given:
        yield ranked[0]


def _dominated(chosen: tuple[int, ...], counts: list[int], usable: list[int], room: int) -> bool:
    """Whether a left-out length can take the place of some of the chosen, no longer than itself, and still fit."""
    slack = room - sum(chosen)
    sums = {0}
    for x in chosen[:8]:
        sums |= {s + x for s in sums}
    sums.discard(0)
    for s in sums:
        # a left-out length beyond s that fits dominates; one equal to s does if it replaces several
        at = bisect_left(usable, s if s not in chosen else s + 1)
        while at < len(usable) and usable[at] <= s + slack:
            if counts[usable[at]] > chosen.count(usable[at]):
                return True
            at += 1
    return False


def plan(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, copies) of the sequences of the best packing found; counts[l] pieces of length l."""
    given = np.asarray(counts, np.int64)
    volume, bound = int((given * np.arange(len(given))).sum()), lower_bound(given, capacity)
    counts = given.tolist()
    best: list[tuple[tuple[int, ...], int]] | None = None
    best_bins, spent = 1 << 62, 0
    live = [x for x in range(len(counts)) if counts[x]]  # lengths that are left, in order
    # a frame is a node of the tree: its open completions, and what its current one took
    frames: list[list] = []
    bins = wasted = 0

    def change(chosen: tuple[int, ...], copies: int) -> None:
        for x in chosen:
            had = counts[x]
            counts[x] += copies
            if not had:
                insort(live, x)
            elif not counts[x]:
                del live[bisect_left(live, x)]

    def fills(width: int) -> list[tuple[int, ...]]:
        top = live[-1]
        allowed = capacity if best is None else (best_bins - 1) * capacity - volume - wasted
        counts[top] -= 1
        left = live if counts[top] else live[:-1]
        found = [(top, *f) for f in islice(_fills(counts, left, capacity - top, allowed, WIDTH), width)]
        counts[top] += 1
        return found

    def opened() -> list | None:
        """Completions to try, the one in use, its copies, and whether further completions were left unlisted."""
        return [iter(fills(1 if best is None else WIDTH)), None, 0, best is None] if live else None

    frame = opened()
    while True:
        if frame is None:  # every piece is placed
            if bins < best_bins:
                best, best_bins = [(f[1], f[2]) for f in frames], bins
            if best_bins <= bound or not frames or spent >= nodes:
                break
        else:
            frames.append(frame)
        # undo what the node on top took, and take its next completion; close nodes that have none left
        advanced = False
        while frames:
            top = frames[-1]
            if top[1] is not None:
                change(top[1], top[2])
                bins -= top[2]
                wasted -= top[2] * (capacity - sum(top[1]))
                top[1] = None
            chosen = next(top[0], None)
            if chosen is None and top[3] and spent < nodes:
                top[0], top[3] = iter(fills(WIDTH)[1:]), False
                chosen = next(top[0], None)
            if chosen is not None and spent < nodes:
                spent += best is not None
                copies = min(counts[x] // chosen.count(x) for x in set(chosen))
                waste = copies * (capacity - sum(chosen))
                if best is not None and -(-(volume + wasted + waste) // capacity) >= best_bins:
                    continue
                change(chosen, -copies)
                bins, wasted, top[1], top[2] = bins + copies, wasted + waste, chosen, copies
                advanced = True
                break
            frames.pop()
        if not advanced:
            break
        frame = opened()
    return best or []


def _slots(patterns: list[tuple[tuple[int, ...], int]], counts: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of pieces, in (length, rank) order, that go to the same place of the same pattern."""
    used = np.zeros(len(counts), np.int64)
    start_of = np.cumsum(counts) - counts
    rows, sequence = [], 0
    for pattern, copies in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            many = pattern.count(length)
            rows.append((int(start_of[length] + used[length]), sequence, many, offset, length))
            used[length] += copies * many
            offset += many * length
        sequence += copies
    rows.sort()
    names = ("first", "sequence", "many", "offset", "length")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def cut_pieces(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document.

    A document is its ids and the end id; only one longer than ``capacity`` is
    cut, into pieces of ``capacity``, the remainder first. A null text is
    empty: one piece of length 1. Rows with equal or null doc_id are documents
    of their own.
    """
    vocabulary = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", owner="tokens"):
            ids, bounds = encoder(vocabulary).encode(batch.column(1))
            size = np.diff(bounds)
            many = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            head = size - (many - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            low = bounds[:-1][row] + start
            checks = [crc(ids[a:a + n]) for a, n in zip(low.tolist(), length.tolist())]
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(checks, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                # pieces of a document follow one another, so the ids of the batch are already in order
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns, names = [*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return documents(df).mapInArrow(cut, kind)


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """The pieces with sequence_id and offset, every sequence gapless from 0 and at most ``capacity`` long.

    ``pieces`` needs a length (1 to ``capacity``); order among equal lengths is
    by doc_id, piece and start where they exist. The rank of a piece among all
    comes from range partitions, so no length, however frequent, is one task.
    """
    pieces = stage(pieces, "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        if row["length"] is None or not 1 <= row["length"] <= capacity:
            raise ValueError(f"length {row['length']} is outside 1 to {capacity}")
        histogram[row["length"]] = row["count"]
    slots = _slots(plan(histogram, capacity, nodes), histogram)
    order = ["length", *[c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(at: pd.Series) -> pd.DataFrame:
        drop_others("packing")  # the ids are written by now
        x = at.to_numpy(np.int64)
        i = np.searchsorted(slots["first"], x, side="right") - 1
        nth, many = x - slots["first"][i], slots["many"][i]
        return pd.DataFrame({"sequence_id": slots["sequence"][i] + nth // many, "offset": slots["offset"][i] + nth % many * slots["length"][i]})

    ranked = with_row_index(pieces, order, "_rank")
    return ranked.withColumn("_p", place("_rank")).select(*pieces.columns, "_p.sequence_id", "_p.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from packed pieces that carry theirs; a sequence is bounded by the capacity."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
