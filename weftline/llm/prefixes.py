"""Prefix trie of conversations from their sorted order: member intervals by range minima, without a stack.

Conversations are sorted by their turns (16-byte digests of role and text), so
the members of every prefix are neighbours. With ``lcp`` the turns a row
shares with the row before it, a prefix of d turns of row i begins at the last
row at or before i, and ends before the first row after i, whose lcp is below
d. Both extents are found independently of each other by binary descent over
a sparse table of minima.

Rows are cut into blocks of about the root of their number. A block has a
sparse table of its own, and one over the minima of all blocks names the block
where an extent ends that leaves it; only the distinct depths of such extents
travel there and back. So no interval is gathered, whatever its size, and a
first turn that all conversations share costs one question per block.

Candidates are the whole sequence of each row and what it shares with the row
before: at most two per conversation. The prefixes between a candidate and its
parent have the same members and are spelled out last. Sums over a subtree are
differences of running sums at the two extents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.index import with_group_totals, with_row_index
from ..session import stage

BLOCK_TURNS = 4096  # turns of one sort key; conversations that share them all are sorted on by the next ones
LEAST = 256  # rows of a block at least
WORD = r"[^\x20\x09-\x0D]+"


# ---- conversations as turn rows -------------------------------------------------------------------------------------


def ordered_turns(df: DataFrame) -> DataFrame:
    """conv, idx (from 0), th (digest of role and text), words, before (words of earlier turns) of every turn.

    Turns are ordered by turn (null first); equal ones by role and text. Null
    roles and texts are empty. Rows without a conv_id belong to no
    conversation and are left out; repeated rows are turns of their own.
    """
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    plain = df.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    marked = plain.select("*", digest.alias("th"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"))
    summed = with_group_totals(marked, ["conv"], [F.col("turn").asc_nulls_first(), "role", "text"], {"idx": F.lit(1), "before": F.col("words")})
    return stage(summed.select("conv", "idx", "th", "words", "before"), "turns")


def rebuild(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of their base: (conv, depth, th, upto) and (conv, len).

    The base of c is c - c % every, h = crc32 of the decimal c % most; c's own
    turns after its first h follow. ``upto`` counts the words through a turn.
    """
    # at most ``most`` - 1 turns of a conversation are listed
    head = F.when(F.col("idx") < most - 1, F.struct("idx", "th", "words"))
    convs = stage(turns.groupBy("conv").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(head)).alias("heads")), "convs")
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")

    def words(of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("bigint"), lambda a, t: a + t["words"])

    bases = convs.filter(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.col("heads").alias("given"))
    joined = convs.withColumn("base", F.col("conv") - F.col("conv") % every).join(bases, "base", "left")
    none = F.slice("heads", 1, 0)
    shaped = stage(joined.select("conv", "n", h.alias("h"), F.slice(F.coalesce("given", none), F.lit(1), h).alias("given"), words(F.slice("heads", F.lit(1), h)).alias("skipped")), "rebuilt")
    k = F.size("given")
    given = shaped.select("conv", "given", F.posexplode("given").alias("i", "t")).select(
        "conv", (F.col("i") + 1).cast("bigint").alias("depth"), "t.th", words(F.slice("given", F.lit(1), F.col("i") + 1)).alias("upto"))
    shift = shaped.select("conv", (k - F.col("h")).cast("bigint").alias("shift"), (words(F.col("given")) - F.col("skipped")).alias("more"))
    own = turns.filter(F.col("idx") >= h).join(shift, "conv").select(
        "conv", (F.col("idx") + F.col("shift") + 1).alias("depth"), "th", (F.col("before") + F.col("words") + F.col("more")).alias("upto"))
    lengths = shaped.select("conv", (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("bigint").alias("len"))
    return stage(given.unionByName(own), "turns"), lengths


# ---- sorted rows and what they share --------------------------------------------------------------------------------


def with_previous(df: DataFrame, at: str, size: int, **names: str) -> DataFrame:
    """Values of the row before in ``at`` (positions without gaps); blocks of ``size`` rows see a copy of the row before them."""
    block = F.expr(f"`{at}` div {size}")
    copies = F.when((F.col(at) + 1) % size == 0, F.array(block, block + 1)).otherwise(F.array(block))
    row = Window.partitionBy("block").orderBy(at)
    seen = df.withColumn("block", F.explode(copies)).select("*", *[F.lag(c).over(row).alias(n) for n, c in names.items()])
    return seen.filter(F.col("block") == block)


def shared(a: Column, b: Column) -> Column:
    """Number of first elements two arrays share."""
    m = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, F.lit(1), m), F.slice(b, F.lit(1), m), lambda x, y: x == y), F.lit(False))
    return F.when(differs == 0, m).otherwise(differs - 1).cast("bigint")


def sort_rows(turns: DataFrame, lengths: DataFrame, block_turns: int = BLOCK_TURNS) -> tuple[DataFrame, int, int]:
    """(pos, block, conv, len, lcp, ends) of the sorted conversations, their number, and the rows of a block.

    ``ends`` is 1 where no member of the row before goes on: a leaf ends there.
    One round sorts by ``block_turns`` turns; only conversations that share all
    of them with another are sorted on by the next, so a sort key is bounded.
    """
    count = lengths.count()
    size = max(LEAST, math.isqrt(count))
    waiting = lengths.select("conv", "len", F.lit(0).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("edge"))
    parts, done = [], 0
    while True:
        within = turns.filter((F.col("depth") > done) & (F.col("depth") <= done + block_turns))
        if done:
            within = within.join(waiting.select("conv"), "conv", "left_semi")
        keys = within.groupBy("conv").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "th"))), lambda x: x["th"]).alias("key"))
        keyed = waiting.join(keys, "conv", "left").withColumn("key", F.coalesce("key", F.array().cast("array<binary>")))
        placed = with_previous(with_row_index(keyed, ["start", "key", "conv"], "idx"), "idx", size, _key="key", _start="start")
        lcp = F.when(F.col("_start").eqNullSafe(F.col("start")), done + shared(F.col("key"), F.col("_key"))).otherwise(F.col("edge"))
        cls = F.when(F.size("key") == block_turns, F.md5(F.concat(*[F.array_join(F.transform("key", F.hex), "")])))
        marked = placed.select("idx", "conv", "len", "start", lcp.alias("lcp"), cls.alias("cls"))
        if done:
            first = marked.groupBy("start").agg(F.min("idx").alias("_first"))
            marked = marked.join(first, "start").withColumn("pos", F.col("start") + F.col("idx") - F.col("_first")).drop("_first")
        else:
            marked = marked.withColumn("pos", F.col("idx"))
        marked = stage(marked.drop("idx"), "sorted")
        alike = marked.filter("cls is not null").groupBy("start", "cls").agg(
            F.count("*").alias("n"), F.max("len").alias("longest"), F.min("pos").alias("start2"), F.min_by("lcp", "pos").alias("edge2"))
        alike = stage(alike.filter((F.col("n") > 1) & (F.col("longest") > done + block_turns)).drop("n", "longest"), "alike")
        if alike.isEmpty():
            parts.append(marked)
            break
        parts.append(marked.join(alike.select("start", "cls"), ["start", "cls"], "left_anti").select(marked.columns))
        waiting = stage(marked.join(alike, ["start", "cls"]).select("conv", "len", F.col("start2").alias("start"), F.col("edge2").alias("edge")), "waiting")
        done += block_turns
    rows = parts[0].select("pos", "conv", "len", "lcp")
    for part in parts[1:]:
        rows = rows.unionByName(part.select("pos", "conv", "len", "lcp"))
    ends = F.when(F.col("_len").isNotNull() & (F.col("lcp") < F.col("_len")), 1).otherwise(0).cast("bigint")
    return with_previous(rows, "pos", size, _len="len").select("pos", "block", "conv", "len", "lcp", ends.alias("ends")), count, size


# ---- extents by range minima ----------------------------------------------------------------------------------------


class Minima:
    """Sparse table of range minima over ``values``."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [np.asarray(values, np.int64)]
        while (1 << len(self.levels)) <= self.n:
            half, below = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def next_below(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """First place at or after ``at`` whose value is below ``d``; n where there is none."""
        j = np.array(at, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = j + (1 << k) <= self.n
            clear = fits & (self.levels[k][np.where(fits, j, 0)] >= d)
            j += clear.astype(np.int64) << k
        return j

    def last_below(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Last place at or before ``at`` whose value is below ``d``; -1 where there is none."""
        j = np.array(at, np.int64) + 1
        for k in range(len(self.levels) - 1, -1, -1):
            fits = j - (1 << k) >= 0
            clear = fits & (self.levels[k][np.where(fits, j - (1 << k), 0)] >= d)
            j -= clear.astype(np.int64) << k
        return j - 1

    def lowest(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Minimum over ``start`` (inclusive) to ``stop`` (exclusive); the largest integer where that is empty."""
        size = np.maximum(np.asarray(stop) - start, 0)
        out = np.full(len(size), np.iinfo(np.int64).max)
        some = size > 0
        level = np.zeros(len(size), np.int64)
        level[some] = np.floor(np.log2(size[some])).astype(np.int64)
        for k in np.unique(level[some]).tolist():
            at = some & (level == k)
            out[at] = np.minimum(self.levels[k][np.asarray(start)[at]], self.levels[k][np.asarray(stop)[at] - (1 << k)])
        return out


class Blocks:
    """One row per block: minima of lcp and conv, and the running sums before each block."""

    def __init__(self, told: pd.DataFrame, size: int):
        told = told.sort_values("block")
        self.size, self.rows = size, int(told["n"].sum())
        self.lcp, self.conv = Minima(told["lcp"].to_numpy(np.int64)), Minima(told["conv"].to_numpy(np.int64))
        self.saved, self.ended = [np.concatenate([[0], np.cumsum(told[c].to_numpy(np.int64))]) for c in ("s", "ends")]


class Block:
    """The rows of one block with their sparse tables and running sums."""

    def __init__(self, rows: pd.DataFrame, blocks: Blocks):
        rows = rows.sort_values("pos")
        self.pos, self.conv, self.len, self.lcp = [rows[c].to_numpy(np.int64) for c in ("pos", "conv", "len", "lcp")]
        self.n, self.number, self.start, self.all = len(rows), int(rows["block"].iloc[0]), int(self.pos[0]), blocks
        self.low, self.lowest = Minima(self.lcp), Minima(self.conv)
        # saved[j]: sums of rows before j; ended[j]: through row j
        self.saved = blocks.saved[self.number] + np.concatenate([[0], np.cumsum(rows["s"].to_numpy(np.int64))])
        self.ended = blocks.ended[self.number] + np.cumsum(rows["ends"].to_numpy(np.int64))
        self.at = np.concatenate([np.flatnonzero(self.lcp > 0), np.flatnonzero(self.len > 0)])
        self.whole = np.arange(len(self.at)) >= int((self.lcp > 0).sum())
        self.d = np.where(self.whole, self.len[self.at], self.lcp[self.at])

    def extents(self) -> tuple[np.ndarray, np.ndarray]:
        return self.low.last_below(self.at, self.d), self.low.next_below(self.at + 1, self.d)

    def left(self, at: np.ndarray) -> dict[str, np.ndarray]:
        """What an interval that begins at local row ``at`` needs from there to the block's end."""
        return {"at": self.start + at, "lcp": self.lcp[at], "saved": self.saved[at + 1], "ended": self.ended[at], "conv": self.lowest.lowest(at, np.full(len(at), self.n))}

    def right(self, at: np.ndarray) -> dict[str, np.ndarray]:
        """What an interval that ends before local row ``at`` needs from the block's start to there."""
        return {"at": self.start + at, "lcp": self.lcp[at], "saved": self.saved[at], "ended": self.ended[at], "conv": self.lowest.lowest(np.zeros(len(at), np.int64), at)}


ASKED = "target bigint, block bigint, side int, d bigint"
TOLD = "block bigint, side int, d bigint, target bigint, at bigint, lcp bigint, saved bigint, ended bigint, conv bigint"
FOUND = ("row bigint, whole boolean, first bigint, d bigint, stop bigint, low bigint, saved bigint, leaves bigint, above bigint, below bigint, "
         "block bigint, ids string")


def _ask(blocks: Blocks):
    """Distinct extents that leave a block, with the block where they end."""

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows, blocks)
        first, stop = block.extents()
        lefts = np.unique(block.d[first < 0])
        rights = np.unique(block.d[stop == block.n])
        to_left = blocks.lcp.last_below(np.full(len(lefts), block.number - 1), lefts)
        to_right = blocks.lcp.next_below(np.full(len(rights), block.number + 1), rights)
        inside = to_right < blocks.lcp.n
        d = np.concatenate([lefts, rights[inside]])
        side = np.repeat([0, 1], [len(lefts), int(inside.sum())])
        return pd.DataFrame({"target": np.concatenate([to_left, to_right[inside]]), "block": block.number, "side": side.astype(np.int32), "d": d})

    return ask


def _tell(blocks: Blocks):
    def tell(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asked.empty:
            return pd.DataFrame({c.split()[0]: [] for c in TOLD.split(", ")})
        block, out = Block(rows, blocks), []
        for side, group in asked.groupby("side"):
            d = group["d"].to_numpy(np.int64)
            at = block.low.next_below(np.zeros(len(d), np.int64), d) if side else block.low.last_below(np.full(len(d), block.n - 1), d)
            got = block.right(at) if side else block.left(at)
            out.append(pd.DataFrame({"block": group["block"].to_numpy(), "side": np.int32(side), "d": d, "target": group["target"].to_numpy(), **got}))
        return pd.concat(out)

    return tell


def _find(blocks: Blocks):
    def find(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows, blocks)
        first, stop = block.extents()
        sides = []
        for side, local, inside in ((0, first, first >= 0), (1, stop, stop < block.n)):
            mine = block.right(np.where(inside, local, 0)) if side else block.left(np.where(inside, local, 0))
            answers = told[told["side"] == side].sort_values("d")
            asked = answers["d"].to_numpy(np.int64)
            if side:  # no row below: the interval ends with the table
                end = {"at": blocks.rows, "lcp": -1, "saved": blocks.saved[-1], "ended": blocks.ended[-1] + 1, "conv": np.iinfo(np.int64).max, "target": blocks.lcp.n}
            place = np.searchsorted(asked, block.d)
            known = ~inside & (place < len(asked))
            known[known] = asked[place[known]] == block.d[known]
            merged = {}
            for c in ("at", "lcp", "saved", "ended", "conv", "target"):
                here = mine[c] if c in mine else np.full(len(block.d), block.number)
                value = np.array(here, np.int64)
                value[known] = answers[c].to_numpy(np.int64)[place[known]]
                if side:
                    value[~inside & ~known] = end[c]
                merged[c] = value
            sides.append((inside, merged))
        (in_left, left), (in_right, right) = sides
        both = in_left & in_right
        # minimum of the members: in this block, in the whole blocks between, and in those where the interval begins and ends
        here = block.lowest.lowest(np.where(in_left, first, 0), np.where(in_right, stop, block.n))
        low = np.where(both, here, np.minimum(here, np.minimum(np.where(in_left, here, left["conv"]), np.where(in_right, here, right["conv"]))))
        number = np.full(len(block.d), block.number)
        between = np.minimum(blocks.conv.lowest(np.where(in_left, number, left["target"] + 1), number), blocks.conv.lowest(number + 1, np.where(in_right, number, right["target"])))
        low = np.minimum(low, between)
        found = pd.DataFrame({
            "row": block.pos[block.at], "whole": block.whole, "first": left["at"], "d": block.d, "stop": right["at"], "low": low,
            "saved": right["saved"] - left["saved"], "leaves": right["ended"] - left["ended"], "above": left["lcp"], "below": right["lcp"], "block": block.number, "ids": None})
        # members whose last turn is here: runs of equal rows, as far as this block holds them
        begins = np.concatenate([[True], (block.lcp[1:] < block.len[1:]) | (block.len[1:] != block.len[:-1])])
        heads = np.flatnonzero(begins)
        ids = [",".join(map(str, run.tolist())) for run in np.split(block.conv, heads[1:])]
        spelled = pd.Series(None, index=range(block.n), dtype=object)
        spelled.iloc[heads] = ids
        found["ids"] = np.where(block.whole, spelled.to_numpy()[block.at], None)
        turnless = heads[block.len[heads] == 0]
        empty = pd.DataFrame({"row": block.pos[turnless], "whole": True, "first": 0, "d": 0, "stop": 0, "low": 0, "saved": 0, "leaves": 0, "above": 0, "below": 0,
                              "block": block.number, "ids": spelled.to_numpy()[turnless]})
        kept = found[~block.whole | begins[block.at]]
        return pd.concat([kept, empty]) if len(empty) else kept

    return find


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which come sorted; one piece is held at a time."""
    key, state, out = None, None, []
    for batch in batches:
        for first, d, ids in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if (first, d) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (first, d), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _hashes(out)
        out = []
    if key is not None:
        yield _hashes([(*key, state.hexdigest())])


def _hashes(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["first", "d", "sha"])


NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def trie(turns: DataFrame, lengths: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per distinct prefix of the conversations (conv, depth, th, upto), (conv, len).

    conv_id is the smallest member, n_convs the members, n_children and
    n_leaves the nodes below, saved_tokens the words that sharing the turns at
    and below the node saves, ends_sha256 the hash of the members that end
    there. Conversations without turns are members of the root alone. Without
    conversations there is no node.
    """
    spark = turns.sparkSession
    rows, count, size = sort_rows(turns, lengths, block_turns)
    if not count:
        return spark.createDataFrame([], NODES)
    words = turns.select(F.col("conv").alias("_c"), F.col("depth").alias("_d"), "upto")
    rows = rows.join(words, (F.col("conv") == F.col("_c")) & (F.col("lcp") == F.col("_d")), "left")
    rows = stage(rows.select("pos", "block", "conv", "len", "lcp", "ends", F.coalesce("upto", F.lit(0)).alias("s")), "rows")
    # one row per block, about the root of the number of conversations
    summary = rows.groupBy("block").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("lcp", "conv")], *[F.sum(c).alias(c) for c in ("s", "ends")])
    blocks = Blocks(summary.toPandas(), size)
    held = rows.groupBy("block")
    asked = stage(held.applyInPandas(_ask(blocks), ASKED), "asked")
    told = stage(asked.groupBy("target").cogroup(held).applyInPandas(_tell(blocks), TOLD), "told")
    found = stage(held.cogroup(told.groupBy("block")).applyInPandas(_find(blocks), FOUND), "found")

    values = ["stop", "low", "saved", "leaves", "above", "below"]
    nodes = found.filter("d > 0").groupBy("first", "d").agg(*[F.max(c).alias(c) for c in values])
    lowest = int(blocks.conv.lowest(np.array([0]), np.array([blocks.conv.n]))[0])
    up, parent_row = F.greatest("above", "below", F.lit(0)), F.when(F.col("above") >= F.col("below"), F.col("first")).otherwise(F.col("stop"))
    inner = found.filter("not whole").select(F.col("row").alias("_row"), F.col("first").alias("p_first"), F.col("low").alias("p_low"))
    nodes = nodes.withColumn("up", up).withColumn("_at", F.when(up > 0, parent_row)).join(inner, F.col("_at") == F.col("_row"), "left").drop("_at", "_row", "above", "below")
    nodes = stage(nodes.withColumn("p_first", F.coalesce("p_first", F.lit(0))).withColumn("p_low", F.coalesce("p_low", F.lit(lowest))), "nodes")
    root = spark.createDataFrame(
        [(0, 0, count, lowest, int(blocks.saved[-1]), int(blocks.ended[-1]) + 1, -1, None, None)],
        "first bigint, d bigint, stop bigint, low bigint, saved bigint, leaves bigint, up bigint, p_first bigint, p_low bigint")
    children = nodes.groupBy(F.col("p_first").alias("first"), F.col("up").alias("d")).agg(F.count("*").alias("children"))
    pieces = found.filter("ids is not null").select("first", "d", "block", "ids")
    counted = stage(pieces.groupBy("first", "d").agg(F.count("*").alias("n"), F.max("ids").alias("ids")), "ending")
    long = pieces.join(counted.filter("n > 1").select("first", "d"), ["first", "d"])
    streamed = long.repartition("first", "d").sortWithinPartitions("first", "d", "block").select("first", "d", "ids").mapInArrow(_hash_pieces, "first bigint, d bigint, sha string")
    ended = counted.filter("n = 1").select("first", "d", F.sha2("ids", 256).alias("sha")).unionByName(streamed)

    whole = nodes.unionByName(root).join(children, ["first", "d"], "left").join(ended, ["first", "d"], "left")
    spelled = whole.withColumn("n", F.col("stop") - F.col("first")).withColumn("depth", F.explode(F.sequence(F.col("up") + 1, F.col("d"))))
    before = words.select(F.col("_c"), (F.col("_d") + 1).alias("_d"), "upto")
    spelled = spelled.join(before, (F.when(F.col("n") > 1, F.col("low")) == F.col("_c")) & (F.col("depth") == F.col("_d")), "left")
    last, top = F.col("depth") == F.col("d"), F.col("depth") == F.col("up") + 1
    return spelled.select(
        F.col("low").alias("conv_id"), "depth", F.when(top, F.col("p_low")).otherwise(F.col("low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.coalesce("children", F.lit(0))).otherwise(1).cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.when(F.col("n") > 1, F.col("saved") - (F.col("n") - 1) * F.coalesce("upto", F.lit(0))).otherwise(0).cast("bigint").alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("sha")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(df: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The trie of the rebuilt conversations of a turn table (conv_id, turn, role, text; further columns are ignored)."""
    turns, lengths = rebuild(ordered_turns(df), every, most)
    return trie(turns, lengths)
