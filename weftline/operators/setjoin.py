"""Exact set-similarity join: every two different sets whose Jaccard similarity reaches a threshold.

Elements have one order, the rarest first. Sets that reach the threshold share
an element among the first ``n - ceil(t * n) + 1`` of each (the prefix), their
sizes are within the threshold of each other, and what follows the first
shared element must still hold enough of both. So rare elements bring the
candidates, and elements that most sets have never pair anything. An element of
many prefixes is cut into blocks that meet block by block, so no task lists it
alone. Equal sets are one class: the join lists pairs of classes, and the
members of a class beside it.

Most elements are in one set only. They come first in the order, pair nothing
and are no part of an overlap, so they leave after they are counted: the sets of
a batch go to slices of the element space as sorted, packed numbers (some 7
bytes an element), and only elements of two sets or more come back.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let
from ..session import stage

BLOCK = 1024
TOKENS = 1 << 21  # elements that a task counts at once
PAIRS = 1 << 15  # pairs that a task verifies at once
COPIES = 1 << 19  # rows to leave out that tasks hold
_KINDS = (np.uint64, np.uint16, np.uint32)  # a packed element: its hash, the place of its set, in how many sets it is


def word_shingles(words: Column, n: int) -> Column:
    """Hashes of the distinct runs of ``n`` words; a shorter text is one run, an empty one has none."""
    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, F.array_distinct(made)).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    # the words are found once, not once per run
    return let(words, runs)


def classes(df: DataFrame, key: str, elements: Column, again: bool = False) -> tuple[DataFrame, DataFrame]:
    """(node, n, elements) of the distinct sets, named by their smallest key, and (key, node, n) of all rows with a set.

    Elements are 64-bit hashes; rows with an empty or null set have none. Sets
    are written once, and copies are left out where they lie. If ``df`` is a
    plain read of a table, only digests need be written and sets be hashed
    ``again`` (a set may be empty then).
    """
    hashes = F.sort_array(F.array_distinct(F.transform(elements, lambda e: F.xxhash64(e)))).alias("elements")
    digest = F.struct(F.xxhash64("elements").alias("a"), F.xxhash64(F.lit(1), "elements").alias("b")).alias("digest")
    hashed = df.select(F.col(key).alias("key"), hashes).select("key", digest, F.size("elements").alias("n"), "elements")
    # empty sets go after the write: a filter on the elements would hash them twice
    rows = (stage(hashed.drop("elements"), "digests") if again else stage(hashed, "sets")).filter("n > 0")
    names = stage(rows.groupBy("digest").agg(F.min("key").alias("node")), "names")
    members = rows.select("key", "digest", "n").join(names, "digest").select("key", "node", "n")
    # a key with two sets names one of them
    named = names.filter("node IS NOT NULL").groupBy(F.col("node").alias("key")).agg(F.min("digest").alias("digest"))
    copies = stage(rows.filter("key IS NOT NULL").select("key", "digest").join(named, ["key", "digest"], "left_anti"), "copies")
    n = copies.count()
    repeated = not rows.groupBy("key").count().filter("count > 1").isEmpty()
    if again and not repeated and n <= COPIES:
        kept = df.filter(F.col(key).isNotNull())
        if n:
            kept = kept.join(F.broadcast(copies.select(F.col("key").alias("_copy"))), F.col(key) == F.col("_copy"), "left_anti")
        sets = kept.select(F.col(key).alias("node"), hashes).select("node", F.size("elements").alias("n"), "elements")
        # a repeated task must find its rows in the same order
        return sets.sortWithinPartitions("node", "n"), members
    whole = (stage(hashed, "sets").filter("n > 0") if again else rows).filter("key IS NOT NULL")
    if n:
        whole = whole.join(F.broadcast(copies) if n <= COPIES else copies, ["key", "digest"], "left_anti")
    reps = whole.select(F.col("key").alias("node"), "n", "elements")
    if repeated:  # the same set twice under one key
        reps = reps.dropDuplicates(["node"])
    # rows that were moved may come in another order when a task is repeated
    return stage(reps, "sets") if repeated or n > COPIES else reps, members


def _packed(*columns: np.ndarray) -> bytes:
    """Columns byte by byte, compressed: the first is sorted and kept as differences, whose high bytes are zero."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes() for c in (first, *columns[1:])]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(table: pa.Table, kinds: tuple) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all packed rows, one after the other, and the number of entries of each row."""
    counts = table["count"].to_numpy()
    parts = [[np.empty(0, k)] for k in kinds]
    for n, packed in zip(counts.tolist(), table["packed"]):
        raw = pa.decompress(packed.as_buffer(), n * sum(np.dtype(k).itemsize for k in kinds), codec="zstd")
        at = 0
        for k, (kind, out) in enumerate(zip(kinds, parts)):
            size = np.dtype(kind).itemsize
            column = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()
            out.append(column if k else np.cumsum(column, dtype=kind))
            at += n * size
    return [np.concatenate(p) for p in parts], counts


def shared_elements(sets: DataFrame, total: int) -> DataFrame:
    """(node, n, elements, common) of the sets that share elements: the shared ones, the rarest first, the last ``common`` in over BLOCK sets.

    The sets of a batch are a block, whose names and sizes travel beside the
    packed elements of every slice of the element space. A slice counts its
    elements and returns those of two sets or more to their blocks.
    """
    spark, kind, block_size = sets.sparkSession, sets.schema["node"].dataType.simpleString(), BLOCK
    tokens = TOKENS
    n_slices = max(1, -(-total // tokens))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = f"block bigint, nodes array<{kind}>, sizes array<int>, count bigint, packed binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        starts = np.array([-(-(k << 64) // n_slices) for k in range(n_slices)], np.uint64)
        blocks = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.greater(batch.column("n"), 0), False))
            ends = np.cumsum(batch.column("n").to_numpy().astype(np.int64))
            marks = np.flatnonzero(np.diff(ends // tokens)) + 1
            cuts = np.unique(np.concatenate([marks, np.arange(0, batch.num_rows, 1 << 16), [batch.num_rows]]))
            for start, end in itertools.pairwise(cuts.tolist()):
                part, block = batch.slice(start, end - start), next(blocks)
                sizes = part.column("n").to_numpy()
                hashes = part.column("elements").flatten().to_numpy().view(np.uint64)
                order = np.argsort(hashes)
                hashes, place = hashes[order], np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[order]
                bounds = [*np.searchsorted(hashes, starts).tolist(), len(hashes)]
                held = [(k, a, b) for k, (a, b) in enumerate(itertools.pairwise(bounds)) if a < b]
                none = [None] * len(held)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block % n_slices, *(k for k, _, _ in held)], pa.int32()), pa.array([block] * (len(held) + 1), pa.int64()),
                    pa.array([part.column("node").to_pylist(), *none], pa.list_(part.schema.field("node").type)), pa.array([sizes, *none], pa.list_(pa.int32())),
                    pa.array([0, *(b - a for _, a, b in held)], pa.int64()),
                    pa.array([b"", *(_packed(hashes[a:b], place[a:b]) for _, a, b in held)], pa.binary())],
                    ["slice", "block", "nodes", "sizes", "count", "packed"])

    def count(table: pa.Table) -> pa.Table:
        heads = table.filter(table["nodes"].is_valid())
        table = table.filter(table["nodes"].is_null())
        (hashes, place), counts = _unpacked(table, _KINDS[:2])
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        runs = np.diff(np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1], [True]]))) if len(hashes) else np.empty(0, np.int64)
        seen = np.repeat(runs, runs)
        kept = np.flatnonzero(seen > 1)
        source = np.repeat(np.arange(len(counts)), counts)[order[kept]]
        # back to the rows they came in, where they stay sorted
        kept = kept[np.argsort(source, kind="stable")]
        n = np.bincount(source, minlength=len(counts))
        ends = np.cumsum(n)
        hashes, place, seen = hashes[kept], place[order[kept]], seen[kept].astype(np.uint32)
        held = np.flatnonzero(n).tolist()
        made = pa.table({
            "block": table["block"].take(pa.array(held, pa.int64())), "nodes": pa.nulls(len(held), table.schema.field("nodes").type), "sizes": pa.nulls(len(held), table.schema.field("sizes").type),
            "count": pa.array(n[held], pa.int64()),
            "packed": pa.array([_packed(hashes[ends[k] - n[k]:ends[k]], place[ends[k] - n[k]:ends[k]], seen[ends[k] - n[k]:ends[k]]) for k in held], pa.binary())})
        return pa.concat_tables([heads.select(made.column_names), made])

    def order(table: pa.Table) -> pa.Table:
        head = table.filter(table["nodes"].is_valid())
        (hashes, place, seen), _ = _unpacked(table.filter(table["nodes"].is_null()), _KINDS)
        nodes, sizes = pc.list_flatten(head["nodes"]), pc.list_flatten(head["sizes"])
        by = np.lexsort((hashes, seen, place))
        n = np.bincount(place, minlength=len(nodes))
        common = np.bincount(place[seen > block_size], minlength=len(nodes))
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(hashes[by].view(np.int64)))
        made = pa.table({"node": nodes, "n": sizes, "elements": lists, "common": pa.array(common, pa.int32())})
        return made.filter(pa.array(n > 0))

    dealt = sets.select("node", "n", "elements").mapInArrow(deal, f"slice int, {row}")
    parts = max(least, n_slices)
    counted = dealt.repartition(parts, "slice").groupBy("slice").applyInArrow(count, row)
    return counted.repartition(parts, "block").groupBy("block").applyInArrow(order, f"node {kind}, n int, elements array<bigint>, common int")


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """Distinct (left, right) that pass the prefix, size and position bounds; left has fewer elements, or the smaller name."""
    lone = F.col("n") - F.size("elements")
    least = F.ceil(F.col("n") * F.lit(threshold) - 1e-9)
    # places are those in the whole set, lone elements included
    head = F.slice("elements", F.lit(1), F.greatest(F.col("n") - least + 1 - lone, F.lit(0)).cast("int"))
    listed = F.transform(head, lambda e, i: F.struct(e.alias("token"), F.get("elements", i - 1).alias("prev")))
    placed = sets.select("node", "n", lone.alias("lone"), (F.size("elements") - F.col("common")).alias("few"), F.posexplode(listed).alias("i", "t"))
    prefix = placed.select("node", "n", (F.col("lone") + F.col("i")).alias("at"), "t.token", "t.prev", (F.col("i") >= F.col("few")).alias("common"))
    rare, common = prefix.filter("NOT common").drop("common"), prefix.filter("common").drop("common")
    sized = common.groupBy("token").agg(F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}").alias("blocks"), F.count("*").alias("m")).filter("m > 1").drop("m")
    marked = common.join(sized, "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))

    def side(df: DataFrame, mark: str, *more) -> DataFrame:
        return df.select("token", F.col("node").alias(mark), F.col("n").alias(f"n{mark}"), F.col("at").alias(f"i{mark}"), F.col("prev").alias(f"p{mark}"), *more)

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        need = F.ceil((F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - 1e-9)
        rest = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
        # of a run that both have, the first element pairs them
        first = F.col("pa").isNull() | F.col("pb").isNull() | (F.col("pa") != F.col("pb"))
        return left.join(right, on).filter(
            ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= F.col("nb") * F.lit(threshold) - 1e-9) & (rest >= need) & first).select("a", "b")

    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    blocked = met(side(marked, "a", F.col("own").alias("block")), side(marked, "b", every), ["token", "block"])
    return met(side(rare, "a"), side(rare, "b"), ["token"]).unionAll(blocked).select(F.col("a").alias("left"), F.col("b").alias("right")).distinct()


def bundled(pairs: DataFrame, n: int, elements: int) -> DataFrame:
    """``pairs`` with the bundle (slot, i, j) that verifies them: pairs of one neighbourhood, so that a set goes to few bundles.

    The pairs whose right sets have the same smallest neighbour share a slot with
    others, or are cut into squares where they are many.
    """
    slots = 1 + n // PAIRS + elements // TOKENS
    both = pairs.unionByName(pairs.select(F.col("right").alias("left"), F.col("left").alias("right")))
    labels = both.groupBy("right").agg(F.least(F.min("left"), F.col("right")).alias("label"))
    marked = stage(pairs.join(labels, "right"), "marked")
    large = marked.groupBy("label").agg(F.ceil(F.sqrt(F.count("*") / PAIRS)).cast("int").alias("k")).filter("k > 1")
    place = F.xxhash64("label")
    # one row for PAIRS pairs at most
    cut = marked.join(F.broadcast(large), "label", "left")
    whole = F.col("k").isNull()
    return cut.select(
        F.when(whole, F.pmod(place, F.lit(slots))).otherwise(place).alias("slot"),
        *[F.when(whole, -1).otherwise(F.pmod(F.xxhash64(side), F.col("k"))).cast("int").alias(x) for x, side in (("i", "left"), ("j", "right"))], "left", "right")


def overlaps(pairs: DataFrame, held: DataFrame, elements: int) -> DataFrame:
    """(left, right, sim) of bundled pairs; a set goes once to every bundle that has pairs of it."""
    bundle, kind = ["slot", "i", "j"], held.schema["node"].dataType.simpleString()
    to = [f"to_{c}" for c in bundle]
    wanted = pairs.select(*[F.col(c).alias(x) for c, x in zip(bundle, to)], F.explode(F.array("left", "right")).alias("node")).distinct()
    sent = wanted.join(held.select("node", "n", "elements"), "node")

    def meet(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        sets = sets.combine_chunks()
        left, right = (pc.index_in(pairs[side], sets["node"]).to_numpy() for side in ("left", "right"))
        sizes = sets["n"].to_numpy()
        tokens = np.unique(pc.list_flatten(sets["elements"]).to_numpy(), return_inverse=True)[1]
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(sets["elements"]).to_numpy())])
        mark = np.zeros(len(tokens) + 1, bool)
        by = np.argsort(right, kind="stable")
        shared = np.empty(len(by), np.int64)
        for run in np.split(by, np.flatnonzero(np.diff(right[by])) + 1):
            own = tokens[ends[right[run[0]]]:ends[right[run[0]] + 1]]
            mark[own] = True
            for k in run.tolist():
                shared[k] = np.count_nonzero(mark[tokens[ends[left[k]]:ends[left[k] + 1]]])
            mark[own] = False
        return pa.table({"left": pairs["left"], "right": pairs["right"], "sim": shared / (sizes[left] + sizes[right] - shared)})

    # as many partitions as keep the sets of one small enough to be sorted in memory
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + elements // TOKENS)
    return pairs.repartition(parts, *bundle).groupBy(*bundle).cogroup(sent.repartition(parts, *to).groupBy(*to)).applyInArrow(meet, f"left {kind}, right {kind}, sim double")


def similarity_join(df: DataFrame, key: str, elements: Column, threshold: float, again: bool = False) -> tuple[DataFrame, DataFrame]:
    """(left, right, sim) of all pairs of classes with similarity of at least ``threshold``, left < right, and (key, node) of their members.

    ``again``: ``df`` is a plain read of a table, whose sets are hashed twice rather than written.
    """
    sets, members = classes(df, key, elements, again)
    held = stage(shared_elements(sets, members.agg(F.sum("n")).first()[0] or 0), "classes")
    pairs = stage(candidates(held, threshold), "pairs")
    # an overlap consists of shared elements
    elements = held.agg(F.sum(F.size("elements"))).first()[0] or 0
    near = overlaps(bundled(pairs, pairs.count(), elements), held, elements).filter(F.col("sim") >= F.lit(threshold) - 1e-12)
    return near.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "sim"), members.drop("n")
