"""Exact n-gram Jaccard join: blocked sparse products of documents by their n-grams.

A document's row of the incidence matrix is the sorted set of its shingle
hashes (64 bits). Equal rows are one class, so copies are compared once.
A pair can reach the similarity only if

* the sizes allow it: ``least * larger <= 100 * smaller``, and
* the rows share a column among the first ``p = size - ceil(least/100 * size) + 1``
  of each, in one order of all columns, and k more columns among the first
  ``p + k``. Any order will do; here it is that of the hashes, with the columns
  of many classes (shared passages, common phrases) at its end.

Column by column, the classes that share it are candidates; pairs that share
too few of the columns looked at for their sizes are dropped. Columns of many
classes are not listed in pairs: each has one hub, and the others meet it in
blocks. A block is the product of the block's rows with the hub's: the shared
entries are summed up per row, and rows whose sum stays below the bound of both
sizes are dropped. Classes that are linked by then need no further comparison
inside their component. Hubs change from round to round; when a round no
longer halves the number of open pairs, the classes of the columns left are
sorted by component and meet block by block, in products of two blocks of rows,
but for blocks of one and the same component. So every link between components
is found, and a group of thousands of near copies is compared with its few
outsiders, not with itself.

Sets are made from the texts when they are needed, for the classes that need
them, rather than kept: they are larger than the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.dedup import connected_groups
from ..operators.index import with_group_index
from ..session import stage
from .common import U64, documents, mix, ragged, release, slices, small, text_key
from .words import Words

ROWS = 256  # rows of a block that meet one hub
HOT = 32  # classes with a column among their first ones, beyond which the column goes to the end of the order
HOT_COLUMNS = 1 << 18  # such columns at most; with more of them HOT doubles
LISTED = 1.4  # columns listed per class, as a multiple of those looked at: some of them may go to the end of the order
FEW = 16  # classes of a column that meet in pairs
ROUNDS = 6
SETS = "doc_id bigint, h bigint, n bigint, a bigint, b bigint, grams array<bigint>"


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after another, and their bounds."""
    from xxhash import xxh64_intdigest

    found = Words(pc.ascii_lower(texts))
    hashed = np.fromiter((xxh64_intdigest(w, 0) for w in found.unique.cast(pa.large_binary()).to_pylist()), U64, len(found.unique))
    codes, counts = hashed[found.codes], found.counts
    starts = np.cumsum(counts) - counts
    many = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    rows = np.repeat(np.arange(len(counts)), many)
    at = ragged(starts, many)
    size = np.minimum(counts, words)[rows]
    grams = mix(size.astype(U64), 5)
    with np.errstate(over="ignore"):
        for k in range(words):
            inside = k < size
            grams[inside] = mix(grams[inside] * U64(0x9E3779B97F4A7C15) + codes[at[inside] + k], k)
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    rows, grams = rows[fresh], grams[fresh]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(counts)))]).astype(np.int64)


def required(n: np.ndarray, least: int) -> np.ndarray:
    """Entries a row of n shares with any partner: ceil(least * n / 100)."""
    return (least * n + 99) // 100


def looked_at(n: np.ndarray, least: int) -> np.ndarray:
    """First columns of a row of n that are looked at: a quarter more than the n - required + 1 by which a partner must be found."""
    return np.where(n > 0, np.minimum((5 * (n - required(n, least) + 1) + 3) // 4, n), 0)


def looked_at_sql(n: str, least: int) -> str:
    return f"least((5 * ({n} - ({least} * {n} + 99) div 100 + 1) + 3) div 4, {n})"


def in_common_sql(n: str, least: int) -> str:
    """Columns at least that two linked rows of n or more entries share among those looked at."""
    return f"({looked_at_sql(n, least)}) - ({n} - ({least} * {n} + 99) div 100)"


def incidence(df: DataFrame, words: int, seed: int = 0, least: int | None = None, late: np.ndarray | None = None) -> DataFrame:
    """doc_id, h (text hash), n (set size), a and b (two 64-bit digests of the set), grams of every row.

    grams is the sorted set or, with ``least``, the first LISTED of its
    columns by which a partner can be found, given once per run of texts that
    holds copies; with ``late`` exactly those it needs, in the order in which
    columns of ``late`` come last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 3 << 20):
            grams, bounds = shingle_sets(batch.column(1), words)
            n = np.diff(bounds)
            with np.errstate(over="ignore"):
                sums = [np.concatenate([[U64(0)], np.cumsum(mix(grams, 2 * seed + k), dtype=U64)]) for k in (101, 102)]
                a, b = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
            if least is not None:
                many = looked_at(n, least)
                if late is None:
                    many = np.minimum(np.ceil(LISTED * many).astype(np.int64), n)
                    first = np.zeros(len(n), bool)
                    first[np.unique(a, return_index=True)[1]] = True
                    many[~first] = 0
                else:
                    at = np.minimum(np.searchsorted(late, grams), len(late) - 1)
                    grams = grams[np.lexsort((grams, late[at] == grams, np.repeat(np.arange(len(n)), n)))]
                grams = grams[ragged(bounds[:-1], many)]
                bounds = np.concatenate([[0], np.cumsum(many)])
            flat = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(grams.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(a), pa.array(b), flat], ["doc_id", "h", "n", "a", "b", "grams"])

    return documents(df).withColumn("_h", text_key()).mapInArrow(run, SETS)


def of_rows(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and text of the rows whose (doc_id, text hash) is in ``wanted`` (doc_id, h)."""
    keys = small(wanted.select(F.col("doc_id").alias("_d"), F.col("h").alias("_w")), 1_000_000)
    return documents(df).join(keys, (text_key() == F.col("_w")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (col, node, n, pos) that come sorted by col and node, without repeats and without columns of one node."""

    def rows(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["col", "node", "n", "pos"])

    held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int32)]
    given = None  # the last row handed on
    for batch in batches:
        col, node, n, pos = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
        if not len(col):
            continue
        fresh = np.concatenate([[True], (col[1:] != col[:-1]) | (node[1:] != node[:-1])])
        fresh[0] = given is None or given != (col[0], node[0])
        col, node, n, pos = [x[fresh] for x in (col, node, n, pos)]
        if not len(col):
            held = [x[:0] for x in held]
            continue
        # a row is shared if a neighbour has its column; the last one waits for the next batch
        alike = col[1:] == col[:-1]
        before = np.concatenate([[given is not None and given[0] == col[0]], alike])
        both = before[:-1] | alike
        if both.any():
            yield rows(*[x[:-1][both] for x in (col, node, n, pos)])
        if before[-1]:
            yield rows(*[x[-1:] for x in (col, node, n, pos)])
            given, held = (col[-1], node[-1]), [x[:0] for x in (col, node, n, pos)]
        else:
            given, held = None, [x[-1:].copy() for x in (col, node, n, pos)]


def first_columns(df: DataFrame, rows: DataFrame, classes: DataFrame, words: int, seed: int, least: int) -> DataFrame:
    """(col, node, n) of the columns by which a class can have partners, where two classes or more share them.

    Columns are in the order of their hashes, but those by which over HOT
    classes would be found come last. Their set is settled before any class
    takes its columns, so the order is one for all. Classes whose list has too
    few other columns take theirs from the text.
    """
    listed = rows.select(F.col("a").alias("node"), "n", F.posexplode("grams").alias("pos", "col")).select("col", "node", "n", "pos")
    shared = stage(listed.repartition("col").sortWithinPartitions("col", "node").mapInArrow(_shared, "col bigint, node bigint, n bigint, pos int"), "shared")
    need = F.expr(looked_at_sql("n", least))
    spark, late = df.sparkSession, np.zeros(0, U64)
    columns = shared.filter(F.col("pos") < need).select("col", "node", "n")
    for _ in range(4):
        counted = columns.groupBy("col").agg(F.count("*").alias("m")).filter(F.col("m") > HOT)
        # how many columns have over 1, 2, 4 ... times HOT classes: a few rows
        scale = counted.groupBy(F.floor(F.log2(F.col("m") / HOT)).alias("k")).agg(F.count("*").alias("n")).collect()
        limit = HOT
        while sum(r["n"] for r in scale if HOT * 2 ** (r["k"] + 1) > limit) + len(late) > HOT_COLUMNS and limit < 1 << 62:
            limit *= 2
        hot = counted.filter(F.col("m") > limit).select("col").toPandas()["col"].to_numpy(np.int64).view(U64)  # at most HOT_COLUMNS
        fresh = np.setdiff1d(hot, late)
        if not len(fresh):
            break
        late = np.union1d(late, fresh)
        last = F.broadcast(spark.createDataFrame(pa.table({"col": late.view(np.int64)})))
        places = shared.join(last, "col").groupBy("node").agg(F.collect_list("pos").alias("late"))
        ranked = stage(shared.join(last, "col", "left_anti").join(places, "node", "left").withColumn("late", F.coalesce("late", F.array().cast("array<int>"))).select(
            "col", "node", "n", (F.col("pos") - F.size(F.filter("late", lambda x: x < F.col("pos")))).alias("rank")), "ranked")
        listed_n = F.least(F.ceil(LISTED * need), F.col("n"))
        lacking = places.join(classes.select("node", "rep", "n"), "node").filter(listed_n - F.size("late") < need).select("node", "rep")
        again = stage(lacking, "again")
        moved = incidence(of_rows(df, again.select("rep.doc_id", "rep.h")), words, seed, least, late).select(F.col("a").alias("node"), "n", "grams")
        taken = moved.select(F.explode("grams").alias("col"), "node", "n").distinct()
        kept = ranked.filter(F.col("rank") < need).join(again.select("node"), "node", "left_anti")
        columns = stage(kept.select("col", "node", "n").unionByName(taken), "columns")
    return columns


def peel(columns: DataFrame, least: int) -> DataFrame:
    """``columns`` without the classes that share too few of theirs to have a partner, and without columns of one class.

    Two linked rows share a number of the columns looked at that grows with
    their sizes, so chance meetings of a few columns end here. Leaving one
    class out can end others; passes go on while they take a tenth or more.
    """
    bound = F.expr(in_common_sql("q", least))
    before = None
    while True:
        shared = columns.groupBy("col").agg(F.count("*").alias("m")).filter("m > 1").select("col")
        columns = stage(columns.join(shared, "col"), "columns")
        after = columns.count()
        if not after or before is not None and after > 0.9 * before:
            return columns
        before = after
        own = columns.groupBy("node").agg(F.count("*").alias("s"), F.first(F.expr(f"({least} * n + 99) div 100")).alias("q"))
        columns = columns.join(own.filter(F.col("s") >= bound).select("node"), "node").select("col", "node", "n")


def products(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The (hub, node) of ``pairs`` whose sets reach the similarity; a hub meets its rows in blocks."""
    sized = pairs.groupBy("hub").agg(F.count("*").alias("m"))
    blocked = stage(pairs.join(sized, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.expr(f"(m + {ROWS - 1}) div {ROWS}")).alias("block")), "blocked")
    heads = blocked.select("hub", "block").distinct().withColumn("node", F.col("hub")).withColumn("first", F.lit(0))
    asked = heads.unionByName(blocked.withColumn("first", F.lit(1)))
    held = asked.join(sets.select("node", "n", "grams"), "node").repartition("hub", "block").sortWithinPartitions("hub", "block", "first")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hub = None
        for batch in batches:
            hubs, blocks, first, nodes, sizes = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            lists = batch.column(5)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            grams = lists.values.to_numpy().view(U64)  # sorted as unsigned
            cuts = np.flatnonzero(np.concatenate([[True], (hubs[1:] != hubs[:-1]) | (blocks[1:] != blocks[:-1])]))
            out = []
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(hubs)]):
                if key != (hubs[a], blocks[a]) or first[a] == 0:
                    key, hub = (hubs[a], blocks[a]), grams[bounds[a]:bounds[a + 1]].copy()
                    a += 1
                if a == z:
                    continue
                flat = grams[bounds[a]:bounds[z]]
                at = np.minimum(np.searchsorted(hub, flat), len(hub) - 1)
                sums = np.add.reduceat((hub[at] == flat).astype(np.int64), bounds[a:z] - bounds[a])
                union = len(hub) + sizes[a:z] - sums
                linked = 100 * sums >= least * union
                out.append((np.full(int(linked.sum()), key[0]), nodes[a:z][linked]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["hub", "node"])
            release()

    return held.select("hub", "block", "first", "node", "n", "grams").mapInArrow(multiply, "hub bigint, node bigint")


def plausible(pairs: DataFrame, own: DataFrame, least: int) -> DataFrame:
    """The (hub, node) of ``pairs`` that share as many of the columns looked at as two linked rows of their sizes must."""
    def side(name: str, mark: str) -> DataFrame:
        return own.select(F.col("node").alias(name), F.expr(in_common_sql("n", least)).alias(f"k{mark}"), F.col("cols").alias(f"c{mark}"))

    both = pairs.join(side("hub", "a"), "hub").join(side("node", "b"), "node")
    return both.filter(F.size(F.array_intersect("ca", "cb")) >= F.least("ka", "kb")).select("hub", "node")


def _fits(x: str, y: str, least: int) -> Column:
    return (least * F.col(x) <= 100 * F.col(y)) & (least * F.col(y) <= 100 * F.col(x))


def links(columns: DataFrame, sets: DataFrame, least: int = 85, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) of the classes that have a link.

    ``columns`` has col, node and n; ``sets`` the node, n and grams of its
    classes. Classes meet in pairs in columns of at most FEW of them. Others
    have a hub, named by a hash of the round among the column's classes, which
    the classes outside its component and within its size bound meet; then the
    hub is done with in this column. Columns of one component are done. What
    the rounds leave is compared in blocks.
    """
    own = stage(columns.groupBy("node").agg(F.first("n").alias("n"), F.collect_list("col").alias("cols")), "own")
    sized = stage(columns.join(columns.groupBy("col").agg(F.count("*").alias("m")), "col"), "sized")
    few = sized.filter(F.col("m") <= FEW).drop("m")
    other = few.select("col", F.col("node").alias("hub"), F.col("n").alias("hn"))
    met = few.join(other, "col").filter((F.col("hub") < F.col("node")) & _fits("n", "hn", least)).select("hub", "node").distinct()
    edges = [stage(products(stage(plausible(met, own, least), "met"), sets, least), "linked")]
    groups = stage(connected_groups(edges[0], "hub", "node"), "groups")
    many = stage(sized.filter(F.col("m") > FEW).drop("m"), "many")
    if many.isEmpty():
        return groups
    before = None
    for step in range(rounds):
        rooted = stage(_rooted(many, groups), "rooted")
        mixed = rooted.groupBy("col", "root").agg(F.count("*").alias("k")).groupBy("col").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("same"))
        mixed = stage(mixed.filter("m * m > same"), "mixed")
        # pairs of a column in different components that have not met
        still = mixed.agg(F.sum(F.expr("(m * m - same) div 2"))).first()[0]
        if not still:
            return groups
        rooted = rooted.join(mixed.select("col"), "col", "left_semi")
        if before is not None and still > 0.5 * before:
            break
        before = still
        hubs = rooted.groupBy("col").agg(F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", F.lit(step))).alias("h"))
        faced = stage(rooted.join(hubs, "col").filter("node <> h.node").select("col", "node", "n", "root", "h"), "faced")
        met = faced.filter((F.col("root") != F.col("h.root")) & _fits("n", "h.n", least)).select(F.col("h.node").alias("hub"), "node").distinct()
        edges.append(stage(products(stage(plausible(met, own, least), "met"), sets, least), "linked"))
        groups = stage(connected_groups(_all(edges), "hub", "node"), "groups")
        many = faced.select("col", "node", "n")
    rooted = stage(_rooted(many, groups), "rooted")
    edges.append(stage(block_products(rooted, sets, least), "linked"))
    return connected_groups(_all(edges), "hub", "node")


def block_products(rooted: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Links between classes of different components that share a column of (col, node, n, root).

    Classes that hang together by columns form a cluster. Its classes are
    sorted by component and cut into blocks of ROWS; two blocks meet unless
    both lie in one component, so a component that holds most of a cluster
    never meets itself. A pair of blocks is one product of their rows; of the
    links of a row, one to each component of the other block is kept.
    """
    stars = rooted.join(rooted.groupBy("col").agg(F.min("node").alias("first")), "col").filter("node <> first").select("first", "node").distinct()
    clusters = connected_groups(stars, "first", "node").withColumnRenamed("root", "cluster")
    nodes = stage(rooted.select("node", "n", "root").distinct().join(clusters, "node"), "nodes")
    placed = with_group_index(nodes, ["cluster"], ["root", "node"], "at").withColumn("block", F.expr(f"at div {ROWS}"))
    placed = stage(placed.select("cluster", "block", "node", "n", "root"), "placed")
    blocks = placed.groupBy("cluster", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("short"), F.max("n").alias("long"))
    blocks = stage(blocks, "blocks")
    a = blocks.select("cluster", *[F.col(c).alias(f"{c}1") for c in ("block", "low", "high", "short", "long")])
    b = blocks.select("cluster", *[F.col(c).alias(f"{c}2") for c in ("block", "low", "high", "short", "long")])
    one = (F.col("low1") == F.col("high1")) & (F.col("low2") == F.col("high2")) & (F.col("low1") == F.col("low2"))
    meets = a.join(b, "cluster").filter((F.col("block1") <= F.col("block2")) & ~one & (least * F.col("short1") <= 100 * F.col("long2")) & (least * F.col("short2") <= 100 * F.col("long1")))
    meets = stage(meets.select("cluster", "block1", "block2"), "meets")
    sides = meets.select("cluster", "block1", "block2", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("block1").alias("block")), F.struct(F.lit(1).alias("side"), F.col("block2").alias("block")))).alias("s"))
    sides = sides.filter((F.col("s.side") == 0) | (F.col("block1") < F.col("block2"))).select("cluster", "block1", "block2", "s.side", "s.block")
    rows = sides.join(placed, ["cluster", "block"]).select("cluster", "block1", "block2", "side", "node", "root")
    full = rows.join(sets.select("node", "n", "grams"), "node")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "node"], ignore_index=True)
        node, root, n = [pdf[c].to_numpy(np.int64) for c in ("node", "root", "n")]
        left = np.flatnonzero(pdf["side"].to_numpy() == 0)
        right = np.flatnonzero(pdf["side"].to_numpy() == 1) if (pdf["side"] == 1).any() else left
        # the left rows by column: a sparse matrix whose products with a row are sums over its columns
        cols = np.concatenate([pdf["grams"].iloc[i] for i in left])
        owner = np.repeat(np.arange(len(left)), n[left])
        order = np.argsort(cols, kind="stable")
        cols, owner = cols[order], owner[order]
        out = []
        for r in right.tolist():
            row = np.sort(np.asarray(pdf["grams"].iloc[r], np.int64))
            start, stop = np.searchsorted(cols, row, side="left"), np.searchsorted(cols, row, side="right")
            sums = np.bincount(owner[ragged(start, stop - start)], minlength=len(left))
            linked = np.flatnonzero((100 * sums >= least * (n[left] + n[r] - sums)) & (root[left] != root[r]))
            _, first = np.unique(root[left][linked], return_index=True)
            out += [(node[left[x]], node[r]) for x in linked[first].tolist()]
        return pd.DataFrame(out, columns=["hub", "node"], dtype="int64")

    return full.groupBy("cluster", "block1", "block2").applyInPandas(multiply, "hub bigint, node bigint")


def _all(edges: list[DataFrame]) -> DataFrame:
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out


def _rooted(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """(col, node, n) with the component of each class so far."""
    return columns.join(groups, "node", "left").select("col", "node", "n", F.coalesce("root", "node").alias("root"))


def components(df: DataFrame, words: int = 4, least: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of every row.

    Texts with fewer words than a shingle are one shingle; null texts and
    those without words have none and stay alone. Null doc_ids have rows but
    are never the smallest of others. Repeated rows are returned as often as
    they come; an empty table gives none. Further columns are ignored.
    """
    seed = 0
    while True:
        rows = stage(incidence(df, words, seed, least), "rows")
        kept = rows.filter("n > 0").groupBy(F.col("a").alias("node"))
        classes = stage(kept.agg(F.first("n").alias("n"), F.min(F.struct("doc_id", "h")).alias("rep"), F.min("doc_id").alias("first"), (F.min("b") == F.max("b")).alias("one")), "classes")
        if classes.filter("not one").isEmpty():
            break
        seed += 1  # two different sets with one digest: take another
    columns = peel(first_columns(df, rows, classes, words, seed, least), least)
    wanted = classes.join(columns.select("node").distinct(), "node", "left_semi").select("rep.doc_id", "rep.h")
    sets = stage(incidence(of_rows(df, stage(wanted, "wanted")), words, seed).select(F.col("a").alias("node"), "n", "grams"), "sets")  # repeated rows only repeat links
    groups = stage(links(columns, sets, least), "groups")
    rooted = classes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(F.col("node").alias("a"), "component_id")
    joined = rows.select("doc_id", "n", "a").join(named, "a", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
