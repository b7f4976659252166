"""Vector search, neighbours, retrieved samples and retrieval evaluation.

Rows are hashed to blocks, so every task holds at most one block of each side
whatever the size of a list, topic or table. Inside a task scores are matrix
products of small tiles, and only the wanted rows of a block are emitted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import digest
from ..session import spread, stage

# What a task holds of either side: each row of one side is sent to every block of the other
QUERY_BLOCK = 32768
CORPUS_BLOCK = 32768
# What is scored at once: 32 MB of scores
TILE = 2048
# Columns that are told apart by the largest of them first
FOLD = 32
# Few rows are cut further, into so many blocks a side, to give all cores work
LEAST_BLOCKS = 6
MOST_TASKS = 2000


def _blocks(rows: int, size: int) -> int:
    return max(-(-rows // size), min(-(-rows // TILE), LEAST_BLOCKS), 1)


def _blocked(queries: DataFrame, corpus: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn`` to every pair of blocks of the same list (of the whole tables without a ``list``).

    ``queries`` (qid, qvec, list, ...) and ``corpus`` (id, vec, list, ...) may
    be of any size; lists are cut into blocks by the hash of the row id.
    """
    if "list" not in queries.columns:
        # one list: its numbers of blocks are two constants
        queries, corpus = queries.withColumn("list", F.lit(0)), corpus.withColumn("list", F.lit(0))
        nq, nc = (_blocks(side.count(), size) for side, size in ((queries, QUERY_BLOCK), (corpus, CORPUS_BLOCK)))

        pairs = nq * nc

        def counted(side):
            return side.withColumns({"_q": F.lit(nq).cast("bigint"), "_c": F.lit(nc).cast("bigint")})
    else:
        # the two sides of a list meet by the hash of its name, which depends on the type
        corpus = corpus.withColumn("list", F.col("list").cast(queries.schema["list"].dataType))
        # one row per list
        sizes = queries.groupBy("list").agg(F.count("*").alias("_nq")).join(corpus.groupBy("list").agg(F.count("*").alias("_nc")), "list")
        cuts = stage(sizes.select("list", F.ceil(F.col("_nq") / QUERY_BLOCK).alias("_q"), F.ceil(F.col("_nc") / CORPUS_BLOCK).alias("_c")), "cuts")
        pairs = cuts.agg(F.sum(F.col("_q") * F.col("_c"))).first()[0] or 0

        def counted(side):
            return side.join(cuts, "list")

    def spread(side, key, own, other):
        marked = counted(side).withColumn(f"{own}b", F.pmod(F.xxhash64(key), F.col(own)))
        return marked.withColumn(f"{other}b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))).drop("_q", "_c")
    q, c = spread(queries, "qid", "_q", "_c"), spread(corpus, "id", "_c", "_q")
    keys = ["list", "_qb", "_cb"]
    # pairs of blocks are few and costly: more partitions than pairs, so that hardly two share a task while others wait
    tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4 * pairs, MOST_TASKS))
    q, c = q.repartition(tasks, *keys), c.repartition(tasks, *keys)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])
        return fn(left.sort_values("qid", ignore_index=True), right.sort_values("id", ignore_index=True))
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(run, schema)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _tiles(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, first column and scores of every tile."""
    for row in range(0, len(left), TILE):
        for col in range(0, len(right), TILE):
            yield row, col, left[row:row + TILE] @ right[col:col + TILE].T


def _strips(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """As tiles of the same size, but few rows by many columns, so that a query is seldom asked again."""
    cols = max(1, min(len(right), 16 * TILE))
    rows = max(1, TILE * TILE // cols)
    for col in range(0, len(right), cols):
        across = np.ascontiguousarray(right[col:col + cols].T)
        for row in range(0, len(left), rows):
            yield row, col, left[row:row + rows] @ across


def _reaching(scores: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that may be among the k best of their row and reach its floor.

    The k-th largest maximum of some sets of columns is a lower bound of the
    k-th score, and only sets whose maximum reaches it are looked into.
    """
    n, width = scores.shape
    sets = width // FOLD
    if sets < 2 * k:
        if width > k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(np.where(np.isnan(scores), -np.inf, scores), -k, axis=1)[:, -k])
        return np.nonzero(scores >= floor[:, None])
    folded = scores[:, :sets * FOLD].reshape(n, FOLD, sets)
    top = np.fmax.reduce(folded, axis=1)
    if np.isneginf(floor).any():
        floor = np.maximum(floor, np.partition(np.where(np.isnan(top), -np.inf, top), -k, axis=1)[:, -k])
    # a set without a number reaches nothing
    at, which = np.nonzero(top >= floor[:, None])
    inside, place = np.nonzero(folded[at, :, which] >= floor[at, None])
    rest, tail = np.nonzero(scores[:, sets * FOLD:] >= floor[:, None])
    return np.concatenate([at[inside], rest]), np.concatenate([place * sets + which[inside], sets * FOLD + tail])


class _Best:
    """The ``k`` best rows of every query seen so far, ties by id.

    A tile gives only what reaches the k-th score its query has by then.
    """

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.held = np.zeros(n, dtype=np.int64)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of the queries ``at`` with the rows ``ids``."""
        rows, cols = _reaching(scores, self.score[at, -1], self.k)
        if not len(rows):
            return
        touched, place = np.unique(rows, return_inverse=True)
        old = at[touched]
        kept = np.arange(self.k) < self.held[old][:, None]
        row = np.concatenate([np.nonzero(kept)[0], place])
        score = np.concatenate([self.score[old][kept], scores[rows, cols]])
        name = np.concatenate([self.id[old][kept], ids[cols]])
        order = np.lexsort((name, -score, row))
        row, score, name = row[order], score[order], name[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < self.k
        self.score[old[row[top]], rank[top]], self.id[old[row[top]], rank[top]] = score[top], name[top]
        self.held[old] = np.minimum(np.bincount(row, minlength=len(old)), self.k)

    def rows(self, qid: np.ndarray) -> Iterator[pd.DataFrame]:
        """(qid, id, score), some queries at a time."""
        for low in range(0, len(qid), TILE):
            part = slice(low, low + TILE)
            row, rank = np.nonzero(np.arange(self.k) < self.held[part, None])
            yield pd.DataFrame({"qid": qid[part][row], "id": self.id[part][row, rank], "score": self.score[part][row, rank]})


def _best_of(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best rows of a block for every query of a block."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        best, ids = _Best(len(left), k), right["id"].to_numpy(np.int64)
        for row, col, scores in _strips(_matrix(left["qvec"]), _matrix(right["vec"])):
            best.add(np.arange(row, row + len(scores)), ids[col:col + scores.shape[1]], scores)
        return pd.concat(best.rows(left["qid"].to_numpy(np.int64)), ignore_index=True)
    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    # the rank filter is pushed in front of the shuffle, so no query gathers more than k rows per task
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("qid", "rank", "id", "score")


QUERY_BYTES = 64 << 20  # a query side up to this size is sent to the corpus, which then stays where it is


def _scanned(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The k best of every query from each partition of the corpus, for queries that fit a task."""
    sent = queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec")).toArrow().combine_chunks()
    qid = sent["qid"].to_numpy().astype(np.int64)
    qvec = sent["qvec"].combine_chunks().flatten().to_numpy().reshape(len(qid), -1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(len(qid), k)
        for batch in batches:
            ids = batch["id"].to_numpy(np.int64)
            for row, col, scores in _strips(qvec, _matrix(batch["vec"]) if len(batch) else np.empty((0, qvec.shape[1]))):
                best.add(np.arange(row, row + len(scores)), ids[col:col + scores.shape[1]], scores)
        yield from best.rows(qid)
    return spread(corpus.select("id", "vec"), "id").mapInPandas(run, "qid long, id long, score double")


def topk_inner_product(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, score): exact largest inner products.

    ``queries`` holds (qid, qvec), ``corpus`` (id, vec). Queries whose bytes,
    counted first, are few go to the corpus; else both sides meet in blocks.
    """
    size = queries.agg(F.sum(F.size("qvec").cast("bigint") * 8 + 16)).first()[0] or 0
    if 0 < size <= QUERY_BYTES:
        return _ranked(_scanned(queries, corpus, k), k)
    return _ranked(_blocked(queries, corpus, _best_of(k), "qid long, id long, score double"), k)


def train_centroids(corpus: DataFrame, nlist: int, fraction: float, seed: int = 1) -> np.ndarray:
    """Centroids of a sample of the corpus: ``nlist`` vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    sample = corpus.sample(fraction, seed) if fraction < 1 else corpus
    model = KMeans(k=nlist, seed=seed, maxIter=10, featuresCol="_f").fit(sample.select(array_to_vector("vec").alias("_f")))
    return np.array(model.clusterCenters())


def nearest_lists(vec: Column, centers: np.ndarray, n: int) -> Column:
    """The ``n`` nearest centroids of a vector."""
    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64)
        d = (centers ** 2).sum(axis=1)[None, :] - 2 * x @ centers.T
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)))
    return near(vec)


def topk_approx(queries: DataFrame, corpus: DataFrame, k: int, nlist: int, nprobe: int, fraction: float = 1.0, seed: int = 1) -> DataFrame:
    """As :func:`topk_inner_product`, but only inside the ``nprobe`` nearest lists of each query."""
    centers = train_centroids(corpus, nlist, fraction, seed)
    c = corpus.withColumn("list", F.element_at(nearest_lists(F.col("vec"), centers, 1), 1))
    q = queries.withColumn("list", F.explode(nearest_lists(F.col("qvec"), centers, nprobe)))
    return _ranked(_blocked(q, c, _best_of(k), "qid long, id long, score double"), k)


class Lists:
    """Inverted lists of a corpus (id, vec) whose searches are exact.

    Their number follows the root of the table. A list keeps its centroid, the
    largest distance r of a member from it, and its rows; no inner product of a
    query q with a member exceeds q . centroid + |q| * r. A query first
    scans the lists of the highest bounds that hold k rows between them; the
    k-th score found there rules out every list whose bound is below it, and
    only the others are scanned. Centroids and list sizes are one row per list.
    """

    def __init__(self, corpus: DataFrame, nlist: int | None = None, seed: int = 1):
        rows = corpus.count()
        self.rows = rows
        if not rows:
            self.placed = corpus.select("id", "vec", F.lit(0).alias("list"), F.lit(0.0).alias("far"))
            return
        wanted = nlist or max(1, math.isqrt(rows))
        # 64 rows a list train the centroids
        centers = train_centroids(corpus, wanted, min(1.0, 64 * wanted / rows), seed)

        @F.pandas_udf("list int, far double")
        def assign(vec: pd.Series) -> pd.DataFrame:
            x = np.stack(vec.to_numpy()).astype(np.float64)
            d = (centers ** 2).sum(axis=1)[None, :] - 2 * x @ centers.T
            near = np.argmin(d, axis=1)
            return pd.DataFrame({"list": near.astype(np.int32), "far": np.sqrt(((x - centers[near]) ** 2).sum(axis=1))})

        placed = corpus.select("id", "vec", assign("vec").alias("_a")).select("id", "vec", "_a.list", "_a.far")
        self.placed = stage(placed, "lists")
        told = self.placed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("r")).toPandas().sort_values("list")
        self.names, self.sizes, self.radius = told["list"].to_numpy(np.int32), told["n"].to_numpy(np.int64), told["r"].to_numpy(np.float64)
        self.centers = centers[self.names]
        self.bundle = _bundles(self.sizes, min(CORPUS_BLOCK, -(-rows // LEAST_BLOCKS)))

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(qid, rank, id, score) as :func:`topk_inner_product` gives them, and (qid, list, n) of the lists scanned, n their rows.

        A query goes once to every bundle of lists that holds one it needs, and the task there picks the lists.
        """
        if not self.rows:
            none = queries.select("qid", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("score")).limit(0)
            return none, none.select("qid", F.lit(0).alias("list"), F.lit(0).cast("bigint").alias("n"))
        names, sizes, radius, centers, bundle = self.names, self.sizes, self.radius, self.centers, self.bundle

        def bounds(q: np.ndarray, some: slice = slice(None)) -> np.ndarray:
            return q @ centers[some].T + np.sqrt((q * q).sum(axis=1))[:, None] * radius[None, some]

        def tiled(vec: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
            for low in range(0, len(vec), TILE):
                yield low, _matrix(vec.iloc[low:low + TILE])

        def within(first: pd.Series) -> np.ndarray:
            """Lists of the first scan, marked."""
            mask = np.zeros((len(first), len(names)), dtype=bool)
            mask[np.repeat(np.arange(len(first)), first.map(len).to_numpy(np.int64)), np.searchsorted(names, np.concatenate(first.to_list()))] = True
            return mask

        def left_out(q: np.ndarray, first: pd.Series, least: pd.Series, some: slice = slice(None)) -> np.ndarray:
            """Lists beyond the first scan that may hold something better; rounding must not rule out one that ties."""
            floor = least.fillna(-np.inf).to_numpy(np.float64) - 1e-9 * (1 + np.abs(least.fillna(0).to_numpy(np.float64)))
            return (bounds(q, some) >= floor[:, None]) & ~within(first)[:, some]

        @F.pandas_udf("array<int>")
        def highest(vec: pd.Series) -> pd.Series:
            """Lists of the highest bounds that hold k rows."""
            found = []
            for _, q in tiled(vec):
                order = np.argsort(-bounds(q), axis=1, kind="stable")
                many = 1 + np.minimum((np.cumsum(sizes[order], axis=1) < k).sum(axis=1), len(names) - 1)
                found += [names[o[:m]] for o, m in zip(order, many)]
            return pd.Series(found)

        @F.pandas_udf("array<int>")
        def others(vec: pd.Series, first: pd.Series, least: pd.Series) -> pd.Series:
            found = []
            for low, q in tiled(vec):
                found += [names[w] for w in left_out(q, first.iloc[low:low + TILE], least.iloc[low:low + TILE])]
            return pd.Series(found)

        @F.pandas_udf("array<int>")
        def bundles_of(lists: pd.Series) -> pd.Series:
            return lists.map(lambda found: np.unique(bundle[np.searchsorted(names, found)]))

        def scan(asked: DataFrame, again: bool) -> DataFrame:
            def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                best, ids, vectors = _Best(len(left), k), right["id"].to_numpy(np.int64), _matrix(right["vec"])
                place = np.searchsorted(names, right["held"].to_numpy(np.int32))
                some = slice(place.min(), place.max() + 1)
                for low in range(0, len(left), TILE):
                    part = left.iloc[low:low + TILE]
                    q = _matrix(part["qvec"])
                    wanted = left_out(q, part["first"], part["least"], some) if again else within(part["first"])[:, some]
                    for one in np.unique(place):
                        asking, mine = np.flatnonzero(wanted[:, one - some.start]), np.flatnonzero(place == one)
                        if len(asking):
                            for _, col, scores in _tiles(q[asking], vectors[mine]):
                                best.add(low + asking, ids[mine[col:col + TILE]], scores)
                return pd.concat(best.rows(left["qid"].to_numpy(np.int64)), ignore_index=True)
            sent = asked.select("qid", "qvec", "first", "least", F.explode("into").alias("list"))
            rows = self.placed.withColumnRenamed("list", "held").join(F.broadcast(known), "held").select("id", "vec", "held", F.col("bundle").alias("list"))
            return _blocked(sent, rows, run, "qid long, id long, score double")

        known = queries.sparkSession.createDataFrame(pd.DataFrame({"held": names, "n": sizes, "bundle": bundle}), "held int, n long, bundle int")
        # staged, so that both scans go by the same lists
        asked = stage(queries.select("qid", "qvec", highest("qvec").alias("first")), "asked")
        found = stage(_ranked(scan(asked.select("*", F.lit(None).cast("double").alias("least"), bundles_of("first").alias("into")), False), k), "first")
        told = asked.join(found.filter(F.col("rank") == k).select("qid", F.col("score").alias("least")), "qid", "left")
        more = told.select("*", others("qvec", "first", "least").alias("others"))
        every = more.select("qid", F.explode(F.concat("first", "others")).alias("held")).join(F.broadcast(known), "held")
        again = scan(more.withColumn("into", bundles_of("others")), True)
        return _ranked(found.select("qid", "id", "score").unionByName(again), k), every.select("qid", F.col("held").alias("list"), "n")


def _bundles(sizes: np.ndarray, most: int) -> np.ndarray:
    """Neighbouring lists in bundles of ``most`` rows, larger lists alone."""
    out, number, rows = np.zeros(len(sizes), dtype=np.int32), 0, 0
    for i, n in enumerate(sizes):
        if rows and rows + n > most:
            number, rows = number + 1, 0
        out[i], rows = number, rows + n
    return out


def unit(vec: Column) -> Column:
    """Vector over its length."""
    from ..functions.arrays import let
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    return let(norm, lambda n: F.transform(vec, lambda x: x / n))


def knn_classify(queries: DataFrame, bank: DataFrame, labels: DataFrame, k: int, t: float) -> DataFrame:
    """(qid, label, class_score, rank): classes by the sum of exp(cosine / t) over the k nearest."""
    near = topk_inner_product(queries.withColumn("qvec", unit(F.col("qvec"))), bank.withColumn("vec", unit(F.col("vec"))), k)
    scores = near.join(labels, "id").groupBy("qid", "label").agg(F.sum(F.exp(F.col("score") / t)).alias("class_score"))
    # at most k classes per query
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("class_score").desc(), "label")))


def similar_examples(queries: DataFrame, examples: DataFrame, k: int = 10) -> DataFrame:
    """(qid, pos, id): the k most similar examples of the query's topic, least similar first.

    ``queries`` holds (qid, qvec, topic), ``examples`` (id, vec, topic).
    """
    q, c = queries.withColumnRenamed("topic", "list"), examples.withColumnRenamed("topic", "list")
    best = _ranked(_blocked(q, c, _best_of(k), "qid long, id long, score double"), k)
    held = best.groupBy("qid").agg(F.count("*").alias("_n"))
    return best.join(held, "qid").select("qid", (F.col("_n") - F.col("rank") + 1).alias("pos"), "id", "score")


def diverse_examples(queries: DataFrame, examples: DataFrame, k: int = 10) -> DataFrame:
    """(qid, pos, id): for an unseen topic, the least similar example of each of the k lowest topics, in reverse.

    A block's k lowest topics are enough: a topic with k lower ones in the
    block where its lowest example lies cannot be among the k lowest overall.
    """
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["topic", "id"], ignore_index=True)
        topics, which = np.unique(b["topic"].to_numpy(), return_inverse=True)
        ids, qid, left, right, parts = b["id"].to_numpy(np.int64), a["qid"].to_numpy(np.int64), _matrix(a["qvec"]), _matrix(b["vec"]), []
        some = max(1, min(TILE, TILE * TILE // len(topics)))
        for row in range(0, len(left), some):
            q = left[row:row + some]
            low, first, every = np.full((len(q), len(topics)), np.inf), np.zeros((len(q), len(topics)), dtype=np.int64), np.arange(len(q))
            for _, col, scores in _tiles(q, right):
                here = which[col:col + scores.shape[1]]
                starts = np.flatnonzero(np.diff(here, prepend=-1))
                for start, end in zip(starts, [*starts[1:], len(here)]):
                    at = scores[:, start:end].argmin(axis=1)
                    value, topic = scores[every, start + at], here[start]
                    # the tiles of a topic come in the order of their ids
                    lower = value < low[:, topic]
                    low[lower, topic], first[lower, topic] = value[lower], ids[col + start + at[lower]]
            reach = np.partition(low, k - 1, axis=1)[:, k - 1:k] if len(topics) > k else np.inf
            rows, cols = np.nonzero(low <= reach)
            parts.append(pd.DataFrame({"qid": qid[row + rows], "topic": topics[cols], "id": first[rows, cols], "score": low[rows, cols]}))
        return pd.concat(parts, ignore_index=True)
    lows = _blocked(queries.select("qid", "qvec"), examples, run, "qid long, topic long, id long, score double")
    per = lows.groupBy("qid", "topic").agg(F.min(F.struct("score", "id")).alias("_m")).select("qid", "_m.id", "_m.score")
    order = Window.partitionBy("qid").orderBy("score", "id")
    kept = per.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    held = kept.groupBy("qid").agg(F.count("*").alias("_n"))
    return kept.join(held, "qid").select("qid", (F.col("_n") - F.col("_r") + 1).alias("pos"), "id", "score")


def causal_neighbors(neighbors: DataFrame, sample_docs: DataFrame, chunks: DataFrame, per_sample: int, k_save: int = 20, pad: int = -1) -> DataFrame:
    """(chunk_id, rank, neighbor_id): neighbours from other documents than the sample's own, padded to ``k_save``.

    ``neighbors`` holds (chunk_id, rank, neighbor_id) with missing ids below 0,
    ``sample_docs`` (sample_id, dataset_idx, doc_id), ``chunks`` (chunk_id, dataset_idx, doc_id).
    """
    # staged, as both the neighbours and the chunks that have any are read from it: a search is not run twice
    neighbors = stage(neighbors.select("chunk_id", "rank", "neighbor_id"), "neighbors")
    db = chunks.select(F.col("chunk_id").alias("neighbor_id"), "dataset_idx", "doc_id")
    real = neighbors.filter("neighbor_id >= 0").join(db, "neighbor_id").withColumn("sample_id", F.floor(F.col("chunk_id") / per_sample))
    allowed = real.join(sample_docs.select("sample_id", "dataset_idx", "doc_id").distinct(), ["sample_id", "dataset_idx", "doc_id"], "left_anti")
    # a chunk has at most as many rows as neighbours were asked for
    again = Window.partitionBy("chunk_id").orderBy("rank")
    kept = allowed.withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= k_save).select("chunk_id", "rank", "neighbor_id")
    slots = neighbors.select("chunk_id").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k_save))))
    return slots.join(kept, ["chunk_id", "rank"], "left").withColumn("neighbor_id", F.coalesce("neighbor_id", F.lit(pad)))


def attach_retrieved(neighbors: DataFrame, chunks: DataFrame, per_sample: int, n_neighbors: int, n_cont: int) -> DataFrame:
    """(sample_id, neighbor_chunks, neighbor_tokens): for each chunk of a sample its neighbours and the chunks behind them.

    Ids wrap at the table's size; ``chunks`` holds (chunk_id, tokens).
    """
    total = chunks.count()
    wide = neighbors.filter(F.col("rank") <= n_neighbors).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n_cont - 1))))
    wide = wide.withColumn("_id", F.pmod(F.col("neighbor_id") + F.col("_j"), F.lit(total)))
    got = wide.join(chunks.select(F.col("chunk_id").alias("_id"), "tokens"), "_id")
    # per_sample * n_neighbors * n_cont entries per sample
    rows = got.groupBy(F.floor(F.col("chunk_id") / per_sample).alias("sample_id")).agg(
        F.array_sort(F.collect_list(F.struct("chunk_id", "rank", "_j", "_id", "tokens"))).alias("_r"))
    return rows.select("sample_id", F.col("_r._id").alias("neighbor_chunks"), F.flatten(F.col("_r.tokens")).alias("neighbor_tokens"))


def select_negatives(key: Column, hard: Column, other: Column, n_hard: int, n_other: int, mode: str, seed: int = 1) -> Column:
    """Evaluation: the first others, then the first hard ones. Training: shuffled hard ones, filled up with shuffled others."""
    if mode == "eval":
        return F.concat(F.slice(other, 1, n_other), F.slice(hard, 1, n_hard))

    def shuffled(x, tag):
        marked = F.transform(x, lambda v, i: F.struct(digest(f"{seed}{tag}", key, i).alias("h"), v.alias("v")))
        return F.transform(F.array_sort(marked), lambda s: s["v"])
    first = F.slice(shuffled(hard, "h"), 1, n_hard)
    return F.concat(first, F.slice(shuffled(other, "o"), F.lit(1), n_hard - F.size(first)))


def topk_hits(hits: DataFrame, question: str, rank: str, hit: str, k: int) -> DataFrame:
    """(k, hits, share): questions with a hit among the first k, for every k."""
    first = hits.groupBy(question).agg(F.min(F.when(F.col(hit), F.col(rank))).alias("_f"))
    counted = first.groupBy("_f").agg(F.count("*").alias("_n"))
    total = counted.agg(F.sum("_n").alias("_t"))
    spark = hits.sparkSession
    upto = counted.filter(F.col("_f") <= k).withColumn("k", F.explode(F.sequence(F.col("_f").cast("int"), F.lit(k)))).groupBy("k").agg(F.sum("_n").alias("hits"))
    every = spark.range(1, k + 1).select(F.col("id").cast("int").alias("k")).join(upto, "k", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return every.withColumn("share", F.col("hits") / total.scalar())


def retrieval_rank_stats(pairs: DataFrame, batch: str, ks: list[int]) -> DataFrame:
    """Mean 0-based rank of the true context among its batch, and top-k accuracies in percent.

    ``pairs`` holds (id, qvec, vec, batch): a query and its true context. Ranks
    are counts of better contexts, summed over blocks; scores stay in the task.
    """
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, qid, ids = _matrix(a["qvec"]), a["qid"].to_numpy(), b["id"].to_numpy()
        own, better = np.einsum("ij,ij->i", left, _matrix(a["own"])), np.zeros(len(a), dtype=np.int64)
        for row, col, s in _tiles(left, _matrix(b["vec"])):
            here = slice(row, row + len(s))
            mine = qid[here, None] == ids[None, col:col + s.shape[1]]
            # the own score may differ in the last digit between the two products
            better[here] += ((s > own[here, None]) & ~mine).sum(axis=1)
        return pd.DataFrame({"qid": qid, "better": better})
    q = pairs.select(F.col("id").alias("qid"), "qvec", F.col("vec").alias("own"), F.col(batch).alias("list"))
    c = pairs.select("id", "vec", F.col(batch).alias("list"))
    ranks = _blocked(q, c, run, "qid long, better long").groupBy("qid").agg(F.sum("better").alias("rank"))
    tops = [F.avg((F.col("rank") < k).cast("double") * 100).alias(f"top{k}_acc") for k in ks]
    return ranks.agg(F.count("*").alias("total"), F.avg("rank").alias("rank"), *tops)
