"""Searches hold one tile of scores at a time, and send a query once to a bundle of lists."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import retrieval as rt


def _block(n, name, vec, seed):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({name: np.arange(n), vec: list(rng.normal(size=(n, 8)))})


def test_a_block_is_scored_in_tiles():
    left, right = _block(8000, "qid", "qvec", 1), _block(8000, "id", "vec", 2)
    s = np.stack(left["qvec"][:50].to_numpy()) @ np.stack(right["vec"].to_numpy()).T
    tracemalloc.start()
    found = rt._best_of(5)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the whole block of scores would be 512 MB
    assert peak < 200e6
    for i in range(50):
        assert found[found.qid == i]["id"].tolist() == np.argsort(-s[i], kind="stable")[:5].tolist()


@pytest.mark.parametrize("tile", [3, 2048])
def test_tiles_keep_ties_and_missing_numbers_apart(tile, monkeypatch):
    monkeypatch.setattr(rt, "TILE", tile)
    rng = np.random.default_rng(3)
    q, c = rng.integers(-2, 3, (11, 3)).astype(float), rng.integers(-2, 3, (40, 3)).astype(float)
    c[7] = np.nan
    found = rt._best_of(4)(pd.DataFrame({"qid": range(11), "qvec": list(q)}), pd.DataFrame({"id": range(40), "vec": list(c)}))
    s = q @ c.T
    for i in range(11):
        want = sorted((j for j in range(40) if j != 7), key=lambda j: (-s[i, j], j))[:4]
        assert found[found.qid == i]["id"].tolist() == want


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 6))
    df = spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(x)], "id long, vec array<double>, topic long")
    return x, df


def test_a_query_goes_once_to_a_bundle_of_lists(points, monkeypatch):
    x, df = points
    asked = []
    blocked = rt._blocked

    def counted(queries, corpus, fn, schema):
        asked.append((queries.count(), queries.select("qid", "list").distinct().count()))
        return blocked(queries, corpus, fn, schema)
    monkeypatch.setattr(rt, "_blocked", counted)
    lists = rt.Lists(df.select("id", "vec"))
    found, scanned = lists.search(df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), 5)
    bundles = len(np.unique(lists.bundle))
    assert bundles < len(lists.names) / 3 and all(n == distinct <= 1500 * bundles for n, distinct in asked)
    s, got = x @ x.T, {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert all(got[i] == np.argsort(-s[i], kind="stable")[:5].tolist() for i in range(1500))
    assert scanned.groupBy("qid", "list").count().filter("count > 1").isEmpty()


def test_lists_of_two_integer_types_meet(points, spark):
    x, df = points
    near = rt.similar_examples(
        df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.col("topic").cast("int").alias("topic")).filter("qid < 30"), df, 3)
    s, got = x @ x.T, {}
    for r in near.orderBy("qid", F.desc("pos")).collect():
        got.setdefault(r.qid, []).append(r.id)
    for i in range(30):
        same = [j for j in range(1500) if j % 7 == i % 7]
        assert got[i] == sorted(same, key=lambda j: (-s[i, j], j))[:3]


@pytest.mark.parametrize("tile", [8, 2048])
def test_lowest_of_topics_over_tiles(points, tile, monkeypatch):
    monkeypatch.setattr(rt, "TILE", tile)
    x, df = points
    x, df = x[:60], df.filter("id < 60")
    low = rt.diverse_examples(df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), df, 4)
    s, got = x @ x.T, {}
    for r in low.orderBy("qid", F.desc("pos")).collect():
        got.setdefault(r.qid, []).append(r.id)
    for i in range(60):
        ends = [min((j for j in range(60) if j % 7 == topic), key=lambda j: (s[i, j], j)) for topic in range(7)]
        assert got[i] == sorted(ends, key=lambda j: (s[i, j], j))[:4]


@pytest.mark.parametrize("width", [10, 700, 739])
def test_sets_of_columns_rule_out_nothing_that_counts(width):
    rng = np.random.default_rng(width)
    scores = rng.integers(-40, 40, (25, width)).astype(float)
    scores[0], scores[1, 3:], scores[2, ::2], scores[3], scores[4, :5] = np.nan, np.nan, -np.inf, 1.0, np.inf
    best = rt._Best(30, 6)
    for ids, part in ((np.arange(width), scores), (np.arange(width, 2 * width), scores[:, ::-1])):
        best.add(np.arange(25) + 5, ids, part)
    both = np.concatenate([scores, scores[:, ::-1]], axis=1)
    rows = pd.concat(best.rows(np.arange(30)))
    for i in range(25):
        want = sorted(np.flatnonzero(~np.isnan(both[i])), key=lambda j: (-both[i, j], j))[:6]
        assert rows[rows.qid == i + 5]["id"].tolist() == want
    # a floor that is known already leaves little to be looked into, as does the floor of the first scores
    wide = rng.normal(size=(50, 64 * rt.FOLD))
    assert len(rt._reaching(wide, np.full(50, -np.inf), 8)[0]) < 50 * 8 * 2
    assert len(rt._reaching(wide, np.full(50, 9.0), 8)[0]) == 0


def test_pairs_of_blocks_do_not_queue_in_a_few_tasks(points, monkeypatch):
    from pyspark import TaskContext
    monkeypatch.setattr(rt, "TILE", 64)

    def where(left, right):
        return pd.DataFrame({"task": [TaskContext.get().partitionId()], "n": [len(left) * len(right)]})
    df = points[1]
    met = rt._blocked(df.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), df.select("id", "vec"), where, "task long, n long")
    got = met.collect()
    assert len(got) == 36 and sum(r.n for r in got) == 1500 * 1500
    # 4 partitions are set
    assert len({r.task for r in got}) > 20


def test_neighbours_are_searched_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def search(batches):
        for batch in batches:
            asked.add(len(batch))
            yield batch
    near = spark.createDataFrame([(c, r, (c + r) % 8) for c in range(8) for r in range(1, 5)], "chunk_id long, rank int, neighbor_id long")
    chunks = spark.createDataFrame([(c, 0, c // 2) for c in range(8)], "chunk_id long, dataset_idx long, doc_id long")
    own = chunks.select(F.floor(F.col("chunk_id") / 2).alias("sample_id"), "dataset_idx", "doc_id")
    got = rt.causal_neighbors(near.mapInPandas(search, near.schema), own, chunks, 2, k_save=3)
    assert got.count() == 24 and asked.value == 32
