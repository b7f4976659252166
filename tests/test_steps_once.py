"""Costly steps that a query shares between its parts are run once."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline import plans
from weftline.functions import text as tx
from weftline.operators import index, setjoin

SMALL = "/root/testdata/sf0.001"


def test_chunks_are_cut_once(spark):
    merged = plans.QUERIES["merge_chunk_tables"](spark, SMALL)
    # the three parts read the chunks that were written, and cut none themselves
    assert not re.search(r"Generate explode", merged._jdf.queryExecution().optimizedPlan().toString())
    assert {r.kind for r in merged.select("kind").distinct().collect()} == {"sampled", "train", "valid"}


def test_rows_are_ranged_once_for_pairwise_accuracy(spark, monkeypatch):
    placed, calls = index._placed, []
    monkeypatch.setattr(index, "_placed", lambda df, order: calls.append(df.columns) or placed(df, order))
    for name in ("pairwise_accuracy", "pairwise_accuracy_graded"):
        calls.clear()
        assert plans.QUERIES[name](spark, SMALL).count() > 0
        # distinct accuracies of a group, and the rows
        assert len(calls) == 2


def test_sets_are_written_twice_at_most_and_copies_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "b", "a"]), (3, ["a", "b", "c", "d"]), (4, []), (5, ["x"])], "doc_id long, s array<string>")
    written, stage = [], setjoin.stage
    monkeypatch.setattr(setjoin, "stage", lambda df, label="stage": written.append((label, df.columns)) or stage(df, label))
    pairs, members = setjoin.similarity_join(df, "doc_id", F.col("s"), 0.5)
    assert [tuple(r) for r in pairs.collect()] == [(1, 3, 0.75)]
    assert {tuple(r) for r in members.collect()} == {(1, 1), (2, 1), (3, 3), (5, 5)}
    # as read, and one of each class
    assert [label for label, names in written if "elements" in names or "token" in names and label == "tokens"] == ["sets", "classes"]


def test_a_key_of_two_sets_names_one_class(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["x", "y"]), (2, ["q"])], "doc_id long, s array<string>")
    sets, members = setjoin.classes(df, "doc_id", F.col("s"))
    assert sorted(r.node for r in sets.collect()) == [1, 2] and members.count() == 3


def test_elements_of_one_set_are_not_kept_or_joined(spark, monkeypatch):
    rows = [(k, [f"{k}-{i}" for i in range(20)] + (["p", "q"] * 15 if k < 4 else [])) for k in range(40)]
    rows += [(100, [f"1-{i}" for i in range(20)] + ["p"])]
    written, stage = {}, setjoin.stage

    def staged(df, label="stage"):
        written[label] = stage(df, label)
        return written[label]
    monkeypatch.setattr(setjoin, "stage", staged)
    pairs, _ = setjoin.similarity_join(spark.createDataFrame(rows, "k long, e array<string>"), "k", F.col("e"), 0.5)
    assert [(r.left, r.right, round(r.sim, 6)) for r in pairs.collect()] == [(1, 100, round(21 / 22, 6))]
    held = {r.node: len(r.elements) for r in written["classes"].collect()}
    assert held == {0: 2, 1: 22, 2: 2, 3: 2, 100: 21}


@pytest.mark.parametrize("again", [True, False])
@pytest.mark.parametrize("copies,twice", [(setjoin.COPIES, True), (setjoin.COPIES, False), (0, False)])
def test_sets_in_many_slices_and_blocks(spark, monkeypatch, again, copies, twice):
    """Text keys, copies left out in both ways, a set beyond a block, a row that comes twice, a null key, sets written or hashed again."""
    for name, value in (("TOKENS", 16), ("BLOCK", 3), ("PAIRS", 4), ("COPIES", copies)):
        monkeypatch.setattr(setjoin, name, value)
    rnd = random.Random(3)
    sets = [sorted({f"e{rnd.randrange(12)}" for _ in range(rnd.randrange(1, 12))}) for _ in range(60)]
    sets += [[f"x{i}" for i in range(40)], [f"x{i}" for i in range(30)]] + sets[:9]
    rows = [(f"k{i:03}", s) for i, s in enumerate(sets)] + [(None, sets[0]), ("k900", []), ("k901", None)]
    rows += [(None, ["only"]), ("k003", sets[3])] if twice else []
    pairs, members = setjoin.similarity_join(spark.createDataFrame(rows, "k string, e array<string>"), "k", F.col("e"), 0.5, again)
    first = {}
    for k, s in rows:
        if k is not None and s:
            first.setdefault(frozenset(s), k)
    want = {(min(i, j), max(i, j)): round(len(a & b) / len(a | b), 9) for (a, i), (b, j) in itertools.combinations(first.items(), 2) if 2 * len(a & b) >= len(a | b)}
    assert len(want) > 5 and ("k060", "k061") in want
    got = [(r.left, r.right, round(r.sim, 9)) for r in pairs.collect()]
    assert {(a, b): s for a, b, s in got} == want and len(got) == len(want)
    named = sorted(((r.key, r.node) for r in members.collect()), key=str)
    assert named == sorted(((k, first.get(frozenset(s))) for k, s in rows if s), key=str)


def test_a_set_is_sent_to_few_bundles(spark, monkeypatch):
    pairs = spark.createDataFrame([(a, b) for a in range(30) for b in range(a)] + [(100, 101), (200, 201)], "left long, right long").persist()
    bundles = setjoin.bundled(pairs, pairs.count(), 0).collect()
    assert len(bundles) == pairs.count() and len({(r.slot, r.i, r.j) for r in bundles}) == 1
    monkeypatch.setattr(setjoin, "PAIRS", 40)
    cut = setjoin.bundled(pairs, pairs.count(), 0).collect()
    held = {}
    for r in cut:
        held.setdefault((r.slot, r.i, r.j), []).append((r.left, r.right))
    assert sorted(p for h in held.values() for p in h) == sorted((r.left, r.right) for r in bundles)
    # 435 pairs of one neighbourhood are 4 by 4 squares
    assert len(held) >= 10 and max(map(len, held.values())) < 120
    assert sum(len({n for p in h for n in p}) for h in held.values()) < 30 * 8


def test_shingles_of_words_are_hashes_of_distinct_runs(spark):
    texts = [(1, "a b c a b c a"), (2, "a b"), (3, ""), (4, None), (5, "b a c")]
    made = {r.k: r.s for r in spark.createDataFrame(texts, "k long, t string").select("k", setjoin.word_shingles(tx.words(F.col("t")), 3).alias("s")).collect()}
    assert {k: len(set(s or [])) for k, s in made.items()} == {1: 3, 2: 1, 3: 0, 4: 0, 5: 1}
    assert len(made[1]) == 3 and not set(made[5]) & set(made[1])
