"""Python helpers of whole batches against plain arithmetic."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import minhash, wordpiece as wp
from weftline.functions.wordpiece import wordpiece
from weftline.operators import objectives as ob, scoring as sc


def test_signatures_are_those_of_plain_integers(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(chr(c) for c in rng.integers(32, 0x2FFF, n)) for n in (6, 7, 517, 518, 1400)]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1).orderBy("k").select(minhash.signature(F.col("t")).alias("s")).collect()]
    a, b = minhash.coefficients(100)
    for text, sig in zip(texts, got):
        hashes = []
        for i in range(len(text) - 5):
            h = 0
            for c in text[i:i + 5]:
                h = (h * minhash.BASE + ord(c)) % minhash.PRIME
            hashes.append(h)
        assert sig == [min((x * h + y) % minhash.PRIME for h in hashes) for x, y in zip(a, b)]


def test_a_remainder_of_nothing_is_zero(spark, monkeypatch):
    # the only shingle hash is 97 * (1 + BASE + ... ): with a = 1 the shift makes the sum a whole multiple of the prime
    h = 0
    for _ in range(5):
        h = (h * minhash.BASE + 97) % minhash.PRIME
    monkeypatch.setattr(minhash, "coefficients", lambda n: ([1] * n, [minhash.PRIME - h] * n))
    assert set(spark.range(1).select(minhash.signature(F.lit("aaaaaa")).alias("s")).first().s) == {0}


def test_words_are_digested_once(monkeypatch):
    calls, real = [], hashlib.md5
    monkeypatch.setattr(sc.hashlib, "md5", lambda x: calls.append(x) or real(x))
    got = np.stack(sc.hashed_words(8)()(pd.Series(["a b a", "B a", ""])))
    assert sorted(calls) == [b"a", b"b"]
    plain = np.zeros((3, 8))
    for i, words in enumerate(("a b a", "b a", "")):
        for w in words.split():
            d = int(real(w.encode()).hexdigest()[:8], 16)
            plain[i, d % 8] += 1.0 if d >> 31 else -1.0
    assert got == pytest.approx(plain / np.where((n := np.linalg.norm(plain, axis=1, keepdims=True)) == 0, 1, n))


def test_only_the_tokens_that_count_reach_the_worker(spark):
    df = spark.createDataFrame([(1, list(range(10, 400)))], "k long, ids array<bigint>")
    made = ob.span_corruption(df, "k", "ids", 50, 64, 32, 0.15, seed=8, bos=1, eos=2, first_sentinel=1000)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(ids" in plan
    row = made.first()
    kept = [x for x in row.text_enc if 10 <= x < 1000]
    gone = [x for x in row.text_dec if 10 <= x < 1000]
    assert row.truncated and sorted(kept + gone) == list(range(10, 60)) and len(row.text_enc) == 64 and len(row.labels) == 32


def test_pieces_are_sorted_natively(spark):
    docs = spark.createDataFrame([(1, "ab a b ab " * 6), (2, None), (3, "zz ab")], "k long, t string")
    vocab = spark.createDataFrame([("a",), ("##b",), ("b",)], "piece string")
    made = wordpiece(docs, "k", "t", vocab)
    assert "array_sort" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: r.pieces for r in made.collect()} == {1: ["a", "##b", "a", "b", "a", "##b"] * 6, 2: [], 3: ["[UNK]", "a", "##b"]}


WORDS = [(1, "Unaffable xyz un ## ##able"), (2, None), (3, " \n"), (4, "u" * 300 + " unable İß 😀un 😀"), (5, "un " * 700)]
CUT = {1: ["un", "##aff", "##able", "[UNK]", "un", "[UNK]", "##able"], 2: [], 3: [], 4: ["[UNK]", "un", "##able", "[UNK]", "😀", "##un", "😀"], 5: ["un"] * 700}


@pytest.mark.parametrize("largest", [wp.PIECES, 0])
def test_words_are_cut_the_same_by_a_held_and_by_a_joined_vocabulary(spark, monkeypatch, largest):
    monkeypatch.setattr(wp, "PIECES", largest)
    monkeypatch.setattr(wp, "WORDS", 4)
    monkeypatch.setattr(wp, "KEEP", 2)
    docs = spark.createDataFrame(WORDS, "k long, t string").coalesce(1)
    vocab = spark.createDataFrame([("un",), ("##aff",), ("##able",), ("##a",), ("##un",), ("😀",), (None,), ("un",)], "piece string")
    assert {r.k: r.pieces for r in wordpiece(docs, "k", "t", vocab).collect()} == CUT
    # rows of one key share the pieces of all of them, place by place
    twice = spark.createDataFrame([(7, "un 😀"), (7, "unable"), (None, "un"), (None, "x"), (8, "un")], "k long, t string")
    got = sorted(((r.k, r.pieces) for r in wordpiece(twice, "k", "t", vocab).collect()), key=str)
    shared = (7, ["un", "un", "##able", "😀"])
    assert got == sorted([shared, shared, (8, ["un"]), (None, ["[UNK]", "un"]), (None, ["[UNK]", "un"])], key=str)
    none = spark.createDataFrame([], "piece string")
    assert wordpiece(docs.filter("k = 1"), "k", "t", none).first().pieces == ["[UNK]"] * 5


def test_words_of_documents_are_not_shuffled(spark):
    docs = spark.createDataFrame(WORDS, "k long, t string")
    made = wordpiece(docs, "k", "t", spark.createDataFrame([("un",)], "piece string"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
