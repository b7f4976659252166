import math
import zlib

import numpy as np
import pytest

from weftline.llm import langid


def plain_sum(word, pieces, p):
    """Probability summed over all segmentations, by recursion over prefixes."""
    a = [1.0] + [0.0] * len(word)
    for t in range(1, len(word) + 1):
        for k in range(1, t + 1):
            piece = word[t - k:t]
            if piece in pieces:
                a[t] += a[t - k] * p[pieces[piece]]
            elif k == 1:
                a[t] += a[t - 1] * langid.FLOOR
    return a[-1]


def plain_counts(word, pieces, p):
    """Expected counts by listing every segmentation."""
    out = {}

    def cut(at, used, prob):
        if at == len(word):
            total[0] += prob
            for u in used:
                out[u] = out.get(u, 0) + prob
            return
        for k in range(1, len(word) - at + 1):
            piece = word[at:at + k]
            if piece in pieces:
                cut(at + k, [*used, piece], prob * p[pieces[piece]])
            elif k == 1:
                cut(at + 1, used, prob * langid.FLOOR)

    total = [0.0]
    cut(0, [], 1.0)
    return {k: v / total[0] for k, v in out.items()}


def test_scores_and_counts_against_all_segmentations():
    found = langid.Pieces(langid.piece_vocabulary())
    number = {p: i for i, p in enumerate(found.pieces)}
    rng = np.random.default_rng(1)
    table = rng.random((len(number), 3))
    table /= table.sum(axis=0)
    stacked = np.vstack([table, np.full((1, 3), langid.FLOOR)])
    words = ["the", "straße", "a", "éclair", "日本q", "internationalisation", "x" * 70, "‱"]
    got = langid.log_scores(words, found, stacked)
    for i, w in enumerate(words):
        marked = langid.MARK + w
        parts = [marked[k:k + langid.CUT + 1] for k in range(0, len(marked), langid.CUT + 1)]
        for j in range(3):
            assert got[i, j] == pytest.approx(sum(math.log(plain_sum(p, number, table[:, j])) for p in parts), rel=1e-9)
    some = ["the", "straße", "éclair"]
    counts = langid.expected_counts(some, np.array([2.0, 1.0, 3.0]), found, stacked[:, :1])
    want = np.zeros(len(number))
    for w, n in zip(some, (2.0, 1.0, 3.0)):
        for piece, c in plain_counts(langid.MARK + w, number, table[:, 0]).items():
            want[number[piece]] += n * c
    assert counts == pytest.approx(want, rel=1e-6, abs=1e-12)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert set(rows) == set(truth)
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(rows[d].held_out == (d in set(held)) for d in truth)
    assert sum(rows[d].lang_pred == truth[d] for d in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows.values())
    # labels of held-out rows, and any other column, change nothing
    blind = docs.withColumn("lang", langid.F.when(langid.F.crc32(langid.F.encode(langid.F.col("doc_id").cast("string"), "UTF-8")) % 3 != 1, langid.F.col("lang"))).drop("source")
    assert {r.doc_id: r.lang_pred for r in langid.identify(blind).collect()} == {d: r.lang_pred for d, r in rows.items()}


def test_nulls_signs_and_untrained_models(spark):
    df = spark.createDataFrame([(None, "the cat", "en", 1.0), (1, None, "en", 1.0), (2, "12 -- 34", "en", 1.0), (2, "", None, 1.0)], "doc_id bigint, text string, lang string, score double")
    langs, table = ["de", "en"], np.full((len(langid.Pieces.of(langid.piece_vocabulary()).pieces), 2), 1e-4)
    out = langid.predict(df, langs, table, langid.piece_vocabulary()).collect()
    assert [(r.lang_pred, r.score) for r in out if r.doc_id is not None] == [("und", 0.0)] * 3
    assert [(r.lang_pred, r.score) for r in out if r.doc_id is None] == [("de", 0.5)]
    nothing = langid.identify(df.filter("lang is null")).collect()
    assert [(r.lang_pred, r.held_out) for r in nothing] == [("und", zlib.crc32(b"2") % 3 == 1)]
    assert langid.identify(df.limit(0)).count() == 0
