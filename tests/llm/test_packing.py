import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftline.llm import packing, tokens


def best_bins(pieces, capacity):
    """Fewest bins by trying every placement."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(bins)
            return
        for b in {v: k for k, v in enumerate(bins)}.values():
            if bins[b] + pieces[i] <= capacity:
                bins[b] += pieces[i]
                place(i + 1, bins)
                bins[b] -= pieces[i]
        bins.append(pieces[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_plan_against_every_placement():
    draw = random.Random(2)
    worse = 0
    for _ in range(60):
        capacity = draw.randrange(10, 40)
        pieces = [draw.randrange(1, capacity + 1) for _ in range(draw.randrange(1, 12))]
        counts = np.bincount(pieces, minlength=capacity + 1)
        plan = packing.plan(counts, capacity)
        assert all(sum(p) <= capacity for p, _ in plan)
        held = np.zeros(capacity + 1, int)
        for p, copies in plan:
            for x in p:
                held[x] += copies
        assert held.tolist() == counts.tolist()
        least = best_bins(pieces, capacity)
        assert packing.lower_bound(counts, capacity) <= least
        worse += sum(c for _, c in plan) - least
    assert worse == 0


def test_completions_are_undominated_and_fit():
    counts = [0, 0, 1, 2, 0, 1, 1, 0, 0, 1]
    for fill in packing._fills(counts, [2, 3, 5, 6, 9], 11, 11, 50):
        assert sum(fill) <= 11
        for x in (2, 3, 5, 6, 9):
            if counts[x] > fill.count(x):
                assert sum(fill) + x > 11


def test_documents_are_cut_and_packed(spark):
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()] + [(9001, None), (9002, ""), (None, "a b"), (None, "a b")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, length string")
    out = packing.pack(packing.cut_pieces(df, 512, with_ids=True), 512)
    rows = out.collect()
    want = {}
    for d, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        head = len(ids) % 512 or 512
        cuts = [0, *range(head, len(ids) + 1, 512)] if len(ids) > 512 else [0, len(ids)]
        want[d] = [(i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert {d: sorted(v) for d, v in got.items() if d is not None} == {d: v for d, v in want.items() if d is not None}
    assert got[None] == want[None] * 2
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 512
    counts = np.bincount([r.length for r in rows], minlength=513)
    assert len(bins) <= packing.lower_bound(counts, 512) + 1
    whole = {r.sequence_id: len(r.ids) for r in packing.sequences(out).collect()}
    assert whole == {s: sum(n for _, n in p) for s, p in bins.items()}


def test_empty_table_and_bad_lengths(spark):
    assert packing.pack(packing.cut_pieces(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(4096,)], "length bigint"))
