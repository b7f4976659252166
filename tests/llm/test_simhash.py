import random

import numpy as np
import pytest
import xxhash

from weftline.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest key reachable over pairs at most 2 bits apart, by comparing all pairs."""
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    want = plain_components(fps)
    got = simhash.components(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{fps[k]:016x}", want[k]) for k in fps}
    assert len(got) == len(fps)


def test_crowded_neighbourhoods_use_the_ball_and_lose_no_link(spark):
    draw = random.Random(5)
    centre = draw.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:  # a crowd around one point, one chain, and strangers
        x = draw.choice(sorted(fps))
        fps.add(x ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    fps |= {draw.getrandbits(64) for _ in range(200)}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    edges = [(r.left, r.right) for r in simhash.links(nodes).collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 2 for a, b in edges)
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = plain_components({f: f & mask for f in signed})
    assert {f: find(f) for f in signed} == want


def test_allocation_is_the_cheapest_of_all():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 500, (50, 3)).astype(float)
    widths, means = [22, 21, 21], [3.0, 5.0, 2.0]
    plan, cost = simhash.allocate(counts, widths, means)

    def price(i, t, c):
        return 0.0 if t < 0 else c + [0, widths[i], widths[i] + widths[i] * (widths[i] - 1) / 2][t] * (1 + means[i])

    for r in range(50):
        options = {(a, b, c): sum(price(i, t, counts[r, i]) for i, t in enumerate((a, b, c))) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0}
        assert cost[r] == pytest.approx(min(options.values()))
        assert options[tuple(plan[r].tolist())] == pytest.approx(cost[r])


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c", 1), (1, None, 2), (2, "", 3), (3, " \n", 4), (4, "A B c", 5), (4, "A B c", 5)]
    out = simhash.components(spark.createDataFrame(rows, "doc_id bigint, text string, fp int")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in out if r.doc_id is not None) == [(False, 1, 1), (False, 2, 1), (False, 3, 1), (False, 4, 4), (False, 4, 4)]
    assert [r.component_id for r in out if r.doc_id is None] == [4]
    assert simhash.components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
