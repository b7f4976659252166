import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from weftline.llm import prefixes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rebuild(rows, every=20, most=4):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - c % every, [])[:h] + ts[h:]
    return out


def plain_trie(rebuilt):
    """Every node by walking all prefixes of all conversations."""
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    rows, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children[p]
        leaves[p] = sum(leaves[q] for q in below) if below else 1
        saved[p] = sum(saved[q] for q in below) + ((len(members[p]) - 1) * len(WORDS.findall(p[-1][1])) if p else 0)
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(rebuilt[c]) == len(p)))
        rows.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_minima_against_scans():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        v = rng.integers(0, 6, n)
        table = prefixes.Minima(v)
        for d in range(7):
            for at in range(n):
                right = next((j for j in range(at, n) if v[j] < d), n)
                left = next((j for j in range(at, -1, -1) if v[j] < d), -1)
                assert table.next_below(np.array([at]), np.array([d]))[0] == right
                assert table.last_below(np.array([at]), np.array([d]))[0] == left
        for a in range(n):
            for b in range(a + 1, n + 1):
                assert table.lowest(np.array([a]), np.array([b]))[0] == v[a:b].min()


def test_conversations_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(prefixes.prefix_trie(df.repartition(5))) == plain_trie(plain_rebuild(rows))


@pytest.mark.parametrize("seed,least,turns", [(1, 4, 4096), (2, 3, 2), (3, 256, 1)])
def test_shared_prefixes_copies_and_blocks(spark, monkeypatch, seed, least, turns):
    """Few distinct texts, so nodes span many blocks of a few rows; sort keys of one or two turns go on in rounds."""
    monkeypatch.setattr(prefixes, "LEAST", least)
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        deep = rng.choice([1, 2, 3, 5, 9])
        for t in range(deep):
            rows.append((c * 3 if c % 4 else c * 20, rng.choice([t, t, None]), rng.choice(["user", None, ""]), rng.choice(["a b", "a b", "a b", "c", "", None])))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns_, lengths = prefixes.rebuild(prefixes.ordered_turns(df))
    assert rows_of(prefixes.trie(turns_, lengths, turns)) == plain_trie(plain_rebuild(rows))


def test_nulls_repeats_empty_and_clashing_columns(spark):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, None, None, None), (5, 2, "user", "x " * 50000), (20, 1, "user", "hello  there"), (20, 1, "user", "hello  there"),
            (21, 1, "user", "hello  there"), (-3, 1, "a", "b c"), (40, 1, "user", "")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, conv int, block int")
    assert rows_of(prefixes.prefix_trie(df)) == plain_trie({**plain_rebuild([r for r in rows if (r[0] or 0) >= 0]), -3: plain_negative(rows)})
    assert prefixes.prefix_trie(df.limit(0)).collect() == []


def plain_negative(rows):
    # the remainder of a negative id has its sign, so the base of -3 is 0, which has no turns here
    h = zlib.crc32(b"-3") % 4
    return [("a", "b c")][h:]


def test_all_conversations_without_turns(spark):
    """A conversation whose own turns are all replaced and whose base is absent is a member of the root alone."""
    bare = [c for c in range(1, 400) if c % 20 and c - c % 20 != 0 and zlib.crc32(str(c).encode()) % 4 == 3][:5]
    df = spark.createDataFrame([(c, 1, "user", "x") for c in bare], "conv_id bigint, turn bigint, role string, text string")
    ends = hashlib.sha256(",".join(map(str, bare)).encode()).hexdigest()
    assert rows_of(prefixes.prefix_trie(df)) == [(min(bare), 0, None, len(bare), 0, 1, 0, ends)]
