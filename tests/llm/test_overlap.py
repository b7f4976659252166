import random
import re

import pyarrow as pa
import pytest

from weftline.llm import overlap

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain_set(text, words=4):
    found = WORD.findall((text or "").translate(UPPER))
    if not found:
        return frozenset()
    k = min(words, len(found))
    return frozenset(tuple(found[i:i + k]) for i in range(len(found) - k + 1))


def plain_components(rows, words=4, least=85):
    """All pairs, then union of the linked."""
    sets = [plain_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in groups[find(i)] if rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_shingle_sets():
    texts = ["a b c d e", "A B c\td\n e", "a b", "a  b", "", None, "d c b a a b c d", "x x x x x x", "é É b c d"]
    grams, bounds = overlap.shingle_sets(pa.array(texts), 4)
    sets = [frozenset(grams[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    for i, s in enumerate(texts):
        for j, t in enumerate(texts):
            assert len(sets[i] & sets[j]) == len(plain_set(s) & plain_set(t))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(overlap.components(docs.repartition(5))) == plain_components(rows)


@pytest.mark.parametrize("seed,hot,rounds,few", [(1, 2, 1, 2), (2, 32, 6, 16), (3, 4, 2, 1)])
def test_near_copies_shared_passages_and_repeats(spark, monkeypatch, seed, hot, rounds, few):
    """Groups at the edge of the similarity, a passage most documents share, chains; few rounds leave pairs to blocks of a few rows."""
    monkeypatch.setattr(overlap, "HOT", hot)
    monkeypatch.setattr(overlap, "FEW", few)
    monkeypatch.setattr(overlap, "ROWS", 8)
    monkeypatch.setattr(overlap.links, "__defaults__", (85, rounds))
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = []
    for base in range(6):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 30, 60]))]
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.5:
                copy += passage.split()
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                text = copy
    rows += [(900, passage), (901, passage + " x"), (902, "one two"), (903, "One  two"), (904, "two one"), (None, None), (905, ""), (906, " \n")]
    rows += [(7, rows[20][1]), (None, rows[30][1]), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(overlap.components(df.repartition(3))) == plain_components(rows)


def test_empty_table_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{i % 5000}x{i}" for i in range(30000))
    rows = [(1, long), (2, long + " tail"), (3, long[: len(long) // 2]), (4, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "doc_id bigint, text string, n int, node int, col int, grams string")
    assert rows_of(overlap.components(df)) == plain_components(rows)
    assert overlap.components(df.limit(0)).collect() == []
    none = spark.createDataFrame([(1, None), (2, " ")], "doc_id bigint, text string")
    assert rows_of(overlap.components(none)) == [(1, 0, 1), (2, 0, 2)]
