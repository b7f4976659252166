import random
import re
import zlib
from collections import Counter

import pytest

from weftline.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_variants(rows):
    seen = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if n >= 5 and len(w) >= 6}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and sum((Counter(v) - Counter(w)).values()) < 2 and distance(v, w) == 1] for w in words}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= 5 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_one_edit():
    rng = random.Random(4)
    for _ in range(4000):
        a, b = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(2)]
        assert variants.one_edit(a, b) == (distance(a, b) == 1)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(variants.variants(docs.repartition(3))) == plain_variants([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed,block,per_cell", [(1, 4, 256), (2, 3, 0), (3, 1024, 0)])
def test_chains_ties_and_blocks(spark, monkeypatch, seed, block, per_cell):
    """Small blocks, and as many letter classes as there are, on words that differ by few letters; counts in powers make chains."""
    monkeypatch.setattr(variants, "BLOCK", block)
    monkeypatch.setattr(variants, "PER_CELL", per_cell)
    rng = random.Random(seed)
    texts = []
    for _ in range(90):
        word = "".join(rng.choice("abé") for _ in range(rng.randrange(5, 9)))
        texts += [word.replace("a", "A", rng.randrange(2)) + rng.choice([" ", "7", "× "])] * rng.choice([1, 5, 6, 30, 150, 900])
    rng.shuffle(texts)
    rows = [(d if d % 7 else None, "".join(texts[d::60])) for d in range(60)] + [(70, None), (71, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    assert rows_of(variants.variants(df)) == plain_variants(rows)
    assert variants.variants(df.limit(0)).collect() == []


def test_repeated_rows_and_a_long_text(spark):
    rows = [(1, "colour " * 40000), (2, "color " * 3 + "colours " * 7), (2, "color " * 3 + "colours " * 7), (3, "Colour×colour"), (4, "a" * 3000 + " " + "a" * 2999)] * 1
    rows += [(4, "a" * 3000 + " " + "a" * 2999)] * 5
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(variants.variants(df)) == plain_variants(rows)
