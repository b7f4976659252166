import random

import numpy as np

from weftline.llm import contamination


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_subsequences_by_bits():
    draw = random.Random(2)
    for _ in range(300):
        a = [draw.randrange(6) for _ in range(draw.randrange(1, 30))]
        b = [draw.randrange(6) for _ in range(draw.randrange(0, 60))]
        assert contamination.common_subsequence(a, b) == plain_lcs(a, b)


def test_planted_passages_of_the_documents(spark):
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    flat = {r.item_id: " ".join(r.text.split()) for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in flat.items() if t in " ".join((r.text or "").split())}
    rows = contamination.leaks(docs, items).collect()
    assert want and {(r.doc_id, r.item_id) for r in rows} == want
    assert all(r.kind == "copy" and r.covered == 1 for r in rows)


def test_copies_paraphrases_answers_and_clean_texts(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    item = [draw.choice(words) for _ in range(40)]
    long_item = [draw.choice(words) for _ in range(150)]

    def noise(n):
        return [draw.choice(words) for _ in range(n)]

    swapped = [w if i % 8 else draw.choice(words) for i, w in enumerate(item)]  # 35 of 40 in order
    loose = [w for i, w in enumerate(item) if i % 3]  # two thirds in order
    docs = [(i, " ".join(noise(200))) for i in range(60)]
    docs += [(100, " ".join(noise(90) + item + noise(70))), (101, " ".join(noise(33) + swapped)), (102, " ".join(noise(10) + long_item + noise(500))), (103, " ".join(noise(50) + loose + noise(50)).upper()),
             (104, None), (105, ""), (106, " ".join(item[:8] + noise(80)))]
    bench = [(7, " ".join(item), loose[3] + " " + loose[9]), (8, " ".join(long_item), None), (9, None, None), (10, "", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("kind", contamination.F.lit(0))
    found = contamination.leaks(df, spark.createDataFrame(bench, "item_id bigint, text string, answer string")).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in found} == {(100, 7, "copy"), (101, 7, "copy"), (102, 8, "copy"), (103, 7, "paraphrase")}
    wrong = spark.createDataFrame([(7, " ".join(item), "absent words")], "item_id bigint, text string, answer string")
    assert {r.doc_id for r in contamination.leaks(df, wrong).collect()} == {100, 101}
    kept = contamination.keep(df, wrong)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {100, 101}
    assert contamination.leaks(df.limit(0), wrong).count() == 0 and contamination.leaks(df, wrong.limit(0)).count() == 0


def test_every_copy_and_paraphrase_holds_a_probe_word():
    draw = random.Random(8)
    for _ in range(2000):
        words = [draw.randrange(1, 9) for _ in range(draw.randrange(1, 12))]
        answer = {draw.randrange(1, 13) for _ in range(draw.randrange(1, 6))}
        counts = np.array([draw.randrange(50) for _ in range(12)])
        passage = [draw.randrange(1, 13) for _ in range(draw.randrange(0, 16))]
        covered = plain_lcs(words, passage) / len(words)
        if covered >= contamination.COPY or covered >= contamination.PARAPHRASE and len(answer & set(passage)) / len(answer) >= contamination.ANSWER:
            assert contamination.probes(words, answer, counts) & set(passage)


def test_no_leak_depends_on_the_decomposition(spark, monkeypatch):
    monkeypatch.setattr(contamination, "COSINE", 2.0)  # latent vectors propose nothing
    draw = random.Random(9)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(400)]

    def noise(n):
        return [draw.choice(words) for _ in range(n)]

    items = [noise(n) for n in (13, 15, 21, 30, 32, 33, 60, 64, 90, 130) * 4]
    docs, want = [(i, " ".join(noise(150))) for i in range(40)], set()
    for i, item in enumerate(items):
        docs += [(1000 + i, " ".join(noise(draw.randrange(90)) + item + noise(40))), (2000 + i, " ".join(noise(50) + [w for j, w in enumerate(item) if j % 3 != 1] + noise(30)))]
        want |= {(1000 + i, i, "copy"), (2000 + i, i, "paraphrase")}
    bench = spark.createDataFrame([(i, " ".join(item), " ".join(item[0:6:3])) for i, item in enumerate(items)], "item_id bigint, text string, answer string")
    found = contamination.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in found} == want
