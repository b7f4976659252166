import hashlib
import random

import numpy as np

from weftline.llm import suffix


def plain(docs, length=100):
    """Removed ranges by a set of all windows in order."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i:i + length]
            if window in seen:
                gone[i:i + length] = True
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        out[doc] = (len(data), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest())
    return out


def told(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeats(df).collect()}


def test_documents_against_all_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(w[1] for w in want.values()) > 0
    assert told(docs.repartition(5)) == want


def test_borders_periods_and_crowds(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CROWD", 20)
    draw = random.Random(3)

    def noise(n):
        return "".join(draw.choice("abcdefgh é\0") for _ in range(n))

    passage, second = noise(260), noise(120)
    texts = [noise(draw.randrange(50)) + passage[draw.randrange(40):200 + draw.randrange(60)] + noise(draw.randrange(80)) for _ in range(60)]
    texts += ["-" * 700, "ab" * 150 + noise(20), "-" * 99, "-" * 101, "", None, second, second[:-1], noise(30) + second[5:118], passage + second + passage, noise(5000)]
    docs = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert told(df) == plain(docs)
    left = {r.doc_id: r.text for r in suffix.remove(df).collect()}
    assert left[texts.index(None) * 3] is None and len(left) == len(texts)


def test_windows_of_a_block_against_a_set():
    draw = random.Random(4)
    parts = [bytes(draw.choice(b"ab\0") for _ in range(draw.randrange(1, 60))) for _ in range(80)]
    got = suffix.equal_windows(parts, 7)
    seen, want = set(), []
    for p in parts:
        for i in range(len(p) + 1):
            w = p[i:i + 7]
            want.append(len(w) == 7 and w in seen)
            if len(w) == 7:
                seen.add(w)
    assert got.tolist() == want


def test_long_texts_cross_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 300)
    draw = random.Random(6)
    a = "".join(draw.choice("xyzw ") for _ in range(2000))
    docs = [(1, a), (2, a[137:1500]), (3, a[:250] + a[900:1400])]
    flat = np.frombuffer(a.encode(), np.uint8)
    assert suffix.runs(flat[:399])[3].sum() == 300
    assert told(spark.createDataFrame(docs, "doc_id bigint, text string")) == plain(docs)


def test_repeated_and_missing_keys(spark):
    draw = random.Random(1)
    t = "".join(draw.choice("abcdef") for _ in range(150))
    df = spark.createDataFrame([(None, t, 1), (5, t, 2), (5, t, 3), (5, "x" + t, 4)], "doc_id bigint, text string, doc int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix.repeats(df).collect())
    assert got[0][:2] in (("5", 150), ("5", 151)) and len(got) == 4
    assert got[0] == got[1] and ("None", 150, 0) in got
    assert {g[2] for g in got if g[0] == "5"} == {150}
    assert suffix.repeats(df.limit(0)).count() == 0
