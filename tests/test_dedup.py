"""Near-duplicates and evaluation n-grams against plain Python."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import minhash
from weftline.functions import text as tx
from weftline.operators import decontaminate as dc, dedup, rolling, setjoin


def shingles(t):
    return {t[i:i + 5] for i in range(len(t) - 5)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "zeta"]
    docs = []
    for base in range(12):
        text = " ".join(rnd.choice(words) + str(rnd.randrange(40)) for _ in range(60))
        docs.append(text)
        for copy in range(base % 4):
            parts = text.split()
            for _ in range(1 + copy * 2):
                parts[rnd.randrange(len(parts))] = "changed"
            docs.append(" ".join(parts))
    docs += [docs[0]] * 40 + ["tiny", ""]
    rnd.shuffle(docs)
    return dict(enumerate(docs))


def buckets(docs):
    a, b = minhash.coefficients(100)
    out = {}
    for i, t in docs.items():
        codes, hs = [ord(c) for c in t], set()
        for s in range(len(codes) - 5):
            h = 0
            for c in codes[s:s + 5]:
                h = (h * minhash.BASE + c) % minhash.PRIME
            hs.add(h)
        if hs:
            sig = [min((x * h + y) % minhash.PRIME for h in hs) for x, y in zip(a, b)]
            for band in range(10):
                out.setdefault((band, tuple(sig[band * 10:band * 10 + 10])), []).append(i)
    return {k: sorted(v) for k, v in out.items() if len(v) > 1}


@pytest.mark.parametrize("rounds", [1, 2, -1])
def test_star_rounds_match_a_plain_loop(spark, corpus, rounds):
    df = spark.createDataFrame(list(corpus.items()), "id long, text string")
    got = {(r.main, r.other): round(r.sim, 9) for r in dedup.near_duplicate_pairs(df, "id", "text", heuristic_iter=rounds).collect()}
    first = {}
    want = {}
    for i, t in sorted(corpus.items()):
        if len(t) > 5:
            if t in first:
                want[(first[t], i)] = 1.0
            first.setdefault(t, i)
    single = {i: t for t, i in first.items()}
    for members in buckets(single).values():
        step, left = 0, list(members)
        while len(left) > 1 and step != rounds:
            main, rest = left[0], left[1:]
            sims = {o: jaccard(shingles(corpus[main]), shingles(corpus[o])) for o in rest}
            want.update({(main, o): round(s, 9) for o, s in sims.items() if s > 0.5})
            left, step = [o for o in rest if sims[o] <= 0.5], step + 1
    assert got == want


def test_hot_copies_give_linear_pairs(spark, corpus):
    df = spark.createDataFrame(list(corpus.items()), "id long, text string")
    assert dedup.exact_copies(df.filter("length(text) > 5"), "id", "text").count() == 40


@pytest.mark.parametrize("seed", range(3))
def test_groups_are_connected_components(spark, seed):
    rnd = random.Random(seed)
    edges = {(rnd.randrange(80), rnd.randrange(80)) for _ in range(45)} | {(200 + i, 201 + i) for i in range(30)} | {(500, 500 + i) for i in range(1, 60)}
    edges = [(a, b) for a, b in edges if a != b]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in dedup.connected_groups(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for e in edges for x in e}


def test_groups_respect_the_threshold(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.69), (4, 5, 0.7)], "main long, other long, sim double")
    assert {r.node: r.root for r in dedup.group_duplicates(pairs).collect()} == {1: 1, 2: 1, 4: 4, 5: 4}


def words_of(t):
    return [(m.group(), m.start()) for m in re.finditer(r"\w+", t.lower())]


def first_hit(text, grams, lengths, top):
    w = words_of(text)
    tokens = [x for x, _ in w]
    for i in range(len(w) - top + 1):
        for n in itertools.chain([top], lengths):
            seq = " ".join(tokens[i:i + n])
            if seq in grams:
                return w[i][1], seq
    if len(w) > top:
        for n in lengths:
            if n == top:
                continue
            for i in range(len(w) - top, len(w) - n + 1):
                seq = " ".join(tokens[i:i + n])
                if seq in grams:
                    return w[i][1], seq
    return None


@pytest.fixture(scope="module")
def tasks_and_docs():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    tasks = [" ".join(rnd.choice(vocab) for _ in range(n)) for n in (20, 9, 13, 5, 8, 15)]
    docs = []
    for d in range(40):
        sents = []
        for s in range(rnd.randrange(1, 30)):
            body = [rnd.choice(vocab) for _ in range(rnd.randrange(5, 25))]
            if rnd.random() < 0.25:
                body[2:2] = rnd.choice(tasks).split()
            sents.append((", " if rnd.random() < 0.3 else " ").join(body) + rnd.choice(".!?"))
        docs.append(" ".join(sents))
    docs.append(" ".join((tasks[1] + ". " + "filler text goes here and on, ") * 1 + "x " * 150 + "." for _ in range(14)))
    return tasks, dict(enumerate(docs))


def grams_of(tasks):
    out = set()
    for t in tasks:
        w = [x for x, _ in words_of(t)]
        if 8 <= len(w) < 13:
            out.add(" ".join(w))
        out |= {" ".join(w[i:i + 13]) for i in range(len(w) - 12)}
    return out


def test_frequency_counts_without_overlap(spark, tasks_and_docs):
    tasks, docs = tasks_and_docs
    grams = grams_of(tasks)
    lengths = sorted({len(g.split()) for g in grams})
    want = dict.fromkeys(grams, 0)
    for t in docs.values():
        while (hit := first_hit(t, grams, lengths, 13)) is not None:
            want[hit[1]] += 1
            t = t[hit[0] + len(hit[1]) + 1:]
    table = dc.ngram_table(spark.createDataFrame([(t,) for t in tasks], "text string"), "text")
    df = spark.createDataFrame(list(docs.items()), "id long, text string")
    got = {r.ngram: r.freq for r in dc.ngram_frequency(df, "id", "text", table).collect()}
    assert got == want
    assert sum(want.values()) > 10


def test_pieces_match_a_work_list(spark, tasks_and_docs):
    tasks, docs = tasks_and_docs
    grams = grams_of(tasks)
    lengths = sorted({len(g.split()) for g in grams})

    def pieces(text):
        todo, out = [text], []
        while todo:
            t = todo.pop(0)
            hit = first_hit(t, grams, lengths, 13)
            if hit is None:
                out.append(t)
                continue
            p = hit[0] - 200
            while p > 0 and t[p] not in ".!?":
                p -= 1
            if p > 0 and p + 1 > 200:
                out.append(t[:p + 1])
            p = hit[0] + len(hit[1]) + 200
            while p < len(t) and t[p] not in ".!?":
                p += 1
            if len(t) - p - 1 > 200:
                todo.append(t[p + 1:])
        return out
    table = dc.ngram_table(spark.createDataFrame([(t,) for t in tasks], "text string"), "text")
    df = spark.createDataFrame(list(docs.items()), "id long, text string")
    got = {}
    for r in dc.decontaminate(df, "id", "text", table, ["id"]).orderBy("split_id").collect():
        got.setdefault(r.id, []).append((r.outcome, r.split_id, r.text))
    seen = set()
    for i, t in docs.items():
        want = pieces(t)
        outcome = "ignored" if not want else "too_many" if len(want) > 10 else "split" if len(want) > 1 else "trimmed" if len(want[0]) < len(t) else "kept"
        seen.add(outcome)
        kept = want if outcome in ("kept", "trimmed", "split") else [None]
        assert got[i] == [(outcome, f"tasks-{i + 1:010d}-{k:04d}" if x is not None else None, x) for k, x in enumerate(kept)], i
    assert {"kept", "split", "trimmed"} <= seen


def plain_pieces(text, grams, lengths, margin=200, least=200, top=13):
    """Pieces by a work list that splits what is left into words anew."""
    todo, out = [text], []
    while todo:
        t = todo.pop(0)
        hit = first_hit(t, grams, lengths, top)
        if hit is None:
            out.append(t)
            continue
        p = hit[0] - margin
        while p > 0 and t[p] not in ".!?":
            p -= 1
        if p > 0 and p + 1 > least:
            out.append(t[:p + 1])
        p = hit[0] + len(hit[1]) + margin
        while p < len(t) and t[p] not in ".!?":
            p += 1
        if len(t) - p - 1 > least:
            todo.append(t[p + 1:])
    return out


@pytest.mark.parametrize("exact", [rolling.EXACT, 0])
def test_whole_documents_table_against_plain_scans(spark, monkeypatch, exact):
    """Frequency, pieces and places over all of sf0.001; with no room for the sorted array, by the bits of the table."""
    monkeypatch.setattr(rolling, "EXACT", exact)
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    tasks = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    # every tenth document holds a passage again, cut inside words and across sentences
    docs |= {d: f"{t} {tasks[d % len(tasks)]}. {t} x{tasks[d % 7]}, {tasks[d % 5]}" for d, t in docs.items() if d % 10 == 0 and t}
    grams = grams_of(tasks)
    lengths = sorted({len(g.split()) for g in grams})
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    table = dc.ngram_table(spark.createDataFrame([(t,) for t in tasks], "text string"), "text")
    want, places = dict.fromkeys(grams, 0), []
    for d, text in docs.items():
        w = [x for x, _ in words_of(text or "")]
        places += [(d, g, i) for n in lengths for i in range(len(w) - n + 1) if (g := " ".join(w[i:i + n])) in grams]
        t = text or ""
        while (hit := first_hit(t, grams, lengths, 13)) is not None:
            want[hit[1]] += 1
            t = t[hit[0] + len(hit[1]) + 1:]
    assert {r.ngram: r.freq for r in dc.ngram_frequency(df, "doc_id", "text", table).collect()} == want
    assert sorted(tuple(r) for r in dc.match_ngrams(df, "doc_id", "text", table).collect()) == sorted(places)
    got = {}
    for r in dc.decontaminate(df, "doc_id", "text", table, ["doc_id"]).collect():
        got.setdefault(r.doc_id, []).append((r.split_id or "", r.outcome, r.text))
    assert len(got) == len(docs) and sum(want.values()) > 50
    for d, text in docs.items():
        pieces = plain_pieces(text or "", grams, lengths)
        kept = pieces if pieces and len(pieces) <= 10 else [None]
        assert [t for _, _, t in sorted(got[d])] == ([text] if text is None else kept), d


def test_scans_that_go_on_inside_words():
    """Offsets inside words, at the end, and letters whose lower case is longer."""
    rnd = random.Random(8)
    for trial in range(300):
        text = "".join(rnd.choice(["a", "b", "ab", " ", " ", ", ", "İ" if trial % 3 == 0 else "c", ". "]) for _ in range(60))
        w = [x for x, _ in words_of(text)]
        grams = {" ".join(w[i:i + n]) for n in (2, 3) for i in range(0, len(w) - n + 1, 3)} | {"b c", "a b", "b ab c"}
        grams = {g for g in grams if len(g.split()) > 1}
        lengths, t, want = sorted({len(g.split()) for g in grams}), text, []
        while (hit := first_hit(t, grams, lengths, 3)) is not None:
            want.append(hit[1])
            t = t[hit[0] + len(hit[1]) + 1:]
        assert [g for _, _, g in rolling.matches(text, grams, lengths, 3, lambda b, s, q: s + len(q) + 1)] == want


@pytest.mark.parametrize("threshold,block", [(0.3, 2), (0.5, 1024), (0.8, 3), (1.0, 1024)])
def test_similarity_join_against_all_pairs(spark, monkeypatch, threshold, block):
    """Random sets with common and rare elements, copies, empty and null ones; small blocks cut the common elements."""
    monkeypatch.setattr(setjoin, "BLOCK", block)
    rnd = random.Random(6)
    sets = []
    for i in range(120):
        if i and rnd.random() < 0.6:
            made = set(rnd.choice(sets)) ^ {f"e{rnd.randrange(200)}" for _ in range(rnd.randrange(0, 4))}
        else:
            made = {f"e{rnd.randrange(200)}" for _ in range(rnd.randrange(0, 14))}
        sets.append(sorted(made | ({"the"} if rnd.random() < 0.9 else set())))
    rows = [*enumerate(sets), (500, None), (501, [])]
    pairs, members = setjoin.similarity_join(spark.createDataFrame(rows, "k long, e array<string>"), "k", F.col("e"), threshold)
    first, want = {}, {}
    for k, e in rows:
        if e:
            first.setdefault(frozenset(e), k)
    for a, i in first.items():
        for b, j in first.items():
            if i < j and len(a & b) / len(a | b) >= threshold - 1e-12:
                want[i, j] = round(len(a & b) / len(a | b), 9)
    assert {(r.left, r.right): round(r.sim, 9) for r in pairs.collect()} == want
    assert {r.key: r.node for r in members.collect()} == {k: first[frozenset(e)] for k, e in rows if e}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_recall_of_bucket_pairs_against_the_exact_join(spark, folder):
    """Pairs of distinct texts over 0.5 that the buckets list, and those that end in one group, against all there are."""
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").dropDuplicates(["text"])
    exact, members = setjoin.similarity_join(docs, "doc_id", tx.shingles(F.col("text"), 5), 0.5)
    true = {(r.left, r.right) for r in exact.filter("sim > 0.5").collect()}
    pairs = dedup.near_duplicate_pairs(docs, "doc_id", "text").persist()
    listed = {(r.main, r.other) for r in pairs.collect()}
    roots = {r.node: r.root for r in dedup.connected_groups(pairs, "main", "other").collect()}
    grouped = sum(a in roots and roots[a] == roots.get(b) for a, b in true)
    print(folder, len(true), len(true & listed), grouped)
    assert len(true) >= 20 and grouped / len(true) >= 0.9
