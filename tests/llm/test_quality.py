import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from weftline.llm import perplexity, quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


class PlainModel:
    """Modified Kneser-Ney over characters, by dictionaries."""

    def __init__(self, texts):
        counts = {4: Counter()}
        for t in texts:
            for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""):
                s = "\2\2\2" + w + "\3"
                counts[4].update(s[i - 3:i + 1] for i in range(3, len(s)))
        for k in (3, 2, 1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        self.counts, self.cut, self.tot, self.off = counts, {}, {}, {}
        for k, grams in counts.items():
            t = [sum(c == n for c in grams.values()) for n in (1, 2, 3, 4)]
            if min(t[:3]) <= 0:
                cut = [0.5, 1.0, 1.5]
            else:
                y = t[0] / (t[0] + 2 * t[1])
                cut = [min(max(i + 1 - (i + 2) * y * t[i + 1] / t[i], 0.0), i + 1.0) for i in range(3)]
            self.cut[k] = lambda c, cut=cut: cut[min(c, 3) - 1]
            self.tot[k], self.off[k] = defaultdict(float), defaultdict(float)
            for g, c in grams.items():
                self.tot[k][g[:-1]] += c
                self.off[k][g[:-1]] += self.cut[k](c)

    def p(self, g):
        k = len(g)
        if not k:
            return 1.0 / (len(self.counts[1]) + 1)
        if g[:-1] not in self.tot[k]:
            return self.p(g[1:])
        c, tot = self.counts[k].get(g, 0), self.tot[k][g[:-1]]
        own = max(c - self.cut[k](c), 0.0) / tot if c else 0.0
        return own + self.off[k][g[:-1]] / tot * self.p(g[1:])

    def nll(self, text):
        total = n = 0
        for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
            s = "\2\2\2" + w + "\3"
            for i in range(3, len(s)):
                total, n = total - math.log(self.p(s[i - 3:i + 1])), n + 1
        return total / n if n else None


ODD = [None, "", " \n ", "a b c d e a b c d e f", "x\nx\n \n\nx", "## a|b <c> $5 & 100%\n## a|b <c> $5 & 100%", "ß ü é 日本", "word\x0bother\x1cword"]


def test_counts_and_perplexity_against_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:120]
    docs += [(10_000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    model, plain = perplexity.build(df), PlainModel([t for _, t in docs])
    rows = {r.doc_id: r for r in quality.measures(df, model).collect()}
    for d, t in docs:
        assert tuple(rows[d][c] for c in quality.COUNTS) == plain_counts(t), t
        want = plain.nll(t)
        assert rows[d].nll == (want if want is None else pytest.approx(want, rel=1e-9))
    scorer = perplexity.Model(model)
    strange, lengths = scorer.score(["zzqq", "日本語", "the"])
    for w, got in zip(["zzqq", "日本語", "the"], strange):
        s = "\2\2\2" + w + "\3"
        assert got == pytest.approx(sum(math.log(plain.p(s[i - 3:i + 1])) for i in range(3, len(s))), rel=1e-9)
    assert lengths.tolist() == [5, 4, 4]


def test_a_model_beyond_memory_is_searched_file_by_file(spark, monkeypatch):
    df = spark.createDataFrame([("some words to count here",), ("and some more words there",)], "text string")
    folder = perplexity.build(df)
    whole = perplexity.Model(folder).score(["words", "other"])[0].tolist()
    monkeypatch.setattr(perplexity, "HELD", 0)
    assert perplexity.Model(folder).score(["words", "other"])[0].tolist() == whole


def test_verdicts(spark):
    draw = random.Random(3)
    syllables = ["an", "er", "on", "the", "re", "in", "st", "tion"]

    def prose(n):
        return " ".join("".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4))) for _ in range(n))

    docs = [(i, prose(80 + i % 50), "en") for i in range(200)]
    docs += [(300, "".join(chr(draw.randrange(33, 127)) + " " * (i % 6 == 0) for i in range(600)), "en"), (301, "too short", "en"), (302, "one two three four five six seven " * 9, "en"), (303, None, None), (304, prose(60), None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("kept", quality.F.lit(1)).withColumn("n_words", quality.F.lit(0))
    rows = {r.doc_id: r for r in quality.judge(df).collect()}
    assert not rows[300].base_failed and not rows[300].kept
    assert rows[301].base_failed and rows[302].base_failed and rows[303].base_failed and rows[303].perplexity is None
    assert sum(rows[i].kept for i in range(200)) >= 198 and rows[304].kept
    out = quality.keep(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(d for d, r in rows.items() if r.kept)
    assert quality.judge(df.limit(0)).count() == 0


def test_memory_of_counting_grams_does_not_follow_the_batch():
    """6 MB of words that are all different, as one batch: counted whole, and with few of its characters spelled out at once."""
    rng = random.Random(3)
    words = [f"{rng.getrandbits(36):x}" for _ in range(600_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words[i:i + 200]) for i in range(0, len(words), 200)])], ["text"])
    tracemalloc.start()
    total = sum(sum(out.column(1).to_pylist()) for out in perplexity._counted(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == sum(len(w) + 1 for w in words)
    assert peak < 200e6
