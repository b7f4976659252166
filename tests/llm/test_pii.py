import hashlib
import math
import re
from collections import defaultdict

import pytest

from weftline.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PLAIN["card"] = r"[0-9]([\x20\-]?[0-9])+"


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain_spans(text):
    found = [(m.start(), list(PLAIN).index(k), k, m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m.group())]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


EDGES = ["a@b.co_m@z.q x@y@z.com", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567, +123 +1234567890123456", None, "",
         "a@b.cc é+33 1 23 45 67 89", "5500 0000 0000 0004-1 5500000000000004", "1" * 3000, "a." * 3000 + "@" + "b." * 2000 + "c", "+1 " * 50 + "x", "..@a.b", "12@3.4.5.6 7.8"]


def test_base_spans_against_plain_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(EDGES)], "doc_id bigint, text string"))
    got = {r.doc_id: [s for s in r.spans.split(",") if s] for r in pii.spans(docs).select("doc_id", pii.digest(pii.F.col("base")).alias("spans")).collect()}
    want = {r.doc_id: plain_spans(r.text) for r in docs.collect()}
    assert got == want


def plain_terms(texts):
    """Disclosing terms by nested loops over distinct texts."""
    beside, holds, entities = defaultdict(set), defaultdict(set), defaultdict(set)
    places = []
    for d, text in texts:
        spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in plain_spans(text))]
        for w in text.split():
            holds[re.sub(r"^[\W_]+|[\W_]+$", "", w.lower())].add(text)
        for a, b, k in spans:
            entity = f"{k}:{text[a:b].lower()}"
            entities[entity].add(text)
            words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            left = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text[:a])][-pii.NEAR:]
            right = [(b + m.start(), b + m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text[b:])][:pii.NEAR]
            for s, e in left + right:
                core = re.sub(r"^[\W_]+|[\W_]+$", "", text[s:e])
                at = s + text[s:e].find(core) if core else s
                if len(core) > 1 and all(y <= at or x >= at + len(core) for x, y, _ in spans):
                    beside[core.lower(), entity].add(text)
                    places.append((d, entity, core.lower(), at, at + len(core)))
            assert words is not None
    n, out = len({t for _, t in texts}), defaultdict(dict)
    for d, entity, term, a, b in places:
        n_te, n_t, n_e = len(beside[term, entity]), len(holds[term]), len(entities[entity])
        ic = math.log2(n / n_e)
        if n_te < pii.SUPPORT or ic <= 0:
            continue
        pmi = math.log2(n_te * n / (n_t * n_e))
        kind = "removed" if pmi >= pii.REMOVE * ic else "generalised" if pmi >= pii.GENERALISE * ic else None
        if kind:
            out[d][a, b] = max(out[d].get((a, b), ""), kind)
    return {d: sorted((a, b, k) for (a, b), k in v.items()) for d, v in out.items()}


@pytest.mark.parametrize("asked", [0, 50_000])
def test_disclosing_terms_against_nested_loops(spark, monkeypatch, asked):
    monkeypatch.setattr(pii, "ASKED", asked)
    texts = [(i, f"word{i} reaches jane.roe@mail.example.com, chief zyx'wi\\ne of plot{i} today") for i in range(5)]
    texts += [(10 + i, f"plain text {i} about chief matters") for i in range(30)] + [(50, texts[0][1]), (51, "zyx'wi\\ne sells well"), (60, "call +1 555 123 4567 now zyx'wi\\ne")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = plain_terms(texts)
    assert any(k == "removed" for v in want.values() for *_, k in v) and any(k == "generalised" for v in want.values() for *_, k in v)
    got = {r.doc_id: sorted((s.start, s.end, s.kind) for s in r.spans if s.rank >= 4) for r in pii.spans(docs).collect()}
    assert {d: v for d, v in got.items() if v} == want
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "jane.roe" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == texts[5][1]
    assert clean[60] == "call [PHONE] now zyx'wi\\ne"


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    rows = [(None, "a@b.cc", "x", 1), (1, None, "y", 2), (1, None, "y", 2), (2, "", "z", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, base int")
    out = queries.pii.spans(docs).collect()
    assert sorted((str(r.doc_id), len(r.spans)) for r in out) == [("1", 0), ("1", 0), ("2", 0), ("None", 1)]
    clean = pii.sanitise(docs).collect()
    assert sorted((str(r.doc_id), str(r.text), r.spans) for r in clean) == [("1", "None", "y"), ("1", "None", "y"), ("2", "", "z"), ("None", "[EMAIL]", "x")]
    assert pii.spans(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(pii.F.sha2(pii.F.lit(""), 256)).first()[0]
