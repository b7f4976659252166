"""Queries over near-duplicates and evaluation n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import minhash, text as tx
from ..operators import decontaminate as dc, dedup, setjoin
from ..session import stage
from . import views
from .registry import joined, query, r6

_A, _B = minhash.coefficients(100)
_P, _M = minhash.PRIME, minhash.BASE

SIGS = f"""codes AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i, length(text) AS len FROM single WHERE length(text) > 5),
rolled AS (SELECT doc_id, i, len, unicode(ch)::BIGINT AS c1, unicode(lead(ch, 1) OVER w)::BIGINT AS c2, unicode(lead(ch, 2) OVER w)::BIGINT AS c3,
  unicode(lead(ch, 3) OVER w)::BIGINT AS c4, unicode(lead(ch, 4) OVER w)::BIGINT AS c5 FROM codes WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
hashes AS (SELECT DISTINCT doc_id, ((((((((c1 * {_M} + c2) % {_P}) * {_M}) + c3) % {_P}) * {_M} + c4) % {_P}) * {_M} + c5) % {_P} AS h FROM rolled WHERE i <= len - 5),
perms AS (SELECT unnest(range(0, 100)) AS k, unnest({_A}) AS a, unnest({_B}) AS b),
sig AS (SELECT doc_id, k, min((a * h + b) % {_P}) AS m FROM hashes, perms GROUP BY ALL),
members AS (SELECT doc_id, k // 10 AS band, md5(string_agg(m::VARCHAR, ',' ORDER BY k)) AS bucket FROM sig GROUP BY ALL),
mains AS (SELECT band, bucket, min(doc_id) AS main FROM members GROUP BY ALL HAVING count(*) > 1),
candidates AS (SELECT DISTINCT main, doc_id AS other FROM members JOIN mains USING (band, bucket) WHERE doc_id <> main)"""

COPIES = """copies AS (SELECT * FROM (SELECT min(doc_id) OVER (PARTITION BY text) AS main, doc_id AS other FROM documents WHERE length(text) > 5) WHERE main <> other),
single AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT other FROM copies))"""

PAIRS = f"""{COPIES}, {SIGS},
sh AS (SELECT DISTINCT doc_id, substr(text, i, 5) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 4)) AS i FROM documents
  WHERE doc_id IN (SELECT main FROM candidates UNION SELECT other FROM candidates))),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT main, other, count(*) AS x FROM candidates JOIN sh a ON a.doc_id = main JOIN sh b ON b.doc_id = other AND a.s = b.s GROUP BY ALL),
pairs AS (SELECT main, other, x::DOUBLE / (m.n + o.n - x) AS sim FROM shared JOIN sizes m ON m.doc_id = main JOIN sizes o ON o.doc_id = other
  WHERE x::DOUBLE / (m.n + o.n - x) > 0.5 UNION ALL SELECT main, other, 1.0::DOUBLE FROM copies)"""

GROUPS = f"""RECURSIVE {PAIRS},
e AS (SELECT main AS a, other AS b FROM pairs WHERE sim >= 0.7 UNION SELECT other, main FROM pairs WHERE sim >= 0.7),
walk AS (SELECT a AS node, a AS seen FROM e UNION SELECT walk.node, e.b FROM walk JOIN e ON e.a = walk.seen),
groups AS (SELECT node, min(seen) AS root FROM walk GROUP BY 1)"""


@query("shingles", "SELECT doc_id, CASE WHEN length(text) > 5 THEN len(list_distinct(list_transform(range(1, length(text) - 4), lambda i: substr(text, i, 5)))) ELSE 0 END AS n FROM documents")
def _(t):
    return views.documents(t).select("doc_id", F.size(tx.shingles(F.col("text"))).cast("bigint").alias("n"))


OVERLAP = """WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS a FROM documents),
i AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS b FROM benchmark),
x AS (SELECT doc_id, item_id, count(*) AS x FROM (SELECT doc_id, unnest(a) AS w FROM d) JOIN (SELECT item_id, unnest(b) AS w FROM i) USING (w) GROUP BY ALL)
SELECT doc_id, item_id, round(x / (len(a) + len(b) - x)::DOUBLE, 6) AS by_union, round(x / least(len(a), len(b))::DOUBLE, 6) AS by_min, round(x / greatest(len(a), len(b))::DOUBLE, 6) AS by_max
FROM x JOIN d USING (doc_id) JOIN i USING (item_id)"""


@query("set_overlap", OVERLAP)
def _(t):
    # every document with every item that shares a word, by an inverted index of the items
    def listed(df, key, size):
        return df.select(key, F.array_distinct(tx.words(F.col("text"))).alias("w")).select(key, F.size("w").alias(size), F.explode("w").alias("w"))
    items = listed(t.benchmark, "item_id", "nb")
    met = listed(views.documents(t), "doc_id", "na").join(items, "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("x"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    base = {"union": F.col("na") + F.col("nb") - F.col("x"), "min": F.least("na", "nb"), "max": F.greatest("na", "nb")}
    return met.select("doc_id", "item_id", *[r6(F.col("x") / b).alias(f"by_{m}") for m, b in base.items()])


@query("set_similarity_join", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS node, s FROM s WHERE len(s) > 0),
c AS (SELECT node, s, len(s) AS n FROM m WHERE doc_id = node),
e AS (SELECT node, n, unnest(s) AS g FROM c),
x AS (SELECT a.node AS l, b.node AS r, a.n AS na, b.n AS nb, count(*) AS x FROM e a JOIN e b ON a.g = b.g AND a.node < b.node AND 2 * a.n >= b.n AND 2 * b.n >= a.n GROUP BY ALL)
SELECT 'link' AS kind, l AS node, r AS other, round(x / (na + nb - x)::DOUBLE, 6) AS sim FROM x WHERE x / (na + nb - x)::DOUBLE >= 0.5
UNION ALL SELECT 'member', node, doc_id, 1.0 FROM m""")
def _(t):
    pairs, members = setjoin.similarity_join(views.documents(t), "doc_id", setjoin.word_shingles(tx.words(F.col("text")), 3), 0.5, again=True)
    links = pairs.select(F.lit("link").alias("kind"), F.col("left").alias("node"), F.col("right").alias("other"), r6(F.col("sim")).alias("sim"))
    return links.unionByName(members.select(F.lit("member").alias("kind"), "node", F.col("key").alias("other"), F.lit(1.0).alias("sim")))


@query("minhash_signatures", f"WITH single AS (SELECT * FROM documents), {SIGS} SELECT doc_id, string_agg(m::VARCHAR, ',' ORDER BY k) AS sig FROM sig GROUP BY 1")
def _(t):
    docs = views.documents(t).filter(F.length("text") > 5)
    return docs.select("doc_id", joined(minhash.signature(F.col("text"))).alias("sig"))


@query("minhash_candidates", f"WITH single AS (SELECT * FROM documents), {SIGS} SELECT main, other FROM candidates")
def _(t):
    return dedup.minhash_lsh_candidates(t.documents, "doc_id", "text")


@query("near_duplicate_pairs", f"WITH {PAIRS} SELECT main, other, round(sim, 6) AS sim FROM pairs")
def _(t):
    return dedup.near_duplicate_pairs(t.documents, "doc_id", "text").withColumn("sim", r6(F.col("sim")))


def _groups(t):
    return dedup.group_duplicates(dedup.near_duplicate_pairs(t.documents, "doc_id", "text"))


@query("duplicate_groups", f"WITH {GROUPS} SELECT node, root FROM groups")
def _(t):
    return _groups(t)


@query("near_duplicate_removal", f"""WITH {GROUPS}
SELECT lang, count(*) AS docs, sum(length(text))::BIGINT AS chars, count(*) FILTER (node IS NULL OR node = root) AS kept_docs,
  sum(CASE WHEN node IS NULL OR node = root THEN length(text) ELSE 0 END)::BIGINT AS kept_chars
FROM documents LEFT JOIN groups ON node = doc_id GROUP BY lang""")
def _(t):
    kept = dedup.remove_group_duplicates(t.documents, _groups(t), "doc_id")

    def counted(df, pre):
        return df.groupBy("lang").agg(F.count("*").alias(pre + "docs"), F.sum(F.length("text")).alias(pre + "chars"))
    return counted(t.documents, "").join(counted(kept, "kept_"), "lang")


WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
GRAMS = f"""b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
ngrams AS (SELECT DISTINCT ngram, len(string_split(ngram, ' ')) AS n FROM (
  SELECT unnest(CASE WHEN len(w) < 8 THEN [] WHEN len(w) < 13 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) END) AS ngram FROM b))"""
MATCHES = GRAMS + f""", d AS (SELECT doc_id, text, {WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM ngrams)),
matches AS (SELECT doc_id, ngram, i - 1 AS word_pos FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS ngram FROM places) JOIN ngrams USING (ngram))"""


@query("ngram_table", f"WITH {GRAMS} SELECT ngram, n FROM ngrams")
def _(t):
    return dc.ngram_table(t.benchmark, "text").withColumn("n", F.col("n").cast("bigint"))


@query("match_ngrams", f"WITH {MATCHES} SELECT * FROM matches")
def _(t):
    return dc.match_ngrams(t.documents, "doc_id", "text", dc.ngram_table(t.benchmark, "text")).withColumn("word_pos", F.col("word_pos").cast("bigint"))


OFFSET = f"""offs AS (SELECT m.*, text, length(array_to_string(w[1:word_pos], '')) + length(array_to_string((string_split_regex(lower(text), '[\\p{{L}}\\p{{N}}_]+'))[1:word_pos + 1], '')) AS start
  FROM matches m JOIN d USING (doc_id))"""


@query("words_with_positions", f"""
WITH d AS (SELECT doc_id, lower(text) AS low, {WORDS} AS w, string_split_regex(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS g FROM documents),
e AS (SELECT doc_id, unnest(w) AS word, unnest(g[1:len(w)]) AS gap, unnest(range(0, len(w))) AS i FROM d)
SELECT doc_id, i, word, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word))::BIGINT AS start FROM e""")
def _(t):
    return tx.word_rows(views.documents(t), "doc_id", "text")


@query("split_around_match", f"""WITH {MATCHES}, {OFFSET},
cut AS (SELECT doc_id, word_pos, ngram, start, CASE WHEN start > 200 THEN regexp_extract(substr(text, 1, start - 199), '(?s)^(.*[.!?])', 1) ELSE '' END AS lft,
  regexp_extract(substr(text, start + length(ngram) + 201), '(?s)^[^.!?]*[.!?](.*)$', 1) AS rgt FROM offs)
SELECT doc_id, word_pos, start::BIGINT AS start, length(CASE WHEN length(lft) > 1 THEN lft ELSE '' END) AS left_len, md5(rgt) AS right_md5 FROM cut""")
def _(t):
    m = dc.match_ngrams(t.documents, "doc_id", "text", dc.ngram_table(t.benchmark, "text"))
    # each distinct place of a text is located once
    m = m.join(t.documents.select("doc_id", "text"), "doc_id").withColumn("start", tx.word_offset(F.col("text"), F.col("word_pos")))
    left, right = dc.split_around_match(F.col("text"), F.col("start"), F.length("ngram"))
    return m.select("doc_id", F.col("word_pos").cast("bigint").alias("word_pos"), F.col("start").cast("bigint").alias("start"),
                    F.length(left).cast("bigint").alias("left_len"), F.md5(right).alias("right_md5"))


@query("ngram_frequency")
def _(t):
    freq = dc.ngram_frequency(t.documents, "doc_id", "text", dc.ngram_table(t.benchmark, "text"))
    return freq.withColumn("rare", F.col("freq") < 10)


@query("decontaminate")
def _(t):
    grams = dc.ngram_table(t.benchmark, "text")
    rare = stage(dc.rare_ngrams(dc.ngram_frequency(t.documents, "doc_id", "text", grams)), "rare")
    return dc.decontaminate(t.documents.select("doc_id", "text"), "doc_id", "text", rare, ["doc_id"]).select("doc_id", "outcome", "split_id", "text")
