"""Queries over splits, packing, blending, sharding, balancing and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import assembly as asm
from ..operators.index import with_group_index, with_running_totals
from ..session import stage
from . import views
from .registry import joined, query, r6

I = views.IDS

SENTS = """sents AS (SELECT doc_id, lang, list_transform(s, lambda x: len(list_filter(string_split_regex(x, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))) AS sizes FROM (
  SELECT doc_id, lang, list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents))"""


def sents(t):
    s = tx.split_sentences(F.col("text"))
    return stage(views.documents(t).select("doc_id", "lang", F.transform(s, lambda x: F.size(tx.blank_tokens(x)).cast("bigint")).alias("sizes")), "sentences")


@query("split_sentences", """SELECT doc_id, i, s FROM (SELECT doc_id, unnest(s) AS s, unnest(range(0, len(s))) AS i FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents))""")
def _(t):
    return views.documents(t).select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("i", "s")).withColumn("i", F.col("i").cast("bigint"))


@query("split_sentences_keep", """SELECT doc_id, len(s)::BIGINT AS n, list_sum(list_transform(s, lambda x: length(x)))::BIGINT AS chars FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?][ \\t\\n\\r]+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)""")
def _(t):
    s = tx.split_sentences(F.col("text"), keep_newlines=True)
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("bigint").alias("n"),
                                                             F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)).cast("bigint").alias("chars"))


@query("split_table", """WITH n AS (SELECT count(*) AS n FROM documents),
b AS (SELECT n, round_even(0.90::DOUBLE * n, 0)::BIGINT AS x, round_even(0.90::DOUBLE * n, 0)::BIGINT + round_even(0.09::DOUBLE * n, 0)::BIGINT AS y,
  round_even(0.90::DOUBLE * n, 0)::BIGINT + round_even(0.09::DOUBLE * n, 0)::BIGINT + round_even(0.01::DOUBLE * n, 0)::BIGINT AS z FROM n),
i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents)
SELECT doc_id, row_idx, CASE WHEN row_idx < x - (z - n) THEN 'train' WHEN row_idx < y - (z - n) THEN 'valid' ELSE 'test' END AS split FROM i, b""")
def _(t):
    return asm.split_table(t.documents.select("doc_id"), ["doc_id"], "90,9,1")


@query("document_order", "SELECT doc_id, e AS epoch, row_number() OVER (ORDER BY e = 2, md5('3|' || e || '|' || doc_id), e, doc_id) - 1 AS order_idx FROM documents, range(0, 3) r(e)")
def _(t):
    return asm.document_order(t.documents.select("doc_id"), "doc_id", 3, 3, True).withColumn("epoch", F.col("epoch").cast("bigint"))


@query("sample_order", """WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS sample_idx, count(*) OVER () AS n FROM documents)
SELECT doc_id, sample_idx, row_number() OVER (ORDER BY sample_idx >= n * 2 // 3, md5('9|' || sample_idx), sample_idx) - 1 AS pos FROM s""")
def _(t):
    return asm.sample_order(t.documents.select("doc_id"), ["doc_id"], 9, t.documents.count() * 2 // 3)


PACK = """sz AS (SELECT doc_id, ids, len(ids) AS n FROM doc_ids WHERE len(ids) > 0),
tot AS (SELECT sum(n)::BIGINT AS t, count(*) AS docs FROM sz),
ep AS (SELECT t, greatest((docs * 2 * {s} + 1 + t - 1) // t, 1) AS e, docs * 2 AS want FROM tot),
apart AS (SELECT *, e > 1 AND want - ((e - 1) * t - 1) // {s} < floor(0.80 * ((t - 1) // {s})) AS last_apart FROM ep),
inst AS (SELECT doc_id, ids, n, epoch, sum(n) OVER (ORDER BY (epoch = e - 1 AND last_apart), md5('{seed}|' || epoch || '|' || doc_id), epoch, doc_id ROWS UNBOUNDED PRECEDING) - n AS start
  FROM sz, apart, range(0, 99) r(epoch) WHERE epoch < e),
tok AS (SELECT doc_id, start, start + unnest(range(0, n)) AS p, unnest(ids) AS id FROM inst),
smp AS (SELECT p // {s} AS j, p, id, doc_id, start FROM tok UNION ALL SELECT p // {s} - 1, p, id, doc_id, start FROM tok WHERE p % {s} = 0 AND p > 0),
packed AS (SELECT j AS sample_idx, list(id ORDER BY p) AS tokens, list(DISTINCT {{'s': start, 'd': doc_id}}) AS dd FROM smp, apart WHERE j < (e * t - 1) // {s} GROUP BY j)"""


@query("pack_samples", f"""WITH {I}, {PACK.format(s=200, seed=17).replace('{{', '{').replace('}}', '}')}
SELECT sample_idx::BIGINT AS sample_idx, md5(array_to_string(tokens, ',')) AS tokens, array_to_string(list_transform(list_sort(dd), lambda x: x.d), ',') AS doc_ids FROM packed""")
def _(t):
    docs = views.doc_ids(t).filter(F.size("ids") > 0)
    out = asm.pack_samples(docs, "doc_id", "ids", 200, docs.count() * 2, seed=17)
    return out.select("sample_idx", F.md5(joined(F.col("tokens"))).alias("tokens"), joined(F.col("doc_ids")).alias("doc_ids"))


@query("sample_chunks", f"""WITH {I}, {PACK.format(s=200, seed=17).replace('{{', '{').replace('}}', '}')}
SELECT (sample_idx * 4 + c)::BIGINT AS chunk_id, sample_idx::BIGINT AS sample_idx, md5(array_to_string(tokens[c * 50 + 1:c * 50 + 50], ',')) AS tokens,
  array_to_string(list_transform(list_sort(dd), lambda x: x.d), ',') AS doc_ids FROM packed, range(0, 4) r(c)""")
def _(t):
    docs = views.doc_ids(t).filter(F.size("ids") > 0)
    samples = asm.pack_samples(docs, "doc_id", "ids", 200, docs.count() * 2, seed=17)
    out = asm.sample_chunks(samples, "sample_idx", "tokens", "doc_ids", 50, 4)
    return out.select("chunk_id", "sample_idx", F.md5(joined(F.col("tokens"))).alias("tokens"), joined(F.col("doc_ids")).alias("doc_ids"))


@query("boundary_range_join", f"""WITH {I}, d AS (SELECT doc_id, len(ids) AS n, sum(len(ids)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - len(ids) AS start FROM doc_ids),
p AS (SELECT unnest(range(0, (SELECT sum(n)::BIGINT FROM d), 500)) AS pos)
SELECT pos, doc_id, (pos - start)::BIGINT AS token_offset FROM p JOIN d ON pos >= start AND pos < start + n""")
def _(t):
    sizes = views.doc_ids(t).select("doc_id", F.size("ids").cast("bigint").alias("n"))
    placed = with_running_totals(sizes, ["doc_id"], {"start": F.col("n")})
    total = sizes.agg(F.sum("n")).first()[0]
    points = t.spark.range(0, total, 500).withColumnRenamed("id", "pos")
    return asm.boundary_range_join(points, "pos", placed, "start", "n").select("pos", "doc_id", (F.col("pos") - F.col("start")).alias("token_offset"))


W = "('0x' || substr(md5('1|' || {e} || '|' || doc_id || '|' || {k}), 1, 8))::BIGINT"
TARGET = "CASE WHEN " + W + " % 5 = 0 THEN 2 + " + W + " % 63 ELSE 64 END"


@query("pack_sentences", f"""WITH RECURSIVE {SENTS},
ok AS (SELECT doc_id, sizes, len(sizes) AS m FROM sents WHERE len(sizes) >= 2 AND NOT list_bool_or(list_transform(sizes, lambda s: s > 512))),
want AS (SELECT count(*) AS w FROM documents),
walk AS (SELECT e, doc_id, sizes, m, 0 AS i, 0 AS k, 0 AS s, 0::BIGINT AS len, {TARGET.format(e='e', k='0')} AS target, NULL::INT AS o_k, NULL::INT AS o_s, NULL::INT AS o_e, NULL::BIGINT AS o_t FROM ok, range(0, 2) r(e)
  UNION ALL SELECT e, doc_id, sizes, m, i + 1, CASE WHEN cut THEN k + 1 ELSE k END, CASE WHEN cut THEN i + 1 ELSE s END, CASE WHEN cut THEN 0 ELSE l END,
    CASE WHEN cut THEN {TARGET.format(e='e', k='(k + 1)')} ELSE target END, CASE WHEN cut THEN k END, CASE WHEN cut THEN s END, CASE WHEN cut THEN i + 1 END, CASE WHEN cut THEN target END
  FROM (SELECT *, m - i - 1 = 0 OR (l >= target AND m - i - 1 > 1 AND i + 1 - s >= 2) AS cut FROM (SELECT *, len + sizes[i + 1] AS l FROM walk WHERE i < m))),
spans AS (SELECT e, doc_id, o_k AS span_idx, o_s AS start_at, o_e AS end_at, o_t AS target FROM walk WHERE o_k IS NOT NULL),
used AS (SELECT * FROM spans, want WHERE e = 0 OR (SELECT count(*) FROM spans WHERE e = 0) < w * 10)
SELECT e AS epoch, doc_id, span_idx::BIGINT AS span_idx, start_at::BIGINT AS start_at, end_at::BIGINT AS end_at, target::BIGINT AS target,
  row_number() OVER (ORDER BY md5('1|' || e || '|' || doc_id || '|' || span_idx), e, doc_id, span_idx) - 1 AS pos FROM used""")
def _(t):
    # asks for more samples than one epoch gives
    out = asm.pack_sentences(sents(t), "doc_id", "sizes", 64, t.documents.count() * 10, short_prob=0.2, seed=1)
    return out.select(F.col("epoch").cast("bigint").alias("epoch"), "doc_id", F.col("span_idx").cast("bigint").alias("span_idx"),
                      F.col("start").alias("start_at"), F.col("end").alias("end_at"), "target", "pos")


BLOCKS = f"""WITH RECURSIVE {SENTS},
ok AS (SELECT doc_id, sizes, len(sizes) AS m, 128 - (doc_id % 11) AS target FROM sents WHERE len(sizes) >= 2 AND NOT list_bool_or(list_transform(sizes, lambda s: s > 512))),
walk AS (SELECT doc_id, sizes, m, target, 0 AS i, 0 AS s, 0::BIGINT AS len, NULL::INT AS o_s, NULL::INT AS o_e FROM ok
  UNION ALL SELECT doc_id, sizes, m, target, i + 1, CASE WHEN cut THEN i + 1 ELSE s END, CASE WHEN cut THEN 0 ELSE l END, CASE WHEN cut THEN s END, CASE WHEN cut THEN i + 1 END
  FROM (SELECT *, m - i - 1 = 0 OR (l >= target AND m - i - 1 >= 2 AND i + 1 - s >= 2) AS cut FROM (SELECT *, len + sizes[i + 1] AS l FROM walk WHERE i < m))),
blocks AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, o_s) - 1 AS block_id, o_s::BIGINT AS start_at, o_e::BIGINT AS end_at FROM walk WHERE o_s IS NOT NULL)"""


@query("pack_blocks", f"{BLOCKS} SELECT * FROM blocks")
def _(t):
    docs = sents(t).withColumn("title", F.col("doc_id") % 11)
    out = asm.pack_blocks(docs, "doc_id", "sizes", "title", 128)
    return out.select("doc_id", "block_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query("pack_blocks_epochs", f"""{BLOCKS}, e AS (SELECT *, unnest(range(0, greatest(1, ((SELECT count(*) FROM documents) * 9 + (SELECT count(*) FROM blocks) - 1) // (SELECT count(*) FROM blocks)))) AS epoch FROM blocks)
SELECT *, row_number() OVER (ORDER BY md5('1|' || epoch || '|' || block_id), epoch, block_id) - 1 AS pos FROM e""")
def _(t):
    docs = sents(t).withColumn("title", F.col("doc_id") % 11)
    out = asm.pack_blocks(docs, "doc_id", "sizes", "title", 128, num_samples=t.documents.count() * 9)
    return out.select("doc_id", "block_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.col("epoch").cast("bigint").alias("epoch"), "pos")


WEIGHTS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}


@query("blend", """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT count(*) * 2 AS w FROM documents),
k AS (SELECT doc_id, lang, n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r FROM documents JOIN n USING (lang)),
e AS (SELECT doc_id, lang, epoch, r + epoch * n AS sample_idx FROM (SELECT *, unnest(range(0, 2 + (SELECT w FROM w) // n)) AS epoch FROM k)),
p AS (SELECT *, row_number() OVER (ORDER BY (sample_idx + 0.5)::DOUBLE / (CASE lang WHEN 'en' THEN 0.5 WHEN 'fr' THEN 0.2 WHEN 'de' THEN 0.2 ELSE 0.1 END)::DOUBLE, lang) - 1 AS pos FROM e)
SELECT pos, lang, sample_idx, epoch::BIGINT AS epoch, doc_id FROM p WHERE pos < (SELECT w FROM w)""")
def _(t):
    # twice the documents: every dataset runs out and starts over
    out = asm.blend(t.documents.select("doc_id", "lang"), "lang", [F.col("doc_id")], WEIGHTS, t.documents.count() * 2)
    return out.withColumn("epoch", F.col("epoch").cast("bigint"))


@query("blend_exact", """WITH RECURSIVE n AS (SELECT count(*) // 2 AS n FROM documents),
g AS (SELECT -1::BIGINT AS pos, 0 AS d, 0::BIGINT AS k, [0, 0, 0, 0]::BIGINT[] AS c
  UNION ALL SELECT pos + 1, x, c[x], list_transform(range(1, 5), lambda i: c[i] + (i = x)::BIGINT) FROM (
    SELECT pos, c, list_position(e, list_max(e)) AS x FROM (SELECT pos, c, list_transform(range(1, 5), lambda i: ([0.5, 0.2, 0.2, 0.1]::DOUBLE[])[i] * greatest(pos + 1, 1)::DOUBLE - c[i]) AS e FROM g, n WHERE pos + 1 < n))),
r AS (SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS d, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents)
SELECT pos, (g.d - 1)::BIGINT AS dataset, g.k AS sample_idx, doc_id FROM g JOIN r ON r.d = g.d AND r.k = g.k WHERE pos >= 0""")
def _(t):
    rows = with_group_index(t.documents.select("doc_id", "lang"), ["lang"], [F.col("doc_id")], "sample_idx")
    names = list(WEIGHTS)
    dataset = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")) - 1
    plan = asm.blend_exact(t.spark, list(WEIGHTS.values()), t.documents.count() // 2)
    held = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    data = rows.join(held, "lang").select(dataset.alias("dataset"), F.col("sample_idx").alias("_row"), "_n", "doc_id")
    sizes = data.select("dataset", "_n").distinct()
    # a dataset that runs out starts over
    placed = plan.join(sizes, "dataset").withColumn("_row", F.col("sample_idx") % F.col("_n")).drop("_n")
    return placed.join(data.drop("_n"), ["dataset", "_row"]).drop("_row")


@query("blend_plan", """WITH p AS (SELECT lang, count(*)::DOUBLE AS w FROM documents GROUP BY 1), s AS (SELECT lang, w / (SELECT sum(w) FROM p) AS share FROM p)
SELECT lang, round(share, 6) AS share, split, target::BIGINT AS target, ceil(target * share * 1.005::DOUBLE)::BIGINT AS request FROM s, (VALUES ('train', 1000), ('valid', 100), ('test', 10)) v(split, target)""")
def _(t):
    plan = t.documents.groupBy("lang").agg(F.count("*").cast("double").alias("w"))
    out = asm.blend_plan(plan, "lang", "w", {"train": 1000, "valid": 100, "test": 10})
    return out.withColumn("share", r6(F.col("share"))).withColumn("target", F.col("target").cast("bigint"))


@query("shard_sequential", """WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 - 24 AS off, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, off + 24 AS row_idx, off // 12 AS batch, off % 12 // 4 AS rank, off % 4 AS slot FROM i WHERE off >= 0 AND off < (n - 24) // 12 * 12""")
def _(t):
    return asm.shard_sequential(t.orders.select("o_orderkey"), ["o_orderkey"], 24, 4, 3).withColumn("slot", F.col("slot").cast("bigint"))


RANDOM = """WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, count(*) OVER () AS n FROM orders), n AS (SELECT count(*) AS n FROM orders),
q AS (SELECT n, (n - n % 12) AS active, 24 + n - n % 12 AS consumed FROM n), p AS (SELECT *, consumed // active AS epoch, consumed % active AS done FROM q),
"""


@query("shard_random_buckets", RANDOM + """b AS (SELECT x AS local, row_number() OVER (ORDER BY md5(epoch || '|' || x), x) - 1 - done // 3 AS i, n // 12 * 4 AS bucket, done FROM p, range(0, n // 12 * 4) r(x))
SELECT o_orderkey, row_idx, r.k::BIGINT AS rank, b.i // 4 AS batch, b.i % 4 AS slot FROM b, range(0, 3) r(k), i WHERE b.i >= 0 AND b.i < (bucket - done // 3) // 4 * 4 AND i.row_idx = r.k * bucket + local""")
def _(t):
    n = t.orders.count()
    out = asm.shard_random(t.orders.select("o_orderkey"), ["o_orderkey"], 24 + n - n % 12, 4, 3, True)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("rank", "slot")})


@query("shard_random_strided", RANDOM + """b AS (SELECT x AS local, row_number() OVER (ORDER BY md5(epoch || '|' || x), x) - 1 - done AS i, n // 4 * 4 - done AS held FROM p, range(0, n // 4 * 4) r(x)),
c AS (SELECT local, i % 3 AS rank, i // 3 AS k, (held - 1 - i % 3) // 3 + 1 AS mine FROM b WHERE i >= 0)
SELECT o_orderkey, row_idx, rank, k // 4 AS batch, k % 4 AS slot FROM c JOIN i ON row_idx = local WHERE k < mine // 4 * 4""")
def _(t):
    n = t.orders.count()
    out = asm.shard_random(t.orders.select("o_orderkey"), ["o_orderkey"], 24 + n - n % 12, 4, 3, False)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("rank", "slot")})


@query("validation_batch", "SELECT o_orderkey, row_idx FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, count(*) OVER () AS n FROM orders) WHERE row_idx < n // 7 * 7")
def _(t):
    return asm.validation_batch(t.orders.select("o_orderkey"), ["o_orderkey"], 7)


def _batched(t):
    sizes = stage(views.documents(t).select("doc_id", F.size(tx.blank_tokens(F.col("text"))).cast("bigint").alias("n_tokens")), "lengths")
    return sizes.withColumn("batch", F.floor(F.col("doc_id") / 64))


SIZES = "sz AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))::BIGINT AS n_tokens FROM documents)"
BATCHED = SIZES + ", b AS (SELECT doc_id, n_tokens, doc_id // 64 AS batch FROM sz)"


# largest differencing: the two states of widest spread are joined until a batch has one; {p} has batch, i (place by length), n_tokens and k
DIFFERENCING = """,
f AS (SELECT batch, k, list({'a': -n_tokens, 'b': -n_tokens, 'c': i, 'parts': list_concat([{'s': -n_tokens, 'm': i, 'ids': [i]}],
    list_transform(range(k - 1), lambda x: {'s': 0::BIGINT, 'm': -1::BIGINT, 'ids': []::BIGINT[]}))}) AS states FROM p GROUP BY batch, k),
d AS (SELECT batch, k, list_sort(states) AS states FROM f
  UNION ALL
  SELECT batch, k, list_sort(list_append(states[3:], {'a': parts[1].s - parts[k].s, 'b': parts[1].s, 'c': list_min(list_concat([states[1].c], [states[2].c])), 'parts': parts})) FROM (
    SELECT batch, k, states, list_sort(list_transform(range(1, k + 1), lambda j: {'s': states[1].parts[j].s + states[2].parts[k + 1 - j].s,
      'm': CASE WHEN states[1].parts[j].m < 0 THEN states[2].parts[k + 1 - j].m WHEN states[2].parts[k + 1 - j].m < 0 THEN states[1].parts[j].m ELSE least(states[1].parts[j].m, states[2].parts[k + 1 - j].m) END,
      'ids': list_concat(states[1].parts[j].ids, states[2].parts[k + 1 - j].ids)})) AS parts FROM d WHERE len(states) > 1)),
u AS (SELECT batch, part - 1 AS part, unnest(states[1].parts[part].ids) AS i FROM d, range(1, 1000) r(part) WHERE len(states) = 1 AND part <= k),
j AS (SELECT p.*, u.part, CASE WHEN p.i % (2 * k) < k THEN p.i % (2 * k) ELSE 2 * k - 1 - p.i % (2 * k) END AS snake FROM p JOIN u USING (batch, i)),
w AS (SELECT batch FROM
  (SELECT batch, max(s) - CASE WHEN count(*) < k THEN 0 ELSE min(s) END AS d FROM (SELECT batch, k, part, sum(n_tokens) AS s FROM j GROUP BY 1, 2, 3) GROUP BY batch, k) JOIN
  (SELECT batch, max(s) - CASE WHEN count(*) < k THEN 0 ELSE min(s) END AS e FROM (SELECT batch, k, snake, sum(n_tokens) AS s FROM j GROUP BY 1, 2, 3) GROUP BY batch, k) USING (batch) WHERE e < d)"""


@query("balance_partitions", f"""WITH RECURSIVE {BATCHED}, p AS (SELECT *, 4::BIGINT AS k, row_number() OVER (PARTITION BY batch ORDER BY n_tokens DESC, doc_id) - 1 AS i FROM b){DIFFERENCING}
SELECT doc_id, n_tokens, batch, CASE WHEN batch IN (SELECT batch FROM w) THEN snake ELSE part END AS part FROM j""")
def _(t):
    return asm.balance_partitions(_batched(t), "batch", "doc_id", "n_tokens", 4)


@query("balance_greedy", f"""WITH RECURSIVE {BATCHED}, p AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY doc_id) - 1 AS i FROM b),
g AS (SELECT batch, -1::BIGINT AS i, [0, 0, 0, 0]::BIGINT[] AS sums, 0 AS lightest FROM p GROUP BY batch
  UNION ALL
  SELECT batch, i, list_transform(range(1, 5), lambda j: sums[j] + CASE WHEN j = lightest THEN n_tokens ELSE 0 END), lightest FROM
    (SELECT g.batch, p.i, sums, n_tokens, list_position(sums, list_min(sums)) AS lightest FROM g JOIN p ON p.batch = g.batch AND p.i = g.i + 1)),
r AS (SELECT batch, lightest, row_number() OVER (PARTITION BY batch ORDER BY sum(n_tokens) DESC, min(i)) - 1 AS part FROM g JOIN p USING (batch, i) GROUP BY batch, lightest)
SELECT doc_id, n_tokens, batch, part FROM p JOIN g USING (batch, i) JOIN r USING (batch, lightest)""")
def _(t):
    return asm.balance_partitions(_batched(t), "batch", "doc_id", "n_tokens", 4, method="given")


@query("micro_batches", f"""WITH RECURSIVE {BATCHED}, p AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY doc_id) - 1 AS orig_idx, row_number() OVER (PARTITION BY batch ORDER BY n_tokens DESC, doc_id) - 1 AS i,
  greatest(ceil(sum(n_tokens) OVER (PARTITION BY batch) / 30000.0::DOUBLE)::BIGINT, 1) AS k FROM b){DIFFERENCING}
SELECT doc_id, n_tokens, batch, orig_idx, CASE WHEN batch IN (SELECT batch FROM w) THEN snake ELSE part END AS micro FROM j""")
def _(t):
    return asm.micro_batches(_batched(t), "batch", "doc_id", "n_tokens", 30000)


SNAKE = SIZES + ", pos AS (SELECT *, row_number() OVER (ORDER BY n_tokens DESC, doc_id) - 1 AS p FROM sz), snake AS (SELECT doc_id, n_tokens, CASE WHEN p % 16 < 8 THEN p % 16 ELSE 15 - p % 16 END AS part FROM pos)"


@query("snake_partitions", f"WITH {SNAKE} SELECT * FROM snake")
def _(t):
    return asm.snake_partitions(_batched(t).drop("batch"), "doc_id", "n_tokens", 8)


@query("unbalance_stats", f"""WITH {SNAKE}, b AS (SELECT r // (n // 8) AS b, sum(n_tokens) AS s FROM (SELECT n_tokens, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM snake) GROUP BY 1),
p AS (SELECT part, sum(n_tokens) AS s FROM snake GROUP BY 1)
SELECT min(s)::BIGINT AS min, max(s)::BIGINT AS max, (max(s) - min(s))::BIGINT AS minmax_diff, round(sum(s)::DOUBLE / 8, 6) AS mean,
  (SELECT min(s) FROM p)::BIGINT AS balanced_min, (SELECT max(s) FROM p)::BIGINT AS balanced_max FROM b""")
def _(t):
    parts = asm.snake_partitions(_batched(t).drop("batch"), "doc_id", "n_tokens", 8)
    return asm.unbalance_stats(parts, ["doc_id"], "n_tokens", "part", 8).withColumn("mean", r6(F.col("mean")))


LANGS = ["en", "fr", "de", "es"]
DATASETS = I + """, ds AS (SELECT (list_position(['en', 'fr', 'de', 'es'], lang) - 1)::BIGINT AS dataset_idx, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS doc_id, ids FROM doc_ids),
cut AS (SELECT dataset_idx, doc_id, ids, unnest(range(0, len(ids), 64)) AS token_start FROM ds),
chunks AS (SELECT dataset_idx, doc_id, token_start, least(token_start + 64, len(ids)) AS token_end, ids[token_start + 1:token_start + 64] AS tokens,
  len(list_filter(ids[token_start + 1:token_start + 64], lambda x: x % 5 <> 0)) AS bert_len FROM cut),
nd AS (SELECT dataset_idx, count(*) AS n_docs, floor(0.9::DOUBLE * count(*))::BIGINT AS n_docs_train FROM ds GROUP BY 1),
cc AS (SELECT c.dataset_idx, n_docs, n_docs_train, count(*) FILTER (bert_len > 0) AS n_chunks, count(*) FILTER (bert_len = 0) AS n_chunks_invalid,
  count(*) FILTER (bert_len > 0 AND doc_id < n_docs_train) AS n_chunks_train FROM chunks c JOIN nd USING (dataset_idx) GROUP BY ALL),
counts AS (SELECT *, floor((SELECT count(*) FROM documents) * (CASE dataset_idx WHEN 0 THEN 6 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 1 END / 10.0::DOUBLE))::BIGINT AS n_chunks_sampled FROM cc)"""
RATIOS = {0: 6.0, 1: 2.0, 2: 1.0, 3: 1.0}


def _datasets(t):
    docs = with_group_index(views.doc_ids(t).withColumnRenamed("doc_id", "_d"), ["lang"], [F.col("_d")], "doc_id")
    idx = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")) - 1
    return docs.select(idx.alias("dataset_idx"), "doc_id", "ids")


def _chunks(docs):
    with_end = docs.withColumn("ids", F.concat("ids", F.array(F.lit(0).cast("bigint"))))
    return asm.chunk_documents(with_end, ["dataset_idx", "doc_id"], "ids", 64, eod=0, relength=lambda x: F.size(F.filter(x, lambda y: y % 5 != 0)))


@query("chunk_documents", f"WITH {DATASETS} SELECT dataset_idx, doc_id, token_start, token_end, md5(array_to_string(tokens, ',')) AS tokens, bert_len, bert_len > 0 AS valid FROM chunks")
def _(t):
    c = _chunks(_datasets(t)).withColumn("tokens", F.md5(joined(F.col("tokens"))))
    return c.withColumns({n: F.col(n).cast("bigint") for n in ("token_start", "token_end", "bert_len")})


def _counts(t, docs, chunks):
    return asm.chunk_counts(chunks, docs, RATIOS, t.documents.count(), 0.9)


@query("chunk_counts", f"WITH {DATASETS} SELECT * FROM counts")
def _(t):
    docs = _datasets(t)
    return _counts(t, docs, _chunks(docs))


@query("merge_chunk_tables", f"""WITH {DATASETS}, v AS (SELECT c.*, n_docs_train, n_chunks_sampled, row_number() OVER (PARTITION BY c.dataset_idx ORDER BY doc_id, token_start) AS rn FROM chunks c JOIN counts USING (dataset_idx) WHERE bert_len > 0)
SELECT 'sampled' AS kind, dataset_idx, doc_id, token_start FROM v WHERE rn <= n_chunks_sampled
UNION ALL SELECT 'train', dataset_idx, doc_id, token_start FROM v WHERE doc_id < n_docs_train UNION ALL SELECT 'valid', dataset_idx, doc_id, token_start FROM v WHERE doc_id >= n_docs_train""")
def _(t):
    docs = _datasets(t)
    # cut once, as the counts and every part read them; the parts share the counts
    chunks = stage(_chunks(docs).drop("tokens"), "chunks")
    counts = stage(_counts(t, docs, chunks), "counts")
    parts = [asm.merge_chunk_tables(chunks, counts, k).select(F.lit(k).alias("kind"), "dataset_idx", "doc_id", F.col("token_start").cast("bigint").alias("token_start"))
             for k in ("sampled", "train", "valid")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("doc_chunk_offsets", f"""WITH {DATASETS}, n AS (SELECT ds.dataset_idx, ds.doc_id, count(c.doc_id) AS n FROM ds LEFT JOIN chunks c ON c.dataset_idx = ds.dataset_idx AND c.doc_id = ds.doc_id AND bert_len > 0 GROUP BY ALL)
SELECT dataset_idx, doc_id, (sum(n) OVER (ORDER BY dataset_idx, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS chunk_offset FROM n""")
def _(t):
    docs = _datasets(t)
    return asm.doc_chunk_offsets(_chunks(docs).drop("tokens"), docs).withColumnRenamed("offset", "chunk_offset")


@query("train_embedding_sample", """WITH r AS (SELECT vec_id, vec_id // 50 AS block, row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY vec_id // 50) AS n FROM embeddings)
SELECT vec_id, block FROM r WHERE rn <= floor(0.3::DOUBLE * n)""")
def _(t):
    return asm.train_embedding_sample(t.embeddings.select("vec_id"), "vec_id", 50, 0.3)


@query("sliding_eval_windows", f"""WITH {I}, w AS (SELECT doc_id, ids, unnest(range(0, greatest(ceil(greatest(len(ids) - 1 - 100, 0) / 100.0::DOUBLE)::BIGINT + 1, 1))) AS win FROM doc_ids),
p AS (SELECT doc_id, win, ids[win * 100 + 1:win * 100 + 257] AS p FROM w)
SELECT doc_id, win AS window_idx, md5(array_to_string(list_concat(p, list_transform(range(len(p), 257), lambda x: 0::BIGINT)), ',')) AS tokens,
  array_to_string(list_transform(range(0, 256), lambda i: CASE WHEN i < len(p) - 1 AND (win = 0 OR i >= 156) THEN 1 ELSE 0 END), '') AS pad_mask FROM p""")
def _(t):
    out = asm.sliding_eval_windows(views.doc_ids(t), "doc_id", "ids", 256, 100)
    return out.select("doc_id", F.col("window").cast("bigint").alias("window_idx"), F.md5(joined(F.col("tokens"))).alias("tokens"), joined(F.col("pad_mask"), "").alias("pad_mask"))
