"""Queries over vectors, neighbours, dialogs and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chats, metrics as me, retrieval as rt
from ..operators.index import with_last_before
from . import views
from .q_grading import F1_FORM, EM_FORM
from .registry import joined, query, r6

C = views.CHUNKS
NEAR = C + """, near AS (SELECT a.chunk_id AS qid, b.chunk_id AS id, list_dot_product(a.vec, b.vec) AS score,
  row_number() OVER (PARTITION BY a.chunk_id ORDER BY list_dot_product(a.vec, b.vec) DESC, b.chunk_id) AS rank FROM chunks a, chunks b)"""


def _sides(t):
    c = views.chunks(t)
    return c.select(F.col("chunk_id").alias("qid"), F.col("vec").alias("qvec")), c.select(F.col("chunk_id").alias("id"), "vec")


def _near(t, k):
    return rt.topk_inner_product(*_sides(t), k)


@query("topk_inner_product", f"WITH {NEAR} SELECT qid, rank, id, round(score, 6) + 0.0 AS score FROM near WHERE rank <= 10")
def _(t):
    return _near(t, 10).select("qid", F.col("rank").cast("bigint").alias("rank"), "id", r6(F.col("score")).alias("score"))


@query("topk_approx")
def _(t):
    q, c = _sides(t)
    # 6 lists give a recall of 0.92 on sf0.1 and 1.00 on sf0.01, 7 give 0.97 and 1.00: it falls as tables grow
    return rt.topk_approx(q, c, 10, nlist=8, nprobe=7).select("qid", F.col("rank").cast("bigint").alias("rank"), "id", r6(F.col("score")).alias("score"))


@query("topk_all_lists", f"WITH {NEAR} SELECT qid, rank, id, round(score, 6) + 0.0 AS score FROM near WHERE rank <= 10")
def _(t):
    # every list probed: the same rows as the exact search
    q, c = _sides(t)
    return rt.topk_approx(q, c, 10, nlist=8, nprobe=8).select("qid", F.col("rank").cast("bigint").alias("rank"), "id", r6(F.col("score")).alias("score"))


@query("topk_lists", f"WITH {NEAR} SELECT qid, rank, id, round(score, 6) + 0.0 AS score FROM near WHERE rank <= 10")
def _(t):
    # as many lists as the root of the table; bounds rule out those that hold nothing better
    q, c = _sides(t)
    return rt.Lists(c).search(q, 10)[0].select("qid", F.col("rank").cast("bigint").alias("rank"), "id", r6(F.col("score")).alias("score"))


CAUSAL = NEAR + """, sd AS (SELECT DISTINCT chunk_id // 4 AS sample_id, dataset_idx, doc_id FROM chunks),
ok AS (SELECT qid AS chunk_id, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM near JOIN chunks c ON c.chunk_id = near.id
  WHERE rank <= 40 AND NOT EXISTS (SELECT 1 FROM sd WHERE sd.sample_id = near.qid // 4 AND sd.dataset_idx = c.dataset_idx AND sd.doc_id = c.doc_id)),
causal AS (SELECT c.chunk_id, r.k AS rank, coalesce(ok.id, -1) AS neighbor_id FROM chunks c CROSS JOIN range(1, 9) r(k) LEFT JOIN ok ON ok.chunk_id = c.chunk_id AND ok.r = r.k)"""


def _causal(t):
    c = views.chunks(t)
    near = _near(t, 40).select(F.col("qid").alias("chunk_id"), "rank", F.col("id").alias("neighbor_id"))
    docs = c.select(F.floor(F.col("chunk_id") / 4).alias("sample_id"), "dataset_idx", "doc_id")
    return rt.causal_neighbors(near, docs, c, 4, k_save=8)


@query("causal_neighbors", f"WITH {CAUSAL} SELECT chunk_id, rank, neighbor_id FROM causal")
def _(t):
    return _causal(t).withColumn("rank", F.col("rank").cast("bigint"))


@query("attach_retrieved", f"""WITH {CAUSAL}, n AS (SELECT count(*) AS n FROM chunks),
w AS (SELECT chunk_id, rank, j, ((neighbor_id + j) % n + n) % n AS id FROM causal, n, range(0, 2) r(j) WHERE rank <= 3),
t AS (SELECT chunk_id, list_transform(vec, lambda x: round(x * 1000)::BIGINT) AS tokens FROM chunks)
SELECT w.chunk_id // 4 AS sample_id, string_agg(w.id::VARCHAR, ',' ORDER BY w.chunk_id, rank, j) AS neighbor_chunks,
  string_agg(array_to_string(tokens, ','), ',' ORDER BY w.chunk_id, rank, j) AS neighbor_tokens FROM w JOIN t ON t.chunk_id = w.id GROUP BY 1""")
def _(t):
    tokens = F.transform("vec", lambda x: F.round(x * 1000).cast("bigint"))
    out = rt.attach_retrieved(_causal(t), views.chunks(t).select("chunk_id", tokens.alias("tokens")), 4, 3, 2)
    return out.select("sample_id", joined(F.col("neighbor_chunks")).alias("neighbor_chunks"), joined(F.col("neighbor_tokens")).alias("neighbor_tokens"))


UNIT = C.replace("embedding::DOUBLE[] AS vec", "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS vec")


@query("knn_classify", f"""WITH {NEAR.replace(C, UNIT)}, s AS (SELECT qid, doc_id AS label, sum(exp(score / 0.5)) AS class_score FROM near JOIN chunks ON chunk_id = id WHERE rank <= 20 GROUP BY ALL)
SELECT qid, label, round(class_score, 6) AS class_score, row_number() OVER (PARTITION BY qid ORDER BY class_score DESC, label) AS rank FROM s""")
def _(t):
    labels = views.chunks(t).select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("label"))
    out = rt.knn_classify(*_sides(t), labels, 20, 0.5)
    return out.select("qid", "label", r6(F.col("class_score")).alias("class_score"), F.col("rank").cast("bigint").alias("rank"))


def _topics(t):
    q, c = _sides(t)
    topic = views.chunks(t).select(F.col("chunk_id").alias("_i"), F.col("doc_id").alias("topic"))
    return q.join(topic, F.col("qid") == F.col("_i")).drop("_i"), c.join(topic, F.col("id") == F.col("_i")).drop("_i")


@query("similar_examples", f"""WITH {C}, n AS (SELECT a.chunk_id AS qid, b.chunk_id AS id, list_dot_product(a.vec, b.vec) AS score FROM chunks a JOIN chunks b USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM n)
SELECT qid, (least(count(*) OVER (PARTITION BY qid), 10) - rank + 1)::BIGINT AS pos, id FROM (SELECT * FROM r WHERE rank <= 10)""")
def _(t):
    q, c = _topics(t)
    return rt.similar_examples(q, c).select("qid", F.col("pos").cast("bigint").alias("pos"), "id")


@query("diverse_examples", f"""WITH {C}, n AS (SELECT a.chunk_id AS qid, b.chunk_id AS id, b.doc_id AS topic, list_dot_product(a.vec, b.vec) AS score FROM chunks a, chunks b),
m AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid, topic ORDER BY score, id) AS f FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS k FROM m WHERE f = 1)
SELECT qid, (count(*) OVER (PARTITION BY qid) - k + 1)::BIGINT AS pos, id FROM r WHERE k <= 6""")
def _(t):
    q, c = _topics(t)
    return rt.diverse_examples(q, c, k=6).select("qid", F.col("pos").cast("bigint").alias("pos"), "id")


@query("topk_hits", f"""WITH {NEAR}, f AS (SELECT n.qid, min(CASE WHEN a.doc_id = b.doc_id AND n.qid <> n.id THEN rank END) AS f FROM near n JOIN chunks a ON a.chunk_id = qid JOIN chunks b ON b.chunk_id = id WHERE rank <= 20 GROUP BY n.qid)
SELECT k::INT AS k, count(f) FILTER (f <= k) AS hits, round(count(f) FILTER (f <= k) / count(*)::DOUBLE, 6) AS share FROM f, range(1, 21) r(k) GROUP BY k""")
def _(t):
    label = views.chunks(t).select("chunk_id", "doc_id")
    near = _near(t, 20).join(label.toDF("qid", "ql"), "qid").join(label.toDF("id", "dl"), "id")
    hits = near.withColumn("hit", (F.col("ql") == F.col("dl")) & (F.col("qid") != F.col("id")))
    return rt.topk_hits(hits, "qid", "rank", "hit", 20).withColumn("share", r6(F.col("share")))


@query("retrieval_rank_stats", f"""WITH {C}, p AS (SELECT chunk_id AS id, chunk_id // 64 AS batch, vec AS qvec, list_transform(range(1, 65), lambda i: vec[i] + 0.1 * vec[65 - i]) AS vec FROM chunks),
r AS (SELECT a.id, count(*) FILTER (b.id <> a.id AND list_dot_product(a.qvec, b.vec) > list_dot_product(a.qvec, a.vec)) AS rank FROM p a JOIN p b USING (batch) GROUP BY a.id)
SELECT count(*) AS total, round(avg(rank), 6) AS rank, round(avg((rank < 1)::INT * 100), 6) AS top1_acc, round(avg((rank < 5)::INT * 100), 6) AS top5_acc FROM r""")
def _(t):
    mixed = F.zip_with("vec", F.reverse("vec"), lambda x, y: x + 0.1 * y)
    pairs = views.chunks(t).select(F.col("chunk_id").alias("id"), F.floor(F.col("chunk_id") / 64).alias("batch"), F.col("vec").alias("qvec"), mixed.alias("vec"))
    out = rt.retrieval_rank_stats(pairs, "batch", [1, 5])
    return out.withColumns({c: r6(F.col(c)) for c in ("rank", "top1_acc", "top5_acc")})


SPLIT = "string_split(text, ' ')"


@query("select_negatives", f"""WITH w AS (SELECT item_id, list_filter({SPLIT}, lambda x: length(x) >= 8) AS hard, list_filter({SPLIT}, lambda x: length(x) < 8) AS other FROM benchmark),
s AS (SELECT *, list_transform(list_sort(list_transform(range(0, len(hard)), lambda i: {{'h': md5('1h|' || item_id || '|' || i), 'v': hard[i + 1]}})), lambda x: x.v) AS hs,
  list_transform(list_sort(list_transform(range(0, len(other)), lambda i: {{'h': md5('1o|' || item_id || '|' || i), 'v': other[i + 1]}})), lambda x: x.v) AS os FROM w)
SELECT item_id, array_to_string(list_concat(other[1:5], hard[1:3]), ' ') AS eval_negatives, array_to_string(list_concat(hs[1:12], os[1:greatest(12 - len(hs), 0)]), ' ') AS train_negatives FROM s""")
def _(t):
    w = F.split("text", " ")
    df = t.benchmark.select("item_id", F.filter(w, lambda x: F.length(x) >= 8).alias("hard"), F.filter(w, lambda x: F.length(x) < 8).alias("other"))
    k, h, o = F.col("item_id"), F.col("hard"), F.col("other")
    return df.select("item_id", F.array_join(rt.select_negatives(k, h, o, 3, 5, "eval"), " ").alias("eval_negatives"),
                     F.array_join(rt.select_negatives(k, h, o, 12, 0, "train"), " ").alias("train_negatives"))


TOK = "'\\x01' || array_to_string(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}\\p{{M}}]+|[^\\p{{Z}}\\p{{C}}]'), chr(1)) || chr(1)".replace("'\\x01'", "chr(1)")


@query("has_answer", f"""WITH b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark),
p AS (SELECT doc_id, d.text, b.text AS answer, regexp_extract(b.text, '^([^ ]* [^ ]*)', 1) AS short FROM documents d JOIN b ON d.doc_id % n = i)
SELECT doc_id, contains({TOK.format(x='text')}, {TOK.format(x='answer')}) OR contains({TOK.format(x='text')}, {TOK.format(x='short')}) AS by_string, regexp_matches(text, short, 'i') AS by_regex FROM p""")
def _(t):
    n = t.benchmark.count()
    short = F.regexp_extract("answer", r"^([^ ]* [^ ]*)", 1)
    from ..operators.index import with_row_index
    b = with_row_index(t.benchmark.select("item_id", F.col("text").alias("answer")), ["item_id"], "i").drop("item_id")
    p = views.documents(t).select("doc_id", "text", (F.col("doc_id") % n).alias("i")).join(b, "i").withColumn("short", short)
    return p.select("doc_id", tx.has_answer(F.col("text"), F.array("answer", "short")).alias("by_string"), tx.has_answer(F.col("text"), F.array("short"), "regex").alias("by_regex"))


STOP = "CASE WHEN regexp_matches(text, '[.?!]$') THEN text ELSE text || '.' END"


@query("dialog_context", f"""SELECT conv_id, turn, coalesce(string_agg({STOP}, ' [SEP] ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations""")
def _(t):
    return chats.dialog_context(t.conversations, "conv_id", "turn", "text", last=3).select("conv_id", "turn", "context")


@query("dialog_context_full", f"""SELECT conv_id, turn, coalesce(string_agg({STOP}, ' [SEP] ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM conversations""")
def _(t):
    return chats.dialog_context(t.conversations, "conv_id", "turn", "text").select("conv_id", "turn", "context")


@query("carry_last_search", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS topic FROM conversations""")
def _(t):
    return with_last_before(t.conversations, ["conv_id"], ["turn"], F.col("role") == "user", F.col("text"), "topic").select("conv_id", "turn", "topic")


D = views.DIALOG
TEST = "seen AS (SELECT DISTINCT regexp_extract(text, '^([^ \\t\\n]*)', 1) AS topic FROM benchmark)"


def _seen(t):
    return t.benchmark.select(F.regexp_extract("text", r"^([^ \t\n]*)", 1).alias("topic")).distinct()


def _status_sql(kind):
    strict = "true" if kind != "wow_seen" else "false"
    return f"""CASE WHEN knowledge = 'no_passages_used' THEN 'no_knowledge' WHEN {strict} AND (contains(knowledge, '(') OR contains(knowledge, ')')) THEN 'brackets'
 WHEN {strict} AND NOT contains(knowledge, topic) THEN 'topic_missing' WHEN topic NOT IN (SELECT topic FROM seen) AND len(list_filter(string_split_regex(knowledge, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) > 20 THEN 'long'
 WHEN topic NOT IN (SELECT topic FROM seen) AND regexp_matches(knowledge, '^([Ii]t|[Tt]his)') THEN 'pronoun' ELSE 'keep' END"""


@query("filter_knowledge_rows", f"WITH {D}, {TEST} SELECT conv_id, turn, {_status_sql('wow_seen')} AS seen_status, {_status_sql('woi')} AS strict_status FROM dialog")
def _(t):
    d = views.dialog(t).join(_seen(t).withColumn("_s", F.lit(True)), "topic", "left")
    seen = F.col("_s").isNotNull()
    return d.select("conv_id", "turn", chats.knowledge_status(F.col("topic"), F.col("knowledge"), "wow_seen", seen).alias("seen_status"),
                    chats.knowledge_status(F.col("topic"), F.col("knowledge"), "woi", seen).alias("strict_status"))


@query("dialog_examples", f"""WITH {D}, t AS (SELECT *, string_split(context, ' [SEP] ') AS s FROM dialog)
SELECT conv_id, turn, '( ' || s[-1] || ' ) ' || topic || ' => ' || knowledge AS instance, '( ' || topic || ' ) ' || array_to_string(s[-3:], ' ') AS example FROM t""")
def _(t):
    i, e = chats.dialog_examples(F.col("context"), F.col("topic"), F.col("knowledge"), "woi")
    return views.dialog(t).select("conv_id", "turn", i.alias("instance"), e.alias("example"))


@query("topic_lookup", f"WITH {D}, {TEST} SELECT conv_id, turn, topic, CASE WHEN topic IN (SELECT topic FROM seen) THEN 'shared' ELSE 'other' END AS kind FROM dialog")
def _(t):
    shared, other = chats.topic_lookup(views.dialog(t), _seen(t), "topic")
    return shared.withColumn("kind", F.lit("shared")).unionByName(other.withColumn("kind", F.lit("other"))).select("conv_id", "turn", "topic", "kind")


# Responses that repeat their knowledge and add some words of their own.
COPIED = f"""{D}, copied AS (SELECT conv_id, turn, topic, context, w AS knowledge, w || ' and ' || array_to_string(string_split(w, ' ')[1:greatest(len(string_split(w, ' ')) // (2 + conv_id % 4), 1)], '+ ') AS response
  FROM (SELECT *, trim(regexp_replace(context, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS w FROM dialog)),
bits AS (SELECT *, string_split(response, ' ') AS r, string_split(knowledge, ' ') AS k FROM copied),
runs AS (SELECT *, coalesce(list_sum(list_transform(regexp_extract_all(array_to_string(list_transform(r, lambda x: CASE WHEN list_contains(k, x) THEN '1' ELSE '0' END), ''), '1{{10,}}'), lambda x: length(x))), 0) AS c FROM bits)"""


@query("prompt_examples", f"""WITH {COPIED} SELECT conv_id * 1000 + turn AS id, 'Topic: ' || topic || '. User says: ' || context || ' We know that: ' || knowledge || ' System replies: ' || response AS line
 FROM runs WHERE c >= 0.6 * len(r) AND c <= 0.9 * len(r) AND c >= 0.8 * len(k) ORDER BY md5('1234|' || id), id LIMIT 20""")
def _(t):
    w = F.trim(F.regexp_replace("context", r"[ \t\n\r\f]+", " "))
    d = views.dialog(t).withColumn("knowledge", w).withColumn("_s", F.split("knowledge", " "))
    n = F.greatest(F.floor(F.size("_s") / (2 + F.col("conv_id") % 4)), F.lit(1)).cast("int")
    d = d.withColumn("response", F.concat("knowledge", F.lit(" and "), F.array_join(F.slice("_s", F.lit(1), n), "+ ")))
    d = d.withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return chats.prompt_examples(d, "topic", "context", "knowledge", "response", "id").select("id", "line")


F1_SQL = f"""{D}, n AS (SELECT conv_id * 1000 + turn AS id, {F1_FORM.replace('lower(text)', 'lower(knowledge)')} AS g, {F1_FORM.replace('lower(text)', 'lower(response)')} AS a FROM dialog WHERE response <> '' AND response <> 'no_passages_used'),
tg AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(list_filter(string_split(g, ' '), lambda x: x <> '')) AS w FROM n) GROUP BY ALL),
ta AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(list_filter(string_split(a, ' '), lambda x: x <> '')) AS w FROM n) GROUP BY ALL),
sm AS (SELECT tg.id, sum(least(tg.n, ta.n)) AS s FROM tg JOIN ta ON tg.id = ta.id AND tg.w = ta.w GROUP BY 1),
f AS (SELECT n.id, coalesce(s, 0) AS s, (SELECT sum(tg.n) FROM tg WHERE tg.id = n.id) AS ng, (SELECT sum(ta.n) FROM ta WHERE ta.id = n.id) AS na FROM n LEFT JOIN sm USING (id)),
scores AS (SELECT id, CASE WHEN s > 0 THEN s / ng::DOUBLE ELSE 0 END AS precision, CASE WHEN s > 0 THEN s / na::DOUBLE ELSE 0 END AS recall FROM f)"""


@query("token_f1", f"""WITH {F1_SQL} SELECT id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM scores""")
def _(t):
    d = views.dialog(t).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    out = me.token_f1(d, "id", "knowledge", "response")
    return out.select("id", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


THE_FORM = EM_FORM.replace("lower(text)", "lower('The ' || text || '!')")


@query("exact_match", f"SELECT item_id, {EM_FORM} IN ({THE_FORM}, 'none') AS exact FROM benchmark")
def _(t):
    df = t.benchmark.withColumn("answers", F.array(F.concat(F.lit("The "), "text", F.lit("!")), F.lit("none")))
    return me.exact_match(df, "text", "answers").select("item_id", "exact")


PREDS = """preds AS (SELECT m, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, vec_id AS uid, label::BIGINT AS label, list_transform(e, lambda x: exp(x) / list_sum(list_transform(e, lambda y: exp(y)))) AS probs
  FROM (SELECT m, vec_id, label, list_transform(range(0, 10), lambda c: list_sum(list_transform(range(1, len(embedding) + 1), lambda j: CASE WHEN (j + m) % 10 = c THEN embedding[j]::DOUBLE ELSE 0 END))) AS e FROM embeddings, range(0, 3) r(m)))"""
MEANS = PREDS + """, cells AS (SELECT dataset, uid, label, unnest(range(0, 10)) AS cls, unnest(probs) AS p FROM preds), means AS (SELECT dataset, uid, label, cls, avg(p) AS p FROM cells GROUP BY ALL),
ens AS (SELECT dataset, uid, label, arg_max(cls, p) AS predicted, max(p) FILTER (cls = 9) AS last_p FROM means GROUP BY ALL)"""


def _preds(t):
    e = t.embeddings.select("vec_id", F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("m"))
    # class c of model m adds up every tenth value, so all of the vector counts

    def value(c):
        own = F.transform("e", lambda x, j: F.when((j + 1 + F.col("m")) % 10 == c, x).otherwise(0.0))
        return F.aggregate(own, F.lit(0.0), lambda a, x: a + x)

    e = e.withColumn("x", F.array(*[F.exp(value(c)) for c in range(10)])).withColumn("s", F.aggregate("x", F.lit(0.0), lambda a, x: a + x))
    return e.select("m", F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("dataset"), F.col("vec_id").alias("uid"), "label", F.transform("x", lambda x: x / F.col("s")).alias("probs"))


@query("ensemble", f"WITH {MEANS} SELECT dataset, uid, label, predicted::BIGINT AS predicted, (last_p >= CASE dataset WHEN 'even' THEN 0.1 ELSE 0.11 END)::INT::BIGINT AS thresholded FROM ens")
def _(t):
    p = _preds(t)
    a = me.ensemble(p, 3)
    b = me.ensemble(p, 3, {"even": 0.1, "odd": 0.11}).select("dataset", "uid", F.col("predicted").cast("bigint").alias("thresholded"))
    return a.withColumn("predicted", F.col("predicted").cast("bigint")).join(b, ["dataset", "uid"])


@query("accuracy", f"""WITH {MEANS}, p AS (SELECT dataset, count(*) FILTER (predicted = label) AS correct, count(*) AS total FROM ens GROUP BY 1),
u AS (SELECT * FROM p UNION ALL SELECT 'all', sum(correct)::BIGINT, sum(total)::BIGINT FROM p) SELECT dataset, correct, total, round(correct * 100.0::DOUBLE / total, 6) AS percent FROM u""")
def _(t):
    return me.accuracy(me.ensemble(_preds(t), 3), "dataset", "predicted", "label").withColumn("percent", r6(F.col("percent")))


BIN = "b AS (SELECT doc_id, quality, toxic, (doc_id * 37 % 100) / 100::DOUBLE AS p, doc_id % 3 AS pred, (doc_id * 7 + quality) % 4 AS truth FROM labels)"


def _binary(t):
    return t.labels.select("doc_id", "quality", "toxic", (F.col("doc_id") * 37 % 100 / F.lit(100.0)).alias("p"), (F.col("doc_id") % 3).alias("pred"),
                           ((F.col("doc_id") * 7 + F.col("quality")) % 4).alias("truth"))


@query("best_threshold", f"""WITH {BIN}, g AS (SELECT i * (1.0::DOUBLE / 100.0::DOUBLE) AS t FROM range(0, 100) r(i)), a AS (SELECT t, avg(((p >= t)::INT = toxic)::INT) AS acc FROM b, g GROUP BY t)
SELECT round(t, 6) + 0.0 AS threshold, round(acc, 6) AS accuracy FROM a ORDER BY acc DESC, t LIMIT 1""")
def _(t):
    out = me.best_threshold(_binary(t), "p", "toxic")
    return out.select(r6(F.col("threshold")).alias("threshold"), r6(F.col("accuracy")).alias("accuracy"))


REPORT = f"""{BIN}, tot AS (SELECT count(*) AS n, count(*) FILTER (truth = pred) AS hit, count(*) FILTER (truth = 3) AS ign FROM b),
cl AS (SELECT c AS cls, count(*) FILTER (truth = c) AS support, count(*) FILTER (truth = c AND pred = c)::DOUBLE AS tp, count(*) FILTER (pred = c AND truth <> c)::DOUBLE AS fpa,
  count(*) FILTER (pred = c AND truth <> c AND truth <> 3)::DOUBLE AS fp, count(*) FILTER (truth <> c AND truth <> 3 AND pred <> c)::DOUBLE AS tn, count(*) FILTER (truth = c AND pred <> c)::DOUBLE AS fn FROM b, range(0, 3) r(c) GROUP BY c),
q AS (SELECT cls, support, support / n::DOUBLE AS w, tp, fp, tn, fn, tp / (tp + fpa + 1e-6) AS precision, tp / (tp + fn + 1e-6) AS recall, (tp + n - tp - fpa - fn) / n AS po,
  ((tp + fpa) * (tp + fn) + (fn + n - tp - fpa - fn) * (fpa + n - tp - fpa - fn)) / (n::DOUBLE * n) AS pe, tp / (2 * tp + fpa + fn - tp + 1e-6) AS jaccard, hit / n::DOUBLE AS accuracy FROM cl, tot),
s AS (SELECT cls::VARCHAR AS cls, support, w, tp, fp, tn, fn, precision, recall, 2 * precision * recall / (precision + recall + 1e-6) AS f1, (po - pe) / (1 - pe + 1e-6) AS kappa, jaccard, accuracy FROM q),
u AS (SELECT * EXCLUDE (w) FROM s UNION ALL SELECT 'weighted', sum(support)::BIGINT, """ + ", ".join(f"sum({c} * w)" for c in ("tp", "fp", "tn", "fn", "precision", "recall", "f1", "kappa", "jaccard")) + ", any_value(accuracy) FROM s)"


@query("classification_report", f"WITH {REPORT} SELECT cls, support, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("tp", "fp", "tn", "fn", "precision", "recall", "f1", "kappa", "jaccard", "accuracy")) + " FROM u")
def _(t):
    out = me.classification_report(_binary(t), "truth", "pred", ignore=3)
    return out.select("cls", "support", *[r6(F.col(c)).alias(c) for c in out.columns if c not in ("cls", "support")])


@query("perplexity", f"""WITH d AS (SELECT sum(n_chars * 0.7::DOUBLE + doc_id % 5) AS l, sum(n_chars) AS t, sum(len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))) AS o FROM documents)
SELECT round(l / (t - 1), 6) AS loss, round(exp(least(20.0::DOUBLE, l / (t - 1))), 6) AS ppl, round(exp(least(20.0::DOUBLE, l / (t - 1) * ((t - 1) / (o - 1)))), 6) AS adjusted_ppl, round((t - 1) / (o - 1), 6) AS token_ratio FROM d""")
def _(t):
    df = t.documents.select((F.col("n_chars") * 0.7 + F.col("doc_id") % 5).alias("l"), "n_chars", F.size(tx.blank_tokens(F.col("text"))).alias("o"))
    out = me.perplexity(df, "l", "n_chars", "o")
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("event_stats", "SELECT event_type, round(avg(value), 2) AS mean, round(stddev_pop(value), 2) AS std, count(value) AS count, round(min(value), 2) AS min, round(max(value), 2) AS max, round(sum(value), 2) AS total FROM events GROUP BY 1")
def _(t):
    return me.event_stats(t.events, "event_type", "value")
