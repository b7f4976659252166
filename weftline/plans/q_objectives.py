"""Queries over tokenizing, padding and training samples, and the text functions left."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as ar, text as tx
from ..functions.wordpiece import wordpiece
from ..operators import objectives as ob
from ..session import stage
from . import views
from .q_assembly import SENTS, sents
from .registry import joined, query

I = views.IDS
WID = "list_transform(list_filter(string_split_regex({x}, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(lower(w)), 1, 6))::BIGINT + 1)"


def _j(x):
    return f"array_to_string({x}, ',')"


def _pad(x, n, fill=0):
    return f"list_concat({x}, list_transform(range(0, greatest({n} - len({x}), 0)), lambda q: {fill}::BIGINT))"


def _mask(n, length):
    return f"list_transform(range(0, {length}), lambda q: CASE WHEN q < {n} THEN 1 ELSE 0 END)"


@query("general_clean", "SELECT doc_id, regexp_replace(text, '  +|([\\p{L}\\p{N}_])\\n+ ?', '\\1 ', 'g') AS text FROM documents")
def _(t):
    return views.documents(t).select("doc_id", tx.general_clean(F.col("text")).alias("text"))


@query("clean_text", "SELECT doc_id, replace(replace(replace(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' . ', '. '), ' . ', '. '), ' . ', '. ') AS text FROM documents")
def _(t):
    return views.documents(t).select("doc_id", tx.clean_text(F.col("text")).alias("text"))


def _rules(rules, x):
    for old, new, is_regex in rules:
        def q(s):
            return "'" + s.replace("'", "''") + "'"
        new_sql = q(new.replace("$1", "\\1")) if is_regex else q(new)
        x = f"regexp_replace({x}, {q(old)}, {new_sql}, 'g')" if is_regex else f"replace({x}, {q(old)}, {new_sql})"
    return x


@query("detokenize", f"SELECT doc_id, {_rules(tx._PTB, 'text')} AS ptb, {_rules(tx._WIKI, 'text')} AS wiki FROM documents")
def _(t):
    return views.documents(t).select("doc_id", tx.detokenize(F.col("text"), "data/ptb.txt").alias("ptb"), tx.detokenize(F.col("text"), "wikitext").alias("wiki"))


@query("fix_text", "SELECT doc_id, text AS repaired FROM documents")
def _(t):
    # texts are spoilt by reading their UTF-8 bytes as Latin-1 (bytes that Latin-1 shows as controls survive the round trip)
    spoilt = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return views.documents(t).select("doc_id", tx.fix_text(spoilt).alias("repaired"))


@query("pad_or_truncate", f"""WITH {I} SELECT doc_id, {_j("list_concat(list_transform(range(0, greatest(300 - len(ids), 0)), lambda q: 0::BIGINT), ids[greatest(len(ids) - 299, 1):])")} AS left_ids,
 {_j(_pad('ids[1:300]', 300))} AS right_ids, least(len(ids), 300)::BIGINT AS n_mask FROM doc_ids""")
def _(t):
    left, mask = ar.pad_or_truncate(F.col("ids"), 300, left_pad=True, policy="left")
    right, _m = ar.pad_or_truncate(F.col("ids"), 300, left_pad=False, policy="right")
    return views.doc_ids(t).select("doc_id", joined(left).alias("left_ids"), joined(right).alias("right_ids"), ar.total(mask).cast("bigint").alias("n_mask"))


@query("whitespace_ints", "SELECT o_orderkey, o_custkey || ',' || o_orderkey AS ids FROM orders")
def _(t):
    text = F.concat_ws("  ", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", joined(ar.whitespace_ints(text)).alias("ids"))


VOCAB = """vocab AS (SELECT DISTINCT substr(w, 1, 3) AS piece FROM (SELECT unnest(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+')) AS w FROM benchmark) WHERE w <> ''
  UNION SELECT DISTINCT '##' || substr(w, 1, 2) FROM (SELECT unnest(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+')) AS w FROM benchmark) WHERE w <> ''
  UNION SELECT DISTINCT '##' || c FROM (SELECT unnest(string_split(lower(text), '')) AS c FROM benchmark) WHERE trim(c) <> '')"""


def _vocab(t):
    w = t.benchmark.select(F.explode(F.split(F.lower("text"), r"[ \t\n\r\f]+")).alias("w")).filter("w <> ''")
    c = t.benchmark.select(F.explode(F.split(F.lower("text"), "")).alias("c")).filter(~F.col("c").rlike(r"^[ \t\n]?$"))
    return w.select(F.substring("w", 1, 3).alias("piece")).unionAll(w.select(F.concat(F.lit("##"), F.substring("w", 1, 2)))).unionAll(
        c.select(F.concat(F.lit("##"), "c"))).distinct()


@query("wordpiece", f"""WITH RECURSIVE {VOCAB}, tok AS (SELECT doc_id, unnest(w) AS w, unnest(range(0, len(w))) AS i FROM (
   SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM documents)),
words AS (SELECT DISTINCT w FROM tok),
sub AS (SELECT w, p, n, CASE WHEN p > 0 THEN '##' ELSE '' END || substr(w, p + 1, n) AS piece FROM (SELECT w, p, unnest(range(1, least(length(w) - p, 3) + 1)) AS n FROM (SELECT w, unnest(range(0, length(w))) AS p FROM words))),
best AS (SELECT w, p, max(n) AS n, arg_max(piece, n) AS piece FROM sub JOIN vocab USING (piece) GROUP BY ALL),
walk AS (SELECT w, 0::BIGINT AS p, '' AS out FROM words UNION ALL SELECT walk.w, walk.p + best.n, out || ' ' || piece FROM walk JOIN best ON best.w = walk.w AND best.p = walk.p),
done AS (SELECT w, out FROM walk WHERE p = length(w))
SELECT doc_id, md5(string_agg(coalesce(out, ' [UNK]'), '' ORDER BY i)) AS pieces, count(*) FILTER (out IS NULL) AS unknown FROM tok LEFT JOIN done USING (w) GROUP BY doc_id""")
def _(t):
    d = wordpiece(views.documents(t), "doc_id", "text", _vocab(t)).filter(F.size("pieces") > 0).withColumnRenamed("pieces", "p")
    return d.select("doc_id", F.md5(F.concat(F.lit(" "), F.array_join("p", " "))).alias("pieces"),
                   F.size(F.filter("p", lambda x: x == "[UNK]")).cast("bigint").alias("unknown"))


@query("encode_docs", f"""WITH {SENTS.replace('sents AS', 'raw AS').replace('AS sizes', 'AS sizes, s')},
e AS (SELECT doc_id, list_filter(list_transform(s, lambda x: {WID.format(x='x')}), lambda y: len(y) > 0) AS p FROM raw)
SELECT doc_id, md5({_j('CASE WHEN len(p) > 0 THEN list_append(flatten(p), 0::BIGINT) ELSE []::BIGINT[] END')}) AS ids,
  {_j('list_transform(range(1, len(p) + 1), lambda i: len(p[i]) + CASE WHEN i = len(p) THEN 1 ELSE 0 END)')} AS lengths FROM e""")
def _(t):
    ids, lengths = ar.encode_sentences(tx.split_sentences(F.col("text")), eod=0)
    return views.documents(t).select("doc_id", F.md5(joined(ids)).alias("ids"), joined(lengths).alias("lengths"))


PAIR_IDS = f"""{views.PAIRS}, p AS (SELECT uid, {WID.format(x='text_a')} AS a, {WID.format(x='text_b')} AS b FROM pairs)"""


def _pairs(t):
    return views.pairs(t).select("uid", ar.word_ids(F.col("text_a")).alias("a"), ar.word_ids(F.col("text_b")).alias("b"), "text_a")


def _encoded(a, b, n):
    body = f"list_concat([1::BIGINT], {a}, [2::BIGINT], {b})"
    kinds = f"list_concat(list_transform(range(0, len({a}) + 2), lambda q: 0::BIGINT), list_transform(range(0, len({b})), lambda q: 1::BIGINT))"
    return f"list_append(({body})[1:{n - 1}], 2::BIGINT)", f"list_append(({kinds})[1:{n - 1}], 1::BIGINT)"


@query("pair_encode", f"""WITH {PAIR_IDS}, e AS (SELECT uid, {_encoded('a', 'b', 64)[0]} AS i, {_encoded('a', 'b', 64)[1]} AS k FROM p)
SELECT uid, {_j(_pad('i', 64))} AS ids, {_j(_pad('k', 64))} AS types, {_j(_mask('len(i)', 64))} AS mask FROM e""")
def _(t):
    ids, types, mask = ar.pair_encode(F.col("a"), F.col("b"), 64, 1, 2, 0)
    return _pairs(t).select("uid", joined(ids).alias("ids"), joined(types).alias("types"), joined(mask).alias("mask"))


@query("single_encode", f"""WITH {PAIR_IDS}, e AS (SELECT uid, CASE WHEN len(a) + 2 >= 32 THEN list_append(list_concat([1::BIGINT], a, [2::BIGINT])[1:31], 2::BIGINT) ELSE list_concat([1::BIGINT], a, [2::BIGINT]) END AS i FROM p)
SELECT uid, {_j(_pad('i', 32))} AS ids, {_j(_mask('len(i)', 32))} AS mask FROM e""")
def _(t):
    ids, _types, mask = ar.pair_encode(F.col("a"), None, 32, 1, 2, 0)
    return _pairs(t).select("uid", joined(ids).alias("ids"), joined(mask).alias("mask"))


@query("sft_sample", f"""WITH {PAIR_IDS}, f AS (SELECT uid, len(a) AS np, list_append(list_concat(a, b), 9::BIGINT) AS ids FROM p)
SELECT uid, {_j(_pad('ids[1:128]', 128))} AS input_ids, {_j(_mask('len(ids)', 128))} AS attention_mask,
 {_j("list_transform(range(0, 128), lambda q: least(q, least(len(ids), 128) - 1))")} AS position_ids,
 {_j("list_transform(range(0, 128), lambda q: CASE WHEN q >= least(len(ids), 128) - 1 OR (np > 1 AND q < least(np, 128) - 1) THEN 0 ELSE 1 END)")} AS loss_mask FROM f""")
def _(t):
    out = ob.sft_sample(_pairs(t), "a", "b", 128, eos=9)
    return out.select("uid", *[joined(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "position_ids", "loss_mask")])


@query("preference_sample", f"""WITH {PAIR_IDS}, f AS (SELECT uid, list_append(list_concat(a, b), 9::BIGINT) AS c, list_append(list_concat(a, list_reverse(a)), 9::BIGINT) AS r FROM p)
SELECT uid, {_j(_pad('c[1:100]', 100))} AS chosen_ids, {_j(_mask('len(c)', 100))} AS chosen_mask, {_j(_pad('r[1:100]', 100))} AS rejected_ids, {_j(_mask('len(r)', 100))} AS rejected_mask FROM f""")
def _(t):
    out = ob.preference_sample(_pairs(t).withColumn("r", F.reverse("a")), "a", "b", "r", 100, 9)
    return out.select("uid", *[joined(F.col(c)).alias(c) for c in ("chosen_ids", "chosen_mask", "rejected_ids", "rejected_mask")])


def _lpad(x, n):
    return f"list_concat(list_transform(range(0, greatest({n} - len({x}), 0)), lambda q: 0::BIGINT), {x}[greatest(len({x}) - {n - 1}, 1):])"


RL = f"""c AS (SELECT conv_id, turn, {WID.format(x="'<|system|> Answer briefly. <|' || role || '|> ' || text || ' <|assistant|>'")} AS p, {WID.format(x="'<|user|> ' || text || ' Hint: think <|assistant|>'")} AS h FROM conversations)"""


@query("rl_sample", f"""WITH {RL} SELECT conv_id, turn, turn AS index, {_j(_lpad('p', 96))} AS input_ids, least(len(p), 96)::BIGINT AS n_tokens,
 {_j("list_transform(range(0, 96), lambda q: greatest(q - greatest(96 - len(p), 0), 0))")} AS position_ids, {_j(_lpad('h', 96))} AS hint_input_ids FROM c""")
def _(t):
    system = F.struct(F.lit("system").alias("role"), F.lit("Answer briefly.").alias("content"))
    said = F.struct(F.col("role").alias("role"), F.col("text").alias("content"))
    hint = F.struct(F.lit("user").alias("role"), F.concat("text", F.lit(" Hint: think")).alias("content"))
    df = t.conversations.select("conv_id", "turn", F.array(system, said).alias("prompt"), F.array(hint).alias("hint"), F.struct(F.col("turn").alias("index")).alias("extra_info"))
    out = ob.rl_sample(df, ["prompt", "hint", "cot"], 96, policy="left")
    return out.select("conv_id", "turn", "index", joined(F.col("input_ids")).alias("input_ids"), ar.total(F.col("attention_mask")).cast("bigint").alias("n_tokens"),
                      joined(F.col("position_ids")).alias("position_ids"), joined(F.col("hint_input_ids")).alias("hint_input_ids"))


@query("switch_template", f"""WITH {views.PAIRS}, c AS (SELECT uid, {WID.format(x="'[user] ' || text_a || ' ' || chr(10) || '[assistant] ' || text_b || chr(10)")} AS i FROM pairs)
SELECT uid, {_j(_pad('i[1:150]', 150))} AS input_ids, least(len(i), 150)::BIGINT AS n_tokens FROM c""")
def _(t):
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("text_a").alias("content")))
    df = views.pairs(t).select("uid", msgs.alias("messages"), F.concat("text_b", F.lit("</s>")).alias("response"))
    out = ob.switch_template(df, "messages", "response", "</s>", 150)
    return out.select("uid", joined(F.col("input_ids")).alias("input_ids"), ar.total(F.col("attention_mask")).cast("bigint").alias("n_tokens"))


@query("evidence_sample", f"""WITH w AS (SELECT page_id, {WID.format(x="regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS a, {WID.format(x='html')} AS b FROM pages),
e AS (SELECT page_id, {_encoded('a', 'b', 200)[0]} AS i, {_encoded('a', 'b', 200)[1]} AS k FROM w)
SELECT page_id, {_j(_pad('i', 200))} AS ids, {_j(_pad('k', 200))} AS types FROM e""")
def _(t):
    df = t.pages.select("page_id", ar.word_ids(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("a"), ar.word_ids(F.col("html")).alias("b"))
    return ob.evidence_sample(df, "a", "b", 200).select("page_id", joined(F.col("ids")).alias("ids"), joined(F.col("types")).alias("types"))


def _h(seed, *parts):
    return f"('0x' || substr(md5('{seed}|' || " + " || '|' || ".join(parts) + "), 1, 8))::BIGINT"


SENT_IDS = f"""{SENTS.replace('sents AS', 'raw AS').replace('AS sizes', 'AS sizes, s')},
sid AS (SELECT doc_id, list_filter(list_transform(s, lambda x: {WID.format(x='x')}), lambda y: len(y) > 0) AS p FROM raw)"""


def _sentence_ids(t):
    parts = F.filter(F.transform(tx.split_sentences(F.col("text")), ar.word_ids), lambda s: F.size(s) > 0)
    return stage(views.documents(t).select("doc_id", parts.alias("p")), "sentence_ids")


@query("segment_pair", f"""WITH {SENT_IDS}, c AS (SELECT doc_id, p, len(p) AS n, CASE WHEN len(p) >= 3 THEN 1 + {_h('4cut', 'doc_id')} % (len(p) - 1) ELSE 1 END AS cut, {_h('4swap', 'doc_id')} < 2147483648 AS sw FROM sid WHERE len(p) > 1),
s AS (SELECT doc_id, sw, CASE WHEN sw THEN flatten(p[cut + 1:]) ELSE flatten(p[1:cut]) END AS a, CASE WHEN sw THEN flatten(p[1:cut]) ELSE flatten(p[cut + 1:]) END AS b FROM c),
r AS (SELECT *, greatest(len(a) + len(b) - 120, 0) AS ex, least(abs(len(a) - len(b)), greatest(len(a) + len(b) - 120, 0)) AS lv FROM s),
g AS (SELECT *, CASE WHEN len(a) > len(b) THEN lv ELSE 0 END + (ex - lv) // 2 AS ra, CASE WHEN len(a) > len(b) THEN 0 ELSE lv END + (ex - lv) - (ex - lv) // 2 AS rb FROM r),
f AS (SELECT *, len(list_filter(range(1, ra + 1), lambda i: {_h('4a', 'doc_id', 'i')} < 2147483648)) AS fa, len(list_filter(range(1, rb + 1), lambda i: {_h('4b', 'doc_id', 'i')} < 2147483648)) AS fb FROM g),
k AS (SELECT doc_id, sw, ex > 0 AS truncated, a[fa + 1:len(a) - ra + fa] AS a, b[fb + 1:len(b) - rb + fb] AS b FROM f),
o AS (SELECT doc_id, sw, truncated, len(a) AS na, list_concat([1::BIGINT], a, [2::BIGINT], CASE WHEN len(b) > 0 THEN list_append(b, 2::BIGINT) ELSE [] END) AS t FROM k)
SELECT doc_id, sw AS is_random, truncated, md5({_j(_pad('t', 128))}) AS tokens, {_j("list_transform(range(0, 128), lambda q: CASE WHEN q >= na + 2 AND q < len(t) THEN 1 ELSE 0 END)")} AS types FROM o""")
def _(t):
    out = ob.segment_pair(_sentence_ids(t).filter(F.size("p") > 1), "doc_id", "p", 120, 128, seed=4)
    return out.select("doc_id", "is_random", "truncated", F.md5(joined(F.col("tokens"))).alias("tokens"), joined(F.col("types")).alias("types"))


@query("masked_lm", f"""WITH {PAIR_IDS}, e AS (SELECT uid, {_pad(_encoded('a', 'b', 64)[0], 64)} AS t FROM p),
q AS (SELECT uid, t, least(10, greatest(1, round_even(len(list_filter(t, lambda x: x <> 0)) * 0.15::DOUBLE, 0)::INT)) AS budget,
  list_transform(list_sort(list_filter(list_transform(range(0, 64), lambda i: {{'h': md5('6pick|' || uid || '|' || i), 'i': i, 'x': t[i + 1]}}), lambda s: s.x > 2)), lambda s: s.i) AS o FROM e),
c AS (SELECT uid, t, o[1:budget] AS hit FROM q)
SELECT uid, {_j("list_transform(range(0, 64), lambda i: CASE WHEN NOT list_contains(hit, i) THEN t[i + 1] WHEN " + _h('6kind', 'uid', 'i') + " < 3435973836 THEN 3 WHEN " + _h('6keep', 'uid', 'i') + " < 2147483648 THEN t[i + 1] ELSE " + _h('6word', 'uid', 'i') + " % 5000 END)")} AS masked,
  {_j("list_transform(range(0, 64), lambda i: CASE WHEN list_contains(hit, i) THEN t[i + 1] ELSE -1 END)")} AS labels, len(hit)::BIGINT AS n_masked FROM c""")
def _(t):
    ids, _t, _m = ar.pair_encode(F.col("a"), F.col("b"), 64, 1, 2, 0)
    df = _pairs(t).select("uid", ids.alias("ids"))
    out = ob.masked_lm(df, "uid", "ids", 0.15, 10, 5000, seed=6)
    return out.select("uid", joined(F.col("masked")).alias("masked"), joined(F.col("labels")).alias("labels"), ar.total(F.col("loss_mask")).cast("bigint").alias("n_masked"))


@query("span_masked_lm")
def _(t):
    ids, _t, _m = ar.pair_encode(F.col("a"), F.col("b"), 64, 1, 2, 0)
    df = _pairs(t).select("uid", ids.alias("ids")).withColumn("starts", F.transform("ids", lambda x: (x % 3 != 0).cast("int")))
    out = ob.span_masked_lm(df, "uid", "ids", "starts", 0.15, 10, 5000, seed=6)
    return out.select("uid", joined(F.col("masked")).alias("masked"), joined(F.col("labels")).alias("labels"), joined(F.col("loss_mask")).alias("loss_mask"))


@query("span_corruption")
def _(t):
    df = views.doc_ids(t).select("doc_id", "ids")
    out = ob.span_corruption(df, "doc_id", "ids", 200, 256, 128, 0.15, seed=8, bos=1, eos=2, first_sentinel=100_000_000)
    return out.select("doc_id", "truncated", *[joined(F.col(c)).alias(c) for c in ("text_enc", "text_dec", "labels", "loss_mask")])


@query("inverse_cloze", f"""WITH {SENT_IDS}, c AS (SELECT doc_id, p, [doc_id + 7]::BIGINT[] AS title, {_h('2pick', 'doc_id')} % len(p) AS k, {_h('2keep', 'doc_id')} < 429496729 AS keep FROM sid WHERE len(p) > 1),
b AS (SELECT doc_id, list_concat([1::BIGINT], (p[k + 1])[1:126], [2::BIGINT]) AS q, list_concat([1::BIGINT], title, [2::BIGINT], (flatten(CASE WHEN keep THEN p ELSE list_concat(p[1:k], p[k + 2:]) END))[1:124], [2::BIGINT]) AS c FROM c)
SELECT doc_id, md5({_j(_pad('q', 128))}) AS query_tokens, md5({_j(_pad('c', 128))}) AS context_tokens, len(c)::BIGINT AS n_context FROM b""")
def _(t):
    df = _sentence_ids(t).filter(F.size("p") > 1).withColumn("title", F.array(F.col("doc_id") + 7))
    out = ob.inverse_cloze(df, "doc_id", "p", "title", 128, 0.1, seed=2)
    return out.select("doc_id", F.md5(joined(F.col("query_tokens"))).alias("query_tokens"), F.md5(joined(F.col("context_tokens"))).alias("context_tokens"),
                      ar.total(F.col("context_pad_mask")).cast("bigint").alias("n_context"))
