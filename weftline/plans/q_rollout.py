"""Queries over prompt groups and token arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import affine, rollout as ro, tokens as tk
from ..operators.index import with_row_index
from ..session import stage
from . import views
from .registry import joined, query, r6

R, TV, LT = views.ROLLOUTS, views.TOKENS, views.LONG_TOKENS


@query("grpo_advantage", f"""WITH {R}, g AS (SELECT uid, avg(score) AS m, stddev_samp(score) AS s, count(*) AS n FROM rollouts GROUP BY uid)
SELECT uid, resp_len, score, round(CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - m) / (s + 1e-6) END, 6) + 0.0 AS advantage,
  round(CASE WHEN n = 1 THEN score ELSE score - m END, 6) + 0.0 AS centred FROM rollouts JOIN g USING (uid)""")
def _(t):
    df = views.rollouts(t)
    a = ro.grpo_advantage(df, "uid", "score")
    both = ro.grpo_advantage(a.withColumnRenamed("advantage", "_a"), "uid", "score", use_std=False)
    return both.select("uid", "resp_len", "score", r6(F.col("_a")).alias("advantage"), r6(F.col("advantage")).alias("centred"))


@query("advantage_over_tokens", f"""WITH {TV}, s AS (SELECT *, list_sum(list_transform(range(1, len(mask) + 1), lambda i: rewards[i] * mask[i])) AS score FROM token_view),
g AS (SELECT uid, avg(score) AS m, stddev_samp(score) AS d, count(*) AS n FROM s GROUP BY uid),
a AS (SELECT id, mask, CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - m) / (d + 1e-6) END AS adv FROM s JOIN g USING (uid))
SELECT id, unnest(range(0, len(mask))) AS t, round(unnest(list_transform(mask, lambda x: x * adv)), 6) + 0.0 AS advantage FROM a""")
def _(t):
    kept = F.zip_with("rewards", "mask", lambda r, m: r * m)
    df = views.token_view(t).withColumn("score", F.aggregate(kept, F.lit(0.0), lambda s, x: s + x))
    a = ro.grpo_advantage(df, "uid", "score")
    return a.select("id", F.posexplode(ro.over_mask(F.col("advantage"), F.col("mask"))).alias("t", "_a")).select(
        "id", F.col("t").cast("bigint").alias("t"), r6(F.col("_a")).alias("advantage"))


@query("scale_on_policy", f"WITH {R} SELECT uid, resp_len, rm_score, round(rm_score * (1 + (2.5 - 1) * CASE variant WHEN 'plain' THEN 1 ELSE 0 END), 6) + 0.0 AS scaled FROM rollouts")
def _(t):
    return views.rollouts(t).select("uid", "resp_len", "rm_score", r6(ro.scale_on_policy(F.col("rm_score"), F.col("variant") == "plain", 2.5)).alias("scaled"))


@query("group_accuracy", f"""WITH {R}, g AS (SELECT uid, avg(score) AS acc, max((resp_len >= 50)::INT) AS t FROM rollouts GROUP BY uid)
SELECT round(acc, 6) AS acc, count(*) AS groups, sum(t)::BIGINT AS truncated_groups FROM g GROUP BY g.acc""")
def _(t):
    return ro.group_accuracy(views.rollouts(t), "uid", "score", "resp_len", 50).withColumn("acc", r6(F.col("acc")))


ACCEPT = """{p}_g AS (SELECT uid, avg(score) AS acc, bool_or(resp_len >= 50) AS truncated FROM {src} GROUP BY uid),
{p}_f AS (SELECT *, acc BETWEEN {lo} AND {hi} AND NOT truncated AS accepted, acc <= 0.25 AS low FROM {p}_g),
{p}_n AS (SELECT *, row_number() OVER (PARTITION BY low ORDER BY uid) AS rn, count(*) FILTER (accepted) OVER () AS n_ok, count(*) FILTER (low) OVER () AS n_low FROM {p}_f),
{p} AS (SELECT uid, acc, truncated, accepted, CASE WHEN n_ok = 0 THEN true ELSE low AND rn <= n_low // 8 * 8 END AS reroll FROM {p}_n)"""


@query("accept_groups", f"WITH {R}, plain_rows AS (SELECT * FROM rollouts WHERE variant = 'plain'), {ACCEPT.format(p='a', src='plain_rows', lo=0.1, hi=0.9)} SELECT uid, round(acc, 6) AS acc, truncated, accepted, reroll FROM a")
def _(t):
    g = ro.accept_groups(views.rollouts(t).filter("variant = 'plain'"), "uid", "score", "resp_len", 0.1, 0.9, 0.25, 50, k=8)
    return g.withColumn("acc", r6(F.col("acc")))


GUIDE = f"""WITH {R}, p_rows AS (SELECT * FROM rollouts WHERE variant = 'plain'), {ACCEPT.format(p='a', src='p_rows', lo=0.1, hi=0.9)},
h_rows AS (SELECT * FROM rollouts WHERE variant = 'hint' AND uid IN (SELECT uid FROM a WHERE reroll)), {ACCEPT.format(p='b', src='h_rows', lo=0.05, hi=0.95)},
c_rows AS (SELECT * FROM rollouts WHERE variant = 'cot' AND uid IN (SELECT uid FROM b WHERE reroll)), {ACCEPT.format(p='c', src='c_rows', lo=0.001, hi=0.999)}"""
BOUNDS = {"plain": (0.1, 0.9), "hint": (0.05, 0.95), "cot": (0.001, 0.999)}


@query("adaptive_guidance", GUIDE + """
SELECT uid, variant, score, resp_len, true AS on_policy FROM p_rows WHERE uid IN (SELECT uid FROM a WHERE accepted)
UNION ALL SELECT uid, variant, score, resp_len, false FROM h_rows WHERE uid IN (SELECT uid FROM b WHERE accepted)
UNION ALL SELECT uid, variant, score, resp_len, false FROM c_rows WHERE uid IN (SELECT uid FROM c WHERE accepted)""")
def _(t):
    rows, _n = ro.adaptive_guidance(views.rollouts(t), "uid", "variant", "score", "resp_len", BOUNDS, 0.25, 50, k=8)
    return rows.select("uid", "variant", "score", "resp_len", "on_policy")


@query("guidance_counts", GUIDE + """
SELECT 'plain' AS variant, count(DISTINCT uid) AS prompts, round(avg(score), 6) AS accuracy, (SELECT count(*) FROM a WHERE accepted) AS accepted_groups FROM p_rows
UNION ALL SELECT 'hint', count(DISTINCT uid), round(avg(score), 6), (SELECT count(*) FROM b WHERE accepted) FROM h_rows
UNION ALL SELECT 'cot', count(DISTINCT uid), round(avg(score), 6), (SELECT count(*) FROM c WHERE accepted) FROM c_rows""")
def _(t):
    _r, counts = ro.adaptive_guidance(views.rollouts(t), "uid", "variant", "score", "resp_len", BOUNDS, 0.25, 50, k=8)
    return counts.select("variant", "prompts", r6(F.col("accuracy")).alias("accuracy"), F.col("accepted_groups").cast("bigint").alias("accepted_groups"))


@query("balanced_variants", "SELECT conv_id, turn, i AS sample_idx, CASE WHEN i < 4 THEN 'plain' ELSE 'hint' END AS variant, i < 4 AS on_policy FROM conversations, range(0, 8) r(i) WHERE role = 'user'")
def _(t):
    out = ro.balanced_variants(t.conversations.filter("role = 'user'").select("conv_id", "turn"), ["plain", "hint"], 8)
    return out.withColumn("sample_idx", F.col("sample_idx").cast("bigint"))


SRC = """src AS (SELECT page_id, regexp_extract(url, '([a-z]+)/[^/]*/', 1) AS x, concat_ws('/', regexp_extract(url, '^[a-z]+://[^/]*\\.([a-z]+)/', 1), regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1)) AS data_source,
  (page_id % 2)::DOUBLE AS reward, (page_id % 3 = 0)::INT::DOUBLE AS fmt FROM pages)"""


@query("score_by_source", f"""WITH {SRC}, p AS (SELECT reward, fmt, unnest(string_split(data_source, '/')[1:3]) AS name, unnest(['domain', 'source', 'subcategory'][1:len(string_split(data_source, '/')[1:3])]) AS level FROM src)
SELECT level, name, round(avg(reward), 6) AS score, round(avg(fmt), 6) AS format_score FROM p GROUP BY ALL
UNION ALL SELECT 'all', 'all', round(avg(reward), 6), round(avg(fmt), 6) FROM src""")
def _(t):
    src = F.concat_ws("/", F.regexp_extract("url", r"^[a-z]+://[^/]*\.([a-z]+)/", 1), F.regexp_extract("url", r"^[a-z]+://[^/]*/(.*)$", 1))
    df = t.pages.select(src.alias("data_source"), (F.col("page_id") % 2).cast("double").alias("reward"), (F.col("page_id") % 3 == 0).cast("double").alias("fmt"))
    return ro.score_by_source(df, "data_source", "reward", "fmt").withColumns({c: r6(F.col(c)) for c in ("score", "format_score")})


@query("pass_at_k", f"WITH {R}, b AS (SELECT uid, max(score) AS b FROM rollouts GROUP BY uid) SELECT round(avg((b = 1)::INT), 6) AS pass_at_k, count(*) AS prompts FROM b")
def _(t):
    return ro.pass_at_k(views.rollouts(t), "uid", "score").withColumn("pass_at_k", r6(F.col("pass_at_k")))


TOTALS = """count(*) AS total_train_samples, sum(resp_len)::BIGINT AS total_train_tokens, sum(resp_len * score)::DOUBLE AS total_train_correct_tokens,
 sum(resp_len * (1 - score))::DOUBLE AS total_train_incorrect_tokens, sum(score)::DOUBLE AS total_train_correct_responses, sum(1 - score)::DOUBLE AS total_train_incorrect_responses"""


@query("token_totals", f"WITH {R} SELECT {TOTALS} FROM rollouts")
def _(t):
    return ro.token_totals(views.rollouts(t), "score", "resp_len")


@query("group_responses", """WITH i AS (SELECT *, row_number() OVER (PARTITION BY role, turn ORDER BY conv_id) - 1 AS i FROM conversations)
SELECT role, turn, i // 32 AS block, md5(string_agg(text, '|' ORDER BY i)) AS responses, string_agg((length(text) % 2)::VARCHAR, ',' ORDER BY i) AS scores FROM i GROUP BY ALL""")
def _(t):
    df = t.conversations.withColumn("score", F.length("text") % 2)
    out = ro.group_responses(df, ["role", "turn"], ["conv_id"], "text", "score", width=32)
    return out.select("role", "turn", "block", F.md5(F.array_join("responses", "|")).alias("responses"), joined(F.col("scores")).alias("scores"))


@query("pairwise_accuracy", f"""WITH {R}, p AS (SELECT a.uid, a.rm_score - b.rm_score AS ds, a.score - b.score AS da FROM rollouts a JOIN rollouts b ON a.uid = b.uid AND a.sample_idx < b.sample_idx),
g AS (SELECT uid, CASE WHEN sum(abs(da)) = 0 THEN 0.5 ELSE sum(CASE WHEN (ds > 0) = (da > 0) THEN abs(da) ELSE 0 END) / sum(abs(da)) END AS acc FROM p GROUP BY uid),
u AS (SELECT DISTINCT uid FROM rollouts) SELECT uid, round(coalesce(acc, 0.5), 6) AS pair_acc FROM u LEFT JOIN g USING (uid)""")
def _(t):
    return ro.pairwise_accuracy(views.rollouts(t, ordered=True), "uid", views.ROLLOUT_ORDER, "rm_score", "score").withColumn("pair_acc", r6(F.col("pair_acc")))


@query("pairwise_accuracy_graded", f"""WITH {R}, q AS (SELECT uid, sample_idx, rm_score, (score + format_score) / 2 AS grade FROM rollouts),
p AS (SELECT a.uid, a.rm_score - b.rm_score AS ds, a.grade - b.grade AS da FROM q a JOIN q b ON a.uid = b.uid AND a.sample_idx < b.sample_idx),
g AS (SELECT uid, CASE WHEN sum(abs(da)) = 0 THEN 0.5 ELSE sum(CASE WHEN (ds > 0) = (da > 0) THEN abs(da) ELSE 0 END) / sum(abs(da)) END AS acc FROM p GROUP BY uid),
u AS (SELECT DISTINCT uid FROM rollouts) SELECT round(avg(coalesce(acc, 0.5)), 6) AS pair_acc FROM u LEFT JOIN g USING (uid)""")
def _(t):
    df = views.rollouts(t, ordered=True).withColumn("grade", (F.col("score") + F.col("format_score")) / 2)
    return ro.pairwise_accuracy(df, "uid", views.ROLLOUT_ORDER, "rm_score", "grade").agg(r6(F.avg("pair_acc")).alias("pair_acc"))


@query("ce_preference_loss", f"WITH {R}, p AS (SELECT 1 / (1 + exp(-3.0 * rm_score * resp_len)) AS p, score FROM rollouts) SELECT round(avg(-(score * greatest(ln(p), -100) + (1 - score) * greatest(CASE WHEN p = 1 THEN -100 ELSE ln(1 - p) END, -100))), 5) AS loss FROM p")
def _(t):
    df = ro.ce_preference_loss(views.rollouts(t), F.col("rm_score") * F.col("resp_len"), F.col("score"), 3.0)
    return df.select(F.round("loss", 5).alias("loss"))


@query("mixin_correct", f"""WITH {R}, n AS (SELECT *, row_number() OVER (PARTITION BY uid, score = 1 ORDER BY sample_idx) AS k FROM rollouts WHERE variant = 'hint'),
o AS (SELECT uid, score AS o_score, resp_len AS o_len, row_number() OVER (PARTITION BY uid ORDER BY sample_idx) AS k FROM rollouts WHERE variant = 'plain' AND score = 0)
SELECT n.uid, sample_idx, CASE WHEN n.score <> 1 AND o_len IS NOT NULL THEN o_score ELSE score END AS score, CASE WHEN n.score <> 1 AND o_len IS NOT NULL THEN o_len ELSE resp_len END AS resp_len,
  n.score <> 1 AND o_len IS NOT NULL AS replaced FROM n LEFT JOIN o ON o.uid = n.uid AND o.k = n.k""")
def _(t):
    # staged, as right, wrong and old rows are read from it, and wrong and old ones twice to be ranged
    df = stage(views.rollouts(t, indexed=True, only=["score", "resp_len", "variant"]).filter("variant <> 'cot'"), "rollouts")
    new, old = df.filter("variant = 'hint'").drop("variant"), df.filter("variant = 'plain'").drop("variant")
    return ro.mixin_correct(new, old, "uid", ["sample_idx"], "score", ["score", "resp_len"])


def _tokens(df, *cols):
    out = tk.explode_tokens(df, ["id"], **{c: c for c in cols})
    return out.select("id", F.col("t").cast("bigint").alias("t"), *[r6(F.col(c)).alias(c) for c in cols])


WHITE = "({x} - w.mean) / sqrt(w.var + 1e-8)"
STATS = "w AS (SELECT count(*) AS n, sum({x}) AS total, avg({x}) AS mean, var_samp({x}) AS var FROM {src} WHERE m = 1)"


@query("masked_stats", f"WITH {LT}, {STATS.format(x='r', src='long_tokens')} SELECT n, round(total, 6) AS total, round(mean, 6) AS mean, round(var, 6) AS var FROM w")
def _(t):
    s = tk.masked_stats(views.token_view(t), "rewards", "mask")
    return s.select("n", *[r6(F.col(c)).alias(c) for c in ("total", "mean", "var")])


@query("masked_whiten", f"WITH {LT}, {STATS.format(x='r', src='long_tokens')} SELECT id, t, round({WHITE.format(x='r')} + w.mean, 6) + 0.0 AS white FROM long_tokens, w")
def _(t):
    return _tokens(tk.masked_whiten(views.token_view(t), "rewards", "mask", "white", keep_mean=True), "white")


@query("row_masked_mean", f"WITH {LT} SELECT id, round(sum(r * m) / sum(m), 6) + 0.0 AS mean FROM long_tokens GROUP BY id")
def _(t):
    return views.token_view(t).select("id", r6(tk.row_masked_mean(F.col("rewards"), F.col("mask"))).alias("mean"))


def _back(x, factor):
    return f"""back AS (SELECT id, t, {x} AS y FROM base b WHERE t = (SELECT max(t) FROM base c WHERE c.id = b.id)
  UNION ALL SELECT b.id, b.t, b.{x} + {factor} * back.y FROM back JOIN base b ON b.id = back.id AND b.t = back.t - 1)"""


GAE = f"""WITH RECURSIVE {LT}, base AS (SELECT *, r + 0.99 * coalesce(lead(v) OVER (PARTITION BY id ORDER BY t), 0) - v AS d FROM long_tokens),
{_back('d', '0.99 * 0.95')}, j AS (SELECT id, t, m, y, y + v AS ret FROM back JOIN long_tokens USING (id, t)), {STATS.format(x='y', src='j')}
SELECT id, t, round({WHITE.format(x='y')}, 6) + 0.0 AS advantages, round(ret, 6) + 0.0 AS returns FROM j, w"""


@query("gae", GAE)
def _(t):
    return _tokens(tk.gae(views.token_view(t), "rewards", "vals", "mask", 0.99, 0.95), "advantages", "returns")


REINFORCE = f"""WITH RECURSIVE {LT}, base AS (SELECT * FROM long_tokens),
back AS (SELECT id, t, r AS y, m FROM base b WHERE t = (SELECT max(t) FROM base c WHERE c.id = b.id)
  UNION ALL SELECT b.id, b.t, b.r + 0.9 * back.y * back.m, b.m FROM back JOIN base b ON b.id = back.id AND b.t = back.t - 1),
{STATS.format(x='y', src='back')} SELECT id, t, round({WHITE.format(x='y')} * m, 6) + 0.0 AS advantages, round(y, 6) + 0.0 AS returns FROM back, w"""


@query("reinforce_pp", REINFORCE)
def _(t):
    return _tokens(tk.reinforce_pp(views.token_view(t), "rewards", "mask", 0.9), "advantages", "returns")


def _token_rows(t):
    return tk.explode_tokens(views.token_view(t), ["id"], r="rewards", v="vals", m="mask").withColumn("t", F.col("t").cast("bigint"))


@query("gae_token_rows", GAE)
def _(t):
    out = affine.gae_rows(_token_rows(t), ["id"], "t", "r", "v", "m", 0.99, 0.95)
    return out.select("id", "t", r6(F.col("advantages")).alias("advantages"), r6(F.col("returns")).alias("returns"))


@query("reinforce_pp_token_rows", REINFORCE)
def _(t):
    out = affine.reinforce_pp_rows(_token_rows(t), ["id"], "t", "r", "m", 0.9)
    return out.select("id", "t", r6(F.col("advantages")).alias("advantages"), r6(F.col("returns")).alias("returns"))


@query("remax", f"""WITH {LT}, s AS (SELECT id, t, m, sum(r * m) OVER (PARTITION BY id ORDER BY t DESC) AS ret, first(v) OVER (PARTITION BY id ORDER BY t) AS b FROM long_tokens)
SELECT id, t, round(ret - b * m, 6) + 0.0 AS advantages, round(ret, 6) + 0.0 AS returns FROM s""")
def _(t):
    return _tokens(tk.remax(views.token_view(t).withColumn("b", F.element_at("vals", 1)), "rewards", "mask", "b"), "advantages", "returns")


@query("rloo", f"""WITH RECURSIVE {LT}, rowm AS (SELECT id, any_value(uid) AS uid, sum(r * m) / sum(m) AS rm, (id % 2)::DOUBLE AS fs, sum(m) AS n_valid FROM long_tokens GROUP BY id),
g AS (SELECT uid, count(*) AS n, sum(rm) AS ts, sum(fs) AS fsum FROM rowm GROUP BY uid),
base AS (SELECT l.id, t, m, CASE WHEN m = 0 THEN 0 WHEN n > 1 THEN r * n / (n - 1) - ts / (n - 1) ELSE r END AS a,
  CASE WHEN t <> n_valid - 1 THEN 0 WHEN n > 1 THEN fs * n / (n - 1) - fsum / (n - 1) ELSE fs END AS b FROM long_tokens l JOIN rowm USING (id) JOIN g ON g.uid = rowm.uid),
back AS (SELECT id, t, m, a AS ya, b AS yb FROM base q WHERE t = (SELECT max(t) FROM base c WHERE c.id = q.id)
  UNION ALL SELECT q.id, q.t, q.m, q.a + 0.9 * ya, q.b + 1.0 * yb FROM back JOIN base q ON q.id = back.id AND q.t = back.t - 1),
j AS (SELECT id, t, m, ya + yb AS y FROM back), {STATS.format(x='y', src='j')}
SELECT id, t, round({WHITE.format(x='y')}, 6) + 0.0 AS advantages, round(y, 6) + 0.0 AS returns FROM j, w""")
def _(t):
    df = views.token_view(t).withColumn("gt", (F.col("id") % 2).cast("double"))
    return _tokens(tk.rloo(df, "uid", "mask", "rewards", "gt", 0.9, 1.0), "advantages", "returns")


@query("eos_mask", f"""WITH {views.IDS}, e AS (SELECT doc_id, ids, list_filter(range(1, len(ids) + 1), lambda i: ids[i] IN (9421869, 13174944))[1] AS p FROM doc_ids)
SELECT doc_id, len(ids)::BIGINT AS n, coalesce(p, len(ids))::BIGINT AS kept FROM e""")
def _(t):
    # ids of the words "the" and "la"
    ids = views.doc_ids(t)
    m = tk.eos_mask(F.col("ids"), [9421869, 13174944])
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n"), F.aggregate(m, F.lit(0), lambda s, x: s + x).cast("bigint").alias("kept"))


@query("position_ids", f"""WITH {LT} SELECT id, t, greatest(sum(p) OVER (PARTITION BY id ORDER BY t) - 1, 0)::BIGINT AS pos
FROM (SELECT id, t, CASE WHEN t < id % 7 THEN 0 ELSE m END AS p FROM long_tokens)""")
def _(t):
    m = F.transform("mask", lambda x, i: F.when(i < F.col("id") % 7, 0).otherwise(x))
    return views.token_view(t).select("id", F.posexplode(tk.position_ids(m)).alias("t", "pos")).select(
        "id", F.col("t").cast("bigint").alias("t"), F.col("pos").cast("bigint").alias("pos"))


@query("remove_pad", f"WITH {TV} SELECT id, list_sum(mask)::BIGINT AS n, round(coalesce(list_sum(rewards[len(rewards) - list_sum(mask)::INT + 1:]), 0), 6) + 0.0 AS total FROM token_view")
def _(t):
    kept = tk.remove_pad(F.col("rewards"), F.col("mask"))
    return views.token_view(t).select("id", F.size(kept).cast("bigint").alias("n"), r6(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)).alias("total"))


KLS = {"kl": "l - f", "abs": "abs(l - f)", "mse": "0.5 * (l - f) * (l - f)", "low_var_kl": "least(greatest(exp(f - l) - (f - l) - 1, -10), 10)"}


@query("kl_penalty", f"WITH {LT}, x AS (SELECT id, t, lp * 20 AS l, ref_lp * 20 AS f FROM long_tokens) SELECT id, t, "
       + ", ".join(f"round({e}, 6) + 0.0 AS {k}" for k, e in KLS.items()) + " FROM x")
def _(t):
    tok = tk.explode_tokens(views.token_view(t), ["id"], l="lp", f="ref_lp")
    return tok.select("id", F.col("t").cast("bigint").alias("t"), *[r6(tk.kl_penalty(F.col("l") * 20, F.col("f") * 20, k)).alias(k) for k in KLS])


@query("kl_shaped_reward", f"""WITH {LT}, n AS (SELECT id, sum(m) AS n, sum((old_lp - ref_lp) * m) / sum(m) AS seq_kl FROM long_tokens GROUP BY id)
SELECT id, t, round(CASE WHEN t = n - 1 THEN (id % 3)::DOUBLE ELSE 0 END - 0.2 * (old_lp - ref_lp) * m, 6) + 0.0 AS shaped, round(seq_kl, 6) + 0.0 AS seq_kl FROM long_tokens JOIN n USING (id)""")
def _(t):
    df = views.token_view(t).withColumn("scores", tk.expand_to_token(F.col("id") % 3, F.col("mask")))
    out = tk.kl_shaped_reward(df, "scores", "old_lp", "ref_lp", "mask", 0.2)
    tok = out.select("id", "seq_kl", F.posexplode("shaped").alias("t", "shaped"))
    return tok.select("id", F.col("t").cast("bigint").alias("t"), r6(F.col("shaped")).alias("shaped"), r6(F.col("seq_kl")).alias("seq_kl"))


@query("expand_to_token", f"WITH {LT} SELECT id, t, CASE WHEN t = n - 1 THEN (id % 3)::DOUBLE ELSE 0.0::DOUBLE END AS score FROM long_tokens JOIN (SELECT id, sum(m) AS n FROM long_tokens GROUP BY id) USING (id)")
def _(t):
    return views.token_view(t).select("id", F.posexplode(tk.expand_to_token(F.col("id") % 3, F.col("mask"))).alias("t", "score")).withColumn("t", F.col("t").cast("bigint"))


def _policy_sql(strategy, shaped, token_mean=True):
    def mean(c, cond, name):
        return f"round(coalesce(sum({c} * m) FILTER ({cond}) / sum(m) FILTER ({cond}), 0), 6) + 0.0 AS {name}"
    total = mean("loss", "true", "pg_loss") if token_mean else "round(sum(loss * m) / 64, 6) + 0.0 AS pg_loss"
    return f"""SELECT '{strategy}' AS strategy, {total}, {mean('cut', 'true', 'pg_clipfrac')}, {mean('kl', 'true', 'ppo_kl')},
 {mean('loss', 'onp', 'on_pg_loss')}, {mean('loss', 'NOT onp', 'off_pg_loss')}, {mean('kl', 'onp', 'on_ppo_kl')}, {mean('kl', 'NOT onp', 'off_ppo_kl')},
 {mean('cut', 'onp', 'on_pg_clipfrac')}, {mean('cut', 'NOT onp', 'off_pg_clipfrac')} FROM (SELECT *, (-a * least(greatest(r, 0.8), 1.2) > loss)::INT AS cut FROM (
 SELECT *, greatest(-a * r, -a * CASE WHEN onp THEN least(greatest(r, 0.9), 1.1) ELSE r END) AS loss FROM (SELECT id, t, m, onp, a, kl, CASE WHEN onp THEN r ELSE {shaped} END AS r FROM x)))"""


POLICY = {"constant": ("r / (r + 0.1)", 0.1), "percentile": ("r / (r + greatest((SELECT quantile_cont(r, 0.3) FROM x WHERE NOT onp), 1e-4))", 0.3), "power": ("pow(r, 0.5)", 0.5)}


@query("policy_diagnostics", f"WITH {LT}, x AS (SELECT id, t, m, on_policy = 1 AS onp, rewards AS a, old_lp - lp AS kl, exp(lp - old_lp) AS r FROM (SELECT *, r AS rewards FROM long_tokens)) "
       + " UNION ALL ".join(_policy_sql(k, v[0], k != "power") for k, v in POLICY.items()))
def _(t):
    df, out = views.token_view(t), None
    for k, (_s, v) in POLICY.items():
        one = tk.policy_diagnostics(df, "old_lp", "lp", "rewards", "mask", "on_policy", 0.1, k, v, token_mean=k != "power")
        one = one.select(F.lit(k).alias("strategy"), *[r6(F.col(c)).alias(c) for c in one.columns])
        out = one if out is None else out.unionByName(one)
    return out


@query("value_diagnostics", f"""WITH {LT}, x AS (SELECT m, pow(v - ref_lp, 2) AS a, pow(least(greatest(v, r - 0.05), r + 0.05) - ref_lp, 2) AS b FROM long_tokens)
SELECT round(0.5 * sum(greatest(a, b) * m) / sum(m), 6) AS vf_loss, round(sum((b > a)::INT * m) / sum(m), 6) AS vf_clipfrac FROM x""")
def _(t):
    v = tk.value_diagnostics(views.token_view(t), "vals", "ref_lp", "rewards", "mask", 0.05)
    return v.select(*[r6(F.col(c)).alias(c) for c in v.columns])


def _spread(c, name):
    return f"round(avg({c}), 6) + 0.0 AS \"{name}/mean\", round(max({c}), 6) + 0.0 AS \"{name}/max\", round(min({c}), 6) + 0.0 AS \"{name}/min\""


@query("data_metrics", f"""WITH {LT}, s AS (SELECT id, sum(r) AS s, sum(lp) AS q, sum(m)::DOUBLE AS n, (id % 64)::DOUBLE AS p, (id % 2)::DOUBLE AS vs, (id % 5 = 0)::INT::DOUBLE AS fs FROM long_tokens GROUP BY id),
a AS (SELECT {_spread('s', 'critic/score')}, {_spread('q', 'critic/rewards')}, {_spread('n', 'response_length')}, round(avg((n = 64)::INT), 6) AS "response_length/clip_ratio",
 {_spread('p', 'prompt_length')}, round(avg((p = 63)::INT), 6) AS "prompt_length/clip_ratio", round(avg(vs), 6) AS "train/filter_accuracy", round(avg(fs), 6) AS "train/format_accuracy" FROM s),
b AS (SELECT {_spread('r', 'critic/advantages')}, {_spread('old_lp', 'critic/returns')}, {_spread('v', 'critic/values')},
 round(1.0 - var_samp(old_lp - v) / (var_samp(old_lp) + 1e-5), 6) + 0.0 AS "critic/vf_explained_var" FROM long_tokens WHERE m = 1)
SELECT * FROM (UNPIVOT a ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT * FROM (UNPIVOT b ON COLUMNS(*) INTO NAME metric VALUE value)""")
def _(t):
    df = views.token_view(t).withColumns({"p": F.col("id") % 64, "vs": (F.col("id") % 2).cast("double"), "fs": (F.col("id") % 5 == 0).cast("double")})
    out = tk.data_metrics(df, "rewards", "lp", "rewards", "old_lp", "vals", "mask", "p", "vs", "fs", 63)
    return out.withColumn("value", r6(F.col("value")))


STAGE = "CASE event_type WHEN 'click' THEN 'gen' WHEN 'view' THEN 'ref' WHEN 'error' THEN 'adv' ELSE event_type END"


@query("timing_metrics", f"""WITH {R}, l AS (SELECT sum(prompt_len) AS p, sum(resp_len) AS r FROM rollouts), s AS (SELECT {STAGE} AS stage, sum(value) AS seconds FROM events GROUP BY 1)
SELECT 'timing_s/' || stage AS metric, round(seconds, 6) AS value FROM s
UNION ALL SELECT 'timing_per_token_ms/' || stage, round(seconds * 1000 / CASE stage WHEN 'gen' THEN r ELSE p + r END, 6) FROM s, l WHERE stage IN ('gen', 'ref', 'adv')""")
def _(t):
    timings = t.events.groupBy(F.expr(STAGE).alias("stage")).agg(F.sum("value").alias("seconds"))
    return tk.timing_metrics(views.rollouts(t), "prompt_len", "resp_len", timings).withColumn("value", r6(F.col("value")))


@query("cloze_accuracy", f"""WITH {LT}, x AS (SELECT id, bool_and(m = 0 OR round(r, 0) = round(v, 0)) AS ok FROM long_tokens GROUP BY id)
SELECT count(*) AS rows, count(*) FILTER (ok) AS correct, round(avg(ok::INT), 6) AS accuracy FROM x""")
def _(t):
    df = views.token_view(t).withColumn("a", F.transform("rewards", lambda x: F.round(x, 0))).withColumn("b", F.transform("vals", lambda x: F.round(x, 0)))
    return tk.cloze_accuracy(df, "a", "b", "mask").withColumn("accuracy", r6(F.col("accuracy")))
