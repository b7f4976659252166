"""Derived views used by the queries, each as DataFrame code and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import word_ids
from ..operators.index import with_group_index
from ..session import spread, stage

ROLLOUT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_tax"]

ROLLOUTS = """rollouts AS (
  SELECT l_orderkey AS uid,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_tax) - 1 AS sample_idx,
    CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
    CASE WHEN l_returnflag <> 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS format_score,
    CASE WHEN l_linestatus = 'F' THEN 'plain' WHEN l_tax < 0.04 THEN 'hint' ELSE 'cot' END AS variant,
    l_quantity::INT AS resp_len, l_discount AS rm_score, l_partkey AS prompt_len
  FROM lineitem)"""


def rollouts(t, indexed: bool = False, ordered: bool = False, only: list[str] | None = None) -> DataFrame:
    """Graded samples: the order is the prompt group, a line is one response.

    ``ordered`` rows carry the columns that ``sample_idx`` counts by, which give the same order without a sort.
    ``only`` these columns, with ``uid``, are numbered and written if ``indexed``.
    """
    df = t.lineitem
    cols = [
        F.col("l_orderkey").alias("uid"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("score"),
        F.when(F.col("l_returnflag") != "A", 1.0).otherwise(0.0).alias("format_score"),
        F.when(F.col("l_linestatus") == "F", "plain").when(F.col("l_tax") < 0.04, "hint").otherwise("cot").alias("variant"),
        F.col("l_quantity").cast("int").alias("resp_len"),
        F.col("l_discount").alias("rm_score"),
        F.col("l_partkey").alias("prompt_len"),
    ]
    if indexed:
        rows = df.select(*cols, *ROLLOUT_ORDER)
        if only is not None:
            rows = rows.select("uid", *only, *ROLLOUT_ORDER)
        return with_group_index(rows, ["uid"], [F.col(c) for c in ROLLOUT_ORDER], "sample_idx", [] if ordered else ROLLOUT_ORDER)
    if ordered:
        cols += ROLLOUT_ORDER
    return df.select(*cols)


# One response per vector: its numbers stand for per-token values, and the response
# ends at the first number above 0.25.
TOKENS = """token_view AS (
  SELECT vec_id AS id, label::BIGINT AS uid, vec_id % 2 AS on_policy, rewards, vals,
    list_transform(rewards, lambda x: -abs(x)) AS old_lp,
    list_transform(vals, lambda x: -abs(x)) AS lp,
    list_transform(range(1, len(rewards) + 1), lambda i: -(abs(rewards[i]) + abs(vals[i])) / 2) AS ref_lp,
    list_transform(range(1, len(rewards) + 1), lambda i: CASE WHEN i <= last_pos THEN 1 ELSE 0 END) AS mask
  FROM (SELECT *, coalesce(list_position(list_transform(rewards, lambda x: x > 0.25), true), len(rewards)) AS last_pos
        FROM (SELECT vec_id, label, embedding::DOUBLE[] AS rewards, list_reverse(embedding::DOUBLE[]) AS vals FROM embeddings)))"""

# The same, one row per token.
LONG_TOKENS = TOKENS + """, long_tokens AS (
  SELECT id, uid, on_policy, unnest(range(0, len(mask))) AS t, unnest(rewards) AS r, unnest(vals) AS v,
    unnest(old_lp) AS old_lp, unnest(lp) AS lp, unnest(ref_lp) AS ref_lp, unnest(mask) AS m FROM token_view)"""


def token_view(t) -> DataFrame:
    base = t.embeddings.select(
        F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("uid"), (F.col("vec_id") % 2).alias("on_policy"),
        F.col("embedding").cast("array<double>").alias("rewards"))
    base = base.withColumn("vals", F.reverse("rewards"))
    hit = F.array_position(F.transform("rewards", lambda x: x > 0.25), True)
    end = F.when(hit > 0, hit).otherwise(F.size("rewards"))
    return base.select(
        "*",
        F.transform("rewards", lambda x: -F.abs(x)).alias("old_lp"),
        F.transform("vals", lambda x: -F.abs(x)).alias("lp"),
        F.zip_with("rewards", "vals", lambda x, y: -(F.abs(x) + F.abs(y)) / 2).alias("ref_lp"),
        F.transform("rewards", lambda x, i: F.when(i < end, 1).otherwise(0)).alias("mask"),
    )


DIALOG = """dialog AS (
  SELECT a.conv_id, a.turn, regexp_extract(z.text, '^([^ \\t\\n]*)', 1) AS topic,
    p.text AS context, regexp_extract(p.text, '^([^.!?]*[.!?]?)', 1) AS knowledge, a.text AS response
  FROM conversations a JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1
  JOIN conversations z ON z.conv_id = a.conv_id AND z.turn = 0 WHERE a.role = 'assistant')"""


def dialog(t) -> DataFrame:
    c = t.conversations
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    head = c.filter("turn = 0").select("conv_id", F.regexp_extract("text", r"^([^ \t\n]*)", 1).alias("topic"))
    return (
        c.filter("role = 'assistant'").join(prev, ["conv_id", "turn"]).join(head, "conv_id")
        .select("conv_id", "turn", "topic", "context",
                F.regexp_extract("context", r"^([^.!?]*[.!?]?)", 1).alias("knowledge"), F.col("text").alias("response"))
    )


PAIRS = """pairs AS (
  SELECT a.conv_id * 1000 + a.turn AS uid, p.text AS text_a, a.text AS text_b, CASE WHEN a.turn % 4 = 1 THEN 'yes' ELSE 'no' END AS label
  FROM conversations a JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1
  WHERE a.role = 'assistant' AND p.role = 'user')"""


def pairs(t) -> DataFrame:
    c = t.conversations
    prev = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("text_a"))
    return c.filter("role = 'assistant'").join(prev, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), "text_a", F.col("text").alias("text_b"),
        F.when(F.col("turn") % 4 == 1, "yes").otherwise("no").alias("label"))


# Token ids of documents: a word's id is the first 6 hex digits of its digest, 1-based.
IDS = """doc_ids AS (
  SELECT doc_id, source, lang, list_transform(list_filter(string_split_regex(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), ' '), lambda w: w <> ''),
    lambda w: ('0x' || substr(md5(lower(w)), 1, 6))::BIGINT + 1) AS ids FROM documents)"""


def documents(t) -> DataFrame:
    """Documents over all cores, for queries that work hard on each text."""
    return spread(t.documents, "doc_id")


def doc_ids(t) -> DataFrame:
    """The token table: encoded once and written, as packing and chunking read it several times."""
    return stage(documents(t).select("doc_id", "source", "lang", word_ids(F.col("text")).alias("ids")), "token_table")


# Answers with a boxed answer in eight notations and a marked number; the truth
# agrees for two of three conversations.
FORMS = ["{n}", "\\frac{{{n}}}{{7}}", "{n}/7", "\\dfrac{{{n}}}{{7}}", "{n}\\%", "\\left( {n}, 7 \\right)", "x = {n}", "{n} \\text{{ cm}}"]
TRUTHS = ["{n}", "{n}/7", "\\frac{{{n}}}{{7}}", "\\frac{{{n}}}{{7}}", "{n}", "({n},7)", "{n}", "{n}"]


def _form_sql(forms: list[str], number: str) -> str:
    def one(f):
        return "'" + f.format(n="' || " + number + " || '") + "'"
    return "CASE n % 8 " + " ".join(f"WHEN {i} THEN {one(f)}" for i, f in enumerate(forms)) + " END"


ANSWERS = f"""answers AS (
  SELECT conv_id, turn, n, text || ' So it is \\boxed{{' || {_form_sql(FORMS, 'n')} || '}}' || chr(10) || '#### ' || n AS response, {_form_sql(TRUTHS, 'm')} AS truth, m::VARCHAR AS number
  FROM (SELECT *, CASE WHEN conv_id % 3 = 0 THEN n + 1 ELSE n END AS m FROM (SELECT *, length(text) % 97 AS n FROM conversations)))"""


def _form(forms, number):
    out = None
    for i, f in enumerate(forms):
        left, right = f.replace("{n}", "\x01", 1).format().split("\x01")
        text = F.concat(F.lit(left), number.cast("string"), F.lit(right))
        out = F.when(F.col("n") % 8 == i, text) if out is None else out.when(F.col("n") % 8 == i, text)
    return out


def answers(t) -> DataFrame:
    c = t.conversations.withColumn("n", F.length("text").cast("bigint") % 97)
    c = c.withColumn("m", F.when(F.col("conv_id") % 3 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return c.select(
        "conv_id", "turn", "n",
        F.concat("text", F.lit(" So it is \\boxed{"), _form(FORMS, F.col("n")), F.lit("}\n#### "), F.col("n").cast("string")).alias("response"),
        _form(TRUTHS, F.col("m")).alias("truth"), F.col("m").cast("string").alias("number"))


# Retrieval fixture: a vector is a chunk, its label the document, label % 3 the dataset.
CHUNKS = "chunks AS (SELECT vec_id AS chunk_id, label::BIGINT AS doc_id, (label % 3)::BIGINT AS dataset_idx, embedding::DOUBLE[] AS vec FROM embeddings)"


def chunks(t) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("doc_id"),
        (F.col("label") % 3).cast("bigint").alias("dataset_idx"), F.col("embedding").cast("array<double>").alias("vec"))
