"""Queries over answers: extraction, normalisation, formats, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading as gr, text as tx
from ..functions.numeric import values_equal
from ..operators import scoring as sc, tokens as tk
from ..session import fresh_path, spread_waits
from . import views
from .registry import joined, query, r6

A = views.ANSWERS


def chain_sql(source: str, column: str, out: str, steps: list[str]) -> str:
    """Subqueries that apply one rule after the other; ``$x`` is the value so far."""
    cur = column
    for i, e in enumerate(steps):
        name = f"{out}_{i}" if i < len(steps) - 1 else out
        source, cur = f"(SELECT *, {e.replace('$x', cur)} AS {name} FROM {source})", name
    return source


def _swaps(pairs):
    e = "$x"
    for old, new in pairs:
        old, new = (f"'{v}'" if v != "\n" else "chr(10)" for v in (old, new))
        e = f"replace({e}, {old}, {new})"
    return e


TEXT_WRAP = "'^\\\\text\\{(.+?)\\}$'"
BOX = "regexp_extract(string_split($x, '\\boxed')[-1], '^[^{}]*(\\{(?:[^{}]|\\{[^{}]*\\})*\\})', 1)"
CONTENT = f"substr({BOX}, 2, length({BOX}) - 2)"


def norm_sql(strict: bool) -> list[str]:
    bad = "WHEN len(string_split($x, '/')) = 2 AND NOT regexp_matches($x, '^[+-]?[0-9](_?[0-9])*/[+-]?[0-9](_?[0-9])*$') THEN NULL " if strict else ""
    return [
        _swaps(gr._MATH_SWAPS),
        "CASE WHEN len(string_split($x, '\\text{ ')) <= 2 THEN string_split($x, '\\text{ ')[1] END",
        "regexp_replace(replace(replace(replace($x, '\\%', ''), ' .', ' 0.'), '{.', '{0.'), '^\\.', '0.')",
        "CASE WHEN len(string_split($x, '=')) = 2 AND length(string_split($x, '=')[1]) <= 2 THEN string_split($x, '=')[2] ELSE $x END",
        "CASE WHEN ends_with($x, '\\sqrt') THEN NULL ELSE regexp_replace($x, '\\\\sqrt([^{])', '\\\\sqrt{\\1}', 'g') END",
        "replace($x, ' ', '')",
        "CASE WHEN ends_with($x, '\\frac') THEN NULL ELSE regexp_replace(regexp_replace($x, '\\\\frac([^{])([^{])', '\\\\frac{\\1}{\\2}', 'g'), '\\\\frac([^{])\\{', '\\\\frac{\\1}{', 'g') END",
        "CASE WHEN $x = '0.5' THEN '\\frac{1}{2}' ELSE $x END",
        "CASE WHEN regexp_matches($x, '^(-?[1-9][0-9]*|0)/(-?[1-9][0-9]*|0)$') THEN regexp_replace($x, '^([^/]*)/(.*)$', '\\\\frac{\\1}{\\2}') " + bad + "ELSE $x END",
    ]


UNWRAP = ["trim($x)", f"CASE WHEN regexp_matches($x, {TEXT_WRAP}) THEN trim(regexp_extract($x, {TEXT_WRAP}, 1)) ELSE $x END"]


def _units():
    e = "$x"
    for u in gr.UNITS:
        e = f"regexp_replace({e}, '{u}(es)?(s)? *(\\^[0-9]+)?', '', 'g')"
    return f"regexp_replace({e}, '\\^ *\\\\circ', '', 'g')"


FLOAT = "regexp_matches($x, '^[ \\t\\n]*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?[ \\t\\n]*$') AND abs(TRY_CAST($x AS DOUBLE) - round_even(TRY_CAST($x AS DOUBLE), 0)) <= 1e-7"
COMMAS = "$x"
for _ in range(4):
    COMMAS = f"regexp_replace({COMMAS}, '([0-9]),([0-9][0-9][0-9])([^0-9]|$)', '\\1\\2\\3', 'g')"
EXPR = [
    f"CASE WHEN regexp_matches($x, {TEXT_WRAP}) THEN regexp_extract($x, {TEXT_WRAP}, 1) ELSE $x END",
    _swaps([("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]),
    _units(),
    "CASE WHEN starts_with($x, '{') AND ends_with($x, '}') THEN substr($x, 2, length($x) - 2) ELSE $x END",
    "regexp_replace($x, ',\\\\! *', '', 'g')",
    f"CASE WHEN {FLOAT} THEN round_even(TRY_CAST($x AS DOUBLE), 0)::BIGINT::VARCHAR ELSE $x END",
    "regexp_replace($x, '- *', '-', 'g')",
    "regexp_replace(regexp_replace($x, '([0-9]) +([0-9])', '\\1+\\2', 'g'), '([0-9]) +([0-9])', '\\1+\\2', 'g')",
    "lower(regexp_replace($x, '[ {}]', '', 'g'))",
    f"CASE WHEN {FLOAT.replace('$x', '(' + COMMAS + ')')} THEN trunc(TRY_CAST(replace($x, ',', '') AS DOUBLE))::BIGINT::VARCHAR ELSE $x END",
]
# a dollar sign before x would be taken for the placeholder
EXPR[1] = EXPR[1].replace("'\\$', '$'", "'\\' || chr(36), chr(36)").replace("'$', ''", "chr(36), ''")


@query("extract_hash_answer", f"""WITH {A} SELECT conv_id, turn, nullif(replace(regexp_extract(response, '#### (-?[0-9.,]+)', 1), ',', ''), '') AS strict,
  coalesce(list_filter(regexp_extract_all(text_only, '-?[0-9.,]+'), lambda x: x <> '.')[-1], regexp_extract_all(text_only, '-?[0-9.,]+')[1]) AS flexible
  FROM (SELECT *, left(response, length(response) - 3) AS text_only FROM answers)""")
def _(t):
    cut = F.substr("response", F.lit(1), F.length("response") - 3)
    return views.answers(t).select("conv_id", "turn", gr.extract_hash_answer(F.col("response")).alias("strict"), gr.extract_hash_answer(cut, "flexible").alias("flexible"))


@query("grade_hash_answer", f"WITH {A} SELECT conv_id, turn, CASE WHEN regexp_extract(response, '#### (-?[0-9.,]+)', 1) = number THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS score FROM answers")
def _(t):
    return views.answers(t).select("conv_id", "turn", gr.grade_hash_answer(F.col("response"), F.col("number"), format_score=0.1).alias("score"))


@query("last_boxed", f"WITH {A} SELECT conv_id, turn, '\\boxed' || {BOX.replace('$x', 'response')} AS boxed, {CONTENT.replace('$x', 'response')} AS content FROM answers")
def _(t):
    return views.answers(t).select("conv_id", "turn", gr.last_boxed(F.col("response")).alias("boxed"), gr.boxed_answer(F.col("response")).alias("content"))


BASE = f"(SELECT *, {CONTENT.replace('$x', 'response')} AS a FROM answers)"


@query("normalize_math", f"WITH {A} SELECT conv_id, turn, n1 AS strict, n2 AS loose, e1 AS expr FROM "
       + chain_sql(chain_sql(chain_sql(BASE, "a", "n1", norm_sql(True)), "a", "n2", UNWRAP + norm_sql(False)), "a", "e1", EXPR))
def _(t):
    a = F.col("a")
    return views.answers(t).withColumn("a", gr.boxed_answer(F.col("response"))).select(
        "conv_id", "turn", gr.normalize_math(a).alias("strict"), gr.normalize_answer_text(a).alias("loose"), gr.normalize_expr(a).alias("expr"))


@query("answers_equal", f"WITH {A} SELECT conv_id, turn, CASE WHEN n1 IS NULL OR n2 IS NULL THEN a = truth ELSE n1 = n2 END AS same FROM "
       + chain_sql(chain_sql(BASE, "a", "n1", norm_sql(True)), "truth", "n2", norm_sql(True)))
def _(t):
    return views.answers(t).select("conv_id", "turn", gr.answers_equal(gr.boxed_answer(F.col("response")), F.col("truth")).alias("same"))


def num_sql(x: str) -> str:
    x = f"trim({x})"
    amount = f"CASE WHEN regexp_matches({x}, '^\\$[0-9]') THEN substr({x}, 2) WHEN regexp_matches({x}, '^[0-9]+(\\.[0-9]+)?\\\\?%$') THEN regexp_replace({x}, '\\\\?%$', '') ELSE {x} END"
    digits = f"replace(replace({amount}, '{{,}}', ''), ',', '')"
    pi = r"'^([-+]?[0-9]*\.?[0-9]*)\\pi$'"
    based = r"'^([-+]?[0-9]+)(\.[0-9]+)?_.+$'"
    plain = r"'^[-+]?([0-9][0-9,]*\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$'"
    factor = f"regexp_extract({x}, {pi}, 1)"
    return (f"CASE WHEN regexp_matches({x}, {pi}) THEN CASE WHEN {factor} IN ('', '+') THEN 1.0 WHEN {factor} = '-' THEN -1.0 ELSE try_cast({factor} AS DOUBLE) END * pi() "
            f"WHEN regexp_matches({x}, {based}) THEN try_cast(regexp_extract({x}, {based}, 1) AS DOUBLE) WHEN regexp_matches({digits}, {plain}) THEN try_cast({digits} AS DOUBLE) END")


def same_sql(a: str, b: str) -> str:
    m, n = f"({num_sql(a)})", f"({num_sql(b)})"
    close = " OR ".join(f"{m} = {n} * {f} OR abs({m} - {n} * {f}) <= 1e-4::DOUBLE * greatest(abs({m}), abs({n} * {f}))" for f in ("1.0::DOUBLE", "0.01::DOUBLE", "100.0::DOUBLE"))
    return f"(lower(trim({a})) = lower(trim({b})) OR replace({a}, ' ', '') = replace({b}, ' ', '') OR coalesce({close}, false))"


LISTED = r"'^[(\[].*[)\]]$'"
INNER = "CASE WHEN regexp_matches({x}, " + LISTED.replace("{", "{{") + ") THEN substr({x}, 2, length({x}) - 2) ELSE {x} END"
EDGE = "CASE WHEN regexp_matches({x}, " + LISTED.replace("{", "{{") + ") THEN substr({x}, 1, 1) || right({x}, 1) ELSE '' END"


@query("values_equal", f"""WITH {A}, v AS (SELECT conv_id, turn, trim(a) AS g, trim(truth) AS t FROM {BASE}),
p AS (SELECT *, string_split({INNER.format(x='g')}, ',') AS gp, string_split({INNER.format(x='t')}, ',') AS tp, {EDGE.format(x='g')} AS ge, {EDGE.format(x='t')} AS te,
  regexp_replace(g, '[{{}}()\\[\\]]', '', 'g') AS gb, regexp_replace(t, '[{{}}()\\[\\]]', '', 'g') AS tb FROM v),
e AS (SELECT conv_id, turn, bool_and({same_sql('x.g', 'x.t')}) AS each FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(gp) + 1), lambda i: {{'g': gp[i], 't': tp[i]}})) AS x FROM p WHERE len(gp) = len(tp) AND len(tp) > 1) GROUP BY ALL)
SELECT conv_id, turn, coalesce(g <> '' AND ({same_sql('g', 't')} OR (({num_sql('g')}) IS NULL OR ({num_sql('t')}) IS NULL) AND
  ((ge = te AND coalesce(each, false)) OR (NOT contains(g, ',') AND NOT contains(t, ',') AND {same_sql('gb', 'tb')}))), false) AS same FROM p LEFT JOIN e USING (conv_id, turn)""")
def _(t):
    return views.answers(t).select("conv_id", "turn", values_equal(gr.boxed_answer(F.col("response")), F.col("truth")).alias("same"))


MATH = "(SELECT *, coalesce(n1, u1) = coalesce(n2, u2) OR e1 = e2 AS ok FROM " + chain_sql(chain_sql(chain_sql(chain_sql(chain_sql(chain_sql(
    BASE, "a", "u1", UNWRAP), "u1", "n1", norm_sql(False)), "truth", "u2", UNWRAP), "u2", "n2", norm_sql(False)), "a", "e1", EXPR), "truth", "e2", EXPR) + ")"


@query("grade_math", f"WITH {A} SELECT conv_id, turn, ok AS right FROM {MATH}")
def _(t):
    return views.answers(t).select("conv_id", "turn", gr.grade_math(F.col("response"), F.array("truth", F.lit("\\boxed{none}"))).alias("right"))


SHAPED = """shaped AS (SELECT conv_id, turn, n, CASE (conv_id + turn) % 6
  WHEN 0 THEN '<think> ' || text || '</think>' || chr(10) || '<answer>\\boxed{' || n || '}</answer>'
  WHEN 1 THEN '<think> ' || text || '<answer>\\boxed{' || n || '}</answer>'
  WHEN 2 THEN '    <think> ' || text || '</think> <answer>\\boxed{' || n || '}</answer>'
  WHEN 3 THEN '<think> ' || text || '</think>x<answer>\\boxed{' || n || '}</answer>   ' || chr(10)
  WHEN 4 THEN '<think> ' || text || '</think><answer>```python' || chr(10) || 'print(' || n || ')' || chr(10) || '```</answer>'
  ELSE text || '\\boxed{' || n || '}' || chr(10) || 'end' || '    ' END AS response FROM (SELECT *, length(text) % 97 AS n FROM conversations))"""


def shaped(t):
    n = F.length("text").cast("bigint") % 97
    c = t.conversations.withColumn("n", n)
    s, w, nl, box = F.col("n").cast("string"), (F.col("conv_id") + F.col("turn")) % 6, F.lit("\n"), F.lit("\\boxed{")
    lit, txt = F.lit, F.col("text")
    end = F.concat(box, s, lit("}</answer>"))
    r = (
        F.when(w == 0, F.concat(lit("<think> "), txt, lit("</think>"), nl, lit("<answer>"), end))
        .when(w == 1, F.concat(lit("<think> "), txt, lit("<answer>"), end))
        .when(w == 2, F.concat(lit("    <think> "), txt, lit("</think> <answer>"), end))
        .when(w == 3, F.concat(lit("<think> "), txt, lit("</think>x<answer>"), end, lit("   \n")))
        .when(w == 4, F.concat(lit("<think> "), txt, lit("</think><answer>```python\nprint("), s, lit(")\n```</answer>")))
        .otherwise(F.concat(txt, box, s, lit("}\nend    "))))
    return c.select("conv_id", "turn", "n", r.alias("response"))


def _n(tag, s="response"):
    return f"(length({s}) - length(replace({s}, '{tag}', ''))) // {len(tag)}"


STRIPPED = "regexp_replace(response, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"
EDGES = "NOT regexp_matches(response, '^ {4}') AND NOT regexp_matches(response, ' {4}$')"
TAGS = (" AND ".join(f"{_n(x)} = 1" for x in ("<think>", "</think>", "<answer>", "</answer>"))
        + f" AND {EDGES} AND starts_with({STRIPPED}, '<think>') AND ends_with({STRIPPED}, '</answer>')"
        + " AND regexp_matches(response, '</think>[ \\t\\n\\r\\f]*<answer>')")
FEW = "NOT regexp_matches(response, '[ \\n]{4}$')"
FORMATS = {
    "math": f"{_n('boxed')} = 1 AND {TAGS}",
    "code": f"{_n('```python')} = 1 AND {_n('```')} = 2 AND {TAGS}",
    "tag": f"{_n('boxed')} = 1 AND {_n('</think>')} = 1 AND {EDGES}",
    "line": f"{_n('XboxedB').replace('XboxedB', chr(92) + 'boxed{')} = 1 AND contains(string_split({STRIPPED}, chr(10))[-1], '\\boxed{{') AND {FEW}".replace("{{", "{"),
    "anywhere": f"{_n('XboxedB').replace('XboxedB', chr(92) + 'boxed{')} = 1 AND {FEW}",
}


@query("verify_format", f"WITH {SHAPED} SELECT conv_id, turn, " + ", ".join(f"({e}) AS is_{k}" for k, e in FORMATS.items()) + " FROM shaped")
def _(t):
    return shaped(t).select("conv_id", "turn", *[gr.verify_format(F.col("response"), k).alias(f"is_{k}") for k in FORMATS])


@query("extract_code_block", f"""WITH {SHAPED} SELECT conv_id, turn, regexp_replace(string_split(string_split(response, '```python')[-1], '```')[1], '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') AS code,
 round(CASE WHEN n % 4 = 0 OR n % 15 < n % 4 THEN 1.0 ELSE len(list_filter(range(0, least(n % 15 + 1, 10)), lambda i: i % 4 <> n % 4)) / least(n % 15 + 1, 10)::DOUBLE END, 6) AS score FROM shaped""")
def _(t):
    # results of the tests of each response: one test in four fails, at a place that moves
    n = F.col("n")
    results = F.transform(F.sequence(F.lit(0).cast("bigint"), n % 15), lambda i: (n % 4 == 0) | (i % 4 != n % 4))
    return shaped(t).select(
        "conv_id", "turn", gr.extract_code_block(F.col("response")).alias("code"), r6(gr.code_score(results)).alias("score"))


def _cut_sql(marker, after):
    m = f"'{marker}'".replace("\n'", "' || chr(10)") if "\n" in marker else f"'{marker}'"
    at = f"length(s) - length(string_split(lower(s), {m})[-1])"
    kept = f"substr(s, {at} + 1)" if after else f"substr(s, 1, {at} - length({m}))"
    return f"SELECT conv_id, turn, m OR contains(lower(s), {m}) AS m, CASE WHEN contains(lower(s), {m}) THEN regexp_replace({kept}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') ELSE s END AS s FROM "


PHRASE = "(SELECT conv_id, turn, false AS m, response AS s FROM answers)"
for _k in gr._BEFORE:
    PHRASE = f"({_cut_sql(_k, True)}{PHRASE})"
for _k in gr._AFTER:
    PHRASE = f"({_cut_sql(_k, False)}{PHRASE})"
PHRASE = "(SELECT conv_id, turn, m OR b <> '' AS m, CASE WHEN b <> '' THEN b ELSE s END AS s FROM (SELECT *, CASE WHEN contains(s, '\\boxed') THEN trim(" + CONTENT.replace("$x", "s") + f") ELSE '' END AS b FROM {PHRASE}))"
PHRASE = f"(SELECT conv_id, turn, m, CASE WHEN contains(s, '. ') THEN trim(substr(s, 1, length(s) - length(string_split(s, '. ')[-1]) - 2)) ELSE s END AS s FROM {PHRASE})"
for _k in gr._LAST:
    PHRASE = f"({_cut_sql(_k, True)}{PHRASE})"


@query("extract_final_phrase", f"WITH {A} SELECT conv_id, turn, s AS phrase, m AND regexp_matches(s, '[0-9]') AS matched FROM {PHRASE}")
def _(t):
    p = gr.extract_final_phrase(F.col("response"))
    return views.answers(t).select("conv_id", "turn", p.alias("p")).select("conv_id", "turn", F.col("p.s").alias("phrase"), F.col("p.m").alias("matched"))


def _sourced(t):
    source = F.element_at(F.array(F.lit("openai/gsm8k"), F.lit("lighteval/MATH"), F.lit("math")), (F.col("turn") % 3 + 1).cast("int"))
    df = views.answers(t).withColumn("source", source)
    return df.withColumn("known", F.when(F.col("source") == "openai/gsm8k", F.col("number")).otherwise(F.col("truth")))


@query("score_by_registry", f"""WITH {A}, h AS (SELECT conv_id, turn, CASE WHEN regexp_extract(response, '#### (-?[0-9.,]+)', 1) = number THEN 1.0 ELSE 0.0 END AS hash FROM answers),
b AS (SELECT conv_id, turn, CASE WHEN n1 IS NULL OR n2 IS NULL THEN a = truth ELSE n1 = n2 END AS same FROM {chain_sql(chain_sql(BASE, "a", "n1", norm_sql(True)), "truth", "n2", norm_sql(True))}),
m AS (SELECT conv_id, turn, ok FROM {MATH})
SELECT conv_id, turn, (CASE turn % 3 WHEN 0 THEN hash WHEN 1 THEN same::INT ELSE ok::INT END)::DOUBLE AS score FROM h JOIN b USING (conv_id, turn) JOIN m USING (conv_id, turn)""")
def _(t):
    return _sourced(t).select("conv_id", "turn", sc.score(F.col("source"), F.col("response"), F.col("known"), sc.registry()).alias("score"))


@query("grade_rollouts", f"""WITH {SHAPED}, {views.TOKENS}, g AS (SELECT *, ({FORMATS['math']}) AS good, turn % 2 = 0 AS plain FROM shaped)
SELECT conv_id, turn, good::INT::DOUBLE AS format_score, (good AND NOT (conv_id % 3 = 0))::INT::DOUBLE AS score, n % 11 + 1 AS n_valid, (good AND NOT (conv_id % 3 = 0))::INT::DOUBLE AS last_token FROM g""")
def _(t):
    df = shaped(t).withColumn("truth", F.when(F.col("conv_id") % 3 == 0, F.col("n") + 1).otherwise(F.col("n")).cast("string"))
    df = df.withColumn("ability", F.lit("math")).withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i <= F.col("n") % 11).cast("int")))
    out = sc.grade_rollouts(df, "response", "truth", "ability", "mask", sc.registry())
    n = F.aggregate("mask", F.lit(0), lambda s, m: s + m)
    return out.select("conv_id", "turn", "format_score", "score", n.cast("bigint").alias("n_valid"), F.element_at("token_scores", n).alias("last_token"))


@query("grade_multi", f"""WITH {A}, s AS (SELECT conv_id, turn, (regexp_extract(response, '#### (-?[0-9.,]+)', 1) = number)::INT AS one FROM answers)
SELECT conv_id, turn, one || ',0,' || one AS scores FROM s""")
def _(t):
    df = _sourced(t).withColumn("samples", F.array("response", F.lit(" \n"), F.concat(F.lit("again "), "response")))
    scores = sc.grade_multi(F.col("samples"), F.col("number"), F.lit("openai/gsm8k"), sc.registry())
    return df.select("conv_id", "turn", joined(F.transform(scores, lambda x: x.cast("int"))).alias("scores"))


def _token_recall(response: str, truth: str) -> float:
    if len(response) % 50 == 0:
        while True:
            pass
    return response.count(truth) / max(len(response), 1)


def _dealt(df):
    """Rows that may each take their whole time limit, over all cores: a scan puts a small table into one task."""
    return spread_waits(df)


@query("scorer_with_timeout", f"""WITH {A} SELECT conv_id, turn, round(CASE WHEN length(response) % 50 = 0 THEN -1.0 ELSE (length(response) - length(replace(response, number, ''))) // length(number) / length(response)::DOUBLE END, 6) AS score FROM answers""")
def _(t):
    # normal rows take microseconds; only the endless ones meet the limit
    own = sc.custom_scorer(_token_recall, seconds=2.0, default=-1.0)
    return _dealt(views.answers(t)).select("conv_id", "turn", r6(own(F.col("response"), F.col("number"))).alias("score"))


def _endless_for_llm(response: str, truth: str) -> float:
    """Ends for no truth that is divisible by 40."""
    while truth.isdigit() and int(truth) % 40 == 0:
        pass
    return float(response.count(truth) > 1)


@query("scorer_limits", f"""WITH {A} SELECT conv_id, turn, round(CASE WHEN number::INT % 40 = 0 THEN -1.0 ELSE ((length(response) - length(replace(response, number, ''))) // length(number) > 1)::INT::DOUBLE END, 6) AS score FROM answers""")
def _(t):
    # the limits by ability, a twentieth of their length
    own = sc.limited_scorer(_endless_for_llm, {k: v / 20 for k, v in sc.TIME_LIMITS.items()}, default=-1.0)
    ability = F.when(F.col("conv_id") % 2 == 0, "math").otherwise("llm")
    return _dealt(views.answers(t)).select("conv_id", "turn", r6(own(F.col("response"), F.col("number"), ability)).alias("score"))


@query("custom_scorer", f"WITH {A} SELECT conv_id, turn, ends_with(response, number)::INT::DOUBLE AS score FROM answers")
def _(t):
    own = sc.custom_scorer(lambda r, truth: float(r.endswith(truth)))
    return views.answers(t).select("conv_id", "turn", sc.score(F.lit("mine"), F.col("response"), F.col("number"), [(["mine"], own)]).alias("score"))


@query("scorer_table_function", f"WITH {A} SELECT conv_id, turn, ends_with(response, number)::INT::DOUBLE AS score, right(response, 3) AS detail FROM answers")
def _(t):
    fn = sc.scored_detail(lambda r, truth: (float(r.endswith(truth)), r[-3:]))
    df = views.answers(t).select("conv_id", "turn", "response", "number")
    return df.lateralJoin(fn(F.col("response").outer(), F.col("number").outer())).select("conv_id", "turn", "score", "detail")


PUNCT = tx.PUNCTUATION.replace("'", "''")
ARTICLES = "trim(regexp_replace(regexp_replace(regexp_replace(' ' || {x} || ' ', '([^\\p{{L}}\\p{{N}}_])(a|an|the)([^\\p{{L}}\\p{{N}}_])', '\\1 \\3', 'g'), '([^\\p{{L}}\\p{{N}}_])(a|an|the)([^\\p{{L}}\\p{{N}}_])', '\\1 \\3', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
F1_FORM = ARTICLES.format(x=f"translate(lower(text), '{PUNCT}', '{' ' * len(tx.PUNCTUATION)}')")
EM_FORM = ARTICLES.format(x=f"translate(lower(text), '{PUNCT}', '')")


@query("normalize_answer", f"SELECT item_id, {F1_FORM} AS spaced, {EM_FORM} AS deleted FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", tx.normalize_answer(F.col("text")).alias("spaced"), tx.normalize_exact(F.col("text")).alias("deleted"))


# signed counts of the words' digests over 64 places, to unit length
EMBEDDED = """w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS w FROM documents),
d AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS d FROM w),
c AS (SELECT doc_id, d % 64 AS place, sum(CASE WHEN d >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS x FROM d GROUP BY ALL),
e AS (SELECT doc_id, round(sum(x * (place + 1)) / sqrt(sum(x * x)), 6) + 0.0 AS mark, round(max(x) / sqrt(sum(x * x)), 6) + 0.0 AS top FROM c GROUP BY 1 HAVING sum(x * x) > 0)"""


def _marks(out):
    at = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return [F.size("embedding").alias("dim"), r6(at).alias("mark"), r6(F.array_max("embedding")).alias("top")]


@query("embed_table", f"WITH {EMBEDDED} SELECT doc_id, 64 AS dim, coalesce(mark, 0.0::DOUBLE) AS mark, greatest(coalesce(top, 0.0::DOUBLE), CASE WHEN (SELECT count(*) FROM c WHERE c.doc_id = documents.doc_id) < 64 THEN 0.0::DOUBLE ELSE -1 END) AS top FROM documents LEFT JOIN e USING (doc_id)")
def _(t):
    out = sc.embed_table(t.documents, "doc_id", "text", sc.hashed_words())
    return out.select("doc_id", *_marks(out))


@query("embed_blocks", f"WITH {EMBEDDED} SELECT doc_id, doc_id // 4096 * 4096 AS block_start, coalesce(mark, 0.0::DOUBLE) AS mark FROM documents LEFT JOIN e USING (doc_id)")
def _(t):
    # stopped after the first half, then resumed on the whole table
    path, n = fresh_path(t.spark, "embeddings"), t.documents.agg(F.max("doc_id") + 1).first()[0]
    sc.embed_blocks(t.documents.filter(F.col("doc_id") < n // 2), "doc_id", "text", sc.hashed_words(), path, 4096, n // 2)
    sc.embed_blocks(t.documents, "doc_id", "text", sc.hashed_words(), path, 4096, n)
    out = t.spark.read.parquet(path)
    return out.select("doc_id", F.col("block_start").cast("bigint").alias("block_start"), _marks(out)[1])
