"""Answer extraction, normalisation, grading and response formats as Columns.

Normalisers work on short answers, so a step that reads its input more than
once binds it first (``let``); the expression stays linear in the rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .arrays import let

_WS = r"[ \t\n\r\f\x0B]"


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{_WS}+|{_WS}+\z", "")


def _swap(s: Column, old: str, new: str = "") -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def _count(s: Column, tag: str) -> Column:
    return F.floor((F.length(s) - F.length(_swap(s, tag))) / len(tag))


def _chain(s: Column, steps: list[Callable[[Column], Column]]) -> Column:
    for step in steps:
        s = let(s, step)
    return s


def extract_hash_answer(text: Column, mode: str = "strict") -> Column:
    """Number after ``#### ``, or the last number-like token that is more than a dot."""
    if mode == "strict":
        found = F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1)
        return F.when(found != "", _swap(_swap(found, ","), "$"))
    return let(F.regexp_extract_all(text, F.lit(r"(-?[0-9.,]+)"), F.lit(1)),
               lambda a: F.coalesce(F.try_element_at(F.filter(a, lambda x: x != "."), F.lit(-1)), F.try_element_at(a, F.lit(1))))


def grade_hash_answer(text: Column, truth: Column, mode: str = "strict", score: float = 1.0, format_score: float = 0.0) -> Column:
    return let(extract_hash_answer(text, mode), lambda a: F.when(a.isNull(), 0.0).when(a == truth, score).otherwise(format_score))


def _braces(tail: Column) -> Column:
    """(opened, closed): 0-based places of the first brace and of the one that closes the count."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(-1).alias("opened"), F.lit(-1).alias("closed"))

    def step(s, c):
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(
            (s["i"] + 1).alias("i"), depth.alias("depth"),
            F.when((s["opened"] < 0) & (c == "{"), s["i"]).otherwise(s["opened"]).alias("opened"),
            F.when((s["closed"] < 0) & (c == "}") & (s["depth"] == 1), s["i"]).otherwise(s["closed"]).alias("closed"))
    return F.aggregate(F.split(tail, ""), start, step)


def _box_tail(text: Column) -> Column:
    return F.when(text.contains("\\boxed"), F.concat(F.lit("\\boxed"), F.substring_index(text, "\\boxed", -1))).when(
        text.contains("\\fbox"), F.concat(F.lit("\\fbox"), F.substring_index(text, "\\fbox", -1)))


def last_boxed(text: Column, spaced: bool = True) -> Column:
    """Last ``\\boxed{...}`` (or ``\\fbox``) with its braces matched; null when it never closes.

    With ``spaced`` a ``\\boxed x`` up to a dollar sign counts first.
    """
    whole = let(F.struct(_box_tail(text).alias("t"), _braces(_box_tail(text)).alias("b")),
                lambda x: F.when(x["b"]["closed"] >= 0, F.substr(x["t"], F.lit(1), x["b"]["closed"] + 1)))
    if not spaced:
        return whole
    return F.when(text.contains("\\boxed "), F.concat(F.lit("\\boxed "), F.substring_index(F.substring_index(text, "\\boxed ", -1), "$", 1))).otherwise(whole)


def remove_boxed(boxed: Column) -> Column:
    """Content of a box; null for any other wrapper."""
    return let(boxed, lambda b: F.when(b.contains("\\boxed "), F.when(b.startswith("\\boxed "), F.substr(b, F.lit(8))))
               .when(b.startswith("\\boxed{") & b.endswith("}"), F.substr(b, F.lit(8), F.length(b) - 8)))


def boxed_answer(text: Column, spaced: bool = True) -> Column:
    return remove_boxed(last_boxed(text, spaced))


# Plain replacements in the order they apply.
_MATH_SWAPS = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
               ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]


def _swaps(s: Column) -> Column:
    for old, new in _MATH_SWAPS:
        s = _swap(s, old, new)
    return s


def _right_units(s: Column) -> Column:
    return let(F.split(s, r"\\text\{ "), lambda p: F.when(F.size(p) == 1, F.get(p, F.lit(0))).when(F.size(p) == 2, F.get(p, F.lit(0))))


def _dots(s: Column) -> Column:
    s = _swap(_swap(_swap(s, "\\%"), " .", " 0."), "{.", "{0.")
    return F.regexp_replace(s, r"^\.", "0.")


def _left_side(s: Column) -> Column:
    return let(F.split(s, "="), lambda p: F.when((F.size(p) == 2) & (F.length(F.get(p, F.lit(0))) <= 2), F.get(p, F.lit(1))).otherwise(s))


def _pieces(s: Column, mark: str, fix: Callable[[Column], Column], short: int = 1) -> Column:
    """Rewrite the parts after each ``mark`` that do not open a brace; an empty part is an error (null)."""
    def done(p):
        rest = F.slice(p, F.lit(2), F.size(p))
        ok = F.array_join(F.concat(F.slice(p, 1, 1), F.transform(rest, lambda x: F.when(x.startswith("{"), x).otherwise(fix(x)))), mark)
        few = F.exists(rest, lambda x: ~x.startswith("{") & (F.length(x) < short))
        return F.when(F.exists(rest, lambda x: x == ""), F.lit(None)).when(few, s).otherwise(ok)
    return let(F.split(s, mark.replace("\\", "\\\\"), -1), done)


def _sqrt(s: Column) -> Column:
    return _pieces(s, "\\sqrt", lambda x: F.concat(F.lit("{"), F.substring(x, 1, 1), F.lit("}"), F.substr(x, F.lit(2))))


def _frac(s: Column) -> Column:
    def fix(x):
        head, second = F.concat(F.lit("{"), F.substring(x, 1, 1), F.lit("}")), F.substring(x, 2, 1)
        return F.when(second != "{", F.concat(head, F.lit("{"), second, F.lit("}"), F.substr(x, F.lit(3)))).otherwise(F.concat(head, F.substr(x, F.lit(2))))
    return _pieces(s, "\\frac", fix, short=2)


def _slash(strict: bool):
    """``a/b`` of plain integers becomes a fraction; ``strict`` makes other two-part slashes an error."""
    whole, number = r"^(-?[1-9][0-9]*|0)/(-?[1-9][0-9]*|0)$", r"^[+-]?[0-9](_?[0-9])*/[+-]?[0-9](_?[0-9])*$"

    def step(s):
        fixed = F.when(s.rlike(whole), F.regexp_replace(s, whole, r"\\frac{$1}{$2}"))
        if strict:
            fixed = fixed.when((F.size(F.split(s, "/")) == 2) & ~s.rlike(number), F.lit(None))
        return fixed.otherwise(s)
    return step


def normalize_math(s: Column, strict: bool = True) -> Column:
    """LaTeX clean-up of an answer; null where a rule cannot apply."""
    half = lambda x: F.when(x == "0.5", F.lit("\\frac{1}{2}")).otherwise(x)
    return _chain(_swaps(s), [_right_units, _dots, _left_side, _sqrt, lambda x: _swap(x, " "), _frac, half, _slash(strict)])


def answers_equal(a: Column, b: Column) -> Column:
    """Equal after :func:`normalize_math`; compared as they are when a rule fails; both missing are equal."""
    norm = F.struct(normalize_math(a).alias("a"), normalize_math(b).alias("b"))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(
        let(norm, lambda n: F.when(n["a"].isNull() | n["b"].isNull(), a == b).otherwise(n["a"] == n["b"])))


_TEXT = r"^\\text\{(.+?)\}$"


def normalize_answer_text(s: Column) -> Column:
    """Unwrapped and cleaned answer; the answer itself where a rule fails."""
    inner = let(_strip(s), lambda x: F.when(x.rlike(_TEXT), _strip(F.regexp_extract(x, _TEXT, 1))).otherwise(x))
    return let(inner, lambda x: F.coalesce(normalize_math(x, strict=False), x))


# Units that are dropped, in the order they are tried.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard"]
_FLOAT = rf"^{_WS}*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?{_WS}*$"


def _as_double(s: Column) -> Column:
    return F.when(s.rlike(_FLOAT), F.trim(s).try_cast("double"))


def _is_whole(d: Column) -> Column:
    return F.coalesce(F.abs(d - F.bround(d)) <= 1e-7, F.lit(False))


def strip_formatted_commas(s: Column) -> Column:
    return F.regexp_replace(s, r"(?<=[0-9]),(?=[0-9]{3}([^0-9]|$))", "")


def is_whole_number(s: Column) -> Column:
    return _is_whole(_as_double(strip_formatted_commas(s)))


def _unit_free(s: Column) -> Column:
    for u in UNITS:
        s = F.regexp_replace(s, rf"{u}(es)?(s)? *(\^[0-9]+)?", "")
    return F.regexp_replace(s, r"\^ *\\circ", "")


def _words(s: Column) -> Column:
    for old, new in [("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "),
                     ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]:
        s = _swap(s, old, new)
    return s


def normalize_expr(s: Column) -> Column:
    """Plain form of an expression: no wrapper, units, percent, braces, blanks or case."""
    return _chain(s, [
        lambda x: F.when(x.rlike(_TEXT), F.regexp_extract(x, _TEXT, 1)).otherwise(x),
        lambda x: _unit_free(_words(x)),
        lambda x: F.when(x.startswith("{") & x.endswith("}"), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x),
        lambda x: F.regexp_replace(x, r",\\! *", ""),
        lambda x: let(_as_double(x), lambda d: F.when(_is_whole(d), F.bround(d).cast("decimal(38,0)").cast("string")).otherwise(x)),
        lambda x: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "- *", "-"), "([0-9]) +(?=[0-9])", "$1+"), "[ {}]", "")),
        lambda x: let(_as_double(_swap(x, ",")), lambda d: F.when(
            is_whole_number(x), F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("string")).otherwise(x)),
    ])


def split_tuple(s: Column) -> Column:
    """Elements inside one pair of brackets, else the whole expression."""
    return let(strip_formatted_commas(s), lambda x: F.when(x == "", F.array().cast("array<string>"))
               .when(x.rlike(r"^[()\[\]][^()\[\]]+[()\[\]]$"), F.transform(F.split(F.substr(x, F.lit(2), F.length(x) - 2), ","), _strip))
               .otherwise(F.array(x)))


_FRACTION = r"^-?[0-9]+.?/0*[1-9][0-9]*.?$"


def exprs_equal(given: Column, truth: Column) -> Column:
    """Equal plain forms, or equal element by element in the same brackets.

    Integers and fractions must match as written; symbolic equality is not part of this.
    """
    def elements(n):
        g, t = split_tuple(n["g"]), split_tuple(n["t"])
        edges = (F.substring(n["g"], 1, 1) == F.substring(n["t"], 1, 1)) & (F.substring(n["g"], -1, 1) == F.substring(n["t"], -1, 1))
        return let(F.struct(g.alias("g"), t.alias("t")), lambda e: (F.size(e["g"]) == F.size(e["t"])) & ((F.size(e["t"]) <= 1) | edges)
                   & F.forall(F.arrays_zip(e["g"].alias("g"), e["t"].alias("t")), lambda z: z["g"] == z["t"]))
    norm = F.struct(normalize_expr(given).alias("g"), normalize_expr(truth).alias("t"))
    return F.coalesce(let(norm, lambda n: (n["g"] == n["t"]) | ((n["g"] != "") & elements(n))), F.lit(False))


def grade_math(response: Column, truths: Column) -> Column:
    """Whether the boxed answer equals one of the truths (plain or boxed)."""
    def right(answer):
        known = F.filter(F.transform(truths, lambda t: F.when(t.contains("\\boxed"), boxed_answer(t, spaced=False)).otherwise(t)), lambda t: t.isNotNull())
        return F.exists(known, lambda t: (normalize_answer_text(answer) == normalize_answer_text(t)) | exprs_equal(answer, t))
    return F.when(response.contains("\\boxed"), F.coalesce(let(boxed_answer(response, spaced=False), right), F.lit(False))).otherwise(False)


def score_boxed(response: Column, truth: Column) -> Column:
    """1 when the last boxed answer equals the truth after clean-up."""
    return let(boxed_answer(response), lambda a: F.when(a.isNotNull() & answers_equal(a, truth), 1.0).otherwise(0.0))


def _edges_ok(s: Column) -> Column:
    return ~s.rlike(r"^ {4}") & ~s.rlike(r" {4}\z")


def _once(s: Column, *tags: str) -> Column:
    out = F.lit(True)
    for tag in tags:
        out = out & (_count(s, tag) == 1)
    return out


def _tagged(s: Column) -> Column:
    tags = ["<think>", "</think>", "<answer>", "</answer>"]
    at = [F.instr(s, x) for x in tags]
    between = F.substr(s, at[1] + len("</think>"), F.greatest(at[2] - at[1] - len("</think>"), F.lit(0)))
    stripped = _strip(s)
    return (_edges_ok(s) & stripped.startswith(tags[0]) & stripped.endswith(tags[3]) & _once(s, *tags)
            & (_strip(between) == "") & (at[1] >= at[0]) & (at[2] >= at[1]) & (at[3] >= at[2]))


def verify_format(s: Column, kind: str = "math") -> Column:
    """Response shape: ``math``, ``code``, ``tag`` only, box on the last ``line``, box ``anywhere``."""
    few_blanks = ~s.rlike(r"[ \n]{4}\z")
    if kind == "math":
        return _once(s, "boxed") & _tagged(s)
    if kind == "code":
        behind = F.when(s.contains("```python"), F.substr(s, F.instr(s, "```python") + 9)).otherwise(F.substr(s, F.lit(9)))
        return _once(s, "```python") & _once(behind, "```") & _tagged(s)
    if kind == "tag":
        return _once(s, "boxed", "</think>") & _edges_ok(s)
    if kind == "line":
        return _once(s, "\\boxed{") & _once(F.element_at(F.split(_strip(s), "\n"), -1), "\\boxed{") & few_blanks
    if kind == "anywhere":
        return _once(s, "\\boxed{") & few_blanks
    raise ValueError(f"unknown format {kind}")


def extract_code_block(text: Column) -> Column:
    """Body of the last python fence."""
    return _strip(F.substring_index(F.substring_index(text, "```python", -1), "```", 1))


def code_score(results: Column, strict: bool = False) -> Column:
    """1 when every test passed, else (unless strict) the share among the first ten."""
    every = F.forall(results, lambda r: r)
    first = F.slice(results, 1, 10)
    share = F.size(F.filter(first, lambda r: r)) / F.greatest(F.size(first), F.lit(1))
    return F.when(every, 1.0).otherwise(F.lit(0.0) if strict else share)


# Markers of a final answer, in the order they are tried.
_BEFORE = ["answer:", "answer is", "answers are"]
_AFTER = ["is answer", "is the answer", "are answers", "are the answers"]
_LAST = ["be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"]


def _mark(s: Column, matched: Column) -> Column:
    return F.struct(s.alias("s"), matched.alias("m"))


def _cut(marker: str, keep_after: bool):
    def step(x):
        low = F.lower(x["s"])
        left = F.length(low) - F.length(F.substring_index(low, marker, -1))
        kept = F.substr(x["s"], left + 1) if keep_after else F.substr(x["s"], F.lit(1), left - len(marker))
        return F.when(low.contains(marker), _mark(_strip(kept), F.lit(True))).otherwise(x)
    return step


def _unbox(x: Column) -> Column:
    found = let(F.struct(_box_tail(x["s"]).alias("t"), _braces(_box_tail(x["s"])).alias("b")),
                lambda y: F.when((y["b"]["opened"] >= 0) & (y["b"]["closed"] >= 0),
                                 _strip(F.substr(y["t"], y["b"]["opened"] + 2, y["b"]["closed"] - y["b"]["opened"] - 1))))
    return let(found, lambda f: F.when(F.coalesce(f, F.lit("")) != "", _mark(f, F.lit(True))).otherwise(x))


def _sentence(x: Column) -> Column:
    left = F.length(x["s"]) - F.length(F.substring_index(x["s"], ". ", -1)) - 2
    return F.when(x["s"].contains(". "), _mark(_strip(F.substr(x["s"], F.lit(1), left)), x["m"])).otherwise(x)


def extract_final_phrase(text: Column) -> Column:
    """struct(s, m): the text behind the last answer marker, and whether it is a match with a digit."""
    steps = [_cut(k, True) for k in _BEFORE] + [_cut(k, False) for k in _AFTER] + [_unbox, _sentence] + [_cut(k, True) for k in _LAST]
    return let(_chain(_mark(text, F.lit(False)), steps), lambda x: _mark(x["s"], x["m"] & x["s"].rlike(r"\p{Nd}")))
