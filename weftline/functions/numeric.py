"""Answers compared by value: numbers within a relative tolerance, percent forms, and lists element by element."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .arrays import let

NUMBER = r"^[-+]?([0-9][0-9,]*\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
BASED = r"^([-+]?[0-9]+)(\.[0-9]+)?_.+$"
PI = r"^([-+]?[0-9]*\.?[0-9]*)\\pi$"


def number(text: Column) -> Column:
    """The value of a plain number, null for anything else.

    Digit groups, a dollar sign before an amount, a percent sign behind an
    unsigned number, the base written behind ``_`` and a factor of pi are
    understood.
    """
    def read(x: Column) -> Column:
        amount = F.when(x.rlike(r"^\$[0-9]"), F.substr(x, F.lit(2))).when(x.rlike(r"^[0-9]+(\.[0-9]+)?\\?%$"), F.regexp_replace(x, r"\\?%$", "")).otherwise(x)
        digits = F.replace(F.replace(amount, F.lit("{,}"), F.lit("")), F.lit(","), F.lit(""))
        factor = F.regexp_extract(x, PI, 1)
        times = F.when(factor.isin("", "+"), 1.0).when(factor == "-", -1.0).otherwise(factor.try_cast("double"))
        return F.when(x.rlike(PI), times * math.pi).when(x.rlike(BASED), F.regexp_extract(x, BASED, 1).try_cast("double")).when(digits.rlike(NUMBER), digits.try_cast("double"))

    return let(F.trim(text), read)


def near(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Equal, or apart by no more than the tolerance times the larger magnitude."""
    return (a == b) | (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)))


def _same_text(a: Column, b: Column) -> Column:
    return (F.lower(F.trim(a)) == F.lower(F.trim(b))) | (F.replace(a, F.lit(" "), F.lit("")) == F.replace(b, F.lit(" "), F.lit("")))


def _same_value(a: Column, b: Column, percent: bool, tolerance: float) -> Column:
    def compare(n: Column) -> Column:
        forms = [1.0, 0.01, 100.0] if percent else [1.0]
        close = near(n["a"], n["b"] * forms[0], tolerance)
        for form in forms[1:]:
            close = close | near(n["a"], n["b"] * form, tolerance)
        return F.coalesce(close, F.lit(False))

    return _same_text(a, b) | let(F.struct(number(a).alias("a"), number(b).alias("b")), compare)


def values_equal(given: Column, truth: Column, percent: bool = True, tolerance: float = 1e-4) -> Column:
    """Whether two answers are the same text, the same value, or lists of such.

    ``percent`` also takes a hundredth and the hundredfold of the truth. Lists
    are compared element by element where both have the same brackets or none;
    braces and brackets around one value do not count. A missing answer equals
    nothing.
    """
    def lists(n: Column) -> Column:
        def inner(x):
            bracketed = x.rlike(r"^[(\[].*[)\]]$")
            return F.when(bracketed, F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x)

        edges = [F.when(x.rlike(r"^[(\[].*[)\]]$"), F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))).otherwise("") for x in (n["g"], n["t"])]
        parts = F.struct(F.split(inner(n["g"]), ",").alias("g"), F.split(inner(n["t"]), ",").alias("t"))
        each = let(parts, lambda p: (F.size(p["g"]) == F.size(p["t"])) & (F.size(p["t"]) > 1)
                   & F.forall(F.arrays_zip(p["g"].alias("g"), p["t"].alias("t")), lambda z: _same_value(z["g"], z["t"], percent, tolerance)))
        bare = [F.regexp_replace(x, r"[{}()\[\]]", "") for x in (n["g"], n["t"])]
        single = ~n["g"].contains(",") & ~n["t"].contains(",") & _same_value(bare[0], bare[1], percent, tolerance)
        return ((edges[0] == edges[1]) & each) | single

    whole = F.struct(F.trim(given).alias("g"), F.trim(truth).alias("t"))
    return F.coalesce(let(whole, lambda n: (n["g"] != "") & (_same_value(n["g"], n["t"], percent, tolerance) | (number(n["g"]).isNull() | number(n["t"]).isNull()) & lists(n))), F.lit(False))
