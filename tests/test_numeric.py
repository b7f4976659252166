"""Answers by value: documented cases and a plain form on random ones."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions.numeric import number, values_equal

CASES = [
    ("0.5", "50%", True), ("50", "0.5", True), ("1,000", "1000", True), ("1{,}000", "1000", True), ("$12", "12", True), ("12\\%", "0.12", True), ("3.14159", "\\pi", True),
    ("2\\pi", "6.2832", True), ("-\\pi", "3.14159", False), ("101_2", "101", True), ("1.00005", "1", True), ("1.001", "1", False), ("0", "0.0", True), ("1e3", "1000", True),
    ("(1, 2)", "(1,2.0)", True), ("(1,2)", "[1,2]", False), ("[0.5, x]", "[50%,X]", True), ("1,2", "1,3", False), ("x, 2", "x,2.00001", True), ("{7}", "7", True), ("[7]", "(7)", True),
    ("Yes ", "yes", True), ("a b", "ab", True), ("", "", False), (None, "1", False), ("1", None, False), ("nan", "nan", True), ("inf", "1", False), ("1,2", "12", True), ("-5", "5", False),
]


def test_cases(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CASES)], "i int, a string, b string")
    got = {r.i: r.same for r in rows.select("i", values_equal(F.col("a"), F.col("b")).alias("same")).collect()}
    assert {i: got[i] for i in got} == {i: want for i, (_, _, want) in enumerate(CASES)}
    strict = rows.filter("i < 2").select(values_equal(F.col("a"), F.col("b"), percent=False).alias("same")).collect()
    assert [r.same for r in strict] == [False, False]


def plain_number(x):
    x = x.strip()
    if m := re.fullmatch(r"([-+]?\d*\.?\d*)\\pi", x):
        return {"": 1.0, "+": 1.0, "-": -1.0}.get(m[1], None if m[1] in ".+.-." else float(m[1] or 1)) * math.pi
    if m := re.fullmatch(r"([-+]?\d+)(\.\d+)?_.+", x):
        return float(m[1])
    if re.match(r"\$\d", x):
        x = x[1:]
    elif re.fullmatch(r"\d+(\.\d+)?\\?%", x):
        x = x.rstrip("%").rstrip("\\")
    x = x.replace("{,}", "").replace(",", "")
    return float(x) if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", x) else None


def test_numbers_against_a_plain_reader(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["1", "2", "0", ".", ",", "-", "%", "$", "e", "_", "\\pi", "x"]) for _ in range(rnd.randrange(1, 6))) for _ in range(600)]
    texts = [t for t in texts if not re.fullmatch(r"[-+]?\.\\pi", t)]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(number(F.col("t")).alias("n")).collect()]
    for text, value in zip(texts, got):
        want = plain_number(text)
        assert value == (pytest.approx(want) if want is not None else None), text
