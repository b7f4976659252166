"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Words are counted by Spark functions. Two words one edit apart differ in their
letter counts by a squared distance of 1 (a letter more) or 2 (a letter for
another), so pairs further apart need no look at their letters. Words of one
length and of one count in each of a few letter classes lie in one cell; an
edit leads to the cell itself or to one whose counts differ by a letter moved
or added. A cell is cut into blocks of bounded size. Every block meets the
blocks of its neighbour cells of the same and the next length: the product of
their letter-count matrices (a Gram matrix) gives all squared distances of the
two blocks at once, and what stays within 2 is verified letter by letter.

The number of letter classes follows the number of words, so cells hold about
as many words at any size, and no vocabulary is paired with itself as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import spread_pairs, stage

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 512  # words of a block
PER_CELL = 128  # words a cell should hold
SIGNS = [*range(97, 123), *range(0xC0, 0x100)]  # letters of counted words


def counted_words(df: DataFrame, every: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of the runs of letters of all texts, A-Z lowered, with at least ``shortest`` letters and ``least`` occurrences.

    Where ``every`` divides the crc32 h of ``<doc_id>:<run>``, the run loses its
    letter h % length. Null texts have no runs; a null doc_id is written as
    nothing. Only functions of the JVM; runs are counted before the shuffle.
    """
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    # a run of fewer letters can't become a word, for runs only get shorter
    runs = df.select(F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(lowered, F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))).alias("run"))
    h, size = F.crc32(F.concat("doc", F.lit(":"), "run")), F.length("run")
    cut = (h % size).cast("int")
    word = F.when(h % every == 0, F.concat(F.substr("run", F.lit(1), cut), F.substr("run", cut + 2))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.length("word") >= shortest))


def letter_classes(words: DataFrame, many: int) -> list[str]:
    """Letters dealt over ``many`` classes, the most frequent first and each to the lightest class: a row per letter."""
    seen = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").groupBy("letter").agg(F.count("*").alias("k")).collect()
    classes, weight = [""] * many, [0] * many
    for letter, k in sorted(seen, key=lambda r: (-r[1], r[0])):
        lightest = weight.index(min(weight))
        classes[lightest] += letter
        weight[lightest] += k
    return classes


def cells(words: DataFrame, classes: list[str]) -> DataFrame:
    """word and cell: the number of letters of each class (their sum is the length)."""
    counts = [F.when(F.lit(not c), 0).otherwise(F.length("word") - F.length(F.translate("word", c, ""))).cast("int") for c in classes]
    return words.select("word", F.array(*counts).alias("cell"))


def neighbours(cell: Column, many: int) -> Column:
    """The cell itself, those with a letter moved from one class to a later one or back (each pair of cells from one side), and with one added."""
    steps = [[0] * many]
    for i in range(many):
        steps.append([int(k == i) for k in range(many)])
        for j in range(i + 1, many):
            steps.append([int(k == i) - int(k == j) for k in range(many)])
    return F.array(*[F.zip_with(cell, F.array(*[F.lit(x) for x in step]), lambda a, b: a + b) for step in steps])


def letter_counts(words: list[str]) -> np.ndarray:
    """Rows of letter counts of lower-case words over SIGNS."""
    place = np.full(256, -1, np.int64)
    place[SIGNS] = np.arange(len(SIGNS))
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    out = np.zeros((len(words), len(SIGNS)), np.float32)
    np.add.at(out, (rows, place[flat]), 1)
    return out


def one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    if len(a) == len(b):
        return a[k + 1:] == b[k + 1:]
    return a[k:] == b[k + 1:] if len(a) < len(b) else a[k + 1:] == b[k:]


def near_in_blocks(left: list[str], right: list[str], same: bool) -> list[tuple[str, str]]:
    """Pairs one edit apart between two blocks (or inside one, each pair once)."""
    x, y = letter_counts(left), letter_counts(right)
    gram = x @ y.T
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * gram
    i, j = np.nonzero(squared <= 2.5)
    if same:
        i, j = i[i < j], j[i < j]
    return [(left[a], right[b]) for a, b in zip(i.tolist(), j.tolist()) if one_edit(left[a], right[b])]


def near_words(words: DataFrame) -> DataFrame:
    """(left, right): every two of the distinct ``words`` that are one edit apart, once."""
    total = words.count()
    many = 1
    # cells of a length grow about fourfold with every class
    while many < 8 and total > PER_CELL * 8 * 3 ** many:
        many += 1
    placed = stage(cells(words, letter_classes(words, many)), "cells")
    sized = placed.groupBy("cell").agg(F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}").alias("parts"))
    blocks = placed.join(sized, "cell").groupBy("cell", F.pmod(F.xxhash64("word"), F.col("parts")).alias("block")).agg(F.collect_list("word").alias("words"))
    blocks = stage(blocks, "blocks")  # a block holds about BLOCK words
    asked = blocks.select(F.col("cell").alias("own"), F.col("block").alias("own_block"), F.col("words").alias("left"), F.explode(neighbours(F.col("cell"), many)).alias("cell"))
    met = asked.join(blocks.withColumnRenamed("words", "right"), "cell")
    inside = F.col("own") == F.col("cell")
    met = met.filter(~inside | (F.col("own_block") <= F.col("block"))).select("left", "right", (inside & (F.col("own_block") == F.col("block"))).alias("same"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for left, right, same in zip(batch.column(0), batch.column(1), batch.column(2)):
                found += near_in_blocks(left.as_py(), right.as_py(), same.as_py())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], ["left", "right"])

    return spread_pairs(met).mapInArrow(multiply, "left string, right string")


def variants(df: DataFrame, every: int = 199, shortest: int = 6, least: int = 5, ratio: int = 5) -> DataFrame:
    """word, n, n_near (words one edit apart), form, form_n and root of every word.

    form is the near word of most occurrences (ties: the first in code-point
    order) if it has at least ``ratio`` times as many; else form and form_n are
    null. root is the last word reached over forms. Repeated rows count again;
    an empty table has no words; further columns are ignored.
    """
    words = stage(counted_words(df, every, shortest, least), "words")
    pairs = stage(near_words(words.select("word")), "pairs")
    both = pairs.select(F.col("left").alias("word"), F.col("right").alias("other")).unionByName(pairs.select(F.col("right").alias("word"), F.col("left").alias("other")))
    known = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), "other")).alias("best"))
    taken = F.coalesce(-F.col("best.k") >= ratio * F.col("n"), F.lit(False))
    formed = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.k")).alias("form_n")), "forms")
    # a form has ``ratio`` times as many occurrences, so paths are short; each round doubles what a step covers
    steps = stage(formed.filter("form is not null").select("word", F.col("form").alias("root")), "steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = stage(moved, "steps")
        steps = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    return formed.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
