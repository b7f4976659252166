"""Quality rules: counts of each text, then language-specific perplexity bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from . import perplexity
from .common import U64, documents, mix, slices, small, without
from .words import Words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _dup_lines(texts: pa.Array) -> np.ndarray:
    lines = pc.split_pattern(texts, "\n")
    rows = np.repeat(np.arange(len(texts)), np.diff(lines.offsets.to_numpy()))
    coded = lines.flatten().dictionary_encode()
    worded = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False).astype(bool)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = worded[codes] if len(worded) else np.zeros(0, bool)
    pairs = rows[keep] * (len(worded) + 1) + codes[keep]
    every = np.bincount(rows[keep], minlength=len(texts))
    return every - np.bincount(np.unique(pairs) // (len(worded) + 1), minlength=len(texts))


def _repeat_words(words: Words) -> np.ndarray:
    """Words inside windows of five that their row holds more than once; windows are told apart by 64-bit hashes."""
    n = len(words.codes) - WINDOW + 1
    if n <= 0:
        return np.zeros(words.n, np.int64)
    whole = np.flatnonzero(words.rows[:n] == words.rows[WINDOW - 1:])
    spread, total = mix(words.codes, 3), mix(words.rows[whole], 4)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            total = total * U64(0x9E3779B97F4A7C15) + spread[whole + j]
    _, at, many = np.unique(mix(total, 6), return_inverse=True, return_counts=True)
    starts = whole[many[at] > 1]
    edges = np.bincount(starts, minlength=len(words.codes) + 1) - np.bincount(starts + WINDOW, minlength=len(words.codes) + 1)
    covered = np.cumsum(edges)[:-1] > 0
    return np.bincount(words.rows[covered], minlength=words.n)


def measures(df: DataFrame, model: str, *keep: str) -> DataFrame:
    """doc_id, ``keep``, the counts, and nll (mean negative log probability of a character) of every row.

    A null text has no words; a text without words has no nll.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = perplexity.Model.of(model)
        for batch in slices(batches, "text", perplexity.SLICE, "perplexity"):
            texts = pa.array(batch.column(1).fill_null(""), pa.large_string())
            words = Words(texts)
            chars = pc.utf8_length(words.unique).to_numpy(zero_copy_only=False)
            logp, length = scorer.score(words.unique.to_pylist()) if len(words.unique) else (np.zeros(0), np.zeros(0))
            total = words.total(length) if len(length) else np.zeros(words.n)
            nll = -(words.total(logp) if len(logp) else np.zeros(words.n)) / np.maximum(total, 1)
            symbols = pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False)
            counts = [words.counts, words.total(chars) if len(chars) else np.zeros(words.n), symbols, _dup_lines(texts), _repeat_words(words)]
            columns = [pa.array(np.asarray(c).astype(np.int64)) for c in counts]
            kept = [batch.column(i) for i in range(batch.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*kept, *columns, pa.array(nll, mask=total == 0)], ["doc_id", *keep, *COUNTS, "nll"])

    source = documents(df, *keep)
    kinds = ", ".join(f"{c} {dict(source.dtypes)[c]}" for c in ("doc_id", *keep))
    return source.mapInArrow(run, f"{kinds}, {', '.join(f'{c} bigint' for c in COUNTS)}, nll double")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


WIDTH = 3.5  # half the band, in robust deviations
FLOOR = 0.25  # share of the plain deviation that a long text's band keeps
OWN_BAND = 50  # a language with fewer passing texts shares the band of all texts
EXACT = 10_000  # accuracy of the quantile sketches


def bands(measured: DataFrame) -> DataFrame:
    """lang, middle, wide, flat: the nll band of each language among rows that pass the base rules.

    A text of n characters is inside when its nll is within
    ``WIDTH * sqrt(wide^2 / n + (FLOOR * flat)^2)`` of the middle, so lower and
    upper perplexity limits follow from the language and the length.
    The row with a null ``_lang`` of kind 'all' serves languages without a band of their own.
    """
    passing = measured.filter(~base_failed() & F.col("nll").isNotNull()).select(F.explode(F.array(F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("l")), F.struct(F.lit(False).alias("every"), F.col("lang").alias("l")))).alias("k"), "nll", "word_chars").select("k.every", "k.l", "nll", "word_chars")
    middles = passing.groupBy("every", "l").agg(F.percentile_approx("nll", 0.5, EXACT).alias("middle"), F.count("*").alias("n"))
    middles = middles.filter(F.col("every") | (F.col("n") >= OWN_BAND)).withColumnsRenamed({"every": "e2", "l": "l2"})
    off = passing.join(small(middles), (F.col("every") == F.col("e2")) & F.col("l").eqNullSafe(F.col("l2"))).withColumn("off", F.abs(F.col("nll") - F.col("middle")))
    scale = 1.4826  # a normal deviation from the median absolute one
    return off.groupBy("every", "l", "middle").agg((F.percentile_approx(F.col("off") * F.sqrt("word_chars"), 0.5, EXACT) * scale).alias("wide"), (F.percentile_approx("off", 0.5, EXACT) * scale).alias("flat"))


def judge(df: DataFrame) -> DataFrame:
    """doc_id, text hash, lang, the counts, perplexity, base_failed and kept of every row of (doc_id, text, lang).

    The model counts all texts; a missing lang is a language of its own. A row
    is kept when it passes the base rules and its perplexity lies in its band.
    Repeated rows get equal verdicts. An empty table gives no rows.
    """
    source = df.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    model = perplexity.build(documents(source))
    measured = stage(measures(source.withColumn("_h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))), model, "_h", "lang"), "measures")
    limits = stage(bands(measured), "bands")
    every = limits.filter("every").select(F.struct("middle", "wide", "flat").alias("b")).scalar()
    own = limits.filter("not every").select(F.col("l"), F.struct("middle", "wide", "flat").alias("own"))
    joined = measured.join(small(own), F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("band", F.coalesce("own", every))
    half = F.sqrt(F.col("band.wide") * F.col("band.wide") / F.col("word_chars") + F.pow(F.col("band.flat") * FLOOR, F.lit(2))) * WIDTH
    inside = F.coalesce(F.abs(F.col("nll") - F.col("band.middle")) <= half, F.lit(True))
    return joined.select("doc_id", "_h", "lang", *COUNTS, F.exp("nll").alias("perplexity"), base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))


def keep(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that pass, all columns as they are."""
    return without(df, judge(df).filter("not kept"), "lang")
