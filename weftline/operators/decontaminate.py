"""Evaluation n-grams in training text: table, matches, frequency, removal."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import words
from ..session import spread, stage
from .index import with_row_index
from .rolling import matches, occurrences

BROADCAST_BYTES = 16 << 20


def ngrams_at(found: Column, n: int) -> Column:
    """All ``n``-grams of a word array with their word positions."""
    return F.when(
        F.size(found) >= n,
        F.transform(F.sequence(F.lit(0), F.size(found) - n),
                    lambda i: F.struct(F.array_join(F.slice(found, i + 1, F.lit(n)), " ").alias("ngram"), i.alias("word_pos"))))


def ngram_table(tasks: DataFrame, text: str, max_n: int = 13, min_n: int = 8) -> DataFrame:
    """Distinct (ngram, n): every ``max_n``-gram; a text of ``min_n`` or more words below that counts whole."""
    w = tasks.select(words(F.col(text)).alias("_w")).filter(F.size("_w") >= min_n)
    grams = F.when(F.size("_w") < max_n, F.array(F.array_join("_w", " "))).otherwise(F.transform(ngrams_at(F.col("_w"), max_n), lambda x: x["ngram"]))
    return w.select(F.explode(grams).alias("ngram")).distinct().withColumn("n", F.size(F.split("ngram", " ")))


def _lengths(ngrams: DataFrame) -> list[int]:
    # a handful of lengths between min_n and max_n
    return sorted(r[0] for r in ngrams.select("n").distinct().collect())


def _small(df: DataFrame, texts: str) -> DataFrame:
    """A broadcast side while its arrays of ``texts`` are measured to hold at most BROADCAST_BYTES; more join by shuffle."""
    held = df.agg(F.sum(F.aggregate(F.col(texts), F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(t) + 64))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def match_ngrams(df: DataFrame, key: str, text: str, ngrams: DataFrame) -> DataFrame:
    """(key, ngram, word_pos): where evaluation n-grams occur in training texts."""
    lengths = _lengths(ngrams)
    if not lengths:
        return df.select(key, F.lit("").alias("ngram"), F.lit(0).alias("word_pos")).limit(0)
    found = occurrences(spread(df.select(key, text), key), key, text, ngrams.select("ngram"), lengths)
    return found.join(ngrams.select("ngram"), "ngram").select(key, "ngram", "word_pos")


def split_around_match(text: Column, start: Column, length: Column, margin: int = 200) -> tuple[Column, Column]:
    """Text up to the sentence end before the match, and after the next sentence end behind it."""
    head = F.regexp_extract(F.substr(text, F.lit(1), F.greatest(start - margin + 1, F.lit(0))), r"(?s)^(.*[.!?])", 1)
    left = F.when((start - margin > 0) & (F.length(head) > 1), head).otherwise("")
    rest = F.substr(text, start + length + margin + 1)
    return left, F.regexp_extract(rest, r"(?s)^[^.!?]*[.!?](.*)$", 1)


def _touched(df: DataFrame, key: str, text: str, ngrams: DataFrame) -> DataFrame:
    """(key, text, _grams) of the texts that a scan may find n-grams in, with these.

    Scans may resume inside a word, which changes the first word of an n-gram
    only, so candidates are matched on all words but the first. Such texts are
    few; they leave the pass over the corpus with their text, so the corpus is
    not joined again.
    """
    tails = stage(ngrams.select("ngram", F.regexp_replace("ngram", r"^[^ ]+ ", "").alias("_tail")), "tails")
    shorter = [n - 1 for n in _lengths(ngrams)]
    found = stage(occurrences(spread(df.select(key, text), key), key, text, tails.select(F.col("_tail").alias("ngram")), shorter, True), "touched")
    listed = found.select(key, F.explode("_found").alias("_tail")).join(tails, "_tail").groupBy(key).agg(F.collect_set("ngram").alias("_grams"))
    return found.drop("_found").join(listed, key)


def ngram_frequency(df: DataFrame, key: str, text: str, ngrams: DataFrame, max_n: int = 13) -> DataFrame:
    """(ngram, n, freq) of every evaluation n-gram, counted without overlap inside a text; ``key`` is unique."""
    ngrams = stage(ngrams, "ngrams")
    lengths = _lengths(ngrams)
    if not lengths:
        return ngrams.select("ngram", "n", F.lit(0).cast("bigint").alias("freq"))

    def behind(begin: int, start: int, seq: str) -> int:
        return start + len(seq) + 1

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def scan(texts: pd.Series, grams: pd.Series) -> pd.Series:
        return pd.Series([[seq for _, _, seq in matches(t, set(g), lengths, max_n, behind)] for t, g in zip(texts, grams)])

    hit = _touched(df, key, text, ngrams)
    counts = hit.select(F.explode(scan(F.col(text), F.col("_grams"))).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("freq"))
    return ngrams.join(counts, "ngram", "left").select("ngram", "n", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"))


def rare_ngrams(freq: DataFrame, key_threshold: int = 10) -> DataFrame:
    """n-grams seen less often than common phrases are."""
    return freq.filter(F.col("freq") < key_threshold).select("ngram", "n")


def _pieces(lengths: list[int], max_n: int, margin: int, min_piece: int) -> Callable:
    """Clean pieces of one text in the order they are found."""
    def cut(text: str, grams) -> list[str]:
        clean, rest = [], 0  # rest: offset of what is still to be searched; None once it is too short

        def behind(begin: int, start: int, seq: str) -> int | None:
            nonlocal rest
            head = text[begin:begin + max(start - begin - margin, 0) + 1]
            end = max(head.rfind(c) for c in ".!?")
            if end > 0 and start - begin - margin > 0 and end + 1 > min_piece:
                clean.append(head[:end + 1])
            after = start + len(seq) + margin
            ends = [p for p in (text.find(c, after) for c in ".!?") if p >= 0]
            rest = min(ends) + 1 if ends and len(text) - min(ends) - 1 > min_piece else None
            return rest

        for _ in matches(text, set(grams), lengths, max_n, behind):
            pass
        return clean if rest is None else [*clean, text[rest:]]
    return cut


def decontaminate(df: DataFrame, key: str, text: str, ngrams: DataFrame, order: list, prefix: str = "tasks", margin: int = 200,
                  min_piece: int = 200, max_splits: int = 10, max_n: int = 13) -> DataFrame:
    """Documents cut around matches: one row per piece, with ``split_id`` and ``outcome``.

    ``outcome`` is kept, trimmed, split, ignored (nothing left) or too_many
    (more than ``max_splits`` pieces); the last two have no text. Only
    documents that may hold an n-gram are scanned, the rest pass as they are.
    """
    lengths = _lengths(ngrams)
    cut = _pieces(lengths, max_n, margin, min_piece)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(texts: pd.Series, grams: pd.Series) -> pd.Series:
        return pd.Series([cut(t, g) for t, g in zip(texts, grams)])

    numbered = with_row_index(df, order, "_pos")
    if lengths:
        # few documents: their pieces join the rest, which passes as it is
        cut_up = stage(_touched(df, key, text, ngrams).select(key, pieces(F.col(text), F.col("_grams")).alias("_p")), "pieces")
        done = numbered.join(_small(cut_up, "_p"), key, "left").withColumn("_p", F.coalesce("_p", F.array(text)))
    else:
        done = numbered.withColumn("_p", F.array(text))
    n = F.size("_p")
    outcome = (
        F.when(n == 0, "ignored").when(n > max_splits, "too_many").when(n > 1, "split")
        .when(F.length(F.element_at("_p", 1)) < F.length(text), "trimmed").otherwise("kept"))
    shown = F.when((n == 0) | (n > max_splits), F.array(F.lit(None).cast("string"))).otherwise(F.col("_p"))
    own = F.col("split_id") if "split_id" in df.columns else None
    out = done.withColumn("outcome", outcome).select("*", F.posexplode(shown).alias("_i", "_t"))
    fresh = F.format_string(prefix + "-%010d-%04d", F.col("_pos") + 1, F.col("_i"))
    split_id = F.when(F.col("_t").isNotNull(), fresh if own is None else F.concat_ws("-", own, fresh))
    return out.withColumn("split_id", split_id).withColumn(text, F.col("_t")).drop("_p", "_t", "_i", "_pos")
