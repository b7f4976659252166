"""Greedy longest-match word pieces.

A vocabulary of bounded size (counted first) goes to the tasks, which cut the
words of a text where they are, each distinct word of a slice once, so no word
is shuffled. A larger one stays a table: distinct words meet it in a join and
are joined back.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .arrays import let
from .text import blank_tokens

PIECES, PIECE_CHARS = 1 << 20, 1 << 24  # the largest vocabulary that tasks hold
WORDS = 1 << 18  # words of a batch handled at once
KEEP = 200_000  # words remembered with their pieces


def _walk(word: Column, matches: Column, unknown: str) -> Column:
    """Pieces of a word from the longest match at each place; a word that cannot be covered is one unknown."""
    def step(state: Column, p: Column) -> Column:
        size = F.try_element_at(matches, p)
        piece = F.concat(F.when(p > 0, "##").otherwise(""), F.substring(word, p + 1, size))
        here = state.at == p
        return F.struct(
            F.when(here & size.isNotNull(), p + size).otherwise(state.at).alias("at"),
            F.when(here & size.isNotNull(), F.concat(state.out, F.array(piece))).otherwise(state.out).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), F.length(word) - 1), first, step)
    # walked once, though both fields are read
    return let(walked, lambda w: F.when(w.at == F.length(word), w.out).otherwise(F.array(F.lit(unknown))))


def cutter(known: frozenset[str], unknown: str, max_chars: int) -> Callable[[str], list[str]]:
    """The pieces of one word by the same rule."""
    longest = max(map(len, known), default=0)

    def cut(word: str) -> list[str]:
        out, at = [], 0
        while at < len(word) <= max_chars:
            mark = "##" if at else ""
            end = next((e for e in range(min(len(word), at + longest), at, -1) if mark + word[at:e] in known), at)
            if end == at:
                return [unknown]
            out.append(mark + word[at:end])
            at = end
        return out or [unknown]
    return cut


def _pieces(words: pa.ListArray, seen: dict[str, list[str]], cut: Callable[[str], list[str]]) -> pa.ListArray:
    """Pieces of every list of words; distinct words are looked up, the rest is copied by place."""
    coded = words.flatten().dictionary_encode()
    cuts = []
    for w in coded.dictionary.to_pylist():
        if w not in seen:
            seen[w] = cut(w)
        cuts.append(seen[w])
    at = coded.indices.to_numpy()
    sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
    n = sizes[at]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    places = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n) + np.arange(ends[-1])
    spelled = pa.array(itertools.chain.from_iterable(cuts), pa.string()).take(pa.array(places))
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.list_value_length(words).to_numpy())])
    return pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), spelled)


def _cut_in_place(df: DataFrame, words: str, known: DataFrame, unknown: str, max_chars: int) -> DataFrame:
    """``df`` with the last column, ``words`` of each row, replaced by their ``pieces``."""
    shared = df.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in known.toLocalIterator()))
    kept = df.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = cutter(shared.value, unknown, max_chars), {}
        for batch in batches:
            held = np.cumsum(pc.list_value_length(batch.column(words)).to_numpy())
            for start, end in itertools.pairwise([0, *(np.flatnonzero(np.diff(held // WORDS)) + 1), batch.num_rows]):
                part = batch.slice(start, end - start)
                if len(seen) > KEEP:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _pieces(part.column(words), seen, cut)], [*kept, "pieces"])
    return df.mapInArrow(run, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "pieces array<string>"]))


def wordpiece(docs: DataFrame, key: str, text: str, vocab: DataFrame, piece: str = "piece", unknown: str = "[UNK]", max_chars: int = 200) -> DataFrame:
    """(key, pieces) of every document; blank and null texts have none, and rows of one key have the pieces of all its rows."""
    known = vocab.select(F.col(piece).alias("_piece")).filter("_piece IS NOT NULL").distinct()
    size = known.agg(F.count("*").alias("n"), F.sum(F.length("_piece")).alias("chars")).first()
    if size.n > PIECES or (size.chars or 0) > PIECE_CHARS:
        return _by_join(docs, key, text, known, unknown, max_chars)
    tokens = blank_tokens(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("_words")
    repeated = docs.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_key"))
    if repeated.isEmpty():
        return _cut_in_place(docs.select(key, tokens), "_words", known, unknown, max_chars)
    repeated = stage(repeated, "repeated_keys")
    same = F.col(key).eqNullSafe(F.col("_key"))
    once = _cut_in_place(docs.join(repeated, same, "left_anti").select(key, tokens), "_words", known, unknown, max_chars)
    words = docs.join(repeated, same, "left_semi").select(F.col(key), F.posexplode(tokens).alias("_i", "_w"))
    cut = _cut_in_place(words.select(key, "_i", F.array("_w").alias("_words")), "_words", known, unknown, max_chars)
    return once.unionByName(_gathered(docs.join(repeated, same, "left_semi"), key, cut.withColumnRenamed("pieces", "_pieces")))


def _gathered(docs: DataFrame, key: str, placed: DataFrame) -> DataFrame:
    """(key, pieces) of the rows of ``docs`` from (key, _i, _pieces) of their words."""
    # sort_array compares natively, array_sort by an interpreted function
    joined = placed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "_pieces"))).alias("_all")).select(F.col(key).alias("_key"), F.flatten(F.col("_all._pieces")).alias("pieces"))
    return docs.select(key).join(joined, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce("pieces", F.array().cast("array<string>")).alias("pieces"))


def _by_join(docs: DataFrame, key: str, text: str, known: DataFrame, unknown: str, max_chars: int) -> DataFrame:
    """The same with a vocabulary of any size: substrings of the distinct words, no longer than its longest piece, meet it in a join."""
    longest = known.agg(F.max(F.length("_piece")).alias("n")).scalar()
    words = docs.select(F.col(key), F.posexplode(blank_tokens(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("_i", "_w"))
    distinct = words.select("_w").distinct()
    places = distinct.filter(F.length("_w") <= max_chars).withColumn("_longest", longest).select("_w", "_longest", F.explode(F.sequence(F.lit(0), F.length("_w") - 1)).alias("_p"))
    parts = places.select("_w", "_p", F.explode(F.sequence(F.lit(1), F.least(F.length("_w") - F.col("_p"), F.col("_longest")))).alias("_n"))
    spelled = parts.withColumn("_piece", F.concat(F.when(F.col("_p") > 0, "##").otherwise(""), F.substring("_w", F.col("_p") + 1, F.col("_n"))))
    best = spelled.join(known, "_piece").groupBy("_w", "_p").agg(F.max("_n").alias("_n"))
    maps = best.groupBy("_w").agg(F.map_from_entries(F.collect_list(F.struct("_p", "_n"))).alias("_m"))
    cut = maps.select("_w", _walk(F.col("_w"), F.col("_m"), unknown).alias("_pieces"))
    placed = words.join(cut, "_w", "left").withColumn("_pieces", F.coalesce("_pieces", F.array(F.lit(unknown))))
    return _gathered(docs, key, placed)
