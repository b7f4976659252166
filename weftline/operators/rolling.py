"""Word n-grams of many lengths found in texts by rolling hashes.

A word has a 64-bit hash h. With an odd base B, the running sums of h[j] * B**j
(modulo 2**64) give the hash of any run of words as a difference of two sums,
scaled back by the inverse of B, so windows of every length cost a subtraction
and a product each. Window hashes are looked up in the hashes of the wanted
n-grams: a sorted array where there are few (counted first), else three bits of
a table of fixed size, whose words are combined by Spark. Only windows that are
found are spelled out, and a join on the strings decides.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

EXACT = 2_000_000  # hashes kept as a sorted array of 8 bytes each
TABLE_BITS = 27  # else: bits of the table, 16 MB
SLICE = 4 << 20  # bytes of text handled at once
KEEP = 200_000  # words remembered with their hashes
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_U = np.uint64


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        value = self[word] = xxh64_intdigest(word, 7)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=_U)


class Rolling:
    """Running sums over the word hashes of many texts; hashes of all windows of a length."""

    def __init__(self, hashes: np.ndarray):
        self.back = _powers(_INVERSE, len(hashes))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(hashes * _powers(BASE, len(hashes)), dtype=_U)])

    def windows(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[n:] - self.sums[:-n]) * self.back[:len(self.sums) - n] + _U(n))


def gram_hash(gram: str, known: WordHashes) -> int:
    words = gram.split(" ")
    return int(Rolling(np.array([known[w] for w in words], _U)).windows(len(words))[0])


class Wanted:
    """Hashes of the wanted n-grams, in an array or in bits of a table."""

    def __init__(self, hashes: np.ndarray | None, bits: np.ndarray | None = None):
        self.hashes, self.bits = hashes, bits
        if hashes is not None:
            # a byte per top bits spares most windows the search
            self.first = np.zeros(1 << 20, bool)
            self.first[(hashes >> _U(44)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of the values that are wanted (a table may name a few others)."""
        if self.hashes is None:
            at = np.arange(len(values))
            for place in _places(values):
                at = at[(self.bits[place[at] >> 3] >> (place[at] & 7).astype(np.uint8)) & 1 == 1]
            return at
        at = np.flatnonzero(self.first[(values >> _U(44)).astype(np.int64)])
        if not len(self.hashes) or not len(at):
            return at[:0]
        near = np.minimum(np.searchsorted(self.hashes, values[at]), len(self.hashes) - 1)
        return at[self.hashes[near] == values[at]]


def _places(values: np.ndarray) -> list[np.ndarray]:
    mask = _U((1 << TABLE_BITS) - 1)
    with np.errstate(over="ignore"):
        return [(v & mask).astype(np.int64) for v in (values, values >> _U(TABLE_BITS), _mixed(values + _U(1)))]


def wanted(grams: DataFrame, exact: int | None = None):
    """A broadcast of the hashes of ``grams`` (ngram): at most EXACT of them, or a table of 16 MB."""
    @F.pandas_udf("bigint")
    def hashed(column: pd.Series) -> pd.Series:
        known = WordHashes()
        return pd.Series([gram_hash(g, known) for g in column], dtype="uint64").astype("int64")

    context = grams.sparkSession.sparkContext
    limit = EXACT if exact is None else exact
    hashes = grams.select(hashed("ngram").alias("h"))
    if grams.limit(limit + 1).count() <= limit:
        return context.broadcast(Wanted(np.unique(hashes.toPandas()["h"].to_numpy(np.int64).view(_U))))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(np.concatenate(_places(batch.column(0).to_numpy().view(_U))))
            word, first = np.unique(place >> 6, return_index=True)
            if len(word):
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(_U(1) << (place & 63).astype(_U), first).view(np.int64))], ["word", "bits"])

    # at most 2**TABLE_BITS / 64 words come back
    words = hashes.mapInArrow(set_bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return context.broadcast(Wanted(None, table.view(np.uint8)))


def tokens(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about SLICE bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + SLICE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def occurrences(df: DataFrame, key: str, text: str, grams: DataFrame, lengths: list[int], carry_text: bool = False) -> DataFrame:
    """(key, ngram, word_pos) of the windows whose hash is wanted; with ``carry_text`` (key, text, _found) of the texts that have any, the n-grams once each.

    What comes out still has to be held against the strings of ``grams``.
    """
    held = wanted(grams)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for batch in _runs(whole):
                if len(known) > KEEP:
                    known.clear()
                lists = [tokens(t.as_py()) for t in batch.column(1)]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                flat = [w for words in lists for w in words]
                if not flat:
                    continue
                rolling = Rolling(np.fromiter(map(known.__getitem__, flat), _U, len(flat)))
                row = np.repeat(np.arange(len(lists)), sizes)
                start = np.cumsum(sizes) - sizes
                rows, grams_, places = [], [], []
                for n in lengths:
                    if n > len(flat):
                        continue
                    at = held.value.find(rolling.windows(n))
                    at = at[row[at] == row[at + n - 1]]
                    rows.append(row[at])
                    places.append(at - start[row[at]])
                    grams_ += [" ".join(flat[i:i + n]) for i in at.tolist()]
                if not grams_:
                    continue
                rows, places = np.concatenate(rows), np.concatenate(places)
                if carry_text:
                    found: dict[int, set] = {}
                    for r, g in zip(rows.tolist(), grams_):
                        found.setdefault(r, set()).add(g)
                    take = pa.array(list(found))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([sorted(g) for g in found.values()], pa.list_(pa.string()))], [key, text, "_found"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(grams_), pa.array(places, pa.int32())], [key, "ngram", "word_pos"])

    schema = f"`{key}` {kind}, `{text}` string, _found array<string>" if carry_text else f"`{key}` {kind}, ngram string, word_pos int"
    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


# ---- scans that go on behind a match --------------------------------------------------------------------------------


class Scan:
    """The matches of some n-grams in one text, in the order in which a scan of its words meets them.

    Of the places where a longest n-gram still fits, the first one counts, and
    there the longest, then the shorter lengths in order; behind the last of
    them length by length. The text is split into words once. A scan that goes
    on at an offset inside a word takes the rest of that word as its first.
    """

    def __init__(self, text: str, grams: set[str], lengths: list[int], max_n: int):
        lower = text.lower()
        self.text, self.grams, self.max_n, self.lengths = text, grams, max_n, lengths
        self.steady = len(lower) == len(text)
        found = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\w+", lower)]
        self.words, self.starts, self.ends = ([f[i] for f in found] for i in range(3))
        self.order = [max_n, *[n for n in lengths if n != max_n]]
        firsts: dict[str, set[int]] = {}
        for g in grams:
            words = g.split(" ")
            firsts.setdefault(words[0], set()).add(len(words))
        # per place the first length that matches, and all of them
        self.at: list[tuple[int, int]] = []
        self.by_length: dict[int, list[int]] = {n: [] for n in self.order}
        for i, w in enumerate(self.words):
            sizes = firsts.get(w)
            if not sizes:
                continue
            hits = [n for n in self.order if n in sizes and i + n <= len(self.words) and " ".join(self.words[i:i + n]) in grams]
            if hits:
                self.at.append((i, hits[0]))
                for n in hits:
                    self.by_length[n].append(i)

    def first(self, offset: int) -> tuple[int, str] | None:
        """Offset and n-gram of the first match at or behind ``offset``."""
        j = bisect_left(self.starts, offset)
        cut = j > 0 and self.ends[j - 1] > offset
        words, n_words = self.words, len(self.words) - j + cut
        last = len(words) - self.max_n  # the last place where a longest n-gram fits
        if n_words < self.max_n:
            return None
        if cut:
            rest = self.text[offset:self.ends[j - 1]].lower()
            for n in self.order:
                seq = " ".join([rest, *words[j:j + n - 1]])
                if seq in self.grams:
                    return offset, seq
        k = bisect_left(self.at, (j, -1))
        if k < len(self.at) and self.at[k][0] <= last:
            i, n = self.at[k]
            return self.starts[i], " ".join(words[i:i + n])
        if n_words > self.max_n:
            for n in self.lengths:
                if n != self.max_n:
                    places = self.by_length[n]
                    k = bisect_left(places, max(last, j))
                    if k < len(places):
                        return self.starts[places[k]], " ".join(words[places[k]:places[k] + n])
        return None


def matches(text: str, grams: set[str], lengths: list[int], max_n: int, resume) -> Iterator[tuple[int, int, str]]:
    """(offset where the search began, offset of the match, n-gram) of one match after another.

    ``resume`` gets the same three and names the offset where the search goes
    on, or None. Letters whose lower case is longer move the offsets of a
    search; such texts are split anew each time.
    """
    begin, scan, base = 0, None, 0
    while begin is not None:
        if scan is None or not scan.steady:
            scan, base = Scan(text[begin:], grams, lengths, max_n), begin
        hit = scan.first(begin - base)
        if hit is None:
            return
        found = begin, base + hit[0], hit[1]
        yield found
        begin = resume(*found)
