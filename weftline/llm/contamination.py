"""Benchmark decontamination by latent semantic retrieval.

Documents are read once into the numbers of their words in the benchmark's
vocabulary (0 for all others). Passages are windows of two blocks, with blocks
as long as the items of a size class, so an item lies whole in some passage.
TF-IDF rows of all passages (inverse frequencies
counted over all documents), and of the items weighted to count as much, are
decomposed by a randomised SVD: tasks multiply their rows with a random
matrix and back, the driver orthogonalises the sum (vocabulary x rank), and a
second pass gives the small Gram matrix whose eigenvectors turn that basis
into singular vectors. Passages whose latent vector has a cosine of ``COSINE``
or more with an item are candidates, and so, whatever their cosine, are all
that hold one of the item's probe words: rarest words of which every copy and
every paraphrase holds one at least (:func:`probes`). So no copy or paraphrase
depends on the decomposition. A candidate is a copy when the longest
common subsequence of words covers ``COPY`` of the item, and a paraphrase when
it covers ``PARAPHRASE`` and the passage holds the item's answer: that of an
``answer`` column if there is one, else the item's most telling words.

Words are lower-cased and lose their outer signs. Items are worked off in
blocks of ``ITEMS``, so what the driver and every task hold is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import documents, ragged, slices, text_key, without
from .words import Words

RANK = 128
EXTRA = 16  # random directions beyond the rank
BLOCK = 32  # words; size classes double it
COSINE = 0.35
COPY = 0.8
PARAPHRASE = 0.5
ANSWER = 0.8  # share of the answer's words that a paraphrase holds
COMMON = 0.002  # occurrences per block beyond which a word has no weight
ITEMS = 2000
CELLS = 1 << 25  # windows x vocabulary held at once
SEED = 11
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—¡¿·"


def normal(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), characters=_SIGNS)


class Items:
    """A block of benchmark items: vocabulary, word numbers (from 1) and answers."""

    def __init__(self, rows: list):
        self.ids, self.words, self.answers, vocabulary = [], [], [], {}
        for row in rows:
            found = Words(pa.array([row["text"] or ""]))
            spelled = [w for w in normal(found.unique).take(pa.array(found.codes)).to_pylist() if w] if len(found.codes) else []
            if not spelled:
                continue
            given = Words(pa.array([row["answer"] or ""])) if "answer" in row else None
            answer = {w for w in normal(given.unique).to_pylist() if w} if given is not None and len(given.codes) else set()
            self.ids.append(row["item_id"])
            self.words.append([vocabulary.setdefault(w, len(vocabulary) + 1) for w in spelled])
            self.answers.append({vocabulary.setdefault(w, len(vocabulary) + 1) for w in sorted(answer)})
        self.vocabulary = list(vocabulary)
        # class of an item: how often its block doubles until the item fits
        self.classes = [max(0, math.ceil(math.log2(len(w) / BLOCK))) for w in self.words]


def numbered(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, _h, terms: 4 bytes for every word of the text, its number or 0; texts without any number are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_string())
        for batch in slices(batches, "text"):
            words = Words(batch.column(1))
            found = pc.index_in(normal(words.unique), value_set=known) if len(words.unique) else pa.array([], pa.int32())
            number = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype("<i4") + np.int32(1)
            terms = number[words.codes] if len(words.codes) else np.zeros(0, "<i4")
            ends = np.cumsum(words.counts)
            held = np.bincount(words.rows[terms > 0], minlength=words.n) > 0
            at = np.flatnonzero(held)
            data = [terms[a:b].tobytes() for a, b in zip((ends - words.counts)[at].tolist(), ends[at].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(data, pa.binary())], ["doc_id", "_h", "terms"])

    source = documents(df).withColumn("_h", text_key())
    return source.select("doc_id", "text", "_h").mapInArrow(run, "doc_id bigint, _h bigint, terms binary")


class Blocks:
    """Occurrences (block, term) of a batch of documents, in order; blocks never cross documents."""

    def __init__(self, terms: pa.Array):
        flat, bounds = _flat(terms)
        size = np.diff(bounds)
        self.terms, self.bounds = flat, bounds
        self.many = -(-size // BLOCK)
        self.first = np.cumsum(self.many) - self.many
        at = np.flatnonzero(flat)
        doc = np.searchsorted(bounds, at, side="right") - 1
        self.owner, self.place = doc, at - bounds[doc]
        self.block = self.first[doc] + self.place // BLOCK
        self.term = flat[at] - 1
        self.total = int(self.many.sum())
        self.doc = np.repeat(np.arange(len(size)), self.many)


def _flat(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.binary_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(terms.to_pylist()), "<i4"), np.concatenate([[0], np.cumsum(sizes // 4)])


def _sums(rows: np.ndarray, at: np.ndarray, total: int) -> np.ndarray:
    """Sum of the rows that share a place, for places in order."""
    out = np.zeros((total, rows.shape[1]), np.float32)
    if len(at):
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[edge]] = np.add.reduceat(rows, edge, axis=0)
    return out


def word_counts(table: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """How often each word occurs, and the number of blocks, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, blocks = np.zeros(size, np.int64), 0
        for batch in slices(batches, "terms"):
            flat, bounds = _flat(batch.column(0))
            total += np.bincount(flat, minlength=size + 1)[1:]
            blocks += int((-(-np.diff(bounds) // BLOCK)).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], blocks))], ["term", "n"])

    rows = table.select("terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size + 1, np.int64)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return out[:size], int(out[size])


def weights(counts: np.ndarray, blocks: int, items: Items) -> np.ndarray:
    """Inverse frequency of each word; common words weigh nothing, but an item keeps its three rarest."""
    inverse = np.log((1.0 + blocks) / (1.0 + np.minimum(counts, blocks))).astype(np.float32) + np.float32(0.01)
    out = np.where(counts > COMMON * max(blocks, 1), 0, inverse).astype(np.float32)
    for words in items.words:
        own = np.unique(np.array(words) - 1)
        rarest = own[np.lexsort((own, counts[own]))[:3]]
        out[rarest] = inverse[rarest]
    return out


def _passages(b: Blocks, weight: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted occurrences (block, term) and the product of every block's row with the basis."""
    told = weight[b.term] > 0
    block, term = b.block[told], b.term[told]
    return block, term, _sums(weight[term][:, None] * basis[term], block, b.total)


def _pairs(rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Windows of two neighbouring blocks (the last block of a document stands alone)."""
    out = rows.copy()
    if len(rows) > 1:
        next_ = doc[1:] == doc[:-1]
        out[:-1][next_] += rows[1:][next_]
    return out


def _total(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum of matrices sent as (slab, data) rows; a slab's rows are one per task."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        whole = reduce(lambda a, d: a + np.frombuffer(d, "<f8"), group["data"], 0.0)
        return pd.DataFrame({"slab": [group["slab"].iloc[0]], "data": [np.asarray(whole, "<f8").tobytes()]})

    out = np.zeros(shape)
    for slab, data in parts.groupBy("slab").applyInPandas(add, "slab int, data binary").collect():
        rows = np.frombuffer(bytes(data), "<f8").reshape(-1, shape[1])
        out[slab * SLAB:slab * SLAB + len(rows)] = rows
    return out


SLAB = 128  # matrix rows that travel together


def _slabs(matrix: np.ndarray) -> pa.RecordBatch:
    data = [np.ascontiguousarray(matrix[low:low + SLAB], "<f8").tobytes() for low in range(0, len(matrix), SLAB)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int32()), pa.array(data, pa.binary())], ["slab", "data"])


def _item_rows(items: Items, weight: np.ndarray) -> np.ndarray:
    out = np.zeros((len(items.ids), len(weight)), np.float32)
    for i, words in enumerate(items.words):
        np.add.at(out[i], np.array(words) - 1, weight[np.array(words) - 1])
    return out


def singular_vectors(table: DataFrame, items: Items, weight: np.ndarray, blocks: int, rank: int = RANK) -> np.ndarray:
    """vocabulary x rank: right singular vectors of the TF-IDF rows of all passages and items."""
    size = len(weight)
    wide = min(size, rank + EXTRA)
    random = np.random.default_rng(SEED).standard_normal((size, wide)).astype(np.float32)
    share = max(1.0, blocks / max(1, len(items.ids)))  # items count as much as all passages together

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, wide))
        for batch in slices(batches, "terms", 1 << 20):
            b = Blocks(batch.column(0))
            block, term, rows = _passages(b, weight, random)
            # a block's words occur in the window that it opens and in the one before it
            windows = _pairs(rows, b.doc)
            before = np.zeros_like(windows)
            if len(windows) > 1:
                next_ = b.doc[1:] == b.doc[:-1]
                before[1:][next_] = windows[:-1][next_]
            order = np.argsort(term, kind="stable")
            both = (windows + before)[block[order]] * weight[term[order]][:, None]
            total += _sums(both, term[order], size)
        yield _slabs(total)

    own = _item_rows(items, weight)
    summed = _total(table.select("terms").mapInArrow(back, "slab int, data binary"), (size, wide)) + share * (own.T @ (own @ random))
    basis = np.linalg.qr(summed)[0].astype(np.float32)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in slices(batches, "terms", 1 << 20):
            b = Blocks(batch.column(0))
            windows = _pairs(_passages(b, weight, basis)[2], b.doc)
            windows = windows[windows.any(axis=1)]
            total += windows.T @ windows
        yield _slabs(total)

    small_ = _total(table.select("terms").mapInArrow(gram, "slab int, data binary"), (basis.shape[1], basis.shape[1])) + share * ((own @ basis).T @ (own @ basis))
    values, vectors = np.linalg.eigh(small_)
    top = np.argsort(values)[::-1][:rank]
    return (basis @ vectors[:, top]).astype(np.float32)


def common_subsequence(item: list[int], passage: list[int]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in passage:
        hit = row & where.get(w, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


def _needed(size: int, share: float) -> int:
    """The fewest of ``size`` words that make up ``share``."""
    return next(k for k in range(size + 1) if k / size >= share)


def probes(words: list[int], answer: set[int], counts: np.ndarray) -> set[int]:
    """Words of which every passage that is a copy or a paraphrase of an item holds one at least.

    With k of n words needed, a passage without any of the n - k + 1 rarest has
    too few. A paraphrase needs words of the item and of the answer: the side
    that is met less often is taken.
    """

    def rarest(given, share: float) -> set[int]:
        each = sorted(given, key=lambda w: (counts[w - 1], w))
        return set(each[:len(each) - _needed(len(each), share) + 1])

    return rarest(words, COPY) | min(rarest(answer, ANSWER), rarest(words, PARAPHRASE), key=lambda some: sum(int(counts[w - 1]) for w in some))


class Probes:
    """The items of one size class by their probe words, and what their copies and paraphrases hold at least."""

    def __init__(self, words: list[list[int]], answers: list[set[int]], counts: np.ndarray):
        self.size = len(counts)
        asked = sorted((w - 1, i) for i, (given, answer) in enumerate(zip(words, answers)) for w in probes(given, answer, counts))
        self.items = np.array([i for _, i in asked], np.int64)
        self.bounds = np.searchsorted([w for w, _ in asked], np.arange(self.size + 1))
        self.words, self.answers = self._table(words), self._table(answers)
        self.copy, self.paraphrase = (np.array([_needed(len(given), share) for given in words]) for share in (COPY, PARAPHRASE))
        self.answered = np.array([_needed(len(answer), ANSWER) for answer in answers])

    def _table(self, lists: list) -> np.ndarray:
        """Word places of every list, one row each, filled up with a word that no passage holds."""
        out = np.full((len(lists), max(map(len, lists))), self.size, np.int64)
        for row, given in zip(out, lists):
            row[:len(given)] = np.array(sorted(given)) - 1
        return out

    def asked(self, block: np.ndarray, term: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """window * items + item wherever a window holds a probe word; joined[i]: window i goes on in block i + 1."""
        sizes = np.diff(self.bounds)
        told = sizes[term] > 0
        block, term = np.divmod(np.unique(block[told] * self.size + term[told]), self.size)
        item = self.items[ragged(self.bounds[term], sizes[term])]
        block = np.repeat(block, sizes[term])
        before = np.flatnonzero((block > 0) & joined[block - 1])
        n = len(self.words)
        return np.unique(np.concatenate([block * n + item, (block[before] - 1) * n + item[before]]))

    def possible(self, keys: np.ndarray, block: np.ndarray, term: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Those of the keys (in order) whose window holds words enough for a copy or a paraphrase, in whatever order."""
        window, item = np.divmod(keys, len(self.words))
        step, out = max(1, CELLS // (self.size + 1)), [np.zeros(0, np.int64)]
        low = 0
        while low < len(keys):
            start = int(window[low])
            high = int(np.searchsorted(window, start + step))
            a, b = np.searchsorted(block, [start, start + step + 1])
            held = np.zeros((step + 1, self.size + 1), bool)
            held[block[a:b] - start, term[a:b]] = True
            on = np.flatnonzero(joined[start:start + step])
            held[on] |= held[on + 1]
            for at in range(low, high, 1 << 15):
                some = slice(at, min(at + (1 << 15), high))
                place, i = (window[some] - start)[:, None], item[some]
                shared = held[place, self.words[i]].sum(axis=1)
                told = held[place, self.answers[i]].sum(axis=1)
                out.append(keys[some][(shared >= self.copy[i]) | (shared >= self.paraphrase[i]) & (told >= self.answered[i])])
            low = high
        return np.concatenate(out)


def _search(table: DataFrame, items: Items, weight: np.ndarray, vectors: np.ndarray, counts: np.ndarray) -> DataFrame:
    own = _item_rows(items, weight) @ vectors
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    classes = np.array(items.classes)
    telling = []
    for words in items.words:
        each = sorted(set(words), key=lambda w: (-weight[w - 1], w))
        telling.append(set(each[:max(2, len(each) // 4)]))
    answers = [a or t for a, t in zip(items.answers, telling)]
    names = items.ids
    levels = []
    for level in range(int(classes.max()) + 1):
        mine = np.flatnonzero(classes == level)
        levels.append((mine, Probes([items.words[i] for i in mine], [answers[i] for i in mine], counts) if len(mine) else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "terms", 1 << 20):
            b = Blocks(batch.column(2))
            blocks, doc = _passages(b, weight, vectors)[2], b.doc
            start = (np.arange(b.total) - b.first[doc]) * BLOCK
            rows, step = [], BLOCK
            for mine, probe in levels:
                if len(mine):
                    joined = np.append(doc[1:] == doc[:-1], False)
                    first = np.searchsorted(doc, np.arange(len(b.bounds) - 1))
                    block = first[b.owner] + b.place // step
                    windows = _pairs(blocks, doc)
                    size = np.linalg.norm(windows, axis=1)
                    live = np.flatnonzero(size > 1e-6)
                    found = [probe.asked(block, b.term, joined)]
                    for low in range(0, len(live), 1 << 14):
                        some = live[low:low + (1 << 14)]
                        w, i = np.nonzero((windows[some] / size[some, None]) @ own[mine].T >= COSINE)
                        found.append(some[w] * len(mine) + i)
                    keys = probe.possible(np.unique(np.concatenate(found)), block, b.term, joined)
                    for at, i in zip(*(x.tolist() for x in np.divmod(keys, len(mine)))):
                        item = int(mine[i])
                        d = int(doc[at])
                        begin = int(b.bounds[d] + start[at])
                        passage = b.terms[begin:min(begin + 2 * step, int(b.bounds[d + 1]))]
                        passage = passage[passage > 0].tolist()
                        covered = common_subsequence(items.words[item], passage) / len(items.words[item])
                        if covered >= PARAPHRASE:
                            answered = len(answers[item].intersection(passage)) / len(answers[item])
                            kind = "copy" if covered >= COPY else "paraphrase" if answered >= ANSWER else None
                            if kind:
                                cosine = float(windows[at] @ own[item] / size[at]) if size[at] > 1e-6 else 0.0
                                rows.append((d, names[item], cosine, covered, answered, kind, int(start[at])))
                # blocks of the next class are pairs of this one's
                pair = start // step % 2 == 0
                merged = _pairs(blocks, doc)[pair]
                blocks, doc, start, step = merged, doc[pair], start[pair], step * 2
            c = list(zip(*rows)) if rows else [[] for _ in range(7)]
            at = pa.array(c[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.float64()), pa.array(c[5], pa.string()), pa.array(c[6], pa.int64())],
                                             ["doc_id", "_h", "item_id", "cosine", "covered", "answered", "kind", "word"])

    return table.mapInArrow(run, "doc_id bigint, _h bigint, item_id bigint, cosine double, covered double, answered double, kind string, word bigint")


def leaks(df: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """doc_id, _h (text hash), item_id, kind, covered, answered, cosine, word of every document that holds an item.

    One row per document and item, of its best passage; ``word`` is the first
    word of that passage. Null and empty texts and items match nothing;
    repeated rows give one row; empty tables give none.
    """
    spark = df.sparkSession
    columns = ["item_id", "text", *(["answer"] if "answer" in benchmark.columns else [])]
    listed = benchmark.select(*[F.col(c).cast("bigint" if c == "item_id" else "string").alias(c) for c in columns]).filter("item_id is not null").orderBy("item_id", "text")
    found, held = [], []

    def work(rows: list) -> None:
        items = Items(rows)
        if not items.ids:
            return
        table = stage(numbered(df, items.vocabulary), "terms")
        counts, blocks = word_counts(table, len(items.vocabulary))
        if not blocks:
            return
        weight = weights(counts, blocks, items)
        found.append(stage(_search(table, items, weight, singular_vectors(table, items, weight, blocks, rank), counts), "leaks"))

    for row in listed.toLocalIterator():
        held.append(row.asDict())
        if len(held) == ITEMS:
            work(held)
            held = []
    work(held)
    if not found:
        return spark.createDataFrame([], "doc_id bigint, _h bigint, item_id bigint, kind string, covered double, answered double, cosine double, word bigint")
    every = reduce(DataFrame.unionAll, found)
    best = every.groupBy("doc_id", "_h", "item_id").agg(F.max(F.struct("covered", "answered", "cosine", "kind", (-F.col("word")).alias("word"))).alias("b"))
    return best.select("doc_id", "_h", "item_id", "b.kind", "b.covered", "b.answered", "b.cosine", (-F.col("b.word")).alias("word"))


def keep(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``df`` that hold no benchmark item, all columns as they are."""
    return without(df, leaks(df, benchmark))
