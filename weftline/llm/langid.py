"""Language identification by unigram pieces, summed over all segmentations.

Pieces are those of a fixed public vocabulary. A word, lower-cased and behind
the vocabulary's word mark, is scored by a forward pass that adds up every way
to cut it into pieces; a text is the product of its words. Piece
probabilities of a language are expected counts under all segmentations
(forward and backward passes), taken over every training text. Passes run over
blocks of distinct words at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import U64, documents, hold, mix, slices
from .words import Words

MARK = "▁"
CUT = 30  # longer words are cut every so many characters; the parts are scored one after another
FLOOR = 1e-7  # a character that the vocabulary lacks
SMOOTH = 0.5  # added to the expected count of every piece
BLOCK = 1 << 14
UNKNOWN = "und"
_FACTOR = mix(np.arange(1, 65), 21) | U64(1)


class Pieces:
    """The vocabulary as a hash table from runs of characters to piece numbers."""

    _known: dict[str, "Pieces"] = {}

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces = sorted({model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
        self.pieces = [p for p in self.pieces if len(p) <= CUT + 1]
        self.longest = max(map(len, self.pieces))
        keys = np.concatenate([self._hash(p) for p in self.pieces])
        self.bits = 19
        self.keys, self.ids = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int32)
        mask = (1 << self.bits) - 1
        for number, key in enumerate(keys.tolist()):
            at = key & mask
            while self.ids[at] >= 0:
                at = (at + 1) & mask
            self.keys[at], self.ids[at] = key, number
        run = np.flatnonzero(np.concatenate([self.ids < 0, [True]]))
        self.probes = int(np.diff(np.concatenate([[-1], run])).max())

    @classmethod
    def of(cls, path: str) -> "Pieces":
        if path not in cls._known:
            cls._known[path] = cls(path)
            hold("langid", cls._known.clear)
        return cls._known[path]

    def _hash(self, piece: str) -> np.ndarray:
        points = np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(U64)
        with np.errstate(over="ignore"):
            total = (points[::-1] * _FACTOR[:len(points)]).sum(dtype=U64, keepdims=True)
        return mix(total, 30 + len(points))

    def find(self, keys: np.ndarray) -> np.ndarray:
        mask = U64((1 << self.bits) - 1)
        at = (keys & mask).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.ids[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.ids[at] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & int(mask)
            hit = self.keys[at[open_]] == keys[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (self.ids[at[open_]] >= 0)]
        return out


def _blocks(words: list[str], pieces: Pieces) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, length, ids) of blocks of word parts of like length.

    ids[k - 1, t] holds the pieces of k characters that end at character t of each part;
    -1 stands for none, and the number behind the vocabulary for an unknown single character.
    """
    owner, parts = [], []
    for i, word in enumerate(words):
        word = MARK + word
        if len(word) <= CUT + 1:
            owner.append(i)
            parts.append(word)
        else:
            for low in range(0, len(word), CUT + 1):
                owner.append(i)
                parts.append(word[low:low + CUT + 1])
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    order = np.argsort(size, kind="stable")
    owners = np.array(owner, np.int64)
    for low in range(0, len(order), BLOCK):
        block = order[low:low + BLOCK]
        length, wide = size[block], int(size[block[-1]])
        points = np.frombuffer("".join([parts[i].ljust(wide) for i in block.tolist()]).encode("utf-32-le"), np.uint32).reshape(len(block), wide).T.astype(U64)
        deep = min(wide, pieces.longest)
        ids = np.full((deep, wide, len(block)), -1, np.int32)
        total = np.zeros_like(points)
        with np.errstate(over="ignore"):
            for k in range(1, deep + 1):
                total[k - 1:] += points[:wide - k + 1] * _FACTOR[k - 1]
                ids[k - 1, k - 1:] = pieces.find(mix(total[k - 1:], 30 + k).ravel()).reshape(wide - k + 1, len(block))
        ids[0][ids[0] < 0] = len(pieces.pieces)
        yield owners[block], length, ids


def _forward(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """alpha[t, word, language]: probability of the first t characters over all segmentations."""
    deep, wide, n = ids.shape
    alpha = np.zeros((wide + 1, n, table.shape[1]))
    alpha[0] = 1.0
    for t in range(1, wide + 1):
        for k in range(1, min(deep, t) + 1):
            row = ids[k - 1, t - 1]
            at = np.flatnonzero(row >= 0)
            if len(at):
                alpha[t, at] += alpha[t - k, at] * table[row[at]]
    return alpha


def log_scores(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probability (word x language) summed over segmentations; ``table`` ends with the floor row."""
    out = np.zeros((len(words), table.shape[1]))
    for owner, length, ids in _blocks(words, pieces):
        alpha = _forward(ids, table)
        np.add.at(out, owner, np.log(alpha[length, np.arange(len(length))]))
    return out


def expected_counts(words: list[str], weights: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of the weighted words, for a one-column table."""
    out = np.zeros(len(pieces.pieces) + 1)
    p = table[:, :1]
    for owner, length, ids in _blocks(words, pieces):
        deep, wide, n = ids.shape
        alpha = _forward(ids, p)[:, :, 0]
        beta = np.zeros((wide + 1, n))
        beta[length, np.arange(n)] = weights[owner] / alpha[length, np.arange(n)]
        for t in range(wide, 0, -1):
            for k in range(1, min(deep, t) + 1):
                row = ids[k - 1, t - 1]
                at = np.flatnonzero((row >= 0) & (beta[t] > 0))
                if len(at):
                    through = p[row[at], 0] * beta[t, at]
                    beta[t - k, at] += through
                    out += np.bincount(row[at], weights=alpha[t - k, at] * through, minlength=len(out))
    return out[:-1]


def train(df: DataFrame, vocabulary: str, rounds: int = 1) -> tuple[list[str], np.ndarray]:
    """Languages in order and their piece probabilities, from all rows of (text, lang) that have both.

    Every round is one pass over the texts; the first starts from equal
    probabilities. What returns to the driver is languages x vocabulary.
    """
    number = len(Pieces.of(vocabulary).pieces)
    start = np.full((number, 1), 1.0 / number)
    langs: list[str] = []
    known = df.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    table = start
    for step in range(rounds):
        given, names = table, list(langs)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, sums = Pieces.of(vocabulary), {}
            for batch in slices(batches, "text", owner="langid"):
                coded = batch.column(1).dictionary_encode()
                which = coded.indices.to_numpy(zero_copy_only=False)
                words = Words(pc.utf8_lower(batch.column(0)))
                for i, lang in enumerate(coded.dictionary.to_pylist()):
                    often = np.bincount(words.codes[which[words.rows] == i], minlength=len(words.unique))
                    seen = np.flatnonzero(often)
                    column = given[:, [names.index(lang)]] if names else given
                    probabilities = np.vstack([column, [[FLOOR]]])
                    found = expected_counts(words.unique.take(pa.array(seen)).to_pylist(), often[seen].astype(float), pieces, probabilities)
                    sums[lang] = sums.get(lang, 0) + found
            for lang, found in sums.items():
                at = np.flatnonzero(found > 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at])], ["lang", "piece", "n"])

        rows = known.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        langs = sorted(rows["lang"].unique())
        sums = np.zeros((number, len(langs)))
        sums[rows["piece"].to_numpy(), np.searchsorted(langs, rows["lang"].to_numpy()) if langs else []] = rows["n"].to_numpy()
        table = (sums + SMOOTH) / (sums.sum(axis=0) + SMOOTH * number)
        if not langs:
            break
    return langs, table


def predict(df: DataFrame, langs: list[str], table: np.ndarray, vocabulary: str) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    The score is the language's share of the total probability under equal
    priors; equal scores go to the first name. A text that is null, or has no
    letter, and every text of an untrained model is ``und`` with score 0.
    """
    stacked = np.vstack([table, np.full((1, table.shape[1]), FLOOR)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(vocabulary)
        for batch in slices(batches, "text", owner="langid"):
            texts = batch.column(1).fill_null("")
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
            best, share = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if langs:
                words = Words(pc.utf8_lower(texts))
                each = log_scores(words.unique.to_pylist(), pieces, stacked)
                total = np.stack([words.total(each[:, i]) for i in range(len(langs))], axis=1)
                top = total.argmax(axis=1)
                parts = np.exp(total - total.max(axis=1, keepdims=True))
                best[letters] = np.array(langs, object)[top[letters]]
                share[letters] = (1 / parts.sum(axis=1))[letters]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.tolist(), pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    return documents(df).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def piece_vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def identify(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the rows that are not held out.

    A row is held out when crc32 of its doc_id as text leaves 1 modulo 3; a
    null doc_id is neither learned from nor held out.
    """
    vocabulary = vocabulary or piece_vocabulary()
    fold = F.crc32(F.encode(F.col("doc_id").cast("bigint").cast("string"), "UTF-8")) % 3
    langs, table = train(df.filter(fold != 1), vocabulary)
    out = predict(df, langs, table, vocabulary)
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
