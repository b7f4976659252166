"""Modified Kneser-Ney model over character 4-grams of words, counted by Spark, stored in sorted hash arrays.

A word is read between three start marks and an end mark, so every character
has three before it and no 4-gram leaves its word. Highest-order counts are
occurrences over all documents; lower orders count distinct predecessors.
Discounts come from the counts of counts of each order, and all probabilities
are joins and aggregates of small tables of distinct grams. The result is two
kinds of rows per order, gram -> log p and context -> log backoff weight, each
keyed by a 64-bit hash and sorted, which scoring tasks search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import fresh_path, stage
from .common import U64, hold, mix, slices
from .words import Words

ORDER = 4
HELD_GRAMS = 500_000  # distinct grams a task sums up before it hands them on
SLICE = 1 << 20  # bytes of text whose words are spelled out at once
START, STOP = "\x02", "\x03"
_FACTORS = mix(np.arange(1, ORDER + 1), 5) | U64(1)
HELD = 256 << 20  # bytes of model that a worker keeps in memory; a larger model is searched file by file


def _spelled(words: list[str]) -> np.ndarray:
    pad = START * (ORDER - 1)
    joined = (STOP + pad).join(words)
    if joined.count(START) != (ORDER - 1) * max(0, len(words) - 1) or joined.count(STOP) != max(0, len(words) - 1):
        joined = (STOP + pad).join([w.replace(START, "?").replace(STOP, "?") for w in words])
    return np.frombuffer((pad + joined + STOP).encode("utf-32-le"), np.uint32)


def _ends(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the characters and end marks, and the number of the word of each."""
    ends = np.flatnonzero(points != ord(START))
    stops = points[ends] == ord(STOP)
    return ends, np.cumsum(stops) - stops


def _hash(points: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` characters up to each position."""
    total = np.zeros(len(ends), U64)
    with np.errstate(over="ignore"):
        for back in range(size):
            total += points[ends - back].astype(U64) * _FACTORS[back]
    return mix(total, 11 + size)


def _string_hash(grams: list[str], size: int) -> np.ndarray:
    points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
    return _hash(points, np.arange(len(grams)) * size + size - 1, size) if size else np.zeros(len(grams), U64)


def _told(grams: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(grams), 100_000):
        part = grams[low:low + 100_000].astype("<u4").tobytes().decode("utf-32-le")
        yield pa.RecordBatch.from_arrays([pa.array([part[i:i + ORDER] for i in range(0, len(part), ORDER)]), pa.array(sums[low:low + 100_000].astype(np.int64))], ["g", "c"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g and c of the words of the batches; a gram of a text takes some 60 bytes at once, so slices are short."""
    keys, grams, sums = np.zeros(0, U64), np.zeros((0, ORDER), np.uint32), np.zeros(0)
    for batch in slices(batches, "text", SLICE):
        words = Words(batch.column(0))
        if not len(words.codes):
            continue
        often = np.bincount(words.codes, minlength=len(words.unique))
        seen = np.flatnonzero(often)
        points = _spelled(words.unique.take(pa.array(seen)).to_pylist())
        ends, owner = _ends(points)
        key = np.concatenate([keys, _hash(points, ends, ORDER)])
        weight = np.concatenate([sums, often[seen][owner].astype(float)])
        windows = np.concatenate([grams, np.stack([points[ends - b] for b in range(ORDER - 1, -1, -1)], axis=1)])
        keys, first, at = np.unique(key, return_index=True, return_inverse=True)
        grams, sums = windows[first], np.bincount(at, weights=weight)
        if len(keys) > HELD_GRAMS:
            yield from _told(grams, sums)
            keys, grams, sums = keys[:0], grams[:0], sums[:0]
    yield from _told(grams, sums)


def gram_counts(texts: DataFrame) -> DataFrame:
    """g (4 characters) and c over all words of the single column ``text``; summed per task before the shuffle."""
    return texts.select("text").mapInArrow(_counted, "g string, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


def _discounts(order: DataFrame) -> list[float]:
    t = [float(v or 0) for v in order.agg(*[F.sum((F.col("c") == k).cast("bigint")) for k in range(1, 5)]).first()]
    if min(t[:3]) <= 0:  # too few grams for the estimate
        return [0.5, 1.0, 1.5]
    y = t[0] / (t[0] + 2 * t[1])
    return [min(max(k + 1 - (k + 2) * y * t[k + 1] / t[k], 0.0), k + 1.0) for k in range(3)]


def _by_count(values: list[float]) -> Column:
    return F.when(F.col("c") == 1, values[0]).when(F.col("c") == 2, values[1]).otherwise(values[2])


def build(texts: DataFrame) -> str:
    """Count the model over all texts and write it; returns its folder."""
    spark = texts.sparkSession
    orders = {ORDER: stage(gram_counts(texts), "grams")}
    for k in range(ORDER - 1, 0, -1):
        # distinct predecessors of the shorter gram
        orders[k] = stage(orders[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("c")), "grams")
    alphabet = orders[1].count() + 1
    lower = None
    rows = []
    for k in range(1, ORDER + 1):
        cut = _discounts(orders[k])
        grams = orders[k].withColumn("ctx", F.substring("g", 1, k - 1))
        contexts = grams.groupBy("ctx").agg(F.sum("c").alias("tot"), F.sum(_by_count(cut)).alias("off")).select("ctx", "tot", (F.col("off") / F.col("tot")).alias("gamma"))
        joined = grams.join(contexts, "ctx")
        below = joined.withColumn("low", F.lit(1.0 / alphabet)) if lower is None else joined.join(lower, F.substring("g", 2, k - 1) == F.col("lg")).drop("lg")
        p = F.greatest(F.col("c") - _by_count(cut), F.lit(0.0)) / F.col("tot") + F.col("gamma") * F.col("low")
        scored = stage(below.select("g", p.alias("p")), "order")
        rows.append(scored.select(F.lit(k).alias("kind"), "g", F.log("p").alias("v")))
        rows.append(contexts.select(F.lit(-k).alias("kind"), F.col("ctx").alias("g"), F.log(F.greatest("gamma", F.lit(1e-12))).alias("v")))
        lower = scored.select(F.col("g").alias("lg"), F.col("p").alias("low"))
    table = rows[0]
    for other in rows[1:]:
        table = table.unionAll(other)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, grams = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            out = np.zeros(len(grams), U64)
            for k in np.unique(kind).tolist():
                at = np.flatnonzero(kind == k)
                size = k if k > 0 else -k - 1
                out[at] = _string_hash([grams[i] for i in at.tolist()], size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), batch.column(2)], ["kind", "h", "v"])

    folder = fresh_path(spark, "kneser-ney")
    unseen = spark.createDataFrame([(0, 0, float(-np.log(alphabet)))], "kind int, h bigint, v double")
    sorted_rows = table.mapInArrow(hashed, "kind int, h bigint, v double").unionAll(unseen).repartitionByRange("kind", "h").sortWithinPartitions("kind", "h")
    sorted_rows.write.parquet(folder)
    return folder


class Model:
    """Sorted hash arrays of a model folder, searched by tasks."""

    _known: dict[str, "Model"] = {}

    def __init__(self, folder: str):
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.where, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.files = sorted(f.path for f in self.where.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-"))
        self.read = lambda path: pq.read_table(self.where.open_input_file(path))
        self.whole = self._tables(self.files) if sum(self.where.get_file_info(f).size for f in self.files) * 2 <= HELD else None
        self.unseen = float(self.find(0, np.zeros(1, U64), 0.0)[0][0])

    @classmethod
    def of(cls, folder: str) -> "Model":
        if folder not in cls._known:
            cls._known.clear()
            cls._known[folder] = cls(folder)
            hold("perplexity", cls._known.clear)
        return cls._known[folder]

    def _tables(self, files: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        table = pa.concat_tables([self.read(f) for f in files]) if files else None
        kind, h, v = (table.column(c).to_numpy() for c in ("kind", "h", "v"))
        return {int(k): (h[kind == k], v[kind == k]) for k in np.unique(kind)}

    def find(self, kind: int, hashes: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
        """Value of each hash, ``default`` where it is not in the model, and whether it is."""
        asked = hashes.view(np.int64)
        value, known = np.full(len(asked), default), np.zeros(len(asked), bool)
        for tables in [self.whole] if self.whole is not None else (self._tables([f]) for f in self.files):
            if kind not in tables:
                continue
            h, v = tables[kind]
            at = np.minimum(np.searchsorted(h, asked), len(h) - 1)
            hit = h[at] == asked
            value[hit], known[hit] = v[at[hit]], True
        return value, known

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word with its end mark, and its number of characters with that mark."""
        points = _spelled(words)
        ends, owner = _ends(points)
        keys = _hash(points, ends, ORDER)
        # a gram of four characters fixes the answer: score each once
        keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
        place = ends[first]
        logp, left, weight = np.zeros(len(place)), np.arange(len(place)), np.zeros(len(place))
        for k in range(ORDER, 0, -1):
            value, known = self.find(k, _hash(points, place[left], k), 0.0)
            logp[left[known]] = value[known] + weight[left[known]]
            left = left[~known]
            if not len(left):
                break
            context = _hash(points, place[left] - 1, k - 1) if k > 1 else np.zeros(len(left), U64)
            weight[left] += self.find(-k, context, 0.0)[0]
        logp[left] = self.unseen + weight[left]
        return np.bincount(owner, weights=logp[at], minlength=len(words)), np.bincount(owner, minlength=len(words))
