"""Token-id files with a minimal perfect hash index.

A dataset is a folder of shards in ascending doc_id order. ``NNNNN.ids`` holds
the raw ids of its documents one after another (little-endian, 2 bytes each
where the vocabulary allows, else 4). ``NNNNN.idx`` holds a minimal perfect
hash of the shard's keys (cascaded bit arrays, ranked) and, by hash value, a
32-bit fingerprint, the first record of the key and its number of records;
then the record bounds in ids. Keys are not stored: a lookup hashes the key,
checks the fingerprint and reads one slice, whatever the size of the shard. A
manifest table has one row per shard: key bounds, records, ids, base.

Shards are cut by range of (doc_id, text hash), so a doc_id with a third of
all rows spreads over several shards and a lookup returns its records from
each. Every file is written under an attempt's own name and then renamed, so
a task that is run again leaves the same files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import fresh_path
from .common import U64, documents, mix, slices, text_key
from .tokens import crc, encoder, vocabulary_path

GAMMA = 2.0
MAGIC = np.array([0x57494458, 1], "<i8")  # "WIDX", version 1
_NULL_KEY = -(1 << 63) + 1


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# ---- minimal perfect hash -------------------------------------------------------------------------------------------


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level sizes and packed bits of a minimal perfect hash over distinct unsigned keys."""
    sizes, bits, left, level = [], [], keys.astype(U64), 0
    while len(left):
        size = max(64, int(GAMMA * len(left)) // 64 * 64 + 64)
        at = (mix(left, level + 1) % U64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little"))
        left = left[~alone[at]]
        level += 1
    return np.array(sizes, "<i8"), np.concatenate(bits) if bits else np.zeros(0, np.uint8)


class Hash:
    """Evaluates a minimal perfect hash; keys outside the set give -1 or any value."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes = sizes
        self.bits = np.unpackbits(bits, bitorder="little").view(bool)
        self.rank = np.concatenate([[0], np.cumsum(self.bits)])
        self.base = np.cumsum(sizes) - sizes

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, base) in enumerate(zip(self.sizes.tolist(), self.base.tolist())):
            at = base + (mix(keys[left], level + 1) % U64(size)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 99) >> U64(32)).astype("<u4")


# ---- writing --------------------------------------------------------------------------------------------------------

MANIFEST = "shard int, low bigint, high bigint, records bigint, ids bigint"


def _save(folder: str, name: str, chunks) -> None:
    where, root = _files(folder)
    where.create_dir(root, recursive=True)
    own = f"{root}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(np.ascontiguousarray(chunk).tobytes())
    where.move(own, f"{root}/{name}")


def _writer(folder: str, vocabulary: str, width: int):
    kind = f"<u{width}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, keys, counts = TaskContext.get().partitionId(), [], []
        where, root = _files(folder)
        own = f"{root}/.{shard:05d}.{uuid.uuid4().hex}"
        out = None
        for batch in slices(batches, "text", owner="tokens"):
            if out is None:
                where.create_dir(root, recursive=True)
                out = where.open_output_stream(own)
            ids, bounds = encoder(vocabulary).encode(batch.column(1))
            out.write(ids.astype(kind).tobytes())
            counts.append(np.diff(bounds))
            keys.append(batch.column(0).fill_null(_NULL_KEY).to_numpy(zero_copy_only=False).astype(np.int64))
        if out is None:
            return
        out.close()
        where.move(own, f"{root}/{shard:05d}.ids")
        key, bounds = np.concatenate(keys), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype("<i8")
        # rows come sorted by key: a key's records are neighbours
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.concatenate([first, [len(key)]])).astype("<i8")
        distinct = key[first].view(U64)
        sizes, bits = build_hash(distinct)
        order = np.argsort(Hash(sizes, bits)(distinct))
        head = np.array([len(sizes), len(bits), len(first), len(key), width], "<i8")
        _save(folder, f"{shard:05d}.idx", [MAGIC, head, sizes, bits, fingerprints(distinct)[order], first[order].astype("<i8"), many[order], bounds])
        row = [[shard], [int(key[0])], [int(key[-1])], [len(key)], [int(bounds[-1])]]
        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *[pa.array(v, pa.int64()) for v in row[1:]]], ["shard", "low", "high", "records", "ids"])

    return write


def write_ids(df: DataFrame, folder: str, vocabulary: str | None = None) -> None:
    """Encode every document and write the dataset under ``folder``.

    A null text is empty and holds the end id alone; a null doc_id sorts
    first; an empty table writes a manifest without rows. One shuffle moves
    every text once; ids are written where they are made. The number of shards
    follows ``spark.sql.shuffle.partitions``.
    """
    vocabulary = vocabulary or vocabulary_path()
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else 4
    ranged = documents(df).select("doc_id", "text", text_key().alias("_h")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    ranged.select("doc_id", "text").mapInArrow(_writer(f"{folder}/data", vocabulary, width), MANIFEST).write.parquet(f"{folder}/written")
    written = df.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/written")
    # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    written.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")


# ---- reading --------------------------------------------------------------------------------------------------------


class Shard:
    """One shard: its index in memory, its ids read by slices."""

    def __init__(self, folder: str, shard: int):
        where, root = _files(f"{folder}/data")
        with where.open_input_file(f"{root}/{shard:05d}.idx") as f:
            data = f.read()
        levels, packed, keys, records, self.width = np.frombuffer(data, "<i8", 5, 16).tolist()
        at = 56

        def take(kind, n):
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        sizes = take("<i8", levels)
        self.hash = Hash(sizes, take(np.uint8, packed))
        self.prints, self.first, self.many, self.bounds = take("<u4", keys), take("<i8", keys), take("<i8", keys), take("<i8", records + 1)
        self.file = where.open_input_file(f"{root}/{shard:05d}.ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; 0 records where the fingerprint differs."""
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        plain = keys.astype(np.int64).view(U64)
        at = self.hash(plain)
        known = (at >= 0) & (self.prints[np.maximum(at, 0)] == fingerprints(plain))
        return np.where(known, self.first[at], 0), np.where(known, self.many[at], 0)

    def ids(self, record: int) -> np.ndarray:
        start, stop = int(self.bounds[record]), int(self.bounds[record + 1])
        self.file.seek(start * self.width)
        return np.frombuffer(self.file.read((stop - start) * self.width), f"<u{self.width}")


def lookup(spark: SparkSession, folder: str, keys: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every record of each distinct key.

    Keys are sent to the shards whose bounds hold them (the manifest has one
    row per shard) and answered there from the index and the raw slices. Keys
    that the dataset does not hold give no row.
    """
    manifest = spark.read.parquet(f"{folder}/manifest").toPandas().sort_values("shard")
    columns = {c: manifest[c].to_numpy(np.int64) for c in ("shard", "low", "high", "base")}
    wanted = keys.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_KEY)).alias("key")).distinct()

    @F.pandas_udf("array<int>")
    def shards_of(key: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        low = np.searchsorted(columns["high"], k, side="left")
        high = np.searchsorted(columns["low"], k, side="right")
        return pd.Series([columns["shard"][a:max(a, b)].astype(np.int32) for a, b in zip(low, high)])

    routed = wanted.select("key", F.explode(shards_of("key")).alias("shard")).repartitionByRange("shard", "key").sortWithinPartitions("shard", "key")
    kind = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    bases = dict(zip(columns["shard"].tolist(), columns["base"].tolist()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, Shard] | None = None
        for batch in batches:
            key, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for shard in np.unique(at).tolist():
                if opened is None or opened[0] != shard:
                    opened = shard, Shard(folder, shard)
                asked = key[at == shard]
                first, many = opened[1].find(asked)
                for k, f, m in zip(asked.tolist(), first.tolist(), many.tolist()):
                    rows = []
                    for r in range(f, f + m):
                        ids = opened[1].ids(r)
                        rows.append((None if k == _NULL_KEY else k, bases[shard] + int(opened[1].bounds[r]), len(ids), crc(ids), ids.tolist() if with_ids else None))
                        if len(rows) == 4096:
                            yield from _answers(rows, with_ids)
                            rows = []
                    held.extend(rows)
                    if len(held) >= 4096:
                        yield from _answers(held, with_ids)
                        held.clear()
        if held:
            yield from _answers(held, with_ids)
            held.clear()

    held: list = []
    return routed.mapInArrow(read, kind)


def _answers(rows: list, with_ids: bool) -> Iterator[pa.RecordBatch]:
    columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        columns, names = [*columns, pa.array([r[4] for r in rows], pa.list_(pa.int32()))], [*names, "ids"]
    yield pa.RecordBatch.from_arrays(columns, names)


def write_and_read(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write the documents to a new dataset in the shared folder and look every document up in it."""
    folder = fresh_path(spark, "ids")
    write_ids(df, folder)
    return lookup(spark, folder, df)
