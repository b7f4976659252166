"""Repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte is removed when a ``LENGTH``-byte string that also starts earlier
covers it. Every such string (window) has a smallest ``GRAM``-byte hash, its
anchor; windows that are equal have equal anchors, and neighbours with one
anchor form a run, about one per 39 bytes. Only runs travel:

1. Tasks cut their texts into runs and settle runs that they hold twice
   themselves, so a group of copies sends one row per task and run.
2. Runs meet by anchor. An equal run that starts earlier settles all windows
   of a run; an anchor with a single run is unique; what is left are the
   borders of repeats, runs that share an anchor but not all of their bytes.
3. The bytes of these runs are joined in blocks of whole anchors. A block's
   suffixes are sorted to ``LENGTH`` bytes, and intervals of equal prefixes
   are expanded breadth first by backward extension on the transform, one
   byte per level, dropping intervals of one suffix and stopping at
   ``LENGTH``: what remains are the classes of equal windows, and all but the
   first of a class start earlier elsewhere.
4. Anchors with more than ``CROWD`` open runs (borders of a passage that very
   many documents share) leave step 3 and are settled by grouping their
   windows themselves, byte for byte, which splits over tasks.

The text of a document is moved twice: to cut out open runs, and at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.index import with_row_index
from ..session import stage
from .common import U64, documents, mix, ragged, raw, slices, text_key

LENGTH = 100
GRAM = 24
CROWD = 4096
SEGMENT = 1 << 20  # bytes hashed at a time
HELD = 1 << 21  # runs a task holds before it settles and sends them
BLOCK = 1 << 20  # bytes of open runs in one transform

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if n not in _POWERS:
        _POWERS.clear()
        up, down = np.full(n, _BASE, U64), np.full(n, _INVERSE, U64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[n] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return _POWERS[n]


def _slide(values: np.ndarray, wide: int) -> np.ndarray:
    """Minimum of every ``wide`` neighbours."""
    low, span = values, 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:len(low) - (wide - span)], low[wide - span:]) if span < wide else low


def runs(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor, hash, start, windows, folded of the runs of one segment of a text.

    A run is cut after as many windows as grams in a window. ``folded`` marks
    runs whose anchor occurs more than once in them: they may repeat themselves.
    """
    wide = LENGTH - GRAM + 1
    up, down = _powers(SEGMENT + LENGTH)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * up[:len(data)], dtype=U64)])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[:len(data) - GRAM + 1], 1)
        low = _slide(grams, wide)
        change = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        size = np.diff(np.concatenate([change, [len(low)]]))
        if size.max() > wide:
            parts = -(-size // wide)
            nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            change = np.repeat(change, parts) + nth * wide
            size = np.minimum(np.repeat(size, parts) - nth * wide, wide)
        end = change + size + LENGTH - 1
        whole = mix((sums[end] - sums[change]) * down[change] + end.astype(U64) - change.astype(U64), 2)
    anchor = low[change]
    inside = ragged(change, size + wide - 1)
    hits = grams[inside] == np.repeat(anchor, size + wide - 1)
    folded = np.add.reduceat(hits, np.cumsum(size + wide - 1) - (size + wide - 1)) > 1
    return anchor, whole, change, size, folded


# a row of step 1 and 2: what is known of a run travels in ``meta``
_RUN = "anchor bigint, whole bigint, doc bigint, meta bigint"
_OPEN, _SETTLED = 0, 1


def _pack(pos: np.ndarray, windows: np.ndarray, folded: np.ndarray, settled: np.ndarray) -> np.ndarray:
    return (pos.astype(np.int64) << 12) | (windows.astype(np.int64) << 2) | (folded.astype(np.int64) << 1) | settled.astype(np.int64)


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U64 else c) for c in columns], ["anchor", "whole", "doc", "meta"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (doc, text); equal runs of the task but the first are settled here."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def send() -> Iterator[pa.RecordBatch]:
        anchor, whole, doc, pos, size, folded = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((pos, doc, whole, anchor))
        anchor, whole, doc, pos, size, folded = (c[order] for c in (anchor, whole, doc, pos, size, folded))
        again = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1])])
        meta = _pack(pos, size, folded, again)
        for low in range(0, len(meta), 1 << 17):
            yield _batch(*(c[low:low + (1 << 17)] for c in (anchor, whole, doc, meta)))
        held.clear()

    for batch in slices(batches, "text"):
        flat, bounds = raw(batch.column(1))
        for i, doc in enumerate(batch.column(0).to_pylist()):
            start, stop = int(bounds[i]), int(bounds[i + 1])
            for low in range(start, stop - LENGTH + 1, SEGMENT):
                anchor, whole, pos, size, folded = runs(flat[low:min(low + SEGMENT + LENGTH - 1, stop)])
                held.append((anchor, whole, np.full(len(pos), doc, np.int64), pos + (low - start), size, folded))
                count += len(pos)
            if count >= HELD:
                yield from send()
                count = 0
    if held:
        yield from send()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settled and open runs of rows sorted by (anchor, whole, doc, meta); unique runs are dropped.

    An anchor's rows may span batches: ``last`` is the row before, ``alone`` the
    first run of its anchor while that has no second.
    """
    last = alone = None
    for batch in batches:
        anchor, whole, doc, meta = (c.to_numpy() for c in batch.columns)
        done = (meta & 1) == 1
        if done.any():
            yield _batch(anchor[done], whole[done], doc[done], meta[done])
            anchor, whole, doc, meta = (c[~done] for c in (anchor, whole, doc, meta))
        if not len(anchor):
            continue
        before = (int(anchor[0]), int(whole[0])) if last is None else last
        fresh = np.concatenate([[last is None or anchor[0] != before[0]], anchor[1:] != anchor[:-1]])
        first = fresh | np.concatenate([[whole[0] != before[1]], whole[1:] != whole[:-1]])
        first[0] |= last is None
        group = np.cumsum(fresh)  # 0: the anchor of the batch before goes on
        kinds = np.bincount(group[first], minlength=group[-1] + 1)
        folded = np.bincount(group[first], weights=(meta[first] >> 1) & 1, minlength=group[-1] + 1) > 0
        shared = (kinds > 1) | folded
        if kinds[0]:  # its first run was in an earlier batch, so these are further ones
            shared[0] = True
        if alone is not None and (kinds[0] or group[-1] > 0):
            if kinds[0]:
                yield _batch(*(np.array([v], np.int64) for v in alone))
            alone = None
        end = group[-1]
        if end > 0 and not shared[end]:
            at = int(np.flatnonzero(first & (group == end))[0])
            alone = (int(anchor[at]), int(whole[at]), int(doc[at]), int(meta[at]))
        out = ~first | (first & shared[group])
        meta = np.where(first, meta, meta | _SETTLED)
        if out.any():
            yield _batch(anchor[out], whole[out], doc[out], meta[out])
        last = int(anchor[-1]), int(whole[-1])


def equal_windows(parts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Which places of the joined parts (one separator behind each) start a window that also starts earlier.

    Suffixes are sorted to ``length`` or more symbols by doubling; intervals
    of equal prefixes start from those of a doubling step and are expanded
    backward, symbol by symbol, up to ``length``.
    """
    joined = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    joined[ends] = 0
    n, depth = len(joined), 1
    rank = joined.copy()
    known, known_depth = rank, 1
    while depth < length:
        ahead = np.zeros(n, np.int64)
        ahead[:n - depth] = rank[depth:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = step
        depth *= 2
        if depth <= length:
            known, known_depth = rank, depth
        if step[-1] == n - 1:
            break
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    back = place[order - 1]  # where the suffix one symbol longer stands
    symbol = joined[order - 1]  # the transform
    at, label = np.arange(n), known[order]
    mark = np.full(n, -1, np.int64)
    for level in range(known_depth, length + 1):
        edge = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([edge, [len(at)]]))
        several = np.repeat(size > 1, size)
        name = np.repeat(np.arange(len(size)), size)[several]
        at = at[several]
        if level == length or not len(at):
            break
        inside = symbol[at] > 0
        at, name = at[inside], name[inside]
        mark[back[at]] = name * 257 + symbol[at]
        at = np.flatnonzero(mark >= 0)
        label = mark[at]
        mark[at] = -1
    repeated = np.zeros(n, bool)
    if len(at):
        starts = order[at]
        edge = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        first = np.minimum.reduceat(starts, edge)
        repeated[starts] = starts != np.repeat(first, np.diff(np.concatenate([edge, [len(at)]])))
        # a window that holds a separator is none
        stop = ends[np.searchsorted(ends, np.arange(n))]
        repeated &= np.arange(n) + length <= stop
    return repeated


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, low, high) of repeated windows of open runs, sorted by (anchor, doc, pos), block by block."""
    anchors, docs, starts, parts = [], [], [], []
    size = 0

    def settle(many: int) -> pa.RecordBatch:
        places = np.flatnonzero(equal_windows(parts[:many]))
        at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts[:many]])])
        owner = np.searchsorted(at, places, side="right") - 1
        low = np.array(starts[:many], np.int64)[owner] + places - at[owner]
        doc = np.array(docs[:many], np.int64)[owner]
        # neighbouring windows of a run make one span
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (low[1:] != low[:-1] + 1)]) if len(low) else np.zeros(0, bool)
        last = np.concatenate([new[1:], [True]]) if len(low) else new
        del anchors[:many], docs[:many], starts[:many], parts[:many]
        return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(low[new]), pa.array(low[last] + LENGTH)], ["doc", "low", "high"])

    for batch in batches:
        for anchor, doc, start, part in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= BLOCK and anchor != anchors[-1]:
                yield settle(len(parts))
                size = 0
            anchors.append(anchor)
            docs.append(doc)
            starts.append(start)
            parts.append(part)
            size += len(part) + 1
    if parts:
        yield settle(len(parts))


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc, pos, part) of the open runs listed beside each text."""
    for batch in slices(batches, "text"):
        rows: list[tuple] = []
        for doc, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
            data = (text or "").encode()
            rows.extend((a, doc, m >> 12, data[m >> 12:(m >> 12) + ((m >> 2) & 1023) + LENGTH - 1]) for a, m in ((r["anchor"], r["meta"]) for r in asked))
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())], ["anchor", "doc", "pos", "part"])


def spans(texts: DataFrame) -> DataFrame:
    """doc, low, high: byte ranges to remove of (doc, text) with unique, ordered docs. Ranges may overlap."""
    cut = texts.select("doc", "text").mapInArrow(_cut, _RUN)
    dealt = F.when(F.col("meta").bitwiseAND(F.lit(1)) == 0, F.col("anchor")).otherwise(F.xxhash64("doc", "meta"))
    met = cut.repartition(dealt).sortWithinPartitions("anchor", "whole", "doc", "meta").mapInArrow(_meet, _RUN)
    marks = stage(met, "runs")
    is_open = F.col("meta").bitwiseAND(F.lit(1)) == 0
    low, windows = F.shiftright("meta", 12), F.shiftright("meta", 2).bitwiseAND(F.lit(1023))
    settled = marks.filter(~is_open).select("doc", low.alias("low"), (low + windows + (LENGTH - 1)).alias("high"))
    crowded = marks.filter(is_open).groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("anchor", F.lit(True).alias("crowd"))
    asked = marks.filter(is_open).groupBy("doc").agg(F.collect_list(F.struct("anchor", "meta")).alias("asked"))
    parts = texts.select("doc", "text").join(asked, "doc").select("doc", "text", "asked").mapInArrow(_take, "anchor bigint, doc bigint, pos bigint, part binary")
    parts = stage(parts, "parts").join(stage(crowded, "crowds"), "anchor", "left")
    blocks = parts.filter(F.col("crowd").isNull()).select("anchor", "doc", "pos", "part").repartition("anchor").sortWithinPartitions("anchor", "doc", "pos")
    expanded = blocks.mapInArrow(_expand, "doc bigint, low bigint, high bigint")
    each = parts.filter("crowd").select("doc", "pos", "part", F.explode(F.sequence(F.lit(0), F.octet_length("part") - LENGTH)).alias("i"))
    windowed = each.select("doc", (F.col("pos") + F.col("i")).alias("low"), F.expr(f"substring(part, i + 1, {LENGTH})").alias("window"))
    firsts = windowed.groupBy("window").agg(F.min(F.struct("doc", "low")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windowed.join(firsts, "window").filter((F.col("doc") != F.col("first.doc")) | (F.col("low") != F.col("first.low")))
    return settled.unionAll(expanded).unionAll(later.select("doc", "low", (F.col("low") + LENGTH).alias("high")))


def _merged(asked: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in asked or ()):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _kept(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for low, high in removed:
        out.append(data[at:low])
        at = high
    return b"".join([*out, data[at:]])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for doc_id, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
            data, removed = (text or "").encode(), _merged(asked)
            kept = _kept(data, removed)
            rows.append((doc_id, len(data), len(data) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), [{"low": a, "high": b} for a, b in removed]))
        c = list(zip(*rows))
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in c[:4]], pa.array(c[4]), pa.array(c[5], kind)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def _ranked(source: DataFrame) -> DataFrame:
    """doc (its place under doc_id, text hash), doc_id, text, for tables whose doc_ids repeat or miss.

    Rows equal in doc_id and text are one document.
    """
    one = source.withColumn("_h", text_key()).dropDuplicates(["doc_id", "_h"])
    numbers = with_row_index(one.select("doc_id", "_h"), ["doc_id", "_h"], "doc").withColumnsRenamed({"doc_id": "d", "_h": "h"})
    return one.join(numbers, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_h") == F.col("h"))).select("doc", "doc_id", "_h", "text")


def repeats(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte ranges) of every row.

    Documents are ordered by doc_id (null first, then by text hash). Null and
    empty texts, and those under ``LENGTH`` bytes, keep all. Rows equal in
    doc_id and text are one document, returned as often as it comes. An empty
    table gives no rows.
    """
    source = documents(df)
    plain = source.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty()
    texts = source.withColumn("doc", F.col("doc_id")) if plain else _ranked(source)
    found = stage(spans(texts), "removed")
    asked = found.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("asked"))
    kind = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<low:bigint,high:bigint>>"
    told = texts.join(asked, "doc", "left").select("doc_id", "text", "asked").mapInArrow(_told, kind)
    if plain:
        return told
    # one row per document so far: repeat it for its equal rows
    many = source.withColumn("_h", text_key()).groupBy("doc_id", "_h").agg(F.count("*").alias("n")).withColumnsRenamed({"doc_id": "d", "_h": "h"})
    keyed = texts.join(asked, "doc", "left").join(many, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_h") == F.col("h")))
    return keyed.select("doc_id", "text", "asked", F.explode(F.expr("array_repeat(1, int(n))"))).select("doc_id", "text", "asked").mapInArrow(_told, kind)


def remove(df: DataFrame) -> DataFrame:
    """doc_id and the text that stays of every row; a character that lost some of its bytes goes as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept = [None if t is None else _kept(t.encode(), [(r["low"], r["high"]) for r in gone or ()]).decode(errors="ignore") for t, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["doc_id", "text"])

    source = documents(df).withColumn("_h", F.sha2(F.coalesce("text", F.lit("")), 256))
    gone = repeats(df).filter("n_removed > 0").dropDuplicates(["doc_id", "kept_sha256", "n_bytes"]).select(F.col("doc_id").alias("d"), "n_bytes", "removed")
    joined = source.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.octet_length(F.coalesce("text", F.lit(""))) == F.col("n_bytes")), "left")
    return joined.select("doc_id", "text", "removed").mapInArrow(run, "doc_id bigint, text string")
