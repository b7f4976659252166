"""SimHash near-duplicates by a generalised pigeonhole.

Fingerprints at most ``distance`` bits apart agree, in at least one of m bit
partitions, up to that partition's own threshold, for any thresholds (-1 and
up) that sum to ``distance - m + 1``. Correlated bits share a partition; each
fingerprint takes the thresholds that a dynamic programme finds cheapest on
the bucket counts of its own values, probes the partitions with them, and the
hits are verified. Fingerprints whose probes would still meet too many others
(groups of near copies that agree everywhere) are compared by the one-
partition split of the distance into two halves instead: two such
fingerprints are within 2 bits exactly when their 1-bit balls share a point,
and a point has at most 65 fingerprints around it. So no bucket is ever
listed pair by pair, and no link is lost.

Equal fingerprints are one node throughout; documents join their component by
fingerprint at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.dedup import connected_groups
from ..session import stage
from .common import U64, documents, slices, text_key, without

BITS = 64
PARTS = 3
CANDIDATES = 130  # a probe plan dearer than this gives way to the ball (65 rows of a fingerprint, on two sides)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:len(found) - k + 1].tolist(), ends[k - 1:].tolist())], U64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(U64)[0])


def fingerprints(df: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, _h (text hash) and fp (the fingerprint's bits as a signed bigint) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "_h", "fp"])

    return documents(df).withColumn("_h", text_key()).mapInArrow(run, "doc_id bigint, _h bigint, fp bigint")


def correlations(nodes: DataFrame) -> np.ndarray:
    """Absolute correlation of every two fingerprint bits over all distinct fingerprints."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        if n:
            i, j = np.divmod(np.arange(BITS * BITS), BITS)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both.ravel()), pa.array(np.full(BITS * BITS, float(n)))], ["i", "j", "both", "n"])

    rows = nodes.select("fp").mapInArrow(count, "i int, j int, both double, n double").groupBy("i", "j").agg(F.sum("both"), F.sum("n")).collect()
    both, n = np.zeros((BITS, BITS)), 1.0
    for i, j, b, total in rows:
        both[i, j], n = b, total
    p = np.diag(both) / n
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    return np.where(spread > 0, np.abs(both / n - np.outer(p, p)) / np.where(spread > 0, spread, 1), 0.0)


def partition_bits(related: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Bits grouped by correlation into parts of nearly equal size, each grown from its most related bit on."""
    free, groups = set(range(len(related))), []
    for g in range(parts):
        size = -(-len(free) // (parts - g))
        inside = sorted(free)
        seed = max(inside, key=lambda b: (related[b, inside].sum() - related[b, b], -b))
        group = [seed]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (related[b, group].sum(), -b)))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def allocate(counts: np.ndarray, widths: list[int], means: list[float], distance: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (rows x parts) with sum ``distance - parts + 1`` of least estimated cost, and that cost.

    counts[r, i] is the bucket of row r's value in part i; a radius-1 probe is
    taken to meet that bucket, a mean bucket per flipped bit, and to cost a row each.
    """
    rows, parts = counts.shape
    goal = distance - parts + 1

    def price(i: int, t: int) -> np.ndarray:
        if t < 0:
            return np.zeros(rows)
        near = sum([1, widths[i], widths[i] * (widths[i] - 1) / 2][:t + 1]) - 1
        return counts[:, i] + near * (1.0 + means[i])

    # state: parts done, sum of thresholds so far
    table: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.zeros(rows), np.zeros((rows, 0), np.int8))}
    for i in range(parts):
        grown: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for total, (cost, path) in table.items():
            for t in range(-1, 3):
                sum_, c = total + t, cost + price(i, t)
                p = np.concatenate([path, np.full((rows, 1), t, np.int8)], axis=1)
                if sum_ in grown:
                    better = c < grown[sum_][0]
                    grown[sum_] = np.where(better, c, grown[sum_][0]), np.where(better[:, None], p, grown[sum_][1])
                else:
                    grown[sum_] = c, p
        table = grown
    return table[goal][1], table[goal][0]


def _value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), U64)
    for place, bit in enumerate(bits):
        out |= ((fp >> U64(bit)) & U64(1)) << U64(place)
    return out.view(np.int64)


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (left, right) between distinct fingerprints that connect exactly those reachable by steps of ``distance`` bits."""
    if distance != 2:
        raise ValueError("the ball form of the exact rest is stated for 2 bits")
    nodes = stage(nodes.select("fp"), "fps")
    groups = partition_bits(correlations(nodes))
    widths = [len(g) for g in groups]

    @F.pandas_udf("array<bigint>")
    def values(fp: pd.Series) -> pd.Series:
        x = fp.to_numpy(np.int64).view(U64)
        return pd.Series(list(np.stack([_value(x, g) for g in groups], axis=1)))

    index = stage(nodes.select("fp", F.posexplode(values("fp")).alias("part", "value")), "parts")
    buckets = stage(index.groupBy("part", "value").agg(F.count("*").alias("n")), "buckets")
    means = dict(buckets.groupBy("part").agg(F.avg("n")).collect())
    sized = index.join(buckets, ["part", "value"]).groupBy("fp").agg(*[F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(PARTS)])

    @F.pandas_udf("array<struct<part:int,value:bigint>>")
    def probes(fp: pd.Series, n0: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        x = fp.to_numpy(np.int64).view(U64)
        plan, cost = allocate(np.stack([n0, n1, n2], axis=1).astype(float), widths, [means.get(i, 0.0) for i in range(PARTS)], distance)
        own = [_value(x, g) for g in groups]
        flips = [_flips(w) for w in widths]
        out = []
        for r in range(len(x)):
            if cost[r] > CANDIDATES:
                out.append([])
                continue
            out.append([{"part": i, "value": v} for i in range(PARTS) if plan[r, i] >= 0 for v in (own[i][r] ^ flips[i][plan[r, i]]).tolist()])
        return pd.Series(out)

    asked = stage(sized.select("fp", F.explode_outer(probes("fp", *[f"n{i}" for i in range(PARTS)])).alias("p")).select("fp", "p.part", "p.value"), "probes")
    met = asked.join(buckets, ["part", "value"], "left").groupBy("fp").agg(F.sum("n").alias("n"))
    heavy = stage(met.filter(F.col("n").isNull() | (F.col("n") > CANDIDATES)).select("fp"), "heavy")
    light = asked.filter(F.col("part").isNotNull()).join(heavy, "fp", "left_anti")
    hits = light.join(index.withColumnRenamed("fp", "other"), ["part", "value"])
    near = hits.filter((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance)).select(F.least("fp", "other").alias("left"), F.greatest("fp", "other").alias("right"))
    # a ball's point has at most 65 distinct fingerprints around it
    ball = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b)))
    points = heavy.select("fp", F.explode(ball).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    around = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = around.select(F.array_min("fps").alias("left"), F.explode("fps").alias("right")).filter("left <> right")
    return near.unionAll(stars).distinct()


def _flips(width: int) -> list[np.ndarray]:
    """XOR masks within 0, 1 and 2 bits of a part."""
    ones = [1 << b for b in range(width)]
    twos = [a | b for i, a in enumerate(ones) for b in ones[:i]]
    return [np.array(m, np.int64) for m in ([0], [0, *ones], [0, *ones, *twos])]


def components(df: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, _h (text hash), fingerprint (16 lowercase hex digits), component_id of every row.

    component_id is the smallest doc_id reachable over links, itself included;
    null doc_ids have rows but are never the smallest. Texts without words
    share fingerprint zero. Repeated rows are returned as often as they come.
    An empty table gives no rows.
    """
    marked = stage(fingerprints(df, words), "fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    groups = connected_groups(links(nodes, distance), "left", "right")
    rooted = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "_h", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep(df: DataFrame) -> DataFrame:
    """One row of each component, that of its smallest doc_id, all columns as they are.

    Of rows that repeat that doc_id one stays. Rows without a doc_id stay only
    where a whole component has none.
    """
    found = stage(components(df), "components")
    kept = without(df, found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))))
    again = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    if again.isEmpty():
        return kept
    key = F.col("doc_id").cast("bigint")
    once = kept.join(again.withColumnRenamed("doc_id", "_again"), key == F.col("_again"), "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again.withColumnRenamed("doc_id", "_again"), key == F.col("_again"), "left_anti").unionByName(once)
