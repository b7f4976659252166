"""Near-duplicate documents: MinHash buckets, verified pairs, groups, removal.

Nothing here lists all pairs of a bucket. A bucket is compared with one main
document at a time, so a bucket of n copies gives n - 1 candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import minhash
from ..functions.text import jaccard, shingles
from ..session import spread, spread_pairs, stage


def exact_copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(main, other) for equal texts; main is the smallest key."""
    hashed = df.select(key, F.sha2(text, 256).alias("_h"))
    mains = hashed.groupBy("_h").agg(F.min(key).alias("main"), F.count("*").alias("_n")).filter("_n > 1")
    return hashed.join(mains, "_h").filter(F.col(key) != F.col("main")).select("main", F.col(key).alias("other"))


def bucket_members(df: DataFrame, key: str, text: str, num_perm: int = 100, bands: int = 10, ngram: int = 5) -> DataFrame:
    """(band, bucket, key) of buckets that hold at least two documents."""
    # texts without shingles are dropped before signing: a filter on the signature would sign twice
    signed = df.select(key, text).filter(F.length(text) > ngram).select(key, minhash.signature(F.col(text), num_perm, ngram).alias("_sig"))
    members = stage(signed.select(key, F.posexplode(minhash.band_buckets(F.col("_sig"), bands)).alias("band", "bucket")), "buckets")
    shared = members.groupBy("band", "bucket").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return members.join(shared, ["band", "bucket"])


def _with_main(members: DataFrame, key: str) -> DataFrame:
    mains = members.groupBy("band", "bucket").agg(F.min(key).alias("main"))
    return members.join(mains, ["band", "bucket"]).filter(F.col(key) != F.col("main"))


def minhash_lsh_candidates(df: DataFrame, key: str, text: str, num_perm: int = 100, bands: int = 10, ngram: int = 5) -> DataFrame:
    """Distinct (main, other) candidates: each bucket member beside the bucket's smallest key."""
    return _with_main(bucket_members(spread(df.select(key, text), key), key, text, num_perm, bands, ngram), key).select("main", F.col(key).alias("other")).distinct()


def verify_pairs(pairs: DataFrame, df: DataFrame, key: str, text: str, metric: str = "union", ngram: int = 5) -> DataFrame:
    """Shingle overlap of each pair.

    Pairs are staged first: their size is then known, and a short list is sent
    to the texts instead of moving the corpus.
    """
    pairs = stage(pairs, "pairs")
    texts = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    both = (
        pairs.join(texts.withColumnsRenamed({"_k": "main", "_t": "_a"}), "main")
        .join(texts.withColumnsRenamed({"_k": "other", "_t": "_b"}), "other")
    )
    sets = spread_pairs(both, "main", "other").select("main", "other", shingles(F.col("_a"), ngram).alias("_a"), shingles(F.col("_b"), ngram).alias("_b"))
    # staged, since a filter on sim would be pushed down and build the sets again
    return stage(sets.select("main", "other", jaccard(F.col("_a"), F.col("_b"), metric).alias("sim")), "sims")


def near_duplicate_pairs(df: DataFrame, key: str, text: str, metric: str = "union", threshold: float = 0.5,
                         heuristic_iter: int = 1, num_perm: int = 100, bands: int = 10, ngram: int = 5) -> DataFrame:
    """(main, other, sim) with sim above the threshold.

    Every round takes the smallest key left in each bucket as main, compares it
    with the rest of the bucket, and drops main and its hits from the bucket.
    ``heuristic_iter`` rounds are made; -1 goes on until the buckets are empty.
    Equal texts are paired by digest first and enter the buckets once.
    """
    source = spread(df.select(key, text), key)
    copies = stage(exact_copies(source.filter(F.length(text) > ngram), key, text), "copies")
    single = source.join(copies.select(F.col("other").alias(key)), key, "left_anti")
    members = bucket_members(single, key, text, num_perm, bands, ngram)
    if heuristic_iter == 1:
        candidates = _with_main(members, key).select("main", F.col(key).alias("other")).distinct()
        found = [verify_pairs(candidates, source, key, text, metric, ngram).filter(F.col("sim") > threshold)]
    else:
        members, found, step = stage(members, "members"), [], 0
        while step != heuristic_iter and not members.isEmpty():
            faced = stage(_with_main(members, key), "faced")
            pairs = faced.select("main", F.col(key).alias("other")).distinct()
            hits = verify_pairs(pairs, source, key, text, metric, ngram).filter(F.col("sim") > threshold)
            found.append(hits)
            left = faced.join(hits.select("main", F.col("other").alias(key)), ["main", key], "left_anti").drop("main")
            # a bucket with one member left has nothing to compare
            shared = left.groupBy("band", "bucket").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
            members = stage(left.join(shared, ["band", "bucket"]), "members")
            step += 1
    same = copies.select("main", "other", F.lit(1.0).alias("sim"))
    return reduce(DataFrame.unionByName, found + [same]).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_groups(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): transitive groups named by their smallest member.

    Alternates two star rounds until the edges stop changing. Each round is a
    combined minimum per node and a join back, so a node with a third of all
    edges is a skewed join key but never one task's list. Edges are staged
    every round; only a count and a checksum come to the driver.
    """
    ends = pairs.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u <> v").distinct()
    edges = stage(ends, "edges")
    before = _state(edges)
    while True:
        # large star: larger neighbours of every node move to the smallest of its neighbourhood
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours of every node move to the smallest of them
        large = stage(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = stage(moved.filter("u <> v").distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def group_duplicates(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(node, root) over pairs at least ``threshold`` alike."""
    return connected_groups(pairs.filter(F.col("sim") >= threshold), "main", "other")


def remove_group_duplicates(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Keep the smallest key of each group."""
    extra = groups.filter("node <> root").select(F.col("node").alias(key))
    return df.join(extra, key, "left_anti")
