"""Registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship
from . import contamination, html, langid, overlap, packing, payload, pii, prefixes, quality, shards, simhash, suffix, twins, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str = "documents", sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return build(spark, spark.read.parquet(f"{folder}/{table}.parquet"), folder)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build
    return register


@query("op1_pii")
def _(spark, documents, folder):
    found = pii.spans(documents)

    def many(kind):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [many(kind) for kind in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


@query("op2_simhash")
def _(spark, documents, folder):
    return simhash.components(documents).drop("_h")


@query("op3_best_fit_packing")
def _(spark, documents, folder):
    return packing.pack(packing.cut_pieces(documents))


@query("op4_token_ids")
def _(spark, documents, folder):
    return payload.write_and_read(spark, documents)


@query("op5_decontamination")
def _(spark, documents, folder):
    found = contamination.leaks(documents, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "kind", "covered", "answered", "cosine", "word")


@query("op6_html_text", "pages")
def _(spark, pages, folder):
    return html.extract(pages).drop("host")


@query("op7_sharding")
def _(spark, documents, folder):
    placed = shards.assign(documents)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_suffix_dedup")
def _(spark, documents, folder):
    return suffix.repeats(documents).drop("removed")


@query("op9_quality_rules")
def _(spark, documents, folder):
    return quality.judge(documents).select("doc_id", *quality.COUNTS, "base_failed", "kept", "perplexity")


@query("op10_language_id")
def _(spark, documents, folder):
    return langid.identify(documents)


@query("op11_prefix_trie", "conversations", twins.PREFIX_TRIE)
def _(spark, conversations, folder):
    return prefixes.prefix_trie(conversations)


@query("op12_spelling_variants", sql=twins.SPELLING_VARIANTS)
def _(spark, documents, folder):
    return variants.variants(documents)


@query("op13_ngram_jaccard", sql=twins.NGRAM_JACCARD)
def _(spark, documents, folder):
    return overlap.components(documents)
