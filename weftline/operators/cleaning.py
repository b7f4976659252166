"""Corpus cleaning rules with counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx

TASKS = ("remove_512", "remove_256_javascript", "remove_512_non_english", "ftfy_fix_text", "general_cleaning")


def cleanup_rules(df: DataFrame, text: str, tasks: tuple[str, ...] = TASKS, english: Column | None = None) -> DataFrame:
    """First enabled rule that fires: ``rule``, ``new_text`` and ``removed``.

    Rewriting rules always fire, so cleaning never follows repair.
    """
    t = F.col(text)
    english = tx.is_english(t) if english is None else english
    fires = {
        "remove_512": F.length(t) < 512,
        "remove_256_javascript": (F.length(t) < 256) & F.lower(t).contains("javascript"),
        "remove_512_non_english": (F.length(t) < 512) & ~english,
        "ftfy_fix_text": F.lit(True),
        "general_cleaning": F.lit(True),
    }
    rule = F.lit(None).cast("string")
    for name in reversed([x for x in TASKS if x in tasks]):
        rule = F.when(fires[name], name).otherwise(rule)
    return df.withColumn("rule", rule).withColumn(
        "new_text", F.when(F.col("rule") == "ftfy_fix_text", tx.fix_text(t))
        .when(F.col("rule") == "general_cleaning", tx.general_clean(t)).otherwise(t)
    ).withColumn("removed", F.coalesce(F.col("rule").startswith("remove"), F.lit(False)))


def clean_corpus(df: DataFrame, text: str, min_tokens: int = 128, english: Column | None = None) -> DataFrame:
    """Repaired text with ``fixed`` and ``status``: non_english, small or keep.

    A document is small when it has under 8 characters per wanted token and
    too few tokens as well.
    """
    fixed = df.withColumn("_old", F.col(text)).withColumn(text, tx.fix_text(F.col(text)))
    english = tx.is_english(F.col(text)) if english is None else english
    small = (F.length(text) < 8 * min_tokens) & (F.size(tx.blank_tokens(F.col(text))) < min_tokens)
    return fixed.withColumn("fixed", F.col("_old") != F.col(text)).withColumn(
        "status", F.when(~english, "non_english").when(small, "small").otherwise("keep")).drop("_old")


def corpus_counters(df: DataFrame, text: str) -> DataFrame:
    """Documents and characters: all, kept, fixed, non-English, small."""
    def both(name, cond):
        return [F.count_if(cond).alias(f"{name}_docs"), F.sum(F.when(cond, F.length(text)).otherwise(0)).alias(f"{name}_chars")]
    return df.agg(
        *both("all", F.lit(True)), *both("kept", F.col("status") == "keep"), *both("fixed", F.col("fixed")),
        *both("non_english", F.col("status") == "non_english"), *both("small", F.col("status") == "small"))
