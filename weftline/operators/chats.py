"""Chat rendering, prompt filters and dialog rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..functions.hashing import digest
from .index import with_group_index


def render_chat(messages: Column, mode: str = "chat", template: str = "{prompt}") -> Column:
    """``template``: the last message in a template; ``chat``: all turns and an open reply; ``raw``: first content."""
    if mode == "raw":
        return F.element_at(messages, 1)["content"]
    if mode == "template":
        return F.replace(F.lit(template), F.lit("{prompt}"), F.element_at(messages, -1)["content"])
    turns = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n")))
    return F.concat(F.array_join(turns, ""), F.lit("<|assistant|>\n"))


def filter_by_prompt_length(df: DataFrame, variants: list[str], max_len: int) -> DataFrame:
    """Keep rows whose every present variant renders to at most ``max_len`` tokens."""
    fits = [F.size(tx.blank_tokens(render_chat(F.col(v)))) <= max_len for v in variants if v in df.columns]
    return df.filter(reduce(lambda a, b: a & b, fits, F.lit(True)))


def map_sentence_pairs(df: DataFrame, uid: str, a: str, b: str, label: str, labels: dict[str, int], test_label: str | None = None) -> DataFrame:
    """Cleaned ``(uid, text_a, text_b, label)``; short rows are dropped, a test split gets one label."""
    name = F.lit(test_label) if test_label else F.trim(F.col(label))
    mapping = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    out = df.select(F.col(uid).alias("uid"), tx.clean_text(F.trim(F.col(a))).alias("text_a"),
                    tx.clean_text(F.trim(F.col(b))).alias("text_b"), F.try_element_at(mapping, name).alias("label"))
    return out.filter((F.length("text_a") > 0) & (F.length("text_b") > 0) & F.col("label").isNotNull() & (F.col("uid") >= 0))


def expand_multiple_choice(df: DataFrame, key: str, questions: str, options: str, answers: str) -> DataFrame:
    """Article x question x choice: a blank ``_`` takes the choice, else it is appended."""
    q = F.col("_q")
    rows = df.select("*", F.posexplode(F.arrays_zip(questions, options, answers)).alias("question_idx", "_z"))
    rows = rows.select("*", F.col(f"_z.{questions}").alias("_q"), F.col(f"_z.{answers}").alias("_a"),
                       F.posexplode(F.col(f"_z.{options}")).alias("choice_idx", "_c"))
    qa = F.when(q.contains("_"), F.replace(q, F.lit("_"), F.col("_c"))).otherwise(F.concat_ws(" ", q, F.col("_c")))
    return rows.select(key, "question_idx", "choice_idx", tx.clean_text(qa).alias("qa"), (F.ascii("_a") - 65).alias("label"))


def knowledge_status(topic: Column, knowledge: Column, kind: str, seen: Column) -> Column:
    """Why a dialog row is left out of the prompt database, or ``keep``."""
    strict = F.lit(kind != "wow_seen")
    return (
        F.when(knowledge == "no_passages_used", "no_knowledge")
        .when(strict & (knowledge.contains("(") | knowledge.contains(")")), "brackets")
        .when(strict & ~F.contains(knowledge, topic), "topic_missing")
        .when(~seen & (F.size(tx.blank_tokens(knowledge)) > 20), "long")
        .when(~seen & knowledge.rlike("^([Ii]t|[Tt]his)"), "pronoun")
        .otherwise("keep")
    )


def dialog_examples(context: Column, topic: Column, knowledge: Column, kind: str) -> tuple[Column, Column]:
    """(instance, dialog example) strings of a prompt database row."""
    turns = F.split(context, r" \[SEP\] ")
    last3 = F.slice(turns, F.greatest(F.size(turns) - 2, F.lit(1)), F.lit(3))
    instance = F.concat(F.lit("( "), F.element_at(turns, -1), F.lit(" ) "), topic, F.lit(" => "), knowledge)
    lead = F.concat(F.lit("( "), topic, F.lit(" ) ")) if kind != "wow_seen" else F.lit("")
    return instance, F.concat(lead, F.array_join(last3, " "))


def _with_stop(text: Column) -> Column:
    return F.when(text.rlike(r"[.?!]$"), text).otherwise(F.concat(text, F.lit(".")))


def dialog_context(df: DataFrame, conv: str, turn: str, text: str, last: int | None = None) -> DataFrame:
    """Earlier turns of every turn joined with ``[SEP]``; ``last`` keeps only that many.

    Turns get their place first. The last-n form is then n equi-joins of
    bounded width, so a hot conversation splits; the full form returns texts
    that grow with the conversation and reads one window frame per turn.
    """
    stopped = df.withColumn("_t", _with_stop(F.col(text)))
    if last is None:
        earlier = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
        return stopped.withColumn("context", F.array_join(F.collect_list("_t").over(earlier), " [SEP] ")).drop("_t")
    placed = with_group_index(stopped, [conv], [turn], "_i")
    spread = placed.select(conv, "_t", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("_d"), "_i").select(
        conv, (F.col("_i") + F.col("_d")).alias("_i"), F.struct((-F.col("_d")).alias("o"), F.col("_t").alias("t")).alias("_e"))
    context = spread.groupBy(conv, "_i").agg(F.array_sort(F.collect_list("_e")).alias("_c"))
    return placed.join(context, [conv, "_i"], "left").withColumn(
        "context", F.coalesce(F.array_join(F.col("_c.t"), " [SEP] "), F.lit(""))).drop("_t", "_i", "_c")


def topic_lookup(train: DataFrame, test: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """(examples of topics the test set has, all other examples)."""
    seen = test.select(topic).distinct()
    return train.join(seen, topic, "left_semi"), train.join(seen, topic, "left_anti")


def prompt_examples(df: DataFrame, topic: str, turn: str, knowledge: str, response: str, key: str, n: int | None = 20, seed: int = 1234) -> DataFrame:
    """Rows whose response copies most of its knowledge, shuffled and formatted as one line.

    Runs of ten or more response tokens that all occur in the knowledge must
    cover 0.6 to 0.9 of the response and at least 0.8 of the knowledge. Runs
    are read off a string of hits, so the scan stays inside expressions.
    """
    r, k = F.split(F.col(response), " "), F.split(F.col(knowledge), " ")
    bits = F.array_join(F.transform(r, lambda w: F.when(F.array_contains(k, w), "1").otherwise("0")), "")
    runs = F.regexp_extract_all(bits, F.lit("(1{10,})"), F.lit(1))
    covered = F.aggregate(runs, F.lit(0), lambda s, x: s + F.length(x))
    good = df.withColumn("_c", covered).filter(
        (F.col("_c") >= 0.6 * F.size(r)) & (F.col("_c") <= 0.9 * F.size(r)) & (F.col("_c") >= 0.8 * F.size(k)))
    line = F.concat(F.lit("Topic: "), F.col(topic), F.lit(". User says: "), F.col(turn), F.lit(" We know that: "),
                    F.col(knowledge), F.lit(" System replies: "), F.col(response))
    out = good.withColumn("line", line).withColumn("_h", digest(seed, key)).orderBy("_h", key)
    return (out.limit(n) if n else out).drop("_h", "_c")
