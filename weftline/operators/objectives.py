"""Training samples: one row in, one row of padded arrays out."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.arrays import let, pad_or_truncate, pair_encode, word_ids
from ..functions.hashing import digest, draw
from .chats import render_chat
from .tokens import position_ids

HALF = 1 << 31
LONGS = T.ArrayType(T.LongType())


def _ones(n: Column) -> Column:
    return F.array_repeat(F.lit(1), n)


def _zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0), n)


def _one(x: int) -> Column:
    return F.array(F.lit(x).cast("bigint"))


def sft_sample(df: DataFrame, prompt: str, response: str, max_len: int, eos: int, pad: int = 0, policy: str = "right") -> DataFrame:
    """``input_ids``, ``attention_mask``, ``position_ids``, ``loss_mask`` of prompt and response ids.

    The loss leaves out the prompt but for its last token, and the last
    response token; both places are counted from the left of what was kept.
    """
    full = F.concat(F.col(prompt), F.col(response), _one(eos))
    ids, mask = pad_or_truncate(full, max_len, pad, left_pad=False, policy=policy)
    out = df.withColumn("_np", F.size(prompt)).withColumn("_n", F.size(prompt) + F.size(response) + 1).withColumns({"input_ids": ids, "attention_mask": mask})
    kept = F.least("_n", F.lit(max_len))
    skip = F.when(F.col("_np") > 1, F.least("_np", F.lit(max_len)) - 1).otherwise(0)
    live = F.greatest(kept - 1 - skip, F.lit(0))
    loss = F.concat(_zeros(skip), _ones(live), _zeros(F.lit(max_len) - skip - live))
    return out.withColumn("position_ids", position_ids(F.col("attention_mask"))).withColumn("loss_mask", loss).drop("_np", "_n")


def preference_sample(df: DataFrame, prompt: str, chosen: str, rejected: str, max_len: int, eos: int | None) -> DataFrame:
    """Chosen and rejected sequences with their masks, zero padded and cut on the right."""
    end = _one(eos) if eos is not None else F.array().cast("array<bigint>")
    out = df
    for name, col in (("chosen", chosen), ("rejected", rejected)):
        ids, mask = pad_or_truncate(F.concat(F.col(prompt), F.col(col), end), max_len, 0, left_pad=False, policy="right")
        out = out.withColumns({f"{name}_ids": ids, f"{name}_mask": mask})
    return out


def rl_sample(df: DataFrame, variants: list[str], max_len: int, mode: str = "chat", template: str = "{prompt}", policy: str = "error", pad: int = 0) -> DataFrame:
    """Left-padded ids, masks and positions of every present prompt variant; the index comes from ``extra_info``."""
    out = df
    for v in variants:
        if v in df.columns:
            ids, mask = pad_or_truncate(word_ids(render_chat(F.col(v), mode, template)), max_len, pad, left_pad=True, policy=policy)
            pre = "" if v == variants[0] else f"{v}_"
            out = out.withColumns({f"{pre}input_ids": ids, f"{pre}attention_mask": mask})
            out = out.withColumn(f"{pre}position_ids", position_ids(F.col(f"{pre}attention_mask")))
    index = F.coalesce(F.col("extra_info.index"), F.lit(0)) if "extra_info" in df.columns else F.lit(0)
    return out.withColumn("index", index)


def switch_template(df: DataFrame, messages: str, response: str, eos_token: str, max_len: int, pad: int = 0) -> DataFrame:
    """The chat with the decoded response, rendered for a second tokenizer; cut and padded on the right."""
    said = F.struct(F.lit("assistant").alias("role"), F.replace(F.col(response), F.lit(eos_token), F.lit("")).alias("content"))
    turns = F.transform(F.concat(F.col(messages), F.array(said)), lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), m["content"], F.lit("\n")))
    ids, mask = pad_or_truncate(word_ids(F.array_join(turns, "")), max_len, pad, left_pad=False, policy="right")
    out = df.withColumns({"input_ids": ids, "attention_mask": mask})
    return out.withColumn("position_ids", position_ids(F.col("attention_mask")))


def evidence_sample(df: DataFrame, title: str, text: str, max_len: int, cls: int = 1, sep: int = 2, pad: int = 0) -> DataFrame:
    """``ids``, ``types``, ``mask`` of title and text as a pair."""
    ids, types, mask = pair_encode(F.col(title), F.col(text), max_len, cls, sep, pad)
    return df.withColumns({"ids": ids, "types": types, "mask": mask})


def removed_counts(len_a: Column, len_b: Column, limit: int) -> tuple[Column, Column]:
    """Tokens taken from a and b when the longer one (b on ties) loses one at a time until both fit."""
    excess = F.greatest(len_a + len_b - limit, F.lit(0))
    gap = F.abs(len_a - len_b)
    level = F.least(gap, excess)
    rest = excess - level
    half = F.floor(rest / 2)
    return (F.when(len_a > len_b, level).otherwise(0) + half).cast("int"), (F.when(len_a > len_b, 0).otherwise(level) + rest - half).cast("int")


def segment_pair(df: DataFrame, key: str, sentences: str, target: int, max_len: int, seed: int, cls: int = 1, sep: int = 2, pad: int = 0) -> DataFrame:
    """Two segments cut between sentences, swapped half of the time, truncated from random ends.

    Gives ``tokens``, ``types``, ``padding_mask``, ``is_random`` and ``truncated``.
    """
    s, k = F.col(sentences), F.col(key)
    n = F.size(s)
    cut = F.when(n >= 3, 1 + draw(f"{seed}cut", k) % (n - 1)).otherwise(1).cast("int")
    out = df.withColumn("_cut", cut).withColumn("is_random", draw(f"{seed}swap", k) < HALF)
    first, second = F.flatten(F.slice(s, F.lit(1), F.col("_cut"))), F.flatten(F.slice(s, F.col("_cut") + 1, n - F.col("_cut")))
    out = out.withColumn("_a", F.when(F.col("is_random"), second).otherwise(first)).withColumn("_b", F.when(F.col("is_random"), first).otherwise(second))
    gone_a, gone_b = removed_counts(F.size("_a"), F.size("_b"), target)
    out = out.withColumn("_ra", gone_a).withColumn("_rb", gone_b)

    def shortened(col, gone, tag):
        front = F.when(F.col(gone) > 0, F.size(F.filter(F.sequence(F.lit(1), F.col(gone)), lambda i: draw(f"{seed}{tag}", k, i) < HALF))).otherwise(0)
        return F.slice(col, front + 1, F.size(col) - F.col(gone))
    out = out.withColumn("truncated", (F.col("_ra") + F.col("_rb")) > 0).withColumn("_a", shortened("_a", "_ra", "a")).withColumn("_b", shortened("_b", "_rb", "b"))
    na, nb = F.size("_a"), F.size("_b")
    close = F.when(nb > 0, F.concat(F.col("_b"), _one(sep))).otherwise(F.col("_b"))
    tokens = F.concat(_one(cls), F.col("_a"), _one(sep), close)
    tail = F.when(nb > 0, nb + 1).otherwise(0)
    out = out.withColumn("_t", tokens).withColumn("types", F.concat(F.array_repeat(F.lit(0), na + 2), F.array_repeat(F.lit(1), tail)))
    short = F.lit(max_len) - F.size("_t")
    return out.select(*df.columns, F.concat("_t", F.array_repeat(F.lit(pad).cast("bigint"), short)).alias("tokens"),
                      F.concat("types", F.array_repeat(F.lit(pad), short)).alias("types"),
                      F.concat(_ones(F.size("_t")), _zeros(short)).alias("padding_mask"), "is_random", "truncated")


def masked_lm(df: DataFrame, key: str, tokens: str, prob: float, max_predictions: int, vocab_size: int, seed: int, special: tuple[int, ...] = (0, 1, 2), mask_id: int = 3) -> DataFrame:
    """``masked``, ``labels`` (-1 elsewhere) and ``loss_mask``: single tokens in seeded order up to the budget.

    A chosen token becomes the mask four times in five, else stays or turns
    into a random id.
    """
    t, k = F.col(tokens), F.col(key)
    length = F.size(F.filter(t, lambda x: x != 0))
    budget = F.least(F.lit(max_predictions), F.greatest(F.lit(1), F.bround(length * prob).cast("int")))
    spots = F.filter(F.transform(t, lambda x, i: F.struct(digest(f"{seed}pick", k, i).alias("h"), i.alias("i"), x.alias("x"))), lambda s: ~s["x"].isin(*special))
    chosen = F.transform(F.slice(F.array_sort(spots), F.lit(1), budget), lambda s: s["i"])
    out = df.withColumn("_pick", chosen)

    def swap(x, i):
        u = draw(f"{seed}kind", k, i)
        kept = F.when(draw(f"{seed}keep", k, i) < HALF, x).otherwise(draw(f"{seed}word", k, i) % vocab_size)
        return F.when(u < int(0.8 * 2 ** 32), F.lit(mask_id).cast("bigint")).otherwise(kept)
    mapped = F.map_from_arrays(F.col("_pick"), _ones(F.size("_pick")))
    out = out.withColumn("_at", mapped).withColumn("loss_mask", let(F.col("_at"), lambda m: F.transform(t, lambda x, i: F.coalesce(F.try_element_at(m, i), F.lit(0)))))
    marked = F.zip_with(t, "loss_mask", lambda x, m: F.struct(x.alias("x"), m.alias("m")))
    out = out.withColumn("_m", marked)
    return out.withColumn("masked", F.transform("_m", lambda s, i: F.when(s["m"] == 1, swap(s["x"], i)).otherwise(s["x"]))).withColumn(
        "labels", F.transform("_m", lambda s: F.when(s["m"] == 1, s["x"]).otherwise(F.lit(-1).cast("bigint")))).drop("_pick", "_at", "_m")


def _rand(seed, key, *parts) -> float:
    """Uniform draw inside a Python task, the same digest rule as in the Columns."""
    return int(hashlib.md5("|".join(map(str, (seed, key, *parts))).encode()).hexdigest()[:8], 16) / 2 ** 32


def choose_spans(words: list[list[int]], n_tokens: int, key, prob: float, max_predictions: int, max_ngrams: int, geometric: bool, seed) -> list[list[int]]:
    """Token positions of masked word runs, in position order.

    Starts come in seeded order; run lengths are 1/n weighted or geometric
    (0.2). A run that does not fit the budget is shortened, one that meets a
    chosen token is passed over.
    """
    budget = min(max_predictions, max(1, round(n_tokens * prob)))
    order = sorted(range(len(words)), key=lambda w: (hashlib.md5(f"{seed}|{key}|o|{w}".encode()).hexdigest(), w))
    taken: set[int] = set()
    spans = []
    for w in order:
        if len(taken) >= budget:
            break
        most = min(max_ngrams, len(words) - w)
        u = _rand(seed, key, "n", w)
        if geometric:
            n, edge = 1, 0.2
            while u > edge and n < max_ngrams:
                n, edge = n + 1, edge + (1 - edge) * 0.2
            n = min(n, most)
        else:
            weights = [1 / i for i in range(1, most + 1)]
            u, n = u * sum(weights), 1
            while n < most and u >= sum(weights[:n]):
                n += 1
        while n >= 1:
            run = [i for word in words[w:w + n] for i in word]
            if len(taken) + len(run) <= budget:
                break
            n -= 1
        if n < 1 or taken & set(run):
            continue
        taken |= set(run)
        spans.append(run)
    return sorted(spans)


def span_masked_lm(df: DataFrame, key: str, tokens: str, starts: str, prob: float, max_predictions: int, vocab_size: int, seed: int,
                   special: tuple[int, ...] = (0, 1, 2), mask_id: int = 3, max_ngrams: int = 3) -> DataFrame:
    """As :func:`masked_lm` over whole words and word runs; ``starts`` is 1 where a word begins."""
    @F.pandas_udf(T.StructType([T.StructField("masked", LONGS), T.StructField("labels", LONGS), T.StructField("loss_mask", LONGS)]))
    def mask(keys: pd.Series, rows: pd.Series, begins: pd.Series) -> pd.DataFrame:
        out = []
        for k, row, begin in zip(keys, rows, begins):
            row = [int(x) for x in row]
            words: list[list[int]] = []
            for i, x in enumerate(row):
                if x in special:
                    continue
                if begin[i] or not words:
                    words.append([i])
                else:
                    words[-1].append(i)
            hit = {i for run in choose_spans(words, sum(x != 0 for x in row), k, prob, max_predictions, max_ngrams, False, seed) for i in run}

            def new(i, x, k=k):
                if _rand(seed, k, "kind", i) < 0.8:
                    return mask_id
                return x if _rand(seed, k, "keep", i) < 0.5 else int(_rand(seed, k, "word", i) * vocab_size)
            out.append(([new(i, x) if i in hit else x for i, x in enumerate(row)], [x if i in hit else -1 for i, x in enumerate(row)],
                        [int(i in hit) for i in range(len(row))]))
        return pd.DataFrame(out, columns=["masked", "labels", "loss_mask"])
    return df.withColumn("_m", mask(F.col(key), F.col(tokens), F.col(starts))).select(*df.columns, "_m.masked", "_m.labels", "_m.loss_mask")


def span_corruption(df: DataFrame, key: str, tokens: str, target: int, max_len: int, max_len_dec: int, prob: float, seed: int,
                    bos: int, eos: int, first_sentinel: int, pad: int = 0) -> DataFrame:
    """Masked runs replaced by sentinels: ``text_enc``, ``text_dec``, ``labels`` (-1 padded), ``loss_mask``, ``truncated``."""
    fields = [T.StructField(n, LONGS) for n in ("text_enc", "text_dec", "labels", "loss_mask")]

    @F.pandas_udf(T.StructType(fields))
    def corrupt(keys: pd.Series, rows: pd.Series) -> pd.DataFrame:
        out = []
        for k, row in zip(keys, rows):
            row = [int(x) for x in row[:target]]
            spans = choose_spans([[i] for i in range(len(row))], len(row), k, prob, int(prob * target), 10, True, seed) if row else []
            enc, dec, at = [], [], 0
            for j, run in enumerate(spans):
                flag = first_sentinel + j
                enc += row[at:run[0]] + [flag]
                dec += [flag] + [row[i] for i in run]
                at = run[-1] + 1
            enc += row[at:]
            n = len(dec) + 1
            if len(enc) > max_len or n > max_len_dec:
                raise ValueError("the sample does not fit its padded length")
            made = (enc + [pad] * (max_len - len(enc)), [bos] + dec + [pad] * (max_len_dec - n),
                    dec + [eos] + [-1] * (max_len_dec - n), [1] * n + [0] * (max_len_dec - n))
            # eight bytes a number: lists of a whole batch would hold an object each
            out.append(tuple(np.array(x, dtype=np.int64) for x in made))
        return pd.DataFrame(out, columns=[f.name for f in fields])
    made = df.withColumn("truncated", F.size(tokens) > target).withColumn("_s", corrupt(F.col(key), F.slice(tokens, 1, target)))
    return made.select(*df.columns, "truncated", *[F.col(f"_s.{f.name}") for f in fields])


def inverse_cloze(df: DataFrame, key: str, sentences: str, title: str | None, max_len: int, keep_prob: float, seed: int, cls: int = 1, sep: int = 2, pad: int = 0) -> DataFrame:
    """A random sentence of a block as query, the block (with it now and then) as context.

    Gives ``query_tokens``, ``query_pad_mask``, ``context_tokens``, ``context_pad_mask``.
    """
    s, k = F.col(sentences), F.col(key)
    pick = (draw(f"{seed}pick", k) % F.size(s)).cast("int")
    out = df.withColumn("_k", pick).withColumn("_keep", draw(f"{seed}keep", k) < int(keep_prob * 2 ** 32))
    query = F.slice(F.element_at(s, F.col("_k") + 1), 1, max_len - 2)
    # the bound place is read inside the lambda
    rest = F.when(F.col("_keep"), s).otherwise(F.concat(F.slice(s, F.lit(1), F.col("_k")), F.slice(s, F.col("_k") + 2, F.greatest(F.size(s) - F.col("_k") - 1, F.lit(0)))))
    head = F.col(title) if title else None
    room = F.lit(max_len - 3) - F.size(head) if title else F.lit(max_len - 2)
    block = F.slice(F.flatten(rest), F.lit(1), room)

    def padded(tokens, lead):
        full = F.concat(_one(cls), lead, _one(sep), tokens, _one(sep)) if lead is not None else F.concat(_one(cls), tokens, _one(sep))
        return pad_or_truncate(full, max_len, pad, left_pad=False)
    q, qm = padded(query, None)
    c, cm = padded(block, head)
    return out.withColumns({"query_tokens": q, "query_pad_mask": qm, "context_tokens": c, "context_pad_mask": cm}).drop("_k", "_keep")
