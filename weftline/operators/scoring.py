"""Scoring registry, rollout grading, time limits and embeddings by user functions."""

from __future__ import annotations

import functools
import hashlib
import signal
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import grading as gr
from ..session import spread
from ..sources.files import missing_blocks

# Which scorer a data source or ability uses.
BOXED_SOURCES = ["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval"]
MATH_SOURCES = ["all_math", "math", "stem", "numina_aops_forum", "numina_synthetic_math", "numina_amc_aime", "numina_synthetic_amc", "numina_cn_k12", "numina_olympiads"]
CODE_SOURCES = ["codecontests", "apps", "codeforces", "taco", "code"]
TIME_LIMITS = {"math": 5, "stem": 5, "code": 5, "llm": 30}

Scorer = Callable[[Column, Column], Column]


def registry(code_results: Column | None = None) -> list[tuple[list[str], Scorer]]:
    """(sources, scorer) pairs; code is scored from a column of test results."""
    found = [
        (["openai/gsm8k"], lambda r, t: gr.grade_hash_answer(r, t)),
        (BOXED_SOURCES, gr.score_boxed),
        (MATH_SOURCES, lambda r, t: gr.grade_math(r, F.array(t)).cast("double")),
    ]
    if code_results is not None:
        found.append((CODE_SOURCES, lambda r, t: gr.code_score(code_results)))
    return found


def score(source: Column, response: Column, truth: Column, scorers: list[tuple[list[str], Scorer]]) -> Column:
    """Score by source; a blank response is 0, an unknown source an error."""
    out = F.when(F.trim(F.regexp_replace(response, r"[ \t\n\r\f\x0B]+", " ")) == "", F.lit(0.0))
    for names, fn in scorers:
        out = out.when(source.isin(names), fn(response, truth).cast("double"))
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double"))


def custom_scorer(fn: Callable[[str, str], float], seconds: float | None = None, default: float = 0.0) -> Scorer:
    """A user's ``fn(response, truth)`` as a scorer, with an optional time limit per row."""
    run = with_timeout(fn, seconds, default)

    @F.pandas_udf("double")
    def scored(responses: pd.Series, truths: pd.Series) -> pd.Series:
        return pd.Series([run(r, t) for r, t in zip(responses, truths)], dtype="float64")

    return lambda r, t: scored(r, t)


def limited_scorer(fn: Callable[[str, str], float], limits: dict[str, float], default: float = 0.0) -> Callable[[Column, Column, Column], Column]:
    """As :func:`custom_scorer`, with the time limit of each row's ability; abilities without one have none."""
    @F.pandas_udf("double")
    def scored(responses: pd.Series, truths: pd.Series, abilities: pd.Series) -> pd.Series:
        runs = {a: with_timeout(fn, limits.get(a), default) for a in abilities.unique()}
        return pd.Series([runs[a](r, t) for r, t, a in zip(responses, truths, abilities)], dtype="float64")

    return lambda r, t, a: scored(r, t, a)


def with_timeout(fn: Callable, seconds: float | None, default, read: Callable = float) -> Callable:
    """``fn`` limited to ``seconds`` of wall time, its result through ``read``; the default on timeout or error.

    Python workers run tasks on their main thread, so an interval timer can
    interrupt a row there.
    """
    def expire(*_):
        raise TimeoutError

    def run(*args):
        if seconds:
            old = signal.signal(signal.SIGALRM, expire)
            signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return read(fn(*args))
        except Exception:
            return default
        finally:
            if seconds:
                signal.setitimer(signal.ITIMER_REAL, 0)
                signal.signal(signal.SIGALRM, old)
    return run


def scored_detail(fn: Callable[[str, str], tuple[float, str]], seconds: float | None = None, default: tuple[float, str] = (0.0, "failed")):
    """A user's scorer as a table function with rows (score, detail); the default on timeout or error."""
    run = with_timeout(fn, seconds, default, lambda found: (float(found[0]), str(found[1])))

    @F.udtf(returnType="score: double, detail: string")
    class Scored:
        def eval(self, response: str, truth: str):
            yield run(response, truth)
    return Scored


def grade_rollouts(df: DataFrame, response: str, truth: str, ability: str, mask: str, scorers: list[tuple[list[str], Scorer]],
                   math_format: str = "math", model_scores: str | None = None) -> DataFrame:
    """``score``, ``format_score`` and ``token_scores`` (the score on the last valid token).

    A response of the wrong shape is graded as empty. Given model scores are
    taken as they are.
    """
    r, a = F.col(response), F.col(ability)
    ok = F.when(a.isin("math", "stem", "llm"), gr.verify_format(r, math_format)).when(a == "code", gr.verify_format(r, "code")).otherwise(True)
    shaped = df.withColumn("format_score", ok.cast("double"))
    if model_scores:
        return shaped.withColumn("score", F.col(model_scores)).withColumn("token_scores", _on_last(F.col("score"), F.col(mask)))
    gated = shaped.withColumn("_r", F.when(F.col("format_score") == 1, r).otherwise(""))
    out = gated.withColumn("score", score(a, F.col("_r"), F.col(truth), scorers)).drop("_r")
    return out.withColumn("token_scores", _on_last(F.col("score"), F.col(mask)))


def _on_last(value: Column, mask: Column) -> Column:
    from .tokens import expand_to_token
    return expand_to_token(value, mask)


def grade_multi(responses: Column, truth: Column, source: Column, scorers: list[tuple[list[str], Scorer]]) -> Column:
    """Scores of a prompt's list of samples, in their order."""
    return F.transform(responses, lambda r: score(source, r, truth, scorers))


def hashed_words(dim: int = 64) -> Callable[[], Callable[[pd.Series], list]]:
    """Deterministic stand-in embedder: signed counts of word digests, unit length."""
    def load():
        @functools.lru_cache(maxsize=1 << 14)
        def place(word: str) -> tuple[int, float]:
            d = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
            return d % dim, 1.0 if d >> 31 else -1.0

        def embed(texts: pd.Series) -> list:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                signs = [0.0] * dim
                for w in t.lower().split():
                    at, sign = place(w)
                    signs[at] += sign
                out[i] = signs
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return list(out / np.where(norms == 0, 1, norms))
        return embed
    return load


def embed_table(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[pd.Series], list]]) -> DataFrame:
    """(key, embedding): a user's batch embedder, loaded once per Python worker task."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()
        for b in batches:
            yield pd.DataFrame({key: b[key], "embedding": embed(b[text])})
    return spread(df.select(key, text), key).mapInPandas(run, f"{key} {kind}, embedding array<double>")


def embed_blocks(df: DataFrame, key: str, text: str, load: Callable, path: str, block: int, n: int) -> int:
    """Embed the blocks of ``key`` not yet written whole under ``path``; returns how many there were.

    Ids must be unique. Blocks are partition folders, overwritten one by one, so
    a job that stopped half way goes on where it ended.
    """
    spark = df.sparkSession
    if df.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} is not unique")
    try:
        done = spark.read.parquet(path).groupBy("block_start").agg(F.count("*").alias("n_rows"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], "block_start long, n_rows long")
    todo = missing_blocks(spark, n, block, done)
    missing = todo.count()
    if missing:
        rows = df.withColumn("block_start", F.floor(F.col(key) / block) * block).join(todo.select("block_start"), "block_start", "left_semi")
        out = embed_table(rows, key, text, load).withColumn("block_start", F.floor(F.col(key) / block) * block)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block_start").parquet(path)
    return missing


__all__ = ["registry", "score", "custom_scorer", "limited_scorer", "TIME_LIMITS", "with_timeout", "scored_detail", "grade_rollouts", "grade_multi", "embed_table", "embed_blocks", "hashed_words"]
