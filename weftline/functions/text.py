"""Text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Python's Unicode word class, written out because Java's \w and \b are ASCII.
WORD = r"[\p{L}\p{N}_]"
BLANK = r"[ \t\n\r\f\x0B]"
SLICE = 1_000_000
WORD_ROWS = 65_536


def words(text: Column) -> Column:
    """Lower-case word runs in reading order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}+)"), F.lit(1))


def blank_tokens(text: Column) -> Column:
    """Tokens between blanks; no tokens in a blank text."""
    squeezed = F.trim(F.regexp_replace(text, f"{BLANK}+", " "))
    return F.when(squeezed == "", F.array().cast("array<string>")).otherwise(F.split(squeezed, " "))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType())])))
def words_with_positions(text: pd.Series) -> pd.Series:
    """Word runs of the lower-cased text with their 0-based start offsets.

    A running offset is quadratic as an array fold, so one linear scan per text is used.
    """
    return text.map(lambda t: [] if t is None else [{"word": m.group(), "start": m.start()} for m in re.finditer(r"\w+", t.lower())])


def word_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, word, start): as :func:`words_with_positions`, a row per word.

    Rows leave the worker some tens of thousands at a time, so its memory does
    not follow the words of a batch of texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, found, starts = [], [], [], []

            def flush():
                cut = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(places, pa.int64()), pa.array(found, pa.string()), pa.array(starts, pa.int64())]
                for held in (at, places, found, starts):
                    held.clear()
                return pa.RecordBatch.from_arrays(cut, [key, "i", "word", "start"])
            for row, value in enumerate(batch.column(1)):
                for i, m in enumerate(re.finditer(r"\w+", (value.as_py() or "").lower())):
                    at.append(row)
                    places.append(i)
                    found.append(m.group())
                    starts.append(m.start())
                    if len(at) == WORD_ROWS:
                        yield flush()
            if at:
                yield flush()
    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, i long, word string, start long")


def word_offset(text: Column, index: Column) -> Column:
    """Start offset of the ``index``-th word of the lower-cased text, for few words of a text."""
    gaps = F.split(F.lower(text), f"{WORD}+", -1)
    before = F.slice(words(text), F.lit(1), index)
    return F.length(F.array_join(before, "")) + F.length(F.array_join(F.slice(gaps, F.lit(1), index + 1), ""))


def shingles(text: Column, n: int = 5) -> Column:
    """Set of character n-grams starting at 0 .. len-n-1; the last start is left out.

    Characters are split once and joined by index: a substring per start would
    walk the text from its beginning each time.
    """
    def grams(chars):
        return F.transform(F.sequence(F.lit(0), F.size(chars) - n - 1), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
    cut = F.transform(F.array(F.split(text, "")), lambda chars: F.array_distinct(grams(chars)))
    return F.when(F.length(text) > n, F.get(cut, F.lit(0))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, mode: str = "union") -> Column:
    """Overlap of two sets over their union, smaller or larger size; 0 if one is empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    base = {
        "union": F.size(a) + F.size(b) - shared,
        "min": F.least(F.size(a), F.size(b)),
        "max": F.greatest(F.size(a), F.size(b)),
    }[mode]
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / base)


def general_clean(text: Column) -> Column:
    """Runs of spaces, and newlines after a word, become one space."""
    return F.regexp_replace(text, rf"  +|(?<={WORD})\n+ ?", " ")


def clean_text(text: Column) -> Column:
    """Newlines to spaces, blanks squeezed, `` . `` pulled to its word."""
    out = F.regexp_replace(text, f"{BLANK}+", " ")
    for _ in range(3):
        out = F.replace(out, F.lit(" . "), F.lit(". "))
    return out


# Fixed values: (pattern, replacement, is_regex) in the order they apply.
_PTB = [
    (" '", "'", False), (" \n", "\n", False), ("\n ", "\n", False), (" n't", "n't", False),
    (" N ", "1 ", False), ("$ 1", "$1", False), ("# 1", "#1", False),
]
_WIKI = [
    ("s '", "s'", False), (r"/' [0-9]/", "/'[0-9]/", True),
    (" @-@ ", "-", False), (" @,@ ", ",", False), (" @.@ ", ".", False),
    (" : ", ": ", False), (" ; ", "; ", False), (" . ", ". ", False),
    (" ! ", "! ", False), (" ? ", "? ", False), (" , ", ", ", False),
    (r"\([ \t\n\r]*([^)]*?)[ \t\n\r]*\)", "($1)", True), (r"\[[ \t\n\r]*([^\]]*?)[ \t\n\r]*\]", "[$1]", True),
    (r"\{[ \t\n\r]*([^}]*?)[ \t\n\r]*\}", "{$1}", True),
    (r"\"[ \t\n\r]*([^\"]*?)[ \t\n\r]*\"", "\"$1\"", True), (r"'[ \t\n\r]*([^']*?)[ \t\n\r]*'", "'$1'", True),
    ("= = = =", "====", False), ("= = =", "===", False), ("= =", "==", False),
    (" ° ", "°", False), (" \n", "\n", False), ("\n ", "\n", False),
    (" N ", " 1 ", False), (" 's", "'s", False),
]


def detokenize(text: Column, path: str) -> Column:
    """Undo corpus tokenisation; the rules are chosen by a word in ``path``."""
    rules = _PTB if "ptb" in path else _WIKI if "wiki" in path else []
    for old, new, is_regex in rules:
        text = F.regexp_replace(text, old, new) if is_regex else F.replace(text, F.lit(old), F.lit(new))
    return text


def split_sentences(text: Column, keep_newlines: bool = False) -> Column:
    """Sentences of a text, cut after ``.!?`` and blanks; very long texts are cut in slices first.

    With ``keep_newlines`` the blanks after a sentence stay part of it.
    """
    pieces = F.when(F.length(text) <= SLICE, F.array(text)).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / SLICE).cast("int")),
                    lambda i: F.substr(text, i * SLICE + 1, F.lit(SLICE)))
    )
    if keep_newlines:
        kept = F.flatten(F.transform(pieces, lambda p: F.split(F.regexp_replace(p, r"([.!?][ \t\n\r]+)", "$1\x01"), "\x01")))
        return F.filter(kept, lambda s: s != "")
    sents = F.flatten(F.transform(pieces, lambda p: F.split(p, r"(?<=[.!?])[ \t\n\r]+")))
    return F.filter(sents, lambda s: s != "")


# Frequent function words that tell the languages apart.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "on", "by", "are", "this"],
    "fr": ["le", "la", "les", "et", "de", "des", "un", "une", "est", "que", "qui", "pour", "dans", "en"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "von", "mit", "den", "im"],
    "es": ["el", "los", "las", "y", "un", "una", "es", "por", "con", "para", "del", "se", "al"],
}


def stop_word_hits(text: Column, lang: str) -> Column:
    found = F.split(F.lower(text), r"[^\p{L}]+")
    known = F.array(*[F.lit(w) for w in STOP_WORDS[lang]])
    return F.size(F.filter(found, lambda w: F.array_contains(known, w)))


def is_english(text: Column) -> Column:
    """English stop words are seen and at least as frequent as any other language's."""
    en = stop_word_hits(text, "en")
    return (en > 0) & (en >= F.greatest(*[stop_word_hits(text, k) for k in STOP_WORDS if k != "en"]))


def fix_text(text: Column) -> Column:
    """Repair text read with the wrong encoding, odd quotes and control characters.

    UTF-8 bytes shown as Latin-1 are decoded again when the bytes are valid
    UTF-8; anything else keeps its letters.
    """
    latin = text.rlike("^[\\x00-\\xff]*$") & text.rlike("[\\xc2-\\xf4][\\x80-\\xbf]")
    again = F.try_validate_utf8(F.encode(F.when(latin, text), "ISO-8859-1").cast("string"))
    out = F.coalesce(again, text)
    out = F.translate(out, "‘’“”  ", "''\"\"\n\n")
    out = F.regexp_replace(out, "\r\n?", "\n")
    return F.regexp_replace(out, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")


# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normalize_answer(s: Column) -> Column:
    """Lower case, punctuation to spaces, articles out, blanks squeezed (F1 form)."""
    out = F.translate(F.lower(s), PUNCTUATION, " " * len(PUNCTUATION))
    return _drop_articles(out)


def normalize_exact(s: Column) -> Column:
    """As :func:`normalize_answer`, but punctuation is deleted."""
    return _drop_articles(F.translate(F.lower(s), PUNCTUATION, ""))


def _drop_articles(s: Column) -> Column:
    out = F.regexp_replace(s, rf"(?<!{WORD})(a|an|the)(?!{WORD})", " ")
    return F.trim(F.regexp_replace(out, f"{BLANK}+", " "))


def answer_tokens(text: Column) -> Column:
    """Uncased letter/digit/mark runs, or single other visible characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}])"), F.lit(1))


def has_answer(text: Column, answers: Column, mode: str = "string") -> Column:
    """Whether one of ``answers`` occurs in the text.

    ``string`` looks for the answer's tokens in a row, ``regex`` searches a
    pattern without case. Both sides are decomposed (NFD) first, so composed
    and decomposed accents are alike.
    """
    if mode == "string":
        def flat(x):
            return F.concat(F.lit("\x01"), F.array_join(answer_tokens(x), "\x01"), F.lit("\x01"))
        # Python functions stay outside the lambdas; the text is decomposed and tokenised once
        beside = F.array_repeat(flat(nfd(text)), F.size(answers))
        return F.exists(F.zip_with(beside, nfd_all(answers), lambda t, a: F.contains(t, flat(a))), lambda found: found)
    text, answers = nfd(text), nfd_all(answers)
    return _any_pattern(text, answers)


@F.pandas_udf(T.BooleanType())
def _any_pattern(texts: pd.Series, answers: pd.Series) -> pd.Series:
    """Case-insensitive search of user patterns; a pattern that does not compile is no match.

    Spark fails the job on a bad pattern, so these are compiled in Python.
    """
    compiled: dict[str, re.Pattern | None] = {}

    def search(pattern: str, text: str) -> bool:
        if pattern not in compiled:
            try:
                compiled[pattern] = re.compile(pattern, re.IGNORECASE | re.UNICODE | re.MULTILINE)
            except re.error:
                compiled[pattern] = None
        return compiled[pattern] is not None and compiled[pattern].search(text) is not None
    return pd.Series([any(search(p, t) for p in ps) for t, ps in zip(texts, answers)])


@F.pandas_udf(T.StringType())
def nfd(texts: pd.Series) -> pd.Series:
    """Canonically decomposed text (no built-in function does this)."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfd_all(texts: pd.Series) -> pd.Series:
    """Canonically decomposed strings of an array."""
    return texts.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFD", x) for x in xs])
