"""Personal data: base patterns, then information-theoretic sanitisation of the terms that give them away.

Base spans are the emails, addresses, card and phone numbers that the stated
patterns find. They are the protected entities. The words beside an entity
(``NEAR`` on either side) are held against the corpus: with n texts, n_t of
them holding the term, n_e the entity and n_te both beside each other, the
pointwise mutual information PMI = log2(n_te n / (n_t n_e)) says how many of
the entity's IC = log2(n / n_e) bits the term discloses. A term whose PMI
reaches ``REMOVE`` of IC is removed beside that entity, one that reaches
``GENERALISE`` is generalised. An estimate needs ``SUPPORT`` different texts
that hold both; equal texts are one witness.

All steps are DataFrame functions. Matches are marked in the text by two
private-use characters, which are first replaced one for one in a copy of it,
and positions follow from the lengths between marks. Patterns use possessive
loops and a look behind, so that no run of characters is scanned twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import documents, text_key

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
NEAR = 4
REACH = 256  # characters on either side that are searched for the NEAR whole words
SUPPORT = 3
GENERALISE = 0.5
REMOVE = 0.9
ASKED = 50_000  # terms that a filter holds as a set

_OPEN, _CLOSE = chr(0xE000), chr(0xE001)
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
# the stated patterns; a start that failed is not tried again inside the same run
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# without these a text has no match
_LEAST = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_WORD = r"[^\x20\x09-\x0D]++"
_EDGES = r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$"
_MATCHES = "array<struct<start:int,end:int,match:string>>"


def _luhn(match: Column) -> Column:
    digits = F.filter(F.split(F.reverse(F.regexp_replace(match, "[^0-9]", "")), ""), lambda d: d != "")
    values = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_like(p, F.lit("^0*+(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])?$")))
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def plain(text: Column) -> Column:
    """The text, null as empty, with the two marks replaced; every character keeps its place."""
    return F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, chr(0xE002) * 2)


def matches(text: Column, pattern: str, least: str) -> Column:
    """All matches in a text without marks: start and end in code points (end exclusive), and the match."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN, -1)
    none = F.array().cast(_MATCHES)

    # a piece is a match, a closing mark, and the text up to the next match
    def step(state: Column, piece: Column) -> Column:
        match = F.substring_index(piece, _CLOSE, 1)
        one = F.struct(state.at.alias("start"), (state.at + F.length(match)).alias("end"), match.alias("match"))
        return F.struct(F.concat(state.out, F.array(one)).alias("out"), (state.at + F.length(piece) - 1).alias("at"))

    first = F.struct(none.alias("out"), F.length(F.element_at(pieces, 1)).alias("at"))
    found = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), first, step, lambda s: s.out)
    return F.when(F.regexp_like(text, F.lit(least)), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """Array of (start, rank of the kind, kind, end, match) in order."""
    def of(rank: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind], _LEAST[kind]), lambda m: _valid(kind, m.match))
        return F.transform(found, lambda m: F.struct(m.start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m.end.alias("end"), m.match.alias("match")))

    return F.array_sort(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS[:4])]))


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span.kind, F.lower(span.match))


def _beside(text: Column, span: Column) -> Column:
    """The characters on either side of a span that are searched for words."""
    low = F.greatest(span.start - REACH, F.lit(0))
    left = F.struct(F.substring(text, low + 1, span.start - low).alias("part"), low.alias("base"), F.lit(True).alias("before"), (low > 0).alias("cut"))
    right = F.struct(F.substring(text, span.end + 1, F.lit(REACH)).alias("part"), span.end.alias("base"), F.lit(False).alias("before"), (F.length(text) > span.end + REACH).alias("cut"))
    return F.struct(_entity(span).alias("entity"), F.array(left, right).alias("sides"))


def _terms(slim: DataFrame) -> DataFrame:
    """doc_id, _h, entity, term (lower case, outer signs off), start, end, match: the words beside each entity.

    A word that the reach cuts off, or that touches a base span, is no term.
    """
    sides = slim.select("doc_id", "_h", "base", F.explode("beside").alias("b")).select("doc_id", "_h", "base", "b.entity", F.explode("b.sides").alias("s"))
    found = F.filter(matches(F.col("s.part"), _WORD, r"[^\x20\x09-\x0D]"),
                     lambda w: ~F.col("s.cut") | F.when(F.col("s.before"), w.start > 0).otherwise(w.end < REACH))
    near = sides.withColumn("w", found).withColumn("w", F.when(F.col("s.before"), F.slice("w", F.greatest(F.size("w") - NEAR + 1, F.lit(1)), F.lit(NEAR))).otherwise(F.slice("w", 1, NEAR)))
    each = near.select("doc_id", "_h", "base", "entity", F.col("s.base").alias("low"), F.explode("w").alias("w"))
    lead = F.length(F.regexp_extract("w.match", r"^[^\p{L}\p{N}]*+", 0))
    cored = each.select("doc_id", "_h", "base", "entity", F.regexp_replace("w.match", _EDGES, "").alias("match"), (F.col("low") + F.col("w.start") + lead).alias("start"))
    placed = cored.withColumn("end", F.col("start") + F.length("match")).filter(F.length("match") > 1)
    free = F.forall("base", lambda b: (b.end <= F.col("start")) | (b.start >= F.col("end")))
    return placed.filter(free).select("doc_id", "_h", "entity", F.lower("match").alias("term"), "start", "end", "match")


def _among(words: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows whose term is asked for: by a set in the filter while the terms, counted here, are few, else by a join."""
    terms = [r[0] for r in asked.limit(ASKED + 1).collect()]
    if len(terms) > ASKED:
        return words.join(asked, "term", "left_semi")
    quoted = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in terms)
    return words.filter(F.expr(f"term IN ({quoted})"))


def disclosures(slim: DataFrame, beside: DataFrame, corpus: DataFrame) -> DataFrame:
    """term, entity, n_te, n_t, n_e, pmi, ic and action of every pair beyond a threshold.

    Term counts run over all words of the corpus (``_h``, ``_plain``), for the
    terms that some entity has beside it in ``SUPPORT`` different texts.
    """
    n = slim.select("_h").distinct().agg(F.count("*").alias("n")).scalar()
    n_e = slim.select("_h", F.explode("base").alias("b")).select("_h", _entity(F.col("b")).alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    together = beside.select("term", "entity", "_h").distinct().groupBy("term", "entity").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= SUPPORT)
    # a term has at least the texts where it stands beside any entity: pairs that these already rule out need no count
    beside_any = beside.select("term", "_h").distinct().groupBy("term").agg(F.count("*").alias("n_b"))
    most = F.col("n_te") * F.pow(F.col("n") / F.col("n_e"), F.lit(1 - GENERALISE)) * 1.001
    pairs = stage(together.join(n_e, "entity").join(beside_any, "term").withColumn("n", n).filter(F.col("n_b") <= most).drop("n_b"), "pairs")
    asked = pairs.select("term").distinct()
    if asked.isEmpty():  # no pair has the support: nothing to count
        n_t = asked.withColumn("n_t", F.lit(1).cast("bigint"))
    else:
        words = corpus.select("_h", F.explode(F.array_distinct(F.split(F.lower("_plain"), r"[\x20\x09-\x0D]+"))).alias("w"))
        held = _among(words.select("_h", F.regexp_replace("w", _EDGES, "").alias("term")), asked)
        n_t = held.distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    told = pairs.join(n_t, "term")
    bits = told.withColumns({"pmi": F.log2(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e"))), "ic": F.log2(F.col("n") / F.col("n_e"))}).filter("ic > 0")
    action = F.when(F.col("pmi") >= F.col("ic") * REMOVE, "removed").when(F.col("pmi") >= F.col("ic") * GENERALISE, "generalised")
    return bits.withColumn("action", action).filter("action is not null").drop("n")


def spans(df: DataFrame) -> DataFrame:
    """doc_id, _h (text hash), base and spans of every row.

    base holds the pattern matches; spans these and the disclosing terms, by
    start, then kind in the order of ``KINDS``; of a term disclosing several
    entities the strongest action counts. Null and empty texts have none.
    Repeated rows get equal spans. An empty table gives no rows.
    """
    source = documents(df).select("doc_id", text_key().alias("_h"), plain(F.col("text")).alias("_plain"))
    found = source.withColumn("base", base_spans(F.col("_plain")))
    slim = stage(found.select("doc_id", "_h", "base", F.transform("base", lambda s: _beside(F.col("_plain"), s)).alias("beside")), "spans")
    beside = stage(_terms(slim), "beside")
    told = stage(disclosures(slim.select("_h", "base"), beside, source), "told")
    hits = beside.join(told.select("term", "entity", "action"), ["term", "entity"]).groupBy("doc_id", "_h", "start", "end", "match").agg(F.max("action").alias("kind"))
    ranked = F.when(F.col("kind") == "generalised", 4).otherwise(5).alias("rank")
    more = hits.groupBy("doc_id", "_h").agg(F.collect_list(F.struct("start", ranked, "kind", "end", "match")).alias("more")).withColumnsRenamed({"doc_id": "d", "_h": "h"})
    rows = slim.select("doc_id", "_h", "base")
    # a row without an entity has no terms beside one, and stays out of the join
    joined = rows.filter(F.size("base") > 0).join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_h") == F.col("h")), "left")
    full = joined.select("doc_id", "_h", "base", F.array_sort(F.concat("base", F.coalesce("more", F.expr("slice(base, 1, 0)")))).alias("spans"))
    return full.unionAll(rows.filter(F.size("base") == 0).withColumn("spans", F.col("base")))


def digest(spans_: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _rewritten(text: Column, found: Column) -> Column:
    """The text with base spans and generalised terms replaced by their kind in brackets, and removed terms left out.

    Of spans that overlap, the first names the replacement and all are covered.
    """
    def step(state: Column, s: Column) -> Column:
        name = F.when(s.kind == "removed", "").when(s.kind == "generalised", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s.kind), F.lit("]")))
        between = F.substring(text, state.at + 1, s.start - state.at)
        grown = F.when(s.start >= state.at, F.concat(state.out, F.array(between, name))).otherwise(state.out)
        return F.struct(grown.alias("out"), F.greatest(state.at, s.end).alias("at"))

    first = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(found, first, step, lambda s: F.concat(F.array_join(s.out, ""), F.substring(text, s.at + 1, F.length(text))))


def sanitise(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with the sanitised text in ``column``, all other columns and rows as they are; null texts stay null.

    ``df`` needs doc_id and text. Only rows with spans are rewritten.
    """
    found = spans(df).filter(F.size("spans") > 0).groupBy("doc_id", "_h").agg(F.first("spans").alias("_spans")).withColumnsRenamed({"doc_id": "_d", "_h": "_k"})
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = df.join(found, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_d")) & (key == F.col("_k")), "left")
    text = F.col("text").cast("string")
    rewritten = F.when(F.col("_spans").isNull(), text).otherwise(_rewritten(text, F.col("_spans")))
    return joined.withColumn("_new", rewritten).drop("_d", "_k", "_spans").withColumn(column, F.col("_new")).drop("_new")
