"""Queries over row shaping, order, sets and files."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import text as tx, urls
from ..operators import chats, cleaning, rows
from ..operators.index import with_row_index
from ..session import fresh_path
from ..sources import files, keyed_json
from . import views
from .registry import joined, query

DOCS = ["doc_id", "lang", "source", "n_chars"]


@query("row_index", "SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS row_idx FROM documents")
def _(t):
    return with_row_index(t.documents.select("doc_id", "lang"), ["lang", "doc_id"])


@query("read_parquet_union", """
SELECT doc_id, lang, n_chars, NULL::INT AS quality, NULL::INT AS toxic FROM documents
UNION ALL SELECT doc_id, NULL, NULL, quality, toxic FROM labels""")
def _(t):
    f = t.folder
    return files.read_parquet_union(t.spark, [f"{f}/documents.parquet", f"{f}/labels.parquet"], strict=False).drop("text", "source")


JSON_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


@query("read_jsonl", """
SELECT doc_id, lang, text, 'good' AS kind FROM documents
UNION ALL SELECT NULL, NULL, '{"doc_id": ' || doc_id || ', "text": ', 'bad' FROM labels""")
def _(t):
    path = fresh_path(t.spark, "jsonl")
    good = t.documents.select(F.to_json(F.struct("doc_id", "text", "lang")).alias("value"))
    broken = t.labels.select(F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "text": ')).alias("value"))
    good.unionAll(broken).write.option("compression", "gzip").text(path)
    rows_, bad = files.read_jsonl(t.spark, path, JSON_SCHEMA, on_error="quarantine")
    return rows_.withColumn("kind", F.lit("good")).unionByName(
        bad.select(F.col("line").alias("text"), F.lit("bad").alias("kind")), allowMissingColumns=True)


@query("read_tsv", "SELECT item_id AS doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS text, 'item ' || item_id AS title FROM benchmark")
def _(t):
    path = fresh_path(t.spark, "tsv")
    flat = F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")).alias("text")
    t.benchmark.select(F.col("item_id").alias("doc_id"), flat, F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("title")) \
        .write.option("sep", "\t").option("header", True).csv(path)
    return files.read_tsv(t.spark, path, "doc_id long, text string, title string", unique="doc_id")


@query("write_jsonl_by", "SELECT lang || '_' || source AS key_safe, doc_id, text FROM documents")
def _(t):
    path = fresh_path(t.spark, "by_key")
    files.write_jsonl_by(t.documents.select("doc_id", "text", F.concat_ws("/", "lang", "source").alias("key")), path, "key")
    return t.spark.read.schema("doc_id long, text string, key_safe string").json(path)


@query("keyed_json", """SELECT lang || '_' || source AS key_safe, count(*) AS n, sum(length(text))::BIGINT AS chars, count(*) AS told_rows, sum(n_chars)::BIGINT AS told_chars
FROM documents GROUP BY 1""")
def _(t):
    # what the committed files hold beside what the metrics file tells
    path = fresh_path(t.spark, "keyed")
    rows = t.documents.select("doc_id", "text", "n_chars", F.concat_ws("/", "lang", "source").alias("key"))
    keyed_json.write_keyed_json(rows, path, "key", ["n_chars"])
    back = keyed_json.read_keyed_json(t.spark, path, "doc_id long, text string, n_chars long, key string")
    held = back.groupBy(F.replace("key", F.lit("/"), F.lit("_")).alias("key_safe")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    told = t.spark.read.text(f"{path}/metrics.json", wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<rows:bigint,n_chars:bigint>>")).alias("key_safe", "m"))
    return held.join(told.select("key_safe", F.col("m.rows").alias("told_rows"), F.col("m.n_chars").alias("told_chars")), "key_safe")


@query("merge_jsonl", "SELECT doc_id, lang FROM documents UNION ALL SELECT item_id, 'bench' FROM benchmark")
def _(t):
    a, b, out = (fresh_path(t.spark, n) for n in ("a", "b", "merged"))
    t.documents.select(F.to_json(F.struct("doc_id", "text", "lang")).alias("value")).write.text(a)
    t.benchmark.select(F.to_json(F.struct(F.col("item_id").alias("doc_id"), "text", F.lit("bench").alias("lang"))).alias("value")) \
        .unionAll(t.benchmark.select(F.lit("{broken"))).write.text(b)
    files.merge_jsonl(t.spark, [a, b], out)
    return t.spark.read.schema(JSON_SCHEMA).json(out).select("doc_id", "lang")


@query("merge_token_tables", f"""WITH {views.IDS},
parts AS (SELECT *, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS part FROM doc_ids)
SELECT row_number() OVER (ORDER BY part, doc_id) - 1 AS doc_id, part::INT AS part, len(ids)::BIGINT AS n_tokens, list_sum(ids)::BIGINT AS id_sum FROM parts""")
def _(t):
    docs = views.doc_ids(t)
    parts = [with_row_index(docs.filter(F.col("lang") == lang).select(F.col("doc_id").alias("_d"), F.col("ids").alias("tokens")), ["_d"], "doc_id").drop("_d")
             for lang in ("en", "fr", "de", "es")]
    merged = files.merge_token_tables(parts)
    total = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return merged.select("doc_id", "part", F.size("tokens").cast("bigint").alias("n_tokens"), F.when(F.size("tokens") > 0, total).alias("id_sum"))


@query("partition_input", """
WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, count(*) OVER () AS n FROM documents)
SELECT doc_id, row_idx % 7 AS robin, row_idx // ((n + 6) // 7) AS block FROM i""")
def _(t):
    docs = t.documents.select("doc_id")
    robin = rows.partition_input(docs, 7, ["doc_id"]).select("doc_id", F.col("part").alias("robin"))
    block = rows.partition_input(docs, 7, ["doc_id"], sequential=True).select("doc_id", F.col("part").alias("block"))
    return robin.join(block, "doc_id")


@query("responses_by_prompt", """
SELECT conv_id, turn // 4 AS block, array_to_string(list(text ORDER BY turn), '|') AS responses, count(*) AS n FROM conversations GROUP BY ALL""")
def _(t):
    out = files.response_rows(t.conversations, "conv_id", "turn", "text", width=4)
    path = fresh_path(t.spark, "responses")
    out.write.parquet(path)
    return t.spark.read.parquet(path).select("conv_id", "block", F.array_join("responses", "|").alias("responses"), F.size("responses").cast("bigint").alias("n"))


@query("missing_blocks", """
WITH n AS (SELECT count(*) AS n FROM embeddings),
w AS (SELECT (vec_id // 64) * 64 AS s, count(*) AS c FROM embeddings WHERE label <> 3 OR vec_id < 200 GROUP BY 1)
SELECT b.s AS block_start, least(n, b.s + 64) AS block_end FROM n, range(0, n, 64) b(s)
LEFT JOIN w ON w.s = b.s WHERE coalesce(w.c, 0) <> least(n, b.s + 64) - b.s""")
def _(t):
    written = t.embeddings.filter("label <> 3 or vec_id < 200").groupBy((F.floor(F.col("vec_id") / 64) * 64).alias("block_start")).agg(F.count("*").alias("n_rows"))
    return files.missing_blocks(t.spark, t.embeddings.count(), 64, written)


@query("select_rename_pop", "SELECT o_orderkey AS uid, o_custkey AS user_id, o_totalprice AS total, o_orderstatus AS status FROM orders")
def _(t):
    renamed = rows.rename_keys(t.orders.drop("o_orderdate"), ["o_orderkey", "o_custkey", "o_totalprice"], ["uid", "user_id", "total"])
    rest, removed = rows.pop_keys(renamed, ["o_orderstatus"], "uid")
    return rest.drop("o_orderpriority").join(rows.rename_keys(removed, ["o_orderstatus"], ["status"]), "uid")


@query("extract_path", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(t):
    return t.events.select("event_id", rows.extract_path("props", "k", json=True).try_cast("bigint").alias("k"))


def _messages(role="role", text="text"):
    return F.array(F.struct(F.lit("system").alias("role"), F.lit("Answer briefly.").alias("content")),
                   F.struct(F.col(role).alias("role"), F.col(text).alias("content")))


@query("render_chat", """
SELECT conv_id, turn, 'Answer briefly.' AS raw, 'Q: ' || text || ' A:' AS templated,
  '<|system|>' || chr(10) || 'Answer briefly.' || chr(10) || '<|' || role || '|>' || chr(10) || text || chr(10) || '<|assistant|>' || chr(10) AS chat
FROM conversations""")
def _(t):
    m = _messages()
    return t.conversations.select("conv_id", "turn", chats.render_chat(m, "raw").alias("raw"),
                                  chats.render_chat(m, "template", "Q: {prompt} A:").alias("templated"), chats.render_chat(m).alias("chat"))


@query("filter_by_prompt_length", """
SELECT conv_id, turn FROM conversations WHERE len(list_filter(string_split_regex(
  '<|system|> Answer briefly. <|' || role || '|> ' || text || ' <|assistant|>', '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) <= 60
AND len(list_filter(string_split_regex(text || ' Hint: ' || text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) <= 90""")
def _(t):
    c = t.conversations.withColumn("prompt", _messages())
    c = c.withColumn("hint", F.array(F.struct(F.lit("user").alias("role"), F.concat("text", F.lit(" Hint: "), "text").alias("content"))))
    # a rendered hint carries the two role marks as tokens of its own
    return chats.filter_by_prompt_length(
        chats.filter_by_prompt_length(c, ["prompt", "ref_prompt", "cot"], 60), ["hint"], 92).select("conv_id", "turn")


URL_SHAPE = urls.SHAPE.replace("'", "''")
EXT = "(" + "|".join(e.replace(".", r"\.") for e in urls.EXTENSIONS) + ")$"


def _url_sql(domains, suffixes):
    d = ", ".join(f"'{x}'" for x in domains)
    s = ", ".join(f"'{x}'" for x in suffixes)
    return f"""
WITH h AS (SELECT page_id, trim(url) AS u, string_split(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)', 1), '.') AS l FROM pages),
d AS (SELECT *, CASE WHEN len(l) = 1 THEN l[1] WHEN array_to_string(l[-2:], '.') IN ({s}) AND len(l) > 2 THEN l[-3] ELSE l[-2] END AS domain FROM h),
r AS (SELECT *, CASE WHEN domain IN ({d}) THEN 'domain' WHEN regexp_matches(lower(string_split(u, '?')[1]), '{EXT}') THEN 'extension'
  WHEN length(u) <= 8 THEN 'short' WHEN NOT regexp_matches(u, '{URL_SHAPE}', 'i') THEN 'malformed' END AS rule FROM d)
SELECT page_id, coalesce(rule, CASE WHEN page_id = min(page_id) OVER (PARTITION BY u, rule) THEN 'keep' ELSE 'duplicate' END) AS status FROM r"""


URL_DOMAINS = urls.DOMAINS + ["spam-farm"]
URL_SUFFIXES = urls.SUFFIXES + ["example.com", "example.net", "example.org"]


@query("url_filter", _url_sql(URL_DOMAINS, URL_SUFFIXES))
def _(t):
    return urls.url_filter(t.pages.select("page_id", "url"), "url", "page_id", URL_DOMAINS, URL_SUFFIXES).select("page_id", "status")


def _hits(lang, text="text"):
    known = ", ".join(f"'{w}'" for w in tx.STOP_WORDS[lang])
    return f"len(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}]+'), lambda w: list_contains([{known}], w)))"


IS_ENGLISH = f"({_hits('en')} > 0 AND {_hits('en')} >= greatest({_hits('fr')}, {_hits('de')}, {_hits('es')}))"


@query("is_english", f"SELECT doc_id, lang, {IS_ENGLISH} AS english FROM documents")
def _(t):
    return views.documents(t).select("doc_id", "lang", tx.is_english(F.col("text")).alias("english"))


GENERAL = "regexp_replace(text, '  +|([\\p{L}\\p{N}_])\\n+ ?', '\\1 ', 'g')"


@query("cleanup_rules", f"""
WITH r AS (SELECT *, CASE WHEN length(text) < 256 AND contains(lower(text), 'javascript') THEN 'remove_256_javascript'
  WHEN length(text) < 512 AND NOT {IS_ENGLISH} THEN 'remove_512_non_english' ELSE 'general_cleaning' END AS rule FROM documents)
SELECT doc_id, rule, starts_with(rule, 'remove') AS removed, CASE WHEN rule = 'general_cleaning' THEN {GENERAL} ELSE text END AS new_text FROM r""")
def _(t):
    return cleaning.cleanup_rules(views.documents(t), "text", ("remove_256_javascript", "remove_512_non_english", "general_cleaning")).select(
        "doc_id", "rule", "removed", "new_text")


N_BLANK = "len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))"
FIXED = "regexp_replace(regexp_replace(translate(text, '‘’“”' || chr(8232) || chr(8233), '''''\"\"' || chr(10) || chr(10)), '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
STATUS = f"""f AS (SELECT doc_id, lang, {FIXED} AS text, text <> {FIXED} AS fixed FROM documents),
s AS (SELECT *, CASE WHEN lang <> 'en' THEN 'non_english' WHEN length(text) < 1024 AND {N_BLANK} < 128 THEN 'small' ELSE 'keep' END AS status FROM f)"""


@query("cleanup_rules_repair", f"""WITH r AS (SELECT doc_id, text, CASE WHEN length(text) < 512 THEN 'remove_512' ELSE 'ftfy_fix_text' END AS rule FROM documents)
SELECT doc_id, rule, rule = 'remove_512' AS removed, CASE WHEN rule = 'remove_512' THEN text ELSE {FIXED} END AS new_text FROM r""")
def _(t):
    return cleaning.cleanup_rules(views.documents(t), "text", ("remove_512", "ftfy_fix_text")).select("doc_id", "rule", "removed", "new_text")


@query("clean_corpus", f"WITH {STATUS} SELECT doc_id, status, fixed, text FROM s")
def _(t):
    return cleaning.clean_corpus(views.documents(t), "text", english=F.col("lang") == "en").select("doc_id", "status", "fixed", "text")


def _count(name, cond):
    return f"count(*) FILTER ({cond}) AS {name}_docs, coalesce(sum(length(text)) FILTER ({cond}), 0)::BIGINT AS {name}_chars"


@query("corpus_counters", f"""WITH {STATUS} SELECT {_count('all', 'true')}, {_count('kept', "status = 'keep'")}, {_count('fixed', 'fixed')},
{_count('non_english', "status = 'non_english'")}, {_count('small', "status = 'small'")} FROM s""")
def _(t):
    return cleaning.corpus_counters(cleaning.clean_corpus(views.documents(t), "text", english=F.col("lang") == "en"), "text")


@query("add_id", "SELECT doc_id, format('corpus-{:010d}', row_number() OVER (ORDER BY doc_id)) AS adlr_id FROM documents")
def _(t):
    return rows.add_id(t.documents.select("doc_id"), "corpus", ["doc_id"])


@query("subsample", "SELECT doc_id, lang FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT (SELECT floor(count(*) * 0.3)::BIGINT FROM documents)")
def _(t):
    return rows.subsample(t.documents.select("doc_id", "lang"), 0.3, 7, "doc_id")


@query("repeat_rows", "SELECT item_id, i::INT AS sample_idx FROM benchmark, range(0, 4) r(i)")
def _(t):
    return rows.repeat_rows(t.benchmark.select("item_id"), 4)


@query("fold_rows", """WITH i AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)
SELECT p // 5 AS fold_id, array_to_string(list(o_orderkey ORDER BY p), ',') AS keys, array_to_string(list(o_orderstatus ORDER BY p), ',') AS states FROM i GROUP BY 1""")
def _(t):
    out = rows.fold(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 5, ["o_orderkey", "o_orderstatus"])
    return out.select("fold_id", joined(F.col("o_orderkey")).alias("keys"), joined(F.col("o_orderstatus")).alias("states"))


@query("unfold_rows", "SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 5 AS fold_id, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 5)::INT AS pos, o_orderkey, o_orderstatus FROM orders")
def _(t):
    cols = ["o_orderkey", "o_orderstatus"]
    return rows.unfold(rows.fold(t.orders.select(*cols), ["o_orderkey"], 5, cols), "fold_id", cols)


@query("reorder_rows", """WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders),
w AS (SELECT doc_id AS out_pos, doc_id * 37 % (SELECT count(*) FROM orders) AS p FROM documents)
SELECT out_pos, o_orderkey FROM w JOIN i USING (p)""")
def _(t):
    wanted = t.documents.select(F.col("doc_id").alias("out_pos"), (F.col("doc_id") * 37 % t.orders.count()).alias("pos"))
    return rows.reorder(t.orders.select("o_orderkey"), ["o_orderkey"], wanted)


@query("pad_to_divisor", """WITH i AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS p, count(*) OVER () AS n FROM nation)
SELECT p AS row_idx, n_name, false AS is_pad FROM i
UNION ALL SELECT n + k, n_name, true FROM i, range(0, 64) r(k) WHERE k < (64 - n % 64) % 64 AND p = k % n""")
def _(t):
    return rows.pad_to_divisor(t.nation.select("n_name", "n_nationkey"), 64, ["n_nationkey"]).drop("n_nationkey")


CLEAN = "replace(replace(replace(regexp_replace({x}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' . ', '. '), ' . ', '. '), ' . ', '. ')"


@query("sentence_pairs", f"""WITH {views.PAIRS}
SELECT * FROM (SELECT uid, {CLEAN.format(x='trim(text_a)')} AS text_a, {CLEAN.format(x='trim(text_b)')} AS text_b, CASE label WHEN 'yes' THEN 1 ELSE 0 END AS label FROM pairs)
WHERE length(text_a) > 0 AND length(text_b) > 0""")
def _(t):
    return chats.map_sentence_pairs(views.pairs(t), "uid", "text_a", "text_b", "label", {"yes": 1, "no": 0})


@query("multiple_choice", f"""
WITH q AS (SELECT item_id, unnest([0, 1]) AS question_idx, unnest(['What about _ here?', 'Which one fits']) AS q, unnest(['C', 'A']) AS a, string_split(text, ' ') AS o FROM benchmark),
c AS (SELECT *, unnest(range(0, len(o)))::INT AS choice_idx, unnest(o) AS c FROM q),
qa AS (SELECT *, CASE WHEN contains(q, '_') THEN replace(q, '_', c) ELSE q || ' ' || c END AS x FROM c)
SELECT item_id, question_idx, choice_idx, {CLEAN.format(x='x')} AS qa, (ascii(a) - 65)::INT AS label FROM qa""")
def _(t):
    options = F.split("text", " ")
    b = t.benchmark.select("item_id", F.array(F.lit("What about _ here?"), F.lit("Which one fits")).alias("questions"),
                           F.array(options, options).alias("options"), F.array(F.lit("C"), F.lit("A")).alias("answers"))
    return chats.expand_multiple_choice(b, "item_id", "questions", "options", "answers")


@query("transpose_lists", "SELECT r_name, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::INT AS pos, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    lists = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(
        F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    return rows.transpose_lists(lists.select("r_name", F.col("n.n_nationkey").alias("n_nationkey"), F.col("n.n_name").alias("n_name")), "r_name", ["n_nationkey", "n_name"])


@query("seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('11|' || doc_id), doc_id) - 1 AS pos FROM documents")
def _(t):
    return rows.seeded_order(t.documents.select("doc_id"), 11, ["doc_id"])


@query("shuffle_groups", f"WITH {views.ROLLOUTS} SELECT uid, sample_idx, row_number() OVER (ORDER BY md5('5|' || uid), uid, sample_idx) - 1 AS pos FROM rollouts")
def _(t):
    return rows.shuffle_groups(views.rollouts(t, indexed=True, only=[]), 5, "uid", ["sample_idx"])


@query("sample_generations", "SELECT conv_id, turn, text FROM conversations ORDER BY md5('42|' || text || '|' || conv_id || '|' || turn), text, conv_id, turn LIMIT 20")
def _(t):
    return rows.sample_generations(t.conversations.select("conv_id", "turn", "text"), 20, 42, ["text", "conv_id", "turn"])


@query("cycled_window", """WITH i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS row_idx, count(*) OVER () AS n FROM benchmark)
SELECT item_id, row_idx FROM i WHERE row_idx // 7 = 11 % (n // 7)""")
def _(t):
    return rows.cycled_window(t.benchmark.select("item_id"), 11, 7, ["item_id"])


@query("concat_batches", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'en'")
def _(t):
    d = t.documents.select("doc_id", "lang", "n_chars")
    return rows.concat([d.filter("lang = 'en'"), d.filter("lang <> 'en'").select("n_chars", "doc_id", "lang")])


@query("chunk_rows", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // (SELECT (count(*) + 6) // 7 FROM orders) AS chunk FROM orders")
def _(t):
    return rows.chunk_rows(t.orders.select("o_orderkey"), 7, ["o_orderkey"], strict=False).drop("row_idx")


@query("distinct_first", "SELECT page_id, page_id = min(page_id) OVER (PARTITION BY regexp_replace(url, '[?#].*$', '')) AS is_first FROM pages")
def _(t):
    return rows.first_per_key(t.pages.select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("u")), "u", "page_id").drop("u")


@query("key_difference", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return rows.difference(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


FIRST_WORD = "regexp_extract(text, '^([^ \\t\\n]*)', 1)"


@query("key_overlap", f"SELECT doc_id, {FIRST_WORD} AS topic FROM documents WHERE {FIRST_WORD} IN (SELECT {FIRST_WORD} FROM benchmark)")
def _(t):
    topic = F.regexp_extract("text", r"^([^ \t\n]*)", 1).alias("topic")
    return rows.overlap(t.documents.select("doc_id", topic), t.benchmark.select(topic), "topic")


@query("zip_columns", "SELECT o_orderkey, o_totalprice, n_lines FROM orders JOIN (SELECT o_orderkey AS k, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON k = o_orderkey")
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    b = o.join(counts, "o_orderkey", "left").withColumn("n_lines", F.coalesce("n", F.lit(0))).drop("n")
    return rows.zip_columns(o, b, "o_orderkey")


@query("attach_by_position", """
WITH a AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM conversations),
b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, replace(text || '<|endoftext|>', '<|endoftext|>', '') AS generated FROM documents)
SELECT conv_id, turn, doc_id, generated FROM a JOIN b USING (i)""")
def _(t):
    gen = t.documents.select("doc_id", F.concat("text", F.lit("<|endoftext|>")).alias("generated"))
    both = rows.attach_by_position(t.conversations.select("conv_id", "turn"), ["conv_id", "turn"], gen, ["doc_id"])
    return both.select("conv_id", "turn", "doc_id", F.replace("generated", F.lit("<|endoftext|>"), F.lit("")).alias("generated"))
