"""SQL forms of the operators that have one, for comparison on small tables."""

from __future__ import annotations

LOW = "translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"'[^\x20\x09-\x0D]+'"


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, bit by bit."""
    octets = f"list_transform(range(1, length(hex(encode({text}))) // 2 + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    step = "list_reduce(list_concat([xor(a, o)], range(8)), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda a, o: {step}), 4294967295)"


PREFIX_TRIE = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 20 AS base, {crc32('c::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, 0 AS own, t.* EXCLUDE (c) FROM h JOIN t ON t.c = h.base AND t.i < h.h UNION ALL SELECT h.c, 1, t.* EXCLUDE (c) FROM h JOIN t ON t.c = h.c AND t.i >= h.h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS depth, md5(length(role)::VARCHAR || ':' || role || text) AS m, len(regexp_extract_all(text, {WORDS})) AS words FROM r),
p AS (SELECT c, depth, words, md5(string_agg(m, '') OVER (PARTITION BY c ORDER BY depth)) AS node FROM d UNION ALL SELECT c, 0, 0, '' FROM h),
ends AS (SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(node, depth) AS node FROM p GROUP BY c) GROUP BY node),
n AS (SELECT node, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY node),
u AS (SELECT n.node, n.conv_id, n.depth, n.n_convs, n.words, q.node AS parent FROM n LEFT JOIN p q ON q.c = n.conv_id AND q.depth = n.depth - 1),
k AS (SELECT parent AS node, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY 1),
s AS (SELECT a.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved FROM u LEFT JOIN k ON k.node = u.node JOIN p a ON a.c = u.conv_id AND a.depth <= u.depth GROUP BY a.node)
SELECT u.conv_id, u.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, u.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM u JOIN s USING (node) LEFT JOIN k ON k.node = u.node LEFT JOIN ends ON ends.node = u.node LEFT JOIN n up ON up.node = u.parent"""

SPELLING_VARIANTS = f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({LOW.format(x='text')}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT run, n, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL)),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM c)
  GROUP BY word HAVING sum(n) >= 5 AND length(word) >= 6),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.cut UNION SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.cut),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, coalesce(form, word) AS root, 1 AS step FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word) USING (word)"""

NGRAM_JACCARD = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOW.format(x='text')}, {WORDS}) AS w FROM documents),
s AS (SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
m AS (SELECT rid, doc_id, len(s) AS n, s, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, '|')) END AS k FROM s),
c AS (SELECT k, any_value(n) AS n, any_value(s) AS s, min(doc_id) AS low FROM m WHERE k IS NOT NULL GROUP BY k),
e AS (SELECT k, n, hash(unnest(s)) AS g FROM c),
x AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS x FROM e a JOIN e b ON a.g = b.g AND a.k < b.k AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY ALL),
l AS (SELECT a, b FROM x WHERE 100 * x >= 85 * (na + nb - x)),
two AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
walk AS (SELECT k AS node, k AS seen FROM c UNION SELECT walk.node, two.b FROM walk JOIN two ON two.a = walk.seen),
root AS (SELECT node AS k, min(low) AS component_id FROM walk JOIN c ON c.k = walk.seen GROUP BY node)
SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id FROM m LEFT JOIN root USING (k)"""
