"""Oracle SQL of the operators that SQL can express."""

from __future__ import annotations

CHAT = """
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM d),
l AS (SELECT *, CASE WHEN role IS NULL THEN 'n' ELSE 'v' || md5(role) END || CASE WHEN text IS NULL THEN 'n' ELSE 'v' || md5(text) END AS h FROM t),
p AS (SELECT conv_id, n, string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY n) AS prefix, COUNT(*) OVER (PARTITION BY conv_id) AS n_turns FROM l),
inner_ AS (SELECT DISTINCT prefix FROM p WHERE n < n_turns),
kept AS (SELECT MIN(conv_id) AS conv_id, n_turns FROM p WHERE n = n_turns AND prefix NOT IN (SELECT prefix FROM inner_) GROUP BY prefix, n_turns)
SELECT conv_id, (n - 1) // 256 AS segment, n_turns, MIN(n) AS first_turn, COUNT(*) AS turns,
  string_agg('<|im_start|>' || COALESCE(role, 'unknown') || chr(10) || COALESCE(text, '') || '<|im_end|>' || chr(10), '' ORDER BY n) AS text
FROM t JOIN kept USING (conv_id) GROUP BY conv_id, segment, n_turns
"""

NEAR_DUPLICATES = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, UNNEST(list_transform(s, lambda x: hash(x))) AS h, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * COUNT(*) >= 75 * (ANY_VALUE(a.n) + ANY_VALUE(b.n) - COUNT(*))),
g AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.id WHERE r.c < g.b),
m AS (SELECT id, MIN(c) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON m.id = s.doc_id
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.95),
g AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
n AS (SELECT a AS id, COUNT(*) AS n FROM g GROUP BY a),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.id WHERE r.c < g.b),
m AS (SELECT id, MIN(c) AS component_id FROM r GROUP BY id)
SELECT vec_id, COALESCE(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON m.id = vec_id LEFT JOIN n ON n.id = vec_id
"""

#: CTE of the crc32 of each byte, made by its rule.
_CRC_TABLE = """tab AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT UNNEST(range(0, 256)) AS i)))"""


def _crc(text: str) -> str:
    """SQL of the unsigned crc32 of ``text`` in UTF-8; ``tab`` must be joined."""
    bytes_ = f"list_transform(range(0, octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), (2 * k + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, t[xor(c, b) & 255 + 1]), 4294967295), 4294967295)".replace("xor(c, b) & 255 + 1", "(xor(c, b) & 255) + 1")


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"COALESCE(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


MANIFEST = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_crc("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS now FROM documents, tab),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
l AS (SELECT source, 0 AS level, list(leaf ORDER BY i) AS nodes FROM p GROUP BY source
  UNION ALL SELECT source, level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[(3 * k + 1)::INT:(3 * k + 3)::INT], ''))) FROM l WHERE len(nodes) > 1),
s AS (SELECT source, level AS height, nodes[1] AS subroot, ROW_NUMBER() OVER (ORDER BY source NULLS FIRST) - 1 AS j FROM l WHERE len(nodes) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY j) AS nodes FROM s
  UNION ALL SELECT level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[(3 * k + 1)::INT:(3 * k + 3)::INT], ''))) FROM u WHERE len(nodes) > 1),
r AS (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1),
w AS (SELECT p.doc_id, p.i AS uid, p.source, l.level, (p.i // pow(3, l.level)::BIGINT) AS q, l.nodes FROM p JOIN l ON l.source IS NOT DISTINCT FROM p.source WHERE len(l.nodes) > 1
  UNION ALL SELECT p.doc_id, p.i, p.source, s.height + u.level, (s.j // pow(3, u.level)::BIGINT), u.nodes FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN u WHERE len(u.nodes) > 1),
g AS (SELECT doc_id, uid, source, list({{'l': array_to_string(nodes[((q // 3) * 3 + 1)::INT:q::INT], ''), 'r': array_to_string(nodes[(q + 2)::INT:((q // 3) * 3 + 3)::INT], '')}} ORDER BY level) AS path FROM w GROUP BY doc_id, uid, source),
f AS (SELECT p.doc_id, p.leaf, s.subroot, r.root, COALESCE(path, []) AS path, p.now FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN r
  LEFT JOIN g ON g.uid = p.i AND g.source IS NOT DISTINCT FROM p.source AND g.doc_id IS NOT DISTINCT FROM p.doc_id),
z AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
  list_reduce(path, lambda a, x: {{'l': '', 'r': sha256(x.l || a.r || x.r)}}, {{'l': '', 'r': now}}).r AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM z
"""

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
a AS (SELECT COALESCE(doc_id::VARCHAR, '') AS id, UNNEST(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
b AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM a WHERE length(run) >= 7),
h AS (SELECT run, {_crc("(id || ':' || run)")} AS h FROM b, tab),
v AS (SELECT w AS word, COUNT(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN run[1:(h % length(run))::INT] || substr(run, (h % length(run) + 2)::INT) ELSE run END AS w FROM h) WHERE length(w) >= 7 GROUP BY w HAVING COUNT(*) >= 2),
k AS (SELECT word, n, UNNEST(range(1, length(word) + 1)) AS i FROM v),
x AS (SELECT word, n, substr(word, 1, (i - 1)::INT) || chr(1) || substr(word, (i + 1)::INT) AS open, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS shorter FROM k),
e AS (SELECT DISTINCT x.word AS a, v.word AS b FROM x JOIN v ON v.word = x.shorter),
g AS (SELECT x.word AS a, y.word AS b FROM x JOIN x y ON x.open = y.open AND x.word <> y.word UNION ALL SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT a AS word, COUNT(*) AS n_near, arg_min(b, (-v.n, b)) AS best, MAX(v.n) AS best_n FROM g JOIN v ON v.word = g.b GROUP BY a),
f AS (SELECT v.word, v.n, COALESCE(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM v LEFT JOIN c USING (word)),
r AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM r JOIN f ON f.form = r.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r USING (word)
"""
