"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from folio.llm import quality_rules as Q

EXACT_DEDUP = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS k, count(*) AS c FROM n GROUP BY t)
SELECT doc_id, k AS keep_id, c AS group_size, doc_id = k AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
spoken AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM d) GROUP BY ALL),
ranked AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM spoken),
common AS (SELECT lang, list(word ORDER BY word) AS ref FROM ranked WHERE r <= {Q.COMMON_WORDS} GROUP BY lang),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM win) WHERE k > 1),
again AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (SELECT d.doc_id, d.lang AS ref_lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    (SELECT len(l) - len(list_distinct(l)) FROM (SELECT list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l)) AS n_dup_lines,
    coalesce(again.n, 0) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper_, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digit_,
    length(text) - length(regexp_replace(text, '[!-/:-@\[-`{{-~]', '', 'g')) AS marks_, strlen(text) - length(text) AS wide_, length(text) AS chars_,
    list_transform(coalesce(k.ref, []), lambda r: len(list_filter(w, lambda x: x = r))) AS hits
  FROM d LEFT JOIN common k ON k.lang IS NOT DISTINCT FROM d.lang LEFT JOIN again USING (doc_id)),
h AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT} * n_words AS base_failed,
    [upper_, greatest(0, chars_ - upper_ - digit_ - marks_ - (chars_ - word_chars) - wide_), digit_, chars_ - word_chars, marks_ - n_symbols, n_symbols, wide_] AS c,
    list_append(hits, n_words - coalesce(list_sum(hits), 0)) AS t FROM m),
cell AS (SELECT doc_id, ref_lang, base_failed, 0 AS kind, unnest(c)::DOUBLE AS v, generate_subscripts(c, 1) AS k FROM h
  UNION ALL SELECT doc_id, ref_lang, base_failed, 1, unnest(t)::DOUBLE, generate_subscripts(t, 1) FROM h),
ref AS (SELECT ref_lang, kind, k, sum(v) AS v FROM cell WHERE NOT base_failed GROUP BY ALL),
part AS (SELECT c.doc_id, c.kind, c.v / sum(c.v) OVER (PARTITION BY c.doc_id, c.kind) AS p, r.v / sum(r.v) OVER (PARTITION BY c.doc_id, c.kind) AS q FROM cell c LEFT JOIN ref r ON r.ref_lang IS NOT DISTINCT FROM c.ref_lang AND r.kind = c.kind AND r.k = c.k),
dist AS (SELECT doc_id, kind, sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS x FROM part GROUP BY ALL)
SELECT h.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {Q.TEST_MIN_WORDS} AND (coalesce(a.x, 0) > {Q.MAX_CHAR_DISTANCE} OR coalesce(b.x, 0) > {Q.WORD_DISTANCE} + {Q.WORD_NOISE} / sqrt(n_words))) AS kept
FROM h LEFT JOIN dist a ON a.doc_id = h.doc_id AND a.kind = 0 LEFT JOIN dist b ON b.doc_id = h.doc_id AND b.kind = 1
"""

#: crc32 of a text's UTF-8 bytes: the reflected polynomial, bit by bit.
_BITS = "list_reduce(list_prepend(xor(c, b), range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
_BYTES = "list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)".format
CRC32 = lambda x: f"xor(list_reduce(list_prepend(4294967295, {_BYTES(x)}), lambda c, b: {_BITS}), 4294967295)"

_CANONICAL = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')".format
_LEAF = lambda chars: "sha256(" + " || ".join(map(_CANONICAL, ("doc_id", "source", "lang", chars, "text"))) + ")"
_NEXT = "list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))"

MERKLE_MANIFEST = f"""WITH RECURSIVE leaf AS (SELECT doc_id, lang, {_LEAF('n_chars')} AS leaf, CASE WHEN {CRC32('doc_id::VARCHAR')} % 7 = 0 THEN {_LEAF('(n_chars + 1)')} ELSE {_LEAF('n_chars')} END AS claim FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i FROM leaf),
level AS (SELECT lang, 0 AS lv, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY lang
  UNION ALL SELECT lang, lv + 1, {_NEXT} FROM level WHERE len(nodes) > 1),
sub AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM level WHERE len(nodes) = 1),
upper AS (SELECT 0 AS lv, list(subroot ORDER BY i) AS nodes FROM sub UNION ALL SELECT lv + 1, {_NEXT} FROM upper WHERE len(nodes) > 1),
lpath AS (SELECT p.doc_id, p.leaf, 0 AS tree, l.lv, (p.i >> l.lv) AS k, l.nodes FROM placed p JOIN level l ON l.lang IS NOT DISTINCT FROM p.lang AND len(l.nodes) > 1),
upath AS (SELECT p.doc_id, p.leaf, 1 AS tree, u.lv, (s.i >> u.lv) AS k, u.nodes FROM placed p JOIN sub s ON s.lang IS NOT DISTINCT FROM p.lang JOIN upper u ON len(u.nodes) > 1),
steps AS (SELECT doc_id, leaf, k, nodes[xor(k, 1) + 1] AS sibling, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY tree, lv) AS n FROM (SELECT * FROM lpath UNION ALL SELECT * FROM upath)),
proofs AS (SELECT doc_id, leaf, sha256(coalesce(string_agg(sibling, '' ORDER BY n), '')) AS proof FROM steps GROUP BY ALL),
folding AS (SELECT doc_id, leaf, claim AS node, 0 AS n FROM placed
  UNION ALL SELECT f.doc_id, f.leaf, sha256(CASE WHEN s.sibling IS NULL THEN f.node WHEN s.k % 2 = 0 THEN f.node || s.sibling ELSE s.sibling || f.node END), s.n FROM folding f JOIN steps s ON s.doc_id = f.doc_id AND s.leaf = f.leaf AND s.n = f.n + 1),
folded AS (SELECT doc_id, leaf, arg_max(node, n) AS folded_root FROM folding GROUP BY ALL)
SELECT p.doc_id, p.leaf, subroot, nodes[1] AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = nodes[1] AS verified
FROM placed p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang JOIN upper ON len(nodes) = 1 JOIN folded f ON f.doc_id = p.doc_id AND f.leaf = p.leaf LEFT JOIN proofs x ON x.doc_id = p.doc_id AND x.leaf = p.leaf"""

SPELLING = f"""WITH RECURSIVE run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS c FROM run GROUP BY ALL),
hashed AS (SELECT *, {CRC32("(doc_id || ':' || run)")} AS h FROM own),
word AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 5 GROUP BY ALL HAVING sum(c) >= 3),
cut AS (SELECT word, n, unnest(range(length(word))) AS lv FROM word),
short AS (SELECT word, n, lv, substr(word, 1, lv) || substr(word, lv + 2) AS key FROM cut),
pair AS (SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM short a JOIN short b ON a.key = b.key AND a.lv = b.lv AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM word a JOIN short b ON a.word = b.key UNION SELECT b.word, b.n, a.word, a.n FROM word a JOIN short b ON a.word = b.key),
best AS (SELECT a, an, count(*) AS n_near, arg_min(b, (-bn, encode(b))) AS b, max(bn) AS bn FROM pair GROUP BY ALL),
form AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * n THEN b END AS form, CASE WHEN bn >= 2 * n THEN bn END AS form_n FROM word LEFT JOIN best ON a = word),
chain AS (SELECT word, word AS root, form AS next, 0 AS d FROM form UNION ALL SELECT c.word, f.word, f.form, d + 1 FROM chain c JOIN form f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM form f JOIN (SELECT word, arg_max(root, d) AS root FROM chain GROUP BY ALL) c ON c.word = f.word"""
