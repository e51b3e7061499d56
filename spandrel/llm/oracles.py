"""SQL for DuckDB with the results of those operators that SQL can express."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), q AS (SELECT page_id, strlen(body) AS n, sha1(body) AS d FROM p),
 m AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS last FROM q)
 SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to FROM m"""

_REACH = """, r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)"""

OP4 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
 l(a, b) AS (SELECT x.vec_id, y.vec_id FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98){_REACH},
 n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), c AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
 SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""

OP7 = """WITH RECURSIVE t(n, k, v) AS (SELECT i, 0, i FROM range(256) x(i) UNION ALL SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM t WHERE k < 8),
 crc AS (SELECT list(v ORDER BY n) AS t FROM t WHERE k = 8),
 d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
 e AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(h, lambda x: (16 * (instr('0123456789ABCDEF', x[1]) - 1) + instr('0123456789ABCDEF', x[2]) - 1)::BIGINT)),
  lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::INT]))) AS text_crc32 FROM d, crc),
 w AS (SELECT doc_id, arg_max(s, md5(doc_id || ':' || s)) AS shard FROM documents, range(16) x(s) GROUP BY doc_id), g AS (SELECT doc_id, arg_max(s, md5(doc_id || ':' || s)) AS shard FROM documents, range(17) x(s) GROUP BY doc_id)
 SELECT doc_id, size, text_crc32, 'key' AS law, w.shard::INT AS shard, row_number() OVER (PARTITION BY w.shard ORDER BY md5(doc_id::VARCHAR), doc_id, size, text_crc32) - 1 AS slot, g.shard::INT AS grown_shard
 FROM e JOIN w USING (doc_id) JOIN g USING (doc_id)"""

OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, range(1, greatest(2, len(w) - 2)) x(i) WHERE len(w) > 0 AND i <= greatest(1, len(w) - 4)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
 l(a, b) AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)){_REACH}, c AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
 SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id"""

_WORDS = f"regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w"

OP10 = f"""WITH b AS (SELECT item_id, {_WORDS} FROM benchmark WHERE item_id IS NOT NULL), d AS (SELECT doc_id, {_WORDS} FROM documents),
 bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
 ks AS (SELECT DISTINCT k FROM bw), dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), ks WHERE i <= len(w) - k + 1),
 h AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, g)), m AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)"""

_CRC_TABLE = """t(n, k, v) AS (SELECT i, 0, i FROM range(256) x(i) UNION ALL SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM t WHERE k < 8),
 crc AS (SELECT list(v ORDER BY n) AS t FROM t WHERE k = 8)"""


def _crc(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, with the table t of crc."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: (16 * (instr('0123456789ABCDEF', x[1]) - 1) + instr('0123456789ABCDEF', x[2]) - 1)::BIGINT)),
  lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::INT])))"""


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"


#: Nodes i to i + 2 of each level become one; a fold goes up from a leaf with the others of its run.
_UP = "list_transform(range(0, len(v), 3), lambda i: sha256(array_to_string(v[i + 1:i + 3], '')))"

OP13 = f"""WITH RECURSIVE {_CRC_TABLE},
 d AS (SELECT doc_id, source, {" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))} AS head, text, CASE WHEN {_crc("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents, crc),
 l AS (SELECT doc_id, source, sha256(head || {_field("text")}) AS leaf, sha256(head || {_field("changed")}) AS now FROM d),
 p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
 s(source, k, v) AS (SELECT source, 0, list(leaf ORDER BY i) FROM p GROUP BY source UNION ALL SELECT source, k + 1, {_UP} FROM s WHERE len(v) > 1),
 r AS (SELECT source, k AS h, v[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM s WHERE len(v) = 1),
 z(k, v) AS (SELECT 0, list(subroot ORDER BY i) FROM r UNION ALL SELECT k + 1, {_UP} FROM z WHERE len(v) > 1),
 w AS (SELECT false AS top, source, k, v FROM s UNION ALL SELECT true, NULL, k, v FROM z),
 a(doc_id, source, leaf, top, i, k, own, proof) AS (SELECT doc_id, source, leaf, false, i, 0, now, '' FROM p
  UNION ALL SELECT doc_id, source, leaf, top OR NOT up, CASE WHEN up THEN i // 3 ELSE j END, CASE WHEN up THEN k + 1 ELSE 0 END, CASE WHEN up THEN sha256(x || own || y) ELSE own END, CASE WHEN up THEN proof || x || y ELSE proof END
  FROM (SELECT a.*, r.i AS j, len(v) > 1 AS up, array_to_string(v[a.i - a.i % 3 + 1:a.i], '') AS x, array_to_string(v[a.i + 2:a.i - a.i % 3 + 3], '') AS y
   FROM a JOIN r ON r.source IS NOT DISTINCT FROM a.source JOIN w ON w.top = a.top AND w.k = a.k AND (a.top OR w.source IS NOT DISTINCT FROM a.source) WHERE NOT a.top OR len(v) > 1)),
 g AS (SELECT k, v[1] AS root FROM z WHERE len(v) = 1)
 SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified FROM a JOIN g ON top AND a.k = g.k JOIN r ON r.source IS NOT DISTINCT FROM a.source"""

#: The state behind each of start, system, user, assistant (1 to 4) by a forced step, and behind a turn that is kept (0: none).
_NEXT = "[3, 3, 4, 3]"
_KEPT = "CASE f.h WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END"


def _way(letter: str, state: str, cost: str) -> str:
    return f"{{'c': b[{state}].c + {cost}, 'a': '{letter}' || b[{state}].a}}"


_LEAST = "list_transform([1, 2, 3, 4], lambda q: list_sort([b[q], {'c': b[[3, 3, 4, 3][q]].c + 2, 'a': 'I' || b[[3, 3, 4, 3][q]].a}])[1])"

OP12 = f"""WITH RECURSIVE {_CRC_TABLE},
 o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS r FROM conversations, crc),
 d AS (SELECT conv_id, turn, CASE WHEN r = 4 THEN 'user' ELSE role END AS role, CASE r WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM o, range(2) x(k) WHERE r <> 0 AND (k = 0 OR r = 3)),
 p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS i FROM d),
 f AS (SELECT *, role[1] AS h, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'k' ELSE 't' END AS c, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS two FROM p),
 n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (c = 'b') AS blank, count(*) FILTER (c = 'd') AS duplicate, count(*) FILTER (c = 't') AS truncated,
  count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
 s(conv_id, i, b) AS (SELECT conv_id, n, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 4::BIGINT, 'a': 'II'}}, {{'c': 2::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}}] FROM n
  UNION ALL SELECT conv_id, i, {_LEAST} FROM (SELECT conv_id, i, {_LEAST} AS b FROM (
   SELECT s.conv_id, f.i, list_transform([1, 2, 3, 4], lambda q: list_sort(list_filter([{_way("D", "q", "3")}, CASE WHEN f.c IN ('k', 't') THEN {_way("R", _NEXT + "[q]", "2 + (f.c = 't')::BIGINT")} END,
    CASE WHEN f.c IN ('k', 't') AND ({_KEPT})[q] > 0 THEN {_way("K", f"({_KEPT})[q]", "(f.c = 't')::BIGINT")} END], lambda x: x IS NOT NULL))[1]) AS b
   FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i - 1))),
 a AS (SELECT conv_id, b[1].c AS cost, b[1].a AS audit FROM s WHERE i = 0),
 w(conv_id, audit, j, i, q, lines) AS (SELECT conv_id, audit, 1, 0, 1, []::VARCHAR[] FROM a
  UNION ALL SELECT w.conv_id, audit, j + 1, CASE audit[j] WHEN 'I' THEN w.i ELSE w.i + 1 END, CASE audit[j] WHEN 'D' THEN q WHEN 'K' THEN ({_KEPT})[q] ELSE {_NEXT}[q] END,
   CASE audit[j] WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, f.role || ':' || f.text) ELSE list_append(lines, CASE {_NEXT}[q] WHEN 3 THEN 'user' ELSE 'assistant' END || ':' || CASE audit[j] WHEN 'R' THEN f.text ELSE '' END) END
   FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i WHERE j <= len(audit)),
 z AS (SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS sha FROM w WHERE j = len(audit) + 1)
 SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM x.conv_id"""
