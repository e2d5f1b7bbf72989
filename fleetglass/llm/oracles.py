"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

LINES = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (c.last IS NOT NULL AND k.doc_id < c.last) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (c.last IS NULL OR k.doc_id >= c.last), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c USING (key)
GROUP BY k.doc_id
"""


MERKLE = r"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source,
         sha256(concat(coalesce(concat(strlen(doc_id::VARCHAR), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
                       coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(n_chars::VARCHAR), ':', n_chars), '-'),
                       coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
         sha256(concat(coalesce(concat(strlen(doc_id::VARCHAR), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
                       coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(n_chars::VARCHAR), ':', n_chars), '-'),
                       coalesce(concat(strlen(text), ':', translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '-'))) AS lowered,
         -- CRC-32 of the decimal digits: a byte in, eight shifts
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(d)::BIGINT FOR d IN string_split(doc_id::VARCHAR, '')]),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT FOR k IN range(8)]),
             lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i FROM leaves),
nodes AS (
  SELECT source, 0 AS level, i, leaf AS hash, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT source, level + 1, i // 16, sha256(string_agg(hash, '' ORDER BY i)), (any_value(n) + 15) // 16
  FROM nodes WHERE n > 1 GROUP BY source, level, i // 16),
subroots AS (
  SELECT source, hash, row_number() OVER (ORDER BY source IS NOT NULL, encode(coalesce(source, ''))) - 1 AS i, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, i, hash, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(hash, '' ORDER BY i)), (any_value(n) + 15) // 16
  FROM upper WHERE n > 1 GROUP BY level, i // 16),
runs AS (
  SELECT source, false AS above, level, i // 16 AS run, list(hash ORDER BY i) AS hashes FROM nodes WHERE n > 1 GROUP BY source, level, i // 16
  UNION ALL
  SELECT NULL, true, level, i // 16, list(hash ORDER BY i) FROM upper WHERE n > 1 GROUP BY level, i // 16),
paths AS (
  SELECT p.doc_id, p.leaf, p.source, s.hash AS subroot, s.i AS tree, false AS above, 0 AS level, p.i, '' AS proof,
         CASE WHEN p.crc % 5 = 0 THEN p.lowered ELSE p.leaf END AS folded, false AS done
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT p.doc_id, p.leaf, p.source, p.subroot, p.tree, p.above OR r.run IS NULL, CASE WHEN r.run IS NULL THEN 0 ELSE p.level + 1 END,
         CASE WHEN r.run IS NULL THEN p.tree ELSE p.i // 16 END,
         concat(p.proof, array_to_string(r.hashes[:p.i % 16], ''), array_to_string(r.hashes[p.i % 16 + 2:], '')),
         CASE WHEN r.run IS NULL THEN p.folded ELSE sha256(concat(array_to_string(r.hashes[:p.i % 16], ''), p.folded, array_to_string(r.hashes[p.i % 16 + 2:], ''))) END,
         p.above AND r.run IS NULL
  FROM paths p LEFT JOIN runs r ON r.above = p.above AND (p.above OR r.source IS NOT DISTINCT FROM p.source) AND r.level = p.level AND r.run = p.i // 16
  WHERE NOT p.done)
SELECT doc_id, leaf, subroot, u.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.hash AS verified
FROM paths JOIN (SELECT hash FROM upper WHERE n = 1) u ON true WHERE done
"""

SEARCH = r"""
WITH dt AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY term),
norms AS (SELECT doc_id, 100 - 75 + (75 * n * n_docs) // n_terms AS m FROM lengths, corpus),
it AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS repeats FROM it GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def similar(width: int, percent: int, columns: str) -> str:
    """Components of documents whose sets of ``width``-word shingles share ``percent`` of their union; ``columns`` of doc_id, n, component."""
    return rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
                                 ELSE [array_to_string(w[k:k + {width - 1}], ' ') FOR k IN range(1, len(w) - {width - 2})] END) AS s
  FROM worded),
sizes AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= {percent} * (p.n + q.n - count(*))),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other),
found AS (SELECT doc_id, min(other) AS component FROM reached GROUP BY doc_id)
SELECT {columns} FROM sizes JOIN found USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": LINES,
        "op4_near_dedup": similar(5, 75, "doc_id, n AS n_shingles, component AS component_id, doc_id = component AS kept"),
        "op11_merkle_manifest": MERKLE,
        "op12_ranked_search": SEARCH,
        "op13_jaccard_join": similar(4, 85, "doc_id, n AS n_shingles, component AS component_id"),
    }
