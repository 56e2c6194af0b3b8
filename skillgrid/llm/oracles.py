"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_TRIM = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH lines AS (
  SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_TRIM})")} AS k FROM lines),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o USING (k)
GROUP BY rid, doc_id
"""



def _field(e: str) -> str:
    return f"CASE WHEN {e} IS NULL THEN '-' ELSE strlen(({e})::VARCHAR) || ':' || ({e})::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(e) for e in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _walk(name: str, start: str, tree: str) -> str:
    """Levels of ``tree`` from each row of ``start`` (rid, g, pos, n, fold, proof) up to its root."""
    return f"""
{name} AS (
  SELECT rid, g, 0 AS level, pos, n, fold, proof FROM {start}
  UNION ALL
  SELECT w.rid, w.g, w.level + 1, w.pos // 2, (w.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN w.fold WHEN w.pos % 2 = 0 THEN w.fold || s.h ELSE s.h || w.fold END),
         w.proof || coalesce(s.h, '')
  FROM {name} w LEFT JOIN {tree} s ON s.g = w.g AND s.level = w.level AND s.pos = xor(w.pos, 1)
  WHERE w.n > 1)"""


def _tree(name: str, start: str) -> str:
    return f"""
{name} AS (
  SELECT g, 0 AS level, pos, h, n FROM {start}
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY g, level, pos // 2, n)"""


# crc32 by its definition: the table of the polynomial 0xEDB88320, one look-up a byte
_CRC = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)
              ORDER BY i) AS t FROM range(256) r(i))"""

OP13 = f"""
WITH RECURSIVE {_CRC},
leaves AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS leaf,
                  {_leaf("n_chars + 1")} AS forged FROM documents),
marked AS (
  SELECT *, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: xor(t[(xor(c, b) % 256 + 1)::BIGINT], c // 256))) % 7 = 0 AS tampered
  FROM leaves, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY g) AS n FROM marked),
start AS (SELECT rid, g, pos, n, leaf AS h, '' AS proof, CASE WHEN tampered THEN forged ELSE leaf END AS fold FROM placed),
{_tree("tree", "start")},
groups AS (SELECT '' AS g, g AS below, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n
           FROM tree WHERE n = 1),
{_tree("top", "groups")},
{_walk("climb", "start", "tree")},
high AS (SELECT c.rid, '' AS g, r.pos, r.n, c.fold, c.proof, r.h AS subroot
         FROM climb c JOIN groups r ON r.below = c.g WHERE c.n = 1),
{_walk("summit", "high", "top")}
SELECT p.doc_id, p.leaf, h.subroot, t.h AS root, sha256(s.proof) AS proof_sha256, s.fold AS folded_root,
       s.fold = t.h AS verified
FROM placed p JOIN high h USING (rid) JOIN summit s USING (rid), top t
WHERE s.n = 1 AND t.n = 1
"""

OP12 = """
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor, a.v AS av, a.label AS al, b.vec_id AS other, b.label AS bl,
             list_inner_product(a.v, b.v)::BIGINT AS score
      FROM a, e b WHERE NOT (a.vec_id = b.vec_id AND a.label = b.label AND a.v = b.v)),
p AS (SELECT anchor, av, al, other, score FROM s WHERE al = bl
      QUALIFY row_number() OVER (PARTITION BY anchor, av, al ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id,
       row_number() OVER (PARTITION BY p.anchor, p.av, p.al, p.other, p.score ORDER BY s.score DESC, s.other)::INTEGER AS rank,
       s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND s.av = p.av AND s.al = p.al AND s.bl <> s.al
             AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""

ORACLES = {"op1_line_dedup": OP1, "op12_hard_negatives": OP12, "op13_merkle_manifest": OP13}
