"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import string

#: Bytes of a text that one substring is taken of, as SQL scans a text for every substring.
PIECE = 256


def near_duplicates(shingle: int, percent: int) -> str:
    """Sets of word shingles, all pairs that share one, links, and the smallest id that a row reaches."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+')"
    return f"""WITH RECURSIVE words AS (SELECT doc_id, {words} AS w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) >= {shingle} THEN list_distinct(list_transform(range(1, len(w) - {shingle} + 2), lambda i: array_to_string(w[i : i + {shingle - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
 rows_ AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM sets),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM rows_ a JOIN rows_ b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n GROUP BY a.doc_id, b.doc_id),
 links AS (SELECT a, b FROM pairs WHERE 100 * common >= {percent} * (na + nb - common)), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.node WHERE r.root < w.b),
 roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
 SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, root AS component_id, root = s.doc_id AS kept FROM sets s JOIN roots r ON r.node = s.doc_id"""


def suffix_dedup(length: int) -> str:
    """Every string of `length` bytes with the smallest id that has it; what later ones cover, as runs; the bytes left."""
    return f"""WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), pieces AS (SELECT doc_id, unnest(range(0, len(h) // 2 - {length - 1}, {PIECE})) AS spot, h FROM t WHERE len(h) >= {2 * length}),
 cut AS (SELECT doc_id, spot, substr(h, 2 * spot + 1, {2 * (PIECE + length - 1)}) AS p FROM pieces), starts AS (SELECT doc_id, spot, p, unnest(range(0, len(p) // 2 - {length - 1})) AS i FROM cut),
 strings AS (SELECT doc_id, spot + i AS place, md5_number(substr(p, 2 * i + 1, {2 * length})) AS x FROM starts), first AS (SELECT x, min(doc_id) AS least FROM strings GROUP BY x HAVING min(doc_id) < max(doc_id)),
 gone AS (SELECT doc_id, place FROM strings JOIN first USING (x) WHERE least < doc_id), marked AS (SELECT doc_id, place, CASE WHEN place <= lag(place) OVER w + {length} THEN 0 ELSE 1 END AS new FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
 numbered AS (SELECT doc_id, place, sum(new) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM marked), runs AS (SELECT doc_id, run, min(place) AS a, max(place) + {length} AS b FROM numbered GROUP BY doc_id, run),
 between_ AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id UNION ALL SELECT doc_id, 0, NULL FROM t WHERE doc_id NOT IN (SELECT doc_id FROM runs)),
 kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * coalesce(b, len(h) // 2) - 2 * a), '' ORDER BY a) AS k FROM between_ JOIN t USING (doc_id) GROUP BY doc_id), removed AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM runs GROUP BY doc_id)
 SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""


def mixing(block: int, lanes: int) -> str:
    """Bytes of each source, when each of its blocks is due by the square root of them, and the earliest deadline slot by slot.

    While sources last, block i of one with weight w is due at i / w of a clock; slots tick by the weights that are left.
    """
    return f"""WITH RECURSIVE size AS (SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size FROM documents),
 sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS bytes FROM size GROUP BY source), src AS (SELECT source, bytes, sqrt(CAST(bytes AS DOUBLE)) AS w, CAST(ceil(bytes / {block}) AS BIGINT) AS blocks, row_number() OVER (ORDER BY bytes DESC, source NULLS FIRST) - 1 AS number FROM sums),
 ends AS (SELECT number, blocks / w AS clock, blocks, w FROM src), steps AS (SELECT number, clock, coalesce(sum(blocks) OVER before, 0) AS gone, (SELECT sum(w) FROM src) - coalesce(sum(w) OVER before, 0) AS rest FROM ends WINDOW before AS (ORDER BY clock, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 edges AS (SELECT s.number, unnest(range(0, s.blocks + 1)) AS i, s.w FROM src s), due AS (SELECT number, i, (SELECT round(arg_max(gone + rest * (e.i / e.w), gone), 7) FROM steps t WHERE t.clock >= e.i / e.w - 1e-12 AND t.clock = (SELECT min(clock) FROM steps u WHERE u.clock >= e.i / e.w - 1e-12)) AS due_at FROM edges e),
 block AS (SELECT a.number, a.i, floor(a.due_at) AS release, ceil(b.due_at) AS deadline FROM due a JOIN due b ON b.number = a.number AND b.i = a.i + 1),
 run(slot, number, next, won) AS (SELECT CAST(-1 AS BIGINT), number, CAST(0 AS BIGINT), false FROM src
 UNION ALL SELECT slot, number, next + CASE WHEN place = 1 THEN 1 ELSE 0 END, place = 1 FROM (SELECT r.slot + 1 AS slot, r.number, r.next, CASE WHEN b.release <= r.slot + 1 THEN row_number() OVER (ORDER BY CASE WHEN b.release <= r.slot + 1 THEN 0 ELSE 1 END, b.deadline, r.number) END AS place FROM run r LEFT JOIN block b ON b.number = r.number AND b.i = r.next WHERE r.slot + 1 < (SELECT sum(blocks) FROM src)) x),
 slots AS (SELECT number, next - 1 AS block, slot FROM run WHERE won), ranked AS (SELECT doc_id, source, size, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 15), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM size)
 SELECT r.doc_id, r.source, r.size, CAST(least(s.number, {lanes}) AS INT) AS lane, r."offset" // {block} AS block, k.slot, r."offset" FROM ranked r JOIN src s ON s.source IS NOT DISTINCT FROM r.source JOIN slots k ON k.number = s.number AND k.block = r."offset" // {block}"""
