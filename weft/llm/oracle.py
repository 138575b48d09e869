"""DuckDB SQL for the operators of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

import re

OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM r
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT DISTINCT rid, array_to_string(w[i : i + 4], ' ') AS gram
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
named AS (SELECT rid, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS name FROM g GROUP BY rid),
sets AS (SELECT name, min(rid) AS rid, any_value(n) AS n FROM named GROUP BY name),
held AS MATERIALIZED (SELECT s.rid, s.n, md5_number(g.gram) AS gram FROM sets s JOIN g USING (rid)),
links AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b
  FROM held a JOIN held b ON a.gram = b.gram AND a.rid <> b.rid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rid, b.rid, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT rid AS node, rid AS seen FROM sets UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
ids AS (SELECT n.name, min(d.doc_id) AS least_id FROM named n JOIN d USING (rid) GROUP BY n.name),
component AS (
  SELECT s.name, min(i.least_id) AS component_id
  FROM sets s JOIN reach r ON r.node = s.rid JOIN sets o ON o.rid = r.seen JOIN ids i ON i.name = o.name GROUP BY s.name)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE c.component_id END AS component_id
FROM d LEFT JOIN named n USING (rid) LEFT JOIN component c USING (name)
"""

OP9 = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    coalesce(md5(doc_id::VARCHAR), '') AS mark
  FROM documents),
s AS (
  SELECT skey, sum(size)::BIGINT AS words, min(size) FILTER (size > 0) AS least, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY skey),
levelled AS (
  SELECT *, words * 2.0::DOUBLE AS most,
    (1.5::DOUBLE * (sum(words) OVER ())::DOUBLE - coalesce(sum(words * 2.0::DOUBLE) OVER below, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER below, 0.0)) AS level
  FROM s WINDOW below AS (ORDER BY words * 2.0::DOUBLE / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, (most / w, skey)) AS level FROM levelled WHERE level * w <= most),
wanted AS MATERIALIZED (SELECT skey, words, least, least(most, coalesce((SELECT level FROM chosen), 'inf'::DOUBLE) * w) AS target FROM levelled),
lengths AS MATERIALIZED (SELECT skey, size, count(*) AS docs FROM d GROUP BY ALL),
halved AS (
  SELECT skey, target, -60.0::DOUBLE / least AS low, ln(2.0::DOUBLE) / least AS high, 0 AS i FROM wanted WHERE words > 0 AND target < 2 * words
  UNION ALL
  SELECT skey, target, CASE WHEN got > target THEN low ELSE (low + high) / 2 END, CASE WHEN got > target THEN (low + high) / 2 ELSE high END, i + 1
  FROM (
    SELECT h.skey, target, low, high, i, sum(size * docs * exp(least((low + high) / 2 * size, ln(2.0::DOUBLE)))) AS got
    FROM halved h JOIN lengths l ON l.skey = h.skey AND size > 0 WHERE i < 90 GROUP BY ALL)),
rated AS (
  SELECT *, row_number() OVER down AS pos, coalesce(sum(size * docs * rate) OVER below, 0)::HUGEINT AS rest, coalesce(sum(size * docs) OVER below, 0)::HUGEINT * 2000000000 AS room
  FROM (
    SELECT l.skey, size, docs, wanted.target, CASE WHEN h.skey IS NULL THEN 2000000000 ELSE floor(exp(least((low + high) / 2 * size, ln(2.0::DOUBLE))) * 1e9 + 0.5) END::HUGEINT AS rate
    FROM lengths l JOIN wanted ON wanted.skey = l.skey LEFT JOIN halved h ON h.skey = l.skey AND i = 90 WHERE size > 0)
  WINDOW down AS (PARTITION BY skey ORDER BY size DESC), below AS (PARTITION BY skey ORDER BY size DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
walk AS (
  SELECT skey, 0::BIGINT AS pos, NULL::BIGINT AS size, NULL::BIGINT AS copies, (round(any_value(target) * 1e9)::HUGEINT - sum(size * docs * rate))::HUGEINT AS carry FROM rated GROUP BY skey
  UNION ALL
  SELECT skey, pos, size, copies::BIGINT, ask - copies * unit
  FROM (
    SELECT *, least(2 * docs, greatest(0, least(greatest(FLOORDIV(2 * ask + unit, 2 * unit), -FLOORDIV(room - rest - ask, unit)), FLOORDIV(ask + rest, unit))))::HUGEINT AS copies
    FROM (SELECT w.skey, r.pos, r.size, docs, rest, room, r.size * 1000000000::HUGEINT AS unit, (r.size * docs * rate + carry)::HUGEINT AS ask FROM walk w JOIN rated r ON r.skey = w.skey AND r.pos = w.pos + 1))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY skey, size ORDER BY mark, doc_id) AS nth, count(*) OVER (PARTITION BY skey, size) AS docs FROM d)
SELECT doc_id, size, words AS source_size, target, (((nth * copies) // docs - ((nth - 1) * copies) // docs) * size)::BIGINT AS taken
FROM (SELECT r.*, words, target, coalesce(copies, r.docs) AS copies FROM ranked r JOIN wanted ON wanted.skey = r.skey LEFT JOIN walk k ON k.skey = r.skey AND k.size = r.size)
"""

#: // of whole numbers cuts off towards zero.
OP9 = re.sub(r"FLOORDIV\(([^,()]+), ([^,()]+)\)", r"(CASE WHEN \1 < 0 THEN -((\2 - 1 - (\1)) // (\2)) ELSE (\1) // (\2) END)", OP9)

OP10 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
pieces AS (SELECT rid, n, lo, substr(h, 2 * lo + 1, 910) AS piece FROM (SELECT rid, n, h, unnest(range(0, n - 199, 256)) AS lo FROM d)),
windows AS (SELECT rid, lo + j AS p, md5_number(substr(piece, 2 * j + 1, 400)) AS m FROM (SELECT *, unnest(range(0, least(256, n - 199 - lo))) AS j FROM pieces)),
twice AS (SELECT m FROM windows GROUP BY m HAVING count(*) > 1),
found AS (SELECT rid, p FROM windows SEMI JOIN twice USING (m)),
opened AS (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM found),
run AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM opened),
spans AS (SELECT rid, k, min(p) AS s, max(p) + 200 AS e FROM run GROUP BY rid, k),
stops AS (SELECT rid, s, e FROM spans UNION ALL SELECT rid, n, n FROM d),
kept AS (
  SELECT rid, string_agg(substr(h, 2 * past + 1, 2 * (s - past)), '' ORDER BY s, e) AS k
  FROM (SELECT t.rid, s, e, h, coalesce(lag(e) OVER (PARTITION BY t.rid ORDER BY s, e), 0) AS past FROM stops t JOIN d USING (rid)) GROUP BY rid),
counts AS (SELECT rid, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (rid) LEFT JOIN counts USING (rid)
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
items AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
postings AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) GROUP BY rid, term),
whole AS (SELECT count(DISTINCT rid) AS n_docs, sum(tf)::BIGINT AS total FROM postings),
spread AS (SELECT rid, 50 + (50 * sum(tf)::BIGINT * n_docs) // total AS m FROM postings, whole GROUP BY rid, n_docs, total),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term, n_docs),
asked AS (SELECT DISTINCT q, term FROM (SELECT q, unnest(terms) AS term FROM items)),
scored AS (SELECT q, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN spread USING (rid) GROUP BY q, rid),
ranked AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (q) WHERE rank <= 50
"""

SQL = {"op3_warc": OP3, "op5_ngram_jaccard": OP5, "op9_source_mixing": OP9, "op10_suffix_dedup": OP10, "op12_ranked_search": OP12}
