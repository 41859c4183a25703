"""SQL for the corpus queries that SQL can express, in DuckDB's dialect."""

_PLAIN = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A SHA-1 is eight runs of 20 bits, each four signs of base 32.
OP3 = r"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, cast(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((cast('0x' || substring(h, cast(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> cast(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  if(page_id = first, 'response', 'revisit') AS record_type, if(page_id = first, NULL, first) AS refers_to FROM f"""

OP4 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_PLAIN}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) > 4 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

OP6 = rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_PLAIN}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT doc_id, sum(tf) AS len FROM f GROUP BY doc_id),
g AS (SELECT count(*) AS n, (SELECT sum(len) FROM l) / count(*) AS mean FROM documents), df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
i AS (SELECT doc_id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS impact FROM f JOIN l USING (doc_id) CROSS JOIN g),
q AS (SELECT doc_id AS query_id, term, tf * ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM f JOIN df USING (term) CROSS JOIN g WHERE doc_id % 100 = 0),
s AS (SELECT query_id, doc_id, round(sum(w * impact), 6) AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s QUALIFY rank <= 10"""

#: The place of a match is the first occurrence of its text behind the match before it: an earlier one would have matched itself.
OP7 = r"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT * FROM (VALUES (0, 'assign', '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'), (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]{16,}'),
  (3, 'jwt', '\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}'), (4, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----')) v(kind, name, pattern)),
m AS (SELECT doc_id, kind, name, text, regexp_extract_all(text, k.pattern) AS found FROM t CROSS JOIN k),
r AS (SELECT doc_id, kind, name, text AS rest, found, 0 AS i, 0 AS upto, 0 AS start, '' AS value FROM m WHERE len(found) > 0 UNION ALL
  SELECT doc_id, kind, name, substring(rest, instr(rest, found[i + 1]) + length(found[i + 1])), found, i + 1, upto + instr(rest, found[i + 1]) - 1 + length(found[i + 1]), upto + instr(rest, found[i + 1]) - 1, found[i + 1] FROM r WHERE i < len(found)),
s AS (SELECT doc_id, kind, start, name || ':' || start || ':' || upto AS span FROM r WHERE i > 0 AND CASE kind WHEN 0 THEN length(regexp_extract(value, '(?i)^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 12 WHEN 1 THEN length(value) >= 18 ELSE true END),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN a USING (doc_id)"""

#: Lists of DuckDB slice without harm beyond their ends.
OP11 = r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS s FROM documents),
d AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substring(s, i, 8) AS BIGINT)) AS h FROM h),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS pre, coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS mid, coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS suf FROM c)
SELECT doc_id, cast(n AS BIGINT) AS n, form, if(form = 'plain', NULL, length(pre)) AS prefix_chars, if(form = 'plain', NULL, length(mid)) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

ORACLES = {"op3_warc_bundles": OP3, "op4_minhash_near_dedup": OP4, "op6_block_max_wand": OP6, "op7_secret_ledger": OP7, "op11_fill_in_middle": OP11}
