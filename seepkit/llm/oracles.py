"""DuckDB SQL of the queries that SQL can express on whole tables."""

_WORDS = r"w AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS l FROM documents))"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op3_jaccard_join": f"""WITH RECURSIVE {_WORDS.format(text=_LOWER)},
runs AS (SELECT doc_id, p, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g, count(*) OVER (PARTITION BY doc_id) AS n FROM w),
sets AS (SELECT DISTINCT doc_id, g FROM runs WHERE p <= greatest(1, n - 4)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * k >= 80 * (s.n + t.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.comp, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT node, min(other) AS comp FROM reach GROUP BY node) c ON c.node = d.doc_id""",
    "op10_substrings": f"""WITH {_WORDS.format(text="coalesce(text, '')")},
runs AS (SELECT doc_id, p, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS g, count(*) OVER (PARTITION BY doc_id) AS n FROM w),
windows AS (SELECT doc_id, p, sha256(g) AS g FROM runs WHERE p <= n - 34),
repeated AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM windows SEMI JOIN repeated USING (g)),
kept AS (SELECT doc_id, count(*) AS k, string_agg(x, ' ' ORDER BY p) AS t FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, (coalesce(s.n, 0) - coalesce(k.k, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id""",
}
