"""DuckDB SQL of the queries that SQL can express: the contracts written out plainly."""

SQL: dict[str, str] = {}
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL["op4_exact_top_k"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 20"""
SQL["op6_line_dedup"] = """WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
w AS (SELECT trim(line, ' ') AS t, min(struct_pack(d := doc_id, p := pos)) AS first FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
m AS (SELECT l.doc_id, l.pos, l.line, w.t IS NULL OR (w.first.d = l.doc_id AND w.first.p = l.pos) AS kept FROM l LEFT JOIN w ON w.t = trim(l.line, ' '))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN kept THEN 0 ELSE 1 END) AS BIGINT) AS n_removed, coalesce(string_agg(CASE WHEN kept THEN line END, chr(10) ORDER BY pos), '') AS text FROM m GROUP BY doc_id"""
_WORDS = f"regexp_extract_all(translate(text, {_FOLD}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL["op7_benchmark_decontamination"] = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark), iw AS (SELECT item, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM i WHERE len(w) > 0),
t AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM iw), n AS (SELECT DISTINCT n FROM t),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, n WHERE len(w) >= n) x),
h AS (SELECT DISTINCT doc_id, t.item, dw.n, k FROM dw JOIN t ON t.g = dw.g AND t.n = dw.n),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM h) x GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) x GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id"""
_SPACED = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
SQL["op8_substring_dedup"] = f"""WITH d AS (SELECT doc_id, {_SPACED.format('text')} AS w FROM documents), g AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS k FROM d WHERE len(w) >= 35) x),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1), c AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + 34)) AS p FROM g JOIN r ON r.h = g.h),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d), m AS (SELECT u.doc_id, u.p, word, c.p IS NULL AS kept FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.p = u.p),
a AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN kept THEN 0 ELSE 1 END) AS gone, string_agg(CASE WHEN kept THEN word END, ' ' ORDER BY p) AS t FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""
SQL["op10_ngram_jaccard_join"] = f"""WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(f'translate(text, {_FOLD})')} AS w FROM documents), g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + least(5, len(w)) - 1], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS k FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a, min(b) AS c FROM r GROUP BY a), s AS (SELECT doc_id, md5(string_agg(h, '' ORDER BY h)) AS s FROM g GROUP BY doc_id), k AS (SELECT s, min(doc_id) AS c FROM s GROUP BY s)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, coalesce(k.c, d.doc_id) AS class_id FROM d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN k ON k.s = s.s"""
