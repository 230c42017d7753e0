"""SQL for the operators that SQL can express."""

LINES = r"""
WITH l AS (SELECT doc_id, pos, line, list_distinct(list_filter(string_split(translate(lower(line), chr(9) || chr(13) || chr(11) || chr(12), '    '), ' '), lambda w: w <> '')) AS t
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
s AS (SELECT *, list_sort(t) AS k, row_number() OVER (PARTITION BY list_sort(t) ORDER BY doc_id, pos) AS copy FROM l),
f AS (SELECT row_number() OVER (ORDER BY doc_id, pos) AS o, doc_id, pos, len(t) AS n, t FROM s WHERE copy = 1 AND len(t) > 0),
w AS (SELECT o, n, unnest(t) AS w FROM f),
p AS (SELECT a.o, b.o AS p, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS hits FROM w a JOIN w b ON a.w = b.w AND b.o < a.o AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY a.o, b.o),
g AS (SELECT DISTINCT o FROM p WHERE hits >= 0.8 * (n + m - hits) - 1e-9),
k AS (SELECT s.doc_id, s.pos, s.line, len(s.t) > 0 AND (s.copy > 1 OR g.o IS NOT NULL) AS gone
      FROM s LEFT JOIN f ON f.doc_id = s.doc_id AND f.pos = s.pos LEFT JOIN g ON g.o = f.o)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') END AS text,
       count(k.pos) AS n_lines, count(*) FILTER (gone) AS n_removed
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id, d.text"""

VORONOI = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, s.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * s.v[i]))::BIGINT AS score
      FROM e q JOIN e s ON q.vec_id % 100 = 0 AND q.vec_id <> s.vec_id AND len(q.v) = len(s.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10"""

#: The CRC-32 is folded bit by bit; low and high climb the trees of languages and of subroots, the walks go from a leaf to the root.
MERKLE = """
WITH RECURSIVE
f AS (SELECT *, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda r, c: list_reduce(list_concat([xor(r, c)], list_transform(range(8), lambda i: 0::BIGINT)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))) AS crc FROM documents),
g AS (SELECT doc_id, lang, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS met FROM f),
h AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(met) || ':' || met, '-')) AS other FROM g),
l AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS m FROM h),
low AS (SELECT tree, 0 AS level, pos, m, leaf AS digest FROM l
        UNION ALL
        SELECT tree, level + 1, pos // 8, (any_value(m) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE m > 1 GROUP BY tree, level, pos // 8),
sub AS (SELECT tree, digest, level, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS m FROM low WHERE m = 1),
high AS (SELECT 0 AS level, pos, m, digest FROM sub
         UNION ALL
         SELECT level + 1, pos // 8, (any_value(m) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE m > 1 GROUP BY level, pos // 8),
n AS (SELECT tree, level, pos, m, digest FROM low WHERE m > 1 UNION ALL SELECT '', level, pos, m, digest FROM high WHERE m > 1),
s AS (SELECT tree, level, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
        coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z FROM n WINDOW w AS (PARTITION BY tree, level, pos // 8 ORDER BY pos)),
inner_walk AS (SELECT id, tree, 0 AS level, pos, other AS x, '' AS p FROM l
         UNION ALL
         SELECT id, tree, level + 1, w.pos // 8, sha256(a || x || z), p || a || z FROM inner_walk w JOIN s USING (tree, level) WHERE s.pos = w.pos),
outer_walk AS (SELECT i.id, 0 AS level, sub.pos, x, p FROM inner_walk i JOIN sub ON sub.tree = i.tree AND sub.level = i.level
         UNION ALL
         SELECT id, w.level + 1, w.pos // 8, sha256(a || x || z), p || a || z FROM outer_walk w JOIN s ON s.tree = '' AND s.level = w.level AND s.pos = w.pos)
SELECT doc_id, leaf, sub.digest AS subroot, r.digest AS root, sha256(p) AS proof_sha256, x AS folded_root, x = r.digest AS verified
FROM l JOIN sub USING (tree) JOIN high r ON r.m = 1 JOIN outer_walk w ON w.id = l.id AND w.level = r.level"""

ORACLES = {"op2_line_dedup": LINES, "op10_voronoi_topk": VORONOI, "op13_merkle": MERKLE}
