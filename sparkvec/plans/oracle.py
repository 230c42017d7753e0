"""The registered queries as SQL text for an independent engine. DIM is the dimension of the test vectors."""

DIM, CHUNKS, WIDTH = 64, 16, 4


def dbl(x: str, i: str = "i") -> str:
    return f"{x}[{i}]::DOUBLE"


def l2(a: str, b: str, n: int = DIM) -> str:
    d = f"({dbl(a)} - {dbl(b)})"
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: {d} * {d}))"


def ip(a: str, b: str, n: int = DIM) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: {dbl(a)} * {dbl(b)}))"


B = "b AS (SELECT vec_id AS id, embedding AS v, label::BIGINT AS label, [label::BIGINT, 10 + vec_id % 3, 20 + vec_id % 5] AS labels, vec_id % 100 AS attr FROM embeddings)"
Q = "q AS (SELECT id AS qid, v AS qv, label AS ql, labels[1:2] AS qlabels, id % 90 AS lo, id % 90 + 9 AS hi FROM b WHERE id % 20 = 0)"
BQ = f"{B}, {Q}"
#: The codebook: rows below 16 in chunks of four dimensions.
PIV = f"piv AS (SELECT c AS chunk, id AS center, v[{WIDTH}*c+1:{WIDTH}*c+{WIDTH}] AS pv FROM b, range({CHUNKS}) r(c) WHERE id < 16)"


def part(x: str) -> str:
    d = f"({x}[{WIDTH}*chunk+i]::DOUBLE - pv[i]::DOUBLE)"
    return f"list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: {d} * {d}))"


CODES = f"codes AS (SELECT id, chunk, center AS code FROM (SELECT id, chunk, center, row_number() OVER (PARTITION BY id, chunk ORDER BY {part('v')}, center) AS rn FROM b, piv) WHERE rn = 1)"
QTAB = f"qtab AS (SELECT qid, chunk, center, {part('qv')} AS value FROM q, piv)"
ADC = "adc AS (SELECT qid, id, list_sum(list(value ORDER BY qtab.chunk)) AS dist FROM codes JOIN qtab ON qtab.chunk = codes.chunk AND qtab.center = codes.code WHERE id <> qid GROUP BY qid, id)"


def top(src: str, k: int, out: str = "qid, id, dist, rk") -> str:
    return f"SELECT {out} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rk FROM {src}) WHERE rk <= {k}"


def pairs(where: str = "true", dist: str = l2("qv", "v")) -> str:
    return f"d AS (SELECT qid, id, label, ql, labels, qlabels, {dist} AS dist FROM q, b WHERE id <> qid AND {where})"


def knn(where: str = "true", k: int = 10, dist: str = l2("qv", "v")) -> str:
    return f"WITH {BQ}, {pairs(where, dist)} {top('d', k)}"


EQ, SUBSET, OVERLAP, RANGE = "label = ql", "list_has_all(labels, qlabels)", "list_has_any(labels, qlabels)", "attr BETWEEN lo AND hi"


def pooled(where: str, pool: int, k: int) -> str:
    return f"WITH {BQ}, {pairs()}, pool AS ({top('d', pool, '*')}), f AS (SELECT qid, id, dist FROM pool WHERE {where}) {top('f', k)}"


MEAN = "m AS (SELECT pos, avg(v[pos + 1]::DOUBLE) AS value FROM b, range(64) r(pos) GROUP BY pos), mv AS (SELECT list(value ORDER BY pos) AS mean FROM m)"
NEAR3 = f"a AS (SELECT x.id, y.id AS center, {l2('x.v', 'y.v')} AS dist FROM b x, b y WHERE y.id IN (0, 1, 2)), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, center) AS rk FROM a)"
PARTS = "id % ceil(count(*) OVER (PARTITION BY center) / 2000.0)::BIGINT"
NEAR1 = f"na AS (SELECT x.id, y.id AS center, {l2('x.v', 'y.v')} AS dist FROM b x, b y WHERE y.id IN (0, 1, 2)), nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, center) AS rk FROM na)"
GRAPH = f"{NEAR1}, sg AS (SELECT id, center AS shard, {PARTS} AS part FROM nn WHERE rk = 1), g AS (SELECT src, rk - 1 AS pos, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rk FROM (SELECT x.id AS src, y.id AS dst, {l2('p.v', 'r.v')} AS dist FROM sg x JOIN sg y ON x.shard = y.shard AND x.part = y.part AND x.id <> y.id JOIN b p ON p.id = x.id JOIN b r ON r.id = y.id)) WHERE rk <= 8)"
BG = f"{B}, {GRAPH}"
FREQ = "f AS (SELECT user_id AS id, count(*) AS freq FROM events WHERE user_id IS NOT NULL GROUP BY user_id)"
POOLS = "(VALUES (10), (50), (100), (200)) p(l)"
RESULTS = f"{pairs()}, t AS ({top('d WHERE label = ql', 10)}), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS r FROM d), res AS (SELECT l, qid, id, dist, row_number() OVER (PARTITION BY l, qid ORDER BY dist, id) AS rk FROM ranked, {POOLS} WHERE r <= l AND label = ql)"
DRAW = "(((id % 1048576 + {salt}) * 2654435761) % 1000)"
ZIPF = [int(1000 * sum(1 / (j + 1) for j in range(c + 1)) / sum(1 / (j + 1) for j in range(10))) for c in range(9)]
NODE = 9 * 4 + DIM * 4  # degree 8
PER = 4096 // NODE


def oracle_sql() -> dict[str, str]:
    out = {
        "filter_eq_knn": knn(EQ),
        "filter_subset_knn": knn(SUBSET),
        "filter_intersect_knn": knn(OVERLAP),
        "filter_range_knn": knn(RANGE),
        "knn_unfiltered": knn(),
        "knn_partitioned_merge": knn(),
        "knn_with_deletes": knn("id % 10 <> 3"),
        "postfilter_eq_knn": pooled(EQ, 100, 10),
        "postfilter_subset_knn": pooled(SUBSET, 100, 10),
        "top_l_pool": f"WITH {BQ}, {PIV}, {CODES}, {QTAB}, {ADC} {top('adc', 20)}",
        "rerank_exact": f"WITH {BQ}, {PIV}, {CODES}, {QTAB}, {ADC}, pool AS ({top('adc', 50)}), e AS (SELECT pool.qid, pool.id, {l2('qv', 'v')} AS dist FROM pool JOIN b ON b.id = pool.id JOIN q ON q.qid = pool.qid) {top('e', 10)}",
        "gated_pool_knn": f"WITH {BQ}, {PIV}, {CODES}, {QTAB}, {ADC}, gate AS (SELECT adc.* FROM adc JOIN b ON b.id = adc.id JOIN q ON q.qid = adc.qid WHERE label = ql), pool AS ({top('gate', 100)}), e AS (SELECT pool.qid, pool.id, {l2('qv', 'v')} AS dist FROM pool JOIN b ON b.id = pool.id JOIN q ON q.qid = pool.qid) {top('e', 10)}",
        "matching_points": f"WITH {BQ} SELECT qid, id FROM q JOIN b ON {EQ}",
        "selectivity": f"WITH {BQ} SELECT qid, sum((label = ql)::INT)::DOUBLE / (SELECT count(*) FROM b)::DOUBLE AS sel FROM q, b GROUP BY qid",
        "label_histogram": f"WITH {B} SELECT label, count(*) AS n FROM b GROUP BY label",
        "multilabel_sets": f"WITH {B} SELECT id, len(labels)::BIGINT AS n_labels, list_sum(labels)::BIGINT AS label_sum FROM b",
        "dist_l2": f"WITH {BQ} SELECT qid, id, {l2('qv', 'v')} AS value FROM q JOIN b ON qid = id - id % 20",
        "dist_ip": f"WITH {BQ} SELECT qid, id, -({ip('qv', 'v')}) AS value FROM q JOIN b ON qid = id - id % 20",
        "dist_cosine": f"WITH {BQ} SELECT qid, id, 1.0::DOUBLE - {ip('qv', 'v')} AS value FROM q JOIN b ON qid = id - id % 20",
        "dist_matrix": f"WITH {BQ} SELECT qid, id, {ip('qv', 'qv')} + {ip('v', 'v')} - 2.0::DOUBLE * {ip('qv', 'v')} AS value FROM q JOIN b ON qid = id - id % 20",
        "normalize": f"WITH {B}, s AS (SELECT id, v, {ip('v', 'v')} AS n FROM b) SELECT id, pos, CASE WHEN n < 1.1920928955078125e-07 THEN 0.0::DOUBLE ELSE v[pos + 1]::DOUBLE / sqrt(n) END AS value FROM s, range({DIM}) r(pos)",
        "row_norms": f"WITH {B} SELECT id, {ip('v', 'v')} AS value FROM b",
        "occlude_factor": f"WITH {BG} SELECT src, near, far, CASE WHEN apart = 0 THEN 3.4028234663852886e38::DOUBLE ELSE dist / apart END AS factor FROM (SELECT x.src, x.dst AS near, y.dst AS far, y.dist, {l2('p.v', 'r.v')} AS apart FROM g x JOIN g y ON x.src = y.src AND x.pos < y.pos JOIN b p ON p.id = x.dst JOIN b r ON r.id = y.dst)",
        "ram_estimate": f"WITH {B} SELECT label, 1.1::DOUBLE * (count(*)::DOUBLE * 32.0::DOUBLE * 4.0::DOUBLE * 1.3::DOUBLE + (count(*) * {DIM} * 4)::DOUBLE) AS bytes FROM b GROUP BY label",
        "scan_vectors": f"WITH {B} SELECT id, pos, v[pos + 1]::DOUBLE AS value FROM b, range({DIM}) r(pos)",
        "vector_metadata": f"WITH {B} SELECT count(*) AS n_rows, max(len(v))::BIGINT AS dim FROM b",
        "vector_by_id": f"WITH {B} SELECT id, pos, v[pos + 1]::DOUBLE AS value FROM b, range({DIM}) r(pos) WHERE id = 7",
        "head_n": f"WITH {B} SELECT id, label FROM b WHERE id < 100",
        "modulo_sample": f"WITH {B} SELECT id, label FROM b WHERE {DRAW.format(salt=0)} < 100",
        "node_table": f"WITH {BG} SELECT b.id, label, count(*) AS degree, min(CASE WHEN pos = 0 THEN dst END) AS nearest, {ip('any_value(v)', 'any_value(v)')} AS norm_sq FROM b JOIN g ON g.src = b.id GROUP BY b.id, label",
        "index_meta": f"WITH {B}, {MEAN}, d AS (SELECT id, {l2('v', 'mean')} AS dist FROM b, mv) SELECT (SELECT count(*) FROM b) AS n_points, {DIM}::BIGINT AS dim, (SELECT id FROM d ORDER BY dist, id LIMIT 1) AS entry, {NODE}::BIGINT AS node_length, {PER}::BIGINT AS nodes_per_sector",
        "page_layout": f"WITH {B} SELECT id, id // {PER} + 1 AS sector, id % {PER} AS place FROM b",
        "tag_lookup": f"WITH {B} SELECT id, CASE WHEN id % 2 = 0 THEN id + 1000000 ELSE id END AS tag FROM b",
        "recall_at_k": f"WITH {BQ}, {RESULTS} SELECT l, (SELECT count(*) FROM res r JOIN t ON t.qid = r.qid AND t.id = r.id WHERE r.l = p.l AND r.rk <= 10)::DOUBLE / ((SELECT count(*) FROM q) * 10)::DOUBLE AS recall FROM {POOLS.replace(' p(l)', ' p(l)')}",
        "recall_valid_only": f"WITH {BQ}, {RESULTS}, s AS (SELECT qid, count(*) AS size FROM t GROUP BY qid), h AS (SELECT r.l, r.qid, count(*) AS hits FROM res r JOIN t ON t.qid = r.qid AND t.id = r.id WHERE r.rk <= 10 GROUP BY r.l, r.qid) SELECT p.l, round(avg(coalesce(hits, 0)::DOUBLE / size), 12) AS recall FROM s CROSS JOIN {POOLS} LEFT JOIN h ON h.l = p.l AND h.qid = s.qid GROUP BY p.l",
        "recall_tie_aware": f"WITH {BQ}, {RESULTS}, w AS ({top('d WHERE label = ql', 20)}), far AS (SELECT qid, dist AS far FROM w WHERE rk = 10), tt AS (SELECT w.qid, w.id FROM w LEFT JOIN far ON far.qid = w.qid WHERE far IS NULL OR dist <= far) SELECT l, (SELECT count(*) FROM res r JOIN tt ON tt.qid = r.qid AND tt.id = r.id WHERE r.l = p.l AND r.rk <= 10)::DOUBLE / (SELECT count(*) FROM q)::DOUBLE * 10.0::DOUBLE AS recall FROM {POOLS}",
        "latency_stats": "WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT p, any_value(value) AS value FROM s, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) x(p) WHERE place = floor(p * n) GROUP BY p",
        "io_reduction": f"WITH {BQ}, {pairs()}, pool AS ({top('d', 100, '*')}) SELECT qid, count(*) AS n_fetch_post, count(*) FILTER (label = ql) AS n_fetch_gated FROM pool GROUP BY qid",
        "centroid": f"WITH {B}, {MEAN} SELECT pos, round(value, 9) AS value FROM m",
        "medoid": f"WITH {B}, {MEAN} SELECT id, round({l2('v', 'mean')}, 9) AS dist FROM b, mv ORDER BY dist, id LIMIT 1",
        "graph_degree_stats": f"WITH {BG}, r AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g)), n AS (SELECT src, count(*) AS n FROM r GROUP BY src) SELECT max(n) AS max_degree, min(n) AS min_degree, sum(n)::DOUBLE / count(*) AS avg_degree, count(*) FILTER (n < 2) AS n_low FROM n",
        "cluster_sse": f"WITH {B}, {NEAR3} SELECT center, count(*) AS n, round(sum(dist), 6) AS sse FROM n WHERE rk = 1 GROUP BY center",
        "shard_sizes": f"WITH {B}, {NEAR3} SELECT center AS shard, count(*) AS n FROM n WHERE rk <= 2 GROUP BY center",
        "shard_assign": f"WITH {B}, {NEAR3} SELECT id, center AS shard FROM n WHERE rk <= 2",
        "closest_centers": f"WITH {B}, {NEAR3} SELECT id, center, dist, rk FROM n WHERE rk <= 2",
        "kmeans_step": f"WITH {B}, {NEAR3} SELECT center, pos, round(avg(v[pos + 1]::DOUBLE), 9) AS value FROM n JOIN b ON b.id = n.id, range({DIM}) r(pos) WHERE rk = 1 GROUP BY center, pos",
        "pq_chunks": f"WITH {B} SELECT id, c AS chunk, v[{WIDTH}*c+1]::DOUBLE AS first, v[{WIDTH}*c+{WIDTH}]::DOUBLE AS last FROM b, range({CHUNKS}) r(c)",
        "pq_encode": f"WITH {B}, {PIV}, {CODES} SELECT id, chunk, code FROM codes",
        "pq_query_table": f"WITH {BQ}, {PIV}, {QTAB} SELECT qid, chunk, center, value FROM qtab",
        "pq_query_table_ip": f"WITH {BQ}, {PIV} SELECT qid, chunk, center, list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: -(qv[{WIDTH}*chunk+i]::DOUBLE * pv[i]::DOUBLE))) AS value FROM q, piv",
        "pq_adc": f"WITH {BQ}, {PIV}, {CODES}, {QTAB} SELECT qid, id, list_sum(list(value ORDER BY qtab.chunk)) AS value FROM codes JOIN qtab ON qtab.chunk = codes.chunk AND qtab.center = codes.code AND qtab.qid = codes.id - codes.id % 20 GROUP BY qid, id",
        "pq_sdc": f"WITH {BQ}, {PIV}, {CODES}, pp AS (SELECT x.chunk, x.center AS c1, y.center AS c2, {l2('x.pv', 'y.pv', WIDTH)} AS d FROM piv x JOIN piv y ON x.chunk = y.chunk) SELECT q.qid, y.id, list_sum(list(d ORDER BY pp.chunk)) AS value FROM q JOIN codes x ON x.id = q.qid JOIN codes y ON y.chunk = x.chunk AND y.id - y.id % 20 = q.qid JOIN pp ON pp.chunk = x.chunk AND pp.c1 = x.code AND pp.c2 = y.code GROUP BY q.qid, y.id",
        "neighbor_store": f"WITH {BG} SELECT src, pos, dst FROM g WHERE pos < 4",
        "reverse_edges": f"WITH {BG} SELECT DISTINCT src, dst FROM (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g)",
        "bfs_hops": f"WITH RECURSIVE {BG}, {MEAN}, s AS (SELECT id FROM b, mv ORDER BY {l2('v', 'mean')}, id LIMIT 1), h1 AS (SELECT DISTINCT dst AS id, 1 AS hop FROM g JOIN s ON src = id), h2 AS (SELECT DISTINCT dst AS id, 2 AS hop FROM g JOIN h1 ON src = id), h3 AS (SELECT DISTINCT dst AS id, 3 AS hop FROM g JOIN h2 ON src = id) SELECT id, min(hop)::BIGINT AS hop FROM (SELECT id, 0 AS hop FROM s UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY id",
        "merge_shards": f"WITH {B}, {NEAR3}, sh AS (SELECT id, center AS shard, {PARTS} AS part FROM n WHERE rk <= 2), e AS (SELECT x.shard, x.id AS src, y.id AS dst, {l2('p.v', 'r.v')} AS dist FROM sh x JOIN sh y ON x.shard = y.shard AND x.part = y.part AND x.id <> y.id JOIN b p ON p.id = x.id JOIN b r ON r.id = y.id), k AS (SELECT *, row_number() OVER (PARTITION BY shard, src ORDER BY dist, dst) AS rn FROM e), u AS (SELECT DISTINCT src, dst, dist FROM k WHERE rn <= 8), o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS pos FROM u) SELECT src, pos, dst FROM o WHERE pos < 8",
        "tunnel_expand": f"WITH {BQ}, {pairs()}, pool AS ({top('d', 20, '*')}), s AS (SELECT DISTINCT id FROM pool WHERE label <> ql), g AS (SELECT src, dst FROM (SELECT p.id AS src, r.id AS dst, row_number() OVER (PARTITION BY p.id ORDER BY {l2('p.v', 'r.v')}, r.id) AS rk FROM s JOIN b p ON p.id = s.id JOIN b r ON r.id <> p.id) WHERE rk <= 4), x AS (SELECT DISTINCT pool.qid, g.dst AS id FROM pool JOIN g ON g.src = pool.id WHERE label <> ql) SELECT x.qid, x.id FROM x WHERE x.qid <> x.id AND NOT EXISTS (SELECT 1 FROM pool p WHERE p.qid = x.qid AND p.id = x.id)",
        "live_nodes": f"WITH {B} SELECT id FROM b WHERE id % 10 <> 3",
        "delete_repair": f"WITH {BG}, l AS (SELECT src, dst FROM g WHERE src % 10 <> 3) SELECT DISTINCT src, dst FROM (SELECT src, dst FROM l WHERE dst % 10 <> 3 UNION ALL SELECT l.src, g.dst FROM l JOIN g ON g.src = l.dst WHERE l.dst % 10 = 3 AND g.dst % 10 <> 3 AND g.dst <> l.src)",
        "id_compaction": f"WITH {B} SELECT id AS old_id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM b WHERE id % 10 <> 3",
        "insert_upsert": "SELECT tag, seq FROM (SELECT user_id AS tag, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1 AND seq % 10 <> 3",
        "hot_nodes": f"WITH {FREQ} SELECT id, freq, row_number() OVER (ORDER BY freq DESC, id) AS rk FROM f ORDER BY freq DESC, id LIMIT 50",
        "cache_hit_rate": f"WITH {FREQ}, o AS (SELECT freq, row_number() OVER (ORDER BY freq DESC, id) AS rk FROM f) SELECT k, sum(freq) FILTER (rk <= k)::DOUBLE / sum(freq)::DOUBLE AS rate FROM o, (VALUES (10::BIGINT), (50::BIGINT), (100::BIGINT)) x(k) GROUP BY k",
        "optimal_cache_size": f"WITH {FREQ}, o AS (SELECT sum(freq) OVER (ORDER BY freq DESC, id ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY freq DESC, id) AS rk, sum(freq) OVER () AS total FROM f) SELECT target, min(rk) AS k FROM o, (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) x(target) WHERE upto::DOUBLE >= target * total::DOUBLE GROUP BY target",
        "norm_bins": f"WITH {B}, s AS (SELECT id, list_sum(list_transform(range(1, {DIM + 1}), lambda i: abs({dbl('v')}))) AS x FROM b) SELECT id, ((row_number() OVER (ORDER BY x, id) - 1) * 10) // (count(*) OVER ()) AS bin FROM s",
        "correlated_labels": f"WITH {B}, {NEAR3} SELECT id, CASE WHEN {DRAW.format(salt=0)} < 500 THEN center ELSE {DRAW.format(salt=7)} % 10 END AS label FROM n WHERE rk = 1",
        "zipf_labels": f"WITH {B} SELECT id, " + " + ".join(f"({DRAW.format(salt=3)} >= {t})::BIGINT" for t in ZIPF) + " AS label FROM b",
        "truth_from_unfiltered": f"WITH {BQ}, {pairs()}, t AS ({top('d', 50, '*')}), s AS (SELECT * EXCLUDE (rk) FROM t WHERE label = ql) {top('s', 10, 'qid, id, rk')}",
        "gt_window": f"WITH {BQ}, {pairs()}, t AS ({top('d', 100)}), w AS (SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 300::BIGINT), (1, 100, 400), (2, 200, 203)) x(step, first, last)), k AS (SELECT step, qid, id, row_number() OVER (PARTITION BY step, qid ORDER BY dist, id) AS rk FROM t, w WHERE id >= first AND id < last), c AS (SELECT step FROM k WHERE rk = 5 GROUP BY step HAVING count(*) = (SELECT count(*) FROM q)) SELECT k.step, qid, id, rk FROM k JOIN c ON c.step = k.step WHERE rk <= 5",
    }
    return out
