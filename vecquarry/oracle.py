"""SQL with the same results as the queries of the core, for tables of the same names."""

from __future__ import annotations

VECTORS = "c AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS qid, e AS x FROM c WHERE vec_id % 20 = 0)"
PACKED = """bits AS (SELECT vec_id, list_transform(range(0, len(embedding) // 8), lambda i: list_sum(list_transform(range(1, 9), lambda j: CASE WHEN embedding[i * 8 + j] > 0 THEN 1 << (8 - j)::INT ELSE 0 END))::INT) AS e FROM embeddings)"""
DISTANCE = {
    "euclidean": "sqrt(list_sum(list_transform(list_zip(x, e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "cosine": "greatest(0, least(2, list_cosine_distance(x, e)))",
    "ip": "-list_inner_product(x, e)",
    "normalized": "greatest(0, least(2, 1 - list_inner_product(x, e)))",
}


def nearest(distance: str, k: int, tables: str = "q, c") -> str:
    return f"""SELECT qid, row_number() OVER w::INT AS rank, vec_id, distance FROM (SELECT qid, vec_id, round({distance}, 6) + 0.0 AS distance FROM {tables})
        WINDOW w AS (PARTITION BY qid ORDER BY distance, vec_id) QUALIFY row_number() OVER w <= {k}"""


ORACLE: dict[str, str] = {f"knn_{m}": f"WITH {VECTORS} {nearest(x, 10)}" for m, x in DISTANCE.items()}

ORACLE["knn_hamming"] = f"""WITH {PACKED}, q AS (SELECT vec_id AS qid, e AS x FROM bits WHERE vec_id % 20 = 0)
    {nearest("list_sum(list_transform(list_zip(x, e), lambda p: bit_count(xor(p[1], p[2]))))::DOUBLE", 10, "q, bits")}"""

ORACLE["query_stats"] = f"""WITH {VECTORS}, near AS ({nearest(DISTANCE["euclidean"], 100)}),
    lists AS (SELECT qid, list(distance ORDER BY rank) AS d FROM near GROUP BY qid),
    means AS (SELECT qid, round(avg({DISTANCE["euclidean"]}), 6) AS m FROM q, c GROUP BY qid),
    lid AS (SELECT qid, d, m, list_filter(d[:10], lambda v: v > 1e-5) AS d10, list_filter(d[:100], lambda v: v > 1e-5) AS d100 FROM lists JOIN means USING (qid))
    SELECT qid, round(m / nullif(d[1], 0), 3) AS rc1, round(m / nullif(d[least(10, len(d))], 0), 3) AS rc10, round(m / nullif(d[least(100, len(d))], 0), 3) AS rc100,
        round(-len(d10) / nullif(list_sum(list_transform(d10, lambda v: ln(v / d[least(10, len(d))]))), 0), 3) AS lid10,
        round(-len(d100) / nullif(list_sum(list_transform(d100, lambda v: ln(v / d[least(100, len(d))]))), 0), 3) AS lid100 FROM lid"""

ORACLE["knn_graph"] = f"""WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS qid, e AS x FROM c), near AS ({nearest(DISTANCE["euclidean"], 5, "q JOIN c ON qid <> vec_id")})
    SELECT qid AS src, rank, vec_id AS dst, distance FROM near"""

ORACLE["gather_rescore"] = f"""WITH {VECTORS}, near AS ({nearest(DISTANCE["cosine"], 20)}) {nearest(DISTANCE["euclidean"], 5, "(SELECT near.qid, near.vec_id, x, e FROM near JOIN q USING (qid) JOIN c ON near.vec_id = c.vec_id)")}"""

CELLS = f"""{VECTORS}, cell AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, e AS x FROM c WHERE vec_id < 16),
    assigned AS (SELECT vec_id, e, cell FROM (SELECT vec_id, e, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round({DISTANCE["euclidean"]}, 6), cell) AS r FROM c, cell) WHERE r = 1),
    probes AS (SELECT qid, x, cell, r FROM (SELECT qid, q.x, cell, row_number() OVER (PARTITION BY qid ORDER BY round({DISTANCE["euclidean"].replace("x, e", "q.x, cell.x")}, 6), cell) AS r FROM q, cell))"""
ORACLE["ivf_assign"] = f"WITH {CELLS} SELECT vec_id, cell FROM assigned"


def _probed(n: int) -> str:
    return nearest(DISTANCE["euclidean"], 10, f"(SELECT * FROM probes JOIN assigned USING (cell) WHERE r <= {n})")


ORACLE["ivf_search"] = f"WITH {CELLS} {_probed(4)}"
TRUTH = f"truth AS ({nearest(DISTANCE['euclidean'], 10)}), bound AS (SELECT qid, distance + 1e-3 AS far FROM truth WHERE rank = 10)"
ORACLE["ivf_recall"] = f"""WITH {CELLS}, found AS ({_probed(4)}), {TRUTH}
    SELECT qid, count(found.distance) FILTER (found.distance <= far) / 10.0::DOUBLE AS recall FROM bound LEFT JOIN found USING (qid) GROUP BY qid"""


def _one_run(n: int) -> str:
    return f"""SELECT {n} AS n_probe, round(avg(recall), 6) AS recall, round(1e6 / avg(comps), 6) AS qps FROM
        (SELECT qid, count(f.distance) FILTER (f.distance <= far) / 10.0::DOUBLE AS recall FROM bound LEFT JOIN ({_probed(n)}) f USING (qid) GROUP BY qid)
        JOIN (SELECT qid, 16 + count(vec_id) AS comps FROM probes LEFT JOIN assigned USING (cell) WHERE r <= {n} GROUP BY qid) USING (qid)"""


ORACLE["ivf_runs"] = f"WITH {CELLS}, {TRUTH} " + " UNION ALL ".join(map(_one_run, (1, 2, 4, 8)))
ORACLE["run_metrics"] = f"""WITH {CELLS}, {TRUTH}, comps AS (SELECT qid, 16 + count(vec_id) AS comps FROM probes LEFT JOIN assigned USING (cell) WHERE r <= 2 GROUP BY qid)
    SELECT 10 AS k, 'embeddings' AS dataset, 'ivf(faiss)' AS algorithm, '2' AS params, (SELECT round(1 / avg(comps), 9) FROM comps) AS qps, round(avg(recall), 6) AS recall FROM
        (SELECT qid, count(f.distance) FILTER (f.distance <= far) / 10.0::DOUBLE AS recall FROM bound LEFT JOIN ({_probed(2)}) f USING (qid) GROUP BY qid)"""

LENGTH = "sqrt(list_sum(list_transform({e}, lambda v: v * v)))"
ORACLE["normalize"] = f"""WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, {LENGTH.format(e="e")} AS l FROM c)
    SELECT vec_id, list_transform(e, lambda v: round(v / l, 9)) AS embedding FROM n"""
ORACLE["matryoshka"] = f"""WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda v: v / {LENGTH.format(e="e")})[:16] AS e FROM c),
    m AS (SELECT *, {LENGTH.format(e="e")} AS l FROM n) SELECT vec_id, list_transform(e, lambda v: round(v / l, 9)) AS embedding FROM m"""
ORACLE["layer_norm"] = """WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT *, list_avg(e) AS m FROM c), s AS (SELECT *, sqrt(list_avg(list_transform(e, lambda v: (v - m) * (v - m))) + 1e-5) AS s FROM m)
    SELECT vec_id, list_transform(e, lambda v: round((v - m) / s, 6)) AS embedding FROM s"""
AT = "cells AS (SELECT vec_id, unnest(range(0, len(embedding)))::INT AS j, unnest(embedding::DOUBLE[]) AS x FROM embeddings)"
BOUNDS = f"{AT}, b AS (SELECT j, min(x) AS low, max(x) AS high, max(abs(x)) AS largest FROM cells GROUP BY j)"
ORACLE["dimension_bounds"] = f"WITH {BOUNDS} SELECT j, low, high, largest FROM b"
ORACLE["quantize_uint8"] = f"""WITH {BOUNDS} SELECT vec_id, list(CASE WHEN high > low THEN floor(greatest(0, least(255, (x - low) / ((high - low) / 255)))) ELSE 0 END::INT ORDER BY j) AS embedding FROM cells JOIN b USING (j) GROUP BY vec_id"""
ORACLE["quantize_int8"] = f"""WITH {BOUNDS} SELECT vec_id, list(greatest(-127, least(127, round_even(x / CASE WHEN largest > 0 THEN largest / 127 ELSE 1 END, 0)))::INT ORDER BY j) AS embedding FROM cells JOIN b USING (j) GROUP BY vec_id"""
ORACLE["quantize_binary"] = f"WITH {PACKED} SELECT vec_id, e AS embedding FROM bits"
ORACLE["unpack_bits"] = "SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS embedding FROM embeddings"
MOMENTS = f"{AT}, m AS (SELECT j, count(x) AS n, avg(x) AS mean, greatest(0, var_samp(x)) AS variance FROM cells GROUP BY j)"
ORACLE["dimension_moments"] = f"WITH {MOMENTS} SELECT j, n, round(mean, 9) AS mean, round(variance, 9) AS variance FROM m"
ORACLE["mahalanobis_diagonal"] = f"WITH {MOMENTS} SELECT vec_id, round(sqrt(sum(CASE WHEN variance > 1e-12 THEN (x - mean) * (x - mean) / variance ELSE 0 END)), 6) AS distance FROM cells JOIN m USING (j) GROUP BY vec_id"
ORACLE["covariance"] = f"WITH {AT} SELECT a.j AS i, b.j AS j, round(covar_samp(a.x, b.x), 9) AS covariance FROM cells a JOIN cells b USING (vec_id) GROUP BY a.j, b.j"
ORACLE["train_test_split"] = "SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY md5(vec_id || ':1'), vec_id) <= 50 THEN 'test' ELSE 'train' END AS part FROM embeddings"
ORACLE["random_sample"] = "SELECT vec_id FROM embeddings ORDER BY md5(vec_id || ':1'), vec_id LIMIT 100"
ORACLE["block_sample"] = """WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings), b AS (SELECT *, pos * 10 // n AS block FROM p),
    s AS (SELECT *, ceil(block * n / 10)::BIGINT AS first, ceil((block + 1) * n / 10)::BIGINT AS last FROM b),
    t AS (SELECT *, first + ('0x' || substr(md5(block || ':1'), 1, 8))::BIGINT % (greatest(last - first - 5, 0) + 1) AS start FROM s)
    SELECT vec_id FROM t WHERE pos >= start AND pos < start + 5"""
ORACLE["multi_vector_offsets"] = """WITH n AS (SELECT l_orderkey AS doc_id, count(*) AS count FROM lineitem GROUP BY 1)
    SELECT doc_id, count, (sum(count) OVER (ORDER BY doc_id) - count)::BIGINT AS start FROM n"""

SUMMARY = """s AS (SELECT DISTINCT k, dataset, algorithm, params, qps, recall, build_time, index_size, run_at FROM summary
    WHERE dataset IS NOT NULL AND algorithm IS NOT NULL AND isfinite(qps) AND qps > 0 AND isfinite(recall) AND recall BETWEEN 0 AND 1)"""


def fastest(recall: float, k: int, source: str = "s") -> str:
    return f"""(SELECT * EXCLUDE (r, n) FROM (SELECT *, rank() OVER (PARTITION BY dataset, algorithm ORDER BY qps DESC) AS r, count(*) OVER (PARTITION BY dataset, algorithm, qps) AS n
        FROM {source} WHERE k = {k} AND recall >= {recall}) WHERE r = 1 AND n = 1)"""


ORACLE["fastest_at"] = f"WITH {SUMMARY} SELECT dataset, algorithm, params, qps, recall FROM {fastest(0.9, 100)}"
ORACLE["pareto_front"] = f"""WITH {SUMMARY} SELECT dataset, algorithm, params, qps, recall FROM s a WHERE k = 100 AND NOT EXISTS (SELECT 1 FROM s b
    WHERE b.k = 100 AND b.dataset = a.dataset AND b.algorithm = a.algorithm AND b.qps >= a.qps AND b.recall >= a.recall AND (b.qps > a.qps OR b.recall > a.recall))"""
ORACLE["radar_score"] = f"""WITH {SUMMARY}, f AS (SELECT dataset, algorithm, qps / max(qps) OVER (PARTITION BY dataset) AS share FROM {fastest(0.9, 100)}),
    full_grid AS (SELECT d.dataset, a.algorithm, coalesce(share, 0) AS share FROM (SELECT DISTINCT dataset FROM s) d CROSS JOIN (SELECT DISTINCT algorithm FROM s) a LEFT JOIN f ON f.dataset = d.dataset AND f.algorithm = a.algorithm),
    kinds AS (SELECT algorithm, contains(dataset, '-ip') AS ip, avg(share) AS mean, count(*) FILTER (share > 0) AS met FROM full_grid GROUP BY ALL)
    SELECT algorithm, round(avg(mean), 9) AS score, sum(met)::BIGINT AS datasets_met FROM kinds GROUP BY algorithm"""
DETAIL = "d AS (SELECT DISTINCT * FROM detail WHERE dataset IS NOT NULL)"
ORACLE["difficulty_split"] = f"""WITH {SUMMARY}, {DETAIL}, u AS (SELECT * FROM d WHERE k = 100 AND recall BETWEEN 0 AND 1 AND time > 0 AND NOT isnan(time)),
    rc AS (SELECT dataset, query_index, round(avg(recall), 9) AS rc FROM u GROUP BY ALL),
    bands AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY rc DESC, query_index) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM rc)
    SELECT algorithm, dataset, round(avg(recall) FILTER (r < 0.1::DOUBLE * n), 6) AS easy, round(avg(recall) FILTER (r >= 0.9::DOUBLE * n), 6) AS difficult, round(avg(recall), 6) AS mean_recall, round(1 / avg(time::DOUBLE), 3) AS qps
    FROM u JOIN bands USING (dataset, query_index) SEMI JOIN {fastest(0.0, 100)} f USING (dataset, algorithm, params) GROUP BY algorithm, dataset"""
ORACLE["performance_gap"] = f"""WITH {SUMMARY}, f AS (SELECT dataset, algorithm, qps FROM {fastest(0.5, 100)}), p AS (SELECT dataset AS inside_of, lead(dataset) OVER (PARTITION BY distance ORDER BY dataset) AS outside_of FROM dataset_info WHERE distance IS NOT NULL)
    SELECT inside_of, outside_of, a.algorithm, a.qps AS inside, b.qps AS outside FROM p JOIN f a ON a.dataset = inside_of JOIN f b ON b.dataset = outside_of AND b.algorithm = a.algorithm"""
ORACLE["metric_table"] = f"""WITH {SUMMARY}, b AS (SELECT dataset, algorithm, build_time AS value FROM s WHERE k = 100 AND recall >= 0.5 AND build_time > 0 QUALIFY row_number() OVER (PARTITION BY dataset, algorithm ORDER BY qps DESC, params) = 1),
    r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY value) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2 AS rank FROM b)
    SELECT algorithm, dataset, value, rank, round(avg(rank) OVER (PARTITION BY algorithm), 9) AS average_rank FROM r"""
ORACLE["legend_order"] = f"""WITH {SUMMARY}, b AS (SELECT algorithm, max(qps) FILTER (recall >= 0.95) AS best FROM s WHERE k = 100 GROUP BY algorithm)
    SELECT algorithm, row_number() OVER (ORDER BY best DESC NULLS LAST, algorithm)::INT AS place FROM b"""
ORACLE["average_rank"] = f"WITH {SUMMARY} SELECT dataset, algorithm, params, qps, rank() OVER (PARTITION BY dataset ORDER BY qps DESC) + (count(*) OVER (PARTITION BY dataset, qps) - 1) / 2 AS rank FROM s WHERE k = 100"
ORACLE["dataset_mean_gap"] = f"WITH {SUMMARY} SELECT dataset, params, qps, qps / max(qps) OVER w AS share, round(qps / avg(qps) OVER w, 6) AS against_mean FROM s WHERE k = 100 WINDOW w AS (PARTITION BY dataset)"
ORACLE["median_by_dataset"] = f"WITH {SUMMARY} SELECT dataset, median(qps) AS median_qps, max(recall) AS best_recall, count(*) AS n FROM s GROUP BY dataset"
ORACLE["completeness_grid"] = f"WITH {SUMMARY} SELECT dataset, algorithm FROM (SELECT DISTINCT dataset FROM s) CROSS JOIN (SELECT DISTINCT algorithm FROM s) ANTI JOIN s USING (dataset, algorithm)"
PAIRS = f"""{SUMMARY}, {DETAIL}, x AS (SELECT * FROM s SEMI JOIN (FROM d WHERE time > 0 AND NOT isnan(time)) d USING (dataset, algorithm, params, k)),
    t AS (SELECT dataset, algorithm, query_index, avg(time::DOUBLE) AS time FROM d SEMI JOIN {fastest(0.0, 100, "x")} f USING (dataset, algorithm, params) WHERE k = 100 AND time > 0 AND NOT isnan(time) GROUP BY ALL),
    pairs AS (SELECT a.dataset, a.algorithm AS a, b.algorithm AS b, a.time AS ta, b.time AS tb, a.time - b.time AS diff FROM t a JOIN t b ON a.dataset = b.dataset AND a.query_index = b.query_index AND a.algorithm < b.algorithm),
    means AS (SELECT dataset, a, b, avg(ta) AS la, avg(tb) AS lb FROM pairs GROUP BY ALL),
    ranked AS (SELECT *, rank() OVER (PARTITION BY dataset, a, b ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY dataset, a, b, abs(diff)) - 1) / 2 AS r, count(*) OVER (PARTITION BY dataset, a, b, abs(diff)) AS t FROM pairs WHERE diff <> 0),
    sums AS (SELECT dataset, a, b, count(*) AS n, coalesce(sum(r) FILTER (diff > 0), 0) AS wp, coalesce(sum(r) FILTER (diff < 0), 0) AS wm, sum(t::DOUBLE * t - 1) AS ties FROM ranked GROUP BY ALL),
    z AS (SELECT *, abs(wp - n::DOUBLE * (n + 1) / 4) / sqrt(nullif(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48, 0)) AS z FROM sums),
    tests AS (SELECT means.dataset, means.a AS algorithm_a, means.b AS algorithm_b, coalesce(n, 0) AS n, coalesce(wp, 0)::DOUBLE AS w_plus, coalesce(wm, 0)::DOUBLE AS w_minus, round(la, 9) AS latency_a, round(lb, 9) AS latency_b,
        round(coalesce(least(1, 2 * exp(-z * z / 2) / 2.5066282746310002 * (0.319381530 * h + -0.356563782 * h ** 2 + 1.781477937 * h ** 3 + -1.821255978 * h ** 4 + 1.330274429 * h ** 5)), 1), 6) AS p_value
        FROM means LEFT JOIN (SELECT *, 1 / (1 + 0.2316419::DOUBLE * z) AS h FROM z) z USING (dataset, a, b))"""
ORACLE["wilcoxon"] = f"WITH {PAIRS} SELECT * FROM tests"
ADJUSTED = """scaled AS (SELECT *, row_number() OVER w AS i, p_value * (count(*) OVER (PARTITION BY dataset) - row_number() OVER w + 1) AS p FROM tests WINDOW w AS (PARTITION BY dataset ORDER BY p_value, algorithm_a, algorithm_b)),
    adjusted AS (SELECT dataset, algorithm_a, algorithm_b, p_value, least(1, max(p) OVER (PARTITION BY dataset ORDER BY i)) AS adjusted FROM scaled)"""
ORACLE["holm"] = f"WITH {PAIRS}, {ADJUSTED} SELECT dataset, algorithm_a, algorithm_b, p_value, round(adjusted, 6) AS adjusted FROM adjusted"
ORACLE["indifferent_pairs"] = f"WITH {PAIRS}, {ADJUSTED} SELECT dataset, algorithm_a AS a, algorithm_b AS b FROM adjusted WHERE adjusted >= 0.01"
ORACLE["indifferent_groups"] = f"""WITH RECURSIVE {PAIRS}, {ADJUSTED}, e AS (SELECT dataset, algorithm_a AS a, algorithm_b AS b FROM adjusted WHERE adjusted >= 0.01),
    near AS (SELECT dataset, b, list(a) AS smaller FROM e GROUP BY ALL), around AS (SELECT dataset, x, list(y) AS near FROM (SELECT dataset, a AS x, b AS y FROM e UNION ALL SELECT dataset, b, a FROM e) GROUP BY ALL),
    c AS (SELECT dataset, [a, b] AS members FROM e UNION ALL SELECT c.dataset, list_append(c.members, n.b) FROM c JOIN near n ON n.dataset = c.dataset AND list_has_all(n.smaller, c.members))
    SELECT dataset, members FROM c WHERE NOT EXISTS (SELECT 1 FROM around v WHERE v.dataset = c.dataset AND list_has_all(v.near, c.members))"""
ORACLE["recall_density"] = f"""WITH {SUMMARY}, g AS (SELECT range / 50.0::DOUBLE AS x FROM range(0, 51))
    SELECT dataset, round(x, 6) AS x, round(avg(exp(-(x - recall) * (x - recall) / (2 * 0.05::DOUBLE * 0.05::DOUBLE))) / (0.05::DOUBLE * sqrt(2 * pi())), 6) AS density FROM s, g GROUP BY ALL"""

ORACLE["grid_expand"] = """WITH lists AS (SELECT m AS metric, 'lists' AS algorithm, false AS disabled, '["' || m || '", ' || n || ', 64]' AS arguments, 3 AS evaluations FROM (VALUES ('euclidean'), ('cosine')) t(m), (VALUES (16), (32)) u(n))
    SELECT * FROM lists UNION ALL SELECT 'cosine', 'graph', false, a, 2 FROM (VALUES ('[[8, 1.0]]'), ('[[16, 1.2]]')) t(a)
    UNION ALL SELECT 'euclidean', 'graph', true, a, 0 FROM (VALUES ('[8, 16]'), ('[8, 10]'), ('[16, 10]'), ('[24, 10]')) t(a)"""
ORACLE["grid_runs"] = """SELECT 'lists' AS algorithm, 'results/embeddings/10/lists/cosine_' || n || '_64' AS path, q::VARCHAR AS parameters FROM (VALUES (16), (32)) t(n), (VALUES (1), (2), (4)) u(q) WHERE NOT (n = 16 AND q = 2)
    UNION ALL SELECT 'graph', 'results/embeddings/10/graph/' || a, b || '_5' FROM (VALUES ('8_1_0'), ('16_1_2')) t(a), (VALUES ('10'), ('20')) u(b)"""
ORACLE["grid_capabilities"] = "SELECT * FROM (VALUES ('lists', 'float', ['any']), ('graph', 'float', ['any', 'euclidean'])) t(name, point_type, metrics)"

ORACLE["dataset_names"] = """WITH p AS (SELECT dataset, string_split(dataset, '-') AS p FROM dataset_info), i AS (SELECT *, list_position(list_transform(p, lambda x: regexp_full_match(x, '[0-9]+')), true) AS i FROM p)
    SELECT dataset, p[i]::INT AS dimension, CASE WHEN i > 0 THEN coalesce(p[i + 1], 'normalized') END AS distance, CASE WHEN i > 0 THEN coalesce(p[i + 2], 'float') END AS point_type, array_to_string(p[:greatest(len(p) - 2, 0)], '-') AS title FROM i"""
ORACLE["parameter_slugs"] = r"SELECT params, slug, sha256(slug) AS marker FROM (SELECT DISTINCT params, trim(regexp_replace(params, '\W+', '_', 'g'), '_') AS slug FROM summary)"
ORACLE["distinct_texts"] = "SELECT min(doc_id) AS doc_id, arg_min(coalesce(source, ''), doc_id) AS source FROM documents WHERE text IS NOT NULL GROUP BY text"
ORACLE["joined_texts"] = "SELECT doc_id, trim(concat_ws(' ', source, lang, dataset)) AS text FROM documents"
ORACLE["first_text"] = "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY created_at NULLS FIRST, doc_id) = 1"
ORACLE["encoded_texts"] = """SELECT doc_id AS vec_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) <= 100 THEN 'test' ELSE 'train' END AS part, 64 AS dimension
    FROM (SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text)"""

ORACLE["pricing_summary"] = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS gross,
    round(avg(l_discount), 2) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
ORACLE["nation_revenue"] = """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
BEATEN = "FROM lineitem a WHERE {} EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_quantity >= a.l_quantity AND b.l_discount >= a.l_discount AND (b.l_quantity > a.l_quantity OR b.l_discount > a.l_discount))"
ORACLE["dominated_lines"] = "SELECT DISTINCT l_orderkey, l_linenumber " + BEATEN.format("")
ORACLE["front_lines"] = "SELECT l_orderkey, l_linenumber " + BEATEN.format("NOT")
ORACLE["customers_without_urgent_orders"] = "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"
ORACLE["customers_with_orders"] = "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"
ORACLE["orders_per_customer"] = "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"
ORACLE["nation_pairs"] = "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name"
ORACLE["status_pivot"] = "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag"
ORACLE["unpivoted_prices"] = "SELECT p_partkey, 'size' AS kind, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part"
ORACLE["two_level_mean"] = """SELECT c_mktsegment, round(avg(m), 4) AS mean, count(*) FILTER (m > 200000) AS large, count(DISTINCT o_custkey) AS customers
    FROM (SELECT c_mktsegment, o_custkey, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY c_mktsegment"""
ORACLE["largest_order"] = "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1"
ORACLE["running_maximum"] = "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS so_far FROM orders"
ORACLE["order_positions"] = "SELECT o_orderstatus, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders"
ORACLE["quantity_bands"] = "SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity >= 40 THEN 'large' END AS band, count(*) AS n, round(sum(ln(l_extendedprice)), 4) AS logs FROM lineitem GROUP BY 1"
ORACLE["names_union"] = "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier"
ORACLE["parts_not_in_large_lots"] = "SELECT p_partkey AS partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 45"

ORACLE["events_tumbling"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
ORACLE["events_sliding"] = """SELECT time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 4) t(i) GROUP BY ALL"""
ORACLE["events_sessions"] = """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session"""

ORACLE["cpu_ranges"] = "SELECT * FROM (VALUES ('0-3,8', [0, 1, 2, 3, 8]), ('5-2', [2, 3, 4, 5]), ('7', [7])) t(given, cpus)"
ORACLE["fbin_round_trip"] = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, embedding::DOUBLE[] AS embedding FROM embeddings"
ORACLE["glove_round_trip"] = "SELECT 'w' || vec_id AS token, embedding::DOUBLE[] AS embedding FROM embeddings"
ORACLE["dataset_round_trip"] = f"""WITH {VECTORS}, near AS ({nearest(DISTANCE["euclidean"], 10)}), means AS (SELECT qid, round(avg({DISTANCE["euclidean"]}), 6) AS avg_distance FROM q, c GROUP BY qid)
    SELECT qid, rank, vec_id, distance, avg_distance FROM near JOIN means USING (qid)"""
ORACLE["results_round_trip"] = "SELECT 'run' || o_orderstatus AS run, o_orderkey AS qid, o_totalprice * CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS time FROM orders"
ORACLE["front_points"] = f"""WITH {SUMMARY}, f AS (SELECT dataset, algorithm, qps, recall FROM s a WHERE k = 100 AND NOT EXISTS (SELECT 1 FROM s b
    WHERE b.k = 100 AND b.dataset = a.dataset AND b.algorithm = a.algorithm AND b.qps >= a.qps AND b.recall >= a.recall AND (b.qps > a.qps OR b.recall > a.recall)))
    SELECT dataset, algorithm, count(DISTINCT (qps, recall))::INT AS steps, max(qps) AS fastest, max(recall) AS best_recall FROM f GROUP BY ALL"""

#: The names, read in the data, under which the three fields of result files stand.
FIELD_NAMES = {
    "best_qps": ["best_qps", "BestQPS", "bestQps", "qps_best", "BEST_QPS", "best-qps", "attrs.best_qps", "metrics.bestQps", "best_queries_per_second", "best qps"],
    "best_search_time": ["best_search_time", "best-search-time", "attrs.best_search_time", "search_time_best", "timing.best_search_time", "BestSearchTime", "bestSearchTime", "best_search_seconds", "best_search_time_ms"],
    "recalls": ["recalls", "Recalls", "metrics.recalls", "recall_per_query", "per-query-recalls", "RECALLS", "data.recalls", "recallValues", "recall_list"],
}
_NAMES = ", ".join(f"('{f}', '{p}', '/{p.replace('.', '/')}')" for f, paths in FIELD_NAMES.items() for p in paths)
_KIND = "CASE WHEN {0} IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN {0} = 'VARCHAR' THEN 'string' WHEN {0} = 'BOOLEAN' THEN 'boolean' END"
_SERIES = "PARTITION BY dataset, algorithm, field ORDER BY written_at NULLS FIRST, file_id"
FILE_FIELDS = f"""files AS (
    SELECT file_id, dataset, algorithm, written_at, body::JSON AS body FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY arrived_at NULLS LAST, body) AS nth FROM results WHERE file_id IS NOT NULL)
    WHERE nth = 1 AND CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' ELSE false END
), names(field, path, pointer) AS (VALUES {_NAMES}), found AS (
    SELECT file_id, field, path, body -> pointer AS value FROM files JOIN names ON json_exists(body, pointer)
), typed AS (
    SELECT file_id, field, path, value, CASE WHEN json_type(value) = 'ARRAY'
        THEN 'array of ' || nullif(array_to_string(list_sort(list_distinct(list_transform(list_filter(value::JSON[], lambda x: json_type(x) <> 'NULL'), lambda x: {_KIND.format("json_type(x)")} || 's'))), ' and '), '')
        ELSE {_KIND.format("json_type(value)")} END AS type FROM found
), grid AS (
    SELECT file_id, dataset, algorithm, written_at, field, path, type, value FROM files CROSS JOIN (SELECT DISTINCT field FROM names) LEFT JOIN typed USING (file_id, field)
)"""
_CHANGES = f"""WITH {FILE_FIELDS}, steps AS (
    SELECT *, row_number() OVER w AS place, lag(path) OVER w AS before, count(*) FILTER (path IS NOT NULL) OVER w AS present FROM grid WINDOW w AS ({_SERIES})
), runs AS (SELECT *, place - present AS run FROM steps), types AS (
    SELECT *, lag(type IGNORE NULLS) OVER (PARTITION BY dataset, algorithm, field, run, path IS NULL ORDER BY place) AS known FROM runs
), changes AS (
    SELECT file_id, dataset, algorithm, written_at, field, CASE WHEN before IS NULL THEN 'added' WHEN path IS NULL THEN 'removed' ELSE 'renamed' END AS change, before AS old, path AS new
    FROM types WHERE place > 1 AND path IS DISTINCT FROM before
    UNION ALL SELECT file_id, dataset, algorithm, written_at, field, 'retyped', known, type FROM types WHERE type <> known)"""
ORACLE["p6_changes"] = f"{_CHANGES} SELECT * FROM changes"
ORACLE["p6_found"] = f"{_CHANGES} SELECT file_id, field, change FROM changes"
_PARSED = """CASE WHEN len(list_filter(parts, lambda x: try_cast(x AS DOUBLE) IS NULL)) = 0 THEN list_transform(parts, lambda x: x::DOUBLE) ELSE [] END"""
ORACLE["p6_values"] = f"""WITH {FILE_FIELDS}, items AS (
    SELECT file_id, field, path, unnest(CASE WHEN json_type(value) = 'ARRAY' THEN value::JSON[] ELSE [value] END) AS item, generate_subscripts(CASE WHEN json_type(value) = 'ARRAY' THEN value::JSON[] ELSE [value] END, 1) AS nth FROM found
), split AS (
    SELECT file_id, field, path, nth, json_type(item) AS kind, list_filter(regexp_split_to_array(regexp_replace(item ->> '$', '[,;]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS parts FROM items
), numbers AS (
    SELECT file_id, field, any_value(path) AS path, flatten(list({_PARSED} ORDER BY nth) FILTER (kind IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT'))) AS v FROM split GROUP BY file_id, field
), scaled AS (SELECT file_id, field, list_transform(v, lambda x: x * CASE WHEN path LIKE '%_ms' THEN 0.001::DOUBLE ELSE 1::DOUBLE END) AS v FROM numbers)
    SELECT file_id, dataset, algorithm, written_at, round(list_max(q.v), 6) AS best_qps, round(list_min(t.v), 12) AS best_search_time, list_transform(coalesce(r.v, CASE WHEN has.file_id IS NOT NULL THEN [] END), lambda x: round(x, 6)) AS recalls
    FROM files LEFT JOIN (FROM scaled WHERE field = 'best_qps') q USING (file_id) LEFT JOIN (FROM scaled WHERE field = 'best_search_time') t USING (file_id) LEFT JOIN (FROM scaled WHERE field = 'recalls') r USING (file_id)
    LEFT JOIN (SELECT file_id FROM found WHERE field = 'recalls') has USING (file_id)"""

ORACLE["grid_inventory"] = """SELECT * FROM (VALUES ('hnswlib', 9, 144), ('ivf(faiss)', 4, 34), ('ivfpqfs(faiss)', 4, 170), ('mrpt', 1, 16), ('pag', 12, 108), ('pdx', 1, 10), ('cuvs-cagra', 21, 588)) t(algorithm, definitions, evaluations)"""
_DRAWN = "row_number() OVER (ORDER BY md5(vec_id || ':42'), vec_id)"
ORACLE["dataset_builds"] = f"""WITH texts AS (SELECT min(doc_id) AS vec_id FROM documents WHERE text IS NOT NULL GROUP BY text)
    SELECT 'agnews-mxbai-1024-euclidean' AS dataset, CASE WHEN {_DRAWN} <= 50 THEN 'test' ELSE 'train' END AS part, vec_id FROM texts
    UNION ALL SELECT 'llama-128-ip', CASE WHEN label < 7 THEN 'train' ELSE q END, vec_id FROM (SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label >= 7 ORDER BY md5(vec_id || ':42'), vec_id) <= 20 THEN 'test' ELSE 'learn' END AS q FROM embeddings)
    UNION ALL SELECT 'glove-200-cosine', CASE WHEN {_DRAWN} <= 30 THEN 'test' ELSE 'train' END, vec_id FROM embeddings"""
ORACLE["export_stats"] = f"SELECT 'embeddings' AS dataset, qid AS query_index, rc1, lid10, rc10, lid100, rc100 FROM ({ORACLE['query_stats']})"
ORACLE["export_info"] = "SELECT dataset, count(DISTINCT vec_id) AS n, max(len(embedding)) AS dimensions FROM vectors WHERE part = 'train' AND embedding IS NOT NULL AND dataset IS NOT NULL GROUP BY dataset"
ORACLE["export_skipped"] = "SELECT 'embeddings' AS dataset, 10 AS k, 'ivf(faiss)' AS algorithm, 'bad' AS run, 'no best_qps or best_search_time' AS reason"
_RECALLS = f"SELECT qid, round(count(f.distance) FILTER (f.distance <= far) / 10.0::DOUBLE, 6) AS recall, {{0}} AS n FROM bound LEFT JOIN ({{1}}) f USING (qid) GROUP BY qid"
_BOTH = " UNION ALL ".join(_RECALLS.format(n, _probed(n)) for n in (1, 2))
ORACLE["export_summary"] = f"""WITH {CELLS}, {TRUTH}, r AS ({_BOTH})
    SELECT 10 AS k, 'embeddings' AS dataset, 'ivf(faiss)' AS algorithm, n::VARCHAR AS params, 1 / n::DOUBLE AS qps, round(avg(recall), 6) AS recall, 1.0::DOUBLE AS build_time, 2.0::DOUBLE AS index_size FROM r GROUP BY n"""
ORACLE["export_detail"] = f"""WITH {CELLS}, {TRUTH}, r AS ({_BOTH}), comps AS (SELECT qid, n, 16 + count(vec_id) AS comps FROM probes JOIN (VALUES (1), (2)) t(n) ON r <= n LEFT JOIN assigned USING (cell) GROUP BY qid, n)
    SELECT 'embeddings' AS dataset, qid AS query_index, 10 AS k, n::VARCHAR AS params, comps::DOUBLE AS time, recall FROM r JOIN comps USING (qid, n)"""


def _recipes() -> str:
    from vecquarry.sources.recipes import TABLE

    lines = ", ".join("('" + " ".join(x.split()) + "')" for x in TABLE.strip().splitlines())
    return f"""WITH t AS (SELECT string_split(line, ' ') AS w FROM (VALUES {lines}) v(line)), p AS (SELECT *, string_split(w[1], '-') AS p FROM t),
        i AS (SELECT *, list_position(list_transform(p, lambda x: regexp_full_match(x, '[0-9]+')), true) AS i FROM p)
        SELECT w[1] AS dataset, w[2] AS kind, array_to_string(w[3:], ' ') AS sources, p[i]::INT AS dimension, coalesce(p[i + 1], 'normalized') AS distance, coalesce(p[i + 2], 'float') AS point_type FROM i"""


ORACLE["dataset_recipes"] = _recipes()
ORACLE["contrast_ridge"] = f"""WITH rc AS (SELECT label::VARCHAR AS dataset, ln(rc10) AS c FROM ({ORACLE["query_stats"]}) s JOIN embeddings ON qid = vec_id WHERE rc10 >= 1), g AS (SELECT range * 3.5::DOUBLE / 999 AS x FROM range(0, 1000))
    SELECT dataset, round(x, 6) AS x, round(avg(exp(-(x - c) * (x - c) / (2 * 0.05::DOUBLE * 0.05::DOUBLE))) / (0.05::DOUBLE * sqrt(2 * pi())), 6) AS density FROM rc, g GROUP BY ALL"""
ORACLE["npy_round_trip"] = "SELECT r AS vec_id, embedding::DOUBLE[] AS embedding FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n, embedding FROM embeddings) WHERE r >= 1 AND r < n - 2"
ORACLE["corpus_lines"] = "SELECT doc_id::VARCHAR AS id, md5(trim(coalesce(source, '') || ' ' || coalesce(text, ''), ' ')) AS text FROM documents"
ORACLE["first_captions"] = "SELECT n_regionkey::BIGINT AS image_id, arg_min(n_name, n_nationkey) AS caption FROM nation GROUP BY n_regionkey"
ORACLE["learn_round_trip"] = f"""WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS qid, e AS x FROM c WHERE vec_id % 20 = 7)
    SELECT qid AS learn_id, rank, vec_id FROM ({nearest(DISTANCE["euclidean"], 5)})"""
ORACLE["rows_in_range"] = "SELECT vec_id FROM embeddings WHERE vec_id >= 100 AND vec_id < 150"
ORACLE["resplit_parts"] = "SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY md5(vec_id || ':1'), vec_id) <= 100 THEN 'test' ELSE 'train' END AS part FROM (SELECT DISTINCT vec_id FROM vectors WHERE part = 'train')"
ORACLE["mahalanobis_given"] = """WITH s AS (SELECT vec_id, list_sum(embedding::DOUBLE[]) AS s, list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v)) AS ss FROM embeddings)
    SELECT vec_id, round(sqrt((ss - s * s / 66) / 2), 6) AS distance FROM s"""
ORACLE["frechet_shift"] = "SELECT round(sqrt(max(len(embedding)) * 0.0625::DOUBLE), 4) AS distance FROM embeddings"
ORACLE["search_recalls"] = """SELECT search, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS queries, true AS reached FROM (VALUES ('ivf_kmeans_search'), ('ivf_sq8_search'), ('ivf_pq_search'), ('ivf_bits_search'),
    ('lsh_search'), ('tree_search'), ('tree_supervised_search'), ('graph_search'), ('lowrank_search')) t(search)"""
ORACLE["events_streamed"] = ORACLE["events_tumbling"]
ORACLE["sessions_streamed"] = ORACLE["events_sessions"]
