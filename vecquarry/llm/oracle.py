"""The same results in SQL, for the queries it can express."""

from vecquarry.llm.quality import MORE_WORDS

SOUND = """sound AS (
    SELECT DISTINCT k, dataset, algorithm, params, qps, recall, build_time, index_size, run_at FROM summary
    WHERE dataset IS NOT NULL AND algorithm IS NOT NULL AND isfinite(qps) AND qps > 0 AND recall BETWEEN 0 AND 1)"""

RANKED = f"""{SOUND}, taken AS (
    SELECT *, count(*) OVER g AS n FROM sound
    WHERE isfinite(build_time) AND build_time >= 0 AND isfinite(index_size) AND index_size >= 0 WINDOW g AS (PARTITION BY dataset, k)
), better AS (
    SELECT *, [rank() OVER (PARTITION BY dataset, k ORDER BY qps DESC) - 1, rank() OVER (PARTITION BY dataset, k ORDER BY recall DESC) - 1,
               rank() OVER (PARTITION BY dataset, k ORDER BY build_time) - 1, rank() OVER (PARTITION BY dataset, k ORDER BY index_size) - 1] AS b
    FROM taken)"""

TIMES = """times AS (
    SELECT DISTINCT * FROM detail WHERE dataset IS NOT NULL AND isfinite(time) AND time > 0)"""

UNITS = """usable AS (
    SELECT DISTINCT ON (vec_id) dataset, part, vec_id, embedding::DOUBLE[] AS e FROM vectors JOIN dataset_info USING (dataset)
    WHERE len(embedding) = dimension AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = dimension
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

ORACLE = {
    "p2_found": f"""WITH {UNITS} SELECT least(a.vec_id, b.vec_id) AS vec_id_a, greatest(a.vec_id, b.vec_id) AS vec_id_b FROM usable a JOIN usable b
        ON a.dataset = b.dataset AND a.part = 'train' AND b.part <> 'train' WHERE round(list_cosine_similarity(a.e, b.e), 6) >= 0.995""",
    "p3_found": f"""WITH {UNITS}, near AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.dataset = b.dataset AND b.part = 'train' AND a.vec_id <> b.vec_id
        QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) <= 5)
        SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM near""",
    "p1_found": f"WITH {RANKED} SELECT dataset, k, algorithm, params FROM better WHERE n >= 20 AND list_max(b) * 10 < n",
    "p1_ranking": f"""WITH {RANKED}, vectors AS (SELECT *, list_reverse_sort(b) AS v FROM better)
        SELECT dataset, k, row_number() OVER (PARTITION BY dataset, k ORDER BY v, algorithm, params) AS rank, algorithm, params,
               list_transform(v, lambda x: 1 - x / n::DOUBLE) AS percentiles, qps, recall, build_time, index_size FROM vectors""",
    "p4_found": f"""WITH {TIMES} SELECT dataset, algorithm FROM times GROUP BY ALL
        HAVING count(*) >= 150 AND quantile_disc(time::DOUBLE, 0.99) >= 10 * quantile_disc(time::DOUBLE, 0.5)""",
    "p5_found": f"""WITH {SOUND} SELECT dataset, algorithm, params FROM sound WHERE k = 100 AND recall >= 0.9
        QUALIFY row_number() OVER (PARTITION BY dataset, algorithm ORDER BY qps DESC, recall DESC, params) <= 3""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}

NEAR = f"""{UNITS}, near AS (
        SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM usable a JOIN usable b ON a.dataset = b.dataset AND b.part = 'train' AND a.vec_id <> b.vec_id
        QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) <= 5)"""
ORACLE["p3_neighbours"] = f"WITH {NEAR} SELECT * FROM near"
ORACLE["p2_report"] = f"""WITH {UNITS}, pairs AS (SELECT a.dataset, b.part, a.vec_id AS train_id, b.vec_id AS eval_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM usable a JOIN usable b
        ON a.dataset = b.dataset AND a.part = 'train' AND b.part <> 'train' WHERE round(list_cosine_similarity(a.e, b.e), 6) >= 0.995), sources AS (SELECT vec_id AS eval_id, min(source) AS source FROM vectors GROUP BY vec_id)
        SELECT dataset, part, source, count(*) AS pairs, count(DISTINCT eval_id) AS eval_vectors, count(DISTINCT train_id) AS train_vectors, count(*) FILTER (cosine = 1) AS same FROM pairs JOIN sources USING (eval_id) GROUP BY ALL"""
_AT = ", ".join(f"v[greatest(1, ceil({p} * len(v) - 1e-9))::INT] AS {n}" for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p99_9", 0.999)))
# groups of so few values are kept whole by a sketch; larger ones are within its bounds, not equal
ORACLE["p4_daily"] = f"""WITH {TIMES}, days AS (SELECT dataset, algorithm, measured_at::DATE AS day, list_sort(list(time::DOUBLE)) AS v FROM times GROUP BY ALL)
        SELECT dataset, algorithm, day, len(v) AS n, {_AT} FROM days"""

_BLANK = r"\s\p{Z}\x0b\x1c-\x1f\x{85}"
_WORD = r"\p{Han}|(?:[^\P{L}\p{Han}]|\p{M})*[^\P{L}\p{Han}](?:[^\P{L}\p{Han}]|\p{M})*"
_FOLD = r"regexp_replace(strip_accents(lower({})), '\p{{M}}', '', 'g')"
_PLAIN = r"\p{L}\p{M}\p{N}.,;:!?''\"()\-…‐‑‒–—―‘’‚‛“”„‟«»¿¡、。，！？：；（）「」『』《》"
_SHORT = r"""regexp_replace(regexp_replace(regexp_replace(text, '<[a-zA-Z/!][^<>]*>', ' ', 'g'), 'https?://[^""" + _BLANK + r"""，。]+', ' ', 'g'), '[\x{AD}\x{200B}-\x{200F}\x{2060}\x{2600}-\x{27BF}\x{FE0E}\x{FE0F}\x{FEFF}\x{1F000}-\x{1FAFF}]', '', 'g')"""
ORACLE["p9_statistics"] = f"""WITH given AS (SELECT word FROM common_words WHERE word IS NOT NULL UNION ALL SELECT unnest(string_split('{" ".join(MORE_WORDS.split())}', ' '))),
    known AS (SELECT DISTINCT {_FOLD.format("w")} AS w FROM (SELECT unnest(regexp_extract_all(word, '{_WORD}')) AS w FROM given)), known_list AS (SELECT list(w) AS ws FROM known),
    lines AS (SELECT doc_id, unnest(regexp_split_to_array({_SHORT}, '[\\n\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS t FROM documents),
    solid AS (SELECT doc_id, t, regexp_replace(t, '[{_BLANK}]', '', 'g') AS packed FROM lines WHERE regexp_matches(t, '[^{_BLANK}]')),
    counted AS (SELECT doc_id, length(packed) AS chars, length(regexp_replace(packed, '[{_PLAIN}]', '', 'g')) AS symbols, length(regexp_replace(t, '\\P{{L}}', '', 'g')) AS letters,
        regexp_matches(packed, '[.!?…。！？:;]["''”’)»」]?$')::INT AS ends, list_transform(regexp_extract_all(t, '{_WORD}'), lambda w: {_FOLD.format("w")}) AS words FROM solid),
    sums AS (SELECT doc_id, sum(len(words)) AS words, sum(letters) AS letters, sum(symbols) AS symbols, sum(chars) AS chars, avg(ends) AS ends, sum(len(list_filter(words, lambda w: list_contains(ws, w)))) AS common FROM counted, known_list GROUP BY doc_id)
    SELECT doc_id, coalesce(words, 0)::BIGINT AS words, round(letters / nullif(words, 0), 9) AS mean_word_length, round(symbols / chars, 9) AS symbol_ratio, round(ends, 9) AS ending_share, round(common / nullif(words, 0), 9) AS common_share
    FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN sums USING (doc_id)"""
ORACLE["p4_bounds"] = f"WITH {TIMES} SELECT dataset, algorithm, count(*) AS n, true AS p50, true AS p90, true AS p99, true AS p99_9 FROM times GROUP BY ALL"
ORACLE["p8_checks"] = "SELECT t.source, target_weight, max_repeats, count(doc_id) AS docs, true AS met, true AS within FROM mix_targets t LEFT JOIN documents d ON d.source = t.source GROUP BY ALL"
