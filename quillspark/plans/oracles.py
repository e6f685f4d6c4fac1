"""The registered queries in DuckDB SQL, put together from named parts."""

from __future__ import annotations

from quillspark.config import BM25_B, BM25_EPSILON, BM25_K1, CHUNKINGS, DEPTH, PARAGRAPH_TOKENS, RRF_CONSTANT, SEARCHES, TOP_KS, WINDOWS, sample_configs
from quillspark.operators.analyze import MEASURES, MODES

WS = r"[\s\x1c-\x1f\x85\p{Z}]"
LINE, THRESHOLD, CATEGORIES = r"chr(10)", "0.1e0", 5


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{WS}+'), lambda w: w <> '')"


def terms(x: str) -> str:
    return words(f"lower({x})")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace(coalesce({x}, ''), '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def q(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits})"


def cosine(a: str, b: str) -> str:
    """Of two term lists as sets."""
    return f"(len(list_intersect({a}, {b})) / (sqrt(len(list_distinct({a}))::double) * sqrt(len(list_distinct({b}))::double) + 1e-10))"


DOCS = "docs AS (SELECT doc_id::varchar AS source_file, text FROM documents)"
QUESTIONS = "questions AS (SELECT item_id::varchar AS question_id, text AS question FROM benchmark)"
KEYWORD_QUESTIONS = f"""questions AS (SELECT item_id::varchar AS question_id, array_to_string(list_transform(list_slice(list_sort(list_transform(list_distinct({terms("text")}), lambda w: {{'n': -length(w), 'w': w}})), 1, 4), lambda x: x.w), ' ') AS question FROM benchmark)"""
GOLD = "gold AS (SELECT DISTINCT question_id, source_file FROM docs JOIN questions ON contains(text, question))"


def _windows(name: str) -> str:
    window, overlap = WINDOWS[name]
    stride = window - overlap
    return f"""{name} AS (SELECT '{name}' AS strategy, source_file, i AS chunk_index, array_to_string(list_slice(w, i * {stride} + 1, i * {stride} + {window}), ' ') AS text FROM
        (SELECT source_file, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, ceil((len(w) - {overlap}) / {float(stride)}e0)::bigint) END)) AS i FROM (SELECT source_file, {words("text")} AS w FROM docs)))"""


_PARAGRAPH = f"""paragraph AS (WITH parts AS (SELECT source_file, list_filter(list_transform(string_split(coalesce(text, ''), {LINE}), lambda p: {strip("p")}), lambda p: p <> '') AS p FROM docs),
    folded AS (SELECT source_file, list_reduce(list_transform(p, lambda x: {{'done': [x], 'buf': '', 'n': 0::bigint}}), lambda a, x:
        CASE WHEN a.n + len({words("x.done[1]")}) >= {PARAGRAPH_TOKENS} THEN {{'done': list_concat(a.done, [CASE WHEN a.buf = '' THEN x.done[1] ELSE a.buf || {LINE} || x.done[1] END]), 'buf': '', 'n': 0::bigint}}
        ELSE {{'done': a.done, 'buf': CASE WHEN a.buf = '' THEN x.done[1] ELSE a.buf || {LINE} || x.done[1] END, 'n': a.n + len({words("x.done[1]")})}} END, {{'done': []::varchar[], 'buf': '', 'n': 0::bigint}}) AS f FROM parts),
    closed AS (SELECT source_file, CASE WHEN f.buf = '' THEN f.done WHEN len(f.done) = 0 THEN [f.buf] ELSE list_concat(list_slice(f.done, 1, len(f.done) - 1), [f.done[len(f.done)] || {LINE} || f.buf]) END AS t FROM folded)
    SELECT 'paragraph' AS strategy, source_file, i - 1 AS chunk_index, t[i] AS text FROM (SELECT source_file, t, unnest(range(1, len(t) + 1)) AS i FROM closed))"""

_SEMANTIC = f"""semantic AS (WITH split AS (SELECT source_file, coalesce(text, '') AS text, {sentences("text")} AS s FROM docs),
    termed AS (SELECT *, list_transform(s, lambda x: {terms("x")}) AS t FROM split),
    sized AS (SELECT source_file, text, s, list_reduce(list_transform(range(1, len(s)), lambda i: [CASE WHEN {cosine("t[i]", "t[i + 1]")} >= {THRESHOLD} THEN 1::bigint ELSE 0::bigint END]), lambda a, x:
        CASE WHEN x[1] = 1 THEN list_concat(list_slice(a, 1, len(a) - 1), [a[len(a)] + 1]) ELSE list_concat(a, [1::bigint]) END, [1::bigint]) AS g FROM termed WHERE len(s) > 2),
    merged AS (SELECT source_file, s, list_reduce(list_transform(range(1, len(g) + 1), lambda i: [g[i], g[i + 1]]), lambda a, x:
        CASE WHEN x[1] < 2 AND len(a) > 0 AND (x[2] IS NULL OR a[len(a)] <= x[2]) THEN list_concat(list_slice(a, 1, len(a) - 1), [a[len(a)] + x[1]]) ELSE list_concat(a, [x[1]]) END, []::bigint[]) AS m FROM sized)
    SELECT 'semantic' AS strategy, source_file, i - 1 AS chunk_index, array_to_string(list_slice(s, coalesce(list_sum(m[1:i - 1]), 0)::bigint + 1, list_sum(m[1:i])::bigint), ' ') AS text FROM (SELECT source_file, s, m, unnest(range(1, len(m) + 1)) AS i FROM merged)
    UNION ALL SELECT 'semantic', source_file, 0, text FROM split WHERE len(s) <= 2)"""

_CHUNKERS = {"fixed_256": _windows("fixed_256"), "fixed_512": _windows("fixed_512"), "paragraph": _PARAGRAPH, "semantic": _SEMANTIC}


def _chunk_sql(name: str) -> str:
    return f"WITH {DOCS}, {_CHUNKERS[name]} SELECT source_file, chunk_index::bigint AS chunk_index, len({words('text')})::bigint AS n_tokens, md5(text) AS text_md5 FROM {name}"


ALL_CHUNKS = ", ".join(_CHUNKERS.values()) + ", chunks AS (" + " UNION ALL ".join(f"SELECT strategy, source_file, chunk_index::bigint AS chunk_index, text FROM {s}" for s in CHUNKINGS) + ")"
WHOLE_CHUNKS = "chunks AS (SELECT 'whole' AS strategy, source_file, 0::bigint AS chunk_index, text FROM docs)"

INDEX = f"""tokens AS MATERIALIZED (SELECT strategy, source_file, chunk_index, {terms("text")} AS t FROM chunks),
    postings AS MATERIALIZED (SELECT strategy, source_file, chunk_index, term, count(*) AS tf FROM (SELECT strategy, source_file, chunk_index, unnest(t) AS term FROM tokens) GROUP BY ALL),
    corpus AS (SELECT strategy, count(*) AS n, sum(len(t))::double / count(*) AS avgdl FROM tokens GROUP BY strategy),
    freq AS (SELECT strategy, term, count(*) AS df, sum(tf) AS cf FROM postings GROUP BY ALL),
    raw AS (SELECT strategy, term, df, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS raw, ln(1 + n::double / df) AS weight FROM freq JOIN corpus USING (strategy)),
    stats AS MATERIALIZED (SELECT strategy, term, df, CASE WHEN raw < 0 THEN {BM25_EPSILON}e0 * mean ELSE raw END AS idf, weight FROM raw JOIN (SELECT strategy, avg(raw) AS mean FROM raw GROUP BY strategy) USING (strategy)),
    norms AS (SELECT strategy, source_file, chunk_index, sqrt(sum(pow(tf * weight, 2))) AS norm FROM postings JOIN stats USING (strategy, term) GROUP BY ALL),
    dl AS (SELECT strategy, source_file, chunk_index, len(t) AS dl FROM tokens)"""

PAIRS = f"""qterms AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest({terms("question")}) AS term FROM questions) GROUP BY ALL),
    qstats AS (SELECT question_id, strategy, term, qtf, idf, weight, qtf * weight AS qw FROM qterms JOIN stats USING (term)),
    qnorms AS (SELECT strategy, question_id, sqrt(sum(qw * qw)) AS qnorm FROM qstats GROUP BY ALL), qsizes AS (SELECT question_id, count(*) AS qsize FROM qterms GROUP BY ALL),
    sums AS (SELECT strategy, question_id, source_file, chunk_index, sum(qtf * idf * (tf * {BM25_K1 + 1}e0 / (tf + {BM25_K1}e0 * (1 - {BM25_B}e0 + {BM25_B}e0 * dl / avgdl)))) AS bm25, sum(qw * tf * weight) AS dot, count(*) AS shared
        FROM postings JOIN qstats USING (strategy, term) JOIN dl USING (strategy, source_file, chunk_index) JOIN corpus USING (strategy) GROUP BY ALL),
    scored AS (SELECT strategy, question_id, source_file, chunk_index, bm25, dot / (norm * qnorm + 1e-10) AS cosine, shared::double / qsize AS coverage
        FROM sums JOIN norms USING (strategy, source_file, chunk_index) JOIN qnorms USING (strategy, question_id) JOIN qsizes USING (question_id))"""

_DEPTH = max(TOP_KS) * max(DEPTH.values())
RANKED = f"""lists AS (SELECT *, row_number() OVER (PARTITION BY strategy, question_id ORDER BY {q("cosine", 9)} DESC, source_file, chunk_index) AS vr,
        CASE WHEN bm25 > 0 THEN row_number() OVER (PARTITION BY strategy, question_id ORDER BY CASE WHEN bm25 > 0 THEN {q("bm25", 9)} END DESC NULLS LAST, source_file, chunk_index) END AS br FROM scored),
    ranked AS MATERIALIZED (SELECT * EXCLUDE (vr, br), CASE WHEN vr <= {_DEPTH} THEN vr END AS vr, CASE WHEN br <= {_DEPTH} THEN br END AS br FROM lists WHERE vr <= {_DEPTH} OR br <= {_DEPTH})"""


def hits(searches=SEARCHES, top_ks=TOP_KS) -> str:
    kinds = ", ".join(f"('{s}', {k}, {DEPTH[s] * k})" for s in searches for k in top_ks)
    return f"""kinds(search, top_k, reach) AS (VALUES {kinds}),
    wide AS (SELECT *, coalesce(1e0 / ({RRF_CONSTANT} + v), 0e0) + coalesce(1e0 / ({RRF_CONSTANT} + w), 0e0) AS rrf FROM (SELECT *, CASE WHEN vr <= reach THEN vr END AS v, CASE WHEN br <= reach THEN br END AS w FROM ranked, kinds)
        WHERE (v IS NOT NULL OR w IS NOT NULL) AND (search <> 'vector' OR v IS NOT NULL) AND (search <> 'bm25' OR w IS NOT NULL)),
    fused AS (SELECT *, row_number() OVER (PARTITION BY strategy, search, top_k, question_id ORDER BY {q("rrf", 12)} DESC, v NULLS LAST, w NULLS LAST) AS fr FROM wide),
    hits AS MATERIALIZED (SELECT strategy || '__' || search || '__k' || top_k AS config_name, strategy, search, top_k, question_id, rank, source_file, chunk_index, CASE search WHEN 'vector' THEN cosine WHEN 'bm25' THEN bm25 WHEN 'hybrid' THEN rrf ELSE coverage END AS score FROM
        (SELECT *, row_number() OVER (PARTITION BY strategy, search, top_k, question_id ORDER BY CASE search WHEN 'vector' THEN -v WHEN 'bm25' THEN -w WHEN 'hybrid' THEN -fr ELSE {q("coverage", 9)} END DESC, fr) AS rank FROM fused WHERE search <> 'hybrid_rerank' OR fr <= reach) WHERE rank <= top_k)"""


WHOLE = f"{DOCS}, {QUESTIONS}, {WHOLE_CHUNKS}, {INDEX}, {PAIRS}, {RANKED}"
ASKED = f"""{GOLD}, gold_lists AS (SELECT question_id, list_sort(list(source_file)) AS gold_source_ids FROM gold GROUP BY ALL),
    bad AS (SELECT list(DISTINCT doc_id::varchar) AS distractors FROM labels WHERE quality = 0),
    asked AS (SELECT q.question_id, question, coalesce(gold_source_ids, []) AS gold, coalesce(distractors, []) AS bad, [w[1], w[(len(w) // 2) + 1], w[len(w)]] AS facts, 'cat_' || (q.question_id::bigint % {CATEGORIES}) AS category
        FROM (SELECT *, {words("question")} AS w FROM questions) q LEFT JOIN gold_lists USING (question_id) CROSS JOIN bad)"""


def retrieval_scores(got: str) -> str:
    share = lambda part, whole: f"CASE WHEN {whole} > 0 THEN ({part})::double / {whole} ELSE 0e0 END"
    hit = f"len(list_filter({got}, lambda s: list_contains(gold, s)))"
    covered = f"len(list_filter(gold, lambda g: list_contains({got}, g)))"
    wrong = f"len(list_filter({got}, lambda s: list_contains(bad, s)))"
    return f"{share(hit, f'len({got})')} AS context_precision, CASE WHEN len({got}) > 0 THEN {share(covered, 'len(gold)')} ELSE 0e0 END AS context_recall, {share(wrong, f'len({got})')} AS distractor_rate"


def fact_found(answer: str, fact: str) -> str:
    number = f"regexp_extract({strip(fact)}, '^(-?[\\d,]+\\.?\\d*)%?$', 1)"
    return f"(contains(lower({answer}), lower({fact})) OR ({number} <> '' AND contains(lower({answer}), {number})))"


#: A candidate of each list costs 1 ms, a rescored one 20 ms.
_LATENCY = f"CASE search WHEN 'hybrid' THEN {2 * DEPTH['hybrid']} WHEN 'hybrid_rerank' THEN {22 * DEPTH['hybrid_rerank']} ELSE 1 END"
_RATED = f"list_transform(range(1, len(ss) + 1), lambda i: {{'n': len(list_intersect({terms('ss[i]')}, qt)), 'i': -i, 's': ss[i]}})"
EVAL = f"""{DOCS}, {QUESTIONS}, {ALL_CHUNKS}, {INDEX}, {PAIRS}, {RANKED}, {hits()}, {ASKED},
    configs AS (SELECT c.v || '__' || s.v || '__k' || k.v AS config_name, s.v AS search, k.v AS top_k FROM unnest({list(CHUNKINGS)}) c(v), unnest({list(SEARCHES)}) s(v), unnest({list(TOP_KS)}) k(v)),
    ctx AS (SELECT config_name, question_id, sum(len({words("text")})) + count(*) - 1 AS tokens, list(source_file ORDER BY rank) AS sources, first(text ORDER BY rank) AS best, count(*) AS got FROM hits JOIN chunks USING (strategy, source_file, chunk_index) GROUP BY ALL),
    joined AS (SELECT a.*, coalesce(tokens, 0)::bigint AS tokens, coalesce(sources, []) AS sources, coalesce(best, '') AS best, coalesce(got, 0) AS got FROM (SELECT * FROM configs, asked) a LEFT JOIN ctx USING (config_name, question_id)),
    texts AS (SELECT DISTINCT best, question FROM joined), rated AS (SELECT best, question, {_RATED} AS r FROM (SELECT best, question, {sentences("best")} AS ss, list_distinct({terms("question")}) AS qt FROM texts)),
    answers AS (SELECT best, question, coalesce(list_sort(r, 'DESC')[1].s, '') AS answer FROM rated),
    results AS MATERIALIZED (SELECT config_name, split_part(config_name, '__', 1) AS chunking, search, top_k, question_id, category AS question_category, got AS chunks_retrieved, tokens AS context_tokens, {retrieval_scores("sources")},
        greatest(0e0, least(1e0, {cosine(terms("answer"), terms("question"))})) AS gold_similarity, len(list_filter(facts, lambda f: {fact_found("answer", "f")}))::double / len(facts) AS fact_recall, len(facts) - len(list_filter(facts, lambda f: {fact_found("answer", "f")})) AS n_missing,
        (top_k * {_LATENCY})::double AS retrieval_latency_ms, 0.5e0 * tokens AS generation_latency_ms, top_k * {_LATENCY} + 0.5e0 * tokens AS total_latency_ms, answer FROM joined JOIN answers USING (best, question))"""
SUMMARY = f"{EVAL}, summary AS MATERIALIZED (SELECT config_name, {', '.join(f'avg({m})::double AS avg_{m}' for m in MEASURES)} FROM results GROUP BY config_name), rated_configs AS (SELECT *, {q('avg_gold_similarity', 9)} AS q FROM summary)"
MODE = "CASE WHEN gold_similarity >= 0.8 AND fact_recall >= 0.8 THEN 'correct' WHEN context_precision < 0.3 THEN 'wrong_source' WHEN context_recall < 0.5 THEN 'insufficient' WHEN gold_similarity >= 0.5 THEN 'partial' ELSE 'wrong_source' END"
_COUNTS = f"counts AS (SELECT config_name, {', '.join(f'count(*) FILTER (WHERE mode = {m!r}) AS {m}' for m in MODES)}, count(*) AS total FROM (SELECT config_name, {MODE} AS mode FROM results) GROUP BY config_name)"
_TURNS = "pairs AS (SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"


def _hits_sql(search: str, k: int) -> str:
    return f"WITH {WHOLE}, {hits((search,), (k,))} SELECT question_id, rank::bigint AS rank, source_file, {q('score')} AS score FROM hits"


def _dense(k: int, columns: str) -> str:
    return f"""WITH v AS (SELECT vec_id AS id, embedding::double[] AS vec, label FROM embeddings),
        sims AS (SELECT a.id AS query_id, b.id AS id, a.label AS ql, b.label AS label, list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)) + 1e-10) AS score FROM v a, v b WHERE a.id % 20 = 0 AND a.id <> b.id),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {q("score", 9)} DESC, id) AS rank FROM sims) {columns.format(k=k)}"""


def _det(a, b, c, d, e, f, g, h, i) -> str:
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_WHOLE_DET = _det("s0", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4")
_C = (_det("y0", "s1", "s2", "y1", "s2", "s3", "y2", "s3", "s4"), _det("s0", "y0", "s2", "s1", "y1", "s3", "s2", "y2", "s4"), _det("s0", "s1", "y0", "s1", "s2", "y1", "s2", "s3", "y2"))

ORACLES: dict[str, str] = {
    "corpus_stats": f"WITH {DOCS} SELECT count(*) AS n_docs, sum(len({words('text')}))::bigint AS n_words, max(len({words('text')}))::bigint AS max_words, sum(length(text))::bigint AS n_chars FROM docs",
    "token_counts": f"WITH {DOCS} SELECT source_file, len({words('text')})::bigint AS n_tokens, len(list_distinct({terms('text')}))::bigint AS n_terms FROM docs",
    "sentence_split": f"WITH {DOCS}, s AS (SELECT source_file, {sentences('text')} AS s FROM docs) SELECT source_file, (i - 1)::bigint AS sentence_index, md5(s[i]) AS sentence_md5 FROM (SELECT source_file, s, unnest(range(1, len(s) + 1)) AS i FROM s)",
    **{f"chunk_{s}": _chunk_sql(s) for s in CHUNKINGS},
    "chunk_counts": f"WITH {DOCS}, {ALL_CHUNKS} SELECT strategy, count(*) AS n_chunks, sum(len({words('text')}))::bigint AS n_tokens FROM chunks GROUP BY strategy",
    "postings_df": f"WITH {DOCS}, {WHOLE_CHUNKS}, {INDEX} SELECT term, df, cf::bigint AS cf FROM freq",
    "term_statistics_bm25": f"WITH {DOCS}, {WHOLE_CHUNKS}, {INDEX} SELECT term, df, {q('idf')} AS idf, {q('weight')} AS weight FROM stats",
    "bm25_topk": _hits_sql("bm25", 10),
    "bm25_topk_bounds": _hits_sql("bm25", 10).replace(QUESTIONS, KEYWORD_QUESTIONS),
    "vector_topk_tfidf": _hits_sql("vector", 5),
    **{f"rrf_hybrid_k{k}": _hits_sql("hybrid", k) for k in TOP_KS},
    **{f"rerank_k{k}": _hits_sql("hybrid_rerank", k) for k in TOP_KS},
    "bm25_positive_only": f"WITH {WHOLE} SELECT question_id, count(*) AS n_positive, {q('max(bm25)')} AS best FROM scored WHERE bm25 > 0 GROUP BY question_id",
    "vector_topk_dense": _dense(5, f"SELECT query_id, rank::bigint AS rank, id, {q('score')} AS score FROM best WHERE rank <= {{k}}"),
    "vector_topk_ivf": _dense(5, f"SELECT query_id, rank::bigint AS rank, id, {q('score')} AS score FROM best WHERE rank <= {{k}}"),
    "vector_topk_pq": _dense(5, f"SELECT query_id, rank::bigint AS rank, id, {q('score')} AS score FROM best WHERE rank <= {{k}}"),
    "vector_label_precision": _dense(10, "SELECT query_id, count(*) FILTER (WHERE ql = label) AS same_label, count(*) AS n FROM best WHERE rank <= {k} GROUP BY query_id"),
    "experiment_plan_rows": f"WITH {QUESTIONS} SELECT c.v || '__' || s.v || '__k' || k.v AS config_name, c.v AS chunking, s.v AS search, k.v::bigint AS top_k, question_id FROM unnest({list(CHUNKINGS)}) c(v), unnest({list(SEARCHES)}) s(v), unnest({list(TOP_KS)}) k(v), questions",
    "config_parse": f"WITH {QUESTIONS} SELECT c.v || '__' || s.v || '__k' || k.v AS config_name, c.v AS chunking, s.v AS search, k.v::bigint AS top_k, count(*) AS n FROM unnest({list(CHUNKINGS)}) c(v), unnest({list(SEARCHES)}) s(v), unnest({list(TOP_KS)}) k(v), questions GROUP BY ALL",
    "question_filter": f"WITH {DOCS}, {QUESTIONS}, {GOLD} SELECT question_id, md5(question) AS question_md5 FROM questions SEMI JOIN gold USING (question_id)",
    "gold_sources": f"WITH {DOCS}, {QUESTIONS}, {GOLD} SELECT question_id, source_file FROM gold",
    "context_assembly": f"WITH {WHOLE}, {hits(('hybrid',), (3,))} SELECT question_id, md5(string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank)) AS context_md5, (sum(len({words('text')})) + count(*) - 1)::bigint AS context_tokens, count(*) AS n_chunks FROM hits JOIN chunks USING (strategy, source_file, chunk_index) GROUP BY question_id",
    "precision_recall_distractor": f"WITH {WHOLE}, {hits(('bm25',), (10,))}, {ASKED}, got AS (SELECT question_id, list(source_file) AS sources FROM hits GROUP BY ALL), s AS (SELECT question_id, {retrieval_scores('sources')} FROM (SELECT asked.*, coalesce(sources, []) AS sources FROM asked LEFT JOIN got USING (question_id))) SELECT question_id, {', '.join(f'{q(c)} AS {c}' for c in ('context_precision', 'context_recall', 'distractor_rate'))} FROM s",
    "retrieved_context_labels": f"WITH {WHOLE}, {hits(('bm25',), (10,))} SELECT coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, count(*) AS n_hits FROM hits LEFT JOIN labels ON doc_id::varchar = source_file GROUP BY ALL",
    "gold_similarity": f"WITH {_TURNS} SELECT conv_id, turn, {q(f'greatest(0e0, least(1e0, {cosine(terms("question"), terms("answer"))}))')} AS similarity FROM pairs",
    "key_fact_recall": f"""WITH {_TURNS}, f AS (SELECT conv_id, turn, coalesce(answer, '') AS answer, list_filter([w[1], w[(len(w) // 2) + 1], w[len(w)]], lambda x: x IS NOT NULL) AS facts FROM (SELECT *, {words("question")} AS w FROM pairs)),
        m AS (SELECT *, list_filter(facts, lambda x: NOT {fact_found("answer", "x")}) AS missing FROM f)
        SELECT conv_id, turn, {q("CASE WHEN len(facts) > 0 THEN (len(facts) - len(missing))::double / len(facts) ELSE 1e0 END")} AS fact_recall, array_to_string(missing, '|') AS missing_facts FROM m""",
    "numeric_fact_match": f"SELECT page_id, count(*) AS n_facts, count(*) FILTER (WHERE {fact_found('html', 'fact')}) AS n_found FROM (SELECT page_id, coalesce(html, '') AS html, unnest(regexp_split_to_array(coalesce(url, ''), '[/?&=#.]')) AS fact FROM pages) WHERE regexp_matches(fact, '[0-9]') GROUP BY page_id",
    "eval_results": f"WITH {EVAL} SELECT config_name, question_id, question_category, chunks_retrieved, context_tokens, {', '.join(f'{q(c)} AS {c}' for c in ('context_precision', 'context_recall', 'distractor_rate', 'gold_similarity', 'fact_recall', 'total_latency_ms'))}, md5(answer) AS answer_md5 FROM results",
    "summary_by_config": f"WITH {SUMMARY} SELECT config_name, {', '.join(f'{q(f"avg_{m}")} AS avg_{m}' for m in MEASURES)} FROM summary",
    "best_worst": f"WITH {SUMMARY} SELECT (SELECT config_name FROM rated_configs ORDER BY q DESC, config_name LIMIT 1) AS best_config, (SELECT config_name FROM rated_configs ORDER BY q, config_name DESC LIMIT 1) AS worst_config",
    **{f"grid_{x}_by_category": f"WITH {EVAL} SELECT question_category, {x}::varchar AS {x}, {q('avg(gold_similarity)')} AS similarity FROM results GROUP BY ALL" for x in ("search", "chunking", "top_k")},
    "grids_in_one_pass": f"WITH {EVAL} SELECT question_category, chunking, search, top_k::bigint AS top_k, {q('avg(gold_similarity)')} AS similarity FROM results GROUP BY GROUPING SETS ((question_category, chunking), (question_category, search), (question_category, top_k))",
    "failure_modes": f"WITH {EVAL}, {_COUNTS} SELECT config_name, {', '.join(MODES)} FROM counts",
    "failure_mode_pct": f"WITH {EVAL}, {_COUNTS} SELECT config_name, mode, {q('100e0 * n / total')} AS pct, {q('100e0 * before / total')} AS bar_start FROM (" + " UNION ALL ".join(f"SELECT config_name, '{m}' AS mode, {m} AS n, {' + '.join(MODES[:i]) or '0'} AS before, total FROM counts" for i, m in enumerate(MODES)) + ")",
    "top10_bottom5": f"WITH {SUMMARY} SELECT place, 'top' AS \"end\", config_name FROM (SELECT config_name, row_number() OVER (ORDER BY q DESC, config_name) AS place FROM rated_configs) WHERE place <= 10 UNION ALL SELECT place, 'bottom', config_name FROM (SELECT config_name, row_number() OVER (ORDER BY q, config_name DESC) AS place FROM rated_configs) WHERE place <= 5",
    "pareto_frontier": f"WITH {SUMMARY}, c AS (SELECT config_name, q, {q('avg_total_latency_ms')} AS c FROM rated_configs), o AS (SELECT *, max(q) OVER (ORDER BY c, config_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c) SELECT config_name, {q('c')} AS cost, {q('q')} AS quality FROM o WHERE before IS NULL OR q > before",
    "plateau_tokens": f"WITH {SUMMARY} SELECT trunc(avg_context_tokens)::bigint AS plateau_tokens FROM rated_configs WHERE (SELECT count(*) FROM summary) > 5 AND q >= 0.95e0 * (SELECT max(q) FROM rated_configs) ORDER BY avg_context_tokens, q, config_name LIMIT 1",
    "trend_fit": f"""WITH {SUMMARY}, b AS (SELECT avg(avg_context_tokens) AS centre, greatest(stddev_pop(avg_context_tokens), 1e-9) AS scale FROM summary), t AS (SELECT avg_context_tokens AS x, avg_gold_similarity AS y, (avg_context_tokens - centre) / scale AS t, centre, scale FROM summary, b),
        s AS (SELECT first(centre) AS centre, first(scale) AS scale, count(DISTINCT x) AS n_x, count(*)::double AS s0, {", ".join(f"sum(pow(t, {k})) AS s{k}" for k in (1, 2, 3, 4))}, {", ".join(f"sum(y * pow(t, {k})) AS y{k}" for k in (0, 1, 2))} FROM t)
        SELECT {q("centre", 4)} AS centre, {q("scale", 4)} AS scale, {", ".join(f"{q(f'{c} / {_WHOLE_DET}', 4)} AS c{k}" for k, c in enumerate(_C))} FROM s WHERE n_x > 2""",
    "strategy_rank": f"WITH {EVAL}, m AS (SELECT search, avg(gold_similarity) AS s FROM results GROUP BY search) SELECT search, {q('s')} AS similarity, row_number() OVER (ORDER BY {q('s', 9)} DESC, search) AS rank FROM m",
    "rerank_gain": f"WITH {EVAL}, x AS (SELECT avg(gold_similarity) FILTER (WHERE search = 'hybrid') AS hq, avg(gold_similarity) FILTER (WHERE search = 'hybrid_rerank') AS rq, avg(retrieval_latency_ms) FILTER (WHERE search = 'hybrid') AS ht, avg(retrieval_latency_ms) FILTER (WHERE search = 'hybrid_rerank') AS rt FROM results) SELECT {q('CASE WHEN coalesce(hq, 0e0) > 0 THEN 100e0 * (coalesce(rq, 0e0) - hq) / hq ELSE 0e0 END', 4)} AS gain_pct, {q('coalesce(rt - ht, 0e0)', 4)} AS latency_ms FROM x",
    "overall_means": f"WITH {EVAL} SELECT count(*) AS n_results, {q('avg(gold_similarity)')} AS mean_similarity, {q('avg(fact_recall)')} AS mean_fact_recall FROM results",
    "results_json_roundtrip": f"WITH {EVAL} SELECT config_name, count(*) AS n, sum(context_tokens)::bigint AS context_tokens, sum(n_missing)::bigint AS n_missing FROM results GROUP BY config_name",
    "quick_sample": f"WITH {EVAL}, picked AS (SELECT question_id FROM questions ORDER BY md5('42:' || question_id) LIMIT 1), names(place, config_name) AS (VALUES {', '.join(f'({i}::bigint, {c.name!r})' for i, c in enumerate(sample_configs(8, 42)))}) SELECT place, config_name, question_id, {q('gold_similarity')} AS gold_similarity, {q('fact_recall')} AS fact_recall FROM results SEMI JOIN picked USING (question_id) JOIN names USING (config_name)",
    "hit_preview": f"WITH {WHOLE}, {hits(('hybrid',), (3,))} SELECT question_id, rank::bigint AS rank, source_file, md5(CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END) AS preview_md5 FROM hits JOIN chunks USING (strategy, source_file, chunk_index)",
    "summary_csv_roundtrip": f"WITH {SUMMARY} SELECT config_name, {q('avg_gold_similarity')} AS avg_gold_similarity, {q('avg_context_tokens')} AS avg_context_tokens FROM summary",
}
