"""SQL that checks the catalogue's queries on another engine, over the same tables and views."""

from __future__ import annotations

from siltwork.functions import expr
from siltwork.functions.chunking import ABBREVIATIONS
from siltwork.sources.views import with_views

JOBS_AT, SOURCES_AT = "TIMESTAMP '2024-01-20 00:00:00'", "TIMESTAMP '1998-01-01 00:00:00'"
SQL: dict[str, str] = {}


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


def _distance(a: str, b: str) -> str:
    return f"1 - {_dot(a, b)} / sqrt({_dot(a, a)} * {_dot(b, b)})"


def _lit(values) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(x) for x in row) + ")" for row in values)


# --- search ---
_ONE = """SELECT v.id AS chunk_id, v.source_id, s.url AS source_url, round({d}, 12) AS distance
FROM v_vectors v JOIN v_sources s ON s.id = v.source_id AND s.status = 'completed' {more}, (SELECT embedding AS q FROM v_vectors WHERE id = 0) x
ORDER BY {d}, v.id LIMIT 5"""
SQL["vector_search_topk"] = _ONE.format(d=_distance("v.embedding", "x.q"), more="")
SQL["vector_search_collection"] = _ONE.format(d=_distance("v.embedding", "x.q"), more="AND s.collection_id = (SELECT collection_id FROM v_sources WHERE id = 2)")
_MANY = """WITH q AS (SELECT id AS query_id, label AS query_label, {quantised_q} AS q FROM v_vectors WHERE id % 100 = 0),
v AS (SELECT id, label, {quantised_v} AS e FROM v_vectors),
p AS (SELECT query_id, query_label, id AS chunk_id, label, {d} AS distance FROM v, q {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM p)"""


def _many(quantised: bool, where: str) -> str:
    e = "list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)::FLOAT)" if quantised else "embedding"
    return _MANY.format(quantised_q=e, quantised_v=e, d=_distance("v.e", "q.q"), where=where)


SQL["vector_search_batch_topk"] = _many(False, "") + " SELECT query_id, chunk_id, round(distance, 9) AS distance, rank::INT AS rank FROM r WHERE rank <= 5"
SQL["vector_quantized_search"] = _many(True, "") + " SELECT query_id, chunk_id, round(distance, 9) AS distance, rank::INT AS rank FROM r WHERE rank <= 3"
SQL["retrieval_hit_mrr"] = _many(False, "WHERE id <> query_id") + """,
f AS (SELECT query_id, min(rank) AS first FROM r WHERE rank <= 5 AND label = query_label GROUP BY query_id)
SELECT count(*) AS n_queries, round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit_at_1, round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit_at_5,
       round(avg(coalesce(1::DOUBLE / first, 0)), 9) AS mrr FROM q LEFT JOIN f USING (query_id)"""
SQL["latency_percentiles"] = "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type"
_RUNS = r"""(SELECT DISTINCT {id}, array_to_string(w[i:i + 4], ' ') AS run FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
FROM (SELECT {id}, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM {table})))"""
SQL["passage_lookup"] = f"""WITH q AS {_RUNS.format(id='item_id', table='benchmark')}, g AS {_RUNS.format(id='doc_id', table='documents')},
n AS (SELECT item_id, count(*) AS n_runs FROM q GROUP BY item_id), h AS (SELECT item_id, doc_id, count(*) AS n FROM g JOIN q USING (run) GROUP BY item_id, doc_id)
SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM h JOIN n USING (item_id) WHERE n >= n_runs GROUP BY item_id"""

# --- listings and counts ---
SQL["collections_list_page"] = "SELECT * FROM v_collections WHERE user_id = 7 ORDER BY title DESC NULLS LAST, id LIMIT 5 OFFSET 5"
_OWNED = "FROM v_sources s JOIN v_collections c ON c.id = s.collection_id AND c.user_id = 7"
SQL["sources_list_page"] = f"SELECT s.* {_OWNED} WHERE s.status = 'failed' ORDER BY s.status, s.id LIMIT 20"
_META = f"""WITH t AS (SELECT count(*) AS n {_OWNED})
SELECT CASE WHEN n > {{skip}} THEN {{page}} ELSE 0 END::BIGINT AS current_page, CASE WHEN n > {{skip}} THEN 20 ELSE 0 END::BIGINT AS page_size,
CASE WHEN n > {{skip}} THEN 1 ELSE 0 END::BIGINT AS first_page, CASE WHEN n > {{skip}} THEN ceil(n / 20.0) ELSE 0 END::BIGINT AS last_page, CASE WHEN n > {{skip}} THEN n ELSE 0 END::BIGINT AS total_records FROM t"""
SQL["pagination_metadata"] = _META.format(skip=20, page=2)
SQL["page_past_end"] = _META.format(skip=19999980, page=1000000)
SQL["collection_by_owner"] = "SELECT id, user_id, title, max_sources FROM v_collections WHERE user_id = 7"
_KEYS = "list_has_all(regexp_split_to_array(lower({t}), '[^\\pL\\pN]+'), list_filter(regexp_split_to_array(lower({q}), '[^\\pL\\pN]+'), lambda x: x <> ''))"
SQL["title_keyword_search"] = f"SELECT p_partkey, p_name FROM part WHERE {_KEYS.format(t='p_name', q=chr(39) + 'Red, ring' + chr(39))}"
SQL["collections_keyword_search"] = f"SELECT id, title FROM v_collections WHERE {_KEYS.format(t='title', q=chr(39) + 'machinery CUSTOMER' + chr(39))}"
SQL["source_status_summary"] = f"""SELECT l.status, count(v.id) AS n FROM (VALUES {_lit((s,) for s in expr.SOURCE_STATUSES)}) l(status)
LEFT JOIN v_sources v ON v.status = l.status AND v.collection_id = 7 GROUP BY l.status"""
SQL["status_counts"] = "SELECT status, count(*) AS n FROM v_sources GROUP BY status"
SQL["step_counts"] = "SELECT current_step, count(*) AS n FROM v_sources GROUP BY current_step"
SQL["job_status_counts"] = "SELECT status, count(*) AS n FROM v_jobs GROUP BY status"
SQL["chunks_per_source"] = "SELECT source_id, count(*) AS n FROM v_chunks GROUP BY source_id"
_DUE = f"status IN ('pending', 'failed') AND (next_retry_at IS NULL OR next_retry_at <= {SOURCES_AT})"
SQL["claimable_sources"] = f"SELECT count(*) FILTER (WHERE {_DUE} AND (retry_count < 5 OR retry_count IS NULL)) AS claim, count(*) FILTER (WHERE {_DUE}) AS monitored FROM v_sources"
_JOB_DUE = f"status IN ('pending', 'failed') AND attempts < max_attempts AND run_after <= {JOBS_AT}"
SQL["claimable_jobs"] = f"SELECT count(*) AS n FROM v_jobs WHERE {_JOB_DUE}"
_STUCK = f"status = 'ingesting' AND updated_at < {SOURCES_AT} - INTERVAL 10 MINUTE"
_STUCK_JOB = f"status = 'processing' AND locked_at IS NOT NULL AND locked_at < {JOBS_AT} - INTERVAL 10 MINUTE"
SQL["stuck_sources"] = f"SELECT count(*) AS n FROM v_sources WHERE {_STUCK}"
SQL["stuck_jobs"] = f"SELECT count(*) AS n FROM v_jobs WHERE {_STUCK_JOB}"
SQL["oldest_claimable_age"] = f"SELECT coalesce(epoch({SOURCES_AT} - min(updated_at)), 0)::BIGINT AS age_seconds FROM v_sources WHERE {_DUE}"
SQL["embedding_coverage"] = "SELECT count(*) AS total, count(*) FILTER (WHERE embedded) AS embedded, count(*) FILTER (WHERE NOT embedded) AS missing FROM v_chunks"
SQL["recent_activity_top50"] = "SELECT id, url, status, updated_at FROM v_sources ORDER BY updated_at DESC NULLS LAST, id LIMIT 50"
SQL["capacity_check"] = "SELECT c.id, count(s.id) AS n_sources, c.max_sources, count(s.id) >= c.max_sources AS \"full\" FROM v_collections c LEFT JOIN v_sources s ON s.collection_id = c.id GROUP BY c.id, c.max_sources"
SQL["chunks_ordered_read"] = "SELECT source_id, chunk_index, token_count FROM v_chunks ORDER BY source_id, chunk_index"
SQL["request_metrics"] = "SELECT event_type, count(*) AS requests, sum(round(value * 1000)::BIGINT)::BIGINT AS total_us FROM events GROUP BY event_type"
_POLL = "SELECT collection_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in expr.SOURCE_STATUSES) + " FROM v_sources GROUP BY collection_id"
SQL["poll_status_counts"] = _POLL
SQL["run_verdicts"] = f"WITH p AS ({_POLL}) SELECT collection_id, CASE WHEN completed = total THEN 'success' WHEN completed > 0 AND completed + failed <= total THEN 'partial' ELSE 'failed' END AS verdict FROM p"
SQL["dominant_block_type"] = """WITH k AS (SELECT user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS r FROM events),
n AS (SELECT user_id, r, count(*) AS n FROM k GROUP BY ALL),
t AS (SELECT *, ['code', 'table', 'list', 'paragraph'][r + 1] AS name, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, r) AS turn FROM n)
SELECT user_id, max(name) FILTER (WHERE turn = 1) AS dominant, string_agg(name, ',' ORDER BY r) AS types FROM t GROUP BY user_id"""
SQL["token_lookup"] = f"""WITH t AS (SELECT sha256(c_name) AS hash, c_nationkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'activation' ELSE 'authentication' END AS scope,
TIMESTAMP '2024-01-01 00:00:00' + to_days((c_custkey % 40)::INT) AS expiry FROM customer)
SELECT u.id AS user_id, u.email, u.activated, t.hash FROM t JOIN v_users u ON u.id = t.user_id WHERE t.scope = 'authentication' AND t.expiry > {JOBS_AT}"""

# --- state changes ---
_S = "id, collection_id, url, {status} AS status, {step} AS current_step, {retry} AS retry_count, {due} AS next_retry_at, {at} AS updated_at, {version} AS version"


def _source(status="status", step="current_step", retry="retry_count", due="next_retry_at", at="updated_at", version="version") -> str:
    return _S.format(status=status, step=step, retry=retry, due=due, at=at, version=version)


_CLAIMED = _source("'ingesting'", "'fetch'", due="NULL::TIMESTAMP", at=SOURCES_AT, version="version + 1")
_CLAIM = "WITH c AS (SELECT * FROM v_sources WHERE {due} AND (retry_count < 5 OR retry_count IS NULL) {more} ORDER BY next_retry_at ASC NULLS FIRST, id LIMIT 20) SELECT {columns} FROM c"
SQL["claim_sources"] = _CLAIM.format(due=_DUE, more="", columns=_CLAIMED)
SQL["claim_sources_skip_locked"] = _CLAIM.format(due=_DUE, more="AND id % 2 <> 0", columns=_CLAIMED)
_J = "id, source_id, source_version, {status} AS status, {attempts} AS attempts, max_attempts, {after} AS run_after, {at} AS locked_at, {by} AS locked_by, {version} AS version"


def _job(status="status", attempts="attempts", after="run_after", at="NULL::TIMESTAMP", by="NULL::VARCHAR", version="version + 1") -> str:
    return _J.format(status=status, attempts=attempts, after=after, at=at, by=by, version=version)


_CLAIM_J = "WITH c AS (SELECT * FROM v_jobs WHERE {due} {more} ORDER BY run_after, id LIMIT {n}) SELECT {columns} FROM c"
SQL["claim_jobs"] = _CLAIM_J.format(due=_JOB_DUE, more="", n=5, columns=_job("'processing'", at=JOBS_AT, by="'embedding-worker-1'"))
SQL["claim_jobs_skip_locked"] = _CLAIM_J.format(due=_JOB_DUE, more="AND id % 7 <> 0", n=1, columns=_job("'processing'", at=JOBS_AT))
_REQ = "r AS (SELECT id AS rid, (id % 7 + 1 + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END)::INT AS expected FROM v_sources)"
SQL["advance_step"] = f"WITH {_REQ} SELECT {_source('CASE WHEN id % 4 = 0 THEN ' + chr(39) + 'completed' + chr(39) + ' ELSE status END', 'CASE WHEN id % 4 = 0 THEN current_step ELSE ' + chr(39) + 'embed' + chr(39) + ' END', version='version + 1')} FROM v_sources JOIN r ON rid = id AND expected = version WHERE status = 'ingesting'"
SQL["update_conflicts"] = f"WITH {_REQ} SELECT rid AS id, expected FROM r WHERE NOT EXISTS (SELECT 1 FROM v_sources s WHERE s.id = rid AND s.version = expected AND s.status = 'ingesting')"
_RETRY = "to_minutes(power(2, {n})::INT)"
_FAIL = f"WITH {_REQ} SELECT {{columns}}, 'boom ' || id AS step_error FROM v_sources JOIN r ON rid = id AND expected = version WHERE status = 'ingesting'"
SQL["fail_source"] = _FAIL.format(columns=_source("CASE WHEN retry_count + 1 >= 5 THEN 'stale' ELSE 'failed' END", "'chunk'", retry="retry_count + 1", due=f"{SOURCES_AT} + {_RETRY.format(n='retry_count')}", at=SOURCES_AT, version="version + CASE WHEN retry_count + 1 >= 5 THEN 2 ELSE 1 END"))
SQL["stale_source"] = _FAIL.format(columns=_source("'stale'", "'chunk'", retry="retry_count + 1", due="NULL::TIMESTAMP", at=SOURCES_AT, version="version + 1"))
SQL["reclaim_sources"] = "SELECT " + _source("CASE WHEN retry_count + 1 >= 5 THEN 'stale' ELSE 'failed' END", retry="retry_count + 1", due=f"CASE WHEN retry_count + 1 >= 5 THEN NULL ELSE {SOURCES_AT} END", at=SOURCES_AT, version="version + 1") + f", 'auto-recovered stuck ingesting at step=' || coalesce(current_step, 'unknown') AS step_error FROM v_sources WHERE {_STUCK}"
SQL["complete_job"] = "SELECT " + _job("'completed'") + " FROM v_jobs WHERE status = 'processing' AND (locked_by IS NULL OR locked_by = 'embedding-worker-2')"
SQL["fail_job"] = "SELECT " + _job("CASE WHEN attempts + 1 >= max_attempts THEN 'dead' ELSE 'failed' END", "attempts + 1", f"{JOBS_AT} + {_RETRY.format(n='attempts')}", version="version + CASE WHEN attempts + 1 >= max_attempts THEN 2 ELSE 1 END") + ", 'timeout' AS last_error FROM v_jobs WHERE status = 'processing' AND id % 11 <> 0 AND (locked_by IS NULL OR locked_by = 'embedding-worker-' || id % 2)"
SQL["embedding_job"] = """WITH k AS (SELECT doc_id % 400 + 1 AS s, count(*) AS n, coalesce(bool_or(length(text) > 30000), FALSE) AS bad FROM documents GROUP BY 1),
j AS (SELECT v.*, coalesce(n, 0) AS n_chunks, n IS NULL OR bad AS f, locked_by = 'embedding-worker-2' AS mine FROM v_jobs v LEFT JOIN k ON s = source_id WHERE status = 'processing' AND id % 3 > 0)
SELECT id, source_id, n_chunks, CASE WHEN NOT mine THEN 'processing' WHEN NOT f THEN 'completed' WHEN attempts + 1 >= max_attempts THEN 'dead' ELSE 'failed' END AS status,
(attempts + CASE WHEN mine AND f THEN 1 ELSE 0 END)::INT AS attempts, (version + CASE WHEN NOT mine THEN 0 WHEN f AND attempts + 1 >= max_attempts THEN 2 ELSE 1 END)::INT AS version,
CASE WHEN mine AND f THEN CASE WHEN n_chunks = 0 THEN 'no chunks found for source ' || source_id ELSE 'embedding chunks for source ' || source_id || ': a text is too long' END END AS last_error FROM j"""
SQL["embedding_job_chunks"] = """WITH c AS (SELECT doc_id % 400 + 1 AS source_id, coalesce(length(text), 0)::DOUBLE AS n FROM documents), j AS (SELECT DISTINCT source_id AS s FROM v_jobs WHERE status = 'processing')
SELECT source_id, count(s) AS n_vectors, sum(CASE WHEN s IS NOT NULL THEN n END) AS total FROM c LEFT JOIN j ON s = source_id GROUP BY source_id"""
SQL["set_embeddings"] = "SELECT doc_id AS id, len(embedding)::INT AS dimension, round(embedding[1]::DOUBLE, 6) AS first FROM documents LEFT JOIN v_vectors v ON v.id = doc_id"
_NEW_COLLECTIONS = """WITH n AS (SELECT c_custkey + 1000000 AS id, c_custkey, c_nationkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ' ' || c_name ELSE c_mktsegment END AS title FROM customer),
t AS (SELECT *, EXISTS (SELECT 1 FROM v_collections v WHERE v.user_id = n.user_id AND v.title = n.title) AS held, row_number() OVER (PARTITION BY user_id, title ORDER BY id) AS turn FROM n)"""
_STAMPS = f"{JOBS_AT} AS created_at, {JOBS_AT} AS updated_at"
SQL["insert_collections"] = _NEW_COLLECTIONS + f" SELECT id, user_id, title, (CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 20 END)::INT AS max_sources, '' AS description, 1 AS version, {_STAMPS} FROM t WHERE turn = 1 AND NOT held"
SQL["insert_collections_refused"] = _NEW_COLLECTIONS + " SELECT id, CASE WHEN held THEN 'present' ELSE 'batch' END AS reason FROM t WHERE turn > 1 OR held"
SQL["insert_sources"] = f"""WITH n AS (SELECT page_id AS id, page_id % 9 AS collection_id, CASE WHEN page_id % 5 = 0 THEN 'http://same.example/' ELSE url END AS url FROM pages),
t AS (SELECT *, row_number() OVER (PARTITION BY collection_id, url ORDER BY id) AS turn FROM n)
SELECT id, collection_id, url, '' AS title, 'pending' AS status, 0 AS retry_count, '{{}}' AS metadata, 1 AS version, {_STAMPS} FROM t WHERE turn = 1 AND (collection_id, url) NOT IN (SELECT (collection_id, url) FROM v_sources)"""
SQL["insert_users"] = f"""WITH n AS (SELECT s_suppkey + 100 AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'FRANCE@example.com' ELSE 'S' || s_suppkey // 2 || '@x.example' END AS email FROM supplier),
t AS (SELECT *, row_number() OVER (PARTITION BY lower(email) ORDER BY id) AS turn FROM n)
SELECT id, email, '' AS fullname, FALSE AS activated, 1 AS version, {_STAMPS} FROM t WHERE turn = 1 AND lower(email) NOT IN (SELECT lower(email) FROM v_users)"""
_USERS = """WITH u AS (SELECT *, (id % 3 + 1)::INT AS version FROM v_users),
r AS (SELECT id, coalesce(CASE id % 3 WHEN 0 THEN 'france@example.com' WHEN 1 THEN 'new' || id // 4 || '@example.com' END, email) AS email, fullname, version FROM u WHERE id % 5 <> 0),
t AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.email = r.email AND o.id <> r.id)), f AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY id) AS turn FROM t)"""
SQL["update_users"] = _USERS + " SELECT id, email, fullname, TRUE AS activated, (version + 1)::INT AS version FROM f WHERE turn = 1"
SQL["update_users_refused"] = _USERS + " SELECT id, CASE WHEN id % 5 = 0 THEN 'conflict' ELSE 'duplicate' END AS reason FROM u WHERE id NOT IN (SELECT id FROM f WHERE turn = 1)"
SQL["update_duplicate_titles"] = "WITH t AS (SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY id) AS turn FROM v_collections WHERE id % 2 = 0) SELECT id, 'duplicate' AS reason FROM t WHERE turn > 1"
SQL["cascade_delete_user"] = """WITH s AS (SELECT s.id FROM v_sources s JOIN v_collections c ON c.id = s.collection_id WHERE c.user_id NOT IN (7, 9))
SELECT 'users' AS relation, count(*) AS n FROM v_users WHERE id NOT IN (7, 9) UNION ALL SELECT 'tokens', count(*) FROM customer WHERE c_nationkey NOT IN (7, 9) UNION ALL SELECT 'collections', count(*) FROM v_collections WHERE user_id NOT IN (7, 9)
UNION ALL SELECT 'sources', count(*) FROM s UNION ALL SELECT 'chunks', count(*) FROM v_chunks WHERE source_id IN (SELECT id FROM s)"""
SQL["chunk_sink"] = "SELECT source_id, CASE WHEN source_id % 7 = 0 THEN 1 ELSE count(*) END::BIGINT AS n_chunks, CASE WHEN source_id % 7 = 0 THEN 1 ELSE sum(token_count) END::BIGINT AS tokens FROM v_chunks GROUP BY source_id"
SQL["metadata_read"] = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE coalesce(lang, '') END AS section_title, CASE WHEN doc_id % 5 = 0 THEN '' ELSE coalesce(source, '') END AS document_title, CASE WHEN doc_id % 5 > 0 THEN n_chars END AS n_chars FROM documents"
SQL["cite_rate"] = "SELECT count(*) AS n_answers, round(avg(CASE WHEN page_id % 3 > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS cite_rate FROM pages"
SQL["embedding_batch_statistics"] = "SELECT count(*) AS n_chunks FROM documents"
_PLACE = "coalesce(list_position(['fetch', 'clean', 'chunk', 'store', 'embed'], {x}.step), 0)"
_MAY = f"""coalesce(x.version = a.version AND (a.status IN ('pending', 'failed') AND x.status = 'ingesting' AND coalesce(x.step, '') = 'fetch'
OR a.status = 'ingesting' AND (x.status IN ('failed', 'stale') OR x.status = 'completed' AND a.step = 'embed' OR x.status = 'ingesting' AND {_PLACE.format(x='x')} BETWEEN {_PLACE.format(x='a')} AND {_PLACE.format(x='a')} + 1)), FALSE)"""
SQL["step_fold"] = f"""WITH e AS (SELECT user_id AS source_id, event_id, {{'status': CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'ingesting' END,
'step': CASE event_type WHEN 'signup' THEN 'fetch' WHEN 'view' THEN 'clean' WHEN 'click' THEN 'fetch' END, 'version': (1 + event_id % 6)::INT, 'refused': 0}} AS x FROM events),
l AS (SELECT source_id, list(x ORDER BY event_id) AS l FROM e GROUP BY source_id),
r AS (SELECT source_id, list_reduce(l, lambda a, x: {{'status': CASE WHEN {_MAY} THEN x.status ELSE a.status END, 'step': CASE WHEN {_MAY} THEN coalesce(x.step, a.step) ELSE a.step END,
'version': (a.version + CASE WHEN {_MAY} THEN 1 ELSE 0 END)::INT, 'refused': (a.refused + CASE WHEN {_MAY} THEN 0 ELSE 1 END)::INT}}, {{'status': 'pending', 'step': NULL::VARCHAR, 'version': 1, 'refused': 0}}) AS s FROM l)
SELECT source_id, s.status AS status, s.step AS current_step, s.version AS version, s.refused AS refused FROM r"""
SQL["reclaim_jobs"] = "SELECT " + _job("CASE WHEN attempts + 1 >= max_attempts THEN 'dead' ELSE 'failed' END", "attempts + 1", f"CASE WHEN attempts + 1 >= max_attempts THEN {JOBS_AT} ELSE {JOBS_AT} + {_RETRY.format(n='attempts')} END") + f" FROM v_jobs WHERE {_STUCK_JOB}"
_RANKED = """WITH g AS (SELECT source_id, chunk_index, l_partkey, l_suppkey, max(token_count) AS token_count FROM v_chunks GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY source_id, chunk_index ORDER BY l_partkey, l_suppkey) AS turn FROM g)"""
SQL["insert_dedupe"] = _RANKED + " SELECT source_id, chunk_index, l_partkey, l_suppkey, token_count FROM t WHERE turn = 1"
SQL["duplicate_rejects"] = _RANKED + """, h AS (SELECT *, chunk_index = 0 AND source_id IN (SELECT id FROM v_sources WHERE status = 'completed') AS held FROM t)
SELECT source_id, chunk_index, l_partkey, l_suppkey, token_count, CASE WHEN held THEN 'present' ELSE 'batch' END AS reason FROM h WHERE held OR turn > 1"""
SQL["enqueue_unique_active"] = """WITH a AS (SELECT source_id, source_version FROM v_jobs WHERE status IN ('pending', 'processing', 'failed') AND attempts = 0 AND run_after < TIMESTAMP '2024-01-03 00:00:00')
SELECT min(id) AS id, source_id, source_version FROM v_jobs WHERE run_after >= TIMESTAMP '2024-01-03 00:00:00' AND (source_id, source_version) NOT IN (SELECT (source_id, source_version) FROM a) GROUP BY source_id, source_version"""
SQL["replace_chunks"] = """WITH n AS (SELECT id FROM v_sources WHERE status = 'completed'),
k AS (SELECT source_id, token_count FROM v_chunks WHERE source_id NOT IN (SELECT id FROM n) UNION ALL SELECT id, 1 FROM n)
SELECT source_id, count(*) AS n_chunks, sum(token_count)::BIGINT AS tokens FROM k GROUP BY source_id"""
SQL["cascade_delete_collection"] = """WITH s AS (SELECT s.id FROM v_sources s JOIN v_collections c ON c.id = s.collection_id WHERE c.user_id <> 7)
SELECT (SELECT count(*) FROM s) AS n_sources, (SELECT count(*) FROM v_chunks WHERE source_id IN (SELECT id FROM s)) AS n_chunks"""
SQL["delete_source_owned"] = "SELECT count(*) AS n, count(*) FILTER (WHERE id = 11) AS n_11 FROM v_sources WHERE id <> 11"
SQL["partial_update_collection"] = """SELECT id, user_id, CASE WHEN id % 2 = 0 THEN 'renamed ' || id::VARCHAR ELSE title END AS title, 50 AS max_sources, 2 AS version
FROM v_collections WHERE title LIKE 'BUILDING%' AND id % 3 + 1 = 1"""

# --- validation: failed checks as "field: message" in order of field, the last check of a field first ---
_BLANK = "regexp_replace(coalesce({c}, ''), '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+', '', 'g') = ''"


def _checks(*fields: tuple[str, list[tuple[str, str]]]) -> str:
    cases = [f"CASE {' '.join(f'WHEN {bad} THEN {chr(39)}{name}: {text}{chr(39)}' for bad, text in reversed(checks))} END" for name, checks in sorted(fields)]
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), '; ')"


_URL_OK = "regexp_full_match({u}, '(?i:https?)://[^\\x00-\\x20\\x7f]*')"
_TITLE_LONG = ("must not be more than 200 bytes long",)
SQL["validate_collections"] = "WITH r AS (SELECT id, CASE WHEN id % 9 = 0 THEN '  ' WHEN id % 9 = 1 THEN repeat(title, 12) ELSE title END AS t, (max_sources * 11 - 20)::INT AS m FROM v_collections) SELECT id, " + _checks(
    ("title", [(_BLANK.format(c="t"), "must be provided"), ("strlen(t) > 200", "must not be more than 200 bytes long")]),
    ("max_sources", [("m < 1", "must be at least 1"), ("m > 100", "must not be more than 100")]),
) + " AS errors FROM r"
SQL["validate_sources"] = "WITH r AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'ftp://x.example/a' WHEN page_id % 7 = 1 THEN '' ELSE url END AS u, (page_id % 30)::INT AS n FROM pages) SELECT page_id AS id, " + _checks(
    ("collection_id", [("NOT page_id > 0", "must be a positive integer")]),
    ("url", [(_BLANK.format(c="u"), "must be provided"), (f"NOT {_URL_OK.format(u='u')}", "must be a valid URL")]),
    ("source_type", [("u = ''", "must be web, youtube or pdf")]),
    ("metadata", [("n > 20", "must not contain more than 20 keys")]),
) + " AS errors FROM r"
SQL["validate_chunks"] = "SELECT doc_id AS id, " + _checks(
    ("source_id", [("NOT doc_id > 0", "must be a positive integer")]),
    ("chunk_index", [("doc_id % 5 = 0", "must not be negative")]),
    ("content", [(_BLANK.format(c="text"), "must be provided"), ("strlen(text) > 50000", "must not be more than 50000 bytes long")]),
    ("token_count", [("n_chars // 4 < 1", "must be at least 1"), ("n_chars // 4 > 2000", "must not be more than 2000")]),
) + " AS errors FROM documents"
SQL["validate_search_inputs"] = "SELECT doc_id AS id, " + _checks(
    ("query", [(_BLANK.format(c="text"), "must be provided"), ("strlen(text) > 2000", "must not be more than 2000 bytes long")]),
    ("top_k", [("doc_id % 25 > 20", "must not be more than 20")]),
) + " AS errors FROM documents"
SQL["validate_filters"] = "SELECT id, " + _checks(
    ("page", [("id % 3 = 0", "must be greater than zero")]),
    ("page_size", [("id % 120 = 0", "must be greater than zero"), ("id % 120 > 100", "must be a maximum of 100")]),
    ("sort", [("id % 4 >= 2", "invalid sort value")]),
) + " AS errors FROM v_sources"
SQL["validate_jobs"] = "SELECT id, " + _checks(
    ("source_id", [("NOT source_id > 0", "must be a positive integer")]),
    ("attempts", [("attempts - 1 < 0", "must not be negative")]),
    ("max_attempts", [("max_attempts - id % 6 <= 0", "must be greater than zero")]),
) + " AS errors FROM v_jobs"
SQL["validate_emails"] = "WITH r AS (SELECT id, fullname, CASE id % 4 WHEN 0 THEN email WHEN 1 THEN replace(email, '@', '.') WHEN 2 THEN '' ELSE replace(email, ' ', '-') END AS e FROM v_users) SELECT id, " + _checks(
    ("email", [("e = ''", "must be provided"), ("NOT regexp_full_match(e, '[^@ ]+@[^@ ]+')", "must be a valid email address")]),
    ("password", [("strlen(fullname) < 8", "must be at least 8 bytes long")]),
) + " AS errors FROM r"
_TEST_URLS = "(SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {urls}) u(url))"


def _with_urls(sql: str) -> str:
    from siltwork.plans.catalogue import URLS

    return sql.format(rows=_TEST_URLS.format(urls=_lit((u,) for u in URLS)))


# --- retries and failures ---
_CODES = "(SELECT unnest(range(400, 600))::INT AS status)"
SQL["failure_classification"] = f"""SELECT kind, status, CASE WHEN kind IN ('bad_url', 'empty_content', 'wrong_content_type', 'no_content', 'no_chunks') THEN TRUE WHEN kind = 'cancelled' THEN FALSE
WHEN status IN (408, 409, 425, 429) THEN FALSE ELSE status < 500 END AS permanent
FROM (VALUES ('bad_url'), ('empty_content'), ('wrong_content_type'), ('no_content'), ('no_chunks'), ('cancelled'), ('http'), ('unknown')) k(kind), {_CODES}"""
SQL["fetch_check"] = """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 404 WHEN page_id % 5 = 0 THEN 415
WHEN page_id % 11 <> 0 AND page_id % 13 = 0 THEN 413 WHEN page_id % 11 = 0 THEN 204 WHEN page_id % 7 = 0 THEN 502 WHEN page_id % 7 = 1 THEN 422 ELSE 0 END AS error FROM pages"""
SQL["fetch_retry"] = "SELECT status::BIGINT AS status, status IN (408, 425, 429, 500, 502, 503, 504) AS retry FROM (SELECT unnest(range(400, 600)) AS status)"
SQL["retry_after"] = "SELECT * FROM (VALUES (0, 120::BIGINT), (1, 7), (2, 0), (3, 0), (4, 3), (5, 0), (6, 0), (7, 60), (8, 0), (9, 0)) t(id, seconds)"
SQL["backoff_schedule"] = """SELECT a AS attempt, least(500 * power(2, least(a - 1, 16)), 5000)::DOUBLE AS fetch_ms, least(500 * power(2, least(a - 1, 16)), 10000)::DOUBLE AS embed_ms,
(CASE WHEN a % 5 = 0 THEN 2 ELSE least(2 * a, 30) END)::BIGINT AS poll_s FROM (SELECT unnest(range(1, 25)) AS a)"""

# --- text ---
_SPACE = r"[\s\x0b\x{85}\x{a0}]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g')"


SQL["plain_text_blocks"] = f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES (-1, E'The first paragraph goes on\\nover two lines.\\n\\nThe second one is long enough, too.'),
(-2, E'The first paragraph has one line only.\\nThe second one is long enough, too.\\n\\n'), (-3, E'\\n\\n short \\n\\n'), (-4, NULL)) v(doc_id, text)),
t AS (SELECT doc_id, {_strip('text')} AS text FROM d),
s AS (SELECT doc_id, string_split(text, CASE WHEN contains(text, chr(10) || chr(10)) THEN chr(10) || chr(10) ELSE chr(10) END) AS parts FROM t),
p AS (SELECT doc_id, unnest(range(len(parts)))::INT AS pos, parts FROM s),
c AS (SELECT doc_id, pos, trim(regexp_replace(parts[pos + 1], '{_SPACE}', ' ', 'g')) AS text FROM p)
SELECT * FROM c WHERE strlen(text) >= 30"""
_ABBR = "|".join(sorted((a.replace(".", "\\.") for a in ABBREVIATIONS), key=lambda a: (-len(a), a)))
SQL["sentences"] = rf"""WITH a AS (SELECT doc_id, regexp_replace(text, '(?i)((?:^|\s)["''(\[]*(?:{_ABBR})[.!?,;:]*[.!?])(\s)', '\1' || chr(2) || '\2', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '([0-9]\.)(\s)', '\1' || chr(2) || '\2', 'g') AS t FROM a),
c AS (SELECT doc_id, replace(regexp_replace(t, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(2), '') AS t FROM b),
d AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS l FROM c)
SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS sentence FROM d"""
#: Blocks of plain text, their sentences, units of at most 400 words, and a fold that packs them with one unit of overlap.
_BLOCKS = SQL["plain_text_blocks"].replace("(-1, E'", "(-1, E'").split("WITH d AS", 1)[1].rpartition("\n")[0]
_CHUNKS = rf"""WITH d AS{_BLOCKS},
b AS (SELECT doc_id, pos, text FROM c WHERE strlen(text) >= 30 AND doc_id >= 0),
a AS (SELECT doc_id, pos, regexp_replace(text, '(?i)((?:^|\s)["''(\[]*(?:{_ABBR})[.!?,;:]*[.!?])(\s)', '\1' || chr(2) || '\2', 'g') AS t FROM b),
n AS (SELECT doc_id, pos, regexp_replace(t, '([0-9]\.)(\s)', '\1' || chr(2) || '\2', 'g') AS t FROM a),
m AS (SELECT doc_id, pos, string_split(replace(regexp_replace(t, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(2), ''), chr(1)) AS l FROM n),
x AS (SELECT doc_id, pos, unnest(range(len(l))) AS k, string_split(trim(unnest(l)), ' ') AS w FROM m),
y AS (SELECT doc_id, pos, k, w, unnest(range((len(w) + 399) // 400)) AS part FROM x WHERE w <> ['']),
u AS (SELECT doc_id, w[part * 400 + 1 : part * 400 + 400] AS w, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k, part) - 1 AS i FROM y),
v AS (SELECT doc_id, i, array_to_string(w, ' ') AS text, len(w) AS t, coalesce(lag(len(w)) OVER (PARTITION BY doc_id ORDER BY i), 0) AS p FROM u),
l AS (SELECT doc_id, list(text ORDER BY i) AS texts, count(*) AS units, list({{'done': []::STRUCT(a BIGINT, b BIGINT)[], 'a': 0::BIGINT, 's': 0::BIGINT, 'i': i::BIGINT, 't': t::BIGINT, 'p': p::BIGINT}} ORDER BY i) AS steps FROM v GROUP BY doc_id),
f AS (SELECT doc_id, texts, units, list_reduce(steps, lambda o, x: {{
 'done': o.done || CASE WHEN {{full}} THEN [{{{{'a': o.a, 'b': x.i - 1}}}}] ELSE [] END || CASE WHEN {{sum}} > 400 THEN [{{{{'a': {{first}}, 'b': x.i}}}}] ELSE [] END,
 'a': CASE WHEN {{sum}} > 400 THEN x.i + 1 ELSE {{first}} END, 's': CASE WHEN {{sum}} > 400 THEN 0 ELSE {{sum}} END, 'i': x.i, 't': x.t, 'p': x.p}},
 {{'done': []::STRUCT(a BIGINT, b BIGINT)[], 'a': 0::BIGINT, 's': 0::BIGINT, 'i': 0::BIGINT, 't': 0::BIGINT, 'p': 0::BIGINT}}) AS s FROM l),
g AS (SELECT doc_id, texts, s.done || CASE WHEN s.a < units THEN [{{'a': s.a, 'b': units - 1}}] ELSE [] END AS done FROM f),
h AS (SELECT doc_id, texts, len(done) AS total, unnest(range(len(done))) AS chunk_index, unnest(done) AS r FROM g),
o AS (SELECT doc_id, chunk_index, total, array_to_string(texts[r.a + 1 : r.b + 1], ' ') AS content FROM h)
SELECT doc_id, chunk_index::INT AS chunk_index, content, '' AS section_title, '' AS section_path, len(string_split(content, ' '))::INT AS token_count, content AS embed_text,
'{{"block_type": "paragraph", "block_types": ["paragraph"], "chunk_content_length": ' || strlen(content) || ', "chunk_index": ' || chunk_index || ', "chunk_token_count": ' || len(string_split(content, ' ')) ||
', "document_title": "", "embed_text_tokens": ' || len(string_split(content, ' ')) || ', "heading_level": 0, "section_path": "", "section_title": "", "total_chunks": ' || total || ', "url": ""}}' AS metadata FROM o"""
_FULL = "(o.a < x.i AND o.s + x.t > 400)"
_HELD = f"(CASE WHEN {_FULL} THEN x.p ELSE o.s END + x.t)"
SQL["chunk_documents"] = _CHUNKS.replace("{full}", _FULL).replace("{sum}", _HELD).replace("{first}", f"(CASE WHEN {_FULL} THEN x.i - 1 ELSE o.a END)").replace("{{", "{").replace("}}", "}")
_GUIDE = "A first paragraph that goes over two lines of text."
SQL["markdown_blocks"] = "SELECT doc_id, block_index, section_title, section_path, heading_level, type, text FROM (VALUES " + _lit([
    (0, 0, "Guide", "Guide", 1, "paragraph", _GUIDE), (0, 1, "Guide", "Guide", 1, "paragraph", "Still in the guide, as an image names no section at all."),
    (0, 2, "Deep link", "Guide > Deep link", 3, "list", "Install all of the tools; Configure them; Run"),
    (1, 0, "", "", 0, "code", 'language: go\nfmt.Println("hello")'),
    (2, 0, "", "", 0, "table", "name: alpha, value: [one](http://u). name: beta beta, value: two and more"), (2, 1, "", "", 0, "paragraph", "The text after the table is a paragraph."),
    (3, 0, "", "", 0, "table", "a row, without any header. another row, of the same table"),
    (4, 0, "", "", 0, "paragraph", "| one line alone is a paragraph | as it has no second |"),
    (5, 0, "", "", 0, "paragraph", "A paragraph after a rule, long enough to be kept. 1. tabbed items are no items, so they are paragraphs"),
    (6, 0, "Two", "Two", 2, "paragraph", "Text of the second level, without a first one above it."), (6, 1, "One", "One", 1, "paragraph", "Text of the first level, which comes after the second."),
    (6, 2, "Three", "One > Three", 3, "paragraph", "Text of the third level, with a gap above it in the path."),
    (7, 0, "", "", 0, "code", "code comes before the table above it"), (7, 1, "", "", 0, "table", "a: the first cell, b: the second cell"),
]) + ") t(doc_id, block_index, section_title, section_path, heading_level, type, text)"
SQL["html_literal_blocks"] = "SELECT page_id, block_index, 'markdown' AS clean_method, section_title, section_path, heading_level, type, text FROM (VALUES " + _lit([
    (0, 0, "Introduction", "Introduction", 1, "paragraph", "This is a sufficiently long paragraph to verify the first way of extraction."),
    (1, 0, "Install", "Guide > Install", 2, "list", "Install all of the dependencies; Configure the environment"), (1, 1, "Run", "Guide > Install > Run", 3, "code", 'language: go\nfmt.Println("hello, this is code")'),
    (2, 0, "", "", 0, "paragraph", "Text after scripts & menus, which is long enough to stay here."),
    (3, 0, "", "", 0, "table", "name: alpha beta, value: gamma delta epsilon"),
]) + ") t(page_id, block_index, section_title, section_path, heading_level, type, text)"
for _name in ("markdown_blocks", "html_literal_blocks"):
    SQL[_name] = SQL[_name].replace("SELECT doc_id,", "SELECT doc_id::BIGINT AS doc_id,").replace("SELECT page_id,", "SELECT page_id::BIGINT AS page_id,")
SQL["token_counts_words"] = r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS n_tokens FROM documents"
def _lines(columns: str) -> str:
    from siltwork.plans.catalogue import LINES

    return f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), w AS (SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS line FROM s
UNION ALL SELECT -1, * FROM (VALUES {_lit(enumerate(LINES))}) v(pos, line)) SELECT doc_id, pos, {columns} FROM w"""


def _text_rules() -> dict[str, str]:
    from siltwork.plans.catalogue import LISTS

    item = r"CASE WHEN regexp_matches(line, '^[-*+] ') THEN substr(line, 3) WHEN regexp_matches(line, '^\d+\.\s+') AND strpos(line, '. ') BETWEEN 1 AND length(line) - 2 THEN substr(line, strpos(line, '. ') + 2) END"
    separator = r"'^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$'"
    links = r"regexp_replace(regexp_replace(line, '!\[[^\]]*\]\([^)]+\)', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"
    steps = "list_transform(string_split(replace(text, ';', chr(10)), chr(10)), lambda x: " + _strip("x") + ")"
    for mark in ("- ", "* ", "+ "):
        steps = f"list_transform({steps}, lambda x: CASE WHEN starts_with(x, '{mark}') THEN {_strip('substr(x, 3)')} ELSE x END)"
    numbered = r"regexp_replace(x, '^\d+\. ', '')"
    steps = f"list_filter(list_transform({steps}, lambda x: {_strip(numbered)}), lambda x: x <> '')"
    labels = "SELECT doc_id, trim(coalesce(CASE WHEN doc_id % 3 > 0 THEN source || ' ' END, '')) AS t, trim(coalesce(CASE WHEN doc_id % 2 = 0 THEN lang ELSE ' ' END, '')) AS p FROM documents"
    return {
        "table_lines": _lines(f"regexp_matches(line, {separator}) OR (line LIKE '|%|' AND length(line) > 1 AND contains(trim(line, '|'), '|')) AS is_table"),
        "list_item_lines": _lines(f"trim(regexp_replace({links.replace('line', item)}, '{_SPACE}', ' ', 'g')) AS item"),
        "normalize_markdown": _lines(f"trim(regexp_replace({links}, '{_SPACE}', ' ', 'g')) AS text"),
        "list_split": f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_lit((-1 - k, x) for k, x in enumerate(LISTS))}) v(doc_id, text)),
l AS (SELECT doc_id, {steps} AS l, {_strip('text')} AS whole FROM d), m AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN l ELSE [whole] END AS l FROM l)
SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS item FROM m""",
        "context_prefix": """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source END AS d, CASE WHEN doc_id % 2 = 0 THEN lang ELSE ' ' END AS s FROM documents
UNION ALL SELECT * FROM (VALUES (-1, 'Guide', 'A > B'), (-2, 'Guide', ' '), (-3, '', 'A'), (-4, NULL, NULL)) v(doc_id, d, s)), t AS (SELECT doc_id, trim(coalesce(d, '')) AS d, trim(coalesce(s, '')) AS s FROM r)
SELECT doc_id, CASE WHEN d <> '' THEN 'Document: ' || d || chr(10) ELSE '' END || CASE WHEN s <> '' THEN 'Section: ' || s || chr(10) ELSE '' END || CASE WHEN d = '' AND s = '' THEN '' ELSE chr(10) END AS prefix FROM t""",
        "section_labels": f"WITH x AS ({labels}) SELECT doc_id, CASE WHEN t <> '' THEN t ELSE p END AS title, CASE WHEN p <> '' THEN p ELSE t END AS path FROM x",
    }


SQL["flatten_messages"] = "SELECT conv_id, string_agg(CASE WHEN trim(coalesce(role, '')) = '' THEN 'USER' ELSE upper(trim(role)) END || ':' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text) AS prompt FROM conversations GROUP BY conv_id"
SQL["prompt_build"] = """WITH p AS (SELECT conv_id, turn, '[' || (turn + 1) || ']' || chr(10) || 'Title: ' || CASE WHEN turn % 2 = 0 AND role <> '' THEN role WHEN turn % 3 = 0 THEN 'doc' ELSE '(untitled)' END || chr(10) || 'URL: https://example.com' || chr(10) ||
'Section: (none)' || chr(10) || 'ChunkIndex: ' || turn || chr(10) || 'Distance: ' || printf('%.4f', turn / 8.0::DOUBLE) || chr(10) || 'Content:' || chr(10) || text || chr(10) || chr(10) AS p FROM conversations)
SELECT conv_id, 'Question:' || chr(10) || 'What is this about?' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg(p, '' ORDER BY turn, p) AS prompt FROM p GROUP BY conv_id"""

# --- streams ---
SQL["stream_arrivals"] = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type, date_trunc('day', ts)"
_FOLD = """WITH f AS (SELECT source_id, count(*) AS n, list_reduce(list(version ORDER BY id), lambda a, x: CASE WHEN x = a THEN a + 1 ELSE a END, 1) AS v FROM v_jobs GROUP BY source_id)"""
SQL["version_fold"] = _FOLD + " SELECT source_id, (v - 1)::BIGINT AS applied, (n - v + 1)::BIGINT AS stale, v::INT AS version FROM f"
SQL["stream_claim_fold"] = _FOLD + " SELECT source_id, (v - 1)::BIGINT AS applied, v::INT AS version FROM f"
_FILLED = "CASE WHEN a.last IS NULL OR x.last - a.last > 180 THEN 4.0::DOUBLE ELSE least(4.0::DOUBLE, a.tokens + (x.last - a.last) * 2) END"
SQL["rate_limit_fold"] = f"""WITH l AS (SELECT user_id AS key, count(*) AS n, list({{'tokens': 0::DOUBLE, 'last': event_id * 0.25::DOUBLE, 'allowed': 0::BIGINT}} ORDER BY event_id) AS l FROM events GROUP BY user_id),
r AS (SELECT key, n, list_reduce(l, lambda a, x: {{'tokens': {_FILLED} - CASE WHEN {_FILLED} >= 1 THEN 1 ELSE 0 END, 'last': x.last, 'allowed': a.allowed + CASE WHEN {_FILLED} >= 1 THEN 1 ELSE 0 END}},
{{'tokens': 4::DOUBLE, 'last': NULL::DOUBLE, 'allowed': 0::BIGINT}}) AS s FROM l)
SELECT key, s.allowed AS allowed, n - s.allowed AS refused FROM r"""
SQL["reclaim_round"] = f"WITH s AS (SELECT CASE WHEN {_STUCK_JOB} THEN CASE WHEN attempts + 1 >= max_attempts THEN 'dead' ELSE 'failed' END ELSE status END AS status FROM v_jobs) SELECT status, count(*) AS n FROM s GROUP BY status"


SQL["stream_reclaim"] = SQL["reclaim_round"]
SQL["stream_queue"] = f"""WITH s AS (SELECT *, coalesce({_STUCK_JOB}, FALSE) AS stuck, {_JOB_DUE} AS due FROM v_jobs), e AS (SELECT CASE WHEN stuck OR due AND id % 3 = 0 THEN CASE WHEN attempts + 1 >= max_attempts THEN 'dead' ELSE 'failed' END WHEN due THEN 'completed' ELSE status END AS status,
(attempts + CASE WHEN stuck OR due AND id % 3 = 0 THEN 1 ELSE 0 END)::INT AS attempts FROM s) SELECT status, attempts, count(*) AS n FROM e GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    out = {name: with_views(sql) for name, sql in (SQL | _text_rules()).items()}
    out["valid_url"] = _with_urls("SELECT url, " + _URL_OK.format(u="url") + " AS valid FROM {rows}")
    bare = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '')"
    out["detect_source_type"] = _with_urls(
        r"SELECT url, CASE WHEN trim(url) = '' THEN '' WHEN regexp_matches(url, '^(https?://)?(www\.)?(youtube\.com/(watch\?v=|embed/)|youtu\.be/)[\w-]+') THEN 'youtube' "
        f"WHEN regexp_full_match({bare}, '/.*|[^:/]*(/.*)?') AND NOT regexp_matches({bare}, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') AND replace(lower({bare}), '%70', 'p') LIKE '%.pdf' THEN 'pdf' ELSE 'web' END AS source_type FROM {{rows}}"
    )
    return out
