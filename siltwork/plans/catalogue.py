"""Named queries over the driver's tables; ``oracles.py`` has the SQL that checks them."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import chunking, expr
from siltwork.functions.embedding import EmbedError
from siltwork.functions.tokens import words
from siltwork.operators import ann, documents, mutations, relational, search, validation
from siltwork.operators.jobs import embed_claimed
from siltwork.sources import fetch
from siltwork.sources.views import load
from siltwork.streaming import queues

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

JOBS_AT = "TIMESTAMP_NTZ '2024-01-20 00:00:00'"
SOURCES_AT = "TIMESTAMP_NTZ '1998-01-01 00:00:00'"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return root.rstrip("/")


def jobs_at():
    return F.expr(JOBS_AT)


def sources_at():
    return F.expr(SOURCES_AT)


def vector(spark: SparkSession, d: str, key: int = 0) -> list[float]:
    return list(load(spark, d, "v_vectors").where(F.col("id") == key).first()["embedding"])


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    rows = load(spark, d, "v_vectors").where("id % 100 = 0")
    return rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))


# --- search ---


@query
def vector_search_topk(spark, d):
    hits = search.search(load(spark, d, "v_vectors"), load(spark, d, "v_sources"), vector(spark, d), 5)
    return hits.withColumn("distance", F.round("distance", 12))


@query
def vector_search_collection(spark, d):
    sources = load(spark, d, "v_sources")
    own = sources.where("id = 2").first()
    return search.search(load(spark, d, "v_vectors"), sources, vector(spark, d), 5, own["collection_id"] if own else -1).withColumn("distance", F.round("distance", 12))


@query
def vector_search_batch_topk(spark, d):
    found = search.search_many(load(spark, d, "v_vectors"), asked(spark, d), 5)
    return found.select("query_id", "chunk_id", F.round("distance", 9).alias("distance"), "rank")


@query
def vector_quantized_search(spark, d):
    vectors = load(spark, d, "v_vectors").withColumn("embedding", expr.quantise(F.col("embedding")))
    queries = asked(spark, d).withColumn("query", expr.quantise(F.col("query")))
    found = search.search_many(vectors, queries, 3)
    return found.select("query_id", "chunk_id", F.round("distance", 9).alias("distance"), "rank")


@query
def retrieval_hit_mrr(spark, d):
    queries = asked(spark, d)
    ranked = search.search_many(load(spark, d, "v_vectors"), queries, 5, other_than_self=True)
    return search.retrieval_quality(ranked, queries, F.col("label") == F.col("query_label")).select("n_queries", *[F.round(c, 9).alias(c) for c in ("hit_at_1", "hit_at_5", "mrr")])


@query
def ann_ivf_recall(spark, d):
    vectors = load(spark, d, "v_vectors").select("id", "embedding")
    queries = asked(spark, d).select("query_id", "query")
    c = ann.centres(vectors, 16)
    found = ann.search(ann.assign(vectors, c), queries, c, 10, probes=12)
    return ann.recall(found, search.search_many(vectors, queries, 10))


@query
def latency_percentiles(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.95), 6).alias("p95"), F.count(F.lit(1)).alias("n"))


@query
def passage_lookup(spark, d):
    """Documents that hold every five-word run of a benchmark passage, found by an equality join of runs.

    Runs are counted by passage and document in each task before the shuffle; no passage meets all documents.
    """
    tokens = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    runs = F.expr("array_distinct(transform(sequence(0, greatest(size(w) - 5, 0)), i -> concat_ws(' ', slice(w, i + 1, 5))))")
    wanted = load(spark, d, "benchmark").withColumn("w", tokens).select("item_id", runs.alias("r")).select("item_id", F.size("r").alias("n_runs"), F.explode("r").alias("run"))
    have = load(spark, d, "documents").withColumn("w", tokens).select("doc_id", F.explode(runs).alias("run"))
    hits = have.join(wanted, "run").groupBy("item_id", "n_runs", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= n_runs")
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


# --- listings and counts ---


@query
def collections_list_page(spark, d):
    rows = relational.collections_of(load(spark, d, "v_collections"), user_id=7)
    return relational.page(rows, 2, 5, "-title", relational.COLLECTION_SORTS)


@query
def sources_list_page(spark, d):
    rows = relational.sources_of(load(spark, d, "v_sources"), load(spark, d, "v_collections"), user_id=7, status="failed")
    return relational.page(rows, 1, 20, "status", relational.SOURCE_SORTS)


@query
def pagination_metadata(spark, d):
    return relational.page_metadata(relational.sources_of(load(spark, d, "v_sources"), load(spark, d, "v_collections"), user_id=7), 2, 20)


@query
def page_past_end(spark, d):
    return relational.page_metadata(relational.sources_of(load(spark, d, "v_sources"), load(spark, d, "v_collections"), user_id=7), 1_000_000, 20)


@query
def collection_by_owner(spark, d):
    return load(spark, d, "v_collections").where("user_id = 7").select("id", "user_id", "title", "max_sources")


@query
def title_keyword_search(spark, d):
    return load(spark, d, "part").where(expr.matches_keywords(F.col("p_name"), F.lit("Red, ring"))).select("p_partkey", "p_name")


@query
def collections_keyword_search(spark, d):
    return relational.collections_of(load(spark, d, "v_collections"), keywords="machinery CUSTOMER").select("id", "title")


@query
def source_status_summary(spark, d):
    return relational.status_summary(load(spark, d, "v_sources"), 7)


@query
def status_counts(spark, d):
    return relational.counts_by(load(spark, d, "v_sources"), "status")


@query
def step_counts(spark, d):
    return relational.counts_by(load(spark, d, "v_sources"), "current_step")


@query
def job_status_counts(spark, d):
    return relational.counts_by(load(spark, d, "v_jobs"), "status")


@query
def chunks_per_source(spark, d):
    return relational.counts_by(load(spark, d, "v_chunks"), "source_id")


@query
def claimable_sources(spark, d):
    rows, at = load(spark, d, "v_sources"), sources_at()
    return rows.agg(F.count_if(relational.claimable_source(at)).alias("claim"), F.count_if(relational.claimable_source(at, retry_cap=False)).alias("monitored"))


@query
def claimable_jobs(spark, d):
    return relational.count_where(load(spark, d, "v_jobs"), relational.claimable_job(jobs_at()))


@query
def stuck_sources(spark, d):
    return relational.count_where(load(spark, d, "v_sources"), relational.stuck_source(sources_at()))


@query
def stuck_jobs(spark, d):
    return relational.count_where(load(spark, d, "v_jobs"), relational.stuck_job(jobs_at()))


@query
def oldest_claimable_age(spark, d):
    return relational.oldest_claimable_age(load(spark, d, "v_sources"), sources_at(), "updated_at")


@query
def embedding_coverage(spark, d):
    return relational.embedding_coverage(load(spark, d, "v_chunks"))


@query
def recent_activity_top50(spark, d):
    return relational.recent(load(spark, d, "v_sources")).select("id", "url", "status", "updated_at")


@query
def capacity_check(spark, d):
    return relational.capacity(load(spark, d, "v_collections"), load(spark, d, "v_sources"))


@query
def chunks_ordered_read(spark, d):
    return load(spark, d, "v_chunks").select("source_id", "chunk_index", "token_count").orderBy("source_id", "chunk_index")


@query
def request_metrics(spark, d):
    return relational.request_metrics(load(spark, d, "events"), "event_type", F.round(F.col("value") * 1000).cast("long"))


@query
def poll_status_counts(spark, d):
    counts = [F.count_if(F.col("status") == s).alias(s) for s in expr.SOURCE_STATUSES]
    return load(spark, d, "v_sources").groupBy("collection_id").agg(F.count(F.lit(1)).alias("total"), *counts)


@query
def run_verdicts(spark, d):
    done, failed, total = F.col("completed"), F.col("failed"), F.col("total")
    return poll_status_counts(spark, d).select("collection_id", relational.run_verdict(done, failed, total).alias("verdict"))


@query
def dominant_block_type(spark, d):
    kinds = F.expr("CASE event_type WHEN 'click' THEN 'code' WHEN 'view' THEN 'table' WHEN 'purchase' THEN 'list' ELSE 'paragraph' END")
    counts = load(spark, d, "events").select("user_id", kinds.alias("type")).groupBy("user_id", "type").agg(F.count(F.lit(1)).alias("n"))
    return relational.dominant_type(counts, "user_id", {t: k for k, t in enumerate(chunking.TYPE_ORDER)})


@query
def token_lookup(spark, d):
    customers = load(spark, d, "customer")
    tokens = customers.select(
        F.sha2(F.col("c_name"), 256).alias("hash"), F.col("c_nationkey").alias("user_id"),
        F.when(F.col("c_custkey") % 3 == 0, "activation").otherwise("authentication").alias("scope"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 40 as int), 0, 0, 0)").alias("expiry"),
    )
    return relational.token_owners(tokens, load(spark, d, "v_users"), jobs_at(), "authentication")


# --- state changes ---


@query
def claim_sources(spark, d):
    return mutations.claim_sources(load(spark, d, "v_sources"), sources_at(), 20)


@query
def claim_sources_skip_locked(spark, d):
    rows = load(spark, d, "v_sources")
    return mutations.claim_sources(rows, sources_at(), 20, locked=rows.where("id % 2 = 0"))


@query
def claim_jobs(spark, d):
    return mutations.claim_jobs(load(spark, d, "v_jobs"), jobs_at(), 5, "embedding-worker-1")


@query
def claim_jobs_skip_locked(spark, d):
    rows = load(spark, d, "v_jobs")
    return mutations.claim_jobs(rows, jobs_at(), 0, "", locked=rows.where("id % 7 = 0"))


def step_requests(spark, d):
    rows = load(spark, d, "v_sources")
    return rows.select("id", F.expr("CAST(id % 7 + 1 + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS INT)").alias("expected"), F.expr("CASE WHEN id % 4 = 0 THEN 'completed' ELSE 'ingesting' END").alias("status"), F.expr("CASE WHEN id % 4 = 0 THEN NULL ELSE 'embed' END").alias("step"))


@query
def advance_step(spark, d):
    return mutations.advance_step(load(spark, d, "v_sources"), step_requests(spark, d))


@query
def update_conflicts(spark, d):
    return mutations.conflicts(load(spark, d, "v_sources"), step_requests(spark, d), "ingesting").select("id", "expected")


def failures(spark, d):
    """Requests of workers for all sources, each eleventh of them with a version that has moved on."""
    return step_requests(spark, d).select("id", "expected", F.lit("chunk").alias("step"), F.concat(F.lit("boom "), F.col("id").cast("string")).alias("error"))


@query
def fail_source(spark, d):
    return mutations.fail_sources(load(spark, d, "v_sources"), failures(spark, d), sources_at())


@query
def stale_source(spark, d):
    return mutations.stale_sources(load(spark, d, "v_sources"), failures(spark, d), sources_at())


@query
def reclaim_sources(spark, d):
    return mutations.reclaim_sources(load(spark, d, "v_sources"), sources_at())


@query
def complete_job(spark, d):
    jobs = load(spark, d, "v_jobs")
    requests = jobs.select("id", F.expr("CAST(id % 7 + 1 AS INT)").alias("expected"), F.lit("embedding-worker-2").alias("worker"))
    return mutations.complete_jobs(jobs, requests)


@query
def fail_job(spark, d):
    jobs = load(spark, d, "v_jobs")
    expected = F.expr("CAST(id % 7 + 1 + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS INT)")
    requests = jobs.select("id", expected.alias("expected"), F.expr("'embedding-worker-' || CAST(id % 2 AS STRING)").alias("worker"), F.lit("timeout").alias("error"))
    return mutations.fail_jobs(jobs, requests, jobs_at())


@query
def embedding_job(spark, d):
    """Jobs in process of worker 2: chunks are documents, a text of over 30,000 characters makes the model refuse."""
    jobs, sources = load(spark, d, "v_jobs"), load(spark, d, "v_sources")
    docs = load(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("id"), F.expr("doc_id % 400 + 1").alias("source_id"), F.col("text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
    claimed = jobs.where("status = 'processing' AND id % 3 > 0")

    def model():
        def embed(texts, task):
            if any(len(t) > 30_000 for t in texts):
                raise EmbedError(400, "a text is too long")
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    out = embed_claimed(claimed, jobs, sources, chunks, model, 2, "embedding-worker-2", jobs_at())
    own = out.jobs.select("id", "status", "attempts", "version", "last_error")
    return out.results.select("id", "source_id", "n_chunks").join(own, "id")


@query
def embedding_job_chunks(spark, d):
    """What the chunks of a round look like afterwards: sources with vectors, and the sum of their first components."""
    jobs, sources = load(spark, d, "v_jobs"), load(spark, d, "v_sources")
    docs = load(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("id"), F.expr("doc_id % 400 + 1").alias("source_id"), F.col("text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"))

    def model():
        return lambda texts, task: [[float(len(t)), 1.0] for t in texts]

    out = embed_claimed(jobs.where("status = 'processing'"), jobs, sources, chunks, model, 2, "embedding-worker-2", jobs_at())
    return out.chunks.groupBy("source_id").agg(F.count("embedding").alias("n_vectors"), F.sum(F.col("embedding")[0].cast("double")).alias("total"))


@query
def set_embeddings(spark, d):
    chunks = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("array<float>").alias("embedding"))
    vectors = load(spark, d, "v_vectors").select("id", "embedding")
    out = mutations.set_embeddings(chunks, vectors, 64)
    return out.select("id", F.size("embedding").alias("dimension"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query
def insert_collections(spark, d):
    present = load(spark, d, "v_collections")
    new = load(spark, d, "customer").select((F.col("c_custkey") + 1_000_000).alias("id"), F.col("c_nationkey").alias("user_id"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ' ' || c_name ELSE c_mktsegment END").alias("title"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 7 END").alias("max_sources"))
    return mutations.insert_collections(new, present, jobs_at())[0]


@query
def insert_collections_refused(spark, d):
    present = load(spark, d, "v_collections")
    new = load(spark, d, "customer").select((F.col("c_custkey") + 1_000_000).alias("id"), F.col("c_nationkey").alias("user_id"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ' ' || c_name ELSE c_mktsegment END").alias("title"))
    return mutations.insert_collections(new, present, jobs_at())[1].select("id", "reason")


@query
def insert_sources(spark, d):
    present = load(spark, d, "v_sources")
    new = load(spark, d, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 9).alias("collection_id"), F.expr("CASE WHEN page_id % 5 = 0 THEN 'http://same.example/' ELSE url END").alias("url"))
    return mutations.insert_sources(new, present, jobs_at())[0]


@query
def insert_users(spark, d):
    present = load(spark, d, "v_users")
    new = load(spark, d, "supplier").select((F.col("s_suppkey") + 100).alias("id"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'FRANCE@example.com' ELSE 'S' || CAST(s_suppkey div 2 AS STRING) || '@x.example' END").alias("email"))
    return mutations.insert_users(new, present, jobs_at())[0]


@query
def update_users(spark, d):
    """E-mail changes: each third user asks for a neighbour's address, each fifth has an old version."""
    users = load(spark, d, "v_users").withColumn("version", F.expr("CAST(id % 3 + 1 AS INT)"))
    return mutations.update_unique(users, user_requests(users), ["email", "activated"], ["email"])[0]


@query
def update_users_refused(spark, d):
    users = load(spark, d, "v_users").withColumn("version", F.expr("CAST(id % 3 + 1 AS INT)"))
    return mutations.update_unique(users, user_requests(users), ["email", "activated"], ["email"])[1].select("id", "reason")


def user_requests(users):
    email = F.expr("CASE WHEN id % 3 = 0 THEN 'france@example.com' WHEN id % 3 = 1 THEN 'new' || CAST(id div 4 AS STRING) || '@example.com' END")
    return users.select("id", F.expr("CAST(version + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS INT)").alias("expected"), email.alias("email"), F.lit(True).alias("activated"))


@query
def update_duplicate_titles(spark, d):
    """Renames to the title of another collection of the same user are refused, as is the second of two equal ones."""
    rows = load(spark, d, "v_collections").withColumn("version", F.expr("CAST(id % 3 + 1 AS INT)"))
    requests = rows.select("id", F.col("version").alias("expected"), F.expr("CASE WHEN id % 2 = 0 THEN 'shared name' ELSE title END").alias("title"))
    return mutations.update_unique(rows, requests, ["title"], ["user_id", "title"])[1].select("id", "reason")


@query
def cascade_delete_user(spark, d):
    users, collections, sources, chunks = (load(spark, d, v) for v in ("v_users", "v_collections", "v_sources", "v_chunks"))
    tokens = load(spark, d, "customer").select(F.sha2("c_name", 256).alias("hash"), F.col("c_nationkey").alias("user_id"))
    left = mutations.delete_user(users.where("id = 7 OR id = 9").select("id"), users, tokens, collections, sources, chunks)
    counted = [f.select(F.lit(name).alias("relation")).groupBy("relation").agg(F.count(F.lit(1)).alias("n")) for name, f in zip(("users", "tokens", "collections", "sources", "chunks"), left)]
    return reduce(DataFrame.unionByName, counted)


@query
def chunk_sink(spark, d):
    """Chunks written by source, then each seventh source written again with one chunk: all other sources keep theirs."""
    path = f"{shared_root(spark)}/siltwork-chunks-{os.urandom(8).hex()}"
    chunks = load(spark, d, "v_chunks").select("source_id", "chunk_index", "token_count")
    fetch.write_chunks(chunks, path)
    fetch.write_chunks(chunks.where("source_id % 7 = 0").select("source_id", F.lit(0).alias("chunk_index"), F.lit(1).alias("token_count")).distinct(), path)
    return spark.read.parquet(path).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("tokens"))


@query
def metadata_read(spark, d):
    """Chunk metadata as JSON and read back; what isn't JSON reads as nothing."""
    rows = load(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.col("lang").alias("section_title"), F.col("source").alias("document_title"), "n_chars")).alias("j"))
    broken = F.when(F.col("doc_id") % 5 == 0, F.lit("{broken")).otherwise(F.col("j"))
    read = F.from_json(broken, "section_title string, document_title string, n_chars long")
    return rows.select("doc_id", F.coalesce(read["section_title"], F.lit("")).alias("section_title"), F.coalesce(read["document_title"], F.lit("")).alias("document_title"), read["n_chars"].alias("n_chars"))


@query
def cite_rate(spark, d):
    pages = load(spark, d, "pages")
    answers = pages.select(F.col("page_id").alias("query_id"), F.expr("CASE WHEN page_id % 3 > 0 THEN 'As ' || url || ' says.' ELSE 'I know.' END").alias("answer"))
    return search.cite_rate(answers, pages.select(F.col("page_id").alias("query_id"), "url")).select("n_answers", F.round("cite_rate", 9).alias("cite_rate"))


@query
def embedding_batch_statistics(spark, d):
    """Calls of a model that refuses batches of over eight texts for now: batches halve until they pass."""
    chunks = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))

    def model():
        from siltwork.functions.embedding import EmbedError

        refused = []

        def embed(texts, task):
            if len(refused) < 1 and len(texts) > 8:
                refused.append(len(texts))
                raise EmbedError(400 if len(texts) < 2 else 503)
            return [[1.0]] * len(texts)

        return embed

    return documents.batch_statistics(chunks, model, 1).select("n_chunks")


@query
def step_fold(spark, d):
    """Steps and statuses of sources from a row of changes, with late and impossible ones among them."""
    rows = load(spark, d, "events").select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), F.expr("CAST(1 + pmod(event_id, 6) AS INT)").alias("expected"),
        F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'ingesting' END").alias("status"),
        F.expr("CASE event_type WHEN 'signup' THEN 'fetch' WHEN 'view' THEN 'clean' WHEN 'click' THEN 'fetch' END").alias("step"),
    )
    return queues.fold_steps(rows)


@query
def reclaim_jobs(spark, d):
    return mutations.reclaim_jobs(load(spark, d, "v_jobs"), jobs_at())


@query
def insert_dedupe(spark, d):
    rows = load(spark, d, "v_chunks").groupBy("source_id", "chunk_index", "l_partkey", "l_suppkey").agg(F.max("token_count").alias("token_count"))
    return mutations.insert_unique(rows, ["source_id", "chunk_index"], ["l_partkey", "l_suppkey"])[0]


@query
def duplicate_rejects(spark, d):
    rows = load(spark, d, "v_chunks").groupBy("source_id", "chunk_index", "l_partkey", "l_suppkey").agg(F.max("token_count").alias("token_count"))
    present = load(spark, d, "v_sources").where("status = 'completed'").select(F.col("id").alias("source_id"), F.lit(0).alias("chunk_index"))
    return mutations.insert_unique(rows, ["source_id", "chunk_index"], ["l_partkey", "l_suppkey"], present)[1]


@query
def enqueue_unique_active(spark, d):
    jobs = load(spark, d, "v_jobs")
    early = F.col("run_after") < F.expr("TIMESTAMP_NTZ '2024-01-03 00:00:00'")
    active = jobs.where(early & F.col("status").isin("pending", "processing", "failed") & (F.col("attempts") == 0))
    return mutations.insert_unique(jobs.where(~early).select("id", "source_id", "source_version"), ["source_id", "source_version"], ["id"], active)[0]


@query
def replace_chunks(spark, d):
    chunks = load(spark, d, "v_chunks").select("source_id", "chunk_index", "token_count")
    new = load(spark, d, "v_sources").where("status = 'completed'").select(F.col("id").alias("source_id"), F.lit(0).alias("chunk_index"), F.lit(1).alias("token_count"))
    kept = mutations.replace_by_key(chunks, new, "source_id")
    return kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("tokens"))


@query
def cascade_delete_collection(spark, d):
    collections, sources, chunks = (load(spark, d, v) for v in ("v_collections", "v_sources", "v_chunks"))
    gone = collections.where("user_id = 7").select("id")
    left = mutations.delete_cascade(gone, [(sources, "collection_id"), (chunks, "source_id")])
    return left[0].agg(F.count(F.lit(1)).alias("n_sources")).crossJoin(left[1].agg(F.count(F.lit(1)).alias("n_chunks")))


@query
def delete_source_owned(spark, d):
    sources, collections = load(spark, d, "v_sources"), load(spark, d, "v_collections")
    own = collections.join(sources.where("id = 11").select(F.col("collection_id").alias("id")), "id").first()
    user = own["user_id"] if own else -1
    return mutations.delete_owned_source(sources, collections, 11, user).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") == 11).alias("n_11"))


@query
def partial_update_collection(spark, d):
    collections = load(spark, d, "v_collections").withColumn("version", F.expr("CAST(id % 3 + 1 AS INT)"))
    requests = collections.where("title LIKE 'BUILDING%'").select("id", F.lit(1).alias("expected"), F.expr("CASE WHEN id % 2 = 0 THEN 'renamed ' || CAST(id AS STRING) END").alias("title"), F.lit(50).alias("max_sources"))
    return mutations.update_rows(collections, requests, ["title", "max_sources"])


# --- validation ---


def with_errors(rows: DataFrame, key: str, found) -> DataFrame:
    return rows.select(F.col(key).alias("id"), validation.error_text(found).alias("errors"))


@query
def validate_collections(spark, d):
    rows = load(spark, d, "v_collections").withColumns({"t": F.expr("CASE WHEN id % 9 = 0 THEN '  ' WHEN id % 9 = 1 THEN repeat(title, 12) ELSE title END"), "m": F.expr("CAST(max_sources * 11 - 20 AS INT)")})
    return with_errors(rows, "id", validation.collection(F.col("t"), F.lit(""), F.col("m")))


@query
def validate_sources(spark, d):
    rows = load(spark, d, "pages").withColumns({"u": F.expr("CASE WHEN page_id % 7 = 0 THEN 'ftp://x.example/a' WHEN page_id % 7 = 1 THEN '' ELSE url END"), "n": F.expr("CAST(page_id % 30 AS INT)")})
    return with_errors(rows, "page_id", validation.source(F.col("page_id"), F.col("u"), expr.source_type(F.col("u")), F.lit("page"), F.col("n")))


@query
def validate_chunks(spark, d):
    return with_errors(load(spark, d, "documents"), "doc_id", validation.chunk(F.col("doc_id"), F.expr("CAST(doc_id % 5 AS INT) - 1"), F.col("text"), F.expr("CAST(n_chars div 4 AS INT)")))


@query
def validate_search_inputs(spark, d):
    return with_errors(load(spark, d, "documents"), "doc_id", validation.question(F.col("text"), F.expr("CAST(doc_id % 25 AS INT)"), 20))


@query
def validate_filters(spark, d):
    sort = F.expr("CASE id % 4 WHEN 0 THEN 'id' WHEN 1 THEN '-status' WHEN 2 THEN 'title' ELSE 'drop' END")
    return with_errors(load(spark, d, "v_sources"), "id", validation.filters(F.expr("CAST(id % 3 AS INT)"), F.expr("CAST(id % 120 AS INT)"), sort, ["id", "created_at", "status", "-id", "-created_at", "-status"]))


@query
def validate_jobs(spark, d):
    return with_errors(load(spark, d, "v_jobs"), "id", validation.job(F.col("source_id"), F.col("status"), F.col("attempts") - 1, F.col("max_attempts") - F.expr("CAST(id % 6 AS INT)")))


@query
def validate_emails(spark, d):
    rows = load(spark, d, "v_users")
    email = F.expr("CASE id % 4 WHEN 0 THEN email WHEN 1 THEN replace(email, '@', '.') WHEN 2 THEN '' ELSE replace(email, ' ', '-') END")
    return with_errors(rows.withColumn("e", email), "id", validation.user(F.col("fullname"), F.col("e"), F.col("fullname")))


URLS = ["https://www.youtube.com/watch?v=dQw4w9WgXcQ", "https://youtu.be/dQw4w9WgXcQ", "http://example.com/a.PDF", "http://example.com/a.pdf?x=1", "https://example.com/pdf", "  ", "", "example.com", "ftp://example.com/a.pdf", "https://example.com/a b", "HTTPS://EXAMPLE.COM/X", "http://", "https://m.youtube.com/watch?v=abcdefghijk", "HTTPS://YOUTU.BE/abcdefghijk", "youtu.be/a", "https://www.youtube.com/shorts/abcdefghijk", "youtube.com/embed/x", " https://youtu.be/abc", "example.com/a.pdf", "/a.PDF#page=2", "http://x.y/a.%70df", "http://x.y/a%zz.pdf", "mailto:a.pdf", "a:b.pdf", "x/a:b.pdf"]


@query
def detect_source_type(spark, d):
    rows = load(spark, d, "pages").select("url").unionByName(spark.createDataFrame([(u,) for u in URLS], "url string"))
    return rows.select("url", expr.source_type(F.col("url")).alias("source_type"))


@query
def valid_url(spark, d):
    rows = load(spark, d, "pages").select("url").unionByName(spark.createDataFrame([(u,) for u in URLS], "url string"))
    return rows.select("url", expr.valid_url(F.col("url")).alias("valid"))


# --- retries and failures ---


@query
def failure_classification(spark, d):
    kinds = spark.createDataFrame([(k,) for k in (*expr.PERMANENT_KINDS, "cancelled", "http", "unknown")], "kind string")
    codes = spark.range(400, 600).select(F.col("id").cast("int").alias("status"))
    return kinds.crossJoin(codes).select("kind", "status", expr.failure_is_permanent(F.col("kind"), F.col("status")).alias("permanent"))


@query
def fetch_check(spark, d):
    rows = load(spark, d, "pages").select("page_id", "html", F.expr("CASE page_id % 6 WHEN 0 THEN 404 ELSE 200 END").alias("status"), F.expr("CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN '' ELSE 'Text/HTML; charset=utf-8' END").alias("kind"))
    article = F.expr("CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE html END")
    size = F.expr("CASE WHEN page_id % 11 = 0 THEN 0 WHEN page_id % 13 = 0 THEN 10485761 ELSE octet_length(html) END")
    return rows.select("page_id", expr.fetch_error(F.col("status"), F.col("kind"), size, article).alias("error"))


@query
def fetch_retry(spark, d):
    return spark.range(400, 600).select(F.col("id").alias("status"), F.col("id").isin(expr.RETRYABLE_FETCH).alias("retry"))


@query
def retry_after(spark, d):
    headers = ["120", " 7 ", "0", "-5", "+3", "x", "", "Sat, 20 Jan 2024 00:01:00 GMT", "Fri, 19 Jan 2024 23:00:00 GMT", "2024-01-20"]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(headers)], "id int, header string")
    return rows.select("id", expr.retry_after_seconds(F.col("header"), F.expr("TIMESTAMP '2024-01-20 00:00:00'")).alias("seconds"))


@query
def backoff_schedule(spark, d):
    n = F.col("id")
    return spark.range(1, 25).select(
        n.alias("attempt"),
        expr.capped_doubling(500, n, 5000).alias("fetch_ms"),
        expr.capped_doubling(500, n, 10000).alias("embed_ms"),
        expr.next_poll_wait(n, F.lit(2), F.lit(30), n % 5 == 0).cast("long").alias("poll_s"),
    )


# --- text ---


@query
def plain_text_blocks(spark, d):
    literal = spark.createDataFrame([(-1 - k, s) for k, s in enumerate(PARAGRAPHS)], "doc_id long, text string")
    return documents.plain_text_blocks(literal.unionByName(load(spark, d, "documents").select("doc_id", "text")))


PARAGRAPHS = ["The first paragraph goes on\nover two lines.\n\nThe second one is long enough, too.", "The first paragraph has one line only.\nThe second one is long enough, too.\n\n", "\n\n short \n\n", None]


LINES = ["- first", "* second", "+ third", "10. install dependencies", "3.x", "-x", "| a | b |", "| grep main", "| ---- | ---- |", "|---|", "a --- b", "| --- | :---: |", "see [the docs](http://x.y/z) now", "![logo](l.png) text  with\tspaces", "1. ", "|a|b|", "||a||", "1.\tone", "2.\ttwo. three", "- see [it](u) ![i](j) now"]


def lines(spark, d):
    """The literal lines and every line of every document."""
    literal = spark.createDataFrame([(-1, k, s) for k, s in enumerate(LINES)], "doc_id long, pos int, line string")
    return literal.unionByName(load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")))


@query
def table_lines(spark, d):
    return lines(spark, d).select("doc_id", "pos", expr.is_table_line(F.col("line")).alias("is_table"))


@query
def list_item_lines(spark, d):
    return lines(spark, d).select("doc_id", "pos", expr.list_item(F.col("line")).alias("item"))


@query
def normalize_markdown(spark, d):
    return lines(spark, d).select("doc_id", "pos", expr.plain_markdown(F.col("line")).alias("text"))


LISTS = ["Install Go; Configure GOPATH; Run go test", "- first\n- second\n3. third", " ; ", "* - + 2. x"]


@query
def list_split(spark, d):
    """Items of the literal lists and of every document taken as a list."""
    literal = spark.createDataFrame([(-1 - k, s) for k, s in enumerate(LISTS)], "doc_id long, text string")
    rows = literal.unionByName(load(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.posexplode(expr.list_items(F.col("text"))).alias("pos", "item"))


@query
def context_prefix(spark, d):
    literal = spark.createDataFrame([(-1, "Guide", "A > B"), (-2, "Guide", " "), (-3, "", "A"), (-4, None, None)], "doc_id long, document string, section string")
    rows = literal.unionByName(load(spark, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 > 0 THEN source END AS document", "CASE WHEN doc_id % 2 = 0 THEN lang ELSE ' ' END AS section"))
    return rows.select("doc_id", expr.context_prefix(F.col("document"), F.col("section")).alias("prefix"))


@query
def section_labels(spark, d):
    rows = load(spark, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 > 0 THEN source || ' ' END AS t", "CASE WHEN doc_id % 2 = 0 THEN lang ELSE ' ' END AS p")
    title, path = expr.section_label(F.col("t"), F.col("p"))
    return rows.select("doc_id", title.alias("title"), path.alias("path"))


@query
def sentences(spark, d):
    return documents.sentences(load(spark, d, "documents"))


@query
def token_counts_words(spark, d):
    return documents.word_counts(load(spark, d, "documents"))


@query
def token_counts(spark, d):
    return documents.token_counts(load(spark, d, "documents"))


MARKDOWN = [
    "# Guide\n\nA first paragraph that\ngoes over two lines of text.\n## ![logo](x.png)\nStill in the guide, as an image names no section at all.\n### Deep [link](http://u)\n- Install all of the [tools](http://t)\n* Configure them\n10. Run",
    "```go\nfmt.Println(\"hello\")  \n```\n```\nx\n```",
    "| name | value |\n| ---- | ---- |\n| alpha | [one](http://u) |\n| beta beta | two and more |\n\nThe text after the table is a paragraph.\n\nThe text after the table is a paragraph.",
    "| a row | without any header |\n| another row | of the same table |\n|---|---|\n",
    "| one line alone is a paragraph | as it has no second |\n",
    "Too short.\n\n- short\n\n---\nA paragraph after a rule, long enough to be kept.\n1.\ttabbed items are no items, so they are paragraphs",
    "## Two\nText of the second level, without a first one above it.\n# One\nText of the first level, which comes after the second.\n### Three\nText of the third level, with a gap above it in the path.",
    "| a | b |\n```\ncode comes before the table above it\n```\n| --- | --- |\n| the first cell | the second cell |",
]
HTML = [
    "<h1>Introduction</h1><p>This is a sufficiently long paragraph to verify the first way of extraction.</p>",
    "<h1>Guide</h1><h2>Install</h2><ul><li>Install all of the dependencies</li><li>Configure the environment</li></ul><h3>Run</h3><pre><code class=\"language-go\">fmt.Println(\"hello, this is code\")</code></pre>",
    "<script>var x = 1;</script><nav>menu</nav><p>Text after scripts &amp; menus, which is long enough to stay here.</p>",
    "<table><tr><th>name</th><th>value</th></tr><tr><td>alpha beta</td><td>gamma delta epsilon</td></tr></table>",
    "<p>short</p>",
]


@query
def markdown_blocks(spark, d):
    rows = spark.createDataFrame(list(enumerate(MARKDOWN)), "doc_id long, text string")
    return documents.markdown_blocks(rows).drop("clean_method")


@query
def html_literal_blocks(spark, d):
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(HTML)], "page_id long, html string")
    return documents.clean_pages(rows)


@query
def html_blocks(spark, d):
    return documents.clean_pages(load(spark, d, "pages"))


@query
def html_method_distribution(spark, d):
    first = documents.clean_pages(load(spark, d, "pages")).where("block_index = 0")
    return relational.shares(first, "clean_method")


@query
def chunk_documents(spark, d):
    return documents.chunk_documents(load(spark, d, "documents"), lambda: words)


@query
def chunk_pages(spark, d):
    return documents.chunk_pages(load(spark, d, "pages"))


@query
def embed_chunks(spark, d):
    from siltwork.functions.embedding import hashed_words

    chunks = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return documents.embed_chunks(chunks, lambda: hashed_words(64), 64)


@query
def flatten_messages(spark, d):
    return search.flatten_messages(load(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query
def prompt_build(spark, d):
    turns = load(spark, d, "conversations")
    hits = turns.select(
        "conv_id", (F.col("turn") + 1).alias("rank"), F.expr("CASE WHEN turn % 2 = 0 THEN role END").alias("title"), F.expr("CASE WHEN turn % 3 = 0 THEN 'doc' END").alias("document_title"),
        F.lit("https://example.com").alias("url"), F.lit("").alias("section"), F.col("turn").alias("chunk_index"), (F.col("turn") / 8).alias("distance"), F.col("text").alias("content"),
    )
    return search.prompt(hits, F.lit("What is this about?"), ["conv_id"])


# --- streams ---


def _as_stream(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows as a file stream of two files a micro-batch, from the shared folder; rows of a key are in one file."""
    spark = rows.sparkSession
    path = f"{shared_root(spark)}/siltwork-stream-{os.urandom(8).hex()}"
    rows.repartition(4, *keys).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream to its end into a memory table; the last row of each key is what the caller keeps."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def transitions(spark, d):
    rows = load(spark, d, "v_jobs")
    return rows.select("source_id", F.col("id").alias("seq"), F.col("version").alias("expected"))


@query
def version_fold(spark, d):
    return queues.fold_versions(transitions(spark, d))


@query
def stream_claim_fold(spark, d):
    """The version fold over a stream; each key comes in one micro-batch, so the last state equals the table's fold."""
    stream = _as_stream(transitions(spark, d), "source_id")
    out = _drain(queues.fold_versions(stream), "update", f"fold_{os.urandom(4).hex()}")
    return out.groupBy("source_id").agg(F.max_by("applied", "version").alias("applied"), F.max("version").alias("version"))


@query
def stream_arrivals(spark, d):
    """An extension over the reference: event-time windows with a watermark."""
    rows = load(spark, d, "events").select("event_id", "ts", "event_type")
    out = _drain(queues.arrivals_per_window(_as_stream(rows)), "complete", f"arrivals_{os.urandom(4).hex()}")
    return out.select("event_type", F.col("n"))


@query
def stream_reclaim(spark, d):
    """Jobs that arrive on a stream are stored, and each micro-batch reclaims what got stuck; the last state's counts."""
    rows = load(spark, d, "v_jobs")
    state = queues.QueueState(f"{shared_root(spark)}/siltwork-queue-{os.urandom(8).hex()}")
    return relational.counts_by(queues.drain(_as_stream(rows), state, jobs_at(), 0, ""), "status")


@query
def stream_queue(spark, d):
    """Jobs that arrive on a stream are claimed in bursts of 2,000 and worked on until none is due; the last state."""
    rows = load(spark, d, "v_jobs")
    state = queues.QueueState(f"{shared_root(spark)}/siltwork-queue-{os.urandom(8).hex()}")
    work = lambda claimed: claimed.select("id", F.expr("CASE WHEN id % 3 = 0 THEN 'no chunks' END").alias("error"))
    last = queues.drain(_as_stream(rows), state, jobs_at(), max(1, rows.count() // 5), "embedding-worker-1", work)
    return last.groupBy("status", "attempts").agg(F.count(F.lit(1)).alias("n"))


@query
def reclaim_round(spark, d):
    return relational.counts_by(queues.reclaim_all(load(spark, d, "v_jobs"), jobs_at()), "status")


@query
def rate_limit_fold(spark, d):
    rows = load(spark, d, "events").select(F.col("user_id").alias("key"), (F.col("event_id") * F.lit(0.25)).alias("at_s"))
    return queues.allowed_requests(rows)


