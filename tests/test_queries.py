"""Catalogue queries against their SQL on another engine, and operators on small fixtures."""

from __future__ import annotations

import datetime
import math
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltwork.functions import expr
from siltwork.operators import ann, mutations, relational, search
from siltwork.plans.catalogue import QUERIES
from siltwork.plans.oracles import oracle_sql
from siltwork.sources.fetch import cleaned_methods, fetch_pages
from siltwork.streaming import queues

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    expected = duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == kinds
    order = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    at = [expected.columns.index(c) for c in order]
    assert ours == sorted(repr([plain(r[k]) for k in at]) for r in expected.fetchall())


@pytest.mark.parametrize("name", ["sentences", "chunk_documents"])
def test_plain_sentences_equal_sql_on_odd_texts(spark, tmp_path, name):
    texts = [
        "word " * 394 + "end. a no. No. b c d e. More of it follows here.", "Say no. No. El fin. st. st. st. st. Next st.  st. one.", "NO!! AL!! DEL!! (Dr. (Dr. x e.g. i.e. U.S. done. ok",
        "In 3. 4. and 5. Then \u0663. so. N\u00ba. x \u017ft. y", "a (" + "(" * 40 + "no" + "." * 40 + " b. c", "no.\nNo.\n\nFirst line. of\u00a0two.\u00a0Three\tno.\tNo.\tx.\fy. z", " \f. \r\n", "", None,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    expected = con.sql(oracle_sql()[name]).select(", ".join(df.columns)).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle_sql())))
def test_other_queries_run(spark, data_dir, name):
    assert QUERIES[name](spark, data_dir).count() > 0


def test_unsafe_sort():
    with pytest.raises(ValueError):
        relational.sort_columns("id; drop", relational.SOURCE_SORTS)


def test_zero_vectors_give_nan(spark):
    row = spark.sql("SELECT array(0f, 0f) AS a, array(1f, 0f) AS b").select(expr.cosine_distance(F.col("a"), F.col("b")).alias("d")).first()
    assert math.isnan(row["d"])


def test_keywords(spark):
    rows = spark.createDataFrame([("Red ring, blue",), ("red",), ("Été à Paris",)], "t string")
    found = lambda q: [r.t for r in rows.where(expr.matches_keywords(F.col("t"), F.lit(q))).collect()]
    assert found("RING red") == ["Red ring, blue"] and found("?!") == [] and found("été") == ["Été à Paris"]


def test_search_pushes_filters_and_takes_top_k(spark, data_dir):
    plan = QUERIES["vector_search_topk"](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(embedding)" in plan


def test_claims_order_and_lock(spark):
    rows = spark.createDataFrame([(1, "pending", 0, "1997-01-02"), (2, "failed", 4, None), (3, "failed", 5, None), (4, "pending", 0, "1999-01-01"), (5, "pending", 1, "1997-01-01")], "id long, status string, retry_count int, due string")
    rows = rows.select("id", "status", "retry_count", F.to_timestamp_ntz("due").alias("next_retry_at"), F.lit("x").alias("current_step"), F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'").alias("updated_at"), F.lit(1).alias("version"))
    at = F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    got = mutations.claim_sources(rows, at, 2).collect()
    assert [r.id for r in got] == [2, 5] and {r.status for r in got} == {"ingesting"} and {r.version for r in got} == {2}
    assert [r.id for r in mutations.claim_sources(rows, at, 9, locked=rows.where("id = 5")).collect()] == [2, 1]


def test_fifth_failure_is_final(spark):
    rows = spark.sql("SELECT 1L AS id, 'ingesting' AS status, n AS retry_count, CAST(NULL AS TIMESTAMP_NTZ) AS next_retry_at, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS updated_at, 6 AS version FROM VALUES (3), (4) t(n)")
    at = F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'")
    rows = rows.withColumns({"id": F.col("retry_count").cast("long"), "current_step": F.lit("fetch")})
    requests = rows.select("id", F.lit(6).alias("expected"), F.lit("chunk").alias("step"), F.lit("why").alias("error"))
    a, b = mutations.fail_sources(rows, requests, at).orderBy("retry_count").collect()
    assert mutations.fail_sources(rows, requests.withColumn("expected", F.lit(5)), at).count() == 0
    assert (a.current_step, a.step_error) == ("chunk", "why")
    assert (a.status, a.retry_count, a.version, a.next_retry_at.minute) == ("failed", 4, 7, 8)
    assert (b.status, b.retry_count, b.version, b.next_retry_at.minute) == ("stale", 5, 8, 16)


def test_clean_run_of_versions(spark):
    steps = [(7, k, v) for k, v in enumerate([1, 2, 3, 4, 5, 6, 7])] + [(8, 0, 1), (8, 1, 1), (8, 2, 2)]
    out = {r.source_id: r for r in queues.fold_versions(spark.createDataFrame(steps, "source_id long, seq long, expected int")).collect()}
    assert (out[7].version, out[7].stale) == (8, 0) and (out[8].version, out[8].applied, out[8].stale) == (3, 2, 1)


def test_streamed_fold_equals_the_table(spark, data_dir):
    batch = {r.source_id: (r.applied, r.version) for r in QUERIES["version_fold"](spark, data_dir).collect()}
    stream = {r.source_id: (r.applied, r.version) for r in QUERIES["stream_claim_fold"](spark, data_dir).collect()}
    assert batch == stream


def test_bucket_of_requests(spark):
    rows = spark.createDataFrame([(1, 0.0)] * 6 + [(1, 1.0)] * 3 + [(1, 500.0)] * 5, "key long, at_s double")
    (r,) = queues.allowed_requests(rows).collect()
    assert (r.allowed, r.refused) == (4 + 2 + 4, 4)


def test_ask_without_hits(spark):
    hits = spark.createDataFrame([], "rank int, title string, document_title string, url string, section string, chunk_index int, distance double, content string")
    assert search.ask(hits, "why?", lambda *a, **k: pytest.fail("called"))["answer"] == search.NOT_ENOUGH


def test_ask_with_hits(spark):
    hits = spark.createDataFrame([(1, " ", None, "http://u", None, 3, 0.25, "text")], "rank int, title string, document_title string, url string, section string, chunk_index int, distance double, content string")
    seen = {}

    def llm(messages, **options):
        seen["text"] = messages[1]["content"]
        return "answer"

    assert search.ask(hits, "why?", llm)["answer"] == "answer"
    assert "[1]\nTitle:  \n" in seen["text"] and "ChunkIndex: 3\n" in seen["text"] and "Content:\ntext" in seen["text"] and "Section: (none)" in seen["text"] and "Distance: 0.2500" in seen["text"]
    with pytest.raises(ValueError):
        search.ask(hits, "why?", lambda *a, **k: " ")


JOBS = "id long, source_id long, source_version int, status string, attempts int, max_attempts int, run_after timestamp_ntz, locked_at timestamp_ntz, locked_by string, version int"


def test_bursts_over_the_claim_size(spark, tmp_path):
    """What is over n waits in the stored state, a batch that runs again changes nothing, older jobs are claimed, too."""
    at = datetime.datetime(2024, 1, 1)
    job = lambda k: (k, k, 1, "pending", 0, 5, at + datetime.timedelta(seconds=k), None, None, 1)
    state = queues.QueueState(str(tmp_path / "queue"))
    sink = queues.work_batch(state, F.lit(datetime.datetime(2024, 2, 1)).cast("timestamp_ntz"), 3, "w1")
    sink(spark.createDataFrame([job(k) for k in range(8)], JOBS), 0)
    claimed = lambda: sorted(r.id for r in state.read(spark).where("status = 'processing' and locked_by = 'w1'").collect())
    assert claimed() == [0, 1, 2] and state.read(spark).count() == 8
    sink(spark.createDataFrame([job(k) for k in (8, 9, 3)], JOBS), 1)
    sink(spark.createDataFrame([job(k) for k in (8, 9, 3)], JOBS), 1)
    assert claimed() == [0, 1, 2, 3, 4, 5] and state.read(spark).count() == 10 and state.batches(spark) == [0, 1]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "queue/claims/batch=1")).collect()) == [3, 4, 5]
    for n in range(2, 6):
        sink(spark.createDataFrame([], JOBS), n)
    assert claimed() == list(range(10)) and state.batches(spark) == [3, 4, 5]


def test_fetching_rows(spark):
    page = "<html><head><title>T</title></head><body><article><p>" + "some long enough text of an article. " * 20 + "</p></article></body></html>"

    def client():
        from siltwork.sources.fetch import Response

        return lambda url, seconds: Response(200, "text/html", page.encode(), url) if "good" in url else Response(404, "text/html", b"x", url)

    rows = {r.id: r for r in fetch_pages(spark.createDataFrame([(1, "http://good/"), (2, "http://bad/"), (3, None)], "id long, url string"), client).collect()}
    assert rows[1].error == 0 and rows[1].title == "T" and "article" in rows[1].text
    assert (rows[2].error, rows[3].error) == (404, 400) and rows[2].html is None


def test_nearest_in_blocks(spark):
    vectors = spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(50)] + [(90, [0.0, 0.0]), (91, None), (92, [1.0])], "id long, embedding array<float>")
    queries = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "query_id long, query array<float>")
    key = lambda rows: sorted((r.query_id, r.rank, r.chunk_id, str(r.distance)) for r in rows.collect())
    whole = key(search.search_many(vectors, queries, 4))
    assert whole == key(search.search_many(vectors.repartition(6), queries, 4, block=2)) and len(whole) == 20
    assert [c for q, _, c, _ in whole if q == 2] == [2, 9, 16, 23]
    assert search.search_many(vectors, queries.limit(0), 4).count() == 0 and search.search_many(vectors.limit(0), queries, 4).count() == 0


def brute_nearest(vectors, queries, k, other_than_self=False, allowed=lambda q, v: True):
    """(query_id, rank, chunk_id, distance) by a loop over all pairs; pairs without a distance come last."""
    out = []
    unit = lambda v: np.array(v, float) / np.sqrt(np.dot(v, v)) if np.any(v) else np.full(len(v), np.nan)
    rows = [(v, unit(e)) for v, e in vectors]
    for q, e in queries:
        m = unit(e)
        found = sorted((math.inf if np.isnan(d) else float(d), v) for v, x in rows if allowed(q, v) and not (other_than_self and v == q) for d in [np.round(1 - m @ x, 12)])
        out += [(q, n + 1, v, str(d)) for n, (d, v) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize("other", [False, True])
def test_nearest_equals_brute_force_on_copies_and_zero_vectors(other):
    """Copies in falling and mixed order of ids, zero vectors and zero queries, over several batches and tiles."""
    random = np.random.default_rng(1)
    some = random.integers(-2, 3, (40, 3)).astype(float)
    some[:2] = 0
    vectors = [(int(v), some[random.integers(0, 40)].tolist()) for v in [*range(3000, 2000, -1), *random.permutation(2000)]]
    queries = [(v, e) for v, e in vectors if v % 100 == 0]
    asked = pa.table({"query_id": pa.array([q for q, _ in queries]), "query": pa.array([e for _, e in queries], pa.list_(pa.float32()))})
    rows = pa.table({"id": pa.array([v for v, _ in vectors]), "embedding": pa.array([e for _, e in vectors], pa.list_(pa.float32()))})
    found = pa.Table.from_batches(search._nearest(asked, 7, other, [])(iter(rows.to_batches(max_chunksize=700)))).to_pylist()
    ours = sorted((r["query_id"], math.inf if math.isnan(r["distance"]) else r["distance"], r["chunk_id"]) for r in found)
    assert [(q, v, str(d)) for q, d, v in ours] == [(q, v, d) for q, _, v, d in sorted(brute_nearest(vectors, queries, 7, other))]


@pytest.mark.parametrize("other", [False, True])
def test_memory_of_nearest_does_not_grow_with_rows_and_queries(other):
    """A block of queries with an Arrow batch would be a matrix of 164 MB, and ranking it whole several of them."""
    random = np.random.default_rng(2)
    lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 4).cast(pa.list_(pa.float64()))
    x = random.normal(size=(10_000, 4))
    asked = pa.table({"query_id": pa.array(range(2048)), "query": lists(x[:2048])})
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), lists(x)], names=["id", "embedding"])
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(search._nearest(asked, 5, other, [])(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()
    assert found.num_rows == 5 * 2048


def test_cells_meet_the_queries_that_probe_them(spark):
    """The inverted file against a loop over the pairs whose cell is probed; no pair becomes a row of the plan."""
    random = np.random.default_rng(3)
    rows = [(k, random.normal(size=4).tolist()) for k in range(300)] + [(300, [0.0] * 4)]
    vectors = spark.createDataFrame([*rows, (301, None)], "id long, embedding array<double>")
    queries = vectors.where("id % 20 = 0 and id < 300").selectExpr("id AS query_id", "embedding AS query")
    c = ann.centres(vectors, 6)
    index = ann.assign(vectors, c)
    found = ann.search(index, queries, c, 5, probes=2)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    cell = {r.id: r.cell for r in index.collect()}
    probed: dict[int, set[int]] = {}
    for r in ann.assign(queries, c, 2).collect():
        probed.setdefault(r.query_id, set()).add(r.cell)
    expected = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0 and r[0] < 300], 5, allowed=lambda q, v: cell[v] in probed[q])
    assert sorted((r.query_id, r["rank"], r.chunk_id, round(r.distance, 9)) for r in found.collect()) == [(q, n, v, round(float(d), 9)) for q, n, v, d in sorted(expected)]
    assert len(cell) == 302 and ann.centres(vectors.limit(0), 6).shape == (0, 0)


def test_log_scan(spark, tmp_path):
    (tmp_path / "log").write_text('x msg="pipeline: cleaned" method=markdown\nx msg="pipeline: cleaned" method=legacy\nother method=markdown\nx msg="pipeline: cleaned" method=markdown\n')
    assert {(r.method, r.n, r.percent) for r in cleaned_methods(spark, str(tmp_path / "log")).collect()} == {("markdown", 2, 66.67), ("legacy", 1, 33.33)}


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
