"""Driver tables as the engine's relations: one SQL text for Spark and for the checking engine.

users, collections (owner: a user), sources (of a collection), chunks (of a source), embedding jobs, and vectors.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, str]] = {
    "v_users": (
        "nation",
        "SELECT n_nationkey AS id, lower(n_name) || '@example.com' AS email, n_name AS fullname, n_regionkey <> 0 AS activated FROM nation",
    ),
    "v_collections": (
        "customer",
        "SELECT c_custkey AS id, c_nationkey AS user_id, c_mktsegment || ' ' || c_name AS title, CAST(c_custkey % 16 + 1 AS INT) AS max_sources FROM customer",
    ),
    "v_sources": (
        "orders",
        """SELECT o_orderkey AS id, o_custkey AS collection_id,
  'https://example.com/doc/' || CAST(o_orderkey AS STRING) AS url,
  CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'ingesting' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'stale' END AS status,
  CASE WHEN o_orderkey % 5 = 1 THEN CASE o_orderkey % 4 WHEN 0 THEN 'fetch' WHEN 1 THEN 'clean' WHEN 2 THEN 'chunk' ELSE 'embed' END END AS current_step,
  CAST(o_orderkey % 6 AS INT) AS retry_count,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS next_retry_at,
  o_orderdate AS updated_at, CAST(o_orderkey % 7 + 1 AS INT) AS version FROM orders""",
    ),
    "v_chunks": (
        "lineitem",
        "SELECT l_orderkey AS source_id, l_linenumber - 1 AS chunk_index, l_partkey, l_suppkey, CAST(l_quantity * 8 AS INT) AS token_count, l_returnflag <> 'N' AS embedded FROM lineitem",
    ),
    "v_jobs": (
        "events",
        """SELECT event_id AS id, user_id AS source_id, 7 AS source_version,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'dead' END AS status,
  CAST(event_id % 6 AS INT) AS attempts, 5 AS max_attempts, ts AS run_after,
  CASE WHEN event_type = 'view' THEN ts END AS locked_at,
  CASE WHEN event_type = 'view' THEN 'embedding-worker-' || CAST(event_id % 4 AS STRING) END AS locked_by,
  CAST(event_id % 7 + 1 AS INT) AS version FROM events""",
    ),
    "v_vectors": ("embeddings", "SELECT vec_id AS id, vec_id % 250 AS source_id, label, embedding FROM embeddings"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or one of the views above over it."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base, text = VIEWS[name]
    body, _, source = text.rpartition(" FROM ")
    columns = re.sub(r"^SELECT\s+", "", body)
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*split_columns(columns))


def split_columns(text: str) -> list[str]:
    """Select items, cut at the commas outside parentheses and quotes."""
    items, depth, quoted, start = [], 0, False, 0
    for k, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted and c == "(":
            depth += 1
        elif not quoted and c == ")":
            depth -= 1
        elif not quoted and depth == 0 and c == ",":
            items.append(text[start:k].strip())
            start = k + 1
    return [*items, text[start:].strip()]


def with_views(sql: str) -> str:
    """``sql`` with the views it names as leading common table expressions."""
    used = [f"{name} AS ({text})" for name, (_, text) in VIEWS.items() if re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql
    sql = sql.strip()
    recursive = re.match(r"WITH RECURSIVE\s+", sql, re.I)
    if recursive:
        return f"WITH RECURSIVE {', '.join(used)}, {sql[recursive.end():]}"
    plain = re.match(r"WITH\s+", sql, re.I)
    if plain:
        return f"WITH {', '.join(used)}, {sql[plain.end():]}"
    return f"WITH {', '.join(used)} {sql}"


def default_dir(scale: str) -> str:
    return os.path.join(os.environ.get("TESTDATA_DIR", "/root/testdata"), f"sf{scale}")
