"""State changes as functions from table to table.

Spark tables have no UPDATE: each change takes the old state (and requests) and returns the new state, or the changed
rows as ``RETURNING`` would. Versions are optimistic locks; requests whose version or status doesn't fit are conflicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.functions.expr import MAX_RETRIES, minutes, retry_at
from siltwork.operators.relational import claimable_job, claimable_source, stuck_job, stuck_source


def updated(rows: DataFrame, **changes: Column) -> DataFrame:
    """``rows`` with the changed columns, all computed from the old row, in the old order and types."""
    kinds = dict(rows.dtypes)
    return rows.select(*[changes[c].cast(kinds[c]).alias(c) if c in changes else F.col(c) for c in rows.columns])


def insert_unique(new: DataFrame, keys: list[str], order: list[str], present: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(inserted, duplicates): the first row of each key that ``present`` doesn't have yet, and all others.

    Duplicates carry the column ``reason``: batch or present.
    """
    ranked = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))  # the join below keeps its partitioning
    held = present.select(*keys).distinct().withColumn("_held", F.lit(True)) if present is not None else None
    ranked = ranked.join(held, keys, "left") if held is not None else ranked.withColumn("_held", F.lit(None).cast("boolean"))
    fresh = F.col("_held").isNull() & (F.col("_n") == 1)
    inserted = ranked.where(fresh).select(*new.columns)
    reason = F.when(F.col("_held").isNotNull(), "present").otherwise("batch")
    return inserted, ranked.where(~fresh).select(*new.columns, reason.alias("reason"))


def claim_sources(sources: DataFrame, as_of: Column, n: int, locked: DataFrame | None = None) -> DataFrame:
    """The next ``n`` claimable sources as claimed: those never due first, then by due time and id; locked ids are skipped."""
    free = sources.where(claimable_source(as_of))
    if locked is not None:
        free = free.join(locked.select("id"), "id", "left_anti")
    first = free.orderBy(F.col("next_retry_at").asc_nulls_first(), "id").limit(n)
    return updated(first, status=F.lit("ingesting"), current_step=F.lit("fetch"), next_retry_at=F.lit(None), updated_at=as_of, version=F.col("version") + 1)


def claim_jobs(jobs: DataFrame, as_of: Column, n: int, worker: str, locked: DataFrame | None = None) -> DataFrame:
    """The next ``n`` (at least one) claimable jobs as claimed by ``worker``."""
    free = jobs.where(claimable_job(as_of))
    if locked is not None:
        free = free.join(locked.select("id"), "id", "left_anti")
    first = free.orderBy(F.col("run_after").asc_nulls_last(), "id").limit(max(n, 1))
    return updated(first, status=F.lit("processing"), locked_at=as_of, locked_by=F.nullif(F.lit(worker), F.lit("")), version=F.col("version") + 1)


def requested(state: DataFrame, requests: DataFrame, status: str) -> DataFrame:
    """State rows that a request (id, expected[, ...]) may change: same version, right status."""
    own = requests.withColumnsRenamed({c: f"req_{c}" for c in requests.columns if c != "id"})
    return state.join(own, "id").where((F.col("version") == F.col("req_expected")) & (F.col("status") == status))


def conflicts(state: DataFrame, requests: DataFrame, status: str) -> DataFrame:
    """Requests that change nothing because the version or the status has moved on."""
    fits = state.where(F.col("status") == status).select("id", F.col("version").alias("expected"))
    return requests.join(fits, ["id", "expected"], "left_anti")


def advance_step(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """Sources moved to the requested status and step (id, expected, status, step)."""
    rows = requested(sources, requests, "ingesting")
    return updated(rows, status=F.col("req_status"), current_step=F.coalesce("req_step", "current_step"), version=F.col("version") + 1).select(*sources.columns)


def fail_sources(sources: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Sources as failed by requests (id, expected, step, error), or after the fifth failure as stale.

    A request changes a source that is still ingesting at the expected version; the others are ``conflicts``. A stale one
    has had two changes and keeps its due time. Column ``step_error`` is added where it is absent.
    """
    count = F.coalesce("retry_count", F.lit(0))
    gone = count + 1 >= MAX_RETRIES
    return _changed(
        sources, requested(sources, requests, "ingesting"), "step_error",
        status=F.when(gone, "stale").otherwise("failed"),
        current_step=F.col("req_step"),
        retry_count=count + 1,
        next_retry_at=retry_at(as_of, count),
        updated_at=as_of,
        version=F.col("version") + F.when(gone, 2).otherwise(1),
    )


def stale_sources(sources: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Sources given up by requests (id, expected, step, error), under the guard of ``fail_sources``."""
    count = F.coalesce("retry_count", F.lit(0))
    rows = requested(sources, requests, "ingesting")
    return _changed(sources, rows, "step_error", status=F.lit("stale"), current_step=F.col("req_step"), retry_count=count + 1, next_retry_at=F.lit(None), updated_at=as_of, version=F.col("version") + 1)


def _changed(state: DataFrame, rows: DataFrame, error: str, **changes: Column) -> DataFrame:
    """``updated`` rows with the request's error, in the columns of ``state`` and the error's."""
    rows = rows.withColumn(error, F.col("req_error"))
    return updated(rows, **changes).select(*dict.fromkeys([*state.columns, error]))


def reclaim_sources(sources: DataFrame, as_of: Column, stuck_minutes: int = 10) -> DataFrame:
    """Sources stuck in ingestion, set free or given up, with the error that says so (column step_error)."""
    count = F.coalesce("retry_count", F.lit(0)) + 1
    gone = count >= MAX_RETRIES
    note = F.concat(F.lit("auto-recovered stuck ingesting at step="), F.coalesce("current_step", F.lit("unknown")))
    stuck = sources.where(stuck_source(as_of, stuck_minutes)).withColumn("step_error", note)
    return updated(
        stuck,
        status=F.when(gone, "stale").otherwise("failed"),
        retry_count=count,
        next_retry_at=F.when(~gone, as_of),
        updated_at=as_of,
        version=F.col("version") + 1,
    )


def _locked(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs in process that a request (id, expected, worker) may change: the lock must be absent or the worker's."""
    own = F.col("locked_by").isNull() | (F.col("locked_by") == F.nullif(F.col("req_worker"), F.lit("")))
    return requested(jobs, requests, "processing").where(own)


def complete_jobs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs done (id, expected, worker)."""
    none = F.lit(None)
    return updated(_locked(jobs, requests), status=F.lit("completed"), locked_at=none, locked_by=none, version=F.col("version") + 1).select(*jobs.columns)


def fail_jobs(jobs: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Jobs as failed by requests (id, expected, worker, error), or dead after the last attempt; ``last_error`` is added."""
    gone = F.col("attempts") + 1 >= F.col("max_attempts")
    return _changed(
        jobs, _locked(jobs, requests), "last_error",
        status=F.when(gone, "dead").otherwise("failed"),
        run_after=retry_at(as_of, F.col("attempts")),
        attempts=F.col("attempts") + 1,
        locked_at=F.lit(None),
        locked_by=F.lit(None),
        version=F.col("version") + F.when(gone, 2).otherwise(1),
    )


def reclaim_jobs(jobs: DataFrame, as_of: Column, stuck_minutes: int = 10) -> DataFrame:
    count = F.col("attempts") + 1
    gone = count >= F.col("max_attempts")
    return updated(
        jobs.where(stuck_job(as_of, stuck_minutes)),
        status=F.when(gone, "dead").otherwise("failed"),
        attempts=count,
        run_after=F.when(gone, as_of).otherwise(as_of + minutes(F.pow(F.lit(2), count - 1))),
        locked_at=F.lit(None),
        locked_by=F.lit(None),
        version=F.col("version") + 1,
    )


def update_rows(state: DataFrame, requests: DataFrame, columns: list[str]) -> DataFrame:
    """Partial updates (id, expected, columns; null leaves a value) under the version guard."""
    own = requests.withColumnsRenamed({c: f"req_{c}" for c in requests.columns if c != "id"})
    rows = state.join(own, "id").where(F.col("version") == F.col("req_expected"))
    return updated(rows, **{c: F.coalesce(f"req_{c}", c) for c in columns}, version=F.col("version") + 1).select(*state.columns)


def update_unique(state: DataFrame, requests: DataFrame, columns: list[str], unique: list[str]) -> tuple[DataFrame, DataFrame]:
    """(updated rows, rejected requests with ``reason``) where the values of ``unique`` must stay unique in the table.

    Reasons: conflict for a version that has moved on, duplicate for values that another row holds, or that a request of
    a smaller id takes first. Rows that the updates leave count as held, as they are when each is made on its own.
    """
    new = update_rows(state, requests, columns)
    held = state.select(F.col("id").alias("_other"), *[F.col(c) for c in unique])
    taken = new.join(held, unique).where("id <> _other").select("id").distinct()
    turn = F.row_number().over(Window.partitionBy(*unique).orderBy("id"))
    first = new.join(taken, "id", "left_anti").withColumn("_turn", turn).where("_turn = 1").drop("_turn")
    stale = requests.join(new.select("id"), "id", "left_anti").withColumn("reason", F.lit("conflict"))
    refused = requests.join(new.select("id").join(first.select("id"), "id", "left_anti"), "id", "left_semi").withColumn("reason", F.lit("duplicate"))
    return first, stale.unionByName(refused)


def insert_rows(new: DataFrame, defaults: dict[str, Column], keys: list[str], order: list[str], present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inserted, duplicates) of ``new`` into ``present``: columns that are absent or null take their default first."""
    filled = new.withColumns({c: F.coalesce(F.col(c), v) if c in new.columns else v for c, v in defaults.items()})
    return insert_unique(filled, keys, order, present)


# What a new row has where nothing is given.
COLLECTION_DEFAULTS = {"description": "", "max_sources": 20, "version": 1}
SOURCE_DEFAULTS = {"title": "", "status": "pending", "retry_count": 0, "metadata": "{}", "version": 1}
JOB_DEFAULTS = {"status": "pending", "attempts": 0, "max_attempts": 5, "version": 1}
USER_DEFAULTS = {"fullname": "", "activated": False, "version": 1}


def insert_collections(new: DataFrame, present: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Collections (id, user_id, title[, ...]); a title is unique among a user's."""
    return insert_rows(new, _stamped(COLLECTION_DEFAULTS, as_of), ["user_id", "title"], ["id"], present)


def insert_sources(new: DataFrame, present: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Sources (id, collection_id, url[, ...]); a URL is unique in its collection."""
    return insert_rows(new, _stamped(SOURCE_DEFAULTS, as_of), ["collection_id", "url"], ["id"], present)


def insert_users(new: DataFrame, present: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Users (id, email[, ...]); an e-mail address is unique in any case of its letters."""
    folded = lambda df: df.withColumn("_email", F.lower("email"))
    done, refused = insert_rows(folded(new), _stamped(USER_DEFAULTS, as_of), ["_email"], ["id"], folded(present))
    return done.drop("_email"), refused.drop("_email")


def insert_jobs(new: DataFrame, present: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Embedding jobs (id, source_id, source_version[, ...]); one of them may be active for a source and version."""
    active = present.where(F.col("status").isin("pending", "processing", "failed"))
    stamped = {c: F.lit(v) for c, v in JOB_DEFAULTS.items()} | {"run_after": as_of}
    return insert_rows(new, stamped, ["source_id", "source_version"], ["id"], active)


def _stamped(values: dict, as_of: Column) -> dict[str, Column]:
    return {c: F.lit(v) for c, v in values.items()} | {"created_at": as_of, "updated_at": as_of}


def apply_changes(state: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """The whole new state: changed rows in the place of the old ones of the same key."""
    return state.join(changed.select(key), key, "left_anti").unionByName(changed.select(*state.columns))


def replace_by_key(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` go, then ``new`` comes in, as one result."""
    return state.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_cascade(gone: DataFrame, tables: list[tuple[DataFrame, str]]) -> list[DataFrame]:
    """What is left of each table, where rows fall with their parent. ``gone`` has id; tables are (rows, parent key)
    in order of descent, and each one's id is the next one's parent key."""
    out, ids = [], gone.select("id").distinct()
    for rows, parent in tables:
        ids = ids.withColumnRenamed("id", parent)
        out.append(rows.join(ids, parent, "left_anti").select(*rows.columns))
        if "id" in rows.columns:
            ids = rows.join(ids, parent, "left_semi").select("id")
    return out


def delete_owned_source(sources: DataFrame, collections: DataFrame, source_id: int, user_id: int) -> DataFrame:
    """Sources without the given one, if it is in a collection of the user's."""
    owned = collections.where(F.col("user_id") == user_id).select(F.col("id").alias("collection_id"))
    hit = sources.where(F.col("id") == source_id).join(owned, "collection_id", "left_semi").select("id")
    return sources.join(hit, "id", "left_anti")


def delete_user(gone: DataFrame, users: DataFrame, tokens: DataFrame, collections: DataFrame, sources: DataFrame, chunks: DataFrame) -> list[DataFrame]:
    """What is left of users, tokens, collections, sources and chunks without the users of ``gone`` (id)."""
    ids = gone.select("id").distinct()
    left = [users.join(ids, "id", "left_anti").select(*users.columns), tokens.join(ids.withColumnRenamed("id", "user_id"), "user_id", "left_anti").select(*tokens.columns)]
    return left + delete_cascade(ids, [(collections, "user_id"), (sources, "collection_id"), (chunks, "source_id")])


def set_embeddings(chunks: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """Chunks with the vectors (id, embedding) put in; a vector of another length raises."""
    checked = vectors.select("id", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.lit("wrong vector length"))).alias("_new"))
    return chunks.join(checked, "id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")
