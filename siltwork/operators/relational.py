"""Listings, counts, summaries and the predicates of the two work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions.expr import MAX_RETRIES, SOURCE_STATUSES, matches_keywords

COLLECTION_SORTS = ("id", "title", "created_at")
SOURCE_SORTS = ("id", "created_at", "updated_at", "status")


def sort_columns(sort: str, allowed: tuple[str, ...]) -> list[Column]:
    """Order of a listing: an allowed column, descending after ``-``, then the id; others raise ``ValueError``."""
    name = sort.removeprefix("-")
    if name not in allowed:
        raise ValueError(f"unsafe sort: {sort}")
    own = F.col(name).desc_nulls_last() if sort.startswith("-") else F.col(name).asc_nulls_last()
    return [own, F.col("id").asc()]


def page(rows: DataFrame, number: int, size: int, sort: str, allowed: tuple[str, ...]) -> DataFrame:
    """One page of a listing. Spark keeps only the first ``number * size`` rows of each task."""
    return rows.orderBy(*sort_columns(sort, allowed)).offset((number - 1) * size).limit(size)


def page_metadata(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One row of totals; zeros if the page is past the end, as such a page carries no total."""
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("n") > (number - 1) * size
    value = lambda c: F.when(seen, c).otherwise(F.lit(0)).cast("long")
    return total.select(
        value(F.lit(number)).alias("current_page"),
        value(F.lit(size)).alias("page_size"),
        value(F.lit(1)).alias("first_page"),
        value(F.expr(f"(n + {size} - 1) div {size}")).alias("last_page"),
        value(F.col("n")).alias("total_records"),
    )


def collections_of(collections: DataFrame, user_id: int | None = None, keywords: str = "") -> DataFrame:
    """A user's collections whose title has all keywords; an empty query is no filter."""
    rows = collections if user_id is None else collections.where(F.col("user_id") == user_id)
    return rows.where(matches_keywords(F.col("title"), F.lit(keywords))) if keywords else rows


def sources_of(sources: DataFrame, collections: DataFrame, user_id: int, collection_id: int | None = None, status: str = "") -> DataFrame:
    """Sources in a user's own collections, of one collection or status if given."""
    owned = collections.where(F.col("user_id") == user_id).select(F.col("id").alias("collection_id"))
    rows = sources.join(owned, "collection_id", "left_semi")
    if collection_id is not None:
        rows = rows.where(F.col("collection_id") == collection_id)
    return rows.where(F.col("status") == status) if status else rows


def claimable_source(as_of: Column, retry_cap: bool = True) -> Column:
    """Pending or failed, with retries left, and due. Monitoring counts it without the cap on retries."""
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of)
    left = F.col("retry_count").isNull() | (F.col("retry_count") < MAX_RETRIES)
    waiting = F.col("status").isin("pending", "failed") & due
    return waiting & left if retry_cap else waiting


def claimable_job(as_of: Column) -> Column:
    return F.col("status").isin("pending", "failed") & (F.col("attempts") < F.col("max_attempts")) & (F.col("run_after") <= as_of)


def stuck_source(as_of: Column, minutes: int = 10) -> Column:
    return (F.col("status") == "ingesting") & (F.col("updated_at") < as_of - F.expr(f"interval {minutes} minutes"))


def stuck_job(as_of: Column, minutes: int = 10) -> Column:
    return (F.col("status") == "processing") & F.col("locked_at").isNotNull() & (F.col("locked_at") < as_of - F.expr(f"interval {minutes} minutes"))


def status_summary(sources: DataFrame, collection_id: int) -> DataFrame:
    """(status, n) of a collection with a row for every status, zero where it has none."""
    own = sources.where(F.col("collection_id") == collection_id).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    listed = sources.sparkSession.createDataFrame([(s,) for s in SOURCE_STATUSES], "status string")
    return listed.join(own, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def count_where(rows: DataFrame, test: Column, name: str = "n") -> DataFrame:
    return rows.agg(F.count_if(test).alias(name))


def oldest_claimable_age(sources: DataFrame, as_of: Column, born: str) -> DataFrame:
    """Whole seconds since the oldest claimable source was made, 0 if none waits."""
    waiting = sources.where(claimable_source(as_of, retry_cap=False)).agg(F.min(born).alias("oldest"))
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("oldest").cast("timestamp"))
    return waiting.select(F.coalesce(age, F.lit(0)).cast("long").alias("age_seconds"))


def embedding_coverage(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("total"), F.count_if("embedded").alias("embedded"), F.count_if(~F.col("embedded")).alias("missing"))


def shares(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, percent) with two decimals."""
    counted = counts_by(rows, column)
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(total).select(column, "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("percent"))


def recent(rows: DataFrame, n: int = 50) -> DataFrame:
    return rows.orderBy(F.col("updated_at").desc_nulls_last(), F.col("id")).limit(n)


def capacity(collections: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, n_sources, max_sources, full). Sources are counted before the join, so a large collection costs nothing."""
    counted = sources.groupBy(F.col("collection_id").alias("id")).agg(F.count(F.lit(1)).alias("n_sources"))
    n = F.coalesce("n_sources", F.lit(0)).cast("long")
    return collections.select("id", "max_sources").join(counted, "id", "left").select("id", n.alias("n_sources"), "max_sources", (n >= F.col("max_sources")).alias("full"))


def token_owners(tokens: DataFrame, users: DataFrame, as_of: Column, scope: str) -> DataFrame:
    """Users of tokens (hash, user_id, expiry, scope) that hold for a scope at ``as_of``."""
    live = tokens.where((F.col("scope") == scope) & (F.col("expiry") > as_of))
    return live.join(users, live["user_id"] == users["id"]).select(users["id"].alias("user_id"), "email", "activated", "hash")


def run_verdict(completed: Column, failed: Column, total: Column) -> Column:
    return F.when(completed == total, "success").when((completed > 0) & (completed + failed <= total), "partial").otherwise("failed")


def dominant_type(counts: DataFrame, by: str, ranks: dict[str, int]) -> DataFrame:
    """(by, dominant, types) from (by, type, n): most frequent type, ties by rank; and all types in order of rank."""
    rank = F.coalesce(*[F.when(F.col("type") == t, r) for t, r in ranks.items()])
    grouped = counts.groupBy(by).agg(
        F.max_by("type", F.struct(F.col("n"), (-rank).alias("r"))).alias("dominant"),
        F.array_sort(F.collect_set(F.struct(rank.alias("r"), F.col("type").alias("t")))).alias("all"),
    )
    return grouped.select(by, "dominant", F.array_join(F.transform("all", lambda x: x["t"]), ",").alias("types"))


def request_metrics(log: DataFrame, code: str, micros: Column) -> DataFrame:
    """(code, requests, total_us) of a request log."""
    return log.groupBy(code).agg(F.count(F.lit(1)).alias("requests"), F.sum(micros).cast("long").alias("total_us"))
