"""Embedding jobs over whole tables: load chunks, embed, store vectors, finish sources and jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions.embedding import EmbedFn
from siltwork.operators.documents import embed_by_source
from siltwork.operators.mutations import advance_step, apply_changes, complete_jobs, fail_jobs, set_embeddings


@dataclass
class Outcome:
    """New states after a round of jobs, and one row a job: id, source_id, n_chunks, error (null: done)."""

    jobs: DataFrame
    sources: DataFrame
    chunks: DataFrame
    results: DataFrame


def embed_claimed(
    claimed: DataFrame, jobs: DataFrame, sources: DataFrame, chunks: DataFrame, embed: Callable[[], EmbedFn], dimension: int, worker: str, as_of: Column, save: Callable[[DataFrame], DataFrame] = lambda df: df
) -> Outcome:
    """Work on ``claimed`` jobs (rows of ``jobs`` as claimed by ``worker``).

    A job without chunks, or one of whose chunks cannot be embedded, fails and leaves no vectors. A source whose version
    has moved on keeps its status and its job is still finished, as the vectors are stored. ``chunks`` has id, source_id,
    content and embedding. ``save`` writes the model's results once, so that the model isn't called again for each
    state that is read; the model runs in one narrow pass over the chunks of claimed sources.
    """
    own = claimed.select(F.col("id").alias("job_id"), "source_id", "source_version", F.col("version").alias("expected"))
    wanted = chunks.join(own.select("source_id").distinct(), "source_id", "left_semi")
    made = save(embed_by_source(wanted, embed, dimension))
    per = made.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("error").alias("failure"))
    missing = F.concat(F.lit("no chunks found for source "), F.col("source_id").cast("string"))
    cause = F.when(F.col("n_chunks").isNull(), missing).otherwise(F.concat(F.lit("embedding chunks for source "), F.col("source_id").cast("string"), F.lit(": "), F.col("failure")))
    judged = own.join(per, "source_id", "left").withColumn("error", cause)
    good = judged.where("error is null")
    requests = judged.select(F.col("job_id").alias("id"), "expected", F.lit(worker).alias("worker"), "error")
    done, failed = complete_jobs(jobs, requests.where("error is null").drop("error")), fail_jobs(jobs, requests.where("error is not null"), as_of)
    steps = good.select(F.col("source_id").alias("id"), F.col("source_version").alias("expected"), F.lit("completed").alias("status"), F.lit("embed").alias("step")).distinct()
    vectors = made.join(good.select("source_id").distinct(), "source_id", "left_semi").select("id", "embedding")
    new_jobs = apply_changes(jobs.withColumn("last_error", F.lit(None).cast("string")), done.withColumn("last_error", F.lit(None).cast("string")).unionByName(failed))
    results = judged.select(F.col("job_id").alias("id"), "source_id", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), "error")
    return Outcome(new_jobs, apply_changes(sources, advance_step(sources, steps)), set_embeddings(chunks, vectors, dimension), results)
