"""The work queues as streams: event folds with version checks, claims, reclaims, and a rate limiter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltwork.operators.mutations import apply_changes, claim_jobs, complete_jobs, fail_jobs, reclaim_jobs
from siltwork.operators.relational import claimable_job

FOLD = "source_id long, applied long, stale long, version int"


def fold_versions(events: DataFrame) -> DataFrame:
    """Per source, how many transitions (source_id, seq, expected) apply and how many come too late.

    A transition applies if it expects the version that the ones before it have left; versions begin at 1. Runs on a
    stream (state per source) and, by the same fold, on a table.
    """

    def step(version: int, expected: list[int]) -> tuple[int, int]:
        applied = 0
        for e in expected:
            if e == version + applied:
                applied += 1
        return applied, len(expected) - applied

    def on_stream(key, batches: Iterator[pd.DataFrame], state: GroupState):
        applied, stale, version = state.get if state.exists else (0, 0, 1)
        rows = pd.concat(list(batches)).sort_values("seq")
        more, late = step(version, rows["expected"].tolist())
        applied, stale, version = applied + more, stale + late, version + more
        state.update((applied, stale, version))
        yield pd.DataFrame({"source_id": [key[0]], "applied": [applied], "stale": [stale], "version": [version]})

    def on_table(key, rows: pd.DataFrame) -> pd.DataFrame:
        more, late = step(1, rows.sort_values("seq")["expected"].tolist())
        return pd.DataFrame({"source_id": [key[0]], "applied": [more], "stale": [late], "version": [1 + more]})

    grouped = events.groupBy("source_id")
    if events.isStreaming:
        return grouped.applyInPandasWithState(on_stream, FOLD, "applied long, stale long, version int", "update", GroupStateTimeout.NoTimeout)
    return grouped.applyInPandas(on_table, FOLD)


class QueueState:
    """A job queue in a shared folder: the whole state after each micro-batch, under ``state/batch=n``.

    A batch reads the last state before its own number and writes its own, so a batch that runs again after a failure
    starts from the same rows and overwrites what it left. Only states with Spark's mark of success count. The last
    ``keep`` states stay.
    """

    def __init__(self, path: str, keep: int = 3):
        self.path, self.keep = path.rstrip("/"), keep

    def _folder(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path

    def batches(self, spark: SparkSession) -> list[int]:
        """Numbers of the committed states."""
        files, root = self._folder(spark, f"{self.path}/state")
        if not files.exists(root):
            return []
        names = [s.getPath().getName() for s in files.listStatus(root)]
        return sorted(int(n.split("=")[1]) for n in names if files.exists(self._folder(spark, f"{self.path}/state/{n}/_SUCCESS")[1]))

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        found = [n for n in self.batches(spark) if before is None or n < before]
        return spark.read.parquet(f"{self.path}/state/batch={found[-1]}") if found else None

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/state/batch={batch}")
        spark = rows.sparkSession
        for n in self.batches(spark):
            if n <= batch - self.keep:
                files, old = self._folder(spark, f"{self.path}/state/batch={n}")
                files.delete(old, True)


def work_batch(state: QueueState, as_of: Column, n: int, worker: str, process: Callable[[DataFrame], DataFrame] | None = None, reclaim: bool = True):
    """A foreachBatch sink: each micro-batch of new jobs wakes one round of reclaim, claim, process and acknowledge.

    Arrivals join the stored state (ids that it has already are left out), jobs that got stuck are set free, and of all
    that are due then, old and new, ``worker`` claims the first ``n``; what is over ``n`` waits for the next round.
    ``process`` takes the claimed rows and returns (id, error), null for success; without it jobs stay claimed.
    Claims are written to ``claims/batch=n`` before they are worked on.
    """

    def sink(arrivals: DataFrame, batch: int) -> None:
        spark = arrivals.sparkSession
        before = state.read(spark, batch)
        jobs = arrivals.withColumn("last_error", F.lit(None).cast("string"))
        if before is not None:
            jobs = before.unionByName(jobs.join(before.select("id"), "id", "left_anti"))
        if reclaim:
            jobs = reclaim_all(jobs, as_of)
        where = f"{state.path}/claims/batch={batch}"
        if n > 0:
            claim_jobs(jobs, as_of, n, worker).write.mode("overwrite").parquet(where)
            claimed = spark.read.parquet(where)
            jobs = apply_changes(jobs, claimed)
            if process is not None:
                process(claimed).write.mode("overwrite").parquet(f"{state.path}/results/batch={batch}")
                requests = spark.read.parquet(f"{state.path}/results/batch={batch}").join(claimed.select("id", F.col("version").alias("expected")), "id").withColumn("worker", F.lit(worker))
                done, failed = requests.where("error is null").drop("error"), requests.where("error is not null")
                jobs = apply_changes(jobs, complete_jobs(jobs, done).unionByName(fail_jobs(jobs, failed, as_of)))
        state.write(jobs, batch)

    return sink


def drain(stream: DataFrame, state: QueueState, as_of: Column, n: int, worker: str, process: Callable[[DataFrame], DataFrame] | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream of arrivals to its end, then rounds without arrivals until nothing is due; the last state."""
    spark = stream.sparkSession
    sink = work_batch(state, as_of, n, worker, process)
    writer = stream.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{state.path}/checkpoint")
    writer.start().awaitTermination()
    while n > 0:
        jobs, last = state.read(spark), state.batches(spark)
        if jobs is None or jobs.where(claimable_job(as_of)).isEmpty():
            break
        sink(jobs.drop("last_error").limit(0), last[-1] + 1)
    return state.read(spark)


#: Steps of a source in order, and the version at which each begins: every step is one change.
ORDER = {"fetch": 0, "clean": 1, "chunk": 2, "store": 3, "embed": 4}


def fold_steps(events: DataFrame) -> DataFrame:
    """(source_id, status, current_step, version, refused) from (source_id, seq, expected, status, step) in order of seq.

    Sources begin as pending at version 1. A change applies if it expects the version that stands, the source is not
    finished (completed or stale), and a step comes in its order: claiming moves pending or failed to ingesting at
    fetch, ingesting goes on to the next step or stays at its step, and any ingesting source may complete after embed,
    fail or go stale. Others are refused.
    """
    entry = F.struct("seq", "expected", "status", "step")
    lists = events.groupBy("source_id").agg(F.array_sort(F.collect_list(entry)).alias("events"))
    place = lambda c: F.coalesce(*[F.when(c == s, F.lit(n)) for s, n in ORDER.items()], F.lit(-1))
    start = F.struct(F.lit("pending").alias("status"), F.lit(None).cast("string").alias("step"), F.lit(1).alias("version"), F.lit(0).alias("refused"))

    def change(a: Column, x: Column) -> Column:
        claim = a["status"].isin("pending", "failed") & (x["status"] == "ingesting") & (x["step"] == "fetch")
        onward = (a["status"] == "ingesting") & (x["status"] == "ingesting") & place(x["step"]).between(place(a["step"]), place(a["step"]) + 1)
        end = (a["status"] == "ingesting") & (x["status"].isin("failed", "stale") | ((x["status"] == "completed") & (a["step"] == "embed")))
        good = F.coalesce((x["expected"] == a["version"]) & (claim | onward | end), F.lit(False))
        return F.struct(
            F.when(good, x["status"]).otherwise(a["status"]).alias("status"), F.when(good, F.coalesce(x["step"], a["step"])).otherwise(a["step"]).alias("step"),
            (a["version"] + good.cast("int")).alias("version"), (a["refused"] + (~good).cast("int")).alias("refused"),
        )

    folded = lists.select("source_id", F.aggregate("events", start, change).alias("s"))
    return folded.select("source_id", F.col("s.status").alias("status"), F.col("s.step").alias("current_step"), F.col("s.version").alias("version"), F.col("s.refused").alias("refused"))


def reclaim_all(jobs: DataFrame, as_of: Column) -> DataFrame:
    """The table after one round of the reclaim loop."""
    return apply_changes(jobs, reclaim_jobs(jobs, as_of))


def allowed_requests(requests: DataFrame, rate: float = 2.0, burst: int = 4, idle_s: float = 180.0) -> DataFrame:
    """(key, allowed, refused) of a token bucket a key over (key, at_s): refilled at ``rate``, dropped when idle."""

    def fold(key, rows: pd.DataFrame) -> pd.DataFrame:
        tokens, last, allowed = float(burst), None, 0
        times = rows["at_s"].sort_values().tolist()
        for t in times:
            if last is not None:
                tokens = float(burst) if t - last > idle_s else min(float(burst), tokens + (t - last) * rate)
            last = t
            if tokens >= 1:
                tokens -= 1
                allowed += 1
        return pd.DataFrame({"key": [key[0]], "allowed": [allowed], "refused": [len(times) - allowed]})

    return requests.groupBy("key").applyInPandas(fold, "key long, allowed long, refused long")


def arrivals_per_window(events: DataFrame, width: str = "1 day") -> DataFrame:
    """An extension over the queues: event-time counts with a watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", "1 hour").groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def next_waits(found: list[bool], base_s: float, most_s: float) -> list[float]:
    """A worker's waits after a row of polls: the base after work, else doubled up to the maximum."""
    out, wait = [], base_s
    for hit in found:
        wait = base_s if hit else (min(2 * wait, most_s) if wait > 0 else most_s)
        out.append(wait)
    return out


def due_order(jobs: DataFrame) -> DataFrame:
    """Jobs numbered in the order in which workers would take them, per source."""
    return jobs.withColumn("turn", F.row_number().over(Window.partitionBy("source_id").orderBy("run_after", "id")))
