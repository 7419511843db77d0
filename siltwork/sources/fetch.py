"""Fetching pages through an injected callable, logs, and sinks."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import markup
from siltwork.functions.expr import RETRYABLE_FETCH

ATTEMPTS, ATTEMPT_S, TOTAL_S, MAX_BODY = 3, 15.0, 90.0, 10 << 20


@dataclass
class Response:
    status: int
    content_type: str
    body: bytes
    url: str
    retry_after_s: float = 0.0


class FetchError(Exception):
    def __init__(self, status: int, message: str, retry_after_s: float = 0.0):
        super().__init__(message)
        self.status, self.retry_after_s = status, retry_after_s


def check(r: Response) -> tuple[str, str, str]:
    """(title, text, html) of a good response's article, else ``FetchError`` with the code of what is wrong."""
    if r.status != 200:
        raise FetchError(r.status, f"status {r.status}", r.retry_after_s)
    kind = r.content_type.lower()
    if kind and "text/html" not in kind and "application/xhtml+xml" not in kind:
        raise FetchError(415, f"content type {r.content_type}")
    if len(r.body) > MAX_BODY:
        raise FetchError(413, "the body is too large")
    if not r.body:
        raise FetchError(204, "the body is empty")
    html = r.body.decode("utf-8", "replace")
    try:
        text = markup.article(markup.parse(html)).text()
    except (RecursionError, ValueError) as e:
        raise FetchError(502, f"the article could not be extracted: {e}") from e
    if not text.strip():
        raise FetchError(422, "the page has no article")
    return markup.title_of(html), text, html


def backoff_s(attempt: int, jitter: Callable[[], float] = random.random) -> float:
    return min(0.5 * 2 ** (attempt - 1), 5.0) + jitter() * 0.5


def fetch(url: str, get: Callable[[str, float], Response], sleep=time.sleep, clock=time.monotonic, jitter=random.random) -> tuple[str, str, str]:
    """Up to three attempts within the total time; the server's Retry-After goes before our own delay."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise FetchError(400, "not an http or https URL")
    began = clock()
    for attempt in range(1, ATTEMPTS + 1):
        try:
            try:
                return check(get(url, ATTEMPT_S))
            except TimeoutError:
                raise FetchError(408, "the attempt took too long") from None
            except OSError as e:
                raise FetchError(503, str(e)) from e
        except FetchError as e:
            wait = e.retry_after_s or backoff_s(attempt, jitter)
            if e.status not in RETRYABLE_FETCH or attempt == ATTEMPTS or clock() - began + wait > TOTAL_S:
                raise
            sleep(wait)
    raise AssertionError


def cleaned_methods(spark: SparkSession, path: str) -> DataFrame:
    """(method, n, percent) of "pipeline: cleaned" lines in key=value logs."""
    lines = spark.read.text(path).where(F.col("value").contains("pipeline: cleaned"))
    method = F.regexp_extract("value", r"\bmethod=([^\s]+)", 1)
    counted = lines.select(F.trim(method, F.lit('"')).alias("method")).where("method <> ''").groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(counted.agg(F.sum("n").alias("t"))).select("method", "n", F.round(100 * F.col("n") / F.col("t"), 2).alias("percent"))


def fetch_pages(sources: DataFrame, get: Callable[[], Callable[[str, float], Response]]) -> DataFrame:
    """(id, url, title, text, html, error, message) of sources (id, url): pages fetched in the tasks, a narrow pass.

    ``get`` makes a task's client. ``error`` is 0, or the code of what went wrong, with its message.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = get()
        for batch in batches:
            for key, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = {"id": key, "url": url, "title": None, "text": None, "html": None, "error": 0, "message": None}
                try:
                    row["title"], row["text"], row["html"] = fetch(url or "", client)
                except FetchError as e:
                    row["error"], row["message"] = e.status, str(e)
                yield pa.RecordBatch.from_pylist([row], schema=_PAGE)

    return sources.select(F.col("id").cast("long").alias("id"), "url").mapInArrow(run, "id long, url string, title string, text string, html string, error int, message string")


_PAGE = pa.schema([("id", pa.int64()), *[(c, pa.string()) for c in ("url", "title", "text", "html")], ("error", pa.int32()), ("message", pa.string())])
BUCKETS = 64


def write_chunks(chunks: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Replace the chunks of the sources in ``chunks`` in the Parquet table at ``path``; all other sources keep theirs.

    The table is cut into buckets of sources. A touched bucket's other rows are read, put together with the new ones in a
    staging folder beside the table, and the bucket is written over from there; buckets that aren't touched stay.
    """
    spark = chunks.sparkSession
    files, target = _hadoop(spark, path)
    bucketed = chunks.withColumn("bucket", F.pmod(F.xxhash64("source_id"), F.lit(BUCKETS)).cast("int"))
    merged = bucketed
    if files.exists(target) and list(files.listStatus(target)):
        touched = [r.bucket for r in bucketed.select("bucket").distinct().collect()]  # BUCKETS values at most
        held = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        merged = held.join(chunks.select("source_id").distinct(), "source_id", "left_anti").unionByName(bucketed)
    staging = f"{path.rstrip('/')}-staging-{uuid.uuid4().hex}"
    merged.write.parquet(staging)
    rows = spark.read.schema(merged.schema).parquet(staging).repartition("bucket")
    rows.write.option("maxRecordsPerFile", rows_per_file).partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    files.delete(_hadoop(spark, staging)[1], True)


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def write_polls(polls: DataFrame, path: str) -> None:
    """``poll_counts`` as CSV with a header, in order of time."""
    poll_counts(polls).orderBy("timestamp").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def notices(spark: SparkSession, path: str, column: str = "value") -> DataFrame:
    """A notify source: files that land in ``path`` as a stream, one row a line, that wakes a queue's rounds."""
    return spark.readStream.text(path).withColumnRenamed("value", column)


def poll_counts(polls: DataFrame) -> DataFrame:
    """One row a poll: total and the five statuses, for a CSV of a run's progress."""
    from siltwork.functions.expr import SOURCE_STATUSES

    counts = [F.count_if(F.col("status") == s).alias(s) for s in SOURCE_STATUSES]
    return polls.groupBy("timestamp", "elapsed_s").agg(F.count(F.lit(1)).alias("total"), *counts)
