"""Approximate vector search: an inverted file of cells around centres, with exact distances in the probed cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.operators.search import _matrix, search_many


def centres(vectors: DataFrame, n: int, sample: int = 20_000, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centres by k-means on about ``sample`` vectors (a documented bound), chosen by the hash of their id."""
    total = vectors.count()
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = vectors.where(F.col("embedding").isNotNull() & (place < F.lit(sample / max(total, 1)))).orderBy("id").select("embedding").limit(2 * sample).toArrow()
    lists = rows.column(0).combine_chunks()
    x = _matrix(lists, pc.max(pc.list_value_length(lists)).as_py() or 0)
    x = x[~np.isnan(x).any(1)]
    c = x[np.random.default_rng(seed).permutation(len(x))[:n]]
    for _ in range(rounds if len(c) else 0):
        own = (x @ c.T).argmax(1)
        for k in range(len(c)):
            if (own == k).any():
                m = x[own == k].sum(0)
                c[k] = m / max(np.linalg.norm(m), 1e-12)
    return c


def assign(vectors: DataFrame, c: np.ndarray, probes: int = 1) -> DataFrame:
    """The rows with ``cell``: their nearest centre, or for queries one row for each of the nearest ``probes``.

    A vector without a direction goes to the first cell.
    """
    names = vectors.columns
    at = names.index("embedding") if "embedding" in names else names.index("query")
    kind = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.argsort(-(_matrix(b.column(at), c.shape[1]) @ c.T), axis=1, kind="stable")[:, :probes]
            rows = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            taken = b.take(rows)
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(near.ravel().astype(np.int32))], names=[*names, "cell"])

    return vectors.mapInArrow(run, kind)


def search(index: DataFrame, queries: DataFrame, c: np.ndarray, k: int, probes: int) -> DataFrame:
    """(query_id, chunk_id, distance, rank): a block of queries is multiplied with the rows of the cells it probes only.

    Memory and ranks are those of ``search_many``: k rows a query leave a task, and no pair is a row.
    """
    near = search_many(index, queries, k, probed=lambda q: np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes])
    return near.select("query_id", "chunk_id", "distance", "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: share of the exact neighbours that were found."""
    hits = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n_neighbours"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
