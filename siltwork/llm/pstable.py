"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are scaled to unit length and projected on ``tables * width`` Gaussian directions; ``floor((projection +
offset) / step)`` of a table's ``width`` directions names a bucket. Vectors of one label and length that share a
bucket in any table are compared exactly (cosine in double precision). With the defaults two vectors at cosine 0.93
share a bucket with probability 0.95, at 0.97 with 0.996; recall is measured in tests/llm.

Equal vectors are one entry with a count, and a pair is counted only in the first table in which it meets, so every
cell returns sums of links and a spanning forest rather than pairs. Buckets over ``limit`` entries are cut into even
cells.

Defined cases: rows with a null label, a null id, a null or zero vector, or a null or non-finite component link with
nothing and are their own component; vectors of unlike lengths never link; repeated rows are each other's links; an
empty table gives an empty table; extra columns don't reach the result and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import saved
from siltwork.llm.components import cells, components

TABLES, WIDTH, STEP, LIMIT = 12, 10, 2.1, 4096


def projection(size: int, tables: int, width: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([size, tables, width, 17])
    return random.standard_normal((size, tables * width)), random.uniform(0, step, tables * width)


def bucket_keys(unit: np.ndarray, tables: int = TABLES, width: int = WIDTH, step: float = STEP) -> np.ndarray:
    """A 64-bit bucket for each vector and table; unequal buckets that share a key only cost a comparison."""
    directions, offsets = projection(unit.shape[1], tables, width, step)
    places = np.floor((unit @ directions + offsets) / step).astype(np.int64).reshape(len(unit), tables, width)
    keys = np.zeros((len(unit), tables), np.uint64)
    for k in range(width):
        keys = (keys ^ places[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _hashed(tables: int, width: int, step: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            keys = np.zeros((len(sizes), tables), np.int64)
            flat, at = lists.flatten().to_numpy().astype(float), np.append(0, np.cumsum(sizes))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                vectors = flat[at[rows][:, None] + np.arange(size)]
                vectors /= np.abs(vectors).max(1, keepdims=True)
                keys[rows] = bucket_keys(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), tables, width, step)
            offsets = pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=[*batch.schema.names, "keys"])

    return run


def link_cell(nodes, counts, vectors, keys, own: np.ndarray, table: int, threshold: float):
    """(node, links first met in this table, first node of its component here) of a cell.

    ``own`` marks the first shard's rows; if both shards are present only pairs across them count.
    """
    n = len(nodes)
    unit = vectors / np.abs(vectors).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    across = own.any() and not own.all()
    links, label = np.zeros(n, np.int64), np.arange(n)
    for start in range(0, n, 256):
        rows = np.arange(start, min(n, start + 256))
        near = unit[rows] @ unit.T >= threshold
        near &= rows[:, None] < np.arange(n)
        if across:
            near &= own[rows][:, None] != own
        x, y = np.nonzero(near)
        x += start
        first = np.empty(len(x), bool)
        for at in range(0, len(x), 1 << 17):
            part = slice(at, at + (1 << 17))
            first[part] = (keys[x[part]] == keys[y[part]]).argmax(1) == table
        x, y = x[first], y[first]
        np.add.at(links, x, counts[y])
        np.add.at(links, y, counts[x])
        for a, b in zip(*np.unique(np.stack([label[x], label[y]]), axis=1)):
            a, b = label[a], label[b]
            if a != b:
                label[label == max(a, b)] = min(a, b)
    return nodes, links, nodes[label]


def _linker(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "size", "place", "key", "cell_i", "cell_j"]
        key, held = None, []

        def close():
            rows = pa.Table.from_batches(held).combine_chunks()
            size = rows.column("size")[0].as_py()
            nodes = rows.column("node").to_numpy()
            if len(nodes) < 2:
                return None
            own = rows.column("shard").to_numpy() == rows.column("cell_i")[0].as_py()
            vectors = rows.column("embedding").combine_chunks().flatten().to_numpy().astype(float).reshape(-1, size)
            keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
            found = link_cell(nodes, rows.column("n").to_numpy(), vectors, keys, own, rows.column("place")[0].as_py(), threshold)
            some = found[1] > 0
            return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in found], names=["node", "links", "root"]) if some.any() else None

        for batch in batches:
            columns = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
            ends = [*(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            start = 0
            for end in ends:
                now = tuple(columns[:, start])
                if now != key and held:
                    if (out := close()) is not None:
                        yield out
                    held = []
                key = now
                held.append(batch.slice(start, end - start))
                start = end
        if held and (out := close()) is not None:
            yield out

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.93, tables: int = TABLES, width: int = WIDTH, step: float = STEP, limit: int = LIMIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    rows = rows.select("vec_id", "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    able = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    mixed = F.xxhash64("embedding")
    valid = rows.where(able).withColumn("mixed", mixed)
    entries = valid.groupBy("label", "mixed", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"))
    entries = saved(entries, "pstable-entries")
    hashed = entries.select("node", "n", F.col("label").cast("long").alias("label"), F.size("embedding").alias("size"), "embedding")
    schema = "node long, n long, label long, size int, embedding array<" + rows.schema["embedding"].dataType.elementType.simpleString() + ">, keys array<long>"
    hashed = saved(hashed.mapInArrow(_hashed(tables, width, step), schema), "pstable-keys")
    buckets = hashed.select("*", F.posexplode("keys").alias("place", "key"))
    met = cells(buckets, ["label", "size", "place", "key"], F.col("node"), limit, "pstable-hot")
    met = met.select("label", "size", "place", "key", "cell_i", "cell_j", "shard", "node", "n", "embedding", "keys")
    found = saved(met.mapInArrow(_linker(threshold), "node long, links long, root long"), "pstable-links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "pstable-roots")
    named = entries.join(sums, "node", "left").join(roots, "node", "left")
    named = named.select("label", "mixed", "embedding", F.coalesce("root", "node").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    named = saved(named, "pstable-named")
    keyed = rows.withColumn("mixed", F.when(able, mixed))
    out = keyed.join(named, ["label", "mixed", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
