"""Near-duplicates by the Jaccard similarity of word shingles: SimHash groups and min-hash bands as candidates, then an exact check.

Two texts link if their sets of ``words``-word shingles have a Jaccard similarity of ``SIMILAR`` (0.8) or more. At 0.8 two
fingerprints of 64 bits differ in about 10 bits and at times in 17, where no cut of the bits keeps buckets apart; so
the BK-trees of the SimHash operator only propose the closest copies, and ``BANDS`` bands of ``ROWS`` min-hashes propose the
rest. A pair at 0.8 shares a band with probability 1 - (1 - 0.8^6)^32 = 0.99994, closer pairs more surely. No pair links
unchecked: every link is counted over both whole sets in integers.

Rounds: SimHash groups and each band's bucket against their first member; then, in buckets whose other members aren't one
component by then, every member outside the largest component against all others, in shards of at most about ``BUDGET``
shingles and over an index of them, so nothing that shares a band stays unchecked. Buckets of the same members count
once.
Sets of shingles are made again from the texts that share a band or a group, and only for those, so that they are
never written for all documents.

Defined cases: as in ``simhash``; fewer words than a shingle make one shingle, texts without words have the empty set and
are equal; texts with equal sets are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch, saved, slices
from siltwork.llm.components import components, joined, open_buckets
from siltwork.llm.rows import Sieve, keep_firsts, rows_of
from siltwork.llm.simhash import near_groups

BANDS, ROWS = 32, 6
BUDGET = 4 << 20  # shingles of a shard, 32 MB
_R = np.random.Generator(np.random.PCG64(42))
_XOR = _R.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _R.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """XXH64 (seed 42) of every shingle in order, repeats included."""
    parts = (text or "").encode().lower().split()
    size = min(words, len(parts))
    joined, at, spans = b" ".join(parts), 0, []
    for p in parts:
        spans.append((at, at + len(p)))
        at += len(p) + 1
    digest = xxhash.xxh64_intdigest
    n = len(parts) - size + 1 if parts else 0
    return np.fromiter((digest(joined[spans[k][0] : spans[k + size - 1][1]], 42) for k in range(n)), np.uint64, n)


def sketch(text: str | None, words: int = 5) -> tuple[int, np.ndarray, list[int]]:
    """(SimHash, sorted distinct shingle hashes, keys of the bands)."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0, hashes, []
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    fp = int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])
    distinct = np.unique(hashes)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(distinct), 1024):
        part = distinct[at : at + 1024]
        least = np.minimum(least, ((part[:, None] ^ _XOR) * _ODD).min(0))
    mins = least.astype("<u8").reshape(BANDS, ROWS)
    return fp, distinct, [xxhash.xxh64_intdigest(mins[k].tobytes(), k) for k in range(BANDS)]


def _longs(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(rows: list) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate(rows) if rows else []))


def sketches(docs: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """(id, salt, fp, entry, size, bands) of every row; salt is the text's hash and entry a hash of its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                made = []
                for text in part.column(1):
                    fp, distinct, bands = sketch(text.as_py(), words)
                    made.append((fp, xxhash.xxh64_intdigest(distinct.astype("<u8").tobytes(), 7), len(distinct), np.array(bands, np.uint64)))
                fps, entries, sizes, bands = zip(*made)
                columns = [part.column(0), part.column(2), _longs(fps), _longs(entries), pa.array(sizes, pa.int32()), _lists(list(bands))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "salt", "fp", "entry", "size", "bands"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.xxhash64(F.col(text_column)).alias("salt"))
    return rows.mapInArrow(run, f"id {kind}, salt long, fp long, entry long, size int, bands array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(entry, size, shingles) of every row of (entry, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):  # a set takes more room than its text
                sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int32()), _lists(sets)], names=["entry", "size", "shingles"])

    return texts.mapInArrow(run, "entry long, size int, shingles array<long>")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shared shingles are 4/5 or more of all their shingles: 9 shared >= 4 (size a + size b)."""
    a = sets.select(F.col("entry").alias("a"), F.col("size").alias("m"), F.col("shingles").alias("x"))
    b = sets.select(F.col("entry").alias("b"), F.col("size").alias("n"), F.col("shingles").alias("y"))
    both = pairs.join(a, "a").join(b, "b")
    return both.where("5 * least(m, n) >= 4 * greatest(m, n)").where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.col("m") + F.col("n"))).select("a", "b")


class Shard:
    """An index of the sets of a shard's members, against which sets are counted one by one."""

    def __init__(self, entries: list[int], roots: list[int], sets: list[np.ndarray]):
        self.entries, self.sizes = entries, np.array([len(x) for x in sets])
        self.top: dict[int, int] = {}
        self.roots = np.array(roots, np.int64)
        whole = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        order = np.argsort(whole, kind="stable")
        self.values, self.owner = whole[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def root(self, name: int) -> int:
        while (up := self.top.get(name, name)) != name:
            name = up
        return name

    def links(self, entry: int, root: int, mine: np.ndarray) -> Iterator[tuple[int, int]]:
        """(entry, member) for members of components that the set joins."""
        mine = np.sort(mine)
        low, high = np.searchsorted(self.values, mine), np.searchsorted(self.values, mine, "right")
        hit = np.flatnonzero(high > low)
        met = np.concatenate([self.owner[low[k] : high[k]] for k in hit]) if len(hit) else np.zeros(0, np.int64)
        counts = np.bincount(met, minlength=len(self.sizes)) if len(mine) else (self.sizes == 0) * 1
        similar = np.flatnonzero((9 * counts >= 4 * (self.sizes + len(mine))) & (self.roots != root))
        for name, k in zip(*np.unique(self.roots[similar], return_index=True)):
            a, b = self.root(int(name)), self.root(root)
            if a != b:
                self.top[max(a, b)] = min(a, b)
                yield entry, self.entries[similar[k]]


def _linker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (key, shard) of rows in order of role: 0 for the index's members, 1 for the sets to count against it."""
    now, held, shard, found = None, ([], [], []), None, []

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
        found.clear()
        return out

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("key", "shard", "role", "member", "root")]
        lists = batch.column("shingles")
        for n, (*key, role, entry, root) in enumerate(zip(*columns)):
            if key != now:
                now, held, shard = key, ([], [], []), None
                if len(found) > 50_000:
                    yield flush()
            values = lists[n].values.to_numpy()
            if role == 0:
                for place, x in zip(held, (entry, root, values.copy())):
                    place.append(x)
            else:
                if shard is None:
                    shard, held = Shard(*held), ([], [], [])
                found.extend(shard.links(entry, root, values))
    yield flush()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_sets(docs: DataFrame, rows: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """(entry, component, root) of every distinct set of ``rows`` (``sketches`` of ``docs``); component is the smallest id reachable."""
    with Scratch() as held:
        named = F.struct(F.col("id").isNull().alias("null"), "id", "salt")
        entries = rows.groupBy("entry").agg(F.min("id").alias("least"), F.min(named).alias("of"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("bands").alias("bands"))
        entries = held.saved(entries, "jaccard-entries")

        keyed = entries.select("entry", "size", F.explode("bands").alias("key"))
        mixed = F.xxhash64("entry")
        buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("entry").alias("first"), F.bit_xor(mixed).alias("x"), F.sum(F.pmod(mixed, F.lit(1 << 31))).alias("y")).where("n > 1")
        buckets = held.saved(buckets.groupBy("n", "first", "x", "y").agg(F.min("key").alias("key")).select("key", "first"), "jaccard-buckets")
        keyed = Sieve(buckets.select(F.col("key").alias("salt"))).rows(keyed, "key", True)
        shared = held.saved(keyed.join(buckets, "key"), "jaccard-shared")
        groups = near_groups(entries.select(F.col("entry").alias("id"), "fp"))
        close = entries.join(groups, "fp").select(F.col("entry").alias("a"), F.col("component").alias("b"))
        met = shared.select(F.col("entry").alias("a"), F.col("first").alias("b"))
        tried = held.saved(_ordered(close.union(met)), "jaccard-pairs")
        asked = shared.select("entry").union(tried.select("a")).union(tried.select("b")).distinct()
        asked = held.saved(entries.join(asked, "entry").select("entry", "of.id", "of.salt"), "jaccard-asked")
        texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
        texts = rows_of(texts, asked, "id", "text", ("entry",)).select("entry", "text")
        sets = held.saved(shingle_sets(texts, words), "jaccard-sets")

        links = held.saved(_checked(tried, sets), "jaccard-links")
        others = shared.where("entry <> first").select("key", F.col("entry").alias("member"), "size")
        roots = held.saved(components(links, "jaccard-components"), "jaccard-roots")
        labelled = others.join(roots.withColumnRenamed("node", "member"), "member", "left").select("key", "member", F.coalesce("root", "member").alias("root"), "size")
        cells = open_buckets(held.saved(labelled, "jaccard-labelled"), ["key"], F.col("size") + 1, BUDGET, held, "jaccard-open").drop("size")
        met = cells.join(sets.select(F.col("entry").alias("member"), "shingles"), "member")
        met = met.repartition("key", "shard").sortWithinPartitions("key", "shard", "role").select("key", "shard", "role", "member", "root", "shingles")
        links = held.saved(met.mapInArrow(_linker, "a long, b long"), "jaccard-links")
        roots = held.saved(components(joined(roots, links), "jaccard-components"), "jaccard-roots")
        named = entries.join(roots.withColumnRenamed("node", "entry"), "entry", "left").select("entry", "least", F.coalesce("root", "entry").alias("root"))
        named = held.saved(named, "jaccard-named")
        least = held.saved(roots.select("root").distinct().join(named, "root").groupBy("root").agg(F.min("least").alias("component")), "jaccard-least")
        return saved(named.join(least, "root", "left").select("entry", F.coalesce("component", "least").alias("component"), "root"), "jaccard-groups")


def _found(docs: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """(id, salt, component, root) of every row."""
    rows = saved(sketches(docs, id_column, text_column, words), "jaccard-rows")
    return rows.select("id", "salt", "entry").join(near_sets(docs, rows, words, id_column, text_column), "entry").drop("entry")


def near_duplicates(docs: DataFrame, words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, component_id) of every row."""
    return _found(docs, words, id_column, text_column).select(F.col("id").alias(id_column), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, chosen as in ``simhash.keep_first``; columns untouched."""
    return keep_firsts(docs, _found(docs, words, id_column, text_column), id_column, text_column)
