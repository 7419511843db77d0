"""SimHash near-duplicates through BK-trees.

Fingerprints of 64 bits come from XXH64 (seed 42) of word shingles; two fingerprints link at ``radius`` or fewer
differing bits. Equal fingerprints are one entry, so exact copies cost nothing further. The 64 bits are cut into
``blocks`` parts; fingerprints within the radius agree in at least ``blocks - radius`` of them, so entries meet in a
bucket for each choice of that many parts (nothing within the radius is lost). Each bucket's entries form BK-trees:
children keyed by their Hamming distance to the parent, and a search follows only edges within the radius of its own
distance.

Buckets over ``limit`` entries are cut into shard trees, in two rounds. First each shard's entries are joined with each
other and with the bucket's first shard tree, which is sent to all tasks of the bucket (``limit`` entries at most, so
its size is bounded). Then only buckets that are not one component yet are searched: entries outside the bucket's largest
component look through every shard tree. A dense bucket costs twice its size, whatever its size.
The trees travel by shuffle, not from the driver: fingerprints of all documents have no bound that would allow a
broadcast of all trees.

A search skips a subtree whose members all are in its own component already, so a group of thousands of near copies
costs about its size, not its square, and each cell returns a spanning forest of its links, not its pairs.

Defined cases: a null text is the empty text; texts with no word have fingerprint zero, which links like any other;
fewer words than a shingle make one shingle; null ids never become a component's id unless all its ids are null;
repeated rows share their fingerprint and stay rows; an empty table gives an empty table; extra columns don't reach
the result and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch, map_texts, saved, slices
from siltwork.llm.components import components, joined, open_buckets
from siltwork.llm.rows import keep_firsts

LIMIT = 2048


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit SimHash; a bit is 1 if it is set in over half of the shingles' hashes."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    size = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    ones, n, step = np.zeros(64, np.int64), len(parts) - size + 1, 1 << 16
    for at in range(0, n, step):
        upto = min(n, at + step)
        pairs = zip(starts[at:upto].tolist(), ends[at + size - 1 : upto + size - 1].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in pairs], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


class BKTree:
    """A BK-tree whose entries also carry the component they have been joined into."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        self.even: list[bool] = []  # the whole subtree is in the entry's component

    def root(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def entry(self, value: int, joined: int | None = None) -> int:
        """A new entry, in the component of entry ``joined`` if that is given; it isn't in the tree yet."""
        self.values.append(value)
        self.children.append({})
        self.parent.append(len(self.parent) if joined is None else self.root(joined))
        self.even.append(True)
        return len(self.values) - 1

    def search(self, k: int, top: int = 0) -> None:
        """Join entry ``k`` with every entry of the tree within the radius."""
        value, radius, visited, todo = self.values[k], self.radius, [], [top]
        mine = self.root(k)
        while todo:
            at = todo.pop()
            if self.even[at] and self.root(at) == mine:
                continue
            visited.append(at)
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius and (other := self.root(at)) != mine:
                self.parent[max(mine, other)] = mine = min(mine, other)
            for edge, child in self.children[at].items():
                if -radius <= edge - distance <= radius:
                    todo.append(child)
        for at in reversed(visited):
            if not self.even[at]:
                own = self.root(at)
                self.even[at] = all(self.even[c] and self.root(c) == own for c in self.children[at].values())

    def hang(self, k: int, top: int = 0) -> None:
        """Put entry ``k`` into the tree."""
        value, mine, at = self.values[k], self.root(k), top
        while True:
            if self.even[at] and self.root(at) != mine:
                self.even[at] = False
            distance = (value ^ self.values[at]).bit_count()
            child = self.children[at].get(distance)
            if child is None:
                self.children[at][distance] = k
                return
            at = child


def link_cell(tree_values: list[int], queries: list[int], radius: int, roots: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Links that join what belongs together in a cell: (value, first value of its component).

    ``roots`` tells of values that are joined already; those links aren't given out again.
    """
    tree, first, places = BKTree(radius), {}, {}

    def entry(value: int) -> int:
        if value in places:
            return places[value]
        name = value if roots is None else roots[value]
        k = places[value] = tree.entry(value, first.get(name))
        first.setdefault(name, k)
        return k

    for n, value in enumerate(tree_values):
        k = entry(value)
        if n:
            tree.search(k)
            tree.hang(k)
    if tree_values:
        for value in queries:
            tree.search(entry(value))
    values = tree.values
    return [(values[k], values[r]) for k in first.values() if (r := tree.root(k)) != k]


def _linker(radius: int):
    """Cells (combo, part, shard) of rows in order of role: 0 for the tree's entries, 1 for its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, roots, found = None, ([], []), {}, []

        def close():
            if len(held[0]) + len(held[1]) > 1:
                found.extend(link_cell(*held, radius, roots))

        def flush():
            signed = np.array(found, np.uint64).view(np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("combo", "part", "shard", "role")]
            values, tops = (batch.column(n).to_numpy().view(np.uint64).tolist() for n in ("fp", "root"))
            for *now, role, value, top in zip(*columns, values, tops):
                if now != key:
                    close()
                    key, held, roots = now, ([], []), {}
                    if len(found) > 50_000:
                        yield flush()
                held[role].append(value)
                roots[value] = top
        close()
        yield flush()

    return run


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4) -> DataFrame:
    """(id, fp, salt) of every row; fp as a signed long, salt the text's hash."""

    def make():
        def kernel(batch: pa.RecordBatch):
            for part in slices(batch, 1):
                for key, text, salt in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
                    value = fingerprint(text.as_py(), words)
                    yield key, value - (1 << 64) if value >> 63 else value, salt

        return kernel

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.xxhash64(F.col(text_column)).alias("salt"))
    return map_texts(rows, f"id {kind}, fp long, salt long", make)


def blocks_for(entries: int, radius: int) -> int:
    """Parts to cut 64 bits into: one more than the radius until buckets would hold over about 64 random entries."""
    blocks = radius + 1
    while blocks < radius + 3 and entries > 64 << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def _links(cells: DataFrame, radius: int) -> DataFrame:
    keys = ["combo", "part", "shard"]
    dealt = cells.select(*keys, "role", "fp", "root").repartition(*keys).sortWithinPartitions(*keys, "role")
    return dealt.mapInArrow(_linker(radius), "a long, b long")


def near_groups(rows: DataFrame, radius: int = 4, limit: int = LIMIT) -> DataFrame:
    """(fp, component, root) of every distinct fingerprint of ``rows`` (id, fp).

    ``component`` is the smallest id reachable and ``root`` names the component, even where ids repeat.
    """
    with Scratch() as held:
        entries = held.saved(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-entries")
        blocks = blocks_for(entries.count(), radius)
        cuts = [64 * k // blocks for k in range(blocks + 1)]
        masks = [sum(((1 << cuts[k + 1]) - (1 << cuts[k])) for k in some) for some in combinations(range(blocks), blocks - radius)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        parts = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])
        key = ["combo", "part"]
        buckets = entries.select("fp", F.posexplode(parts).alias("combo", "part"))
        hot = held.saved(buckets.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit), "simhash-hot")
        cold = buckets.join(hot, key, "left_anti").select(*key, F.lit(0).alias("shard"), F.lit(0).alias("role"), "fp", F.col("fp").alias("root"))
        shards = F.ceil(F.col("n") / limit).cast("int")
        large = buckets.join(hot, key).withColumn("shards", shards).withColumn("shard", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("shards")).cast("int"))
        first = large.where("shard = 0").withColumn("shard", F.explode(F.sequence(F.lit(1), F.col("shards") - 1)))
        both = large.withColumn("role", F.lit(0)).unionByName(first.withColumn("role", F.lit(1)))
        found = held.saved(_links(cold.unionByName(both.select(*key, "shard", "role", "fp", F.col("fp").alias("root"))), radius), "simhash-links")
        roots = held.saved(components(found, "simhash-components"), "simhash-roots")
        if not hot.isEmpty():
            named = large.select(*key, F.col("fp").alias("member")).join(roots.withColumnRenamed("node", "member"), "member", "left").withColumn("root", F.coalesce("root", "member"))
            again = open_buckets(named, key, F.lit(1), limit, held, "simhash-open").withColumnRenamed("member", "fp")
            found = held.saved(_links(again, radius), "simhash-links")
            roots = held.saved(components(joined(roots, found), "simhash-components"), "simhash-roots")
        named = entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        named = held.saved(named, "simhash-named")
        least = held.saved(roots.select("root").distinct().join(named, "root").groupBy("root").agg(F.min("least").alias("component")), "simhash-least")
        return saved(named.join(least, "root", "left").select("fp", F.coalesce("component", "least").alias("component"), "root"), "simhash-groups")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row."""
    rows = saved(fingerprints(docs, id_column, text_column, words), "simhash-rows")
    groups = near_groups(rows, radius)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(groups, "fp").select(F.col("id").alias(id_column), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, radius: int = 4, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, null last; columns untouched.

    Where one id has several texts in a group, the text of the smallest hash stays; of rows that repeat id and text one
    stays.
    """
    rows = saved(fingerprints(docs, id_column, text_column, words), "simhash-rows")
    return keep_firsts(docs, rows.join(near_groups(rows.select("id", "fp"), radius), "fp"), id_column, text_column)
