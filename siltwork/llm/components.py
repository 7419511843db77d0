"""Connected components of a sparse graph of links, and even cells for buckets of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch, discard, saved


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the component's smallest node.

    Large-star and small-star rounds turn the links into one star a component, in about log n rounds, and end as soon as
    the links are stars. Every round reads and writes shared tables. Minima are pre-aggregated in each task, and both
    sides of the joins are plain scans, so that Spark can broadcast a small side or split a node with very many links.
    """
    links = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct()
    links = saved(links, name)
    for _ in range(most_rounds):
        if _are_stars(links):
            break
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, lambda: both.where("v > u"), name)
        small = _star(large, lambda large=large: large, name, keep_centre=True)
        discard(links)
        discard(large)
        links = small
    else:
        raise RuntimeError("components did not settle")
    stars = links.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return stars.unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def joined(stars: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with the links of ``stars``, a result of ``components`` that they extend."""
    return stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(edges)


def _are_stars(links: DataFrame) -> bool:
    """Whether every larger end v has one link and is no other link's smaller end."""
    ends = links.select(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("u").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    crossed = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 0 and up + down > 1")
    return not crossed.agg(F.count(F.lit(1))).first()[0]


def _star(links: DataFrame, moved, name: str, keep_centre: bool = False) -> DataFrame:
    """Links (u, v) hung on the smallest of v, u and u's neighbours; for the small star u is the larger end."""
    if keep_centre:
        links = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
        rows = links
    else:
        rows = moved()
    least = saved(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    out = rows.join(least, "u").select(F.col("v"), F.col("m"))
    if keep_centre:
        out = out.unionByName(least.select(F.col("u").alias("v"), "m"))
    out = saved(out.where("v <> m").distinct().select("v", F.col("m").alias("u")), name)
    discard(least)
    return out


def cells(rows: DataFrame, key: list[str], member: Column, limit: int, name: str) -> DataFrame:
    """``rows`` with cell_i, cell_j and shard: each two members of a bucket meet in a cell, and no cell is large.

    A bucket of n members is cut into ceil(n / limit) shards by ``member``'s hash; cell (i, j) holds shards i and j.
    Buckets within ``limit`` are one cell. Only the few larger buckets are looked up; their table has at most
    rows / limit entries and Spark broadcasts it only if its size allows.
    """
    hot = saved(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit), name)
    shards = F.coalesce(F.ceil(F.col("_n") / limit), F.lit(1)).cast("int")
    out = rows.join(hot, key, "left").withColumn("_s", shards).withColumn("shard", F.pmod(F.xxhash64(member, F.lit(5)), F.col("_s")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_s") - 1), lambda x: F.struct(F.least(x, F.col("shard")).alias("i"), F.greatest(x, F.col("shard")).alias("j")))
    out = out.withColumn("_cell", F.explode(pairs)).withColumns({"cell_i": F.col("_cell.i"), "cell_j": F.col("_cell.j")}).drop("_n", "_s", "_cell")
    return out.repartition(*key, "cell_i", "cell_j").sortWithinPartitions(*key, "cell_i", "cell_j", "shard")


def open_buckets(rows: DataFrame, key: list[str], weight: Column, limit: int, held: Scratch, name: str) -> DataFrame:
    """``rows`` (key, member, root) of buckets whose members aren't all joined yet, with shard and role.

    A bucket is cut into shards of a total ``weight`` of about ``limit`` by the members' hash. Its members have role 0, each
    in its own shard; those outside the bucket's largest component also have role 1 in every shard, as queries.
    Two members that aren't joined yet are not both in the largest component, so each such pair meets once at
    least, and a bucket of n members of which m are outside costs n + m * shards rows, not a share of n squared.
    """
    each = rows.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"))
    found = each.groupBy(*key).agg(F.max_by("root", F.struct("_n", "root")).alias("largest"), F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_c"))
    found = held.saved(found.where("_c > 1").select(*key, "largest", F.ceil(F.greatest(F.col("_w") / limit, F.lit(1.0))).cast("int").alias("shards")), name)
    met = held.saved(rows.join(found, key).withColumn("shard", F.pmod(F.xxhash64("member", F.lit(5)), F.col("shards")).cast("int")), name)
    queries = met.where("root <> largest").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    both = met.withColumn("role", F.lit(0)).unionByName(queries.withColumn("role", F.lit(1)))
    return both.select(*rows.columns, "shard", "role")
