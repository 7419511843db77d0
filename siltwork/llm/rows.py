"""Picking rows of wide tables by decisions on ids and text hashes, without a shuffle of all texts.

Decisions are narrow: (id, salt), salt being the text's hash. A join would shuffle every text once decisions are too
many to broadcast. So a bitmap of hashed salts sorts the rows out first in each task: rows that it doesn't hold are
certainly not meant, and only what it holds is joined exactly. The bitmap has 16 bits a key and ``2**MOST_BITS`` bits (16 MB) at
most, which bounds what is collected and broadcast; past that it holds more rows and the join does more of the work,
with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch, saved

MOST_BITS = 27


class Sieve:
    """The bitmap of ``keys`` (salt)."""

    def __init__(self, keys: DataFrame, most_bits: int = MOST_BITS):
        n = keys.count()
        self.bits = min(most_bits, max(10, int(16 * n).bit_length()))
        place = F.pmod(F.xxhash64("salt", F.lit(17)), F.lit(1 << self.bits))
        words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toArrow()
        held = np.zeros(1 << self.bits - 6, np.int64)
        held[words.column("w").to_numpy()] = words.column("v").to_numpy()
        self.words = keys.sparkSession.sparkContext.broadcast(held.view(np.uint64))

    def rows(self, docs: DataFrame, salt_column: str, held: bool) -> DataFrame:
        """Rows whose salt the bitmap holds, or the others; columns untouched."""
        shared, name = self.words, "__sw_place"
        placed = docs.withColumn(name, F.pmod(F.xxhash64(salt_column, F.lit(17)), F.lit(1 << self.bits)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = shared.value
            for batch in batches:
                place = batch.column(batch.num_columns - 1).to_numpy().astype(np.uint64)
                hit = (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
                yield batch.filter(pa.array(hit == held))

        return placed.mapInArrow(run, placed.schema).drop(name)


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.withColumns({"__sw_id": F.col(id_column), "__sw_salt": F.xxhash64(F.col(text_column))})


def _joined(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    named = chosen.select(*[F.col(c).alias(f"__sw_c_{c}") for c in chosen.columns])
    return keyed.join(named, F.expr("__sw_id <=> __sw_c_id and __sw_salt <=> __sw_c_salt"))


def rows_of(docs: DataFrame, chosen: DataFrame, id_column: str = "doc_id", text_column: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """One row of ``docs`` for each (id, salt) of ``chosen``, with the columns ``also`` of it."""
    out = [F.col(f"`{c}`") for c in docs.columns] + [F.col(f"__sw_c_{c}").alias(c) for c in also]
    maybe = Sieve(chosen).rows(_keyed(docs, id_column, text_column), "__sw_salt", True)
    return _joined(maybe, chosen).dropDuplicates(["__sw_id", "__sw_salt"]).select(*out)


def keep_firsts(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``docs`` of each root of ``found`` (id, salt, root): that of the smallest id, null last, then of the
    smallest salt; of rows that repeat id and text one. Columns are untouched."""
    with Scratch() as held:
        counted = held.saved(found.groupBy("root", "id", "salt").agg(F.count(F.lit(1)).alias("n")), "kept-counts")
        first = counted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "salt", "n")).alias("c"))
        first = held.saved(first.select("root", "c.id", "c.salt", "c.n"), "kept-firsts")
        mark = first.select(F.col("root").alias("r"), F.col("id").alias("i"), F.col("salt").alias("s"))
        others = counted.join(mark, F.expr("root = r and id <=> i and salt = s"), "left_anti").unionByName(counted.where("n > 1"))
        sieve = Sieve(held.saved(others.select("salt"), "kept-others"))
        chosen = saved(first.select("id", "salt"), "kept-chosen")
    keyed, out = _keyed(docs, id_column, text_column), [F.col(f"`{c}`") for c in docs.columns]
    maybe = _joined(sieve.rows(keyed, "__sw_salt", True), chosen).dropDuplicates(["__sw_id", "__sw_salt"])
    return sieve.rows(keyed, "__sw_salt", False).select(*out).unionByName(maybe.select(*out))
