"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

Targets: sources in order of code points (null last) weigh 5, 2, 1, repeating, and share the words of all; a target
stops at three times its source's size, and the excess is shared again by weight: rounds of one aggregate over the
sources, each of which stops those above, until none is above. The order comes from ranges of sources, each numbered
in its own task, and the sizes of the ranges before it, so there may be any number of sources.

Copies: every document of a source is wanted ``target / size`` times. The whole part is certain; the fraction is
rounded by pairs. A step takes two documents with fractions, moves words from one to the other in a random direction
(with odds that keep each one's expectation) until one fraction is 0 or 1, and carries the other on. Words are
conserved in each step. Documents meet in groups of about ``GROUP`` of like hash; each group leaves one fraction at
most, and the leftovers meet again in ever fewer groups: a reduction tree of about log(n) / log(GROUP) levels, each
written to the shared folder. The last fraction of a source is drawn. So that a long document drawn last does not
spoil a source's total, this is done for documents over the source's mean size first, then for those over an eighth of
it, then for the rest; what the draw of one tier gave too much or too little shifts
the wanted copies of the next tier, within 0 and ``CAP``. No group
grows with its source, so one source may hold any share of the rows. Random draws are hashes of the two ids and
``seed``; reruns agree.

Rows that repeat id, source and text are one unit with a count, which wants that many times the copies and has one
fraction; its copies are dealt evenly to its rows, the odd ones to some of them. So repeats never fill a group.

Defined cases: a null text is empty and takes part with size 0 (never copied more than its whole part, and it takes no
words); a null source is a source of its own; documents of a source without words have target 0; repeated rows each
take their share, at most ``CAP`` copies; an empty table gives an empty table; extra columns don't reach the result and
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.llm.common import Scratch, saved

WEIGHTS, CAP, GROUP = (5, 2, 1), 3, 64
RUN = 4096  # rows made from one row at a time


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def turns(sources: DataFrame, held: Scratch) -> DataFrame:
    """``sources`` with ``turn``, their place in order of code points, null last."""
    order = F.col("source").asc_nulls_last()
    ranges = held.saved(sources.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "mixing-ranges")
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row a task
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    numbered = ranges.withColumn("within", within).join(sizes.select("range", before.alias("before")), "range")
    return numbered.select(*sources.columns, (F.col("before") + F.col("within")).alias("turn"))


def targets(sizes: DataFrame, held: Scratch) -> DataFrame:
    """(source, source_size, target) from one row a source (source, source_size)."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("turn") % len(WEIGHTS) + 1).cast("int"))
    rows = turns(sizes, held).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(CAP)).alias("most"))
    rows = held.saved(rows, "mixing-weights")
    level, stopped = None, None
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.col("most")
        n, words_of_all, fixed, left = rows.agg(F.count_if(over), F.sum(F.col("source_size").cast("double")), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == stopped or not left:
            break
        level, stopped = (words_of_all - (fixed or 0.0)) / left, n
    target = F.col("most") if level is None else F.least("most", F.lit(level) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


#: One pivotal step as SQL. ``acc`` has the list of settled documents and the carried one; ``x`` is the next document.
#: Fractions are of copies, ``a`` and ``b`` the words that their fractions stand for.
_STEP = """
aggregate(
  items,
  cast(named_struct('settled', array(), 'carry', null) as struct<settled: array<{item}>, carry: {item}>),
  (acc, x) -> case
    when acc.carry is null then named_struct('settled', acc.settled, 'carry', x)
    else transform(array(named_struct(
      'up', least(acc.carry.part * acc.carry.size, (1 - x.part) * x.size),
      'down', least((1 - acc.carry.part) * acc.carry.size, x.part * x.size),
      'draw', pmod(xxhash64(acc.carry.doc_id, x.doc_id, acc.carry.salt, x.salt, {seed}), 1073741824) / 1073741824D)),
      d -> transform(array(
        case when d.up + d.down <= 0 or d.draw * (d.up + d.down) < d.down then d.up else -d.down end),
        m -> transform(array(named_struct(
          'c', {moved_carry},
          'x', {moved_x})),
          n -> case
            when n.c.part <= 1e-9 or n.c.part >= 1 - 1e-9
            then named_struct('settled', concat(acc.settled, array(n.c)), 'carry', n.x)
            else named_struct('settled', concat(acc.settled, array(n.x)), 'carry', n.c) end)[0])[0])[0]
  end)
"""
_ITEM = "struct<size: bigint, doc_id: {id}, salt: bigint, part: double, base: bigint, rows: bigint>"
UNITS = ["source", "n", "doc_id", "salt", "size", "part", "base", "rows"]


def _moved(side: str, sign: str) -> str:
    part = f"greatest(0D, least(1D, {side}.part {sign} m / {side}.size))"
    return f"named_struct('size', {side}.size, 'doc_id', {side}.doc_id, 'salt', {side}.salt, 'part', {part}, 'base', {side}.base, 'rows', {side}.rows)"


def pivot(units: DataFrame, seed: int, level: int) -> DataFrame:
    """One level: documents of a source with fractions meet in ceil(n / GROUP ** (level + 1)) groups of like hash."""
    item = _ITEM.format(id=units.schema["doc_id"].dataType.simpleString())
    groups = F.ceil(F.col("n") / F.lit(float(GROUP ** (level + 1)))).cast("long")
    spread = F.pmod(F.xxhash64("doc_id", "salt", F.lit(seed), F.lit(level)), groups).alias("spread")
    entry = F.struct("size", "doc_id", "salt", "part", "base", "rows")
    grouped = units.groupBy("source", "n", spread).agg(F.sort_array(F.collect_list(entry), asc=False).alias("items"))
    step = _STEP.format(item=item, seed=seed, moved_carry=_moved("acc.carry", "-"), moved_x=_moved("x", "+"))
    folded = grouped.select("source", "n", F.expr(step).alias("acc"))
    every = F.explode(F.expr("concat(acc.settled, array(acc.carry))")).alias("u")
    return folded.select("source", "n", every).select("source", "n", "u.doc_id", "u.salt", "u.size", "u.part", "u.base", "u.rows")


def mix_units(docs: DataFrame, seed: int = 20, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, source, salt, size, source_size, target, rows, copies) of every distinct (id, source, text).

    ``salt`` is the text's hash, ``rows`` how many rows are equal, ``copies`` how many rows the mix takes for them.
    """
    with Scratch() as held:
        rows = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), F.xxhash64(F.col(text_column)).alias("salt"), words(F.col(text_column)).alias("size"))
        units = held.saved(rows.groupBy("doc_id", "source", "salt", "size").agg(F.count(F.lit(1)).alias("rows")), "mixing-units")
        sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("n"), F.sum("rows").alias("n_rows"))
        sizes = held.saved(sizes, "mixing-sources")
        counts = sizes.select(F.col("source").alias("s"), "n", "n_rows")
        wanted = targets(sizes.select("source", "source_size"), held).join(counts, F.expr("source <=> s")).drop("s")
        wanted = held.saved(wanted, "mixing-targets")
        want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        joined = units.join(wanted.withColumnRenamed("source", "s"), F.expr("source <=> s")).withColumn("want", want)
        mean = F.col("source_size") / F.col("n_rows")
        tier = F.when(F.col("size") > mean, 0).when(F.col("size") > mean / 8, 1).otherwise(2)
        joined = _split(joined).withColumn("tier", tier)
        most = wanted.agg(F.max("n")).first()[0] or 0
        done, owed = [], sizes.select("source", F.lit(0.0).alias("owed"))
        for k in range(3):
            own = joined.where(F.col("tier") == k).select(*UNITS)
            rounded, owed = _round_tier(own, owed, seed + 2 * k, most, held)
            done += rounded
        copies = F.when(F.col("size") > 0, F.col("base") + F.round("part").cast("long")).otherwise(F.col("base"))
        taken = _union(done).withColumn("copies", copies).drop("n").join(wanted.withColumnRenamed("source", "s"), F.expr("source <=> s"))
        return saved(taken.select("doc_id", "source", "salt", "size", "source_size", "target", "rows", "copies"), "mixing-copies")


def mix(docs: DataFrame, seed: int = 20, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, copies, source) of every document."""
    units = mix_units(docs, seed, id_column, text_column, source_column)
    rows = units.withColumn("__sw_k", F.explode(F.sequence(F.lit(0), F.least(F.col("rows"), F.lit(RUN)) - 1)))
    more = _runs(units.where(F.col("rows") > RUN), F.col("rows"), F.lit(RUN))
    copies = F.expr("copies div rows") + (F.col("__sw_k") < F.expr("copies % rows")).cast("long")
    out = rows.unionByName(more).withColumn("copies", copies)
    return out.select(F.col("doc_id").alias(id_column), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def _runs(rows: DataFrame, upto: Column, start: Column) -> DataFrame:
    """Each row once for each __sw_k from ``start`` to below ``upto``, made in runs that are dealt to all tasks."""
    runs = rows.withColumn("__sw_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((upto - start - 1) / F.lit(RUN)).cast("long"))))
    first = start + F.col("__sw_run") * RUN
    dealt = runs.withColumns({"__sw_first": first, "__sw_last": F.least(first + RUN, upto) - 1}).repartition("__sw_run", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    return dealt.withColumn("__sw_k", F.explode(F.sequence("__sw_first", "__sw_last"))).drop("__sw_run", "__sw_first", "__sw_last")


def _round_tier(units: DataFrame, owed: DataFrame, seed: int, most: int, held: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Rounded units of a tier, and the words that each source is owed after it (source, owed)."""
    due = held.saved(owed.withColumnRenamed("source", "s"), "mixing-owed")
    mass = units.groupBy("source").agg(F.sum((F.col("size") * F.col("rows")).cast("double")).alias("mass"))
    room = held.saved(mass.join(due, F.expr("source <=> s"), "right").select("s", "owed", F.coalesce("mass", F.lit(0.0)).alias("mass")), "mixing-room")
    shift = F.when(F.col("mass") > 0, F.col("owed") / F.col("mass")).otherwise(F.lit(0.0))
    before = (F.col("base") + F.col("part")) / F.col("rows")
    shifted = units.join(room, F.expr("source <=> s")).withColumn("want", F.greatest(F.lit(0.0), F.least(F.lit(float(CAP)), before + shift)))
    moved = _split(shifted).select(*UNITS)
    settled = (F.col("part") <= 1e-9) | (F.col("part") >= 1 - 1e-9) | (F.col("size") == 0)
    done, open_units, level = [moved.where(settled)], moved.where(~settled), 0
    while most:
        after = pivot(open_units, seed, level)
        last = most <= GROUP ** (level + 1)
        if last:  # each source was one group and has one fraction left: a single draw
            draw = F.pmod(F.xxhash64("doc_id", "salt", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
            after = after.withColumn("part", F.when(settled, F.col("part")).otherwise((draw < F.col("part")).cast("double")))
        after = held.saved(after, "mixing-level")
        done.append(after if last else after.where(settled))
        if last:
            break
        open_units, level = after.where(~settled), level + 1
    words_of = lambda df, name: df.groupBy("source").agg(F.sum((F.col("base") + F.col("part")) * F.col("size")).alias(name))
    wished = words_of(units, "wished").withColumnRenamed("source", "w")
    given = words_of(done[0] if len(done) == 1 else _union(done), "given").withColumnRenamed("source", "g")
    rest = room.join(wished, F.expr("s <=> w"), "left").join(given, F.expr("s <=> g"), "left")
    owed = rest.select(F.col("s").alias("source"), (F.col("owed") + F.coalesce("wished", F.lit(0.0)) - F.coalesce("given", F.lit(0.0))).alias("owed"))
    return done, owed


def _split(units: DataFrame) -> DataFrame:
    """``want`` copies of each of a unit's rows as a whole ``base`` and a fraction ``part`` for all of them."""
    total = F.col("want") * F.col("rows")
    units = units.withColumn("base", F.least(F.floor(total + F.lit(1e-12)), F.col("rows") * CAP).cast("long"))
    return units.withColumn("part", F.greatest(F.lit(0.0), total - F.col("base")))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def apply_mix(docs: DataFrame, units: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as ``units`` (of ``mix_units``) says; its columns stay as they are.

    Every row that repeats id, source and text stays as often as the others do; copies that are left over are made from
    one of them. One join, which shuffles texts only where Spark finds the decisions too large to broadcast.
    """
    key = {"doc_id": F.col(id_column), "source": F.col(source_column), "salt": F.xxhash64(F.col(text_column))}
    same = " and ".join(f"__sw_d_{c} <=> __sw_{c}" for c in key)

    def joined(decided: DataFrame) -> DataFrame:
        named = decided.select(*[F.col(c).alias(f"__sw_{c}") for c in (*key, "rows", "copies")])
        return docs.withColumns({f"__sw_d_{c}": v for c, v in key.items()}).join(named, F.expr(same))

    own = [F.col(f"`{c}`") for c in docs.columns]
    each = joined(units.where("copies >= rows")).withColumn("__sw_k", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("__sw_copies div __sw_rows"))))
    odd = saved(units.where("copies % rows > 0"), "mixing-odd")  # small as a rule, which Spark can then see
    odd = joined(odd).dropDuplicates([f"__sw_d_{c}" for c in key])
    return each.select(*own).unionByName(_runs(odd, F.expr("__sw_copies % __sw_rows"), F.lit(0)).select(*own))
