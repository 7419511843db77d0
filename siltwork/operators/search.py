"""Vector search: top-k of one query or many, with the ownership and status filters, and retrieval quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.functions.expr import cosine_distance


def search(vectors: DataFrame, sources: DataFrame, query: list[float], k: int, collection_id: int | None = None) -> DataFrame:
    """The ``k`` nearest searchable chunks of one query vector, nearest first.

    Searchable: the source is completed, the chunk has a vector. The query is a literal, so distances are computed in the
    scan, with pushed filters; the join moves ids and distances only, and a task sends k rows to the top-k.
    """
    done = sources.where(F.col("status") == "completed")
    if collection_id is not None:
        done = done.where(F.col("collection_id") == collection_id)
    literal = F.array(*[F.lit(float(x)) for x in query])
    near = vectors.where(F.col("embedding").isNotNull()).select(F.col("id").alias("chunk_id"), "source_id", cosine_distance(F.col("embedding"), literal).alias("distance"))
    rows = near.join(done.select(F.col("id").alias("source_id"), F.col("url").alias("source_url")), "source_id").select("chunk_id", "source_id", "source_url", "distance")
    return rows.orderBy(F.col("distance").asc_nulls_last(), "chunk_id").limit(k)


#: Bounds of what a task holds beside its Arrow batch: rows made a matrix at once, products of a block of queries with
#: rows at once, and candidates that wait to be ranked.
SLICE_ROWS, TILE, WAITING = 2048, 1 << 20, 1 << 18


def search_many(
    vectors: DataFrame, queries: DataFrame, k: int, other_than_self: bool = False, block: int = 4096, probed: Callable[[np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    """(query_id, chunk_id, distance, rank[, label, query_label]) of the ``k`` nearest vectors of each query (query_id, query).

    The stated query set meets all rows in blocks of at most ``block`` queries: a block is one matrix, which bounds what
    is collected and sent to the tasks. A task multiplies its rows with it tile by tile, ranks only what is not farther
    than a query's k-th neighbour so far, and hands on k rows a query, which are ranked again over all tasks: its memory
    depends on ``block`` and ``k``, not on the rows. Distances are rounded to twelve decimals; ties go to the smaller id.

    ``probed`` names the cells that each query of a matrix meets (one row a query); ``vectors`` then have a ``cell``.
    """
    extra = [c for c in ("label",) if c in vectors.columns] + [c for c in ("query_label",) if c in queries.columns]
    rows = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding", *[c for c in extra if c == "label"], *["cell"] * (probed is not None))
    blocks = max(1, -(-queries.count() // block))
    parts = []
    for n in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).orderBy("query_id").toArrow()
        parts.append(rows.mapInArrow(_nearest(own, k, other_than_self, extra, probed), _near_schema(vectors, queries, extra)))
    near = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "chunk_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _near_schema(vectors: DataFrame, queries: DataFrame, extra: list[str]) -> str:
    kinds = {c: t for df in (vectors, queries) for c, t in df.dtypes}
    return f"query_id {kinds['query_id']}, chunk_id {kinds['id']}, distance double" + "".join(f", {c} {kinds[c]}" for c in extra)


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Rows of unit length in double precision; NaN where a vector is zero, null in part or of another length."""
    out = np.full((len(lists), size), np.nan)
    fits = pc.fill_null(pc.equal(pc.list_value_length(lists), size), False)
    held = lists.filter(fits)
    out[fits.to_numpy(zero_copy_only=False)] = held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), size)
    with np.errstate(invalid="ignore", divide="ignore"):
        out /= np.sqrt((out * out).sum(1, keepdims=True))
    out[np.isnan(out).any(1)] = np.nan
    return out


def _nearest(queries: pa.Table, k: int, other_than_self: bool, extra: list[str], probed: Callable[[np.ndarray], np.ndarray] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists = (queries.column(c).combine_chunks() for c in ("query_id", "query"))
        size = pc.max(pc.list_value_length(lists)).as_py() or 0
        matrix, own = _matrix(lists, size), ids.to_numpy(zero_copy_only=False)
        asking: dict[int | None, tuple[np.ndarray, np.ndarray]] = {None: (np.arange(len(own)), matrix)}
        cells = probed(matrix) if probed is not None and len(own) else None
        best = _Best(len(own), k)
        step = 32  # rows of the next tile: the first ones fill the ranks, as nothing is too far for them yet
        for whole in batches:
            for start in range(0, whole.num_rows if len(own) else 0, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                x = _matrix(batch.column("embedding"), size)
                names = batch.column("id").to_numpy(zero_copy_only=False)
                lost = np.isnan(x[:, 0]) if size else np.ones(len(x), bool)
                for cell, members in _by_cell(batch, cells is not None):
                    if cell not in asking:
                        q = np.flatnonzero((cells == cell).any(1))
                        asking[cell] = q, matrix[q]
                    q, m = asking[cell]
                    if not len(q):
                        continue

                    def meet(at: np.ndarray, rows: np.ndarray, distance: np.ndarray) -> None:
                        near = best.may_rank(at, distance, names[rows])
                        if other_than_self:
                            near &= own[at] != names[rows]
                        at, rows = at[near], rows[near]
                        best.add(at, distance[near], batch.column("id").take(pa.array(rows)), {c: batch.column(c).take(pa.array(rows)) for c in extra if c != "query_label"})

                    # Pairs without a distance come last, by id: no more than k and the query itself can count.
                    first = lambda r: r[np.argsort(names[r], kind="stable")[: k + 1]]
                    blank = np.isnan(m[:, 0]) if size else np.ones(len(q), bool)
                    for asked, rows in ((q[~blank], first(members[lost[members]])), (q[blank], first(members))):
                        open_ = asked[np.isinf(best.worst[asked])]
                        if len(open_) and len(rows):
                            meet(np.repeat(open_, len(rows)), np.tile(rows, len(open_)), np.full(len(open_) * len(rows), np.nan))
                    members, done = members[~lost[members]], 0
                    while done < len(members):
                        rows = members[done : done + max(1, min(step, TILE // len(q)))]
                        likeness = m @ x[rows].T
                        at, c = np.nonzero(likeness >= (1 - 1e-11 - best.worst[q])[:, None])
                        meet(q[at], rows[c], np.round(1 - likeness[at, c], 12))
                        done += len(rows)
                        step = min(2 * step, TILE)
        for b in best.table().to_batches():
            at = b.column("query")
            columns = [ids.take(at), b.column("id"), b.column("distance"), *[queries.column(c).combine_chunks().take(at) if c == "query_label" else b.column(c) for c in extra]]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "distance", *extra])

    return run


def _by_cell(batch: pa.RecordBatch, celled: bool) -> Iterator[tuple[int | None, np.ndarray]]:
    if not celled:
        yield None, np.arange(batch.num_rows)
        return
    cell = batch.column("cell").to_numpy(zero_copy_only=False)
    order = np.argsort(cell, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        if len(part):
            yield int(cell[part[0]]), part


class _Best:
    """The ``k`` nearest rows so far of each of ``n`` queries (numbered), and candidates that wait to be ranked."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.worst, self.worst_id = np.full(n, np.inf), None  # distance and id of the k-th; infinite while it has none
        self.parts: list[pa.Table] = []
        self.waiting = 0

    def may_rank(self, at: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each candidate comes before its query's k-th row."""
        distance, worst = np.where(np.isnan(distance), np.inf, distance), self.worst[at]
        near = (distance < worst) | np.isinf(worst)
        if self.worst_id is not None:
            tied = np.flatnonzero(~near & (distance == worst))
            near[tied] = ids[tied] < self.worst_id[at[tied]]
        return near

    def add(self, at: np.ndarray, distance: np.ndarray, ids: pa.Array, more: dict[str, pa.Array]) -> None:
        if not len(at):
            return
        self.parts.append(pa.table({"query": pa.array(at), "distance": pa.array(distance), "id": ids, **more}))
        self.waiting += len(at)
        if self.waiting >= WAITING:
            self.rank()

    def rank(self) -> None:
        rows = pa.concat_tables(self.parts)
        q, d, c = (rows.column(n).to_numpy() for n in ("query", "distance", "id"))
        order = np.lexsort((c, d, q))
        turn = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        last = order[turn == self.k - 1]
        if self.worst_id is None:
            self.worst_id = np.zeros(len(self.worst), c.dtype)
        self.worst[q[last]], self.worst_id[q[last]] = np.where(np.isnan(d[last]), np.inf, d[last]), c[last]
        self.parts, self.waiting = [rows.take(pa.array(order[turn < self.k])).combine_chunks()], 0

    def table(self) -> pa.Table:
        if self.parts:
            self.rank()
        return self.parts[0] if self.parts else pa.table({})


def retrieval_quality(ranked: DataFrame, queries: DataFrame, relevant: Column) -> DataFrame:
    """One row: hit rates at 1 and 5 and mean reciprocal rank over all queries, misses included."""
    first = ranked.where(relevant).groupBy("query_id").agg(F.min("rank").alias("first"))
    every = queries.select("query_id").join(first, "query_id", "left")
    hit = lambda n: F.avg(F.coalesce((F.col("first") <= n).cast("double"), F.lit(0.0)))
    mrr = F.avg(F.coalesce(1 / F.col("first").cast("double"), F.lit(0.0)))
    return every.agg(F.count(F.lit(1)).alias("n_queries"), hit(1).alias("hit_at_1"), hit(5).alias("hit_at_5"), mrr.alias("mrr"))


def cite_rate(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: answers (query_id, answer), and the share of them that names the URL of one of their hits (query_id, url)."""
    cited = answers.join(hits.select("query_id", "url"), "query_id").where(F.col("answer").contains(F.col("url"))).select("query_id").distinct()
    both = answers.join(cited.withColumn("_c", F.lit(1.0)), "query_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n_answers"), F.coalesce(F.avg(F.coalesce("_c", F.lit(0.0))), F.lit(0.0)).alias("cite_rate"))


# The answer without hits and the layout of a passage.
NOT_ENOUGH = "I don't have enough information in the provided sources to answer that."
PASSAGE = "[%d]\nTitle: %s\nURL: %s\nSection: %s\nChunkIndex: %d\nDistance: %.4f\nContent:\n%s\n\n"
SYSTEM = "You answer questions using only the numbered context passages. Cite the source URLs that support each statement. If the passages don't contain the answer, say so."


def prompt(hits: DataFrame, question: Column, by: list[str]) -> DataFrame:
    """(by, prompt): numbered passages of ranked hits (rank, title, document_title, url, section, chunk_index, distance, content)."""
    filled = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    title = filled("title", filled("document_title", F.lit("(untitled)")))
    passage = F.format_string(
        PASSAGE, F.col("rank"), title, F.col("url"), filled("section", F.lit("(none)")), F.col("chunk_index"), F.col("distance"), F.col("content"),
    )
    one = hits.select(*by, question.alias("_q"), F.struct(F.col("rank").alias("r"), passage.alias("p")).alias("_p"))
    parts = one.groupBy(*by, "_q").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return parts.select(*by, F.concat(F.lit("Question:\n"), F.col("_q"), F.lit("\n\nContext:\n"), F.array_join(F.transform("_p", lambda x: x["p"]), "")).alias("prompt"))


def flatten_messages(messages: DataFrame, by: str, turn: str, role: str, text: str) -> DataFrame:
    """(by, prompt): ``ROLE:`` and content of each turn in order, a blank role being USER."""
    name = F.when(F.trim(F.coalesce(F.col(role), F.lit(""))) == "", "USER").otherwise(F.upper(F.trim(F.col(role))))
    entry = F.struct(F.col(turn).alias("t"), F.concat(name, F.lit(":\n"), F.coalesce(F.col(text), F.lit(""))).alias("m"))
    return messages.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["m"]), "\n\n").alias("prompt"))


def ask(hits: DataFrame, question: str, llm_fn) -> dict:
    """Answer over the few rows of one search; without hits the model isn't called."""
    rows = hits.orderBy("rank").collect()
    if not rows:
        return {"answer": NOT_ENOUGH, "sources": []}
    text = prompt(hits.withColumn("one", F.lit(1)), F.lit(question), ["one"]).first()["prompt"]
    answer = llm_fn([{"role": "system", "content": SYSTEM}, {"role": "user", "content": text}], temperature=0.2, max_tokens=700)
    if not (answer or "").strip():
        raise ValueError("the model's answer is blank")
    return {"answer": answer, "sources": [r.asDict() for r in rows]}
