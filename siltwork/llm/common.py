"""Helpers shared by the corpus operators: shared scratch tables, Arrow row loops, document folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Only in local mode may that setting be absent (tests, a laptop):
    then a temporary folder is made and registered as the session's checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        context = spark.sparkContext
        root = context.getCheckpointDir()
        if root is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="siltwork-"))
            root = context.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/siltwork/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._siltwork_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``saved``; call only when nothing lazy still reads them."""
    path = getattr(df, "_siltwork_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        target.getFileSystem(conf).delete(target, True)


class Scratch:
    """Tables of one operator's run: ``with Scratch() as t`` deletes them at the end, but not those given to ``t.keep``."""

    def __init__(self):
        self.frames: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        self.frames.append(saved(df, name))
        return self.frames[-1]

    def keep(self, *frames: DataFrame) -> None:
        """What a lazy result still reads."""
        self.frames = [f for f in self.frames if not any(f is k for k in frames)]

    def __exit__(self, *failure) -> None:
        for f in self.frames:
            discard(f)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def map_texts(df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[pa.RecordBatch], Iterable[tuple]]]) -> DataFrame:
    """Run a row kernel over Arrow batches.

    ``make`` is called once per task and returns a function from a record batch to output tuples, so models load
    once. Output is re-batched at a bounded number of rows.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            rows: list[tuple] = []
            for row in kernel(batch):
                rows.append(row)
                if len(rows) >= 4096:
                    yield _batch(rows, arrow)
                    rows = []
            if rows:
                yield _batch(rows, arrow)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_column: str, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows whose text passes a test, columns untouched; a narrow pass. ``make`` is called once per task."""
    place = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for batch in batches:
            yield batch.filter(pa.array([passes(t.as_py()) for t in batch.column(place)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def slices(batch: pa.RecordBatch, text_column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of text, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class TwoGenerationCache:
    """A dict of bounded size: when the young generation is full it becomes the old one and the old one goes."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        self.young[key] = value
        self.turn()

    def turn(self) -> None:
        """For callers that put into ``young`` themselves."""
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
