"""What the operators of this folder share: staging in the shared folder, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The folder of a local session where spark.checkpoint.dir is unset, as in tests.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the master local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all its machines share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spark-"))
        found = _OWN[0]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallywood-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, under: str | None = None) -> DataFrame:
    """df staged between the rounds of a loop, in a folder of its own or in the folder under, which its owner removes.

    The next plan begins with the size of the files. A checkpoint keeps the estimate of its plan instead, and
    each join multiplies the estimates of its sides, so over many rounds they grow beyond all bounds.
    """
    if under is None:
        return staged(df, "cut")
    path = f"{under}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A broadcast table has at most so many rows, and so many bytes of text in them.
SMALL_ROWS, SMALL_BYTES = 1_000_000, 64 << 20


def small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """df, a staged table, marked for a broadcast where it has so few rows and so few bytes of text."""
    if df.limit(rows + 1).count() > rows:
        return df
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    if texts and (df.agg(F.sum(sum(texts[1:], texts[0]))).first()[0] or 0) > size:
        return df
    return F.broadcast(df)


def running(df: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """df, staged, with sums[c] = the sum of the long column c over all rows up to each one in order (nulls first).

    A range shuffle puts the rows in parts, each part is sorted and summed by itself, batch after batch, and takes the
    sum of the parts before it. What is broadcast is one row for each part. order must tell rows apart, or equal
    rows must be interchangeable.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    part, *names = free(df, "part", *sums.values())
    schema = T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType()), *[T.StructField(n, T.LongType()) for n in names]])
    arrow, where = to_arrow_schema(schema), [df.columns.index(c) for c in sums]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, so_far = TaskContext.get().partitionId(), [0] * len(where)
        for b in batches:
            more = [np.cumsum(b.column(i).fill_null(0).to_numpy(zero_copy_only=False)) + at for i, at in zip(where, so_far, strict=True)]
            so_far = [int(m[-1]) if len(m) else at for m, at in zip(more, so_far, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, nth, np.int32)), *[pa.array(m, pa.int64()) for m in more]], schema=arrow)

    parts = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(summed, schema), "running")
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # over one row for each part
    before = parts.groupBy(part).agg(*[F.max(n).alias(n) for n in names]).select(part, *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"{n}__") for n in names])
    return parts.join(F.broadcast(before), part).select(*df.columns, *[(F.col(n) + F.col(f"{n}__")).alias(out) for n, out in zip(names, sums.values(), strict=True)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores before it as no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n = "_" + n
        out.append(n)
        taken.add(n)
    return out


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df less the columns whose names equal one of names, upper and lower case alike."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def sliced(batch: pa.RecordBatch, where: Sequence[int], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """batch in parts of rows whose columns where hold about most bytes together, or one row."""
    rows, at = max(1, batch.num_rows), 0
    step = max(1, int(rows * most / max(1, sum(batch.column(i).nbytes for i in where))))
    while at < batch.num_rows:
        part = batch.slice(at, step)
        while part.num_rows > 1 and sum(part.column(i).nbytes for i in where) > 2 * most:
            part = part.slice(0, part.num_rows // 2)
        yield part
        at += part.num_rows


def appended(df: DataFrame, make: Callable[[], Callable[..., list[pa.Array]]], needs: Sequence[str], adds: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    """df with the columns adds, computed batch by batch from the columns needs.

    make() is called once a task and gives a function from the Arrow arrays of needs to those of
    adds. A column of df that has the name of an added one is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    base = without(df, [n for n, _ in adds])
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, t) for n, t in adds]])
    arrow, where = to_arrow_schema(schema), [base.columns.index(n) for n in needs]
    kinds = [arrow.field(len(base.columns) + i).type for i in range(len(adds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in (part for batch in batches for part in sliced(batch, where)):
            more = [x.cast(k) if x.type != k else x for x, k in zip(f(*[b.column(i) for i in where]), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=arrow.names)

    return base.mapInArrow(run, schema)
