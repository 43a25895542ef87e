"""Helpers shared by the training-data operators.

Nothing outside this subpackage imports it.  Intermediate tables go to the
folder that the cluster names in ``spark.checkpoint.dir`` so that a lost
executor never takes the only copy of a result with it.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a folder beside the warehouse's tables."""
    found = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quireflow-tmp"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/quireflow/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Bytes of the rows that Python is sent at once; changes no result.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python in batches of ``BATCH_BYTES`` at most (or one row); by default 10000 rows of any length are one.

    A batch is held by the JVM, outside its heap, and by Python, twice while the next one comes.
    """
    was = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, was)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which its process keeps no memory that is free.

    A worker outlives its task and waits beside the JVM for the next one; the C
    library would keep most of what the arrays of a task took.
    """

    def run_and_give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run_and_give_back


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.stored_at = path
    return held


def cut_lean(df: DataFrame, tag: str) -> DataFrame:
    """:func:`cut` for what Python makes of texts, in small batches."""
    with small_batches(df.sparkSession):
        return cut(df, tag)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def mark() -> int:
    """A place in the list of intermediate tables, for :func:`release`."""
    return len(_written)


def release(since: int = 0, keep: Sequence[DataFrame] = ()) -> None:
    """Remove the intermediate tables written since a mark but for some; call once the results are stored."""
    paths = [df.stored_at for df in keep]
    found = _written[since:]
    _written[since:] = [x for x in found if x[1] in paths]
    for spark, path in found:
        if path not in paths:
            with contextlib.suppress(Exception):  # the session may be gone already
                drop_path(spark, path)


def finish(df: DataFrame, tag: str, since: int) -> DataFrame:
    """Write ``df`` and read it again; the intermediate tables written since the mark go."""
    out = cut(df, tag)
    release(since, keep=[out])
    return out


atexit.register(release)


#: What a broadcast side may take in memory.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``limit`` bytes in memory.

    ``df`` must be cheap to read (a stored table).  Beyond the bound the join is
    left to Spark: a sort-merge join, whose skewed partitions adaptive execution
    splits.
    """
    return F.broadcast(df) if fits(df, limit) else df


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows take at most ``limit`` bytes: 16 for each row, 16 for each value, and what strings and arrays hold."""
    row = F.lit(16)
    for name, kind in df.dtypes:
        held = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            row = row + 16 + F.coalesce(F.octet_length(held), F.lit(0))
        elif kind.startswith("array"):
            row = row + 16 + 8 * F.greatest(F.size(held), F.lit(0))
        else:
            row = row + 16
    return (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= limit


def sliced(batches: Iterator[pa.RecordBatch], columns: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts add up to about ``limit`` bytes, so that few rows are Python objects at once."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns.split())
        part = (np.cumsum(size) - size) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def aside(df: DataFrame, needed: str) -> DataFrame:
    """``df`` with all but the needed columns under numbered names, so that none meets a helper; ``toDF`` gives the names back."""
    return df.toDF(*(c if c in needed.split() else f"x{i}" for i, c in enumerate(df.columns)))


def words_column(text: Column) -> Column:
    """The words of a text as an array (null text: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
