"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python.
ROWS_PER_BATCH = 1024
#: Bytes of text that are worked on at once, but for single texts that are longer.
BYTES_AT_ONCE = 1 << 19
#: Rows that a writer of an intermediate table holds at once.
ROW_GROUP_BYTES = 16 << 20
#: Largest table, measured in bytes, that is broadcast.
BROADCAST_BYTES = 16 << 20

_held: list = [None, None]


def release_model() -> None:
    """Let go of the worker's heavy object, if it holds one, and give its memory back."""
    if _held[0] is not None:
        _held[:] = [None, None]
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: its allocator decides


def worker_model(key, make: Callable):
    """A heavy object that a worker keeps between tasks; one at a time, so that successive operators don't add up."""
    if _held[0] != key:
        release_model()
        _held[:] = [key, make()]
    return _held[1]


def by_bytes(batches: Iterable[pa.RecordBatch], column: int, limit: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the texts of a column come to more than ``limit`` bytes."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(total):
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` of ``sf_dir``, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Lower the session's Arrow batch size to ``rows`` (never raises it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) <= 0 or int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session in one process (tests, single machine) names none, a temporary folder is made
    and kept in the session, and Spark's checkpoints go there too; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.loomstone.shared.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomstone-")
        spark.conf.set("spark.loomstone.shared.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/loomstone-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage; the copy outlives any executor. Sizes of the parts follow the plan.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomstone_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote; ``df`` must not be used afterwards."""
    path = getattr(df, "_loomstone_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether the rows, as text and 16 bytes more a value, come to ``limit`` bytes at most (``BROADCAST_BYTES``)."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") + 16 for c in df.columns), F.lit(0))
    return (df.agg(F.sum(size)).first()[0] or 0) <= (BROADCAST_BYTES if limit is None else limit)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """The (materialised) table, marked to be broadcast if its measured size allows it; joins work either way."""
    return F.broadcast(df) if small(df) else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that the table has not."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def remainder(column: str, n: int):
    """crc32 of the column as text, modulo ``n`` (null stays null)."""
    return F.crc32(F.col(column).cast("string")) % n


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
