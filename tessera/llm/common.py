"""What the operators share: the shared folder, tables kept in it, and files written by executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import on_workers

#: Rows and bytes of an Arrow batch that goes to a Python worker: whole texts, so few rows.
ROWS_PER_BATCH = 1000
BYTES_PER_BATCH = 1 << 24

_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


#: Python workers are kept between tasks; so they give large arrays back to the system when they are done with them.
_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 23), "MALLOC_TRIM_THRESHOLD_": str(1 << 24), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def tuned(spark: SparkSession) -> SparkSession:
    on_workers(spark)
    for name, value in _MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")


def folder(spark: SparkSession, label: str) -> str:
    """The URI of a new folder in the one that driver and executors share (spark.checkpoint.dir).

    Where none is set, a local session gets one of its own; on a cluster that would be a folder that the others
    don't see, so it raises ValueError.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    if (open_ := _scope.get()) is not None:
        open_.append(path)
    return path


def saved(df: DataFrame, label: str, tasks: int | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here, and lost executors cost nothing.

    tasks: the most that write, where the rows are known to be few, so that a small table isn't as many files as the shuffles have partitions.
    """
    spark = df.sparkSession
    path = folder(spark, label)
    (df if tasks is None else df.coalesce(tasks)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[list[str]]:
    """The folders that are made inside, for `discard`; those of other threads and of others' calls aren't among them."""
    made: list[str] = []
    mark = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(mark)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete folders whose rows nobody reads any more."""
    jvm = spark.sparkContext._jvm
    for path in made:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def apart(name: str, *tables: DataFrame) -> str:
    """The name, with underscores in front until no column of the tables has it (Spark doesn't tell cases apart)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def files_at(uri: str):
    """The pyarrow file system and path of a URI; executors use it to write and read files of their own formats."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return system, path


def unit(key: str = "doc_id") -> Column:
    """crc32 of the key as text, the split that the contracts name."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives b""."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def join_by_count(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner", share: int = 256) -> DataFrame:
    """rows joined with a table that has one row for each key, and in `count` how many rows have it.

    Keys with more than total / share rows, so fewer than `share` keys, are broadcast: their rows stay where they
    are, however many they are. The other keys are joined by a shuffle, in which none is large.
    """
    limit = total // share
    mark = apart("hot", rows, table)
    names = [c for c in table.columns if c != key]
    hot = table.filter(F.col(count) > limit)
    few = rows.join(F.broadcast(hot), key)
    many = rows.join(F.broadcast(hot.select(key, F.lit(True).alias(mark))), key, "left_anti").join(table.filter(F.col(count) <= limit), key, how)
    columns = [*rows.columns, *names]
    return few.select(*columns).unionByName(many.select(*columns))
