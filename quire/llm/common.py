"""Shared helpers: durable intermediate tables and Arrow plumbing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


SMALL_ROWS = 1 << 20
"""Rows of a few numbers each that may be broadcast: some 32 MiB."""


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is missing (single-machine tests) a temporary folder is made, one a process.
    """
    return (spark.conf.get("spark.checkpoint.dir", None) or _own_folder()).rstrip("/")


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quire-")


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it.

    This cuts lineage durably: a lost executor costs only the tasks it ran, never the whole job.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(rows: DataFrame, other: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join of wide ``rows`` with a narrow table that has been written: broadcast if it has at most ``SMALL_ROWS`` rows.

    Adaptive execution would find the table small only after it had shuffled the rows. Beyond the bound both sides are shuffled.
    """
    small = other.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return rows.join(F.broadcast(other) if small else other, on, how)


@cache
def _trim() -> Callable[[int], int]:
    """glibc's malloc_trim, or nothing where it is missing."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda _: 0


def release_memory() -> None:
    """Give freed memory of this process back to the system.

    Arrow's pool and malloc keep what they have had, and Spark keeps idle Python workers, several an executor when a
    stage has two Python steps; together they would hold the peaks of all tasks before.
    """
    pa.default_memory_pool().release_unused()
    _trim()(0)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch. A task's freed memory leaves the worker with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = out = None
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        del batch, out
        release_memory()

    return df.mapInArrow(run, schema)


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with further columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup a stream sorted by ``key`` so that no key spans two of the yielded tables."""
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key))
        last = column[batch.num_rows - 1]
        inside = pc.index(column, last).as_py()
        if held and held[-1].column(held[-1].schema.get_field_index(key))[held[-1].num_rows - 1] == last and inside == 0:
            held.append(batch)
            continue
        if inside:
            held.append(batch.slice(0, inside))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(inside)]
    if held:
        yield pa.Table.from_batches(held)


def null_safe_text(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
