"""Shared plumbing: reading tables, the shared folder, cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; where that is unset, a session on one machine (tests) makes
    a temporary folder once and remembers it as the context's checkpoint folder. On a cluster, where such a
    folder is not shared, it must be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tallywright-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


#: Bytes that go to a Python worker at a time while a table is stored; a longer text goes alone.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def limit_batches(spark: SparkSession) -> str:
    """Arrow batches of the session hold BATCH_BYTES from here on, if they held more; gives what was set before.

    Buffers of executors and of their Python workers grow with the batches; results don't depend on them.
    """
    before = spark.conf.get(BATCH)
    digits = before.rstrip("b")
    if not digits.isdigit() or int(digits) > BATCH_BYTES:
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")
    return before


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """``limit_batches`` for a while."""
    before = limit_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


#: Rows of a few numbers that make a file worth while.
FILE_ROWS = 100_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again.

    The copy survives lost executors, is computed once however often it is read, and ends the lineage. Where
    a bound of its rows is known, ``rows``, it has no more files than FILE_ROWS asks for.
    """
    path = fresh_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one long column that are broadcast at most: about 16 MB as sent, twice that as a hash table.
BROADCAST_IDS = 1_000_000


def only(df: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose ``key`` (a long) is in the one-column ``ids``, or is not with ``left_anti``.

    The ids are counted first, so they are computed twice: up to BROADCAST_IDS of them are broadcast, so the
    wide rows of ``df`` stay where they are; more are joined by a shuffle.
    """
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias("only_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, F.col(key) == F.col("only_id"), how)
