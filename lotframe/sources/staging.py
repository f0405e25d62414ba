"""Intermediate tables in the cluster's shared folder.

A staged table cuts lineage, survives the loss of executors and gives the
planner real sizes, which decide between broadcast and shuffle joins.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_paths_in_scope: ContextVar[list[str] | None] = ContextVar("_paths_in_scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="lotframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/lotframe/{name}-{uuid.uuid4().hex}"
    paths = _paths_in_scope.get()
    if paths is not None:
        paths.append(path)
    return path


@contextmanager
def discarding_stages(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables staged inside the block when it ends.

    For jobs that write their result inside the block; a DataFrame that leaves
    it would miss its tables.
    """
    paths: list[str] = []
    token = _paths_in_scope.set(paths)
    try:
        yield
    finally:
        _paths_in_scope.reset(token)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TRUST_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside the block leaves no shuffle files, which else stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def bucketed_table(
    spark: SparkSession, folder: str, schema: StructType, keys: Sequence[str], buckets: int, in_order: Sequence[str] = ()
) -> DataFrame:
    """A scan that knows its buckets. The table is in the catalog only until it is resolved; its files stay.

    ``in_order``: columns that each file is sorted by. Spark takes a bucket of one file for sorted only if the session says so.
    """
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    table = f"lotframe_{uuid.uuid4().hex}"
    if in_order:
        spark.conf.set(_TRUST_ORDER, "true")
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)}) "
        f"{f'SORTED BY ({', '.join(in_order)}) ' if in_order else ''}INTO {buckets} BUCKETS LOCATION '{folder}'"
    )
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


def stage_bucketed(df: DataFrame, name: str, buckets: int, *keys: str, then: Sequence[str] = ()) -> DataFrame:
    """As :func:`stage`, in buckets by a hash of ``keys``, each sorted by ``keys`` and ``then``.

    Rows that come in this hash's partitions make one file per bucket; work by ``keys`` then moves no rows, and work
    along ``then`` within them sorts none.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    table, order = f"lotframe_{uuid.uuid4().hex}", [*keys, *then]
    writer = df.write.bucketBy(buckets, *keys).sortBy(*order).format("parquet").option("path", path)
    with dropping_shuffles(spark):
        writer.option("compression", "zstd").saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")
    return bucketed_table(spark, path, df.schema, keys, buckets, order)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as a table scan."""
    path = new_folder(df.sparkSession, name)
    with dropping_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
