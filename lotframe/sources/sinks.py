"""Where lots and reports are written.

Lots are kept as a Parquet working copy, which appends read, and exported in the
format that is asked for. Types, spaces and line breaks survive in the first and
the CSV export keeps them too.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F

from ..operators.clean import append_lots, append_to_buckets, distinct_in_buckets, lot_key
from .flat import read_flat
from .manifest import _file_system, path_exists
from .staging import bucketed_table, stage


def run_timestamp(moment: dt.datetime | None = None) -> str:
    """One stamp for all files of a run."""
    return (moment or dt.datetime.now()).strftime("%Y%m%d_%H%M%S")


def lots_path(folder: str, timestamp: str) -> str:
    return f"{folder.rstrip('/')}/portfolio-{timestamp}"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions below an output path, oldest first."""
    if not path_exists(spark, path):
        return []
    system, hadoop_path = _file_system(spark, path)
    names = [status.getPath().getName() for status in system.listStatus(hadoop_path)]
    numbers = [int(match.group(1)) for match in (re.fullmatch(r"v(\d+)", name) for name in names) if match]
    return sorted(n for n in numbers if path_exists(spark, f"{path}/v{n}/_SUCCESS"))


def _write(df: DataFrame, path: str, file_format: str) -> None:
    writer = df.write.mode("overwrite")
    if file_format == "csv":
        writer = lossless_csv(writer)
    writer.format(file_format).save(path)


def lossless_csv(writer: DataFrameWriter) -> DataFrameWriter:
    """With a header, and cells as they are: the writer strips their ends unless told not to."""
    return (
        writer.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


#: Columns that are worked out for a lot and don't tell it from others.
METRICS = ("Years Held", "CAGR", "Beta")


@dataclass(frozen=True)
class WorkingCopy:
    """Lots in Parquet, bucketed by :func:`lot_key` over fields that the folder's name has a checksum of."""

    folder: str
    buckets: int
    checksum: str

    @classmethod
    def named(cls, version: str, fields: Sequence[str], buckets: int) -> WorkingCopy:
        parent, name = version.rsplit("/", 1)
        checksum = f"{zlib.crc32(json.dumps(sorted(fields)).encode()):08x}"
        return cls(f"{parent}/_working/{name}-{buckets}-{checksum}", buckets, checksum)

    @classmethod
    def of(cls, spark: SparkSession, version: str) -> WorkingCopy | None:
        """The complete copy of a version; null if it has none."""
        parent, name = version.rsplit("/", 1)
        if not path_exists(spark, f"{parent}/_working"):
            return None
        system, working = _file_system(spark, f"{parent}/_working")
        for status in system.listStatus(working):
            match = re.fullmatch(rf"{name}-(\d+)-([0-9a-f]{{8}})", status.getPath().getName())
            if match and path_exists(spark, f"{parent}/_working/{match[0]}/_SUCCESS"):
                return cls(f"{parent}/_working/{match[0]}", int(match[1]), match[2])
        return None

    def fits(self, fields: Sequence[str]) -> bool:
        return self == WorkingCopy.named(f"{self.folder.rsplit('/_working/', 1)[0]}/{self.version}", fields, self.buckets)

    @property
    def version(self) -> str:
        return self.folder.rsplit("/", 1)[1].split("-")[0]

    def write(self, lots: DataFrame, fields: Sequence[str]) -> None:
        """One file per bucket if the lots come in these buckets already. They stay in their order: sorted by key, like ones would lie apart."""
        table = f"lotframe_{uuid.uuid4().hex}"
        keyed = lots if "lot_key" in lots.columns else lots.withColumn("lot_key", lot_key(fields))
        writer = keyed.write.bucketBy(self.buckets, "lot_key").format("parquet").option("path", self.folder)
        writer = writer.option("compression", "zstd")
        writer.mode("overwrite").saveAsTable(table)
        lots.sparkSession.sql(f"DROP TABLE {table}")

    def read(self, spark: SparkSession) -> DataFrame:
        """A scan that knows its buckets."""
        schema = spark.read.parquet(self.folder).schema
        return bucketed_table(spark, self.folder, schema, ["lot_key"], self.buckets)


def latest_version(spark: SparkSession, path: str) -> str | None:
    versions = _versions(spark, path)
    return f"{path}/v{versions[-1]}" if versions else None


def read_lots(spark: SparkSession, path: str, fields: Sequence[str], file_format: str = "csv") -> DataFrame | None:
    """The latest complete version by field name, all text; null if there is none.

    A field that it lacks is null. A version without a working copy is read from
    its export.
    """
    found = latest_version(spark, path)
    if found is None:
        return None
    copy = WorkingCopy.of(spark, found)
    if copy is not None:
        lots = spark.read.parquet(copy.folder)
    else:
        lots = read_flat(spark, found) if file_format == "csv" else spark.read.format(file_format).load(found)
    known = set(lots.columns)
    return lots.select(
        *[(F.col(f"`{f}`") if f in known else F.lit(None)).cast("string").alias(f) for f in fields]
    )


def with_previous(
    lots: DataFrame, folder: str, timestamp: str, fields: Sequence[str], file_format: str = "csv"
) -> DataFrame:
    """The lots together with those already written under this timestamp.

    Earlier lots are read from their buckets and not shuffled, unless they were written with other fields.
    """
    spark, path = lots.sparkSession, lots_path(folder, timestamp)
    version = latest_version(spark, path)
    copy = WorkingCopy.of(spark, version) if version else None
    if copy is not None and copy.fits(fields):
        return append_to_buckets(copy.read(spark), lots, fields, copy.buckets)
    previous = read_lots(spark, path, fields, file_format)
    return lots if previous is None else append_lots(previous, lots, fields)


def write_lots(
    lots: DataFrame, folder: str, timestamp: str, file_format: str = "csv", buckets: int | None = None, as_set: bool = False
) -> str:
    """Write under ``portfolio-<timestamp>`` and return the path.

    Each write makes a new version directory, so an append can read the version
    before it and a failed job leaves that one in place. A version keeps the number of
    buckets of the one before; the first takes ``buckets``, else the session's shuffle partitions. ``as_set``: the
    lots have no metrics and no order to keep, and equal ones count as one; they are shuffled once and written once before the export.
    A column ``lot_key`` of them (:func:`lot_key`) is no field.
    """
    spark, path = lots.sparkSession, lots_path(folder, timestamp)
    versions = _versions(spark, path)
    target = f"{path}/v{versions[-1] + 1 if versions else 1}"
    before = WorkingCopy.of(spark, f"{path}/v{versions[-1]}") if versions else None
    fields = [name for name in lots.columns if name not in (*METRICS, "lot_key")]
    count = before.buckets if before else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    copy = WorkingCopy.named(target, fields, count)
    if as_set:
        copy.write(distinct_in_buckets(lots, fields, count), fields)
        whole = spark.read.parquet(copy.folder).select(*[F.col(f"`{name}`") for name in fields])
    elif before is not None and before.fits(fields):
        # An append comes from these buckets; the export reads the working copy, so the plan behind it runs once.
        copy.write(lots, fields)
        whole = spark.read.parquet(copy.folder).select(*[F.col(f"`{name}`") for name in lots.columns])
    else:
        # The export has the lots in their order, the working copy in their buckets, a file for each.
        whole = stage(lots, "lots")
        copy.write(whole.repartition(count, lot_key(fields)), fields)
    _write(whole, target, file_format)
    return target


def write_report(report: DataFrame, folder: str, timestamp: str) -> dict[str, str]:
    """The one-row metrics report as JSON, and as CSV with nested values as text."""
    base = f"{folder.rstrip('/')}/metrics_report_{timestamp}"
    paths = {"json": f"{base}.json", "csv": f"{base}.csv"}
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(paths["json"])
    kinds = dict(report.dtypes)
    flat = [
        F.to_json(name).alias(name) if kinds[name].startswith(("struct", "array", "map")) else F.col(name)
        for name in report.columns
    ]
    report.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(paths["csv"])
    return paths
