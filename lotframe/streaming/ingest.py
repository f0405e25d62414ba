"""Reports that keep arriving in a folder.

Two streams follow one another. The first turns every batch of new files into lots and
lands them, repeats included, in a directory of its own. The second reads what has
landed and lets each lot through once: its state store holds the lots that have been
seen, partitioned by them, so a batch costs what it brings and no earlier output is
read. State lives in RocksDB beside the executors and its changes in the checkpoint.

A replayed batch finds its directory complete and leaves it; a directory that was not
complete is written anew, and lots that come twice by that stop at the state store.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import canonical, clean
from ..plans.ingest import ingest
from ..sources.grid import read_listed
from ..sources.manifest import path_exists
from ..sources.staging import discarding_stages, stage

_FILES_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
_STORE = "spark.sql.streaming.stateStore."
#: Settings of the state store, where the session has none of its own.
STATE_SETTINGS = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}rocksdb.changelogCheckpointing.enabled": "true",
}


def land_batch(
    files: DataFrame, batch_id: int, landing: str, fields: Sequence[str], synonyms: dict | None = None
) -> None:
    """Lots of one batch of files, in the directory of that batch."""
    target = f"{landing}/batch_id={batch_id}"
    spark = files.sparkSession
    if path_exists(spark, f"{target}/_SUCCESS"):
        return
    with discarding_stages(spark):
        lots = ingest(stage(read_listed(files), "grid"), fields, synonyms)
        lots.write.mode("overwrite").parquet(target)


def unseen_lots(landed: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Each lot of the stream once, null equal to null."""
    return landed.select(*map(clean.quoted, fields)).dropDuplicates(list(fields))


@dataclass
class ReportStream:
    """The two running queries; ``finish`` waits for those that end by themselves."""

    landing: StreamingQuery
    unseen: StreamingQuery

    def finish(self, timeout: float | None = None) -> None:
        for query in (self.landing, self.unseen):
            query.awaitTermination(timeout) if timeout else query.awaitTermination()

    def stop(self) -> None:
        self.landing.stop()
        self.unseen.stop()


def stream_reports(
    spark: SparkSession,
    folder: str,
    sink: str,
    checkpoint: str,
    fields: Sequence[str] = canonical.FULL_FIELDS,
    synonyms: dict | None = None,
    files_per_batch: int = 10_000,
    available_now: bool = False,
) -> ReportStream:
    """Watch ``folder`` and append the lots of new reports, each once, to the Parquet ``sink``.

    Lots land in ``checkpoint``/landed on the way. With ``available_now`` the first stream ends
    before the second starts, so that all that is there goes through.
    """
    landed = f"{checkpoint}/landed"
    files = (
        spark.readStream.format("binaryFile")
        .schema(_FILES_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    landing = (
        files.writeStream.option("checkpointLocation", f"{checkpoint}/landing")
        .foreachBatch(lambda batch, batch_id: land_batch(batch, batch_id, landed, fields, synonyms))
        .trigger(**_trigger(available_now))
        .start()
    )
    if available_now:
        landing.awaitTermination()
    types = ", ".join(f"`{field}` string" for field in fields)
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        if before[name] is None or name.endswith("providerClass") and before[name].endswith("HDFSBackedStateStoreProvider"):
            spark.conf.set(name, value)
    try:
        lots = spark.readStream.schema(types).option("recursiveFileLookup", True).parquet(_made(spark, landed))
        unseen = (
            unseen_lots(lots, fields)
            .writeStream.format("parquet")
            .outputMode("append")
            .option("path", sink)
            .option("checkpointLocation", f"{checkpoint}/unseen")
            .trigger(**_trigger(available_now))
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return ReportStream(landing, unseen)


def _trigger(available_now: bool) -> dict:
    return {"availableNow": True} if available_now else {"processingTime": "0 seconds"}


def _made(spark: SparkSession, folder: str) -> str:
    """The folder, made if it is not there: a stream can't watch what doesn't exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder
