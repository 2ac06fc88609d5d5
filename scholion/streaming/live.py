"""Streams: idempotent merges per micro-batch, an acknowledged queue, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from scholion.operators.relational import first_wins


class VersionedTable:
    """A table as numbered parquet versions in one folder: a version is written whole, then named current."""

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _fs(self):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [n for n in names if n.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self) -> DataFrame:
        """The current version; an empty table before the first."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{known[-1]}")

    def commit(self, frame: DataFrame, version: int) -> None:
        """Write a version; where it or a later one is already complete nothing is done, so replays change nothing.

        The version before stays for its readers, older ones go.
        """
        known = self.versions()
        if known and version <= known[-1]:
            return
        frame.write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        fs, _ = self._fs()
        for old in known[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v{old}"), True)


def merge_stream(changes: DataFrame, target: VersionedTable, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Upsert every micro-batch of ``changes`` into ``target``: the latest row per key stays, whatever its batch."""

    def merge(batch: DataFrame, number: int) -> None:
        both = batch.select(*target.read().columns).unionByName(target.read())
        target.commit(first_wins(both, [key], [F.col(order).desc()]), number + 1)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def phases_stream(works: DataFrame, phases: list[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Run several merges in order over each micro-batch and its number (from 1), each of which reads what those before it wrote."""

    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for phase in phases:
                phase(kept, number + 1)
        finally:
            kept.unpersist()

    return works.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded_queue(log: DataFrame, key: str, seq: str, cancelled: str, source: str) -> DataFrame:
    """(key, seq, source): what is waiting in an append-only log, in order of first arrival.

    A cancelled key never waits again; its first source stays.
    """
    folded = log.groupBy(key).agg(F.min(seq).alias("seq"), F.min_by(source, seq).alias("source"), F.bool_or(cancelled).alias("_gone"))
    return folded.where("not _gone").drop("_gone")


def tumbling(events: DataFrame, time: str, size: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums per window and group; on a stream, ``late`` is the watermark beyond which rows are dropped."""
    timed = events.withWatermark(time, late) if late else events
    out = timed.groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, time: str, size: str, step: str, by: list[str], late: str | None = None) -> DataFrame:
    timed = events.withWatermark(time, late) if late else events
    out = timed.groupBy(F.window(time, size, step), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    timed = events.withWatermark(time, late) if late else events
    out = timed.groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("session_window.start").alias("start"), *by, "n", "total")


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """Each left row with the right value last known at its time: one union and one window instead of a range join."""
    both = left.withColumn("_left", F.lit(1)).withColumn("_known", F.lit(None).cast(dict(right.dtypes)[value])).unionByName(
        right.select(by, time, F.col(value).alias("_known")).withColumn("_left", F.lit(0)), allowMissingColumns=True
    )
    known = F.last("_known", ignorenulls=True).over(W.partitionBy(by).orderBy(time, "_left").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(f"{value}_known", known).where("_left = 1").drop("_left", "_known")
