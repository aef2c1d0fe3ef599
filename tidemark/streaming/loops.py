"""The running forecaster: a loop over micro-batches that stores samples, forecasts, and scores what has come due."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cycle import forecast_cycle
from tidemark.operators.evaluate import matured
from tidemark.schema import SAMPLES, SERIES, SNAPSHOTS

#: Columns of the stores besides the batch's number; a snapshot also has its contract's interval.
FORECASTS = f"{SNAPSHOTS}, interval_s bigint"
UNAVAILABLE = "cluster_id string, workload_id string, source_fingerprint string, generated_at timestamp, status string"
EVALUATED = "snapshot_id bigint, workload_id string, source_fingerprint string, upper double, realized double, covered boolean, underpredicted boolean, absolute_error double, complete boolean"


@dataclass
class LastGood:
    """A side table that is read anew with each batch and replaced whole; where a read fails, the last good version stays.

    A version is written to ``folder`` before it is used, so that a batch sees
    one state of the table however long it runs, and a source that changes or
    fails meanwhile is no matter. The version before goes once the next one
    is there. Without any good version the failure is the caller's.
    """

    spark: SparkSession
    load: Callable[[], DataFrame]
    folder: str
    version: int = 0
    fault: str | None = None
    current: DataFrame | None = field(default=None, repr=False)

    def refresh(self) -> DataFrame:
        path = f"{self.folder}/{self.version + 1}"
        try:
            fresh = self.load()
            fresh.write.mode("overwrite").parquet(path)
        except (PySparkException, Py4JError, OSError) as e:
            self.fault = str(e)
            if self.current is None:
                raise
            return self.current
        before, self.version, self.fault = f"{self.folder}/{self.version}", self.version + 1, None
        self.current = self.spark.read.schema(fresh.schema).parquet(path)
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        return self.current


def stored(spark: SparkSession, folder: str, name: str, ddl: str, before: int | None = None) -> DataFrame:
    """A store's rows with their batch's number, up to and without that of ``before``; empty where nothing was written yet."""
    path = f"{folder}/{name}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = f"{ddl}, batch bigint"
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


@dataclass
class Forecaster:
    """What a batch does, for ``foreachBatch``: samples to their store, a decision per contract, and the scores of snapshots that have come due.

    All is written under the number of the batch, in place of what that number
    wrote before: a batch that is run again, after a crash between its writes
    or from a checkpoint, leaves one copy of each row. Contracts, state and
    models are read anew with each batch and kept if that fails. ``clock``
    says what time it is at a batch, by default that of its latest sample;
    ``settings`` go to ``forecast_cycle``.
    """

    folder: str
    contracts: LastGood
    state: LastGood
    models: LastGood | None = None
    clock: Callable[[DataFrame], Any] | None = None
    settings: dict[str, Any] = field(default_factory=dict)

    def samples(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The newest value of each time of a series."""
        rows = stored(spark, self.folder, "samples", SAMPLES, before)
        return rows.groupBy("cluster_id", *SERIES, "observed_at").agg(F.max_by("observed_value", "batch").alias("observed_value"))

    def snapshots(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        return stored(spark, self.folder, "snapshots", FORECASTS, before)

    def evaluated(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        return stored(spark, self.folder, "evaluated", EVALUATED, before)

    def _put(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Of a key that a batch has twice, the larger value stands: there is no order within a batch.
        own = batch.groupBy("cluster_id", *SERIES, "observed_at").agg(F.max("observed_value").alias("observed_value"))
        self._put(own, "samples", number)
        contracts, state = self.contracts.refresh(), self.state.refresh()
        models = self.models.refresh() if self.models else None
        at = self.clock(batch) if self.clock else spark.read.parquet(f"{self.folder}/samples/batch={number}").agg(F.max("observed_at")).first()[0]
        if at is None:  # an empty batch has no time of its own
            return
        now = F.lit(at).cast("timestamp")
        samples = self.samples(spark, number + 1)
        decided = forecast_cycle(samples, contracts, state, now, models=models, **self.settings)
        clusters = contracts.select(*SERIES, "cluster_id", "interval_s").where("cluster_id is not null").dropDuplicates(SERIES)
        rows = decided.join(clusters, SERIES, "left").withColumn("generated_at", now)
        self._put(rows.select("cluster_id", *SERIES, "generated_at", "status", "latest", "engine", (F.col("steps") * F.col("interval_s")).alias("horizon_s"), "p50", "upper", "surge", "safe", "reason", "interval_s"), "decided", number)
        told = spark.read.parquet(f"{self.folder}/decided/batch={number}")
        blank = {"realized": "double", "evaluated_at": "timestamp", "covered": "boolean", "underpredicted": "boolean", "absolute_error": "double"}
        ok = told.where("status = 'ok'").select(
            F.xxhash64(*SERIES, F.lit(number)).alias("snapshot_id"), "cluster_id", *SERIES, "generated_at", F.col("latest").alias("observed_at"), "engine", "horizon_s", "p50", "upper", "surge", "safe", "reason", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()], "interval_s"
        )
        self._put(ok, "snapshots", number)
        self._put(told.where("status <> 'ok'").select("cluster_id", *SERIES, "generated_at", "status"), "unavailable", number)
        open_ = self.snapshots(spark, number).drop("batch").join(self.evaluated(spark, number).select("snapshot_id"), "snapshot_id", "left_anti")
        self._put(matured(open_, samples, now, F.col("interval_s")), "evaluated", number)


def run(stream: DataFrame, forecaster: Forecaster, checkpoint: str, every: str | None = None):
    """The loop: over what is there now, or every so often."""
    writer = stream.writeStream.foreachBatch(forecaster).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
