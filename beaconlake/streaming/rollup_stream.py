"""Keeps the summary up to date as files of a signal arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from beaconlake.operators import rollup
from beaconlake.plans import schema


def start(spark: SparkSession, signal: str, source: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch's summary is a folder of its own under target, so a batch that is run again replaces itself."""
    rows = spark.readStream.schema(schema.SCHEMAS[signal]).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        rollup.summarise(signal, batch).write.mode("overwrite").parquet(f"{target}/part={signal}-{number}")

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def read(spark: SparkSession, target: str) -> DataFrame:
    """The summary over all batches so far."""
    return rollup.merge(spark.read.parquet(target))
