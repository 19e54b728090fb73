"""Freshness, row counts and sizes of the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.plans import schema
from beaconlake.sources.tables import Tables


def freshness(tables: Tables) -> DataFrame:
    """The latest event time by signal, as micros since the epoch; null for empty tables."""
    each = (
        tables.table(s).agg(schema.epoch_micros(F.max(schema.EVENT_TIME[s])).alias("latest_micros")).select(F.lit(s).alias("signal"), "latest_micros")
        for s in schema.SIGNALS
    )
    return reduce(DataFrame.unionByName, each)


def logical_rows(tables: Tables) -> DataFrame:
    each = (tables.table(s).agg(F.count("*").alias("rows")).select(F.lit(s).alias("signal"), "rows") for s in schema.SIGNALS)
    return reduce(DataFrame.unionByName, each)


def physical_bytes(spark: SparkSession, path: str) -> int:
    """Bytes under a folder of any file system; 0 if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getContentSummary(at).getLength() if store.exists(at) else 0
