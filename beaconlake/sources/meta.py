"""What a store says of itself: its layout's version, and what wrote it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

import beaconlake
from beaconlake.plans import schema

TABLE = "store_meta"


def read(spark: SparkSession, root: str) -> dict[str, str]:
    """Keys and values; a store that was never stamped has none. A handful of rows."""
    try:
        rows = spark.read.parquet(f"{root}/{TABLE}").collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return {}
        raise
    return {r["key"]: r["value"] for r in rows}


def stamp(spark: SparkSession, root: str) -> dict[str, str]:
    """Checks the store's version and writes what has changed since it was last stamped; raises on a version out of range."""
    have = read(spark, root)
    want = have | {
        "schema_version": str(schema.check_version(have.get("schema_version"))),
        "oldest_schema_version": str(schema.OLDEST_VERSION), "schema_fingerprint": schema.fingerprint(), "written_by": beaconlake.__version__,
    }
    if want != have:
        spark.createDataFrame(sorted(want.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{TABLE}")
    return want
