"""Where tables come from: partitioned Parquet, or views over the driver's test tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.plans import schema

# Dialect-neutral: the same text runs here and in DuckDB.
FIXTURE_SQL = {
    schema.LOGS: """
SELECT ts AS time_unix_nano, ts AS observed_time_unix_nano,
 md5(concat('t', cast(floor(event_id / 10) as bigint))) AS trace_id,
 substr(md5(concat('s', event_id)),1,16) AS span_id,
 concat('svc-', user_id % 5) AS service_name, 'demo' AS service_namespace, concat('inst-', user_id % 17) AS service_instance_id,
 CASE event_type WHEN 'error' THEN 17 ELSE 9 END AS severity_number,
 CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS severity_text,
 event_type AS event_name,
 concat(event_type, ' event ', event_id, ' for user ', user_id) AS body,
 CASE WHEN user_id % 11 = 0 THEN '{}' ELSE concat('{"deployment.environment":"env-', user_id % 3, '","host.name":"host-', user_id % 7, '"}') END AS resource_attributes,
 'events' AS scope_name, '1.0' AS scope_version, '{}' AS scope_attributes,
 concat('{"http.method":"', CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END, '","http.route":"/', event_type, '","http.status_code":', CASE event_type WHEN 'error' THEN 500 ELSE 200 END, '}') AS log_attributes,
 cast(0 as bigint) AS dropped_attributes_count, cast(0 as bigint) AS flags
FROM events""",
    schema.SPANS: """
SELECT l_shipdate AS start_time_unix_nano, cast(l_quantity * 1000000 as bigint) AS duration_time_unix_nano,
 md5(concat('o', l_orderkey)) AS trace_id, substr(md5(concat('l', l_orderkey, '-', l_linenumber, '-', l_partkey)),1,16) AS span_id,
 concat('supplier-', l_suppkey % 10) AS service_name, concat('ship ', l_returnflag, l_linestatus) AS name,
 cast(l_linenumber % 6 as int) AS kind, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS status_code,
 concat('{"deployment.environment":"env-', l_suppkey % 3, '"}') AS resource_attributes,
 concat('{"http.request.method":"GET","http.response.status_code":', CASE l_returnflag WHEN 'R' THEN 500 ELSE 200 END, ',"http.route":"/part/', l_partkey % 50, '"}') AS span_attributes
FROM lineitem""",
    schema.GAUGE: """
SELECT ts AS time_unix_nano, concat('event.value.', event_type) AS name, 'd' AS description, '1' AS unit,
 CASE WHEN event_id % 4 = 0 THEN event_id % 100 END AS int_value, CASE WHEN event_id % 4 <> 0 THEN value END AS double_value,
 concat('svc-', user_id % 5) AS service_name, concat('{"deployment.environment":"env-', user_id % 3, '"}') AS resource_attributes,
 concat('{"state":"s', user_id % 4, '"}') AS metric_attributes FROM events""",
    schema.SUM: """
SELECT ts AS time_unix_nano, 'event.count' AS name, 'd' AS description, '1' AS unit,
 event_id AS int_value, cast(null as double) AS double_value,
 concat('svc-', user_id % 5) AS service_name, concat('{"deployment.environment":"env-', user_id % 3, '"}') AS resource_attributes,
 concat('{"state":"s', user_id % 4, '"}') AS metric_attributes FROM events""",
}
FIXTURE_SOURCE = {schema.LOGS: "events", schema.SPANS: "lineitem", schema.GAUGE: "events", schema.SUM: "events"}

#: Event days may be off by a time zone in a writer's partitions.
_DAY = timedelta(days=1)


#: The column of written spans that a search for a trace filters on.
TRACE_KEY = "trace_key"


class Tables:
    """Lazy tables by name. Times are naive UTC, so the session's zone must be."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        raise NotImplementedError

    def within(self, name: str, start: datetime, end: datetime) -> DataFrame:
        """The rows of a signal from start on and before end, both cut to milliseconds as clients mean them.

        The predicate stands on the bare column, so it is pushed to the scan; a table that is laid out by
        event_date also gets a predicate on that, which prunes partitions.
        """
        at = schema.EVENT_TIME[name]
        cut = lambda t: F.lit(t.replace(microsecond=t.microsecond // 1000 * 1000)).cast("timestamp_ntz")
        df = self.table(name)
        rows = df.filter((F.col(at) >= cut(start)) & (F.col(at) < cut(end)))
        if "event_date" in df.columns:
            rows = rows.filter(F.col("event_date").between(F.lit((start - _DAY).date()), F.lit((end + _DAY).date())))
        return rows

    def summary(self) -> DataFrame:
        return self.table(schema.SUMMARY)

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], schema.SCHEMAS[name])

    def ready(self) -> None:
        """Raises unless the log table can be read. No rows are."""
        schema.assert_schema(self.table(schema.LOGS), schema.LOGS)


class ParquetTables(Tables):
    """A folder of tables, each a folder of Parquet files, by event_date or not. Absent tables are empty."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark)
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        try:
            df = self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return self.empty(name)
            raise
        return schema.conform(df, name, ("event_date", "time_nanos", TRACE_KEY) if name != schema.SUMMARY else ())

    def write(self, name: str, df: DataFrame, mode: str = "append") -> None:
        """By day of event, so that a time range prunes to its days; rows of a day come from one shuffle range or more.

        Spans also get their trace id in lower case as a column, and files are in order of it, with a bloom filter, so
        that a search for one trace reads few row groups of each file.
        """
        df = schema.conform(df, name)
        if name != schema.SUMMARY:
            at = F.col(schema.EVENT_TIME[name])
            df = df.withColumn("event_date", at.cast("date")).repartitionByRange("event_date", at)
        if name == schema.SPANS:
            df = df.withColumn(TRACE_KEY, F.lower(F.coalesce("trace_id", F.lit("")))).sortWithinPartitions("event_date", TRACE_KEY)
        out = df.write.mode(mode).partitionBy("event_date").option(f"parquet.bloom.filter.enabled#{TRACE_KEY}", "true")
        out.parquet(f"{self.root}/{name}")

    def create_missing(self) -> None:
        for name in (*schema.SIGNALS, schema.SUMMARY):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)


class FixtureTables(Tables):
    """The four signals as views over the driver's events and lineitem."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__(spark)
        self.sf_dir = sf_dir
        self._summary: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        if name == schema.SUMMARY:
            if self._summary is None:
                from beaconlake.operators.rollup import rollup

                self._summary = rollup(self)
            return self._summary
        source = FIXTURE_SOURCE[name]
        view = f"fixture_{source}_{uuid.uuid4().hex}"
        self.spark.read.parquet(f"{self.sf_dir}/{source}.parquet").createOrReplaceTempView(view)
        df = self.spark.sql(FIXTURE_SQL[name].replace(f"FROM {source}", f"FROM {view}"))
        self.spark.catalog.dropTempView(view)
        return schema.conform(df, name)


class DictTables(Tables):
    """Given DataFrames by name; tables that are not given are empty."""

    def __init__(self, spark: SparkSession, **tables: DataFrame) -> None:
        super().__init__(spark)
        self.given = tables

    def table(self, name: str) -> DataFrame:
        return schema.conform(self.given[name], name) if name in self.given else self.empty(name)
