import json
from datetime import datetime

import pytest

from beaconlake.plans import schema
from beaconlake.sources import meta, otlp_json


def test_otlp_json_logs(spark):
    payload = {
        "resourceLogs": [{
            "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}, {"key": "service.instance.id", "value": {"intValue": "7"}}]},
            "scopeLogs": [{"scope": {"name": "lib"}, "logRecords": [
                {"timeUnixNano": "1700000000123456789", "severityText": "INFO", "severityNumber": 9, "traceId": "AB", "body": {"stringValue": "hi"}, "attributes": [{"key": "http.status_code", "value": {"intValue": "200"}}, {"key": "http.status_code", "value": {"intValue": "500"}}]},
                {"observedTimeUnixNano": "1700000001000000000", "body": {"boolValue": True}},
            ]}],
        }]
    }
    df = spark.createDataFrame([(json.dumps(payload),), ("{broken",), ("{}",), (None,)], "value string")
    rows = otlp_json.logs(df).orderBy("time_unix_nano").collect()
    assert [r["body"] for r in rows] == ["hi", "true"]
    first = rows[0]
    assert first["time_unix_nano"] == datetime(2023, 11, 14, 22, 13, 20, 123456) and first["time_nanos"] == 1700000000123456789
    assert (first["service_name"], first["service_instance_id"], first["trace_id"], first["scope_name"]) == ("api", "7", "ab", "lib")
    assert json.loads(first["log_attributes"]) == {"http.status_code": "200"}
    assert otlp_json.logs(df).drop("time_nanos").schema.simpleString() == schema.SCHEMAS[schema.LOGS].simpleString()


def test_store_meta(spark, tmp_path):
    root = str(tmp_path)
    assert meta.read(spark, root) == {}
    first = meta.stamp(spark, root)
    assert first["schema_version"] == "3" and first["schema_fingerprint"] == schema.fingerprint() and len(schema.fingerprint()) == 16
    files = sorted(p.name for p in (tmp_path / meta.TABLE).iterdir())
    assert meta.stamp(spark, root) == first and sorted(p.name for p in (tmp_path / meta.TABLE).iterdir()) == files, "nothing has changed, so nothing is written"
    spark.createDataFrame([("schema_version", "9")], "key string, value string").write.mode("overwrite").parquet(f"{root}/{meta.TABLE}")
    with pytest.raises(schema.SchemaError):
        meta.stamp(spark, root)


def test_columns_are_checked(spark):
    schema.assert_schema(spark.createDataFrame([], schema.SCHEMAS[schema.SUM]), schema.SUM)
    with pytest.raises(schema.SchemaError, match="lacks"):
        schema.assert_schema(spark.createDataFrame([], "a int"), schema.SUM)
    wrong = spark.createDataFrame([], schema.SCHEMAS[schema.SUM]).withColumn("name", __import__("pyspark").sql.functions.lit(1))
    with pytest.raises(schema.SchemaError, match="name is int"):
        schema.assert_schema(wrong, schema.SUM)


def test_a_written_store_is_searched_by_trace(spark, sf, tmp_path):
    """The id reaches the scan, whatever case it was written in, and the rows are those of the plain search."""
    from datetime import datetime

    from pyspark.sql import functions as F

    from beaconlake.operators import compile as c
    from beaconlake.plans import schema
    from beaconlake.sources.tables import DictTables, FixtureTables, ParquetTables

    spans = FixtureTables(spark, sf).table(schema.SPANS).withColumn("trace_id", F.when(F.col("kind") > 2, F.upper("trace_id")).otherwise(F.col("trace_id")))
    store = ParquetTables(spark, str(tmp_path))
    store.write(schema.SPANS, spans)
    some = spans.select(F.lower("trace_id").alias("t")).orderBy("t").first()["t"]
    bounds = datetime(1995, 1, 1), datetime(2002, 1, 1)
    found = c.trace(some.upper(), *bounds, store)
    assert f"EqualTo(trace_key,{some})" in found._jdf.queryExecution().executedPlan().toString()
    plain = c.trace(some, *bounds, DictTables(spark, **{schema.SPANS: spans}))
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and found.count()


def test_catalogs_that_are_not_read_faithfully_are_refused(spark, tmp_path):
    from beaconlake.plans import schema
    from beaconlake.sources.catalogs import CatalogError, CatalogTables

    tables = spark.createDataFrame([(1, schema.LOGS, None, "", True)], "table_id long, table_name string, end_snapshot long, path string, path_is_relative boolean")
    files = spark.createDataFrame([(1, "a.parquet", None)], "table_id long, path string, end_snapshot long")
    none = spark.createDataFrame([], "table_id long, end_snapshot long")
    plain = {"ducklake_table": tables, "ducklake_data_file": files}
    read = lambda **more: CatalogTables(spark, (plain | more).__getitem__, str(tmp_path)).live_files(schema.LOGS)
    assert read() == read(ducklake_delete_file=none) == [f"{tmp_path}/a.parquet"]
    with pytest.raises(CatalogError, match="delete files"):
        read(ducklake_delete_file=spark.createDataFrame([(1, None)], "table_id long, end_snapshot long"))
    with pytest.raises(CatalogError, match="relative"):
        read(ducklake_table=tables.selectExpr("table_id", "table_name", "end_snapshot", "'logs/' AS path", "path_is_relative"))
