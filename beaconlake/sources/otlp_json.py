"""OTLP/JSON log payloads as rows of the log table (beyond the reference, which leaves writing to others)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.plans import schema

_ANY = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRIBUTES = f"array<struct<key:string,value:{_ANY}>>"
PAYLOAD = (
    f"resourceLogs array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeLogs:array<struct<"
    f"scope:struct<name:string,version:string,attributes:{_ATTRIBUTES}>,logRecords:array<struct<"
    "timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,eventName:string,traceId:string,spanId:string,"
    f"flags:bigint,droppedAttributesCount:bigint,body:{_ANY},attributes:{_ATTRIBUTES}>>>>>>"
)


def _text(value: Column) -> Column:
    return F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"].cast("string"), value["boolValue"].cast("string"))


def _json(attributes: Column) -> Column:
    """Attributes as one JSON object of texts; of a key that occurs twice the first stays."""
    pairs = F.filter(F.coalesce(attributes, F.array().cast(_ATTRIBUTES)), lambda a: a["key"].isNotNull())
    first = F.filter(pairs, lambda a, i: F.array_position(F.transform(pairs, lambda b: b["key"]), a["key"]) == i + 1)
    return F.to_json(F.map_from_entries(F.transform(first, lambda a: F.struct(a["key"], _text(a["value"])))))


def _attribute(attributes: Column, key: str) -> Column:
    return F.get(F.transform(F.filter(attributes, lambda a: a["key"] == key), lambda a: _text(a["value"])), 0)


def _time(nanos: Column) -> Column:
    return F.timestamp_micros(F.floor(nanos.try_cast("bigint") / 1000).cast("bigint")).cast("timestamp_ntz")


def logs(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Rows of the log table from payloads, one JSON text a row; texts that do not parse give none."""
    got = payloads.select(F.from_json(column, PAYLOAD).alias("p"))
    got = got.select(F.explode("p.resourceLogs").alias("r"))
    got = got.select(F.col("r.resource.attributes").alias("resource"), F.explode("r.scopeLogs").alias("s"))
    got = got.select("resource", F.col("s.scope").alias("scope"), F.explode("s.logRecords").alias("log"))
    at = F.coalesce(F.col("log.timeUnixNano"), F.col("log.observedTimeUnixNano"))
    out = got.select(
        _time(at).alias("time_unix_nano"), _time(F.col("log.observedTimeUnixNano")).alias("observed_time_unix_nano"),
        F.lower("log.traceId").alias("trace_id"), F.lower("log.spanId").alias("span_id"),
        *(_attribute(F.col("resource"), f"service.{k.replace('_', '.')}").alias(f"service_{k}") for k in ("name", "namespace", "instance_id")),
        F.col("log.severityNumber").alias("severity_number"), F.col("log.severityText").alias("severity_text"), F.col("log.eventName").alias("event_name"),
        _text(F.col("log.body")).alias("body"), _json(F.col("resource")).alias("resource_attributes"),
        F.col("scope.name").alias("scope_name"), F.col("scope.version").alias("scope_version"), _json(F.col("scope.attributes")).alias("scope_attributes"),
        _json(F.col("log.attributes")).alias("log_attributes"), F.coalesce("log.droppedAttributesCount", F.lit(0)).alias("dropped_attributes_count"),
        F.coalesce("log.flags", F.lit(0)).alias("flags"), at.try_cast("bigint").alias("time_nanos"),
    )
    return schema.conform(out, schema.LOGS, ("time_nanos",))
