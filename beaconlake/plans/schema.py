"""Tables, their columns, and the version of their layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS, STR, INT, LONG, DOUBLE = T.TimestampNTZType(), T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

LOGS, SPANS, GAUGE, SUM, SUMMARY = "otlp_logs", "otlp_traces", "otlp_metrics_gauge", "otlp_metrics_sum", "metadata_summary"
SIGNALS = (LOGS, SPANS, GAUGE, SUM)


def _struct(columns: str) -> T.StructType:
    kinds = {"ts": TS, "str": STR, "int": INT, "long": LONG, "double": DOUBLE, "bool": T.BooleanType(), "date": T.DateType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (c.split(":") for c in columns.split())])


_SERVICE = "service_name:str service_namespace:str service_instance_id:str"
_POINT = (
    "time_unix_nano:ts start_time_unix_nano:ts name:str description:str unit:str int_value:long double_value:double "
    f"{_SERVICE} resource_attributes:str scope_name:str scope_version:str scope_attributes:str metric_attributes:str "
    "flags:long exemplars_json:str"
)
# The column names of the stored tables.
SCHEMAS: dict[str, T.StructType] = {
    LOGS: _struct(
        f"time_unix_nano:ts observed_time_unix_nano:ts trace_id:str span_id:str {_SERVICE} severity_number:int severity_text:str "
        "event_name:str body:str resource_attributes:str scope_name:str scope_version:str scope_attributes:str log_attributes:str "
        "dropped_attributes_count:long flags:long"
    ),
    SPANS: _struct(
        f"start_time_unix_nano:ts duration_time_unix_nano:long trace_id:str span_id:str parent_span_id:str trace_state:str {_SERVICE} "
        "name:str kind:int status_code:int status_status_message:str resource_attributes:str scope_name:str scope_version:str "
        "scope_attributes:str span_attributes:str events_json:str links_json:str dropped_attributes_count:long "
        "dropped_events_count:long dropped_links_count:long flags:long"
    ),
    GAUGE: _struct(_POINT),
    SUM: _struct(_POINT + " aggregation_temporality:int is_monotonic:bool"),
    SUMMARY: _struct(
        "signal:str event_date:date kind:str name:str value:str metric_type:str metric_unit:str metric_description:str "
        "service_name:str deployment_environment:str severity_text:str row_count:long first_seen:ts last_seen:ts"
    ),
}
EVENT_TIME = {LOGS: "time_unix_nano", SPANS: "start_time_unix_nano", GAUGE: "time_unix_nano", SUM: "time_unix_nano"}

VERSION, OLDEST_VERSION = 3, 3


class SchemaError(Exception):
    pass


def check_version(stored: str | None) -> int:
    """The layout version of a store; a new store has none and gets the current one."""
    if stored is None:
        return VERSION
    try:
        version = int(stored)
    except ValueError:
        raise SchemaError(f"schema version {stored!r} is not a number") from None
    if not OLDEST_VERSION <= version <= VERSION:
        raise SchemaError(f"schema version {version} is not between {OLDEST_VERSION} and {VERSION}")
    return version


def conform(df: DataFrame, table: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """df with the table's columns, in order and typed; those it lacks are null. extra columns stay where df has them."""
    have = set(df.columns)

    def column(f: T.StructField) -> Column:
        return (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)

    return df.select(*map(column, SCHEMAS[table].fields), *[c for c in extra if c in have])


def assert_schema(df: DataFrame, table: str) -> None:
    """Raises unless df has all columns of the table in their types. Reads no rows."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in SCHEMAS[table].fields:
        if f.name not in have:
            raise SchemaError(f"{table} lacks the column {f.name}")
        if have[f.name] != f.dataType:
            raise SchemaError(f"{table}.{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def fingerprint() -> str:
    """A short name for the layout of all tables: FNV-1a over their columns and types."""
    h = 0xCBF29CE484222325
    for table in sorted(SCHEMAS):
        for f in SCHEMAS[table].fields:
            for byte in f"{table}.{f.name}:{f.dataType.simpleString()};".encode():
                h = (h ^ byte) * 0x100000001B3 & (1 << 64) - 1
    return f"{h:016x}"
