"""The registered queries over the test tables, and the same in DuckDB's SQL.

Times are micros or seconds since the epoch, so that engines compare alike; label columns are text; means
and rates are rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.functions import labels
from beaconlake.operators import compile as compiled
from beaconlake.operators import discovery, health, rollup
from beaconlake.plans import logql, promql, schema, traceql
from beaconlake.plans.model import MetricPlan, Window
from beaconlake.sources.catalogs import storage_layout
from beaconlake.sources.tables import FIXTURE_SQL, FixtureTables

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "logs_select_eq_contains"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LOG_WINDOW = Window(datetime(2024, 1, 5), datetime(2024, 1, 25))
METRIC_WINDOW = Window(datetime(2024, 1, 1), datetime(2024, 2, 1))
TRACE_WINDOW = Window(datetime(1996, 1, 1), datetime(1997, 1, 1))
DAY = 86_400


def _with(*signals: str) -> str:
    return "WITH " + ",\n".join(f"{s} AS ({FIXTURE_SQL[s]})" for s in signals) + "\n"


def _between(column: str, w: Window) -> str:
    return f"{column} >= TIMESTAMP '{w.start}' AND {column} < TIMESTAMP '{w.end}'"


def _attr(column: str, key: str) -> str:
    return f"json_extract_string({column}, '$.\"{key}\"')"


def _int(text: str) -> str:
    return f"try_cast({text} AS INTEGER)"


ENV, HOST = _attr("resource_attributes", "deployment.environment"), _attr("resource_attributes", "host.name")
METHOD = f"coalesce({_attr('log_attributes', 'http.request.method')}, {_attr('log_attributes', 'http.method')})"
STATUS = f"coalesce({_int(_attr('log_attributes', 'http.response.status_code'))}, {_int(_attr('log_attributes', 'http.status_code'))})"
SPAN_METHOD = f"coalesce({_attr('span_attributes', 'http.request.method')}, {_attr('span_attributes', 'http.method')})"
SPAN_STATUS = f"coalesce({_int(_attr('span_attributes', 'http.response.status_code'))}, {_int(_attr('span_attributes', 'http.status_code'))})"


# Logs


def _log_sql(where: str, limit: int, order: str = "DESC") -> str:
    return (
        _with(schema.LOGS)
        + f"""SELECT epoch_us(time_unix_nano) AS ts_us, body, service_name, service_namespace, service_instance_id,
 {ENV} AS deployment_environment, {HOST} AS host_name, scope_name, severity_text, lower(trace_id) AS trace_id, lower(span_id) AS span_id,
 {_attr('log_attributes', 'http.route')} AS http_route, {METHOD} AS http_method, cast({STATUS} AS VARCHAR) AS http_status_code
FROM otlp_logs WHERE {_between('time_unix_nano', LOG_WINDOW)} AND {where}
ORDER BY time_unix_nano {order} NULLS LAST, body, span_id LIMIT {limit + 1}"""
    )


def _log(name: str, text: str, where: str, limit: int = 1000, direction: str = "backward") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = compiled.logs(logql.parse(text, LOG_WINDOW, limit, direction), FixtureTables(spark, sf_dir))
        return df.select(schema.epoch_micros(F.col("timestamp")).alias("ts_us"), *df.columns[1:])

    QUERIES[name] = query
    ORACLE_SQL[name] = _log_sql(where, limit, "ASC" if direction == "forward" else "DESC")


_log(FLAGSHIP, '{service_name="svc-1"} |= "click"', "coalesce(service_name, '') = 'svc-1' AND body ILIKE '%click%'", 100)
_log("logs_label_eq_empty", '{deployment_environment=""}', f"coalesce({ENV}, '') = ''")
_log("logs_label_eq_alias", '{resource.service.name="svc-3", host-name="host-2"}', f"coalesce(service_name, '') = 'svc-3' AND coalesce({HOST}, '') = 'host-2'")
_log("logs_label_neq_null", '{deployment_environment!="env-1"}', f"coalesce({ENV}, '') <> 'env-1'")
_log("logs_label_neq_empty", '{host.name!=""}', f"coalesce({HOST}, '') <> ''")
_log("logs_label_regex", '{service_name=~"vc-[12]"}', "regexp_matches(coalesce(service_name, ''), 'vc-[12]')")
_log("logs_label_not_regex", '{service_name!~"-[0-3]$"}', "NOT regexp_matches(coalesce(service_name, ''), '-[0-3]$')")
_log("logs_regex_noop", '{service_name=~".*", severity_text="ERROR"}', "coalesce(severity_text, '') = 'ERROR'")
_log("logs_not_regex_false", '{service_name!~".*"}', "FALSE")
_log("logs_int_label", '{http_status_code="500"}', f"coalesce(cast({STATUS} AS VARCHAR), '') = '500'")
_log("logs_json_label", '{http.method="POST", http_route=~"click|view"}', f"coalesce({METHOD}, '') = 'POST' AND regexp_matches(coalesce({_attr('log_attributes', 'http.route')}, ''), 'click|view')")
_log("logs_text_and", '{} |= "ERROR AND user 1"', "body ILIKE '%ERROR%' AND body ILIKE '%user 1%'")
_log("logs_text_or", '{} |= "signup OR purchase"', "(body ILIKE '%signup%' OR body ILIKE '%purchase%')")
_log("logs_text_wildcard", '{} |= "view%user 1_"', "body ILIKE '%view%user 1_%'")
_log("logs_body_regex", '{severity_text="INFO"} |~ "event [0-9]*7 "', "coalesce(severity_text, '') = 'INFO' AND regexp_matches(coalesce(body, ''), 'event [0-9]*7 ')")
_log("logs_forward_limit", '{service_name="svc-2"}', "coalesce(service_name, '') = 'svc-2'", 50, "forward")
_log("logs_trace_id", '{trace_id=~"^0"}', "regexp_matches(coalesce(lower(trace_id), ''), '^0')")


# Metrics

_METRIC_LABEL_SQL = {
    "service_name": "service_name", "deployment_environment": ENV, "state": _attr("metric_attributes", "state"),
}
_VALUE = "coalesce(double_value, cast(int_value AS DOUBLE))"
_AGGREGATES = {
    "avg": f"avg({_VALUE})", "min": f"min({_VALUE})", "max": f"max({_VALUE})", "sum": f"sum({_VALUE})", "count": "cast(count(*) AS DOUBLE)",
    "rate": f"CASE WHEN max(epoch_us(time_unix_nano)) > min(epoch_us(time_unix_nano)) THEN (max({_VALUE}) - min({_VALUE})) / ((max(epoch_us(time_unix_nano)) - min(epoch_us(time_unix_nano))) / 1e6) END",
}


def _plan(text: str, window: Window, step: int, limit: int = 5000, forward: bool = True, signal: str | None = None) -> MetricPlan:
    q = promql.parse(text)
    return MetricPlan(q.name, q.matchers, window, signal or q.signal, q.aggregation, q.group_by, step, limit, forward)


def _metric_frame(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


def _metric_sql(table: str, metric: str, aggregation: str, groups: tuple[str, ...], step: int, where: str = "TRUE", limit: int = 5000, order: str = "ASC") -> str:
    def at(label: str) -> str:
        return _METRIC_LABEL_SQL.get(label) or (
            "CAST(NULL AS VARCHAR)" if label in ("job", "instance") else labels.plain_column(labels.METRICS, label)
            or _attr("resource_attributes" if labels.place(labels.METRICS, label).kind == "resource" else "metric_attributes", ",".join(labels.place(labels.METRICS, label).keys))
        )

    columns = "".join(f", {at(g)} AS {g}" for g in groups).replace("service_namespace AS", "CAST(NULL AS VARCHAR) AS").replace("service_instance_id AS", "CAST(NULL AS VARCHAR) AS")
    keys = ", ".join(map(str, range(1, len(groups) + 2)))
    return (
        _with(table)
        + f"""SELECT cast(floor(epoch_us(time_unix_nano) / (1e6 * {step})) * {step} AS BIGINT) AS bucket{columns},
 round({_AGGREGATES[aggregation]}, 6) AS value
FROM {table} WHERE {_between('time_unix_nano', METRIC_WINDOW)} AND name = '{metric}' AND {where}
GROUP BY {keys} ORDER BY 1 {order}{''.join(f', {i} NULLS LAST' for i in range(2, len(groups) + 2))} LIMIT {limit + 1}"""
    )


def _metric(name: str, text: str, sql: str, step: int = DAY, limit: int = 5000, forward: bool = True) -> None:
    QUERIES[name] = lambda spark, sf_dir: _metric_frame(compiled.metric(_plan(text, METRIC_WINDOW, step, limit, forward), FixtureTables(spark, sf_dir)))
    ORACLE_SQL[name] = sql


_CLICK = "event.value.click"
_metric("metric_avg_by_service", f"avg by (service_name) ({_CLICK})", _metric_sql(schema.GAUGE, _CLICK, "avg", ("service_name",), DAY))
for _agg in ("min", "max", "sum", "count"):
    _metric(f"metric_{_agg}", f"{_agg}({_CLICK}) by (service.name)", _metric_sql(schema.GAUGE, _CLICK, _agg, ("service_name",), 3600), 3600)
_metric("metric_rate", "sum by (service_name) (rate(event.count[5m]))", _metric_sql(schema.SUM, "event.count", "rate", ("service_name",), DAY))
_metric("metric_multi_label", f"max by (state, deployment.environment) ({_CLICK})", _metric_sql(schema.GAUGE, _CLICK, "max", ("state", "deployment_environment"), DAY))
_metric("metric_ungrouped", _CLICK, _metric_sql(schema.GAUGE, _CLICK, "avg", (), 600), 600)
_metric(
    "metric_filtered", 'sum(event.value.view{service_name!="svc-0", state=~"s[12]"})',
    _metric_sql(schema.GAUGE, "event.value.view", "sum", (), DAY, f"coalesce(service_name, '') <> 'svc-0' AND regexp_matches(coalesce({_attr('metric_attributes', 'state')}, ''), 's[12]')"),
)
_metric("metric_name_label", '{__name__="event.value.error", state="s1"}', _metric_sql(schema.GAUGE, "event.value.error", "avg", (), DAY, f"coalesce({_attr('metric_attributes', 'state')}, '') = 's1'"))
_metric("metric_instant", f"sum({_CLICK})", _metric_sql(schema.GAUGE, _CLICK, "sum", (), 300, limit=1, order="DESC"), 300, 1, False)
_metric(
    "metric_without", f"sum without (state) ({_CLICK})",
    _metric_sql(schema.GAUGE, _CLICK, "sum", tuple(n for n in labels.names(labels.METRICS) if n != "state"), DAY),
)


def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gauge that isn't there is looked for among the sums."""
    tables = FixtureTables(spark, sf_dir)
    first = compiled.metric(_plan("max by (service_name) (event.count)", METRIC_WINDOW, DAY), tables)
    if not first.take(1):
        first = compiled.metric(_plan("max by (service_name) (event.count)", METRIC_WINDOW, DAY, signal="sum"), tables)
    return _metric_frame(first)


QUERIES["metric_gauge_to_sum_fallback"] = _fallback
ORACLE_SQL["metric_gauge_to_sum_fallback"] = _metric_sql(schema.SUM, "event.count", "max", ("service_name",), DAY)


def _total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that ends in _total keeps it and is read from the sums."""
    tables = FixtureTables(spark, sf_dir)
    sums = tables.table(schema.SUM).withColumn("name", F.lit("event_count_total"))
    from beaconlake.sources.tables import DictTables

    return _metric_frame(compiled.metric(_plan("count(event_count_total)", METRIC_WINDOW, DAY), DictTables(spark, **{schema.SUM: sums})))


QUERIES["metric_total_suffix"] = _total
ORACLE_SQL["metric_total_suffix"] = _metric_sql(schema.SUM, "event.count", "count", (), DAY)


# Traces


def _trace_frame(df: DataFrame) -> DataFrame:
    micros = {c: schema.epoch_micros(F.col(c)) for c in ("start_time", "end_time")}
    return df.withColumns(micros).withColumnsRenamed({"start_time": "start_us", "end_time": "end_us"})


def _search(name: str, params: dict[str, str], where: str, limit: int) -> None:
    QUERIES[name] = lambda spark, sf_dir: _trace_frame(compiled.trace_search(traceql.parse(params, TRACE_WINDOW, limit), FixtureTables(spark, sf_dir)))
    ORACLE_SQL[name] = (
        _with(schema.SPANS)
        + f"""SELECT coalesce(lower(trace_id), '') AS trace_id, epoch_us(min(start_time_unix_nano)) AS start_us, epoch_us(max(start_time_unix_nano)) AS end_us,
 max(service_name) AS service_name, max(name) AS span_name, count(*) AS matched_spans, max(duration_time_unix_nano) AS duration
FROM otlp_traces WHERE {_between('start_time_unix_nano', TRACE_WINDOW)} AND {where}
GROUP BY otlp_traces.trace_id ORDER BY max(start_time_unix_nano) DESC, otlp_traces.trace_id LIMIT {limit + 1}"""
    )


_search("trace_search", {"q": '{ resource.service.name = "supplier-3" }'}, "coalesce(service_name, '') = 'supplier-3'", 1000)
_search("trace_search_status", {"q": '{ status = 2 && http.method = "GET" }'}, f"coalesce(cast(status_code AS VARCHAR), '') = '2' AND coalesce({SPAN_METHOD}, '') = 'GET'", 1000)
_search("trace_search_tags", {"tags": 'name=~"R[FO]" http.status_code!=200', "deployment.environment": "env-1"}, f"coalesce({ENV}, '') = 'env-1' AND regexp_matches(coalesce(name, ''), 'R[FO]') AND coalesce(cast({SPAN_STATUS} AS VARCHAR), '') <> '200'", 1000)
_search("trace_search_limit", {}, "TRUE", 20)

_TRACE_ID = "md5(concat('o', 7))"
_ALL_TIME = Window(datetime(1990, 1, 1), datetime(2010, 1, 1))


def _by_id(full: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        trace_id = spark.sql(f"SELECT {_TRACE_ID}").first()[0].upper()
        df = compiled.trace(trace_id, _ALL_TIME.start, _ALL_TIME.end, FixtureTables(spark, sf_dir), full)
        return df.select(schema.epoch_micros(F.col("timestamp")).alias("ts_us"), *df.columns[1:])

    return query


_SPAN_COLUMNS = f"""epoch_us(start_time_unix_nano) AS ts_us, lower(trace_id) AS trace_id, lower(span_id) AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id,
 service_name, name AS span_name, duration_time_unix_nano AS duration, status_code, {SPAN_METHOD} AS http_method, {SPAN_STATUS} AS http_status_code"""
_PROTO_COLUMNS = f""", CAST(NULL AS VARCHAR) AS trace_state, kind AS span_kind, CAST(NULL AS VARCHAR) AS status_message, CAST(NULL AS VARCHAR) AS scope_name,
 CAST(NULL AS VARCHAR) AS scope_version, {ENV} AS deployment_environment, {_attr('span_attributes', 'http.route')} AS http_route, {_attr('span_attributes', 'exception.type')} AS exception_type"""
for _name, _full in (("trace_by_id", False), ("trace_by_id_proto_cols", True)):
    QUERIES[_name] = _by_id(_full)
    ORACLE_SQL[_name] = (
        _with(schema.SPANS)
        + f"SELECT {_SPAN_COLUMNS}{_PROTO_COLUMNS if _full else ''} FROM otlp_traces WHERE trace_id = {_TRACE_ID} AND {_between('start_time_unix_nano', _ALL_TIME)} ORDER BY 1 LIMIT {compiled.MOST_SPANS}"
    )


# Discovery: from the points, and from the summary

_POINTS = f"(SELECT name, service_name, {ENV} AS deployment_environment, time_unix_nano FROM otlp_metrics_gauge UNION ALL SELECT name, service_name, {ENV}, time_unix_nano FROM otlp_metrics_sum)"


def _register(name: str, query: Callable[[FixtureTables], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(FixtureTables(spark, sf_dir))
    ORACLE_SQL[name] = sql


_register(
    "prom_label_values_raw", lambda t: discovery.raw_values(t, "deployment_environment", METRIC_WINDOW),
    _with(schema.GAUGE, schema.SUM) + f"SELECT DISTINCT deployment_environment AS value FROM {_POINTS} WHERE deployment_environment IS NOT NULL AND deployment_environment <> '' AND {_between('time_unix_nano', METRIC_WINDOW)} ORDER BY 1 LIMIT 1000",
)
_register(
    "prom_metric_names_raw", lambda t: discovery.raw_values(t, "__name__", METRIC_WINDOW),
    _with(schema.GAUGE, schema.SUM) + f"SELECT DISTINCT name AS value FROM {_POINTS} WHERE {_between('time_unix_nano', METRIC_WINDOW)} ORDER BY 1 LIMIT 1000",
)
_register(
    "prom_series_raw", lambda t: discovery.raw_series(t, METRIC_WINDOW),
    _with(schema.GAUGE, schema.SUM) + f"SELECT name, service_name, deployment_environment, count(*) AS rows FROM {_POINTS} WHERE {_between('time_unix_nano', METRIC_WINDOW)} GROUP BY 1, 2, 3 ORDER BY rows DESC, 1, 2, 3 NULLS LAST LIMIT 1000",
)


def _seen(column: str) -> str:
    return f"epoch_us(min({column})) AS first_us, epoch_us(max({column})) AS last_us"


def _summary_frame(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(
        F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), *columns, "row_count",
        schema.epoch_micros(F.col("first_seen")).alias("first_us"), schema.epoch_micros(F.col("last_seen")).alias("last_us"),
    )


_DAY_SQL = "strftime(time_unix_nano, '%Y-%m-%d') AS event_date"
_register(
    "rollup_label_values",
    lambda t: _summary_frame(rollup.summarise(schema.LOGS, t.table(schema.LOGS)).filter("kind = 'label_value'"), "name", "value"),
    _with(schema.LOGS)
    + ",\nv AS ("
    + " UNION ALL ".join(
        f"SELECT time_unix_nano, '{n}' AS name, {at} AS value FROM otlp_logs"
        for n, at in (
            ("service_name", "service_name"), ("service_namespace", "service_namespace"), ("deployment_environment", ENV), ("host_name", HOST),
            ("scope_name", "scope_name"), ("severity_text", "severity_text"), ("http_route", _attr("log_attributes", "http.route")), ("http_method", METHOD),
        )
    )
    + f")\nSELECT {_DAY_SQL}, name, value, count(*) AS row_count, {_seen('time_unix_nano')} FROM v WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2, 3",
)
_register(
    "rollup_series",
    lambda t: _summary_frame(rollup.summarise(schema.LOGS, t.table(schema.LOGS)).filter("kind = 'series'"), "service_name", "deployment_environment", "severity_text"),
    _with(schema.LOGS) + f"SELECT {_DAY_SQL}, service_name, {ENV} AS deployment_environment, severity_text, count(*) AS row_count, {_seen('time_unix_nano')} FROM otlp_logs GROUP BY 1, 2, 3, 4",
)
_register(
    "rollup_tag_values",
    lambda t: rollup.summarise(schema.SPANS, t.table(schema.SPANS)).filter("kind = 'tag_value'").groupBy("name").agg(F.countDistinct("value").alias("n_values"), F.sum("row_count").alias("n_rows")),
    _with(schema.SPANS)
    + ",\nv AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS name, {at} AS value FROM otlp_traces"
        for n, at in (
            ("service.name", "service_name"), ("deployment.environment", ENV), ("http.route", _attr("span_attributes", "http.route")), ("http.method", SPAN_METHOD),
            ("http.status_code", f"cast({SPAN_STATUS} AS VARCHAR)"), ("span.name", "name"), ("status.code", "cast(status_code AS VARCHAR)"),
        )
    )
    + ")\nSELECT name, count(DISTINCT value) AS n_values, count(*) AS n_rows FROM v WHERE value IS NOT NULL AND value <> '' GROUP BY 1",
)
_register(
    "rollup_metric_metadata",
    lambda t: _summary_frame(rollup.summarise(schema.SUM, t.table(schema.SUM)).filter("kind = 'metric_metadata'"), "name", "metric_type", "metric_unit", "metric_description"),
    _with(schema.SUM) + f"SELECT {_DAY_SQL}, name, 'counter' AS metric_type, unit AS metric_unit, description AS metric_description, count(*) AS row_count, {_seen('time_unix_nano')} FROM otlp_metrics_sum GROUP BY 1, 2, 3, 4, 5",
)
# A day's summary row counts as a whole where the day reaches into the window.
_DAYS = "strftime(time_unix_nano, '%Y-%m-%d')"
_IN_WINDOW = f"HAVING min(time_unix_nano) < TIMESTAMP '{LOG_WINDOW.end}' AND max(time_unix_nano) >= TIMESTAMP '{LOG_WINDOW.start}'"
_register(
    "discovery_label_values", lambda t: discovery.values(t.summary(), (schema.LOGS,), "label_value", "service_name", LOG_WINDOW),
    _with(schema.LOGS) + f", d AS (SELECT {_DAYS} AS day, service_name AS value, count(*) AS n FROM otlp_logs GROUP BY 1, 2 {_IN_WINDOW}) SELECT value, cast(sum(n) AS BIGINT) AS rows FROM d GROUP BY 1 ORDER BY 1 LIMIT 1000",
)
_register(
    "discovery_tag_values", lambda t: discovery.values(t.summary(), (schema.SPANS,), "tag_value", "status.code", TRACE_WINDOW),
    _with(schema.SPANS) + f", d AS (SELECT strftime(start_time_unix_nano, '%Y-%m-%d') AS day, cast(status_code AS VARCHAR) AS value, count(*) AS n FROM otlp_traces GROUP BY 1, 2 HAVING min(start_time_unix_nano) < TIMESTAMP '{TRACE_WINDOW.end}' AND max(start_time_unix_nano) >= TIMESTAMP '{TRACE_WINDOW.start}') SELECT value, cast(sum(n) AS BIGINT) AS rows FROM d GROUP BY 1 ORDER BY 1 LIMIT 1000",
)
_register(
    "loki_series", lambda t: discovery.series(t.summary(), (schema.LOGS,), ["service_name", "deployment_environment", "severity_text"], LOG_WINDOW),
    _with(schema.LOGS) + f", d AS (SELECT {_DAYS} AS day, service_name, {ENV} AS deployment_environment, severity_text, count(*) AS n FROM otlp_logs GROUP BY 1, 2, 3, 4 {_IN_WINDOW}) SELECT service_name, deployment_environment, severity_text, cast(sum(n) AS BIGINT) AS rows FROM d GROUP BY 1, 2, 3 ORDER BY rows DESC, 1, 2 NULLS LAST, 3 LIMIT 1000",
)
_register(
    "prom_series_summary", lambda t: discovery.series(t.summary(), discovery.METRIC_SIGNALS, discovery.SERIES_KEYS, METRIC_WINDOW),
    _with(schema.GAUGE, schema.SUM) + f"SELECT name, service_name, deployment_environment, count(*) AS rows FROM {_POINTS} GROUP BY 1, 2, 3 ORDER BY rows DESC, 1, 2, 3 NULLS LAST LIMIT 1000",
)
_register(
    "prom_metadata",
    lambda t: (df := discovery.metric_metadata(t.summary())).select("name", "metric_type", "unit", "help", schema.epoch_micros(F.col("last_seen")).alias("last_us")),
    _with(schema.GAUGE, schema.SUM) + "SELECT name, metric_type, max(coalesce(unit, '')) AS unit, max(coalesce(description, '')) AS help, epoch_us(max(time_unix_nano)) AS last_us FROM (SELECT name, 'gauge' AS metric_type, unit, description, time_unix_nano FROM otlp_metrics_gauge UNION ALL SELECT name, 'counter', unit, description, time_unix_nano FROM otlp_metrics_sum) GROUP BY 1, 2 ORDER BY last_us DESC, 1, 2 LIMIT 1000",
)


# Health

_register(
    "freshness", health.freshness,
    _with(*schema.SIGNALS) + " UNION ALL ".join(f"SELECT '{s}' AS signal, epoch_us(max({schema.EVENT_TIME[s]})) AS latest_micros FROM {s}" for s in schema.SIGNALS),
)
_register("logical_rows", health.logical_rows, _with(*schema.SIGNALS) + " UNION ALL ".join(f"SELECT '{s}' AS signal, count(*) AS rows FROM {s}" for s in schema.SIGNALS))


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for tables, orders for data files, a third of which are no longer live."""
    tables = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("table_id"), F.col("s_name").alias("table_name"), F.expr("CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey END").alias("end_snapshot"),
    )
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        (F.col("o_custkey") % 150).alias("table_id"), F.col("o_orderkey").alias("data_file_id"), (F.col("o_orderkey") % 1000).alias("record_count"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END").alias("end_snapshot"),
    )
    return storage_layout(tables, files)


QUERIES["storage_layout"] = _layout
ORACLE_SQL["storage_layout"] = """
SELECT s_suppkey AS table_id, s_name AS table_name, count(o_orderkey) AS active_data_files, cast(coalesce(sum(o_orderkey % 1000), 0) AS BIGINT) AS active_data_file_rows
FROM supplier LEFT JOIN orders ON o_custkey % 150 = s_suppkey AND o_orderkey % 3 <> 0
WHERE s_suppkey % 7 <> 0 GROUP BY 1, 2
"""
