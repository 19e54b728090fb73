"""Plans to lazy DataFrames, in built-in expressions only."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.functions import labels
from beaconlake.plans import schema
from beaconlake.plans.model import ApiError, LogPlan, Matcher, MetricPlan, Op, TracePlan
from beaconlake.sources.tables import TRACE_KEY, Tables

MOST_SPANS = 20_000


def matches(m: Matcher, scope: str) -> Column | None:
    """A label filter; None if it holds for all rows. No value is the same as an empty one.

    On a plain string column the filter is written so that it reaches the Parquet scan, which
    coalesce(column, '') = 'x' does not.
    """
    if m.op in (Op.RE, Op.NOT_RE) and m.value == ".*":
        return None if m.op is Op.RE else F.lit(False)
    plain = labels.plain_column(scope, m.field)
    if plain and m.op in (Op.EQ, Op.NE):
        c = F.col(plain)
        if m.op is Op.EQ:
            return c == m.value if m.value else c.isNull() | (c == "")
        return c.isNull() | (c != m.value) if m.value else c != ""
    text = F.coalesce(labels.expression(scope, m.field).cast("string"), F.lit(""))
    return {
        Op.EQ: lambda: text == m.value, Op.NE: lambda: text != m.value,
        Op.RE: lambda: text.rlike(m.value), Op.NOT_RE: lambda: ~text.rlike(m.value),
    }[m.op]()


def contains(column: str, query: str) -> Column | None:
    """Words joined by OR, or else by AND, each found anywhere and in any case; % and _ stay wildcards.

    The query splits at " OR " wherever it holds one in any case, but only upper case parts it.
    """
    if not query.strip():
        return None
    if "(" in query or ")" in query:
        raise ApiError(400, "unsupported_query", "parentheses are not supported in text queries")
    either = " or " in query.lower()
    terms = [t.strip() for t in query.split(" OR " if either else " AND ")]
    found = [F.col(column).ilike("%" + t.replace("\\", "\\\\") + "%") for t in terms if t]
    return functools.reduce(operator.or_ if either else operator.and_, found) if found else None


def _filtered(df: DataFrame, scope: str, matchers: tuple[Matcher, ...]) -> DataFrame:
    for m in matchers:
        on = matches(m, scope)
        df = df if on is None else df.filter(on)
    return df


def logs(plan: LogPlan, tables: Tables) -> DataFrame:
    """timestamp, body and the projected labels as text; one row more than the limit if there are more.

    Rows of one time are in the order of their bodies and span ids, so that a limit always cuts alike.
    """
    df = _filtered(tables.within(schema.LOGS, plan.window.start, plan.window.end), labels.LOGS, plan.matchers)
    for t in plan.text:
        on = F.coalesce(F.col("body"), F.lit("")).rlike(t.term) if t.regex else contains("body", t.term)
        df = df if on is None else df.filter(on)
    # The projection's JSON paths are read after the limit, for the rows that are left.
    keys = [c for c in ("time_nanos",) if c in df.columns]
    time = [F.col(c).asc_nulls_last() if plan.forward else F.col(c).desc_nulls_last() for c in ["time_unix_nano", *keys]]
    cut = df.orderBy(*time, F.col("body").asc_nulls_last(), F.col("span_id").asc_nulls_last()).limit(plan.limit + 1)
    return cut.select(
        F.col("time_unix_nano").alias("timestamp"), "body",
        *(labels.expression(labels.LOGS, n).cast("string").alias(n) for n in labels.log_columns()), *keys,
    )


def point_value() -> Column:
    return F.coalesce(F.col("double_value"), F.col("int_value").cast("double"))


def aggregate(name: str) -> Column:
    """An aggregation over the points of a group; rate is the rise over the time between first and last point."""
    v = point_value()
    if name == "count":
        return F.count("*").cast("double")
    if name == "rate":
        at = schema.epoch_micros(F.col("time_unix_nano"))
        span = (F.max(at) - F.min(at)) / F.lit(1e6)
        return F.when(span > 0, (F.max(v) - F.min(v)) / span)
    return {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[name](v)


def metric(plan: MetricPlan, tables: Tables) -> DataFrame:
    """bucket (seconds since the epoch), the grouping labels as text, and value; one row more than the limit if there are more."""
    if plan.aggregation == "rate" and plan.signal != "sum":
        raise ApiError(400, "unsupported_aggregation", "rate is for sums only")
    if plan.signal not in ("gauge", "sum"):
        raise ApiError(400, "unsupported_signal", f"there is no metric signal {plan.signal}")
    if not plan.name:
        raise ApiError(400, "missing_metric_name", "a metric name is required")
    table = schema.SUM if plan.signal == "sum" else schema.GAUGE
    df = tables.within(table, plan.window.start, plan.window.end).filter(F.col("name") == plan.name)
    df = _filtered(df, labels.METRICS, plan.matchers)
    step = min(max(plan.step, 1), 86_400)
    at = schema.epoch_micros(F.col("time_unix_nano"))
    bucket = ((at - F.pmod(at, F.lit(step * 1_000_000))) / 1_000_000).cast("long").alias("bucket")
    groups = [labels.expression(labels.METRICS, n).cast("string").alias(n) for n in plan.group_by]
    out = df.groupBy(bucket, *groups).agg(aggregate(plan.aggregation).alias("value"))
    time = F.col("bucket").asc() if plan.forward else F.col("bucket").desc()
    return out.orderBy(time, *(F.col(n).asc_nulls_last() for n in plan.group_by)).limit(plan.limit + 1)


def trace_search(plan: TracePlan, tables: Tables) -> DataFrame:
    """One row per trace with a matching span, the latest first. Names are the greatest of the matching spans' names."""
    df = _filtered(tables.within(schema.SPANS, plan.window.start, plan.window.end), labels.SPANS, plan.matchers)
    out = df.groupBy(F.col("trace_id").alias("raw_id")).agg(
        F.min("start_time_unix_nano").alias("start_time"), F.max("start_time_unix_nano").alias("end_time"),
        F.max("service_name").alias("service_name"), F.max("name").alias("span_name"),
        F.count("*").alias("matched_spans"), F.max("duration_time_unix_nano").alias("duration"),
    )
    out = out.orderBy(F.col("end_time").desc_nulls_last(), F.col("raw_id").asc_nulls_last()).limit(plan.limit + 1)
    return out.select(F.coalesce(F.lower("raw_id"), F.lit("")).alias("trace_id"), *out.columns[1:])


def check_trace_id(trace_id: str) -> str:
    if not re.fullmatch(r"[0-9a-fA-F]{16}|[0-9a-fA-F]{32}", trace_id):
        raise ApiError(400, "invalid_trace_id", "a trace id is 16 or 32 hex digits")
    return trace_id.lower()


def trace(trace_id: str, start, end, tables: Tables, full: bool = False) -> DataFrame:
    """The spans of a trace by start; full adds what the protobuf form needs.

    Ids of either case match. Stores written by :class:`ParquetTables` have the id in lower case as a column, and the
    filter on it reaches the scan; in others ``lower()`` decides, within the days of the window.
    """
    trace_id = check_trace_id(trace_id)
    df = tables.within(schema.SPANS, start, end)
    df = df.filter(F.col(TRACE_KEY) == trace_id) if TRACE_KEY in df.columns else df.filter(F.lower("trace_id") == trace_id)
    order = [F.col(c).asc_nulls_last() for c in ("start_time_unix_nano", "span_id")]
    df = df.orderBy(*order).limit(MOST_SPANS)
    span = lambda n: labels.expression(labels.SPANS, n).alias(n)
    columns = [
        F.col("start_time_unix_nano").alias("timestamp"), *(F.lower(c).alias(c) for c in ("trace_id", "span_id", "parent_span_id")),
        "service_name", F.col("name").alias("span_name"), F.col("duration_time_unix_nano").alias("duration"), "status_code",
        span("http_method"), span("http_status_code"),
    ]
    if full:
        columns += [
            "trace_state", F.col("kind").alias("span_kind"), F.col("status_status_message").alias("status_message"),
            "scope_name", "scope_version", span("deployment_environment"), span("http_route"), span("exception_type"),
        ]
    return df.select(*columns)
