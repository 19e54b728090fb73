"""Requests to plans, and rows to the shapes that Prometheus, Loki and Tempo clients expect."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from datetime import datetime, timedelta
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame

from beaconlake.functions import labels
from beaconlake.operators import compile as compiled
from beaconlake.operators.discovery import Discovery
from beaconlake.plans import logql, params, promql, schema, traceql
from beaconlake.plans.model import MetricPlan, Window
from beaconlake.server import protobuf
from beaconlake.sources.tables import Tables

METRIC_RANGE, INTERACTIVE_RANGE = timedelta(days=30), timedelta(hours=24)
INSTANT_WINDOW, INSTANT_STEP = timedelta(minutes=5), 300
RANGE_ROWS, LOG_ROWS, LOG_ROWS_DEFAULT, TRACE_ROWS, TRACE_ROWS_DEFAULT = 5000, 1000, 100, 1000, 20
TRACE_AHEAD, TRACE_WINDOW = timedelta(minutes=10), timedelta(days=7)
NO_VALUES = ("", "duration", "min-duration", "max-duration", "duration_ms")
_EPOCH = datetime(1970, 1, 1)


def seconds(at: datetime) -> int:
    return (at - _EPOCH) // timedelta(seconds=1)


def nanos(at: datetime, exact: int | None = None) -> int:
    return exact if exact is not None else (at - _EPOCH) // timedelta(microseconds=1) * 1000


def number(value: float | None) -> str:
    """In digits, without an exponent; whole numbers without a point, and NaN for what is not finite."""
    value = 0.0 if value is None else value
    if not math.isfinite(value):
        return "NaN"
    text = format(Decimal(repr(value)), "f")
    return text.removesuffix(".0")


def _key(labels_: dict[str, str]) -> str:
    return json.dumps(labels_, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def success(data: Any) -> dict:
    return {"status": "success", "data": data}


class Adapters:
    """run collects a DataFrame under the server's guards."""

    def __init__(self, tables: Tables, discovery: Discovery, run: Callable[[DataFrame], list] = DataFrame.collect) -> None:
        self.tables, self.discovery, self.run = tables, discovery, run

    # metrics

    def _metric_rows(self, plan: MetricPlan) -> list[dict]:
        """Rows up to the limit; a gauge without any is looked for among the sums."""
        rows = self.run(compiled.metric(plan, self.tables))
        if not rows and plan.signal == "gauge" and plan.aggregation != "rate":
            rows = self.run(compiled.metric(MetricPlan(**{**plan.__dict__, "signal": "sum"}), self.tables))
        return [r.asDict() for r in rows[: plan.limit]]

    def metric_query(self, p: dict[str, str]) -> dict:
        text = params.required(p, "query")
        at = params.time(p, "time", params.now())
        probe = {"1": 1.0, "1+1": 2.0}.get("".join(text.split()))
        if probe is not None:
            return success({"resultType": "vector", "result": [{"metric": {}, "value": [seconds(at), number(probe)]}]})
        q = promql.parse(text)
        window = Window(at - INSTANT_WINDOW, at + timedelta(seconds=1))
        rows = self._metric_rows(MetricPlan(q.name, q.matchers, window, q.signal, q.aggregation, q.group_by, INSTANT_STEP, 1, False))
        result = [{"metric": self._metric_labels(q.name, q.group_by, r), "value": [seconds(at), number(r["value"])]} for r in rows]
        return success({"resultType": "vector", "result": result})

    @staticmethod
    def _metric_labels(name: str, group_by: tuple[str, ...], row: dict) -> dict[str, str]:
        return {"__name__": name} | {k: row[k] for k in group_by if row[k]}

    def metric_range(self, p: dict[str, str]) -> dict:
        text = params.required(p, "query")
        start, end = params.required_time(p, "start"), params.required_time(p, "end")
        window = params.check_range(start, end, METRIC_RANGE)
        step = params.step(p.get("step", "60"))
        q = promql.parse(text)
        group_by = q.group_by if q.explicit_grouping else ("service_name",)
        rows = self._metric_rows(MetricPlan(q.name, q.matchers, window, q.signal, q.aggregation, group_by, step, RANGE_ROWS))
        found: dict[str, tuple[dict[str, str], list]] = {}
        for r in rows:
            own = self._metric_labels(q.name, group_by, r)
            found.setdefault(_key(own), (own, []))[1].append([r["bucket"], number(r["value"])])
        return success({"resultType": "matrix", "result": [{"metric": m, "values": v} for _, (m, v) in sorted(found.items())]})

    def metric_labels(self, p: dict[str, str]) -> dict:
        params.optional_range(p, METRIC_RANGE)
        return success(labels.metric_label_names())

    def metric_label_values(self, p: dict[str, str], name: str) -> dict:
        return success(self.discovery.metric_label_values(name, params.optional_range(p, METRIC_RANGE)))

    def metric_series(self, p: dict[str, str]) -> dict:
        return success(self.discovery.metric_series(params.optional_range(p, METRIC_RANGE)))

    def metric_metadata(self, p: dict[str, str]) -> dict:
        return success(self.discovery.metric_metadata())

    # logs

    def _logs(self, p: dict[str, str], ranged: bool) -> dict:
        text = params.required(p, "query")
        end = params.time(p, "end", params.now())
        window = params.check_range(params.time(p, "start", end - timedelta(hours=1)), end, INTERACTIVE_RANGE)
        limit = params.limit(p.get("limit"), LOG_ROWS_DEFAULT, LOG_ROWS)
        if not ranged:
            window = Window(window.start, end + timedelta(seconds=1))
        plan = logql.parse(text, window, limit, p.get("direction", "backward"))
        found: dict[str, tuple[dict[str, str], list]] = {}
        for r in [r.asDict() for r in self.run(compiled.logs(plan, self.tables))[:limit]]:
            own = {k: r[k] for k in labels.stream_labels() if r[k]}
            at = nanos(r["timestamp"] or window.end, r.get("time_nanos"))
            found.setdefault(_key(own), (own, []))[1].append([str(at), r["body"] or ""])
        streams = [{"stream": s, "values": v} for _, (s, v) in sorted(found.items(), reverse=plan.forward)]
        return success({"resultType": "streams", "result": streams})

    def log_query(self, p: dict[str, str]) -> dict:
        return self._logs(p, False)

    def log_range(self, p: dict[str, str]) -> dict:
        return self._logs(p, True)

    def log_labels(self, p: dict[str, str]) -> dict:
        params.optional_range(p, INTERACTIVE_RANGE)
        return success(labels.stream_labels())

    def log_label_values(self, p: dict[str, str], name: str) -> dict:
        return success(self.discovery.log_label_values(name, params.optional_range(p, INTERACTIVE_RANGE)))

    def log_series(self, p: dict[str, str]) -> dict:
        return success(self.discovery.log_series(params.optional_range(p, INTERACTIVE_RANGE)))

    # traces

    def trace_search(self, p: dict[str, str]) -> dict:
        window = params.optional_range(p, INTERACTIVE_RANGE)
        limit = params.limit(p.get("limit"), TRACE_ROWS_DEFAULT, TRACE_ROWS)
        rows = self.run(compiled.trace_search(traceql.parse(p, window, limit), self.tables))[:limit]
        traces = [
            {
                "traceID": r["trace_id"], "startTimeUnixNano": str(nanos(r["start_time"])) if r["start_time"] else "",
                "rootServiceName": r["service_name"], "rootTraceName": r["span_name"],
                "spanSet": {"spans": [], "matched": r["matched_spans"]}, "spanSets": [{"spans": [], "matched": r["matched_spans"]}],
                "durationMs": int((r["duration"] or 0) / 1_000_000),
            }
            for r in rows
        ]
        return {"traces": traces, "metrics": {"inspectedTraces": len(traces), "completedJobs": 1}}

    def tags(self, p: dict[str, str]) -> dict:
        return {"tagNames": labels.tag_names()}

    def tag_values(self, p: dict[str, str], tag: str) -> dict:
        if tag in NO_VALUES:
            return {"tagValues": []}
        return {"tagValues": self.discovery.tag_values(tag, params.optional_range(p, INTERACTIVE_RANGE))}

    def _trace_rows(self, trace_id: str, full: bool) -> list[tuple[dict, int]]:
        end = params.now() + TRACE_AHEAD
        rows = self.run(compiled.trace(trace_id, end - TRACE_WINDOW, end, self.tables, full))
        return [(r.asDict(), nanos(r["timestamp"])) for r in rows]

    def trace_json(self, trace_id: str) -> dict:
        return trace_json(self._trace_rows(trace_id, False))

    def trace_proto(self, trace_id: str) -> bytes:
        return protobuf.trace(self._trace_rows(trace_id, True))


def trace_json(rows: list[tuple[dict, int]]) -> dict:
    spans = [
        {
            "traceId": r["trace_id"] or "", "spanId": r["span_id"] or "", "parentSpanId": r["parent_span_id"] or "", "name": r["span_name"] or "",
            "kind": "SPAN_KIND_UNSPECIFIED", "startTimeUnixNano": str(at), "endTimeUnixNano": str(at + (r["duration"] or 0)),
            "attributes": [
                {"key": "service.name", "value": {"stringValue": r["service_name"] or ""}},
                {"key": "http.request.method", "value": {"stringValue": r["http_method"] or ""}},
                {"key": "http.response.status_code", "value": {"intValue": str(r["http_status_code"] or 0)}},
            ],
            "status": {"code": r["status_code"] or 0},
        }
        for r, at in rows
    ]
    return {"batches": [{"resource": {}, "instrumentationLibrarySpans": [{"spans": spans}]}]}


def storage_health(tables: Tables, rows: list, latest: list, bytes_: int, layout: dict) -> dict:
    now = (params.now() - _EPOCH).total_seconds()
    fresh = {}
    for r in latest:
        at = None if r["latest_micros"] is None else r["latest_micros"] / 1e6
        lag = None if at is None else now - at
        stamp = None if at is None else (_EPOCH + timedelta(microseconds=r["latest_micros"])).isoformat(sep=" ")
        fresh[r["signal"]] = {"timestamp": stamp, "epoch_seconds": at, "event_lag_seconds": lag, "lag_seconds": lag}
    return {
        "healthy": True, "capabilities": {"insert": False, "query": True}, "freshness_watermarks": fresh,
        "logical_rows": {r["signal"]: r["rows"] for r in rows}, "storage_layout": layout, "physical_bytes": bytes_,
        "signals": list(schema.SIGNALS),
    }
