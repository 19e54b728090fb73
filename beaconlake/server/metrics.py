"""Counters, gauges and observations, as Prometheus text."""

from __future__ import annotations

import threading

PREFIX = "beaconlake_"
# The metrics there are, their kinds, and the labels they may carry.
KINDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "admission_capacity": ("gauge", ("admission",)),
    "admission_in_use": ("gauge", ("admission",)),
    "admission_rejections_total": ("counter", ("admission", "reason")),
    "active_data_file_rows": ("gauge", ("storage_signal",)),
    "active_data_files": ("gauge", ("storage_signal",)),
    "freshness_watermark_timestamp": ("gauge", ("storage_signal",)),
    "http_connection_closes_total": ("counter", ("reason",)),
    "http_connection_errors_total": ("counter", ("reason",)),
    "http_connection_requests_total": ("counter", ("mode",)),
    "phase_duration_seconds": ("summary", ("route_template", "phase", "status", "reason")),
    "query_duration_seconds": ("summary", ("route_template",)),
    "query_requests_total": ("counter", ("route_template", "status", "reason")),
    "query_timeouts_total": ("counter", ("route_template",)),
    "storage_logical_rows": ("gauge", ("storage_signal",)),
    "storage_physical_bytes": ("gauge", ("storage_signal",)),
}


def _escape(value: str) -> str:
    return value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


class Metrics:
    def __init__(self) -> None:
        self._values: dict[tuple[str, tuple[tuple[str, str], ...]], list[float]] = {}
        self._lock = threading.Lock()

    def _cell(self, name: str, kind: str, labels: dict[str, object]) -> list[float]:
        have, allowed = KINDS[name]
        if have != kind or not set(labels) <= set(allowed):
            raise ValueError(f"{name} is a {have} with labels {allowed}")
        return self._values.setdefault((name, tuple(sorted((k, str(v)) for k, v in labels.items()))), [0.0, 0.0])

    def count(self, name: str, by: float = 1, **labels: object) -> None:
        with self._lock:
            self._cell(name, "counter", labels)[0] += by

    def gauge(self, name: str, value: float, **labels: object) -> None:
        with self._lock:
            self._cell(name, "gauge", labels)[0] = value

    def observe(self, name: str, value: float, **labels: object) -> None:
        with self._lock:
            cell = self._cell(name, "summary", labels)
            cell[0], cell[1] = cell[0] + 1, cell[1] + value

    def render(self) -> str:
        with self._lock:
            values = sorted((k, list(v)) for k, v in self._values.items())
        lines: list[str] = []
        last = None
        for (name, labels), (first, total) in values:
            kind = KINDS[name][0]
            if name != last:
                lines.append(f"# TYPE {PREFIX}{name} {kind}")
                last = name
            text = "{" + ",".join(f'{k}="{_escape(v)}"' for k, v in labels) + "}" if labels else ""
            if kind == "summary":
                lines += [f"{PREFIX}{name}_count{text} {first:.0f}", f"{PREFIX}{name}_sum{text} {total!r}"]
            else:
                lines.append(f"{PREFIX}{name}{text} {int(first) if first.is_integer() else repr(first)}")
        return "\n".join(lines) + "\n" if lines else ""
