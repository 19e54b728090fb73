"""Metric queries: a selector under at most one function and one aggregation."""

from __future__ import annotations

import re

from beaconlake.functions import labels
from beaconlake.plans import selectors
from beaconlake.plans.model import ApiError, Op, PromQuery

REASON = "unsupported_promql"
AGGREGATIONS = ("avg", "min", "max", "sum", "count")
_HEAD = re.compile(rf"({'|'.join(AGGREGATIONS)})(?![A-Za-z0-9_:.])\s*")
_GROUPING = re.compile(r"(by|without)\s*\(([^)]*)\)\s*")


def _unsupported(message: str = "this is not in the supported PromQL subset") -> ApiError:
    return selectors.bad(REASON, message)


def _closing(text: str) -> int | None:
    """Where the parenthesis that text starts with is closed."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return i
    return None


def _bare(text: str) -> str:
    """Without white space and parentheses around the whole."""
    text = text.strip()
    while text.startswith("(") and _closing(text) == len(text) - 1:
        text = text[1:-1].strip()
    return text


def _group_labels(text: str) -> list[str]:
    out: list[str] = []
    for spelling in filter(None, map(str.strip, text.split(","))):
        name = labels.canonical(labels.METRICS, spelling)
        if name is None:
            raise _unsupported(f"cannot group by {spelling}")
        if name not in out:
            out.append(name)
    return out


def _aggregation(text: str) -> tuple[str, tuple[str, ...], bool, str] | None:
    """(aggregation, grouping, whether it is written out, what is aggregated), if text is an aggregation."""
    head = _HEAD.match(text)
    if not head:
        return None
    rest = text[head.end() :]
    grouping = _GROUPING.match(rest)
    if grouping:
        rest = rest[grouping.end() :]
    end = _closing(rest) if rest.startswith("(") else None
    if end is None:
        raise _unsupported()
    inner, after = rest[1:end], rest[end + 1 :].strip()
    if after:
        grouping = None if grouping else _GROUPING.fullmatch(after)
        if not grouping:
            raise _unsupported()
    if not grouping:
        return head[1], (), False, inner
    given = _group_labels(grouping[2])
    if grouping[1] == "without":
        given = [n for n in labels.names(labels.METRICS) if n not in given]
    return head[1], tuple(given), True, inner


def parse(text: str) -> PromQuery:
    """The innermost function wins: sum by (x) (rate(m[5m])) is the rate of m by x. Ranges are ignored."""
    text = _bare(text)
    aggregation, group_by, explicit = "avg", (), False
    outer = _aggregation(text)
    if outer:
        aggregation, group_by, explicit, text = outer
        text = _bare(text)
    for _ in range(1 if outer else 2):
        at = text.find("(")
        if at < 0 or not text.endswith(")"):
            break
        called = text[:at].strip()
        if called not in (*AGGREGATIONS, "rate"):
            raise _unsupported()
        aggregation, text = called, _bare(text[at + 1 : -1])
    if text.endswith("]") and "[" in text:
        text = text[: text.rfind("[")].strip()
    name, matchers = selectors.parse(text, REASON)
    if not name:
        named = next((m for m in matchers if m.field == "__name__" and m.op is Op.EQ), None)
        if named is None:
            raise _unsupported("a metric query needs a name or __name__")
        matchers.remove(named)
        name = named.value
    stored, signal = metric(name, aggregation)
    return PromQuery(stored, signal, aggregation, selectors.resolve(matchers, labels.METRICS, REASON), group_by, explicit)


# Names that clients ask for, and what they are stored as.
STORED_NAMES = {
    "process_runtime_cpython_cpu_time_seconds_total": "process.runtime.cpython.cpu_time",
    "otelcol_process_uptime_seconds_total": "otelcol_process_uptime",
    "demo_recommendation_requests_total": "app_recommendations_counter",
}
# Prefixes that lose _total only, prefixes that become dotted, and the units that those lose.
PLAIN_PREFIXES = ("otelcol_exporter_", "otelcol_process_")
DOTTED_PREFIXES = ("traces_span_metrics_", "system_", "process_runtime_")
UNITS = ("_seconds", "_milliseconds", "_bytes", "_ratio", "_count", "_total")


def stored_name(name: str) -> str:
    if name in STORED_NAMES:
        return STORED_NAMES[name]
    if name.startswith(PLAIN_PREFIXES):
        return name.removesuffix("_total")
    if name.startswith(DOTTED_PREFIXES):
        name = name.removesuffix("_total")
        unit = next((u for u in UNITS if name.endswith(u)), "")
        return name.removesuffix(unit).replace("_", ".")
    return name


def metric(name: str, aggregation: str) -> tuple[str, str]:
    """The stored name, and the table it is read from: gauge or sum."""
    stored = stored_name(name)
    return stored, "sum" if aggregation == "rate" or name.endswith("_total") or stored.endswith(".sum") else "gauge"
