"""Label values, series and metric descriptions: from the summary, or from the points where it has none."""

from __future__ import annotations

import json
import threading
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.functions import labels
from beaconlake.plans import schema
from beaconlake.plans.model import Window
from beaconlake.sources.tables import Tables

MOST_ROWS = 1000
METRIC_SIGNALS = (schema.GAUGE, schema.SUM)


def _cut(t) -> Column:
    return F.lit(t.replace(microsecond=t.microsecond // 1000 * 1000)).cast("timestamp_ntz")


def _seen(summary: DataFrame, signals: tuple[str, ...], kind: str, window: Window | None) -> DataFrame:
    df = summary.filter((F.col("kind") == kind) & F.col("signal").isin(*signals))
    if window is None:
        return df
    # A day that ends before the window, or begins after it, holds nothing of it.
    df = df.filter(F.col("event_date").isNull() | F.col("event_date").between(F.lit(window.start.date()), F.lit(window.end.date())))
    return df.filter((F.col("first_seen") < _cut(window.end)) & (F.col("last_seen") >= _cut(window.start)))


def _by_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(F.col("rows").desc(), *(F.col(k).asc_nulls_last() for k in keys)).limit(MOST_ROWS)


def values(summary: DataFrame, signals: tuple[str, ...], kind: str, name: str, window: Window) -> DataFrame:
    """value and rows, in the order of the values."""
    df = _seen(summary, signals, kind, window).filter((F.col("name") == name) & F.col("value").isNotNull())
    return df.groupBy("value").agg(F.sum("row_count").alias("rows")).orderBy("value").limit(MOST_ROWS)


def series(summary: DataFrame, signals: tuple[str, ...], keys: list[str], window: Window) -> DataFrame:
    return _by_rows(_seen(summary, signals, "series", window).groupBy(*keys).agg(F.sum("row_count").alias("rows")), keys)


def metric_metadata(summary: DataFrame) -> DataFrame:
    text = lambda c: F.max(F.coalesce(F.col(c), F.lit("")))
    out = _seen(summary, METRIC_SIGNALS, "metric_metadata", None).groupBy("name", "metric_type").agg(
        text("metric_unit").alias("unit"), text("metric_description").alias("help"), F.max("last_seen").alias("last_seen")
    )
    return out.orderBy(F.col("last_seen").desc_nulls_last(), F.col("name").asc_nulls_last(), F.col("metric_type").asc_nulls_last()).limit(MOST_ROWS)


def _points(tables: Tables, window: Window, *columns: Column) -> DataFrame:
    gauge, total = (tables.within(s, window.start, window.end).select(*columns) for s in METRIC_SIGNALS)
    return gauge.unionByName(total)


def raw_values(tables: Tables, name: str, window: Window) -> DataFrame:
    at = F.col("name") if name == "__name__" else labels.expression(labels.METRICS, name).cast("string")
    df = _points(tables, window, at.alias("value")).filter("value is not null and value <> ''")
    return df.distinct().orderBy("value").limit(MOST_ROWS)


SERIES_KEYS = ["name", "service_name", "deployment_environment"]


def raw_series(tables: Tables, window: Window) -> DataFrame:
    env = labels.expression(labels.METRICS, "deployment_environment").alias("deployment_environment")
    df = _points(tables, window, F.col("name"), F.col("service_name"), env)
    return _by_rows(df.groupBy(*SERIES_KEYS).agg(F.count("*").alias("rows")), SERIES_KEYS)


class Cache:
    """Answers by request and window, first in first out; a new generation of the summary empties it."""

    MOST_ENTRIES, MOST_BYTES = 128, 128 * 1024

    def __init__(self) -> None:
        self._kept: OrderedDict[tuple, Any] = OrderedDict()
        self._lock = threading.Lock()
        self.generation = 0

    def __len__(self) -> int:
        return len(self._kept)

    def renew(self) -> None:
        with self._lock:
            self.generation += 1
            self._kept.clear()

    def get(self, key: tuple, make: Callable[[], Any]) -> Any:
        with self._lock:
            if key in self._kept:
                return self._kept[key]
            generation = self.generation
        value = make()
        if len(json.dumps(value)) <= self.MOST_BYTES:
            with self._lock:
                if generation == self.generation:
                    self._kept[key] = value
                    while len(self._kept) > self.MOST_ENTRIES:
                        self._kept.popitem(last=False)
        return value


class Discovery:
    """Answers in plain values. Unknown labels have no values."""

    def __init__(self, tables: Tables, cache: Cache | None = None) -> None:
        self.tables, self.cache = tables, cache or Cache()

    def _cached(self, api: str, kind: str, name: str, window: Window | None, make: Callable[[], Any]) -> Any:
        when = tuple(t.isoformat(timespec="milliseconds") for t in (window.start, window.end)) if window else ()
        return self.cache.get((api, kind, name, *when), make)

    @staticmethod
    def _column(df: DataFrame) -> list[str]:
        return sorted({r["value"] for r in df.collect()})

    @staticmethod
    def _label_sets(df: DataFrame, keys: dict[str, str]) -> list[dict[str, str]]:
        return [{shown: r[k] for k, shown in keys.items() if r[k]} for r in df.collect()]

    def metric_label_values(self, name: str, window: Window) -> list[str]:
        name = "__name__" if name == "__name__" else labels.canonical(labels.METRICS, name)
        if name is None:
            return []

        def make() -> list[str]:
            found = self._column(values(self.tables.summary(), METRIC_SIGNALS, "label_value", name, window))
            return found or self._column(raw_values(self.tables, name, window))

        return self._cached("metrics", "values", name, window, make)

    def metric_series(self, window: Window) -> list[dict[str, str]]:
        keys = {"name": "__name__", "service_name": "service_name", "deployment_environment": "deployment_environment"}

        def make() -> list[dict[str, str]]:
            found = self._label_sets(series(self.tables.summary(), METRIC_SIGNALS, SERIES_KEYS, window), keys)
            return found or self._label_sets(raw_series(self.tables, window), keys)

        return self._cached("metrics", "series", "", window, make)

    def metric_metadata(self) -> dict[str, list[dict[str, str]]]:
        def make() -> dict[str, list[dict[str, str]]]:
            out: dict[str, list[dict[str, str]]] = {}
            for r in metric_metadata(self.tables.summary()).collect():
                out.setdefault(r["name"], []).append({"type": r["metric_type"], "unit": r["unit"], "help": r["help"]})
            return out

        return self._cached("metrics", "metadata", "", None, make)

    def log_label_values(self, name: str, window: Window) -> list[str]:
        name = labels.canonical(labels.LOGS, name)
        if name is None:
            return []
        return self._cached("logs", "values", name, window, lambda: self._column(values(self.tables.summary(), (schema.LOGS,), "label_value", name, window)))

    def log_series(self, window: Window) -> list[dict[str, str]]:
        keys = ["service_name", "deployment_environment", "severity_text"]
        make = lambda: self._label_sets(series(self.tables.summary(), (schema.LOGS,), keys, window), {k: k for k in keys})
        return self._cached("logs", "series", "", window, make)

    def tag_values(self, tag: str, window: Window) -> list[str]:
        name = labels.tag_name(tag)
        if name is None:
            return []
        return self._cached("traces", "values", name, window, lambda: self._column(values(self.tables.summary(), (schema.SPANS,), "tag_value", name, window)))
