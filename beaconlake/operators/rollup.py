"""The summary that discovery reads: label values, series and metric descriptions by day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.functions import labels
from beaconlake.plans import schema
from beaconlake.sources.tables import Tables

SCOPE = {schema.LOGS: labels.LOGS, schema.SPANS: labels.SPANS, schema.GAUGE: labels.METRICS, schema.SUM: labels.METRICS}
METRIC_TYPE = {schema.GAUGE: "gauge", schema.SUM: "counter"}
_KEYS = ("kind", "name", "value", "metric_type", "metric_unit", "metric_description", "service_name", "deployment_environment", "severity_text")


def _entry(**values: Column) -> Column:
    return F.struct(*(values.get(k, F.lit(None)).cast("string").alias(k) for k in _KEYS))


#: The columns that a signal's entries are made from, in parts, each of which has few values beside the rows: what describes a
#: resource goes together, and attributes stand alone.
_METRIC_PARTS = (("name", "service_name", "resource_attributes"), ("name", "unit", "description"))
PARTS = {
    schema.LOGS: (("service_name", "service_namespace", "resource_attributes", "severity_text"), ("scope_name",), ("log_attributes",)),
    schema.SPANS: (("service_name", "service_namespace", "resource_attributes"), ("name", "status_code"), ("span_attributes",)),
    schema.GAUGE: _METRIC_PARTS,
    schema.SUM: _METRIC_PARTS,
}


def _entries(signal: str) -> list[tuple[set[str], Column]]:
    """What a row of the signal adds to the summary, each with the columns that it is made from."""
    scope = SCOPE[signal]
    kind = F.lit("tag_value" if signal == schema.SPANS else "label_value")
    out = [(labels.columns(scope, of), _entry(kind=kind, name=F.lit(n), value=labels.expression(scope, of))) for n, of in labels.listed(scope)]
    env, of_env = labels.expression(scope, "deployment_environment"), labels.columns(scope, "deployment_environment")
    if signal == schema.LOGS:
        series = _entry(kind=F.lit("series"), service_name=F.col("service_name"), deployment_environment=env, severity_text=F.col("severity_text"))
        out.append(({"service_name", "severity_text"} | of_env, series))
    elif signal in METRIC_TYPE:
        out.append(({"name"}, _entry(kind=kind, name=F.lit("__name__"), value=F.col("name"))))
        out.append(({"name", "service_name"} | of_env, _entry(kind=F.lit("series"), name=F.col("name"), service_name=F.col("service_name"), deployment_environment=env)))
        metadata = _entry(kind=F.lit("metric_metadata"), name=F.col("name"), metric_type=F.lit(METRIC_TYPE[signal]), metric_unit=F.col("unit"), metric_description=F.col("description"))
        out.append(({"name", "unit", "description"}, metadata))
    return out


def _distinct(signal: str, rows: DataFrame) -> DataFrame:
    """The different values of each part of the columns by day, with their number and times; other parts' columns are null."""
    parts = PARTS[signal]
    names = list(dict.fromkeys(c for p in parts for c in p))
    each = (F.struct(F.lit(i).alias("part"), *(F.when(F.lit(c in p), F.col(c)).alias(c) for c in names)) for i, p in enumerate(parts))
    flat = rows.select(F.col(schema.EVENT_TIME[signal]).alias("at"), F.explode(F.array(*each)).alias("s"))
    return flat.groupBy(F.to_date("at").alias("event_date"), *(F.col(f"s.{c}").alias(c) for c in ("part", *names))).agg(
        F.count("*").alias("row_count"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen")
    )


def summarise(signal: str, rows: DataFrame) -> DataFrame:
    """The summary of some rows of a signal, in one pass; null and empty values are left out.

    Attributes are JSON, and each label costs a parse. So rows are counted by the texts first, and labels are read
    from the different ones.
    """
    of_part: list[list[Column]] = [[] for _ in PARTS[signal]]
    for columns, entry in _entries(signal):
        of_part[next(i for i, p in enumerate(PARTS[signal]) if columns <= set(p))].append(entry)
    here = reduce(lambda out, x: out.when(F.col("part") == x[0], F.array(*x[1])), enumerate(of_part), F)
    flat = _distinct(signal, rows).select("event_date", "row_count", "first_seen", "last_seen", F.explode(here).alias("e"))
    flat = flat.filter("e.kind not in ('label_value', 'tag_value') or (e.value is not null and e.value <> '')")
    return merge(flat.select(F.lit(signal).alias("signal"), "event_date", "e.*", "row_count", "first_seen", "last_seen"))


def merge(summaries: DataFrame) -> DataFrame:
    """Summaries of parts, of batches of a stream for instance, as one."""
    out = summaries.groupBy("signal", "event_date", *_KEYS).agg(
        F.sum("row_count").alias("row_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    return schema.conform(out, schema.SUMMARY)


def rollup(tables: Tables) -> DataFrame:
    return reduce(DataFrame.unionByName, (summarise(s, tables.table(s)) for s in schema.SIGNALS))
