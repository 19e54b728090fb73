"""The label registry: the spellings of a label, and where each kind of row keeps it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGS, SPANS, METRICS = "logs", "spans", "metrics"
SCOPES = (LOGS, SPANS, METRICS)
#: The column that holds a row's own attributes.
OWN = {LOGS: "log_attributes", SPANS: "span_attributes", METRICS: "metric_attributes"}

#: Labels of so many values that they are never listed.
UNBOUNDED = frozenset({"trace_id", "span_id", "service_instance_id"})


@dataclass(frozen=True)
class Place:
    """Where rows of a kind keep a label: kind says how the keys are read."""

    kind: str
    keys: tuple[str, ...] = ()


def column(name: str) -> Place:
    """A column."""
    return Place("column", (name,))


def lower(name: str) -> Place:
    """A column in lower case."""
    return Place("lower", (name,))


def resource(key: str) -> Place:
    """An attribute of the resource."""
    return Place("resource", (key,))


def own(*keys: str) -> Place:
    """The first of the row's own attributes that is there."""
    return Place("own", keys)


def number(*keys: str) -> Place:
    """The same as a whole number."""
    return Place("number", keys)


def unset() -> Place:
    """A label that is never set."""
    return Place("unset")


@dataclass(frozen=True)
class Label:
    """A label, its other spellings, its place in each kind of row that has it, and where it is shown: as a metric's label,
    as a stream label, as a column of log rows, as a tag of traces."""

    name: str
    aliases: tuple[str, ...] = ()
    logs: Place | None = None
    spans: Place | None = None
    metrics: Place | None = None
    metric_label: bool = False
    stream_label: bool = False
    log_column: bool = False
    tag: str | None = None

    def place(self, scope: str) -> Place | None:
        return {LOGS: self.logs, SPANS: self.spans, METRICS: self.metrics}[scope]


#: Label names, aliases, places and uses, in the order in which they are shown.
LABELS = (
    Label(
        "service_name", ("service.name", "resource.service.name", "serviceName", "service-name"), logs=column("service_name"),
        spans=column("service_name"), metrics=column("service_name"), metric_label=True, stream_label=True, log_column=True,
        tag="service.name",
    ),
    Label(
        "service_namespace", ("service.namespace", "resource.service.namespace", "service-namespace"),
        logs=column("service_namespace"), spans=column("service_namespace"), metrics=column("service_namespace"),
        stream_label=True, log_column=True, tag="service.namespace",
    ),
    Label(
        "service_instance_id", ("service.instance.id", "resource.service.instance.id", "service-instance-id"),
        logs=column("service_instance_id"), spans=column("service_instance_id"), metrics=column("service_instance_id"),
        stream_label=True, log_column=True, tag="service.instance.id",
    ),
    Label(
        "deployment_environment", ("deployment.environment", "deployment_environment_name", "deployment-environment"),
        logs=resource("deployment.environment"), spans=resource("deployment.environment"),
        metrics=resource("deployment.environment"), metric_label=True, stream_label=True, log_column=True,
        tag="deployment.environment",
    ),
    Label(
        "host_name", ("host.name", "resource.host.name", "host-name"), logs=resource("host.name"), spans=resource("host.name"),
        metrics=resource("host.name"), stream_label=True, log_column=True, tag="host.name",
    ),
    Label(
        "k8s_cluster_name", ("k8s.cluster.name",), logs=resource("k8s.cluster.name"), spans=resource("k8s.cluster.name"),
        metrics=resource("k8s.cluster.name"),
    ),
    Label(
        "k8s_node_name", ("k8s.node.name",), logs=resource("k8s.node.name"), spans=resource("k8s.node.name"),
        metrics=resource("k8s.node.name"),
    ),
    Label(
        "k8s_statefulset_name", ("k8s.statefulset.name",), logs=resource("k8s.statefulset.name"),
        spans=resource("k8s.statefulset.name"), metrics=resource("k8s.statefulset.name"),
    ),
    Label(
        "k8s_deployment_name", ("k8s.deployment.name",), logs=resource("k8s.deployment.name"),
        spans=resource("k8s.deployment.name"), metrics=resource("k8s.deployment.name"), tag="k8s.deployment.name",
    ),
    Label(
        "scope_name", ("instrumentationScope.name", "instrumentation_scope_name"), logs=column("scope_name"), stream_label=True,
        log_column=True,
    ),
    Label("severity_text", ("severity.text",), logs=column("severity_text"), stream_label=True, log_column=True),
    Label("trace_id", ("traceID",), logs=lower("trace_id"), spans=lower("trace_id"), stream_label=True, log_column=True, tag="traceID"),
    Label("span_id", ("spanID",), logs=lower("span_id"), spans=lower("span_id"), stream_label=True, log_column=True, tag="spanID"),
    Label(
        "http_route", ("http.route", "http-route"), logs=own("http.route"), spans=own("http.route"), metrics=own("http.route"),
        stream_label=True, log_column=True, tag="http.route",
    ),
    Label(
        "http_method", ("http.method", "http.request.method", "http-method"), logs=own("http.request.method", "http.method"),
        spans=own("http.request.method", "http.method"), metrics=own("http.request.method"), stream_label=True, log_column=True,
        tag="http.method",
    ),
    Label(
        "http_status_code", ("http.status_code", "http.response.status_code", "http-status-code"),
        logs=number("http.response.status_code", "http.status_code"),
        spans=number("http.response.status_code", "http.status_code"), log_column=True, tag="http.status_code",
    ),
    Label("http_response_status_code", ("http.response.status_code",), metrics=own("http.response.status_code")),
    Label("span_name", ("span.name", "span-name", "name"), spans=column("name"), metrics=own("span.name"), tag="span.name"),
    Label("status_code", ("status.code", "status"), spans=column("status_code"), metrics=own("status.code"), tag="status.code"),
    Label("job", (), metrics=unset()),
    Label("instance", (), metrics=unset()),
    Label("state", (), metrics=own("state")),
    Label("type", (), metrics=own("type")),
    Label("cpu", (), metrics=own("cpu")),
    Label("exporter", (), metrics=own("exporter")),
    Label("receiver", (), metrics=own("receiver")),
    Label("processor", (), metrics=own("processor")),
    Label("otel_signal", (), metrics=own("otel_signal")),
    Label("data_type", (), metrics=own("data_type")),
    Label("postgresql_database_name", ("postgresql.database.name",), metrics=own("postgresql.database.name")),
    Label("rpc_service", ("rpc.service",), spans=own("rpc.service"), metrics=own("rpc.service"), tag="rpc.service"),
    Label("rpc_method", ("rpc.method",), spans=own("rpc.method"), metrics=own("rpc.method"), tag="rpc.method"),
    Label(
        "rpc_grpc_status_code", ("rpc.grpc.status_code",), spans=own("rpc.grpc.status_code"), metrics=own("rpc.grpc.status_code"),
        tag="rpc.grpc.status_code",
    ),
    Label("server_address", ("server.address",), spans=own("server.address"), metrics=own("server.address"), tag="server.address"),
    Label("url_template", ("url.template",), metrics=own("url.template")),
    Label("db_namespace", ("db.namespace",), spans=own("db.namespace"), metrics=own("db.namespace"), tag="db.namespace"),
    Label("exception_type", ("exception.type",), spans=own("exception.type"), tag="exception.type"),
)


@cache
def aliases(scope: str) -> dict[str, str]:
    """Each spelling that the scope knows, and the label it means; names go before aliases of other labels."""
    known = [x for x in LABELS if x.place(scope)]
    out = {x.name: x.name for x in known}
    for x in known:
        for a in x.aliases:
            out.setdefault(a, x.name)
    return out


@cache
def spellings(scope: str) -> tuple[str, ...]:
    """The same spellings in the registry's order: a label, then its aliases."""
    return tuple(s for x in LABELS if x.place(scope) for s in (x.name, *x.aliases))


def canonical(scope: str, spelling: str) -> str | None:
    return aliases(scope).get(spelling)


def names(scope: str) -> list[str]:
    return [x.name for x in LABELS if x.place(scope)]


def stream_labels() -> list[str]:
    return [x.name for x in LABELS if x.stream_label and x.logs]


def log_columns() -> list[str]:
    return [x.name for x in LABELS if x.log_column and x.logs]


def metric_label_names() -> list[str]:
    return ["__name__", *(x.name for x in LABELS if x.metric_label and x.metrics)]


def tag_names() -> list[str]:
    return sorted({s for x in LABELS if x.tag and x.spans for s in (x.tag, x.name, *x.aliases)})


def tag_name(spelling: str) -> str | None:
    """The tag that a spelling means; labels without spans in them count too."""
    return next((x.tag for x in LABELS if x.tag and spelling in (x.tag, x.name, *x.aliases)), None)


def listed(scope: str) -> list[tuple[str, str]]:
    """(name in the summary, label) of the labels whose values are listed."""
    out = []
    for x in LABELS:
        shown = {LOGS: x.stream_label and x.name, METRICS: x.metric_label and x.name, SPANS: x.tag}[scope]
        if x.place(scope) and x.name not in UNBOUNDED and shown:
            out.append((shown, x.name))
    return out


def attribute(column: str, key: str) -> Column:
    """A JSON attribute as text. Keys hold dots, so they are quoted; broken JSON gives null."""
    return F.get_json_object(column, f"$['{key}']")


def whole(text: Column) -> Column:
    """Text as an INT, rounded half away from zero; null where it is no number or does not fit."""
    return F.round(text.try_cast("double")).try_cast("int")


def place(scope: str, name: str) -> Place | None:
    return next((x.place(scope) for x in LABELS if x.name == name), None)


def plain_column(scope: str, name: str) -> str | None:
    """The string column that holds the label as it is, if one does; filters on it reach the scan."""
    at = place(scope, name)
    return at.keys[0] if at and at.kind == "column" and not (scope == SPANS and name == "status_code") else None


def expression(scope: str, name: str) -> Column:
    """The label's value in a row of the scope."""
    at = place(scope, name)
    if at is None:
        raise KeyError(f"{scope} rows have no label {name}")
    if at.kind == "column":
        return F.col(at.keys[0])
    if at.kind == "lower":
        return F.lower(F.col(at.keys[0]))
    if at.kind == "resource":
        return attribute("resource_attributes", at.keys[0])
    if at.kind == "unset":
        return F.lit(None).cast("string")
    found = [attribute(OWN[scope], k) for k in at.keys]
    return F.coalesce(*(map(whole, found) if at.kind == "number" else found))


def columns(scope: str, name: str) -> set[str]:
    """The columns that the label's value is read from."""
    at = place(scope, name)
    return set({"resource": ("resource_attributes",), "own": (OWN[scope],), "number": (OWN[scope],)}.get(at.kind, at.keys))
