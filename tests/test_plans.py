from datetime import datetime, timedelta

import pytest

from beaconlake.functions import labels
from beaconlake.plans import logql, params, promql, schema, selectors, traceql
from beaconlake.plans.model import ApiError, Matcher, Op, Window

W = Window(datetime(2024, 1, 1), datetime(2024, 1, 2))


def reason(call, *args):
    with pytest.raises(ApiError) as e:
        call(*args)
    assert e.value.status == 400
    return e.value.reason


# The registry


def test_scopes_and_pinned_lists():
    assert [len(labels.names(s)) for s in labels.SCOPES] == [16, 22, 31]
    assert len(labels.LABELS) == 37
    assert labels.metric_label_names() == ["__name__", "service_name", "deployment_environment"]
    assert labels.stream_labels() == [
        "service_name", "service_namespace", "service_instance_id", "deployment_environment", "host_name", "scope_name",
        "severity_text", "trace_id", "span_id", "http_route", "http_method",
    ]
    assert labels.log_columns() == [*labels.stream_labels(), "http_status_code"]
    assert [n for n, _ in labels.listed(labels.LOGS)] == [
        "service_name", "service_namespace", "deployment_environment", "host_name", "scope_name", "severity_text", "http_route", "http_method",
    ]


def test_an_alias_has_one_meaning_in_a_scope():
    for scope in labels.SCOPES:
        meaning = {}
        for x in labels.LABELS:
            if x.place(scope):
                for a in x.aliases:
                    assert meaning.setdefault(a, x.name) == x.name
    assert labels.canonical(labels.LOGS, "http.response.status_code") == "http_status_code"
    assert labels.canonical(labels.METRICS, "http.response.status_code") == "http_response_status_code"
    assert labels.canonical(labels.LOGS, "job") is None
    assert labels.tag_name("http_status_code") == "http.status_code" and labels.tag_name("nothing") is None
    assert labels.tag_names() == sorted(set(labels.tag_names())) and "status" in labels.tag_names()


# Selectors


def test_selector_parts():
    name, found = selectors.parse('m.x{a="1,2", b!="x", c=~"a|b" , d!~"z",}', "r")
    assert name == "m.x"
    assert found == [Matcher("a", Op.EQ, "1,2"), Matcher("b", Op.NE, "x"), Matcher("c", Op.RE, "a|b"), Matcher("d", Op.NOT_RE, "z")]
    assert selectors.parse("{}", "r") == ("", [])
    assert selectors.parse('{a="x\\"y"}', "r")[1] == [Matcher("a", Op.EQ, 'x\\"y')]


@pytest.mark.parametrize(
    ("text", "want"),
    [('{a="x', "invalid_selector"), ('{a="x}', "r"), ("{a}", "r"), ("a b", "r"), ("", "r"), ('{a="b"} tail', "invalid_selector")],
)
def test_bad_selectors(text, want):
    assert reason(selectors.parse, text, "r") == want


def test_conflicts_fail_closed():
    same = [Matcher("service.name", Op.EQ, "a"), Matcher("service_name", Op.EQ, "a")]
    assert len(selectors.resolve(same, labels.LOGS, "r")) == 2
    assert reason(selectors.resolve, [same[0], Matcher("service_name", Op.EQ, "b")], labels.LOGS, "r") == "r"
    assert reason(selectors.resolve, [Matcher("nothing", Op.EQ, "a")], labels.LOGS, "r") == "r"


@pytest.mark.parametrize("pattern", ["(?=a)", "(?!a)", "(?<=a)b", "(a)\\1", "a++", "(?>a)", "("])
def test_patterns_that_linear_engines_lack(pattern):
    assert reason(selectors.resolve, [Matcher("service_name", Op.RE, pattern)], labels.LOGS, "r") == "r"


def test_patterns_that_are_fine():
    for p in ("a+b*", "\\\\d1", "(?i)x", "(?P<n>a)", "a{2,3}"):
        selectors.resolve([Matcher("service_name", Op.RE, p)], labels.LOGS, "r")


# Log queries


def test_log_filters():
    plan = logql.parse('{service.name="x", k8s_node_name=~"a,b"} |= "time out"', W, 10)
    assert plan.matchers == (Matcher("service_name", Op.EQ, "x"), Matcher("k8s_node_name", Op.RE, "a,b"))
    assert [(t.term, t.regex) for t in plan.text] == [("time out", False)]
    assert [(t.term, t.regex) for t in logql.parse('{} |~ "a|b"', W, 1).text] == [("a|b", True)]
    assert [(t.term, t.regex) for t in logql.parse('{} |= "a" |= "b"', W, 1).text] == [('a" |= "b', False)]
    assert logql.parse("{}", W, 1, "FORWARD").forward and not logql.parse("{}", W, 1).forward


def test_other_log_filters_are_refused():
    assert reason(logql.parse, '{a="x"} != "y"', W, 1) == "invalid_selector"
    assert reason(logql.parse, '{service_name="x"} | json', W, 1) == "invalid_selector"


# Metric queries


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("m", ("m", "gauge", "avg", (), False)),
        ("((m))", ("m", "gauge", "avg", (), False)),
        ("sum(m)", ("m", "gauge", "sum", (), False)),
        ("sum by (service.name) (m)", ("m", "gauge", "sum", ("service_name",), True)),
        ("max(m) by (state, state)", ("m", "gauge", "max", ("state",), True)),
        ("sum by (state) (rate(m[5m]))", ("m", "sum", "rate", ("state",), True)),
        ("rate(m[5m])", ("m", "sum", "rate", (), False)),
        ("avg(min(m))", ("m", "gauge", "min", (), False)),
        ("foo_total", ("foo_total", "sum", "avg", (), False)),
        ('{__name__="a.sum"}', ("a.sum", "sum", "avg", (), False)),
        ("system_cpu_time_seconds_total", ("system.cpu.time", "sum", "avg", (), False)),
        ("otelcol_exporter_sent_spans_total", ("otelcol_exporter_sent_spans", "sum", "avg", (), False)),
        ("demo_recommendation_requests_total", ("app_recommendations_counter", "sum", "avg", (), False)),
        ("process_runtime_memory_bytes", ("process.runtime.memory", "gauge", "avg", (), False)),
    ],
)
def test_metric_queries(text, want):
    q = promql.parse(text)
    assert (q.name, q.signal, q.aggregation, q.group_by, q.explicit_grouping) == want


def test_without():
    q = promql.parse("sum without (state, cpu) (m)")
    assert len(q.group_by) == 29 and "state" not in q.group_by and q.explicit_grouping


@pytest.mark.parametrize("text", ["a + b", "topk(3, m)", "sum(m) by (nope)", "sum(m) offset 5m", "sum by (state) (m) by (cpu)", '{a="b"}', "sum m", "m offset 5m", "increase(m[5m])"])
def test_unsupported_metric_queries(text):
    assert reason(promql.parse, text) == "unsupported_promql"


# Trace search


def test_trace_search():
    plan = traceql.parse({"q": '{ resource.service.name = "a b" && status != 2 || http.route=~"/x.*" }', "tags": "span.name=go", "service_name": "a b"}, W, 5)
    assert set(plan.matchers) == {
        Matcher("service_name", Op.EQ, "a b"), Matcher("status_code", Op.NE, "2"), Matcher("http_route", Op.RE, "/x.*"), Matcher("span_name", Op.EQ, "go"),
    }
    assert traceql.parse({"q": "{ duration > 5s && span.http.route=x }"}, W, 5).matchers == ()
    assert reason(traceql.parse, {"q": "service.name=a", "tags": "service_name=b"}, W, 5) == "unsupported_selector"


# Parameters


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2024-01-02T03:04:05Z", datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02T03:04:05.123456789+02:00", datetime(2024, 1, 2, 1, 4, 5, 123456)),
        ("1700000000", datetime(2023, 11, 14, 22, 13, 20)),
        ("1700000000000000000", datetime(2023, 11, 14, 22, 13, 20)),
        ("1700000000.5", datetime(2023, 11, 14, 22, 13, 20, 500000)),
        ("nan", None), ("soon", None), ("", None), ("9" * 25, None),
    ],
)
def test_times(raw, want):
    assert params.parse_time(raw) == want


def test_ranges_steps_and_limits():
    day = timedelta(days=1)
    assert reason(params.check_range, W.end, W.start, day) == "invalid_time_range"
    assert reason(params.check_range, W.start, W.end, timedelta(hours=23)) == "range_too_large"
    assert params.optional_range({"to": "bad", "from": "1700000000", "end": "1700000100"}, day).start == datetime(2023, 11, 14, 22, 13, 20)
    assert reason(params.optional_range, {"end": "bad"}, day) == "invalid_time_range"
    assert params.step("15s") == params.step("15") == 15
    for bad in ("1m", "15.0", "", "s"):
        assert reason(params.step, bad) == "invalid_step"
    assert params.limit("x", 7, 10) == params.limit(None, 7, 10) == 7
    for bad in ("0", "11"):
        assert reason(params.limit, bad, 7, 10) == "limit_too_large"
    assert reason(params.required, {"query": ""}, "query") == "missing_parameter"


def test_schema_versions():
    assert schema.check_version(None) == schema.check_version("3") == 3
    for bad in ("2", "4", "x"):
        with pytest.raises(schema.SchemaError):
            schema.check_version(bad)
