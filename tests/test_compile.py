"""Semantics on rows made for them."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from beaconlake.functions import labels
from beaconlake.operators import compile as compiled
from beaconlake.operators import discovery, health, rollup
from beaconlake.plans import logql, promql, schema, traceql
from beaconlake.plans.model import ApiError, Matcher, MetricPlan, Op, Window
from beaconlake.sources.catalogs import storage_layout
from beaconlake.sources.tables import DictTables, ParquetTables

T0 = datetime(2024, 1, 1)
W = Window(T0, T0 + timedelta(days=1))


def frame(spark, table, rows):
    names = [f.name for f in schema.SCHEMAS[table].fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema.SCHEMAS[table])


def logs(spark, rows):
    made = [{"time_unix_nano": T0 + timedelta(seconds=i), "span_id": str(i)} | r for i, r in enumerate(rows)]
    return DictTables(spark, **{schema.LOGS: frame(spark, schema.LOGS, made)})


def ids(tables, text, **more):
    return sorted(int(r["span_id"]) for r in compiled.logs(logql.parse(text, W, 1000, **more), tables).collect())


def test_label_operators_on_null_and_empty(spark):
    t = logs(spark, [{"service_name": None}, {"service_name": ""}, {"service_name": "a"}, {"service_name": "ab"}])
    assert ids(t, '{service_name="a"}') == [2]
    assert ids(t, '{service_name=""}') == [0, 1]
    assert ids(t, '{service_name!="a"}') == [0, 1, 3]
    assert ids(t, '{service_name!=""}') == [2, 3]
    assert ids(t, '{service_name=~"b"}') == [3]
    assert ids(t, '{service_name!~"b"}') == [0, 1, 2]
    assert ids(t, '{service_name=~".*"}') == [0, 1, 2, 3] and ids(t, '{service_name!~".*"}') == []


def test_pushed_filters_mean_the_same_as_the_plain_ones(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("b",)], "service_name string")
    text = F.coalesce("service_name", F.lit(""))
    for op, plain in ((Op.EQ, lambda v: text == v), (Op.NE, lambda v: text != v)):
        for value in ("", "a"):
            got = df.filter(compiled.matches(Matcher("service_name", op, value), "logs")).collect()
            assert got == df.filter(plain(value)).collect()


def test_json_attributes(spark):
    rows = [
        {"log_attributes": None}, {"log_attributes": "{broken"}, {"log_attributes": '{"http.status_code":200}'},
        {"log_attributes": '{"http.status_code":"200.7"}'}, {"log_attributes": '{"http.response.status_code":"abc","http.status_code":404}'},
        {"log_attributes": '{"http.status_code":true}'}, {"log_attributes": '{"http":{"status_code":1}}'}, {"log_attributes": '{"http.status_code":null}'},
    ]
    t = logs(spark, rows)
    got = {int(r["span_id"]): r["http_status_code"] for r in compiled.logs(logql.parse("{}", W, 100), t).collect()}
    assert got == {0: None, 1: None, 2: "200", 3: "201", 4: "404", 5: None, 6: None, 7: None}
    assert ids(t, '{http_status_code="404"}') == [4] and ids(t, '{http_status_code=""}') == [0, 1, 5, 6, 7]


def test_text_terms(spark):
    t = logs(spark, [{"body": b} for b in ("Disk FULL on a", "disk ok", "100% full", "a\\b", "a or b", None)])
    assert ids(t, '{} |= "disk"') == [0, 1]
    assert ids(t, '{} |= "disk AND full"') == [0]
    assert ids(t, '{} |= "full OR ok"') == [0, 1, 2]
    assert ids(t, '{} |= "a or b"') == [4]
    assert ids(t, '{} |= "d_sk"') == [0, 1]
    assert ids(t, '{} |= "a\\b"') == [3]
    assert ids(t, '{} |= ""') == [0, 1, 2, 3, 4, 5]
    assert ids(t, '{} |~ "^$"') == [5]
    with pytest.raises(ApiError, match="parentheses"):
        ids(t, '{} |= "(a)"')


def test_time_bounds_are_half_open_and_cut_to_milliseconds(spark):
    at = [T0, T0 + timedelta(milliseconds=1, microseconds=700), T0 + timedelta(milliseconds=2)]
    t = logs(spark, [{"time_unix_nano": x} for x in at])
    window = Window(T0 + timedelta(milliseconds=1, microseconds=900), T0 + timedelta(milliseconds=2, microseconds=900))
    rows = compiled.logs(logql.parse("{}", window, 10), t).collect()
    assert [r["span_id"] for r in rows] == ["1"]


def test_limit_and_order(spark):
    t = logs(spark, [{"body": "x"}] * 5)
    back = compiled.logs(logql.parse("{}", W, 2), t).collect()
    ahead = compiled.logs(logql.parse("{}", W, 2, "forward"), t).collect()
    assert [r["span_id"] for r in back] == ["4", "3", "2"] and [r["span_id"] for r in ahead] == ["0", "1", "2"]


def points(spark, table, rows):
    made = [{"time_unix_nano": T0, "name": "m"} | r for r in rows]
    return DictTables(spark, **{table: frame(spark, table, made)})


def values(tables, text, step=60, **more):
    q = promql.parse(text)
    df = compiled.metric(MetricPlan(q.name, q.matchers, W, more.pop("signal", q.signal), q.aggregation, q.group_by, step, **more), tables)
    return [tuple(r) for r in df.collect()]


def test_aggregations(spark):
    t = points(spark, schema.GAUGE, [{"int_value": 1}, {"double_value": 2.5}, {}, {"int_value": 9, "double_value": 4.0}])
    at = int((T0 - datetime(1970, 1, 1)).total_seconds())
    assert values(t, "m") == [(at, 2.5)]
    assert [values(t, f"{a}(m)")[0][1] for a in ("min", "max", "sum", "count")] == [1.0, 4.0, 7.5, 4.0]


def test_not_a_number_is_greatest(spark):
    t = points(spark, schema.GAUGE, [{"double_value": float("nan")}, {"double_value": float("inf")}, {"double_value": 1.0}])
    assert values(t, "min(m)")[0][1] == 1.0 and values(t, "max(m)")[0][1] != values(t, "max(m)")[0][1]


def test_rate(spark):
    rows = [{"time_unix_nano": T0 + timedelta(seconds=s), "int_value": v, "service_name": n} for s, v, n in ((0, 10, "a"), (10, 40, "a"), (20, 5, "a"), (0, 7, "b"))]
    t = points(spark, schema.SUM, rows)
    got = values(t, "sum by (service_name) (rate(m[1m]))", 3600)
    assert [r[1:] for r in got] == [("a", 35 / 20), ("b", None)]
    with pytest.raises(ApiError) as e:
        values(t, "rate(m)", signal="gauge")
    assert e.value.reason == "unsupported_aggregation"


def test_buckets(spark):
    old = datetime(1969, 12, 31, 23, 59, 30)
    t = points(spark, schema.GAUGE, [{"time_unix_nano": old, "int_value": 1}, {"time_unix_nano": old + timedelta(seconds=60), "int_value": 2}])
    plan = MetricPlan("m", (), Window(old - timedelta(1), old + timedelta(1)), "gauge", "sum", (), 60)
    assert [tuple(r) for r in compiled.metric(plan, t).collect()] == [(-60, 1.0), (0, 2.0)]


def test_labels_that_are_never_set(spark):
    t = points(spark, schema.GAUGE, [{"int_value": 1}])
    assert values(t, "sum by (job, instance) (m)")[0][1:] == (None, None, 1.0)
    assert values(t, 'm{job!=""}') == [] and len(values(t, 'm{job=""}')) == 1


def spans(spark, rows):
    made = [{"start_time_unix_nano": T0 + timedelta(seconds=i), "span_id": f"S{i}"} | r for i, r in enumerate(rows)]
    return DictTables(spark, **{schema.SPANS: frame(spark, schema.SPANS, made)})


def test_trace_search(spark):
    t = spans(spark, [
        {"trace_id": "AB", "name": "z", "service_name": "a", "duration_time_unix_nano": 5}, {"trace_id": "AB", "name": "y", "service_name": "b"},
        {"trace_id": "ab", "name": "x", "status_code": 2}, {"trace_id": None, "duration_time_unix_nano": -3},
    ])
    rows = [tuple(r) for r in compiled.trace_search(traceql.parse({}, W, 10), t).select("trace_id", "service_name", "span_name", "matched_spans", "duration").collect()]
    assert rows == [("", None, None, 1, -3), ("ab", None, "x", 1, None), ("ab", "b", "z", 2, 5)]
    assert compiled.trace_search(traceql.parse({"q": "status=2"}, W, 10), t).count() == 1
    assert len(compiled.trace_search(traceql.parse({}, W, 1), t).collect()) == 2


def test_trace_by_id(spark):
    t = spans(spark, [{"trace_id": "AbCdEf0123456789"}, {"trace_id": "abcdef0123456789", "parent_span_id": "S0"}, {"trace_id": "0" * 16}])
    rows = compiled.trace("ABCDEF0123456789", W.start, W.end, t, True).collect()
    assert [(r["span_id"], r["parent_span_id"]) for r in rows] == [("s0", None), ("s1", "s0")]
    for bad in ("", "xyz", "0" * 15, "0" * 33, "g" * 16):
        with pytest.raises(ApiError):
            compiled.trace(bad, W.start, W.end, t)


def test_rollup_serves_discovery(spark):
    gauge = frame(spark, schema.GAUGE, [
        {"time_unix_nano": T0, "name": "m", "service_name": "a", "unit": "s", "resource_attributes": '{"deployment.environment":"e"}'},
        {"time_unix_nano": T0 + timedelta(days=2), "name": "n", "service_name": "", "description": "d"},
    ])
    log = frame(spark, schema.LOGS, [{"time_unix_nano": T0, "service_name": "a", "severity_text": "INFO"}, {"time_unix_nano": T0, "service_name": None}])
    span = frame(spark, schema.SPANS, [{"start_time_unix_nano": T0, "name": "go", "status_code": 1}])
    raw = DictTables(spark, **{schema.GAUGE: gauge, schema.LOGS: log, schema.SPANS: span})
    full = DictTables(spark, **{schema.GAUGE: gauge, schema.LOGS: log, schema.SPANS: span, schema.SUMMARY: rollup.rollup(raw)})
    d, bare = discovery.Discovery(full), discovery.Discovery(raw)
    for x in (d, bare):  # from the summary, and from the points
        assert x.metric_label_values("__name__", W) == ["m"]
        assert x.metric_label_values("service.name", W) == ["a"]
        assert x.metric_series(W) == [{"__name__": "m", "service_name": "a", "deployment_environment": "e"}]
        assert x.metric_label_values("nothing", W) == []
    assert d.log_label_values("severity.text", W) == ["INFO"] and bare.log_label_values("severity.text", W) == []
    assert d.tag_values("span_name", W) == ["go"] and d.tag_values("status", W) == ["1"] and d.tag_values("nothing", W) == []
    assert d.log_series(W) == [{"service_name": "a", "severity_text": "INFO"}, {}]
    assert d.metric_metadata() == {"n": [{"type": "gauge", "unit": "", "help": "d"}], "m": [{"type": "gauge", "unit": "s", "help": ""}]}
    assert d.log_label_values("trace_id", W) == []


ODD = [
    None, "", "{}", "no json", "[1]", '{"deployment.environment":"e","http.route":"/a","http.method":"GET","http.status_code":"200"}',
    '{"deployment.environment":"e","http.route":"/a","http.method":"GET"', '{"http.route":"/a","http.route":"/b","deployment.environment":null,"deployment.environment":"f"}',
    '{"http.route":{"a":[1]},"http.request.method":"","http.method":"PUT","http.response.status_code":404.5,"host.name":"h"}',
    '{"http\\u002eroute":"/\\u00e9","rpc.service":1e3,"exception.type":"\\ud800","k8s.deployment.name":true} rest',
]


@pytest.mark.parametrize("signal", schema.SIGNALS)
def test_rollup_counts_texts_before_it_reads_them(signal, spark):
    scope, at = rollup.SCOPE[signal], schema.EVENT_TIME[signal]
    rows = [
        {at: when, "service_name": s, "name": s, "status_code": n, "severity_text": s, "unit": s, "resource_attributes": r, labels.OWN[scope]: ODD[-1 - i]}
        for i, r in enumerate(ODD) for n, (s, when) in enumerate([("a", T0), ("", T0 + timedelta(days=1)), (None, None), ("a", T0 + timedelta(seconds=1))])
    ]
    columns = schema.SCHEMAS[signal].names
    df = frame(spark, signal, [{k: v for k, v in {**dict.fromkeys([at]), **r}.items() if k in columns} for r in rows])
    got = rollup.summarise(signal, df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "get_json_object" in plan and "get_json_object" not in plan[plan.rindex("HashAggregate"):]

    def seen(of, *values):
        return of.groupBy(F.to_date(at), *values).agg(F.count("*"), F.min(at), F.max(at)).collect()

    key = lambda r: str(tuple(r))
    have = got.filter("kind in ('label_value', 'tag_value') and name <> '__name__'").select("name", "event_date", "value", "row_count", "first_seen", "last_seen").collect()
    want = [(n, *r) for n, label in labels.listed(scope) for r in seen(df.filter(labels.expression(scope, label).cast("string") != ""), labels.expression(scope, label).cast("string"))]
    assert sorted(map(key, have)) == sorted(map(key, want)) and len(have) > 4
    env = labels.expression(scope, "deployment_environment").alias("env")
    shared = {schema.LOGS: ["service_name", "severity_text"], schema.SPANS: None}.get(signal, ["name", "service_name"])
    have = got.filter("kind = 'series'").select("event_date", *(shared or []), "deployment_environment", "row_count", "first_seen", "last_seen").collect()
    assert sorted(map(key, have)) == sorted(map(key, seen(df, *shared, env) if shared else []))
    have = got.filter("kind = 'metric_metadata' or name = '__name__'").groupBy("kind").agg(F.sum("row_count")).collect()
    assert dict(map(tuple, have)) == ({"metric_metadata": 40, "label_value": 20} if scope == labels.METRICS else {})


def test_cache():
    cache = discovery.Cache()
    made = []
    for i in (1, 1, 2):
        cache.get(("k", i), lambda: made.append(1) or ["v"])
    assert len(made) == 2 and len(cache) == 2
    for i in range(200):
        cache.get(("n", i), list)
    assert len(cache) == cache.MOST_ENTRIES
    cache.get(("big",), lambda: "x" * (cache.MOST_BYTES + 1))
    assert ("big",) not in cache._kept
    cache.renew()
    assert len(cache) == 0


def test_health(spark, tmp_path):
    t = logs(spark, [{"body": "a"}, {"body": "b"}])
    assert {r["signal"]: r["rows"] for r in health.logical_rows(t).collect()} == {schema.LOGS: 2, schema.SPANS: 0, schema.GAUGE: 0, schema.SUM: 0}
    latest = {r["signal"]: r["latest_micros"] for r in health.freshness(t).collect()}
    assert latest[schema.LOGS] == int((T0 - datetime(1970, 1, 1)).total_seconds() + 1) * 10**6 and latest[schema.SUM] is None
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x").write_bytes(b"12345")
    assert health.physical_bytes(spark, str(tmp_path / "a")) == 5 and health.physical_bytes(spark, str(tmp_path / "none")) == 0


def test_layout_keeps_tables_without_files(spark):
    tables = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", 9)], "table_id long, table_name string, end_snapshot long")
    files = spark.createDataFrame([(1, 10, 5, None), (1, 11, 6, 4), (3, 12, 7, None)], "table_id long, data_file_id long, record_count long, end_snapshot long")
    assert sorted(tuple(r) for r in storage_layout(tables, files).collect()) == [(1, "a", 1, 5), (2, "b", 0, 0)]


def test_tables_in_files(spark, tmp_path):
    store = ParquetTables(spark, str(tmp_path / "t"))
    assert store.table(schema.LOGS).count() == 0
    store.create_missing()
    store.ready()
    store.write(schema.LOGS, logs(spark, [{"body": "a"}, {"body": "b", "time_unix_nano": T0 + timedelta(days=3)}]).table(schema.LOGS))
    assert sorted(p.name for p in (tmp_path / "t" / schema.LOGS).iterdir() if "=" in p.name) == ["event_date=2024-01-01", "event_date=2024-01-04"]
    assert [r["body"] for r in store.within(schema.LOGS, W.start, W.end).collect()] == ["a"]


def test_streaming_rollup(spark, tmp_path):
    from beaconlake.streaming import rollup_stream

    source = str(tmp_path / "in")
    rows = frame(spark, schema.LOGS, [{"time_unix_nano": T0, "service_name": "a"}])
    rows.write.parquet(source)
    args = (spark, schema.LOGS, source, str(tmp_path / "out"), str(tmp_path / "check"))
    rollup_stream.start(*args).awaitTermination()
    rows.write.mode("append").parquet(source)
    rollup_stream.start(*args).awaitTermination()
    got = rollup_stream.read(spark, str(tmp_path / "out")).filter("kind = 'label_value' and name = 'service_name'").collect()
    assert [(r["value"], r["row_count"]) for r in got] == [("a", 2)]


def test_nanoseconds_break_ties(spark, tmp_path):
    df = frame(spark, schema.LOGS, [{"time_unix_nano": T0, "span_id": s} for s in "ab"]).withColumn("time_nanos", F.when(F.col("span_id") == "a", 5).otherwise(7).cast("long"))
    df.write.parquet(str(tmp_path / schema.LOGS))
    rows = compiled.logs(logql.parse("{}", W, 5), ParquetTables(spark, str(tmp_path))).collect()
    assert [(r["span_id"], r["time_nanos"]) for r in rows] == [("b", 7), ("a", 5)]


def test_plans_are_plain_values():
    assert json.dumps(promql.parse("m").__dict__) and hash(logql.parse("{}", W, 1))
