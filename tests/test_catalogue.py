import pytest
from conftest import rows_of

from beaconlake.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_sql(name, spark, sf, oracle):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), oracle.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_time_range_and_label_reach_the_scan(spark, sf, tmp_path):
    from datetime import datetime

    from beaconlake.operators import compile as compiled
    from beaconlake.plans import logql, schema
    from beaconlake.plans.model import Window
    from beaconlake.sources.tables import FixtureTables, ParquetTables

    store = ParquetTables(spark, str(tmp_path))
    store.write(schema.LOGS, FixtureTables(spark, sf).table(schema.LOGS))
    plan = logql.parse('{service_name="svc-1"}', Window(datetime(2024, 1, 10), datetime(2024, 1, 12)), 5)
    text = compiled.logs(plan, store)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(service_name,svc-1)" in text and "GreaterThanOrEqual(time_unix_nano" in text
    assert "PartitionFilters: [isnotnull(event_date" in text
    assert "events_json" not in text and "TakeOrderedAndProject" in text
    fixture = compiled.logs(plan, FixtureTables(spark, sf)).drop("event_date").collect()
    assert [r["body"] for r in compiled.logs(plan, store).collect()] == [r["body"] for r in fixture]
