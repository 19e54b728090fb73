import base64
import hashlib
import io

import pytest
from conftest import rows_of

from beaconlake.llm import warc

COLUMNS = "page_id long, url string, html string"


def test_captures(spark):
    rows = [(3, "http://a/1", "same"), (1, "http://a/2", "same"), (2, None, "own ü"), (7, "u", None), (5, "u\r\nX: y", ""), (None, "n", "same"), (9, "d", "dup"), (9, "d", "dup")]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' AS row", "1 AS payload")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=str)

    def row(i, text, kind="response", to=None):
        raw = (text or "").encode()
        return i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, to

    want = [row(3, "same"), row(1, "same", "revisit", 3), row(2, "own ü"), row(7, None), row(5, "", "revisit", 7), row(None, "same", "revisit", 3), row(9, "dup"), row(9, "dup", "revisit", 9)]
    assert got == sorted(want, key=str)


def test_records_in_an_archive(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>one"), (2, "http://b", "<p>one")], COLUMNS)
    manifest = warc.write(pages, str(tmp_path / "w"))
    assert manifest.agg({"n_records": "sum"}).first()[0] == 6
    records = warc.records(manifest).collect()
    kinds = sorted(r["type"] for r in records)
    assert kinds == ["metadata", "metadata", "request", "request", "response", "revisit"]
    response, revisit = (next(r for r in records if r["type"] == k) for k in ("response", "revisit"))
    assert response["payload"] == b"<p>one" and response["declared_digest"] == "sha1:" + response["sha1"]
    assert revisit["refers_to"] == response["record_id"] and revisit["payload"] is None
    assert {r["concurrent_to"] for r in records if r["type"] in ("request", "metadata")} == {response["record_id"], revisit["record_id"]}


def test_transactions_over_chains_and_gaps(spark):
    schema = warc._RECORD
    make = lambda i, kind, to=None: (i, kind, to, None, "u", None, None, None, 0, None, 5 if kind == "metadata" else None)
    rows = [make("r1", "response"), make("q1", "request", "r1"), make("m1", "metadata", "q1"), make("r2", "response"), make("m2", "metadata", "r2"), make("r3", "revisit"), make("q9", "request", "gone")]
    got = {r["record_id"]: (r["request"] and r["request"]["record_id"], r["metadata"] and r["metadata"]["record_id"]) for r in warc.transactions(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"r1": ("q1", "m1"), "r2": (None, "m2"), "r3": (None, None)}


def test_members_of_any_size(monkeypatch):
    blocks = [b"", b"x" * 10, bytes(range(256)) * 300, b"end"]
    raw = b"".join(warc.record([("WARC-Type", "x")], b) for b in blocks)
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(warc, "READ", size)
        assert [warc.parse(m)[1] for m in warc.members(io.BytesIO(raw))] == blocks
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members(io.BytesIO(raw[:-5])))
    with pytest.raises(ValueError, match="not a WARC"):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")


def test_large_and_many_files(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "é" * (200_000 if i == 3 else i)) for i in range(40)], COLUMNS)
    assert warc.round_trip(pages).filter("record_type = 'response'").count() == 40


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], COLUMNS)).count() == 0


def test_query_agrees_with_sql(spark, sf, oracle):
    from beaconlake.llm import queries

    got = queries.QUERIES["op2_warc"](spark, sf).toPandas()
    assert rows_of(got) == rows_of(oracle.sql(queries.ORACLE_SQL["op2_warc"]).df())
