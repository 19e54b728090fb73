import random

import pytest
from conftest import rows_of

from beaconlake.llm import quality_rules as q

COLUMNS = "doc_id long, text string, source string"


def by_hand(text):
    """(words, word_chars, symbols, dup_lines, repeat_words)"""
    text = text or ""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a", "a b c d e", "a b c d e a b c d e", "x " * 30, "é ü\n\né ü\n é ü", "# $%\n# $%\x0b<|>"]
    for _ in range(60):
        texts.append("".join(rng.choice(["a ", "b ", "c ", "\n", "#", " \n", "é", "\x0c"]) for _ in range(rng.randint(0, 80))))
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], COLUMNS)
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in q.quality(df).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}


def good(i):
    return " ".join(f"word{i}x{k}" for k in range(20))


def test_hosts_are_rejected_with_their_documents(spark):
    rows = [(i, good(i), "fine") for i in range(1000, 1300)] + [(0, good(0), "fine")] + [(100 + i, "short", "spam") for i in range(60)] + [(200, good(1), "spam")]
    rows += [(300, "short", "fine"), (301, good(2), None), (302, "short", "single")]
    got = {r["doc_id"]: r for r in q.quality(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got[0]["kept"] and not got[300]["kept"] and got[300]["base_failed"]
    assert got[200]["host_rejected"] and not got[200]["base_failed"] and not got[200]["kept"]
    assert got[301]["kept"]
    assert not got[302]["host_rejected"], "one document says little of a host"


def scored(spark, rows):
    return q.counted(spark.createDataFrame(rows, COLUMNS).selectExpr("struct(*) AS doc")).selectExpr("doc.source AS host", "quality")


def test_rates_shrink_towards_the_mean(spark):
    rows = [(i, good(i), "big") for i in range(300)] + [(1000, "short", "small")] + [(2000 + i, good(i) if i % 2 else "x", "half") for i in range(40)]
    rates = {r["host"]: r for r in q.host_rates(scored(spark, rows)).collect()}
    assert 0 <= rates["big"]["rate_short"] < 0.05 < rates["half"]["rate_short"] < 0.55 and rates["small"]["rate_short"] < 1.0
    assert all(r["low_short"] < r["rate_short"] for r in rates.values())
    assert rates["half"]["others_short"] == pytest.approx(1 / 301) and rates["big"]["others_short"] == pytest.approx(21 / 41)


def test_suspect_hosts_lose_what_fails_a_rule_there(spark):
    """Symbols alone are no reason to go but where a host has many such documents."""
    noisy = lambda i: good(i) + " " + " ".join("#" + "$" * k for k in range(1, 12))
    rows = [(i, good(i), f"h{i % 8}") for i in range(800)] + [(1000 + i, noisy(i), f"h{i % 8}") for i in range(16)]
    rows += [(2000 + i, good(i), "loud") for i in range(100)] + [(3000 + i, noisy(i), "loud") for i in range(20)]
    rows += [(4000, noisy(1), "tiny")]
    got = {r["doc_id"]: r for r in q.quality(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert not any(r["host_rejected"] or r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == set(range(3000, 3020))


def test_planted_hosts_through_the_registered_query(spark, sf, tmp_path):
    """The driver's own documents, of which those of two hosts are made worse; small clean hosts stay."""
    from beaconlake.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").toPandas()
    rows = [(1_000_000 + i, "too short", "bad host") for i in range(40)] + [(2_000_000 + i, good(i), "bad host") for i in range(20)]
    rows += [(3_000_000 + i, good(i), f"small{i}") for i in range(3)] + [(4_000_000, "short", "single")]
    frame = spark.createDataFrame(docs[["doc_id", "text", "source"]]).union(spark.createDataFrame(rows, COLUMNS))
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_quality_rules"](spark, str(tmp_path)).collect()}
    assert all(got[2_000_000 + i]["host_rejected"] and not got[2_000_000 + i]["base_failed"] and not got[2_000_000 + i]["kept"] for i in range(20))
    assert all(got[3_000_000 + i]["kept"] for i in range(3)) and not got[4_000_000]["host_rejected"]
    rest = [got[i] for i in docs.doc_id]
    assert not any(r["host_rejected"] for r in rest)


def test_filter_keeps_rows_and_columns(spark):
    rows = [(1, good(1), "a", "x"), (1, good(1), "a", "x"), (None, good(2), None, None), (3, None, "a", "y")]
    df = spark.createDataFrame(rows, COLUMNS + ", kept string")
    out = q.keep_good(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in out.collect() if r["kept"]) == [(1, "x"), (1, "x")] and out.count() == 3
    assert q.quality(df).filter("kept").count() == 3


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert q.quality(empty).count() == 0 and q.keep_good(empty).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(1, good(1), "a")], COLUMNS)
    text = q.counted(df.selectExpr("struct(*) AS doc"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_query_agrees_with_sql(spark, sf, oracle):
    from beaconlake.llm import queries

    got = queries.QUERIES["op9_quality_rules"](spark, sf).toPandas()
    assert rows_of(got) == rows_of(oracle.sql(queries.ORACLE_SQL["op9_quality_rules"]).df())


@pytest.mark.parametrize("most", [0, 10_000])
def test_many_hosts_go_through_a_join(spark, most, monkeypatch):
    monkeypatch.setattr(q, "BROADCAST_HOSTS", most)
    rows = [(i, "short" if i % 3 else good(i), f"h{i % 5}") for i in range(200)]
    assert q.quality(spark.createDataFrame(rows, COLUMNS)).filter("host_rejected").count() == 200
