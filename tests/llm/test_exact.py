import hashlib
import random
import re

import pytest
from conftest import rows_of

from beaconlake.llm import exact_dedup as x

COLUMNS = "doc_id long, text string"


def by_hand(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        named = [k for k in g if k is not None]
        out.append((i, min(named) if named else None, len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("bits", [256, 4])
def test_groups_against_brute_force(spark, bits):
    """With digests of four bits, nearly all hits are of different bytes and go by the texts themselves."""
    rng = random.Random(2)
    texts = [None, "", " ", "  ", "a b", "a\t\nb", "a  b ", "A b", "é\x0bü"] + ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 5))) for _ in range(80)]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts, strict=True)) + [(None, "a b"), (None, "alone")]
    got = x.exact_groups(spark.createDataFrame(rows, COLUMNS), bits=bits)
    assert shown(got) == by_hand(rows)
    kept = [r["doc_id"] for r in got.filter("kept").collect()]
    assert sorted(kept, key=str) == sorted({k for _, k, _, _ in by_hand(rows)}, key=str)


def test_one_row_of_each_text_stays(spark):
    rows = [(5, "a b", "p"), (5, "a  b", "q"), (3, "c", "r"), (None, "c", "s"), (None, None, None), (None, "", None)]
    df = spark.createDataFrame(rows, COLUMNS + ", keeper string")
    out = x.drop_copies(df)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["3", "5", "None"]


def test_state_goes_on(spark, tmp_path):
    """A second call with more files adds to the groups of the first."""
    from pyspark.sql import functions as F

    digests, state = str(tmp_path / "digests"), str(tmp_path / "state")

    def put(rows):
        df = spark.createDataFrame(rows, "key string, doc_id long")
        loc = F.struct(F.lit(1).cast("long").alias("file"), F.col("doc_id").alias("row"))
        df = df.select("key", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", loc.alias("at")).alias("row"))
        df.write.mode("append").parquet(digests)
        return df.schema

    groups = lambda schema: {r["key"]: (r["keeper"]["doc_id"], r["group_size"]) for r in x.stream_groups(spark, digests, schema, state).collect()}
    assert groups(put([("k", 9), ("k", 7), ("l", 1)])) == {"k": (7, 2), "l": (1, 1)}
    assert groups(put([("k", 4), ("m", 2)])) == {"k": (4, 3), "l": (1, 1), "m": (2, 1)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert x.exact_groups(empty).count() == 0 and x.drop_copies(empty).count() == 0


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    x.exact_groups(spark.createDataFrame([(1, "a")], COLUMNS)).collect()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_query_agrees_with_sql(spark, sf, oracle):
    from beaconlake.llm import queries

    got = queries.QUERIES["op10_exact_dedup"](spark, sf).toPandas()
    assert rows_of(got) == rows_of(oracle.sql(queries.ORACLE_SQL["op10_exact_dedup"]).df())
