import pytest
from pyspark.sql import functions as F

from beaconlake.llm import common


def places(df):
    return [(r["loc"]["file"], r["loc"]["row"]) for r in common.located(df).collect()]


def test_rows_have_places_of_their_own(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert len(set(places(df))) == 100 and sorted(places(df)) == sorted(places(df))
    assert len(set(places(df.filter("id > 50").select("id")))) == 49


@pytest.mark.parametrize("shape", ["made", "exploded", "joined", "grouped"])
def test_other_frames_are_written_first(spark, tmp_path, shape):
    spark.range(20).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    df = {
        "made": lambda: spark.range(20), "exploded": lambda: df.select(F.explode(F.array("id", "id")).alias("id")),
        "joined": lambda: df.crossJoin(spark.range(2).toDF("k")), "grouped": lambda: df.groupBy("id").count(),
    }[shape]()
    got = places(df)
    assert len(set(got)) == len(got) == df.count()


def test_rows_come_back_whole(spark, tmp_path):
    spark.range(5).selectExpr("id AS `a.b`", "id AS loc", "id AS doc").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = common.located(df)
    assert got.columns == ["doc", "loc"] and got.select("doc.*").columns == df.columns
    assert sorted(map(tuple, got.select("doc.*").collect())) == [(i, i, i) for i in range(5)]
    plan = got.select(common.of("loc")).filter(common.of("a.b") > 3)._jdf.queryExecution().executedPlan().toString()
    assert "doc#" not in plan.split("ReadSchema")[1], "what is not asked for is not read"


def test_tables_are_discarded_once(spark):
    table = common.materialize(spark.range(3), "x")
    common.discard(table, None, spark.range(1))
    import os

    assert not os.path.exists(table.scratch_path.removeprefix("file:"))


def test_shared_files(spark, tmp_path):
    folder = f"file://{tmp_path}/a/b"
    common.make_dir(spark, folder)
    with common.open_shared(folder + "/x", "wb") as f:
        f.write(b"123")
    with common.open_shared(f"{tmp_path}/a/b/x", "rb") as f:
        assert f.read() == b"123"
    common.remove(spark, folder)
    assert not (tmp_path / "a" / "b").exists()


def test_shared_folder_is_the_sessions(spark):
    assert common.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert common.materialize(spark.range(3), "x").inputFiles()[0].removeprefix("file:").lstrip("/").startswith(spark.conf.get("spark.checkpoint.dir").lstrip("/"))


def test_words(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tb\x0bc ",), ("é\u00a0x",)], "t string")
    rows = df.select(common.words_of(F.col("t")).alias("w"), common.n_words_of(F.col("t")).alias("n")).collect()
    assert [r["w"] for r in rows] == [[], [], ["a", "b", "c"], ["é\u00a0x"]] and [r["n"] for r in rows] == [0, 0, 3, 1]


def test_let_computes_once(spark):
    out = spark.range(1).select(common.let(F.array(F.rand(), F.lit(0.0)), lambda a: F.array(F.get(a, 0), F.get(a, 0)))).first()[0]
    assert out[0] == out[1]
