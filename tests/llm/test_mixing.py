import pytest

from beaconlake.llm import mixing

COLUMNS = "doc_id long, text string, source string"


def water(sizes, weights=mixing.WEIGHTS, budget=mixing.BUDGET, most=mixing.MAX_EPOCHS):
    """Targets by source, by clamping one source at a time."""
    order = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = budget * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[k] for k in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        s = min(over, key=lambda k: most * sizes[k] / weight[k])
        out[s] = most * sizes[s]
        left -= out[s]
        free.remove(s)
    return out


def docs(spark, sizes, each=10):
    rows, n = [], 0
    for s, total in sizes.items():
        for i in range(0, total, each):
            rows.append((n, "w " * min(each, total - i), s))
            n += 1
    return spark.createDataFrame(rows, COLUMNS)


CASES = [
    {"a": 1000, "b": 1000, "c": 1000}, {"a": 10, "b": 5000, "c": 10, "d": 3000}, {"a": 50, "é": 70, "Z": 4000, None: 900}, {"only": 500},
    {f"s{i}": 10 * i + 10 for i in range(25)},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets_and_samples(spark, sizes):
    df = docs(spark, sizes)
    rows = mixing.planned(df).collect()
    source = dict(df.select("doc_id", "source").collect())
    want = water(sizes)
    for s, size in sizes.items():
        own = [r for r in rows if source[r["doc_id"]] == s]
        assert all(r["source_size"] == size and r["target"] == pytest.approx(want[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 5 + 1e-6, "half a document off at most"
        assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in own)


def test_mix_is_the_plan(spark):
    df = docs(spark, {"a": 300, "b": 3000}).selectExpr("*", "'x' AS target", "doc_id AS extra", "1 AS last", "2 AS epochs", "3 AS size", "4 AS copies")
    plan = {r["doc_id"]: r["copies"] for r in mixing.planned(df).collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    counts = {}
    for r in out.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {k: v for k, v in plan.items() if v}


def test_odd_rows(spark):
    rows = [(None, "a b", None), (None, "a b", None), (1, None, "x"), (2, " \t", "x"), (3, "a\x0bb\x0cc", "y"), (3, "other text", "y")]
    got = mixing.planned(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 2, 3] and len(got) == 6
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert mixing.planned(empty).count() == 0 and mixing.mixed(empty).count() == 0


@pytest.mark.parametrize("most", [0, 10_000])
def test_many_sources_go_through_joins(spark, most, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    rows = mixing.planned(docs(spark, CASES[2])).collect()
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * sum(CASES[2].values()), abs=20)


def test_reruns_agree_and_seeds_differ(spark):
    df = docs(spark, {"a": 2000, "b": 2000, "c": 2000})
    first, again, second = (sorted(map(tuple, mixing.planned(df, seed=s).select("doc_id", "copies").collect())) for s in (1, 1, 2))
    assert first == again != second


def test_query_on_tables(spark, sf):
    from beaconlake.llm import queries

    rows = queries.QUERIES["op7_mixing"](spark, sf).toPandas()
    docs_ = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert sorted(rows.doc_id) == sorted(docs_.doc_id)
    rows = rows.merge(docs_[["doc_id", "source"]], on="doc_id")
    want = water(rows.groupby("source")["size"].sum().to_dict())
    for s, own in rows.groupby("source"):
        assert own.target.iloc[0] == pytest.approx(want[s]) and abs(own.taken.sum() - want[s]) <= max(0.06 * want[s], own["size"].max() / 2)
