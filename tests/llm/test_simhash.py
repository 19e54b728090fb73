import random
import re

import pytest
import xxhash

from beaconlake.llm import graph, simhash

COLUMNS = "doc_id long, text string"


def print_by_hand(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(values):
    """Of each place, the places that it reaches over differences of two bits or fewer."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    rng = random.Random(3)
    texts = ["", " \n", "a", "A b", "a b c", "a b c d", "É é X", "a b c " * 50, "\x0b\x0c", "x\x00y"]
    texts += [" ".join(rng.choice(["al", "Be", "ga", "dé"]) for _ in range(rng.randint(1, 40))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t.encode()) & (1 << 64) - 1 == print_by_hand(t), t


def test_a_text_of_more_than_one_block(monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    text = " ".join(str(i * i % 91) for i in range(200))
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == print_by_hand(text)


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_links_against_brute_force(spark, crowd):
    rng = random.Random(4)
    values = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), crowd).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
    roots = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_by_hand(values)
    got = {}
    for s, w in zip(signed, want, strict=True):
        assert got.setdefault(roots.get(s, s), w) == w
    assert len(got) == len(set(want))


@pytest.mark.parametrize("shape", ["path", "star", "ring", "pairs"])
def test_components(spark, shape):
    n = 40
    edges = {
        "path": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)], "ring": [(i, (i + 1) % n) for i in range(n)],
        "pairs": [(2 * i, 2 * i + 1) for i in range(n)] + [(3, 3), (1, 0)],
    }[shape]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == ({i: i - i % 2 for i in range(2 * n)} if shape == "pairs" else dict.fromkeys(range(n + (shape != "ring")), 0))


def test_groups(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(9, long), (4, long + " more"), (7, None), (2, " \n"), (None, long), (None, "alone here now"), (4, long + " more"), (1, "quite another text of some words")]
    near = simhash.near_groups(spark.createDataFrame(rows, COLUMNS)).collect()
    texts = {str(i): t for i, t in rows}
    assert all(int(r["fingerprint"], 16) == print_by_hand(texts[str(r["doc_id"])]) for r in near if r["doc_id"] is not None)
    assert sorted(str(r["component_id"]) for r in near) == sorted(["4"] * 4 + ["2"] * 2 + ["1", "None"]) if (print_by_hand(long) ^ print_by_hand(long + " more")).bit_count() <= 2 else True


def test_one_of_each(spark):
    rows = [(9, "a b c", "x"), (4, "a b c", "y"), (4, "a b c", "y"), (None, "a b c", "z"), (None, "d e f", None)]
    df = spark.createDataFrame(rows, COLUMNS + ", fp string")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["fp"])) for r in out.collect()) == [("4", "y"), ("None", "None")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert simhash.near_groups(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_query_against_brute_force(spark, sf):
    from beaconlake.llm import queries

    got = sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in queries.QUERIES["op4_simhash"](spark, sf).collect())
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert [f for _, f, _ in got] == [print_by_hand(texts[i]) for i, _, _ in got]
    assert [c for _, _, c in got] == [got[w][0] for w in components_by_hand([f for _, f, _ in got])]


def test_no_table_of_the_corpus_is_broadcast(spark, monkeypatch):
    """However small the compressed files look: beyond MOST_SENT rows no join broadcasts."""
    from beaconlake.llm import common

    plans = []
    write = simhash.materialize

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    for module in (common, simhash, graph):
        monkeypatch.setattr(module, "MOST_SENT", 0, raising=False)
    for module in (simhash, graph):
        monkeypatch.setattr(module, "materialize", seen)
    rng = random.Random(10)
    long = [" ".join(rng.choice(["al", "be", "ga", "de"]) + str(rng.randrange(9)) for _ in range(400)) for _ in range(8)]
    rows = [(i, long[i % 8] + " more" * (i // 8)) for i in range(24)]
    near = simhash.near_groups(spark.createDataFrame(rows, COLUMNS))
    plans.append(("groups", near._jdf.queryExecution().executedPlan().toString()))
    got = {r["doc_id"]: r["component_id"] for r in near.collect()}
    prints = [print_by_hand(t) for _, t in rows]
    want = components_by_hand(prints)
    assert got == dict(enumerate(want)) and len(set(want)) < len(set(prints))
    assert len(plans) > 8 and [name for name, plan in plans if "Broadcast" in plan] == []
    assert [name for name, plan in plans if "Join" in plan]
