import hashlib
import random

import numpy as np
import pytest

from beaconlake.llm import suffix_dedup as x

NONE = np.empty(0, np.uint64)


def by_hand(rows):
    """(doc_id, bytes, removed, spans, sha) for (doc_id, text), None last."""
    order = lambda i: x.NO_ID if i is None else i
    first = {}
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        for p in range(len(t) - x.SPAN + 1):
            first.setdefault(t[p : p + x.SPAN], order(i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - x.SPAN + 1):
            if first[t[p : p + x.SPAN]] < order(i):
                gone[p : p + x.SPAN] = b"\1" * x.SPAN
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(rng):
    words = [bytes(rng.choice(b"abcdef \n") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([3, 8, 200]))]
    make = lambda n: b" ".join(rng.choice(words) for _ in range(n))
    passages = [make(rng.randint(5, 60)) for _ in range(6)]
    out = []
    for _ in range(rng.randint(1, 30)):
        t = b"".join(rng.choice(passages) if rng.random() < 0.6 else make(rng.randint(0, 40)) for _ in range(rng.randint(0, 5)))
        if rng.random() < 0.3 and out:
            copy = bytearray(rng.choice(out))
            for _ in range(rng.randint(0, 3) if copy else 0):
                copy[rng.randrange(len(copy))] = rng.randrange(256)
            t = bytes(copy)
        out.append(t)
    return out + rng.choice([[], [b"a" * 300, b"a" * 170, b"\0" * 120, b"\0" * 60]])


@pytest.mark.parametrize("trial", range(40))
def test_runs_against_brute_force(trial):
    rng = random.Random(trial)
    own = texts(rng)
    ids = [rng.randrange(20) for _ in own] if trial % 3 == 0 else rng.sample(range(1000), len(own))
    if trial % 7 == 0:
        ids[0] = x.NO_ID
    frequent = NONE
    if trial % 2:
        size = np.array([len(t) for t in own])
        gram = x.anchors(np.frombuffer(b"".join(own), np.uint8), np.cumsum(size) - size, np.cumsum(size))[3]
        frequent = np.unique(gram)[::3]
    chunks, runs = rng.choice([1, 2, 5]), {}
    every = b"".join(own)
    bounds = {every[i : i + rng.choice([3, x.GRAM, x.SPAN])] for i in rng.sample(range(len(every)), min(len(every), rng.choice([0, 2, 9])))}
    splitters = np.unique(np.array(sorted(bounds), f"S{x.SPAN}"))
    for c in range(chunks):
        which = range(c, len(own), chunks)
        for p, r in x.chunk_runs([own[j] for j in which], np.array([ids[j] for j in which], np.int64), frequent, splitters):
            runs.setdefault(p, []).append(r)
    found = [x.merge_runs(r) for r in runs.values()] or [(np.empty(0, np.int64),) * 4]
    doc, text_hash, first, last = (np.concatenate(f) for f in zip(*found, strict=True))
    got = []
    for i, t in zip(ids, own, strict=True):
        mine = (doc == i) & (text_hash == np.uint64(x.text_hash(t)))
        removed, spans, kept = x._cut(t, first[mine], last[mine])
        got.append((i, len(t), removed, spans, hashlib.sha256(kept).hexdigest()))
    assert got == by_hand(list(zip(ids, own, strict=True)))


def test_merge_against_sorting():
    rng = random.Random(9)
    for n_runs in (1, 2, 3, 7, 20):
        runs = [sorted(bytes(rng.choice(b"ab\0\xff") for _ in range(x.SPAN)) if rng.random() < 0.5 else rng.choice([b"a" * 50, b"a" * 49 + b"b"]) for _ in range(rng.randint(0, 30))) for _ in range(n_runs)]
        common = lambda a, b: next((i for i in range(x.SPAN) if a[i] != b[i]), x.SPAN)
        prefixes = [[0, *(common(a, b) for a, b in zip(r, r[1:]))][: len(r)] for r in runs]
        order, shared = x.merge(runs, prefixes)
        at = [0] * n_runs
        out = []
        for r in order:
            out.append(runs[r][at[r]])
            at[r] += 1
        assert out == sorted(s for r in runs for s in r)
        assert shared[1:] == [common(a, b) for a, b in zip(out, out[1:])]


def test_merge_never_looks_at_known_prefixes():
    """Strings that know where they part from the last one are ordered without their bytes."""

    class Shy(bytes):
        def __getitem__(self, at):
            assert not isinstance(at, slice) or at.start >= 40, "bytes before the known prefix were read"
            return bytes.__getitem__(self, at)

    base = b"k" * 40
    runs = [[Shy(base + bytes([i]) * 10) for i in range(k, 60, 3)] for k in range(3)]
    strings = [[bytes(r[0]), *r[1:]] for r in runs]
    order, _ = x.merge(strings, [[0, *([40] * (len(r) - 1))] for r in runs])
    assert order == [i % 3 for i in range(60)]


def test_ranges_hold_the_order_of_suffixes():
    """All entries of a range come before those of the next, by their grams."""
    rng = random.Random(8)
    own = [t for k in range(12) for t in texts(rng)]
    ids = np.arange(len(own))
    splitters = np.unique(np.array(sorted(rng.choice(own)[:20] + b"x" for _ in range(6)), f"S{x.SPAN}"))
    span = {}
    for c in range(3):
        for p, run in x.chunk_runs(own[c::3], ids[c::3], NONE, splitters):
            prefixes, rest = x.unpack(run)[2:4]
            grams = [r[: x.GRAM].tobytes() for r in x.front_decode(prefixes, rest)]
            if grams:
                low, high = span.get(p, (grams[0], grams[0]))
                span[p] = min(low, *grams), max(high, *grams)
    order = [span[p] for p in sorted(span)]
    assert len(order) > 2 and all(a[1] < b[0] for a, b in zip(order, order[1:]))


def test_buckets_are_the_same_in_spark(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 3}") for i in range(-50, 50)] + [(None, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.expr(f"coalesce(doc_id, {x.NO_ID}L) ^ xxhash64(cast(text as binary))"))
    got = [r["b"] for r in df.select(F.expr(x.BUCKET.format(x="x", n=7)).alias("b")).collect()]
    ids = np.array([x.NO_ID if i is None else i for i, _ in rows])
    assert got == x.bucket_of(ids, np.array([x.text_hash(t.encode()) for _, t in rows], np.uint64), 7).tolist() and len(set(got)) > 3


def test_front_coding():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (500, x.SPAN), dtype=np.uint8)
    rows = rows[x.sort_rows(rows)]
    assert [r.tobytes() for r in rows] == sorted(r.tobytes() for r in rows)
    prefixes = x.common_prefixes(rows)
    assert (x.front_decode(prefixes, rows[np.arange(x.SPAN) >= prefixes[:, None]]) == rows).all()


def test_rows(spark, monkeypatch):
    line = "The quick brown fox jumps over the lazy dog, and then some more of it. "
    rows = [(5, line * 2), (3, "x" + line), (None, line), (None, "y" + line), (9, None), (9, ""), (7, line), (7, line + "tail of seven"), (8, "ü" * 40), (2, "ü" * 30 + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS bucket", "0 AS kept")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in x.dedup(df).collect()]
    assert sorted(got, key=str) == sorted(by_hand([(i, (t or "").encode()) for i, t in rows]), key=str)
    assert x.dedup(df.limit(0)).count() == 0


def test_ranges_without_repeats(spark):
    df = spark.createDataFrame([(i, f"{i} " * 40) for i in range(3)], "doc_id long, text string")
    assert [r["n_removed"] for r in x.dedup(df, share=50).collect()] == [0, 0, 0]
    assert x._reduce_runs(x.pa.table({"run": [r for _, r in x.chunk_runs([b"z" * 60], np.array([1]), NONE, np.empty(0, "S50"))]}), 3).num_rows == 0


def test_frequent_grams_go_as_windows(spark, monkeypatch):
    monkeypatch.setattr(x, "SAMPLE", 1)
    rng = random.Random(4)
    licence = "Permission is hereby granted to any person who reads this line of text, and to all others. "
    rows = [(i, " ".join(str(rng.random()) for _ in range(rng.randint(0, 9))) + licence + str(rng.random())) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    splitters, frequent = x.plan_ranges(df.selectExpr("doc_id", "cast(text AS binary) AS text"), share=1000)
    assert len(splitters) >= 4 and len(frequent) and (splitters[1:] > splitters[:-1]).all()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in x.dedup(df, chunk=2000, share=1000).collect()]
    assert sorted(got) == sorted(by_hand([(i, t.encode()) for i, t in rows]))


def test_runs_are_gone_before_texts_are_sent(spark):
    """What the runs' exchange wrote must not lie beside that of the texts."""
    import glob
    import time

    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*")}
    rows = [(i, f"{i % 7} is the number of this text, and it has some more words than fifty bytes hold.") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    was = spark.conf.get(key)
    out = x.dedup(df)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(key) == was
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()]
    assert sorted(got) == sorted(by_hand([(i, t.encode()) for i, t in rows]))


def test_query(spark, sf):
    from beaconlake.llm import queries

    rows = [(i, t.encode()) for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.QUERIES["op5_suffix_dedup"](spark, sf).collect()]
    assert sorted(got) == sorted(by_hand(rows))
