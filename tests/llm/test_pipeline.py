import re

import numpy as np
import pytest

import corpus_pipeline


def test_stages():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "token ids"]


def test_run_against_plain_steps(spark, sf):
    """The rows of run(), from plain Python over the whole table, but for which documents the mix repeats."""
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    from test_quality import by_hand as counts
    from test_alike import wide_by_hand

    from beaconlake.llm.bpe import load_ranks

    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    rows = [(i, t, s) for i, t, s in zip(docs.doc_id, docs.text, docs.source, strict=True) if (c := counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    seen, exact = set(), []
    for i, t, s in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if norm not in seen:
            seen.add(norm)
            exact.append((i, t, s))
    prints = [sum(v << 64 * k for k, v in enumerate(wide_by_hand(t))) for _, t, _ in exact]
    near = {exact[k][0]: exact[k][1] for k, p in enumerate(prints) if not any((p ^ q).bit_count() <= 77 for q in prints[:k])}

    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=load_ranks(public.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} <= set(near)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(map(size, near.values()))
    assert sum(size(near[r["doc_id"]]) for r in got) == pytest.approx(1.5 * total, rel=0.05)
    for r in got:
        assert r["n_tokens"] == len(library.encode_ordinary(near[r["doc_id"]]))
    assert np.bincount([r["doc_id"] for r in got]).max() <= 2


def test_stages_keep_columns(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en", f"s{i % 3}", 5, "extra") for i in range(30)] + [(None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __kept string")
    df.write.parquet(str(tmp_path / "d"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(str(tmp_path / "d")), "").columns == df.columns


def test_entry_without_the_corpus_operators():
    """The entry module takes it that both may be gone, and nothing else."""
    import subprocess
    import sys
    import textwrap

    code = textwrap.dedent("""
        import sys

        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("beaconlake.llm"):
                    raise ModuleNotFoundError(f"No module named {name!r}", name=name)

        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e

        names = e.queries()
        assert len(names) > 40 and not any(n.startswith("op") for n in names) and "pipeline" not in names
        assert set(e.oracle_sql()) <= set(names)
    """)
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_workers_are_slim_after_token_ids(spark):
    """Python workers are used again by later stages: they remember no words, so that their memory doesn't add to that of others."""
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    from beaconlake.llm import bpe

    rows = [(i, " ".join(f"w{i}x{k * k}" for k in range(200))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = public.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.encoded(docs, path, public.PATTERN).count() == 400

    def remembered(batches):
        from beaconlake.llm import bpe

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"codecs": [len(bpe._codecs)], "n": [sum(len(c.words) + len(c.pieces) + len(c.units) for c in bpe._codecs.values())]})

    seen = spark.range(0, 8, 1, 8).mapInArrow(remembered, "codecs long, n long").collect()
    assert any(r["codecs"] for r in seen) and all(r["n"] == 0 for r in seen)
