"""No name of an input column may crash an operator or change its result."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import beaconlake.llm
from beaconlake.llm import bpe, exact_dedup, mixing, pii, quality_rules, simhash, suffix_dedup, warc

SOURCES = Path(beaconlake.llm.__file__).parent
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def names_within() -> list[str]:
    """Every name that the modules give to a column, and the hidden one of file scans."""
    found = {"_metadata", "__loc", "__kept", "a.b", "LOC", "Doc"}
    for path in SOURCES.glob("*.py"):
        text = path.read_text()
        found |= set(re.findall(r'alias\("(\w+)"\)', text)) | set(re.findall(r'withColumn(?:Renamed)?\("(\w+)"', text))
        found |= {n for s in re.findall(r'toDF\(([^)]*)\)', text) for n in re.findall(r'"(\w+)"', s)}
    return sorted(n for n in found if n.lower() not in ("doc_id", "text", "source", "lang"))


def rows():
    out = [(i, " ".join(f"{WORDS[(i // 2 + k * k) % 12]}{k}x{i // 2}" for k in range(20)), "en", f"s{i % 3}") for i in range(60)]
    return out + [(60, None, None, None), (None, "a b c", "en", "s1"), (61, "short", "en", "s2"), (60, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("clash") / "plain")
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(at)
    return spark.read.parquet(at)


def clashing(docs, path, names):
    folded, keep = set(), []
    for n in names:
        if n.lower() not in folded:
            folded.add(n.lower())
            keep.append(n)
    docs.select("*", *(F.lit("extra").alias(n) for n in keep)).coalesce(1).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


FILTERS = {
    "quality": quality_rules.keep_good, "exact": exact_dedup.drop_copies, "near": simhash.one_of_each, "alike": simhash.one_alike, "mixed": mixing.mixed,
}


@pytest.mark.parametrize(("name", "made"), [*((n, False) for n in FILTERS), ("exact", True)])
def test_stages_keep_the_same_rows_and_all_columns(spark, docs, tmp_path, name, made):
    extra = clashing(docs, str(tmp_path / "d"), names_within())
    if made:  # a frame that is no scan of files
        extra, plain = extra.unionByName(extra.limit(0)), docs.unionByName(docs.limit(0))
    else:
        plain = docs
    out = FILTERS[name](extra)
    assert out.columns == extra.columns
    shown = lambda df: sorted(tuple(map(str, r)) for r in df.select("doc_id", "text", "source").collect())
    want = shown(FILTERS[name](plain))
    assert shown(out) == want and want
    assert all(set(r[4:]) == {"extra"} for r in out.limit(5).collect())


def tables():
    public = pytest.importorskip("public_tokenizers")
    from beaconlake.llm import huffman_ids

    return {
        "quality": quality_rules.quality, "exact": exact_dedup.exact_groups, "near": simhash.near_groups, "planned": mixing.planned,
        "pii": lambda d: pii.pseudonymised(d, b"key"), "suffix": suffix_dedup.dedup,
        "bpe": lambda d: bpe.encoded(d, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN),
        "huffman": lambda d: huffman_ids.round_trip(d, public.path("word_bpe_49k.json")),
    }


@pytest.mark.parametrize("name", ["quality", "exact", "near", "planned", "pii", "suffix", "bpe", "huffman"])
def test_tables_are_the_same(docs, tmp_path, name):
    extra = clashing(docs, str(tmp_path / "d"), names_within())
    run = tables()[name]
    shown = lambda df: (df.columns, sorted(tuple(map(str, r)) for r in df.collect()))
    assert shown(run(extra)) == shown(run(docs))


def test_pages(spark, tmp_path):
    plain = spark.createDataFrame([(1, "u1", "x"), (2, "u2", "x"), (3, None, None), (None, "u", "y")], "page_id long, url string, html string")
    names = [n for n in names_within() if n not in ("page_id", "url", "html")]
    extra = clashing(plain, str(tmp_path / "p"), names)
    shown = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert shown(warc.round_trip(extra)) == shown(warc.round_trip(plain))


def test_toxicity(docs, tmp_path):
    from beaconlake.llm import toxicity

    extra = clashing(docs, str(tmp_path / "d"), names_within())
    labels = docs.sparkSession.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    shown = lambda df: sorted((str(r["doc_id"]), round(r["score"], 5)) for r in df.collect())
    assert shown(toxicity.scored(extra, labels.withColumn("text", F.lit("x")))) == shown(toxicity.scored(docs, labels))
