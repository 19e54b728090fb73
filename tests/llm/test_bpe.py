import hashlib
import random

import numpy as np
import pytest

from beaconlake.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")

SIGNS = "ab  '\n\t sSdltrevm019²½éß中文  　\x1c\x1d\x1f\x85​᠎-_|!\U0001F600é"


@pytest.fixture(scope="module")
def path():
    return tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library(path):
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


@pytest.fixture(scope="module")
def coder(path):
    return bpe.Codec(path, tokenizers.PATTERN)


def odd_texts():
    rng = random.Random(5)
    out = ["", " ", "  a", "a  ", "it's don't 'S", "x" * 3000, "".join(rng.choice("0123456789abcdef") for _ in range(2000)), "a \n b", "\n", "a\n", " a", "ab " * 4000, "<|endoftext|>", "\x00\x00"]
    return out + ["".join(rng.choice(SIGNS) for _ in range(rng.randint(1, 60))) for _ in range(4000)]


def test_ids_against_the_library(coder, library):
    texts = odd_texts()
    ids, counts = coder.encode(texts)
    ends = np.cumsum(counts)
    for t, a, z in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:z].tolist() == library.encode_ordinary(t), repr(t)


def test_decoding(coder, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 500)
    texts = odd_texts()[:600]
    ids, counts = coder.encode(texts)
    assert coder.decoded_sha256(ids, counts) == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_words_without_a_switch(coder, library):
    """Words of any length and script come through the recursive query."""
    rng = random.Random(6)
    texts = ["".join(rng.choice(abc) for _ in range(n)) for abc in ("ACGT", "=", "-=", "abcdefghijklmnopqrstuvwxyz", "aab") for n in (255, 256, 257, 3000)]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)) for n in (80, 300, 3400)]
    texts += ["".join(rng.choice("กขคงจฉชซญดตถทนบปผพฟมยรลวสหอฮะาิีุูเแโใไ") for _ in range(1200)), "theandingoer" * 850, "x" * 10_000]
    ids, counts = coder.encode(texts)
    ends = np.cumsum(counts)
    for t, a, z in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:z].tolist() == library.encode_ordinary(t), t[:40]


def contracted_by_hand(codec, word):
    """The leftmost pair of least rank, again and again."""
    parts = [bytes([b]) for b in word]
    while True:
        ranks = [codec.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        if not ranks or min(ranks) == 1 << 60:
            return [codec.ranks[x] for x in parts]
        i = ranks.index(min(ranks))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_any_vocabulary(tmp_path):
    """Ranks in no order that training would give: lesser pairs come up late."""
    import base64

    rng = random.Random(7)
    for trial in range(25):
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(3, 40))}
        every = [bytes([i]) for i in range(256)] + sorted(tokens, key=lambda t: rng.random())
        path = tmp_path / f"{trial}.tiktoken"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(every)))
        own = bpe.Codec(str(path), tokenizers.PATTERN)
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 60))) for _ in range(60)] + [b"a" * 41, b"ab" * 30]
        want = [contracted_by_hand(own, w) for w in words]
        for query in (bpe.CONTRACT, bpe.CONTRACT_MORE):
            ids, counts = own._contract(words, query)
            ends = np.cumsum(counts)
            assert [ids[a:z].tolist() for a, z in zip(ends - counts, ends, strict=True)] == want
        assert [[i for x in xs for i in contracted_by_hand(own, x)] for xs in own._cuts(words)] == want


def test_nothing_is_spilled(coder):
    assert coder.db.execute("SELECT current_setting('temp_directory')").fetchall() == [("",)]


def test_code_points_of_newer_tables(coder, library):
    import unicodedata

    newer = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and coder.letter.match(chr(c))]
    texts = [f"a{c}a1{c}1 {c}!{c}" for c in newer[:: max(1, len(newer) // 3000)]] + ["plain"]
    ids, counts = coder.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[a:z].tolist() for a, z in zip(ends - counts, ends, strict=True)] == library.encode_ordinary_batch(texts)


def test_forgetting_changes_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_UNITS", 10)
    monkeypatch.setattr(bpe, "MOST_WORDS", 30)
    for i in range(20):
        text = f"some words number {i} and more{i * i} of them"
        ids, counts = coder.encode([text, text])
        assert ids.tolist() == library.encode_ordinary(text) * 2


def test_rows(spark, path, library):
    rows = [(1, "a b\n c"), (None, "it's"), (2, None), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in bpe.encoded(df, path, tokenizers.PATTERN, with_ids=True).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)))
    assert got == sorted(want, key=str)
    assert bpe.encoded(df.limit(0), path, tokenizers.PATTERN).count() == 0


def test_query(spark, sf, library):
    from beaconlake.llm import queries

    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.QUERIES["op3_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
