import heapq
import io
import random
import zlib

import numpy as np
import pytest

from beaconlake.llm import huffman_ids as h

pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
SIGNS = "ab  '\n\t sSdltrevm019²½éßÉ中文  　\x1c\x1d\x1f\x85​᠎-_|!\U0001F600é٣Σσ̣İ.,.,"


def plain_huffman_cost(freq):
    heap = [int(f) for f in freq if f]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def test_lengths():
    rng = np.random.default_rng(1)
    for n in (2, 3, 10, 300):
        freq = rng.zipf(1.4, n).astype(np.int64)
        loose = h.code_lengths(freq, 16)
        if loose.max() < 16:
            assert int((freq * loose).sum()) == plain_huffman_cost(freq)
        tight = h.code_lengths(freq, 9)
        assert tight.max() <= 9 and sum(2.0 ** -int(x) for x in tight if x) <= 1 and int((freq * tight).sum()) >= int((freq * loose).sum())
    assert h.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0] and not h.code_lengths(np.zeros(4, np.int64)).any()
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    assert h.code_lengths(np.array(fib), 8).max() == 8
    with pytest.raises(ValueError, match="do not fit"):
        h.code_lengths(np.ones(9, np.int64), 3)


def test_codes_are_canonical():
    code = h.Code(np.array([2, 0, 1, 3, 3], np.uint8))
    assert [int(code.code[i]) for i in (2, 0, 3, 4)] == [0b0, 0b10, 0b110, 0b111]


def test_blocks_stand_alone():
    rng = np.random.default_rng(2)
    for n in (1, 5, 1023, 1024, 1025, 7000):
        ids = rng.zipf(1.3, n) % 500
        code = h.Code(h.code_lengths(np.bincount(ids, minlength=500)))
        offsets, payload = code.encode(ids)
        assert (code.decode(payload, offsets, n, h.BLOCK) == ids).all()
        last = (len(offsets) - 1) * h.BLOCK
        assert (code.decode(payload, offsets[-1:], n - last, h.BLOCK) == ids[last:]).all()


def test_damaged_files_are_refused():
    with pytest.raises(ValueError, match="not a file"):
        list(h.read_segments(io.BytesIO(b"x" * 64)))


def each(ids, counts):
    return np.split(ids, np.cumsum(counts)[:-1])


def test_words_against_the_library():
    rng = random.Random(3)
    coder = h.WordCoder(public.path("word_bpe_49k.json"))
    texts = ["", "a" * 2000, "It's. DON'T, stop...", "<|endoftext|>"] + ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in each(*coder.encode(texts))] == want
    coder.forget()
    assert [x.tolist() for x in each(*coder.encode(texts[::-1]))] == want[::-1]


def test_added_tokens_against_the_unaltered_library():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    path = public.path("word_bpe_49k.json")
    library, coder = Tokenizer.from_file(path), h.WordCoder(path)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", *SIGNS]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a" * 2000 + "<|startoftext|>"] + ["".join(rng.choice(parts[: rng.choice([6, 80])]) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    assert library.encode(texts[0], add_special_tokens=False).ids == [320, 49407, 321]
    assert [x.tolist() for x in each(*coder.encode(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_code_points_of_newer_tables():
    import unicodedata

    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library, coder = Tokenizer.from_file(path), h.WordCoder(path)
    some = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) == "Cn" or c % 64 == 7)]
    some = [c for c in some if ord(c) < 0x32000][::3] + [chr(c) for c in (0x0C5C, 0xA7CE, 0x10940, 0x10951, 0xE0FFF)]
    texts = [f"a{c}a1{c}1 {c}!{c}" for c in some]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in each(*coder.encode(texts))] == want


def test_added_tokens_in_a_table(spark):
    check(spark, [(1, "a b"), (2, "a <|endoftext|> b"), (3, "<|startoftext|>"), (4, "c d")])


def check(spark, rows, df=None):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    df = spark.createDataFrame(rows, "doc_id long, text string") if df is None else df
    got = [tuple(r) for r in h.round_trip(df, path).orderBy("start").collect()]
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    ids.sort(key=lambda x: (x[0] is None, x[0] or 0))
    want, at = [], 0
    for i, x in ids:
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert [g[:3] for g in got] == [w[:3] for w in want] if len({i for i, _ in rows}) == len(rows) else len(got) == len(want)
    assert sorted((g[2:] for g in got)) == sorted(w[2:] for w in want)
    return got


def test_round_trip(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i * 7 % 101, " ".join(rng.choice(["the", "of", "zebra", "Ünder", "x.y,"]) for _ in range(rng.randint(0, 60)))) for i in range(101)]
    check(spark, [*rows, (500, None), (None, "no id")])
    got = check(spark, [(1, "a"), (1, "a"), (None, None), (None, "b c")])
    assert [g[0] for g in got] == [1, 1, None, None]


def test_documents_over_segments(spark, monkeypatch):
    """A document of more ids than a segment holds goes on in the next."""
    file = io.BytesIO()
    ids = np.arange(3000) % 50
    code = h.Code(h.code_lengths(np.bincount(ids, minlength=50)))
    book = zlib.compress(code.lengths.tobytes())
    import struct

    file.write(struct.pack("<4sIII", b"HTOK", 1, 50, len(book)) + book)
    h._write_segment(file, code, [(1, 100, False), (2, 1900, True)], ids[:2000])
    h._write_segment(file, code, [(2, 900, False), (None, 100, False)], ids[2000:])
    file.seek(0)
    segments = list(h.read_segments(file))
    assert (np.concatenate([s[3] for s in segments]) == ids).all()
    assert [s[2].tolist() for s in segments] == [[0, 2], [0, 1]] and segments[1][0].tolist() == [2, 0]


def test_empty_table(spark):
    assert h.round_trip(spark.createDataFrame([], "doc_id long, text string"), public.path("word_bpe_49k.json")).count() == 0


def test_query(spark, sf):
    from beaconlake.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, spark.read.parquet(f"{sf}/documents.parquet"))
    assert queries.QUERIES["op8_huffman_ids"](spark, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
