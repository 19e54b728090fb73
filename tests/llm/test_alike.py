"""The similarity form of the near-duplicates: wide fingerprints against brute force over sets of shingles."""

import random
import re

import pytest
import xxhash

from beaconlake.llm import graph, simhash

COLUMNS = "doc_id long, text string"
ALL = (1 << 64) - 1


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def wide_by_hand(text):
    made = shingles(text)
    ones = [0] * 512
    for s in made:
        h = int.from_bytes(xxhash.xxh64_digest(s.encode(), 42), "little")
        for lane in range(8):
            z = h + (lane + 1) * 0x9E3779B97F4A7C15 & ALL
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & ALL
            z = (z ^ z >> 27) * 0x94D049BB133111EB & ALL
            z ^= z >> 31
            for bit, v in enumerate(f"{byte:08b}" for byte in z.to_bytes(8, "little")):
                for k in range(8):
                    ones[64 * lane + 8 * bit + k] += v[k] == "1"
    bits = "".join("1" if 2 * n > len(made) else "0" for n in ones)
    return [int(bits[64 * i : 64 * i + 64], 2) for i in range(8)]


def unsigned(fp):
    return [v & ALL for v in fp]


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]


def edited(rng, text, n):
    out = list(text)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def test_fingerprints():
    rng = random.Random(5)
    texts = ["", " \n", "a", "A b c D", "a b c d e", "É é X a b c d", "a b c " * 300, "x\x00y"] + [" ".join(words(rng, n)) for n in (5, 6, 259, 260, 900)]
    for t in texts:
        assert unsigned(simhash.wide_fingerprint(t.encode())) == wide_by_hand(t), t[:40]


def test_a_text_of_more_than_one_block(monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    text = " ".join(words(random.Random(6), 200))
    assert unsigned(simhash.wide_fingerprint(text.encode())) == wide_by_hand(text)


def test_bits_of_similarities():
    assert simhash.most_bits(1.0) == 0 and simhash.most_bits(0.8) == 77 and simhash.most_bits(0.0) == 256


@pytest.mark.parametrize("most_keys", [0, 500_000])
def test_all_links_of_few_bits(spark, monkeypatch, most_keys):
    """Up to 31 bits, two to a segment but for one, every link is found, and none beyond 77."""
    monkeypatch.setattr(simhash, "MOST_KEYS", most_keys)
    rng = random.Random(7)
    values = []
    for _ in range(6):
        base = rng.getrandbits(512)
        values.append(base)
        for n in (1, 2, 16, 31, 31, 31, 60, 77, 78, 120):
            values.append(base ^ sum(1 << b for b in rng.sample(range(512), n)))
        for segment in rng.sample(range(16), 3):
            spoilt = [b for s in range(16) if s != segment for b in rng.sample(range(32 * s, 32 * s + 32), 2)]
            values.append(base ^ sum(1 << b for b in [*spoilt, 32 * segment + 5]))
    rows = []
    for i, v in enumerate(values):
        lanes = [v >> 64 * k & ALL for k in range(8)]
        rows.append((i, [x - (1 << 64) if x >> 63 else x for x in lanes]))
    got = {tuple(r) for r in simhash.alike_links(spark.createDataFrame(rows, "id long, fp array<long>"), crowd=1000).collect()}
    far = {(i, j): (a ^ values[j]).bit_count() for j in range(len(values)) for i, a in enumerate(values[:j])}
    assert {p for p, n in far.items() if n <= 31} <= got <= {p for p, n in far.items() if n <= 77}


def share_an_entry(a, b):
    """Segments of a fingerprint: odd ones are indexed by all within a bit, even ones by themselves."""
    for k in range(16):
        x, y = a >> 32 * k & 0xFFFFFFFF, b >> 32 * k & 0xFFFFFFFF
        if (x ^ y).bit_count() <= x.bit_count() % 2 + y.bit_count() % 2:
            return True
    return False


@pytest.mark.parametrize(("crowd", "tile", "most_sent"), [(1, 3, 100_000), (16, 1024, 100_000), (16, 7, 0)])
def test_components_of_large_entries(spark, monkeypatch, crowd, tile, most_sent):
    """Many texts with one segment in common, alike by threes and by chains, and near no member drawn: no link is lost."""
    from beaconlake.llm import common

    for module in (common, simhash, graph):
        monkeypatch.setattr(module, "MOST_SENT", most_sent)
    rng = random.Random(11)

    def spoilt(v, bits, keep):  # so many bits of each segment but one
        return v ^ sum(1 << b for s in range(16) if s != keep for b in rng.sample(range(32 * s, 32 * s + 32), bits))

    values = []
    for even in (0, 5):  # the segment that all have in common
        segment = 0b11011
        for _ in range(20):
            base = rng.getrandbits(512) & ~(0xFFFFFFFF << 32 * even) | segment << 32 * even
            values += [base, spoilt(base, 4, even), spoilt(base, 5, even)]
        for _ in range(30):  # a chain
            values.append(spoilt(values[-1], 4, even))
    base = rng.getrandbits(512)
    values += [base ^ sum(1 << b for b in rng.sample(range(512), 20)) for _ in range(60)]  # a group of near copies
    rows = []
    for i, v in enumerate(values):
        lanes = [v >> 64 * k & ALL for k in range(8)]
        rows.append((i, [x - (1 << 64) if x >> 63 else x for x in lanes]))
    prints = spark.createDataFrame(rows, "id long, fp array<long>")
    got = simhash.alike_links(prints, crowd=crowd, tile=tile).collect()
    assert all((values[a] ^ values[b]).bit_count() <= 77 for a, b in got)

    def roots(links):
        root = list(range(len(values)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in root]

    want = [(i, j) for j, b in enumerate(values) for i, a in enumerate(values[:j]) if (a ^ b).bit_count() <= 77 and share_an_entry(a, b)]
    assert roots(got) == roots(want)
    reached = {r["node"]: r["root"] for r in simhash.alike_roots(prints, crowd=crowd, tile=tile).collect()}
    assert [reached.get(i, i) for i in range(len(values))] == roots(want)


def test_links_grow_with_a_group_not_with_its_square(spark):
    """16 alike that share 15 segments: a link to the least for each, made once, where there were all 120 pairs."""
    rng = random.Random(12)
    rows = []
    for size in (2, 3, 8, 16, 17):
        base = rng.getrandbits(480) << 32
        for i in range(size):
            lanes = [(base | 0b11 << 2 * i) >> 64 * k & ALL for k in range(8)]
            rows.append((100 * size + i, [x - (1 << 64) if x >> 63 else x for x in lanes]))
    links = simhash.alike_links(spark.createDataFrame(rows, "id long, fp array<long>")).collect()
    assert sorted(map(tuple, links)) == [(100 * size, 100 * size + i) for size in (2, 3, 8, 16, 17) for i in range(1, size)]


def test_recall_and_clean_documents(spark):
    """Copies of 0.8 and more against brute force. The border is soft: a few pairs under 0.7 are linked, too, none under 0.6."""
    rng = random.Random(8)
    texts = []
    for k in range(240):
        base = words(rng, rng.choice([60, 150, 400]))
        texts += [base, edited(rng, base, max(1, int(len(base) * (k % 16) * 0.004)))]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingles(t) for _, t in rows]
    kept = {r["doc_id"] for r in simhash.one_alike(spark.createDataFrame(rows, COLUMNS)).collect()}
    alike, between, wrong, clean = {"0.8": [], "0.9": []}, [], [], 0
    for i in range(0, len(rows), 2):
        s = similarity(sets[i], sets[i + 1])
        assert i in kept
        if s >= 0.8:
            alike["0.9" if s >= 0.9 else "0.8"].append(i + 1 not in kept)
        elif s < 0.7:
            clean += 1
            if i + 1 not in kept:
                wrong.append(round(s, 3))
        else:
            between.append(i + 1 not in kept)
    print({k: (sum(v), len(v)) for k, v in alike.items()}, "0.7 to 0.8:", (sum(between), len(between)), "below:", wrong, clean)
    assert clean > 20 and len(wrong) <= 0.05 * clean and all(s > 0.6 for s in wrong)
    assert sum(alike["0.9"]) >= 0.95 * len(alike["0.9"]) and len(alike["0.9"]) > 20
    assert sum(alike["0.8"]) >= 0.5 * len(alike["0.8"]) and len(alike["0.8"]) > 10


def test_a_large_group(spark):
    """400 variants of one text, far more than the crowd of an entry, leave one; texts beside them stay."""
    rng = random.Random(9)
    base = words(rng, 300)
    rows = [(1000 - i, " ".join(edited(rng, base, 1 + i % 3))) for i in range(400)] + [(2000 + i, " ".join(words(rng, 100))) for i in range(50)]
    kept = sorted(r["doc_id"] for r in simhash.one_alike(spark.createDataFrame(rows, COLUMNS)).collect())
    assert kept == [601, *range(2000, 2050)]


def test_cases(spark):
    rows = [(9, "a b c", "x"), (4, "A  b c", "y"), (4, "a b c", "y"), (None, "a b c", "z"), (None, "d e f", None), (7, None, "n"), (6, " \n", "m"), (8, "", "o")]
    df = spark.createDataFrame(rows, COLUMNS + ", fp string")
    out = simhash.one_alike(df)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["fp"])) for r in out.collect()) == [("4", "y"), ("6", "m"), ("None", "None")]
    assert simhash.one_alike(spark.createDataFrame([], COLUMNS)).count() == 0


def test_components_of_the_table(spark, sf):
    """Over a whole table: every text kept out is near one kept, by links of at least 0.7; similar texts of 0.9 go."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    sets = {i: shingles(t) for i, t in texts.items()}
    kept = {r["doc_id"] for r in simhash.one_alike(docs).collect()}
    ids = sorted(texts)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if similarity(sets[a], sets[b]) >= 0.7]
    rows = spark.createDataFrame([*links, (-1, -2)], "a long, b long")
    roots = {r["node"]: r["root"] for r in graph.components(rows).collect()}
    assert all(i in kept for i in ids if roots.get(i, i) == i)
    assert all(max(a, b) not in kept for a, b in links if similarity(sets[a], sets[b]) >= 0.9)
