"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits, from the XXH64 of word shingles. Two fingerprints that differ in at most
two bits, cut into two segments of 32, have a segment that differs in at most one bit. So each
distinct fingerprint is indexed by both segments, whole and with each bit in turn as a wildcard; an
equality join finds the candidates and a bit count verifies them. A wildcard entry only meets entries
with the other value of that bit, so each pair is seen once a segment.

There are two ways to link what shares an index entry, both exact, so that ``crowd`` changes the cost and
never the components (a property test holds them against each other around it). Up to ``crowd``
fingerprints to an entry are joined with each other. Those of a larger entry, whose pairs would grow with its
square, are indexed by the points within one bit of them instead: fingerprints that share a point differ in at
most two bits, all that differ in at most two share one, and a point has 65 of them at most. These
are linked to the least, so no pairs of a large group are made. Components are found by star
contraction over the links; nothing of the size of the corpus comes to the driver, and no join may broadcast it.

:func:`one_alike` takes similarity in place of bits: five-word shingles, and texts whose sets of them have a
Jaccard similarity of 0.8 or more. Such sets lie at an angle that makes about 77 of 512 bits differ, so it makes
fingerprints of 512 bits, cuts them into 16 segments, and verifies candidates by the bits of the whole
fingerprints (one standard deviation of their count is 8 bits, or 0.04 of similarity at the threshold). Segments
that differ in one bit are of different parity, so those of odd parity are indexed by all their variants
and those of even parity by themselves; two odd ones that differ in two bits meet as well. Pairs
that differ in up to 31 bits share an entry for certain, those beyond by chance; `tests/llm/test_alike.py`
holds the recall against brute force. In each entry all are first compared with its least member, two that meet in
several entries once. An entry whose members have come to one component by these
links, over any entries, is settled. Of any other, all members outside its most frequent component are compared
with all members of other components, so no link between components is lost, and making all pairs in entries of up to ``crowd``
changes the cost alone (a property test holds
them against brute force). A group of near copies of any size costs its size; an entry of many texts that are not alike costs their square,
spread over tiles.

Defined cases: a null text is an empty one; texts without words have fingerprint zero and are linked
like any other; fewer words than a shingle are one shingle; a null doc_id sorts after all others;
repeated rows share a fingerprint and a component; an empty table gives an empty result; extra
columns of any name are carried by :func:`one_of_each` and left out by :func:`near_groups`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.common import MOST_SENT, discard, located, materialize, of, row_name, ship, slimmed, unsent
from beaconlake.llm.graph import components

SHINGLE = 3
SEED = 42
#: Pairs are made within an index entry of so many fingerprints at most.
CROWD = 64
_BLOCK = 1 << 16

ALIKE_SHINGLE = 5
SIMILARITY = 0.8
WIDE_BITS = 512
#: Of two wide fingerprints in an index entry the link to the least is all there is to it.
PAIR = 2
#: Members of a larger entry that are not linked otherwise are compared in tiles of so many by so many.
TILE = 1024
#: A task makes the some 270 index entries each of so many wide fingerprints.
PRINTS_A_TASK = 4096
#: So many shared index keys of 8 bytes go to all executors at most; more are joined by a shuffle.
MOST_KEYS = 500_000
_LANES = WIDE_BITS // 64
#: SplitMix64 makes the lanes of a wide fingerprint from one hash a shingle.
_STEPS = (np.arange(1, _LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
#: The eight bits of a byte as the eight bytes of a number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in _hashes(text, shingle):
        bits = np.unpackbits(hashes.reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def _hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """The bytes of the shingles' hashes, in blocks; none of a text without words."""
    words = text.lower().split()  # both are ASCII-only for bytes
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= shingle:
        starts, ends = [0], [len(joined)]
    else:
        after = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *after[: len(words) - shingle].tolist()]
        ends = (after[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), _BLOCK):
        made = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)]
        yield np.frombuffer(b"".join(made), dtype=np.uint8)


def wide_fingerprint(text: bytes, shingle: int = ALIKE_SHINGLE) -> list[int]:
    """The fingerprint of a text's set of shingles: WIDE_BITS bits as signed 64-bit integers, all zero without words."""
    blocks = [b.view(np.uint64) for b in _hashes(text, shingle)]
    if not blocks:
        return [0] * _LANES
    hashes = np.unique(np.concatenate(blocks))
    ones = np.zeros(WIDE_BITS, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 ones fit the bytes that they are counted in
        mixed = hashes[at : at + 255, None] + _STEPS
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        ones += _SPREAD[mixed.view(np.uint8)].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(">i8").tolist()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        made = pa.array([fingerprint(t.as_py() or b"") for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=["row", "fp"])


def fingerprinted(rows: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of :func:`located`: row (struct of unnamed, doc_id and at, its locator) and fp."""
    ship(rows.sparkSession)
    named = rows.select(row_name(doc_id).alias("row"), of(text).cast("binary").alias("text"))
    return named.mapInArrow(slimmed(_fingerprints), f"row {named.schema['row'].dataType.simpleString()}, fp long")


def _entries(prints: DataFrame) -> DataFrame:
    """66 index entries a fingerprint: place 0-31 of a segment is a wildcard, 32 is none. bit: what the wildcard stands for."""
    at = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("k"))
    at = at.select("fp", F.col("k") % 33, F.floor(F.col("k") / 33).cast("int")).toDF("fp", "place", "side")
    part = F.expr("CASE WHEN side = 0 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END")
    at = at.select("fp", "place", "side", part.alias("part"))
    return at.select(
        "fp",
        F.expr(
            "CASE WHEN place = 32 THEN part ELSE part & ~shiftleft(1L, place) END"
            " + shiftleft(cast(place + 33 * side AS BIGINT), 32)"
        ).alias("key"),
        F.expr("CASE WHEN place = 32 THEN 2 ELSE cast(shiftright(part, place) & 1L AS INT) END").alias("bit"),
    )


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) that differ in two bits or fewer."""
    entries = _entries(prints)
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(entries.join(unsent(sizes), "key"), "entries")
    few = shared.filter(F.col("n") <= crowd)
    a = few.filter("bit <> 1").select("key", F.col("fp").alias("a"), F.col("bit").alias("bit_a"))
    b = few.filter("bit <> 0").select("key", F.col("fp").alias("b"), F.col("bit").alias("bit_b"))
    met = a.join(unsent(b), "key").filter("(bit_a = 0 and bit_b = 1) or (bit_a = 2 and bit_b = 2 and a < b)")
    pairs = met.filter("bit_count(a ^ b) <= 2").select("a", "b")

    many = shared.filter(F.col("n") > crowd).select("fp").distinct()
    points = many.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("k")).select(
        "fp", F.expr("CASE WHEN k = 64 THEN fp ELSE fp ^ shiftleft(1L, k) END").alias("point")
    )
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n"))
    least = materialize(least.filter("n > 1"), "points")
    two = least.filter("n = 2").select("a", F.col("z").alias("b"))
    more = points.join(unsent(least.filter("n > 2")), "point").select("a", F.col("fp").alias("b"))
    near = two.union(more).filter("a <> b and bit_count(a ^ b) <= 2")
    found = materialize(pairs.union(near).distinct(), "links")
    discard(shared, least)
    return found


def grouped(located_rows: DataFrame, text: str = "text", doc_id: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """Per row of :func:`located`: row, fp, first (the row struct that comes first in its component)."""
    rows = materialize(fingerprinted(located_rows, text, doc_id), "fingerprints")
    firsts = materialize(rows.groupBy("fp").agg(F.min("row").alias("first")), "prints")
    n = firsts.count()
    roots = components(links(firsts.select("fp"), crowd))
    rooted = firsts.join(unsent(roots, n), firsts["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    if n > MOST_SENT:  # between two shuffled sides a large component splits as a skewed join does
        least = materialize(least, "least")
    named = materialize(rooted.select("fp", "root").join(unsent(least, n), "root").select("fp", "first"), "components")
    discard(firsts, roots, least)
    return rows.join(unsent(named, n), "fp")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint in hex, component_id."""
    return grouped(located(docs), text, doc_id, crowd).select(
        F.col("row.doc_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """Of each component the row with the smallest doc_id, with the columns of docs."""
    rows = located(docs)
    gone = grouped(rows, text, doc_id, crowd).filter(F.col("row") != F.col("first")).select("row.at")
    return rows.join(unsent(gone), F.col("loc") == F.col("at"), "left_anti").select("doc.*")


def most_bits(similarity: float) -> int:
    """How many bits differ, as expected, between wide fingerprints of sets of this Jaccard similarity and of like sizes."""
    return int(WIDE_BITS * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        made = pa.array([wide_fingerprint(t.as_py() or b"") for t in texts], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=["row", "fp"])


def _differing(a: str, b: str) -> str:
    return " + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(_LANES))


def _alike_entries(prints: DataFrame) -> DataFrame:
    """Index entries (key, id) of wide fingerprints: a segment of odd parity and all its variants, one of even parity itself."""
    halves = "transform(sequence(0, {}), k -> IF(k % 2 = 0, fp[k div 2] & 4294967295L, shiftrightunsigned(fp[k div 2], 32)))"
    parts = prints.select("id", F.posexplode(F.expr(halves.format(2 * _LANES - 1))).alias("side", "part"))
    variants = (
        "IF(bit_count(part) % 2 = 1, transform(sequence(0, 32), i -> IF(i = 32, part, part ^ shiftleft(1L, i))), array(part))"
    )
    keys = parts.select("id", "side", F.explode(F.expr(variants)).alias("part"))
    return keys.select("id", F.expr("part | shiftleft(cast(side AS BIGINT), 32)").alias("key"))


def alike_links(prints: DataFrame, similarity: float = SIMILARITY, crowd: int = PAIR, tile: int = TILE) -> DataFrame:
    """Links (a, b) between ids of wide fingerprints (columns id and fp) that connect all that are alike and share an entry."""
    first, roots, crossing = _linked(prints, similarity, crowd, tile)
    return first if crossing is None else first.union(crossing.select("a", "b"))


def alike_roots(prints: DataFrame, similarity: float = SIMILARITY, crowd: int = PAIR, tile: int = TILE) -> DataFrame:
    """One row per id that has a link of :func:`alike_links`: node, root."""
    first, roots, crossing = _linked(prints, similarity, crowd, tile)
    if crossing is None or not (n := crossing.count()):
        discard(first, crossing)
        return roots
    later = components(crossing, "root_a", "root_b")
    met = later.toDF("was", "now")
    known = roots.union(met.select("was", "was")).distinct()  # an id without a first link is a root by itself
    out = known.join(unsent(met, 2 * n), F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
    out = materialize(out, "roots")
    discard(first, roots, crossing, later)
    return out


def _linked(prints: DataFrame, similarity: float, crowd: int, tile: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Links (a, b), their components, and if there are entries of more than two and than crowd, the links of :func:`_crossing`.

    All are compared with the least of each of their entries, and in entries of up to crowd with each other.
    """
    n = prints.count()
    entries = _alike_entries(prints.repartition(n // PRINTS_A_TASK + 1, "id"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    sizes = materialize(sizes.filter("n > 1"), "keys")
    known = F.broadcast(sizes) if sizes.count() <= MOST_KEYS else unsent(sizes)
    shared = materialize(entries.join(known, "key"), "entries")
    near = f"{_differing('fp_a', 'fp_b')} <= {most_bits(similarity)}"
    met = shared.filter("least <> id").select(F.col("least").alias("a"), F.col("id").alias("b"))
    if crowd > PAIR:
        few = shared.filter(F.col("n") <= crowd)
        one, two = (few.select("key", F.col("id").alias(name)) for name in ("a", "b"))
        met = met.union(one.join(unsent(two), "key").filter("a < b").select("a", "b"))
    met = met.distinct()
    for name in ("a", "b"):
        met = met.join(unsent(prints.select(F.col("id").alias(name), F.col("fp").alias(f"fp_{name}")), n), name)
    first = materialize(met.filter(near).select("a", "b"), "links")
    roots = components(first)
    crossing = None
    if sizes.filter(F.col("n") > max(crowd, PAIR)).count():
        crossing = _crossing(shared.filter(F.col("n") > max(crowd, PAIR)).select("key", "id"), prints, roots, near, n, tile)
    discard(sizes, shared)
    return first, roots, crossing


def _crossing(many: DataFrame, prints: DataFrame, roots: DataFrame, near: str, n: int, tile: int) -> DataFrame:
    """The links (root_a, root_b, a, b) that components lack in entries (key, id): one for each two that are alike in an entry.

    All of an entry that are not of its most frequent component are compared with all of it, in tiles of about ``tile`` by ``tile``.
    """
    rooted = many.join(unsent(roots, n), F.col("id") == F.col("node"), "left")
    members = materialize(rooted.select("key", "id", F.coalesce("root", "id").alias("root")), "members")
    sums = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
    sums = sums.agg(F.max(F.struct("n", "root")).alias("home"), F.sum("n").alias("n")).filter("home.n < n")
    blocks = [F.ceil(F.expr(f"({size}) / {tile}")).alias(name) for size, name in (("n - home.n", "rows"), ("n", "cols"))]
    unsettled = materialize(sums.select("key", F.col("home.root").alias("home"), *blocks), "unsettled")
    dealt = members.join(unsent(unsettled, unsettled.count()), "key").join(unsent(prints, n), "id")
    dealt = dealt.withColumn("h", F.xxhash64("id"))
    one = dealt.filter("root <> home").selectExpr(
        "key", "id AS a", "fp AS fp_a", "root AS root_a", "pmod(h, rows) AS i", "explode(sequence(0L, cols - 1)) AS j"
    )
    two = dealt.selectExpr(
        "key", "id AS b", "fp AS fp_b", "root AS root_b", "root = home AS at_home", "pmod(h, cols) AS j",
        "explode(sequence(0L, rows - 1)) AS i",
    )
    met = one.join(unsent(two), ["key", "i", "j"]).filter("root_a <> root_b AND (at_home OR a < b)").filter(near)
    met = met.groupBy(F.least("root_a", "root_b").alias("root_a"), F.greatest("root_a", "root_b").alias("root_b"))
    met = met.agg(F.min(F.struct("a", "b")).alias("link"))
    out = materialize(met.select("root_a", "root_b", "link.*"), "crossing")
    discard(members, unsettled)
    return out


def alike(located_rows: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """Per row of :func:`located`: row, and first, the row struct that comes first among those alike, over links.

    Fingerprints are named by 64-bit hashes of theirs.
    """
    ship(located_rows.sparkSession)
    named = located_rows.select(row_name(doc_id).alias("row"), of(text).cast("binary").alias("text"))
    made = named.mapInArrow(slimmed(_wide), f"row {named.schema['row'].dataType.simpleString()}, fp array<long>")
    rows = materialize(made.withColumn("id", F.xxhash64("fp")), "fingerprints")
    firsts = materialize(rows.groupBy("id").agg(F.min("row").alias("first"), F.min("fp").alias("fp")), "prints")
    n = firsts.count()
    roots = alike_roots(firsts.select("id", "fp"), similarity)
    rooted = firsts.join(unsent(roots, n), firsts["id"] == roots["node"], "left")
    rooted = rooted.select("id", "first", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    if n > MOST_SENT:  # as in grouped()
        least = materialize(least, "least")
    named = materialize(rooted.select("id", "root").join(unsent(least, n), "root").select("id", "first"), "components")
    discard(firsts, roots, least)
    return rows.select("row", "id").join(unsent(named, n), "id").select("row", "first")


def one_alike(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """Of each group of texts alike the row with the smallest doc_id, with the columns of docs."""
    rows = located(docs)
    gone = alike(rows, text, doc_id, similarity).filter(F.col("row") != F.col("first")).select("row.at")
    return rows.join(unsent(gone), F.col("loc") == F.col("at"), "left_anti").select("doc.*")
