"""Byte-level BPE: DuckDB recursive queries encode the words of a partition, ordered aggregation decodes.

Each task splits its texts by the pattern, and puts each word it hasn't met (and that is no token as
a whole) into a table of token-position rows with their right neighbours. A recursive query joins
neighbours with the merge table, contracts each word's leftmost pair of least rank, and repeats
until no word has a pair left. Ids of a text are gathered from its words. Decoding aggregates
(text, position, id) rows in order of position and puts the bytes of each text's ids together.

The query is keyed by (word, position) and keeps the last row of each, so its memory grows with the bytes of
the words, not with the rounds. Two things keep rounds few, and neither changes an id:

* Unless a contraction brings about a pair of lesser rank with what stands beside it, the other occurrences of the
  leftmost pair would be contracted next, one after the other. In pieces of over ``SHORT`` bytes, these, up to the
  first that does, go in one round (``CONTRACT_MORE``). For shorter ones a round of the query is cheaper that contracts
  one pair of each. Both are the same recursion, and tests hold them against each other at all lengths.
* A word is cut first where no token of the vocabulary can cross, as told by up to ``REACH`` bytes on both sides;
  its pieces have merges of their own. So unspaced text of large scripts comes in short pieces that recur.

Texts are cut at single spaces between non-space characters first, where no match of the pattern can
cross, so that the pattern runs once for each distinct unit that a task remembers. Memory: a block of
texts, a bounded number of remembered units and words, and DuckDB's limit; DuckDB never spills, as it has no
folder to do so.

Letters and digits are told by the Unicode tables of the ``regex`` module, which may be newer than the
library's. Texts that have a code point beyond the common version (unassigned for ``unicodedata``, a letter or digit for
``regex``) are therefore encoded by the library itself.

Defined cases: a null text is an empty one and has no ids; texts of any length are encoded whole;
special tokens are ordinary text; repeated rows give repeated rows; an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.common import ship, slimmed

#: Bytes on each side of a place that tell whether a token can cross it.
REACH = 3
#: Characters of text that are encoded at once, at least one text; bytes of words in one recursive query, at least one
#: word; units, words and pieces remembered.
BLOCK_CHARS = 2_000_000
BLOCK_BYTES = 400_000
#: Pieces of so many bytes contract one pair a round; words of more bytes than this are looked at for cuts.
SHORT = 64
WORTH_CUTTING = 16
MOST_UNITS = 300_000
MOST_WORDS = 500_000
#: Tokens that are decoded at once, at least one text's.
BLOCK_TOKENS = 300_000

#: t: the token at a place, -1 once it is part of another; q and n: place and token on the right; r: four times the rank
#: of (t, n), 2 more where that token's pair with itself is of lesser rank, 1 more where a pair of it with any other is.
CONTRACT = """
WITH RECURSIVE s(w, p, t, q, n, r) USING KEY (w, p) AS (
  SELECT w, p, t, q, n, m.r FROM starts LEFT JOIN merges m ON t = m.a AND n = m.b
  UNION ALL
  SELECT x.w, x.p, x.t, x.q, x.n, CASE WHEN x.t >= 0 THEN m.r END
  FROM (
    WITH best AS (SELECT w, min((r::BIGINT << 32) | p) AS k, arg_min(q, (r::BIGINT << 32) | p) AS gone FROM s WHERE t >= 0 AND r IS NOT NULL GROUP BY w),
    e AS (SELECT b.w, (b.k & 4294967295)::INT AS p, (b.k >> 34)::INT AS ab, b.gone, x.q, x.n FROM best b JOIN s x ON x.w = b.w AND x.p = b.gone)
    SELECT s.w, s.p, CASE WHEN s.p = e.gone THEN -1 WHEN s.p = e.p THEN e.ab ELSE s.t END AS t,
         CASE WHEN s.p = e.p THEN e.q ELSE s.q END AS q,
         CASE WHEN s.p = e.p THEN e.n WHEN s.q = e.p THEN e.ab ELSE s.n END AS n
    FROM s JOIN e ON s.w = e.w WHERE s.t >= 0) x
  LEFT JOIN merges m ON x.t = m.a AND x.n = m.b)
SELECT w, p, t FROM s WHERE t >= 0 ORDER BY w, p
"""

#: The same for long pieces, with further occurrences of the leftmost pair in the same round.
CONTRACT_MORE = """
WITH RECURSIVE s(w, p, t, q, n, r) USING KEY (w, p) AS (
  SELECT w, p, t, q, n, m.r FROM starts LEFT JOIN merges m ON t = m.a AND n = m.b
  UNION ALL
  SELECT x.w, x.p, x.t, x.q, x.n, CASE WHEN x.t >= 0 THEN m.r END
  FROM (
    WITH best AS (SELECT w, min((r::BIGINT << 32) | p) AS k FROM s WHERE t >= 0 AND r IS NOT NULL GROUP BY w),
    live AS (SELECT s.*, b.k FROM s JOIN best b ON s.w = b.w WHERE s.t >= 0),
    same AS (SELECT w, p, q, r, lag(q) OVER (PARTITION BY w ORDER BY p) IS DISTINCT FROM p AS head
             FROM live WHERE r = k >> 32 AND (r & 2 = 0 OR p = k & 4294967295)),
    odd AS (SELECT o.w, o.p, o.r >> 2 AS ab, x.n FROM same o JOIN live x ON x.w = o.w AND x.p = o.q WHERE o.r & 1 = 1),
    stops AS (SELECT o.w, min(o.p) AS stop FROM odd o LEFT JOIN live y ON y.w = o.w AND y.q = o.p
              LEFT JOIN merges m ON m.a = o.ab AND m.b = o.n LEFT JOIN merges v ON v.a = y.t AND v.b = o.ab
              WHERE m.r >> 2 < o.ab OR v.r >> 2 < o.ab GROUP BY o.w),
    chains AS (SELECT w, p, q, r, sum(head::INT) OVER (PARTITION BY w ORDER BY p) AS chain FROM same),
    nth AS (SELECT w, p, q, r, row_number() OVER (PARTITION BY w, chain ORDER BY p) AS i FROM chains),
    picked AS (SELECT nth.* FROM nth LEFT JOIN stops z ON nth.w = z.w WHERE i & 1 = 1 AND (stop IS NULL OR p <= stop)),
    c AS (SELECT d.w, d.p, d.q AS gone, d.r >> 2 AS ab, l.q, l.n FROM picked d JOIN live l ON l.w = d.w AND l.p = d.q)
    SELECT l.w, l.p, CASE WHEN g.w IS NOT NULL THEN -1 ELSE coalesce(c.ab, l.t) END AS t,
           coalesce(c.q, l.q) AS q, coalesce(z.ab, c.n, l.n) AS n
    FROM live l LEFT JOIN c ON l.w = c.w AND l.p = c.p LEFT JOIN c g ON l.w = g.w AND l.p = g.gone
    LEFT JOIN c z ON l.w = z.w AND coalesce(c.q, l.q) = z.p) x
  LEFT JOIN merges m ON x.t = m.a AND x.n = m.b)
SELECT w, p, t FROM s WHERE t >= 0 ORDER BY w, p
"""

DECODE = """
SELECT doc, sha256(unhex(array_to_string(list_select((SELECT hex FROM vocabulary), ids), ''))) AS sha
FROM (SELECT doc, list(id + 1 ORDER BY pos) AS ids FROM tokens GROUP BY doc) ORDER BY doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + length], one after the other."""
    before = np.cumsum(length) - length
    return flat[np.repeat(start - before, length) + np.arange(int(length.sum()))]


class Ragged:
    """Arrays of ids under numbers, in one growing buffer."""

    def __init__(self) -> None:
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.length, self.n = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(lengths) > len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.length = np.concatenate([self.length, np.empty_like(self.length)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + len(lengths)] = lengths
        self.used, self.n = self.used + len(ids), self.n + len(lengths)

    def get(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.flat, self.start[which], self.length[which]), self.length[which]


class Numbered(dict):
    """Numbers for strings, in the order in which they are first asked for."""

    def __init__(self, fresh: list[str], first: int) -> None:
        self.fresh, self.next = fresh, first

    def __missing__(self, key: str) -> int:
        self[key] = at = self.next
        self.fresh.append(key)
        self.next += 1
        return at


class Codec:
    def __init__(self, path: str, pattern: str, memory: str = "512MB") -> None:
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.space = regex.compile(r"\s")
        self.safe = regex.compile(r"(?<=\S)(?= \S)")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        own = {"threads": 1, "memory_limit": memory, "preserve_insertion_order": False, "temp_directory": ""}
        self.db = duckdb.connect(config=own)
        pairs = [
            (self.ranks[t[:i]], self.ranks[t[i:]], rank)
            for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        a, b, ab = np.array(pairs or np.empty((0, 3)), np.int32).T
        lower = np.isin(ab, np.unique(np.concatenate([a[ab < a], b[ab < b]])))
        twice = np.isin(ab, a[(a == b) & (ab < a)])
        self._table("given", a=a, b=b, r=4 * ab + 2 * twice + lower)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.crossing = self._crossing()
        self.library = None
        self.settled: set[str] = set()
        self.path, self.letter = path, regex.compile(r"[\p{L}\p{N}]")
        spelt = [""] * (max(self.ranks.values()) + 1)  # by id; a list, which is read by place
        for token, rank in self.ranks.items():
            spelt[rank] = token.hex()
        self.db.register("given", pa.table({"hex": [spelt]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")
        self.forget()

    def forget(self, words: bool = True) -> None:
        if words:
            self.words, self.word_ids = {}, Ragged()
            self.pieces, self.piece_ids = {}, Ragged()
        self.unit_ids = Ragged()
        self.fresh: list[str] = []
        self.units = Numbered(self.fresh, 0)

    def _table(self, name: str, **columns: np.ndarray) -> None:
        self.db.register(name, pa.table(columns))

    def _crossing(self) -> dict[tuple[int, int], np.ndarray]:
        """What stands on both sides of the places within tokens, by how many bytes of each, as sorted numbers."""
        found: dict[tuple[int, int], set[int]] = {(i, j): set() for i in range(1, REACH + 1) for j in range(1, REACH + 1)}
        for token in self.ranks:
            for i in range(1, len(token)):
                near = token[max(0, i - REACH) : i + REACH]
                x = 0
                for byte in near:
                    x = x * 257 + byte
                found[min(i, REACH), min(len(token) - i, REACH)].add(x)
        # By the two bytes at a place: whether they are a token of their own, and whether any token has them so.
        self.pairs_alone, self.pairs_within = np.zeros(257 * 257, bool), np.zeros(257 * 257, bool)
        self.pairs_alone[list(found[1, 1])] = True
        self.pairs_within[[a * 257 + b for token in self.ranks for a, b in zip(token, token[1:])]] = True
        return {k: np.array(sorted(v), np.int64) for k, v in found.items()}

    def _cuts(self, words: list[bytes]) -> list[list[bytes]]:
        """The pieces of words that no token can join."""
        gap = b"\0" * REACH
        flat = np.frombuffer(gap + b"".join(w + gap for w in words), np.uint8).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        starts = REACH + np.cumsum(size + REACH) - size - REACH
        inside = np.zeros(len(flat) + 1, np.int32)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + size, -1)
        flat[np.cumsum(inside[:-1]) == 0] = 256  # no byte of a word
        pair = flat[:-1] * 257 + flat[1:]
        joined = np.append(False, self.pairs_alone[pair])  # whether a token can cross from the byte before to this one
        open_ = np.flatnonzero(self.pairs_within[pair] & ~joined[1:]) + 1
        for (i, j), known in self.crossing.items():
            if not len(known) or not len(open_) or i + j == 2:
                continue
            key = np.zeros(len(open_), np.int64)
            for k in range(-i, j):
                key = key * 257 + flat[open_ + k]
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[at] == key
            joined[open_[hit]] = True
            open_ = open_[~hit]
        inner = np.cumsum(inside[:-1]) > 0
        inner[starts] = False
        cut = np.flatnonzero(inner & ~joined)
        of = np.searchsorted(starts, cut, "right") - 1
        out = [[w] for w in words]
        at = (cut - starts[of]).tolist()
        if not len(of):
            return out
        bounds = np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist()
        for x, z in zip(bounds, [*bounds[1:], len(of)], strict=True):
            w, ends = words[of[x]], [0, *at[x:z], size[of[x]]]
            out[of[x]] = [w[m:n] for m, n in zip(ends, ends[1:])]
        return out

    def _contract(self, words: list[bytes], query: str = CONTRACT) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        token = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        end = np.cumsum(size)
        place = (np.arange(len(token)) - np.repeat(end - size, size)).astype(np.int32)
        right = np.roll(token, -1)
        right[end - 1] = -1
        self._table("starts", w=word, p=place, t=token, q=place + np.int32(1), n=right)
        got = self.db.execute(query).fetchnumpy()
        return got["t"], np.bincount(got["w"], minlength=len(words))

    def _learn_pieces(self, pieces: list[bytes], store: Callable[[list[bytes], np.ndarray, np.ndarray], None]) -> None:
        pieces.sort(key=len)  # pieces of a block are then done after about as many rounds
        at = 0
        while at < len(pieces):
            end, size = at, 0
            query = CONTRACT if len(pieces[at]) <= SHORT else CONTRACT_MORE
            most = SHORT if query is CONTRACT else len(pieces[-1])
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= BLOCK_BYTES and len(pieces[end]) <= most):
                size += len(pieces[end])
                end += 1
            part = pieces[at:end]
            store(part, *self._contract(part, query))
            at = end

    def _learn_words(self, words: list[str]) -> None:
        raw = {w: w.encode() for w in words}
        whole = [w for w, r in raw.items() if r in self.ranks]
        self._add_words(whole, np.array([self.ranks[raw[w]] for w in whole], np.int32), np.ones(len(whole), np.int64))
        rest = {r: w for w, r in raw.items() if r not in self.ranks}
        if not rest:
            return
        cut = {r: [r] for r in rest}
        far = [r for r in rest if len(r) > WORTH_CUTTING]
        if far:
            cut.update(zip(far, self._cuts(far), strict=True))
        # A word of one piece is kept as a word alone.
        alone = [r for r, xs in cut.items() if len(xs) == 1]
        self._learn_pieces(alone, lambda part, ids, counts: self._add_words([rest[r] for r in part], ids, counts))
        joined = [xs for xs in cut.values() if len(xs) > 1]
        if not joined:
            return
        fresh = list(dict.fromkeys(x for xs in joined for x in xs if x not in self.pieces))

        def store(part: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
            self.pieces.update(zip(part, range(self.piece_ids.n, self.piece_ids.n + len(part))))
            self.piece_ids.add(ids, counts)

        self._learn_pieces(fresh, store)
        ids, length = self.piece_ids.get(np.array([self.pieces[x] for xs in joined for x in xs], np.int64))
        each = np.array([len(xs) for xs in joined], np.int64)
        bounds, ends = np.concatenate([[0], np.cumsum(length)]), np.cumsum(each)
        self._add_words([rest[r] for r, xs in cut.items() if len(xs) > 1], ids, bounds[ends] - bounds[ends - each])

    def _add_words(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.words.update(zip(words, range(self.word_ids.n, self.word_ids.n + len(words)), strict=True))
        self.word_ids.add(ids, counts)

    def _learn_units(self) -> None:
        """Ids of the units that were met for the first time."""
        fresh = self.fresh
        if not fresh:
            return
        find = self.pattern.findall  # of letters alone, with a space before them or not, there is one match
        found = [(u,) if u.isalpha() or u[0] == " " and u[1:].isalpha() else find(u) for u in fresh]
        new = [w for w in dict.fromkeys(w for ws in found for w in ws) if w not in self.words]
        self._learn_words(new)
        flat = np.array([self.words[w] for ws in found for w in ws], np.int64)
        ids, length = self.word_ids.get(flat)
        each = np.array([len(ws) for ws in found], np.int64)
        bounds = np.concatenate([[0], np.cumsum(length)])
        ends = np.cumsum(each)
        self.unit_ids.add(ids, bounds[ends] - bounds[ends - each])
        fresh.clear()

    def _plain(self, text: str) -> bool:
        """Whether each space of a text stands alone between other signs, so that units are what a split gives."""
        if not text or text[0].isspace() or text[-1].isspace() or "  " in text or "\n " in text or " \n" in text:
            return False
        return not self._odd(text)

    def _odd(self, text: str) -> bool:
        """Whether a text has white space besides space and line feed; then only the pattern can tell."""
        return not text.isprintable() and any(c in text for c in _ODD) or not text.isascii() and any(c in text for c in _WIDE)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has."""
        if self.unit_ids.n > MOST_UNITS:
            self.forget(len(self.words) + len(self.pieces) > MOST_WORDS)
        newer = {i: t for i, t in enumerate(texts) if not t.isascii() and self._newer(t)}
        if newer:
            texts = ["" if i in newer else t for i, t in enumerate(texts)]
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        found: list[np.ndarray | None] = [None] * len(texts)
        if plain:
            # Arrow tells units apart; Python sees each one once a call, with the space before it.
            parts = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
            units = parts.values.dictionary_encode()
            index, ends = units.indices.to_numpy(), parts.offsets.to_numpy()
            first = np.zeros(len(index), bool)
            first[ends[:-1]] = True
            number = np.zeros(len(units.dictionary), np.int64)
            used = np.flatnonzero(np.bincount(index[~first], minlength=len(units.dictionary)))
            number[used] = np.fromiter(map(self.units.__getitem__, map(" ".__add__, units.dictionary.take(pa.array(used)).to_numpy(zero_copy_only=False))), np.int64)
            flat = number[index]
            flat[ends[:-1]] = np.fromiter((self.units[x] for x in units.dictionary.take(pa.array(index[ends[:-1]])).to_numpy(zero_copy_only=False)), np.int64)
            for i, a, z in zip(plain, ends[:-1], ends[1:], strict=True):
                found[i] = flat[a:z]
        for i, own in enumerate(found):
            if own is None:
                found[i] = np.array([self.units[u] for u in self.safe.split(texts[i])] if texts[i] else [], np.int64)
        self._learn_units()
        flat = np.concatenate([np.empty(0, np.int64), *found])
        each = np.array([len(us) for us in found], np.int64)
        ids, length = self.unit_ids.get(flat)
        bounds = np.concatenate([[0], np.cumsum(length)])
        ends = np.cumsum(each)
        counts = bounds[ends] - bounds[ends - each]
        if newer:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, t in newer.items():
                parts[i] = np.array(self._by_library(t), np.int32)
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts

    def _newer(self, text: str) -> bool:
        """Whether a text has a letter or digit that only the newer of the Unicode tables have."""
        for c in set(text) - self.settled:
            if unicodedata.category(c) == "Cn" and self.letter.match(c):
                return True
            self.settled.add(c)
        return False

    def _by_library(self, text: str) -> list[int]:
        if self.library is None:
            import tiktoken

            self.library = tiktoken.Encoding("own", pat_str=self.pattern.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self.library.encode_ordinary(text)

    def decoded_sha256(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """SHA-256 of the bytes that the ids of each text stand for."""
        out = [hashlib.sha256(b"").hexdigest()] * len(counts)
        ends = np.cumsum(counts)
        first = 0
        while first < len(counts):
            begin = int(ends[first] - counts[first])
            last = max(first + 1, int(np.searchsorted(ends, begin + BLOCK_TOKENS, "right")))
            part = ids[begin : int(ends[last - 1])]
            doc = np.repeat(np.arange(first, last, dtype=np.int32), counts[first:last])
            self._table("tokens", doc=doc, pos=np.arange(len(part), dtype=np.int32), id=part)
            got = self.db.execute(DECODE).fetchnumpy()
            for d, sha in zip(got["doc"].tolist(), got["sha"].tolist(), strict=True):
                out[d] = sha
            first = last
        return out


#: White space besides space and line feed.
_ODD = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One per worker and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs.clear()
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def forget_all() -> None:
    """Drops what this worker's codecs remember of texts; the vocabularies stay."""
    for known in _codecs.values():
        known.forget()


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, first = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column("text")).fill_null(0).to_pylist()):
            size += n
            if size >= BLOCK_CHARS:
                yield batch.slice(first, i + 1 - first)
                size, first = 0, i + 1
        if first < batch.num_rows:
            yield batch.slice(first)


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for part in blocks(batches):
            ids, counts = coder.encode([t or "" for t in part.column("text").to_pylist()])
            bounds = np.concatenate([[0], np.cumsum(counts)])
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            shas = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas), pa.array(coder.decoded_sha256(ids, counts))]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(slimmed(run, forget_all), schema)
