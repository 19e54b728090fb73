"""Removing repeated passages with a sparse suffix array, merged from front-coded sorted runs.

A byte goes if it lies in a string of ``SPAN`` bytes that also starts in a document of smaller doc_id.

* Anchors. Of the ``SPAN - GRAM + 1`` grams of ``GRAM`` bytes in each window of ``SPAN`` bytes, the one of
  least hash (the leftmost of equal ones) is the window's anchor. It hangs on the window's bytes alone,
  so equal windows have their anchors at equal places, and only suffixes that start at anchors need be
  sorted: about one in twenty. A suffix is cut at ``SPAN`` bytes; an entry also has the bytes on its left
  that its windows reach, and which windows these are.
* Runs. A task sorts the suffixes of a chunk of texts. Entries that agree in all their bytes are one for
  the documents of a chunk: the windows of all but the smallest document are repeats. What is left is
  front-coded (the common prefix with the one before as a number), cut at the splitters, and sent.
* Splitters. A sample of the suffixes is put in order, and its range bounds part the order of all suffixes, so ranges in
  order hold all entries in order. Entries are held against the bounds by their gram alone, so those that
  can share a window are in one range.
* Merge. The runs of a range go through a loser tree that keeps, with each loser, the common prefix with
  what beat it: the longer common prefix wins without a look at the bytes, and only at equal lengths are
  bytes compared, from that length on. The merge yields the common prefixes of neighbours.
* Windows. Entries that agree whole are settled by their smallest document. Of the others, only those
  whose longest common prefix (which a neighbour has) reaches far enough for one of their windows are
  taken apart into windows; equal windows meet by hash and are compared byte for byte.
* Frequent anchors. Grams that a sample finds too often for one range send their windows as suffixes of
  their own, which are held against the splitters by all their bytes. So neither a passage that a third of all
  documents share nor the many texts around a common phrase are one range's load.

Entries that agree only in part are settled window by window: the common prefixes of the merge tell which windows can
occur twice, equal ones meet by hash among these, and bytes decide.

The covered ranges go to their documents by (doc_id, hash of the text), and the rest of each text is
put together there. All exchanges are of packed runs, a row a run. The runs are deleted before the texts are sent.

Defined cases: a null text is an empty one; texts of less than SPAN bytes keep all; a null doc_id counts
as greater than any other, and null ones, like equal doc_ids, are not smaller than each other; rows that
agree in doc_id and text lose the same; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.common import discard, freed, materialize, ship

SPAN, GRAM = 50, 14
GRAMS = SPAN - GRAM + 1
LEFT = GRAMS - 1
#: Bytes of text of a run, at least one text; and bytes of text that a range or bucket is for. Runs times ranges is
#: the number of packed runs, so larger executors should take larger ones: a worker needs about 50 times as many bytes.
CHUNK, SHARE = 8 << 20, 8 << 20
#: One document in so many is looked at for sizes, frequent grams and splitters, and one in so many of its suffixes for these.
SAMPLE, THIN = 64, 8
NO_ID = np.iinfo(np.int64).max
_BLOCK = 1 << 17
_PLACE = np.uint64((1 << 20) - 1)
_M, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_RANDOM = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM = 8 + 4 + 2 bytes from each place on."""
    m = [np.uint64(pow(int(_M), 1 << i, 1 << 64)) for i in range(3)]
    h1 = b.astype(np.uint64)
    h2 = h1[:-1] * m[0] + h1[1:]
    h4 = h2[:-2] * m[1] + h2[2:]
    h8 = h4[:-4] * m[2] + h4[4:]
    n = len(b) - GRAM + 1
    return _mix((h8[:n] * m[2] + h4[8 : 8 + n]) * m[1] + h2[12 : 12 + n])


def anchors(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per anchor and stretch of windows that have it: first window, last window, anchor, its gram's hash.

    text holds documents from starts to ends, one after the other.
    """
    out: list[tuple[np.ndarray, ...]] = []
    total = len(text) - SPAN + 1
    some = ends - starts >= SPAN
    last = np.zeros(max(total, 0) + 1, np.int32)
    np.add.at(last, starts[some], 1)
    np.add.at(last, ends[some] - SPAN + 1, -1)
    within = np.cumsum(last[:-1]) > 0
    for a in range(0, max(total, 0), _BLOCK):
        z = min(a + _BLOCK, total)
        windows = np.flatnonzero(within[a:z])
        if not len(windows):
            continue
        h = gram_hashes(text[a : z + SPAN - 1])
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= GRAMS:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        rest = GRAMS - n
        low = np.minimum(low[: len(low) - rest], low[rest:])
        at = (low[windows] & _PLACE).astype(np.int64)
        new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(windows, prepend=-2) != 1))
        close = np.append(new[1:], len(at)) - 1
        out.append((windows[new] + a, windows[close] + a, at[new] + a, h[at[new]]))
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as columns of big-endian numbers, which sort alike."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def sort_rows(rows: np.ndarray) -> np.ndarray:
    """The order of rows of bytes: by 16 bytes first, and by all of them where these tie."""
    words = _words(rows)
    order = np.lexsort((words[:, 1], words[:, 0]))
    head = words[order, :2]
    same = np.flatnonzero((head[1:] == head[:-1]).all(axis=1))
    if len(same):
        tied = np.zeros(len(order), bool)
        tied[same] = tied[same + 1] = True
        place = np.flatnonzero(tied)
        group = np.cumsum(np.append(True, (head[1:] != head[:-1]).any(axis=1)))[place]
        own = words[order[place]]
        order[place] = order[place][np.lexsort((*(own[:, i] for i in range(own.shape[1] - 1, 1, -1)), group))]
    return order


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.uint8)
    for a in range(1, len(rows), 1 << 16):
        z = min(a + (1 << 16), len(rows))
        differ = rows[a:z] != rows[a - 1 : z - 1]
        first = differ.argmax(axis=1)
        out[a:z] = np.where(differ[np.arange(z - a), first], first, rows.shape[1])
    return out


def _side_hash(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of rows of bytes that are 0 from length on, and of the length."""
    h = length.astype(np.uint64)
    for column in _words(rows).T:
        h = _mix(h ^ column)
    return h


class Entries:
    """Suffixes at anchors: right (bytes from the anchor on), left (bytes before it, nearest first), the
    least and greatest number of bytes that a window has on the left, owner (number of the text) and
    place (of the anchor in the text). Bytes beyond a text or beyond the reach of windows are 0."""

    def __init__(self, right, left, least, most, owner, place) -> None:
        self.right, self.left, self.least, self.most, self.owner, self.place = right, left, least, most, owner, place

    def __len__(self) -> int:
        return len(self.owner)

    def take(self, which: np.ndarray) -> Entries:
        return Entries(*(getattr(self, k)[which] for k in ("right", "left", "least", "most", "owner", "place")))


def same_whole(e: Entries, prefixes: np.ndarray) -> np.ndarray:
    """Numbers that agree for entries that agree in all bytes and windows; e is sorted by right, and a number
    is that of a first entry."""
    out = np.arange(len(e))
    alike = prefixes == SPAN
    some = np.flatnonzero(alike | np.append(alike[1:], False))
    if not len(some):
        return out
    run = np.cumsum(~alike)[some]
    shape = e.least[some].astype(np.uint64) << np.uint64(8) | e.most[some]
    key = _side_hash(e.left[some], shape)
    order = np.lexsort((key, run))
    a, b = order[1:], order[:-1]
    fresh = np.append(True, (run[a] != run[b]) | (key[a] != key[b]))
    first = some[order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]]
    out[some[order]] = first
    head = out[some]
    wrong = some[(e.left[some] != e.left[head]).any(axis=1) | (e.least[some] != e.least[head]) | (e.most[some] != e.most[head])]
    out[wrong] = wrong  # equal hashes of different bytes stand alone
    return out


def text_hash(text: bytes) -> int:
    """What Spark's xxhash64 gives for the bytes."""
    return xxhash.xxh64_intdigest(text, 42)


def ranges_of(rows: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The range of each row of bytes, among sorted splitters."""
    return np.searchsorted(splitters, np.ascontiguousarray(rows).view(f"S{rows.shape[1]}")[:, 0], "right")


def chunk_runs(texts: list[bytes], ids: np.ndarray, frequent: np.ndarray, splitters: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(range, run) of a chunk of texts. A run is packed; see pack()."""
    parts = len(splitters) + 1
    hashes = np.array([text_hash(t) for t in texts], np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    text = np.frombuffer(b"".join([bytes(LEFT), *texts, bytes(SPAN)]), np.uint8)
    first, last, at, gram = anchors(text[LEFT : len(text) - SPAN], starts, ends)
    least, most = at - last, at - first
    if len(frequent):
        # Each window of a frequent gram is an entry of its own, with nothing on the left.
        hot = np.isin(gram, frequent)
        n = (last - first + 1)[hot]
        own = np.repeat(first[hot] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        at, gram = np.concatenate([at[~hot], own]), np.concatenate([gram[~hot], np.zeros(len(own), np.uint64)])
        least, most = (np.concatenate([x[~hot], np.zeros(len(own), np.int64)]) for x in (least, most))
    if not len(at):
        return
    owner = np.searchsorted(ends, at, "right")
    room = np.minimum(ends[owner] - at, SPAN - least)
    right = np.lib.stride_tricks.sliding_window_view(text, SPAN)[at + LEFT]
    right *= np.arange(SPAN, dtype=np.uint8) < room.astype(np.uint8)[:, None]
    left = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, LEFT)[at][:, ::-1])
    left *= np.arange(LEFT, dtype=np.uint8) < most.astype(np.uint8)[:, None]
    e = Entries(right, left, least.astype(np.uint8), most.astype(np.uint8), owner.astype(np.int32), at - starts[owner])
    del right, left
    order = sort_rows(e.right)
    e, gram = e.take(order), gram[order]
    prefixes = common_prefixes(e.right)
    group = same_whole(e, prefixes)
    smallest = np.full(len(e), NO_ID)
    np.minimum.at(smallest, group, ids[e.owner])
    repeat = ids[e.owner] > smallest[group]
    known = ranges(e.owner[repeat], (e.place - e.most)[repeat], (e.place - e.least)[repeat])
    e, gram = e.take(~repeat), gram[~repeat]
    part = ranges_of(e.right[:, :GRAM], splitters)
    if len(frequent):
        whole = gram == 0
        part[whole] = ranges_of(e.right[whole], splitters)
    by_part = np.argsort(part, kind="stable")  # the order of suffixes stays
    bounds = np.searchsorted(part[by_part], np.arange(parts + 1))
    of_known = known[0] % parts
    for p in np.union1d(part, of_known).tolist():
        which = by_part[bounds[p] : bounds[p + 1]]
        yield p, pack(e.take(which), tuple(x[of_known == p] for x in known), ids, hashes)


def ranges(owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows by owner, in order, joined where they touch: owner, first, last."""
    order = np.lexsort((first, owner))
    owner, first, last = owner[order].astype(np.int64), first[order], last[order]
    if not len(owner):
        return owner, first, last
    # Owners are kept apart by an offset larger than any place.
    apart = (int(last.max()) + 2) * np.cumsum(np.append(False, owner[1:] != owner[:-1]))
    reach = np.maximum.accumulate(last + apart)
    new = np.flatnonzero(np.append(True, (first + apart)[1:] > reach[:-1] + 1))
    return owner[new], first[new], reach[np.append(new[1:], len(owner)) - 1] - apart[new]


def pack(e: Entries, known: tuple[np.ndarray, ...], ids: np.ndarray, hashes: np.ndarray) -> bytes:
    """Columns of a run of sorted entries and known ranges of windows, each with the texts' ids and hashes."""
    used, number = np.unique(np.concatenate([e.owner, known[0]]), return_inverse=True)
    prefixes = common_prefixes(e.right)
    rest = e.right[np.arange(SPAN) >= prefixes[:, None]]
    left = e.left[np.arange(LEFT) < e.most[:, None]]
    n = len(e)
    columns = [
        ids[used].astype("<i8"), hashes[used].astype("<u8"), prefixes, rest, e.least, e.most, left,
        number[:n].astype("<u4"), _narrow(e.place), number[n:].astype("<u4"), known[1].astype("<i8"), known[2].astype("<i8"),
    ]
    head = np.array([len(c) for c in columns] + [columns[8].itemsize], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(c.tobytes() for c in columns))


def _narrow(x: np.ndarray) -> np.ndarray:
    """In 4 bytes each where that is enough."""
    return x.astype("<u4" if x.max(initial=0) < 1 << 32 else "<i8")


_KINDS = ("<i8", "<u8", "u1", "u1", "u1", "u1", "u1", "<u4", "<i8", "<u4", "<i8", "<i8")


def unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    *lengths, wide = np.frombuffer(raw, "<i8", len(_KINDS) + 1).tolist()
    at, out = 8 * len(_KINDS) + 8, []
    for i, (kind, n) in enumerate(zip(_KINDS, lengths, strict=True)):
        kind = "<u4" if i == 8 and wide == 4 else kind
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return tuple(out)


def front_decode(prefixes: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The rows that front-coding stands for: a byte is that of the last row that spells its column out."""
    n = len(prefixes)
    rows = np.zeros((n, SPAN), np.uint8)
    rows[np.arange(SPAN) >= prefixes[:, None]] = rest
    number = np.arange(n)
    for i in range(SPAN):
        spelt = prefixes <= i
        if not spelt.all():
            rows[:, i] = rows[np.maximum.accumulate(np.where(spelt, number, 0)), i]
    return rows


def merge(strings: list[list[bytes]], prefixes: list[list[int]]) -> tuple[list[int], list[int]]:
    """The runs' numbers in the order of their merged strings, and the common prefix of each with the one before.

    prefixes has each string's common prefix with the one before in its run. A loser's number is the common
    prefix with the string that beat it last, which is the last one that came out; so of two, the one with the
    longer prefix comes first, and only equal prefixes call for a look at the bytes, past the prefix.
    """
    total = sum(map(len, strings))
    end = b"\xff" * (SPAN + 1)
    leaves = 1
    while leaves < max(2, len(strings)):
        leaves *= 2
    now = [s[0] if s else end for s in strings] + [end] * (leaves - len(strings))
    shared = [0 if s else -1 for s in strings] + [-1] * (leaves - len(strings))
    at = [0] * leaves
    lengths = [len(s) for s in strings]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix is set."""
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = now[a][x:], now[b][x:]
        if s == t:
            shared[b] = x + len(t)
            return a, b
        n = x + len(s) - ((int.from_bytes(s) ^ int.from_bytes(t)).bit_length() + 7) // 8
        if s < t:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    losers, winners = [0] * leaves, [0] * (2 * leaves)
    winners[leaves:] = range(leaves)
    for node in range(leaves - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    a = winners[1]
    out, out_shared = [0] * total, [0] * total
    for i in range(total):
        out[i], out_shared[i] = a, shared[a]
        k = at[a] + 1
        at[a] = k
        if k < lengths[a]:
            mine = now[a] = strings[a][k]
            x = prefixes[a][k]
        else:
            mine, x = end, -1
            now[a] = end
        node = (a + leaves) >> 1
        while node:
            b = losers[node]
            y = shared[b]
            if x < y:
                shared[a], losers[node] = x, a
                a, x, mine = b, y, now[b]
            elif x == y and x >= 0:
                other = now[b]
                if mine[x : x + 1] != other[x : x + 1]:
                    if mine[x : x + 1] > other[x : x + 1]:
                        shared[a], losers[node] = x, a
                        a, mine = b, other
                else:
                    s, t = mine[x:], other[x:]
                    if s == t:
                        shared[b] = x + len(t)
                    else:
                        n = x + len(s) - ((int.from_bytes(s) ^ int.from_bytes(t)).bit_length() + 7) // 8
                        if s < t:
                            shared[b] = n
                        else:
                            shared[a], losers[node] = n, a
                            a, mine = b, other
            node >>= 1
        shared[a] = x
    return out, out_shared


def _window_hashes(e: Entries) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over right and left, from which the hash of any window of an entry is a sum of two."""
    up = np.cumprod(np.full(SPAN, _M))
    inverse = np.uint64(pow(int(_M), -1, 1 << 64))
    down = np.cumprod(np.full(LEFT, inverse))
    sums = lambda rows, weights: np.concatenate(
        [np.zeros((len(rows), 1), np.uint64), np.cumsum(_RANDOM[rows] * weights, axis=1, dtype=np.uint64)], axis=1
    )
    return sums(e.right, up), sums(e.left, down)


def window_bytes(e: Entries, which: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Rows of the SPAN bytes of windows: that of entry which with left bytes before the anchor."""
    offset = np.arange(SPAN) - left[:, None]
    return np.where(offset >= 0, e.right[which[:, None], np.maximum(offset, 0)], e.left[which[:, None], np.maximum(-offset - 1, 0)])


def settle(e: Entries, ids: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated ranges of windows (owner, first, last) among merged entries; ids are of owners."""
    if not len(e):
        return (np.empty(0, np.int64),) * 3
    mine = ids[e.owner]
    group = same_whole(e, shared)
    smallest = np.full(len(e), NO_ID)
    np.minimum.at(smallest, group, mine)
    repeat = mine > smallest[group]
    found = [(e.owner[repeat].astype(np.int64), (e.place - e.most)[repeat], (e.place - e.least)[repeat])]

    # One entry for each group goes on; its other members (of the same document) get what it gets.
    heads = np.flatnonzero(group == np.arange(len(e)))
    own = shared.astype(np.int64)
    between = np.minimum.reduceat(own, np.append(0, heads[:-1] + 1)) if len(heads) else own[:0]
    # between[i]: the common prefix of head i with head i - 1, over all that lies between them.
    between = np.array([0, *between[1:]], np.int64)[: len(heads)]
    reach = np.maximum(between, np.append(between[1:], 0))
    rep = e.take(heads)
    low = np.maximum(rep.least.astype(np.int64), SPAN - reach)
    n = np.maximum(rep.most.astype(np.int64) - low + 1, 0)
    some = np.flatnonzero(n)
    if len(some):
        rep, low, n, docs = rep.take(some), low[some], n[some], smallest[heads][some]
        which = np.repeat(np.arange(len(some)), n)
        left = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        rights, lefts = _window_hashes(rep)
        key = _mix(rights[which, SPAN - left] + lefts[which, left]) ^ _RANDOM[left]
        order = np.argsort(key, kind="stable")
        fresh = np.append(True, key[order][1:] != key[order][:-1])
        number = np.cumsum(fresh) - 1
        many = np.bincount(number)[number] > 1
        order, number = order[many], number[many]
        if len(order):
            first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            head = order[np.repeat(first, np.diff(np.append(first, len(order))))]
            true = np.ones(len(order), bool)
            for a in range(0, len(order), 1 << 16):
                own = a + np.flatnonzero(order[a : a + (1 << 16)] != head[a : a + (1 << 16)])
                x, y = order[own], head[own]
                true[own] = (window_bytes(rep, which[x], left[x]) == window_bytes(rep, which[y], left[y])).all(axis=1) & (left[x] == left[y])
            if not true.all():  # different windows of one hash: told apart by their bytes
                names: dict[tuple[int, bytes], int] = {}
                bad = np.isin(number, number[~true])
                rows = window_bytes(rep, which[order[bad]], left[order[bad]])
                number[bad] = [names.setdefault((int(r), w.tobytes()), len(names)) + number.max() + 1 for r, w in zip(left[order[bad]], rows, strict=True)]
            least = np.full(int(number.max()) + 1, NO_ID)
            np.minimum.at(least, number, docs[which[order]])
            hit = order[docs[which[order]] > least[number]]
            # Members of the head's group that are of its smallest document have the same windows.
            members = np.flatnonzero(~repeat)
            of = np.searchsorted(heads[some], group[members])
            of = np.where((of < len(some)) & (heads[some][np.minimum(of, len(some) - 1)] == group[members]), of, -1)
            members, of = members[of >= 0], of[of >= 0]
            by = np.argsort(of, kind="stable")
            members, of = members[by], of[by]
            begin, stop = np.searchsorted(of, which[hit]), np.searchsorted(of, which[hit], "right")
            times = stop - begin
            entry = members[np.repeat(begin - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]
            window = e.place[entry] - np.repeat(left[hit], times)
            found.append((e.owner[entry].astype(np.int64), window, window))
    return ranges(*(np.concatenate(x) for x in zip(*found, strict=True)))


def merge_runs(runs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Repeated ranges of windows in the runs of one range: doc_id, hash of the text, first, last."""
    ids, hashes, parts, known, strings, prefixes = [], [], [], [], [], []
    base = 0
    for raw in runs:
        of_ids, of_hashes, own, rest, least, most, left, owner, place, *more = unpack(raw)
        right = front_decode(own, rest)
        whole = right.tobytes()
        strings.append([whole[i : i + SPAN] for i in range(0, len(whole), SPAN)])
        prefixes.append(own.tolist())
        lefts = np.zeros((len(own), LEFT), np.uint8)
        lefts[np.arange(LEFT) < most[:, None]] = left
        parts.append(Entries(right, lefts, least, most, owner.astype(np.int64) + base, place.astype(np.int64)))
        known.append((more[0].astype(np.int64) + base, more[1], more[2]))
        ids.append(of_ids)
        hashes.append(of_hashes)
        base += len(of_ids)
    order, shared = merge(strings, prefixes)
    del strings, prefixes
    order = np.array(order, np.int64)
    # The nth time a run comes out it is with its nth entry.
    offset = np.cumsum([0, *(len(p) for p in parts[:-1])])
    by_run = np.argsort(order, kind="stable")
    place = np.empty(len(order), np.int64)
    counts = np.bincount(order, minlength=len(parts)) if len(order) else np.zeros(len(parts), np.int64)
    place[by_run] = np.concatenate([np.arange(c) + o for c, o in zip(counts, offset, strict=True)]) if len(order) else place
    merged = Entries(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("right", "left", "least", "most", "owner", "place")))
    del parts
    merged = merged.take(place)
    all_ids, all_hashes = np.concatenate(ids), np.concatenate(hashes)
    found = settle(merged, all_ids, np.array(shared, np.uint8))
    owner, first, last = ranges(*(np.concatenate(x) for x in zip(found, *known, strict=True)))
    return all_ids[owner], all_hashes[owner], first, last


def bucket_of(ids: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The same as BUCKET in SQL: rows without a doc_id, or with one of many, are told apart by their texts."""
    x = ids.astype(np.uint64) ^ hashes.astype(np.uint64)
    x = (x ^ (x >> np.uint64(15)) ^ (x >> np.uint64(31))).astype(np.int64)
    return np.mod(x, buckets)


BUCKET = "cast(pmod({x} ^ shiftrightunsigned({x}, 15) ^ shiftrightunsigned({x}, 31), {n}L) as int)"


def _map_runs(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, splitters: np.ndarray, chunk: int) -> Iterator[pa.RecordBatch]:
    texts: list[bytes] = []
    ids: list[int] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for part, run in chunk_runs(texts, np.array(ids, np.int64), frequent, splitters):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([run], pa.binary())], names=["part", "run"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or b""
            texts.append(text)
            ids.append(NO_ID if doc_id is None else doc_id)
            size += len(text)
            if size >= chunk:
                yield from flush()
                texts, ids, size = [], [], 0
    if texts:
        yield from flush()


def _reduce_runs(table: pa.Table, buckets: int) -> pa.Table:
    ids, hashes, first, last = merge_runs(table.column("run").to_pylist())
    bucket = bucket_of(ids, hashes, buckets)
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))[: len(order)]
    rows = []
    for a, z in zip(bounds, np.append(bounds[1:], len(order))[: len(bounds)], strict=True):
        w = order[a:z]
        rows.append(zstandard.compress(b"".join(x[w].astype(k).tobytes() for x, k in ((ids, "<i8"), (hashes, "<u8"), (first, "<i8"), (last, "<i8"))), 1))
    return pa.table({"bucket": pa.array(bucket[order][bounds], pa.int32()), "found": pa.array(rows, pa.binary())})


def _cut(text: bytes, first: np.ndarray, last: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes and runs that go, and what stays, for ranges of windows in any order."""
    _, a, z = ranges(np.zeros(len(first), np.int64), first, last + SPAN - 1)
    if not len(a):
        return 0, 0, text
    keep = zip([0, *(z + 1).tolist()], [*a.tolist(), len(text)], strict=True)
    return int((z - a + 1).sum()), len(a), b"".join(text[x:y] for x, y in keep)


def _apply(docs: pa.Table, found: pa.Table) -> pa.Table:
    parts: list[tuple[np.ndarray, ...]] = []
    for raw in found.column("found").to_pylist():
        raw = zstandard.decompress(raw)
        n = len(raw) // 32
        parts.append(tuple(np.frombuffer(raw, k, n, at * n) for k, at in (("<i8", 0), ("<u8", 8), ("<i8", 16), ("<i8", 24))))
    ids, hashes, first, last = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 4
    order = np.lexsort((hashes, ids))
    ids, hashes, first, last = ids[order], hashes[order], first[order], last[order]
    rows = []
    for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text"), strict=True):
        text = text.as_py() or b""
        own = NO_ID if doc_id is None else doc_id
        a, z = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
        if z > a:
            h = np.uint64(text_hash(text))
            a, z = a + np.searchsorted(hashes[a:z], h), a + np.searchsorted(hashes[a:z], h, "right")
        removed, spans, kept = _cut(text, first[a:z], last[a:z])
        rows.append((doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def plan_ranges(rows: DataFrame, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Splitters of the order of suffixes, and grams too frequent for one range, both from a sample.

    There are as many as ranges, and at most eight times as many. What the sample misses costs time and never changes
    the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            size = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(size)
            whole = b"".join([*texts, bytes(SPAN)])
            _, _, at, gram = anchors(np.frombuffer(whole, np.uint8)[: len(whole) - SPAN], ends - size, ends)
            found, n = np.unique(gram, return_counts=True)
            some = [whole[i : i + SPAN] for i in at[_mix(at.astype(np.uint64)) % np.uint64(THIN) == 0].tolist()]
            columns = [
                pa.array([None, *found.astype(np.int64).tolist(), *[None] * len(some)], pa.int64()),
                pa.array([int(size.sum()), *n.tolist(), *[None] * len(some)], pa.int64()),
                pa.array([None] * (1 + len(found)) + some, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "n", "suffix"])

    picked = rows.filter(F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(SAMPLE)) == 0)
    sample = materialize(picked.mapInArrow(run, "gram long, n long, suffix binary"), "suffix-sample")
    sums = sample.filter("n is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "gram-sample")
    total = SAMPLE * (sums.filter("gram is null").agg(F.sum("n")).first()[0] or 0)
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-total // share)) | 1
    often = max(16, share // 20 // 8 // SAMPLE)  # an eighth of a range's entries
    hot = sums.filter(F.col("gram").isNotNull() & (F.col("n") >= often)).select("gram").collect()
    dealt = sample.filter("suffix is not null").select("suffix").repartitionByRange(parts, "suffix")
    bounds = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min("suffix").alias("least")).orderBy("least").collect()
    discard(sample, sums)
    splitters = np.unique(np.array([bytes(r["least"]) for r in bounds[1:]], f"S{SPAN}"))
    return splitters, np.array([r["gram"] for r in hot], np.int64).astype(np.uint64)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK, share: int = SHARE) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that stay."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    with freed(spark):
        splitters, frequent = plan_ranges(rows, share)
    parts = len(splitters) + 1
    buckets = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))) | 1

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _map_runs(batches, frequent, splitters, chunk)

    def reduce(table: pa.Table) -> pa.Table:
        return _reduce_runs(table, buckets)

    sent = rows.mapInArrow(runs, "part int, run binary")
    with freed(spark):
        found = materialize(sent.groupBy("part").applyInArrow(reduce, "bucket int, found binary"), "repeats")
    name = rows.withColumn("x", F.expr(f"coalesce(doc_id, {NO_ID}L) ^ xxhash64(coalesce(text, cast('' as binary)))"))
    named = name.select("doc_id", "text", F.expr(BUCKET.format(x="x", n=buckets)).alias("bucket"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return named.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_apply, schema)


def measured(docs: DataFrame) -> DataFrame:
    """dedup() without the bytes."""
    return dedup(docs).drop("kept")
