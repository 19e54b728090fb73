"""Token ids in files of canonical, length-limited Huffman codes.

Texts are encoded with the tokenizers library, an end id is appended to each, and the ids are counted
over all documents in the same pass, a row of partial counts a task. The code lengths (package-merge, at most ``LIMIT`` bits) are made on the driver
from one number per id of the vocabulary. Documents are dealt out by ranges of doc_id; each task
writes one file, and files in order of their number hold the documents in ascending order.

A file has a header and segments (all numbers little-endian):

* header: ``HTOK``, u32 version 1, u32 size of the vocabulary, u32 bytes of code lengths, the zlib'd
  code lengths (u8 an id, 0: not in use).
* segment: ``SEGM``, u32 documents, u32 ids, u32 blocks, u32 ids a block, u64 bytes of payload; per
  document i64 doc_id, u32 ids, u8 flags (1: no doc_id, 2: goes on in the next segment); per block
  u64 the bit where it starts; the payload, most significant bit first.

Each block is decoded on its own from its bit offset, by a table of all ``LIMIT``-bit prefixes.

Defined cases: a null text is an empty one and has the end id only; a null doc_id sorts last; rows of
equal doc_id are in the order of a hash of their ids, then of the ids; a document of any length goes over as many segments as it
takes; an empty table gives an empty result and no file; extra columns are left out.
"""

from __future__ import annotations

import itertools
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.llm.bpe import Numbered, Ragged, blocks
from beaconlake.llm.common import discard, make_dir, materialize, open_shared, scratch, ship

END_ID = 2
LIMIT = 16
BLOCK = 1024
#: Ids of a segment at most; a task holds one segment in memory.
SEGMENT = 1 << 20
MOST_UNITS = 700_000
_HEAD, _SEGMENT = "<4sIII", "<4sIIIIQ"


class WordCoder:
    """The tokenizers library, asked once for each word that a worker remembers.

    Texts are cut at white space, which no word of this vocabulary holds, after what the tokenizer's
    normaliser does; the units go through its pattern, and each word through its own model. Texts that
    hold the content of an added token go to the library whole, and so do those with a code point that is
    unassigned for ``unicodedata``: the Unicode tables of ``regex`` may be newer than the library's.
    """

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        with open(path) as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.normalise = self.tokenizer.normalizer.normalize_str
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized for t in added):
            raise ValueError("added tokens that are sought in normalised text are not told by their content")
        self.added = [t.content for t in added]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.size = self.tokenizer.get_vocab_size()
        self.settled: set[str] = set()
        self.letters = self._byte_letters()
        self.forget()

    @staticmethod
    def _byte_letters() -> dict[int, int]:
        """The printable letter for each byte: itself, or the next free one from 256 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}

    def forget(self) -> None:
        self.ids, self.fresh = Ragged(), []
        self.words: dict[str, list[int]] = {}
        self.units = Numbered(self.fresh, 0)

    def _normal(self, text: str) -> str:
        """The text as the normaliser leaves it, with spaces wherever no word of the pattern can cross.

        Where full stops and commas stand beside no other symbol, they are words of their own.
        """
        signs = set(text)
        if signs & _OWN_CASE or not unicodedata.is_normalized("NFC", text):
            text = self.normalise(text)
            signs = set(text)
        else:
            text = text.lower()
        if "\n" in signs:
            text = text.replace("\n", " ")
        if signs & _STOPS and not any(x in text for x in _STOPS_ROW) and all(c.isalnum() or c in " \n.," for c in signs):
            text = text.replace(".", " . ").replace(",", " , ")
        return text

    def _newer(self, text: str) -> bool:
        """Whether a text has a code point that the library's tables and ours may tell apart differently."""
        for c in set(text) - self.settled:
            if unicodedata.category(c) == "Cn":
                return True
            self.settled.add(c)
        return False

    def _word(self, word: str) -> list[int]:
        shown = word if word.isascii() else word.encode().decode("latin-1")
        self.words[word] = ids = [t.id for t in self.model.tokenize(shown.translate(self.letters))]
        return ids

    def _ids(self, unit: str) -> list[int]:
        if unit.isalpha():
            return self.words.get(unit) or self._word(unit)
        known, out = self.words, []
        for word in self.pattern.findall(self.normalise(unit)):
            out += known.get(word) or self._word(word)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has. Units are told apart by Arrow; Python sees each
        one once a call."""
        if self.ids.n > MOST_UNITS:
            self.forget()
        whole = {i: t for i, t in enumerate(texts) if any(x in t for x in self.added) or not t.isascii() and self._newer(t)}
        if whole:
            texts = ["" if i in whole else t for i, t in enumerate(texts)]
        parts = pc.split_pattern(pa.array(map(self._normal, texts), pa.large_string()), " ")
        units = parts.values.dictionary_encode()
        known = np.fromiter(map(self.units.__getitem__, units.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(units.dictionary))
        new = [self._ids(u) for u in self.fresh]
        self.fresh.clear()
        self.ids.add(np.fromiter(itertools.chain.from_iterable(new), np.int32), np.fromiter(map(len, new), np.int64, len(new)))
        flat, ends = known[units.indices.to_numpy()], parts.offsets.to_numpy()
        ids, length = self.ids.get(flat)
        counts = np.diff(np.concatenate([[0], np.cumsum(length)])[ends])
        if whole:
            each = np.split(ids, np.cumsum(counts)[:-1])
            for i, t in whole.items():
                each[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32)
            ids, counts = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return ids, counts


#: Letters whose small form hangs on what stands around them, or takes more than one sign.
_OWN_CASE = frozenset("\u03a3\u0130")
_STOPS = frozenset(".,")
_STOPS_ROW = ("..", ".,", ",.", ",,")

_coders: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders.clear()
        _coders[path] = WordCoder(path)
    return _coders[path]


def token_table(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Per row: doc_id and ids, packed as little-endian numbers of the least size that holds the vocabulary. Further rows,
    one a task, have no ids but used and n: the ids that the task wrote, and how often each."""
    ship(docs.sparkSession)
    names = ["doc_id", "ids", "used", "n"]
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        size = max(own.size, end_id + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        sums = np.zeros(size, np.int64)
        for part in blocks(batches):
            ids, counts = own.encode([t or "" for t in part.column("text").to_pylist()])
            flat = np.insert(ids.astype(kind), np.cumsum(counts), end_id)
            counts += 1
            sums += np.bincount(flat, minlength=size)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]) * flat.itemsize, pa.int64())
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, ends.buffers()[1], pa.py_buffer(flat)])
            none = pa.nulls(len(counts), longs)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed.cast(pa.binary()), none, none], names=names)
        used = np.nonzero(sums)[0]
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([used], longs), pa.array([sums[used]], longs)], names=names
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, used array<long>, n array<long>")


def counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents."""
    each = tokens.filter("used is not null").select(F.explode(F.arrays_zip("used", "n")).alias("x"))
    sums = np.zeros(size, np.int64)
    for row in each.groupBy("x.used").agg(F.sum("x.n").alias("n")).collect():
        sums[row["used"]] = row["n"]  # one row an id of the vocabulary at most
    return sums


def code_lengths(freq: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most limit bits, by package-merge; 0 for ids that do not occur."""
    out = np.zeros(len(freq), np.uint8)
    used = np.nonzero(freq)[0]
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    used = used[np.argsort(freq[used], kind="stable")]
    coins = freq[used].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        every = np.concatenate([coins, packages])
        order = np.argsort(every, kind="stable")
        levels.append(order < len(coins))
        every = every[order]
        packages = every[: len(every) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, length = 2 * len(coins) - 2, np.zeros(len(coins), np.int64)
    for own in reversed(levels):
        n = int(own[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[used] = length
    return out


class Code:
    """Canonical codes: shorter first, then by id."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths
        used = np.nonzero(lengths)[0]
        order = used[np.lexsort((used, lengths[used]))]
        self.most = max(1, int(lengths.max(initial=1)))
        span = 1 << (self.most - lengths[order].astype(np.int64))
        start = np.cumsum(span) - span
        self.code = np.zeros(len(lengths), np.uint64)
        self.code[order] = (start >> (self.most - lengths[order].astype(np.int64))).astype(np.uint64)
        full = 1 << self.most
        self.symbol = np.zeros(full, np.uint32)
        self.step = np.ones(full, np.int64)
        self.symbol[: int(span.sum())] = np.repeat(order, span)
        self.step[: int(span.sum())] = np.repeat(lengths[order], span)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offsets of the blocks, and the payload."""
        length = self.lengths[ids].astype(np.int64)
        end = np.cumsum(length)
        at = end - length
        word = at >> 5
        bits = self.code[ids] << (64 - (at & 31) - length).astype(np.uint64)
        n = int(end[-1] >> 5) + 2 if len(ids) else 0
        # Codes share no bit, so sums of what falls into a 32-bit word are exact in a double.
        sums = np.bincount(word, (bits >> np.uint64(32)).astype(np.float64), n)
        sums += np.bincount(word + 1, (bits & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        return at[::BLOCK], sums.astype(np.uint64).astype(">u4").tobytes()

    def decode(self, payload: bytes, offsets: np.ndarray, n: int, block: int) -> np.ndarray:
        """All blocks at once, a symbol of each at a time."""
        raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at, last = offsets.astype(np.int64), len(window) - 1
        out = np.empty((block, len(at)), np.uint32)
        shift = np.uint32(32 - self.most)
        for i in range(min(block, n)):
            prefix = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> shift
            out[i] = self.symbol[prefix]
            at = at + self.step[prefix]
        return out.T.reshape(-1)[:n] if n >= block else out[:n, 0]


def _write_segment(file: BinaryIO, code: Code, docs: list[tuple[int | None, int, bool]], ids: np.ndarray) -> None:
    offsets, payload = code.encode(ids)
    file.write(struct.pack(_SEGMENT, b"SEGM", len(docs), len(ids), len(offsets), BLOCK, len(payload)))
    file.write(np.array([d or 0 for d, _, _ in docs], "<i8").tobytes())
    file.write(np.array([n for _, n, _ in docs], "<u4").tobytes())
    file.write(np.array([(d is None) + 2 * more for d, _, more in docs], np.uint8).tobytes())
    file.write(offsets.astype("<u8").tobytes())
    file.write(payload)


def read_segments(file: BinaryIO) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per segment: doc_ids, ids a document, flags, all ids."""
    magic, version, size, n = struct.unpack(_HEAD, file.read(struct.calcsize(_HEAD)))
    if magic != b"HTOK" or version != 1:
        raise ValueError("not a file of Huffman-coded ids")
    code = Code(np.frombuffer(zlib.decompress(file.read(n)), np.uint8)[:size])
    while head := file.read(struct.calcsize(_SEGMENT)):
        magic, docs, ids, n_blocks, block, n_payload = struct.unpack(_SEGMENT, head)
        if magic != b"SEGM":
            raise ValueError("a segment is damaged")
        doc_ids, each = np.frombuffer(file.read(8 * docs), "<i8"), np.frombuffer(file.read(4 * docs), "<u4")
        flags, offsets = np.frombuffer(file.read(docs), np.uint8), np.frombuffer(file.read(8 * n_blocks), "<u8")
        yield doc_ids, each, flags, code.decode(file.read(n_payload), offsets, ids, block)


def write(tokens: DataFrame, folder: str, kind: str, size: int) -> DataFrame:
    """Writes the files and returns one row a file: part, path, n_docs, n_ids, n_bytes.

    A file has a name of its own, and only those in the manifest count: what a lost or repeated task
    leaves behind is never read.
    """
    spark = tokens.sparkSession
    make_dir(spark, folder)
    lengths = spark.sparkContext.broadcast(code_lengths(counts(tokens, size)))  # a byte an id of the vocabulary
    tokens = tokens.filter("ids is not null").select("doc_id", "ids")
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("ids")]
    dealt = tokens.repartitionByRange(*order).sortWithinPartitions(*order[:2], "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, code = f"{folder}/{part:06d}-{uuid.uuid4().hex}.htok", Code(lengths.value)
        file, docs, ids, held, n_docs, n_ids = None, [], [], 0, 0, 0

        def flush() -> None:
            _write_segment(file, code, docs, np.concatenate(ids))
            docs.clear(), ids.clear()

        for batch in batches:
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if file is None:
                    file = open_shared(path, "wb")
                    book = zlib.compress(lengths.value.tobytes())
                    file.write(struct.pack(_HEAD, b"HTOK", 1, size, len(book)) + book)
                own = np.frombuffer(packed.as_buffer(), kind)
                n_docs, n_ids = n_docs + 1, n_ids + len(own)
                while held + len(own) > SEGMENT:
                    room = SEGMENT - held
                    docs.append((doc_id, room, True))
                    ids.append(own[:room].astype(np.int64))
                    own, held = own[room:], 0
                    flush()
                docs.append((doc_id, len(own), False))
                ids.append(own.astype(np.int64))
                held += len(own)
        if file is not None:
            flush()
            n_bytes = file.tell()
            file.close()
            row = {"part": [part], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [n_bytes]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("n_docs", "n_ids", "n_bytes"))]))

    return materialize(dealt.mapInArrow(run, "part int, path string, n_docs long, n_ids long, n_bytes long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = max(1, manifest.count())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("offset"))  # a row a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), strict=True):
                at, begin, crc = 0, 0, 0
                with open_shared(path, "rb") as file:
                    for doc_ids, each, flags, ids in read_segments(file):
                        raw, rows, place = memoryview(ids.astype("<u4").tobytes()), [], 0
                        for doc_id, n, flag in zip(doc_ids.tolist(), each.tolist(), flags.tolist(), strict=True):
                            crc = zlib.crc32(raw[4 * place : 4 * (place + n)], crc)
                            place, at = place + n, at + n
                            if not flag & 2:
                                rows.append((None if flag & 1 else doc_id, begin, at - begin, crc))
                                begin, crc = at, 0
                        columns = list(zip(*rows, strict=True)) or [[]] * 4
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part] * len(rows), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)],
                            names=["part", "doc_id", "local", "n_tokens", "ids_crc32"],
                        )

    spread = manifest.select("part", "path").repartitionByRange(files, "part")
    rows = spread.mapInArrow(run, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "part").select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Encodes, writes and reads back."""
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    tokens = materialize(token_table(docs, path, text, doc_id, end_id), "tokens")
    manifest = write(tokens, scratch(docs.sparkSession, "token-files"), kind, size)
    discard(tokens)
    return read(manifest)
