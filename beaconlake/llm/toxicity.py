"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of a vector of the word itself (for words of the training sample) and the
mean vector of its character 3- to 5-grams, hashed into buckets, so unseen words of a known kind are
scored too. Two GRUs read each window in both directions; attention weighs their states, and a
logistic unit scores the pooled state. Windows of ``WINDOW`` words start every ``STRIDE`` words and
cover the whole text; a document's score is that of its highest window, as in training, so a toxic passage
counts alike in a text of any length. The more windows a clean text has, the more chances of a false hit.

Training takes a bounded sample of labelled rows: at most ``MOST_DOCS`` documents of each label, in
order of a seeded hash, and at most ``MOST_WINDOWS`` windows of each (texts of up to some 1,000 words whole), drawn
on the executors. Of a toxic document, the highest window learns; of a clean one, all do. Gradients are worked out by
hand. One document in ``SPARE`` is not learnt from: with these the logits are shifted so that at the threshold the
share of toxic documents found, less ``ALARM`` times the share of clean ones above it, is greatest; the fewer toxic
documents there are to tell by, the less they are shifted.

Labels are learnt only from rows whose crc32(doc_id) modulo 3 is not 1. Language, source, doc_id and
labels are no inputs of a score.

Defined cases: null, empty and wordless texts are one window of no words and get the score of the
network's bias; a doc_id without a label is scored like any other; a doc_id with several labels is toxic if
one of them says so; without labels of both kinds every score is the rate of toxic labels (0 without
any); repeated rows give repeated rows; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.bpe import blocks
from beaconlake.llm.common import ship

WINDOW, STRIDE = 32, 16
DIM, HIDDEN, POOL = 16, 8, 8
BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
MOST_DOCS, MOST_WINDOWS = 2500, 64
STEPS, BATCH_DOCS, DOC_WINDOWS = 800, 48, 6
SEED = 7
THRESHOLD = 0.7
#: One document in so many of the sample is for the threshold; and how much worse a false alarm is than a miss.
SPARE, ALARM = 5, 3.0
#: With so many toxic documents to tell the shift by, half of it is believed.
FEW = 8
#: Words whose inputs a worker remembers; windows that are scored at once.
MOST_WORDS, BATCH = 400_000, 4096

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def clean(text: str | None) -> bytes:
    """Lower case, with a space for each ASCII sign that is no letter or digit."""
    text = text or ""
    return (text if text.isascii() else text.lower()).encode("utf-8", "replace").translate(_KEEP)


def starts(n: int) -> range:
    """Where the windows of n words start; the last one reaches the end."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def gram_index(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of <word>, word by word, and how many each has. Bytes are the characters."""
    size = np.array([len(w) + 2 for w in words], np.int64)
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(flat))
    owner = np.repeat(np.arange(len(words)), size)
    index, owners = [], []
    for n in GRAMS:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ flat[k : len(flat) - n + 1 + k]) * np.uint64(0x100000001B3)
        here = left[: len(h)] >= n
        index.append(((h ^ (h >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)[here])
        owners.append(owner[: len(h)][here])
    index, owners = np.concatenate([np.empty(0, np.int64), *index]), np.concatenate([np.empty(0, np.int64), *owners])
    order = np.argsort(owners, kind="stable")
    return index[order], np.bincount(owners, minlength=len(words))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, counts[i] of them for row i."""
    out = np.zeros((len(counts), values.shape[1]), np.float32)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out


def _add_rows(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices, and the sums of the rows of each."""
    order = np.argsort(index, kind="stable")
    found, first = np.unique(index[order], return_index=True)
    return found, np.add.reduceat(values[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name, and the network's passes over (time, batch) arrays of word numbers; 0 is no word."""

    def __init__(self, vocabulary: list[bytes], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.words = {w: i for i, w in enumerate(vocabulary, 1)}
        self.shift = 0.0
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {
            "word": np.zeros((len(vocabulary) + 1, DIM), np.float32),
            "gram": rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32),
            **{f"in_{d}": draw(DIM, 3 * HIDDEN) for d in "fb"},
            **{f"bias_{d}": np.zeros(3 * HIDDEN, np.float32) for d in "fb"},
            **{f"zr_{d}": draw(HIDDEN, 2 * HIDDEN) for d in "fb"},
            **{f"c_{d}": draw(HIDDEN, HIDDEN) for d in "fb"},
            "pool": draw(2 * HIDDEN, POOL), "pool_bias": np.zeros(POOL, np.float32), "look": draw(POOL, 1)[:, 0],
            "out": draw(2 * HIDDEN, 1)[:, 0], "out_bias": np.zeros(1, np.float32),
        }

    def inputs(self, own: np.ndarray, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Vectors of words: own are rows of word, index and counts their n-grams."""
        return self.p["word"][own] + _sums(self.p["gram"][index], counts) / np.maximum(counts, 1)[:, None]

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """What words put into the gates of both directions, with a row of zeros for no word in front."""
        rows = np.concatenate([vectors @ self.p[f"in_{d}"] + self.p[f"bias_{d}"] for d in "fb"], axis=1)
        return np.concatenate([np.zeros((1, 6 * HIDDEN), np.float32), rows]).astype(np.float32)

    def forward(self, gates: np.ndarray, words: np.ndarray, keep: bool = False):
        """Logits of windows; words is (time, batch). With keep, also what backward() needs."""
        time, batch = words.shape
        mask = (words > 0)[:, :, None]
        states = np.zeros((time, batch, 2 * HIDDEN), np.float32)
        held = {d: [] for d in "fb"}
        for d, at, order in (("f", 0, range(time)), ("b", HIDDEN, range(time - 1, -1, -1))):
            h = np.zeros((batch, HIDDEN), np.float32)
            zr_u, c_u, side = self.p[f"zr_{d}"], self.p[f"c_{d}"], slice(3 * at, 3 * at + 3 * HIDDEN)
            table = np.ascontiguousarray(gates[:, side])
            for t in order:
                g = table[words[t]]
                zr = g[:, : 2 * HIDDEN] + h @ zr_u
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ c_u)
                new = np.where(mask[t], h + z * (c - h), h)
                if keep:
                    held[d].append((t, h, z, r, c))
                h = new
                states[t, :, at : at + HIDDEN] = h
        look = np.tanh(states @ self.p["pool"] + self.p["pool_bias"])
        score = np.where(mask[:, :, 0], look @ self.p["look"], -1e9)
        weight = np.exp(score - score.max(axis=0)) * mask[:, :, 0]
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        logits = pooled @ self.p["out"] + self.p["out_bias"]
        return (logits, (mask, states, held, look, weight, pooled)) if keep else logits

    def backward(self, words: np.ndarray, kept, d_logits: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters but those of inputs, and of the gate rows at each word (time, batch, 6 HIDDEN)."""
        mask, states, held, look, weight, pooled = kept
        p, grad = self.p, {}
        grad["out"], grad["out_bias"] = pooled.T @ d_logits, d_logits.sum(keepdims=True)
        d_pooled = d_logits[:, None] * p["out"]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["look"] = np.einsum("tb,tbk->k", d_score, look)
        d_look = d_score[:, :, None] * p["look"] * (1 - look * look)
        grad["pool"] = np.einsum("tbh,tbk->hk", states, d_look)
        grad["pool_bias"] = d_look.sum(axis=(0, 1))
        d_states = weight[:, :, None] * d_pooled + d_look @ p["pool"].T
        d_gates = np.zeros((*words.shape, 6 * HIDDEN), np.float32)
        for d, at in (("f", 0), ("b", HIDDEN)):
            zr_u, c_u = p[f"zr_{d}"], p[f"c_{d}"]
            grad[f"zr_{d}"], grad[f"c_{d}"] = np.zeros_like(zr_u), np.zeros_like(c_u)
            carry = np.zeros((words.shape[1], HIDDEN), np.float32)
            for t, h, z, r, c in reversed(held[d]):
                dh = carry + d_states[t, :, at : at + HIDDEN]
                on = dh * mask[t]
                carry = dh - on * z
                d_c = on * z * (1 - c * c)
                d_rh = d_c @ c_u.T
                carry += d_rh * r
                d_zr = np.concatenate([on * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
                carry += d_zr @ zr_u.T
                grad[f"zr_{d}"] += h.T @ d_zr
                grad[f"c_{d}"] += (r * h).T @ d_c
                d_gates[t, :, 3 * at : 3 * at + 3 * HIDDEN] = np.concatenate([d_zr, d_c], axis=1)
        return grad, d_gates


def threshold_shift(clean: np.ndarray, toxic: np.ndarray) -> float:
    """What to take from logits so that THRESHOLD parts clean documents from toxic ones, by their highest windows."""
    if not len(clean) or not len(toxic):
        return 0.0
    every = np.unique(np.concatenate([clean, toxic]))
    between = np.concatenate([every[:1] - 1, (every[1:] + every[:-1]) / 2, every[-1:] + 1])
    found = 1 - np.searchsorted(np.sort(toxic), between) / len(toxic)
    alarms = 1 - np.searchsorted(np.sort(clean), between) / len(clean)
    worth = found - ALARM * alarms
    best = between[worth >= worth.max() - 1e-9]
    shift = float(best[len(best) // 2] - np.log(THRESHOLD / (1 - THRESHOLD)))
    return shift * len(toxic) / (len(toxic) + FEW)


def fit(windows: list[tuple[list[list[bytes]], int]], seed: int = SEED, steps: int = STEPS) -> Network | float:
    """The network, from (windows of words, label) per document; the rate of label 1 if only one label is there."""
    spare = [x for i, x in enumerate(windows) if i % SPARE == 0]
    rest = [x for i, x in enumerate(windows) if i % SPARE]
    if len({y for _, y in rest}) < 2:
        spare, rest = [], windows
    net = _fit(rest, seed, steps)
    if isinstance(net, Network) and spare:
        own = Scorer(net)
        logits = [own.logits([b" ".join(w) for w in ws] or [b""]) for ws, _ in spare]
        highest = np.array([x.max() for x in logits])
        labels = np.array([y for _, y in spare])
        net.shift = threshold_shift(highest[labels == 0], highest[labels == 1])
    return net


def _fit(windows: list[tuple[list[list[bytes]], int]], seed: int, steps: int) -> Network | float:
    labels = np.array([y for _, y in windows], np.int64)
    if len(set(labels.tolist())) < 2:
        return float(labels.mean()) if len(labels) else 0.0
    rng = np.random.default_rng(seed)
    seen: dict[bytes, int] = {}
    for ws, _ in windows:
        for w in {w for x in ws for w in x}:
            seen[w] = seen.get(w, 0) + 1
    net = Network(sorted(w for w, n in seen.items() if n > 1), seed)
    every = sorted(seen)
    number = {w: i for i, w in enumerate(every, 1)}
    own = np.array([net.words.get(w, 0) for w in every], np.int64)
    index, counts = gram_index(every)
    first = np.cumsum(counts) - counts
    docs = []
    for ws, _ in windows:
        rows = np.zeros((max(1, len(ws)), WINDOW), np.int64)
        for i, x in enumerate(ws):
            rows[i, : len(x)] = [number[w] for w in x]
        docs.append(rows)
    sides = [np.nonzero(labels == y)[0] for y in (0, 1)]
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    steps = min(steps, max(150, 30 * len(docs) // BATCH_DOCS))
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(s, BATCH_DOCS // 2) for s in sides])
        picks = [docs[i][rng.permutation(len(docs[i]))[:DOC_WINDOWS]] for i in chosen]
        each = np.array([len(x) for x in picks])
        batch = np.concatenate(picks).T
        used, flat = np.unique(batch, return_inverse=True)
        words = flat.reshape(batch.shape) + (used[0] > 0)
        used = used[used > 0]
        n = counts[used - 1]
        grams = index[np.repeat(first[used - 1] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        of = own[used - 1] * (rng.random(len(used)) > 0.3)  # now and then a word is known by its characters alone
        vectors = net.inputs(of, grams, n)
        logits, kept = net.forward(net.gates(vectors), words, keep=True)
        prob = _sigmoid(logits)
        d_logits = np.zeros_like(logits)
        at = 0
        for doc, k in zip(chosen, each, strict=True):
            if labels[doc]:
                top = at + int(np.argmax(logits[at : at + k]))
                d_logits[top] = prob[top] - 1
            else:
                d_logits[at : at + k] = prob[at : at + k] / np.sqrt(k)
            at += k
        d_logits /= BATCH_DOCS
        grad, d_gates = net.backward(words, kept, d_logits)
        found, rows = _add_rows(words.reshape(-1), d_gates.reshape(-1, 6 * HIDDEN))
        rows = rows[int(found[0] == 0) :]
        d_vectors = np.zeros_like(vectors)
        for d, a in (("f", 0), ("b", 3 * HIDDEN)):
            part = rows[:, a : a + 3 * HIDDEN]
            grad[f"in_{d}"], grad[f"bias_{d}"] = vectors.T @ part, part.sum(axis=0)
            d_vectors += part @ net.p[f"in_{d}"].T
        touched = {k: slice(None) for k in grad}
        touched["gram"], grad["gram"] = _add_rows(grams, np.repeat(d_vectors / np.maximum(n, 1)[:, None], n, axis=0))
        if of.any():
            touched["word"], grad["word"] = _add_rows(of[of > 0], d_vectors[of > 0])
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():  # of the tables, only the rows that were touched move
            (m, v), at = state[k], touched[k]
            m[at] += 0.1 * (g - m[at])
            v[at] += 0.01 * (g * g - v[at])
            move = (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)
            net.p[k][at] -= (rate * (move + (0.01 * net.p[k][at] if k in ("word", "gram") else 0))).astype(np.float32)
    return net


class Scorer:
    def __init__(self, net: Network) -> None:
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.gates, self.n = np.zeros((1 << 15, 6 * HIDDEN), np.float32), 1

    def _learn(self, words: list[bytes]) -> None:
        new = [w for w in words if w and w not in self.known]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            own = np.array([self.net.words.get(w, 0) for w in part], np.int64)
            rows = self.net.gates(self.net.inputs(own, *gram_index(part)))[1:]
            while self.n + len(part) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
            self.gates[self.n : self.n + len(part)] = rows
            self.known.update(zip(part, range(self.n, self.n + len(part)), strict=True))
            self.n += len(part)

    def logits(self, cleaned: list[bytes]) -> np.ndarray:
        """Per cleaned text, the logit of its highest window."""
        if self.n > MOST_WORDS:
            self.forget()
        parts = pc.split_pattern(pa.array(cleaned, pa.large_binary()), b" ")
        units = parts.values.dictionary_encode()
        words = units.dictionary.to_pylist()
        self._learn(words)
        number = np.array([self.known[w] if w else 0 for w in words], np.int64)
        flat = number[units.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        real = flat > 0
        upto = np.concatenate([[0], np.cumsum(real)])[parts.offsets.to_numpy()]
        flat = np.concatenate([flat[real], np.zeros(WINDOW, np.int64)])
        begin, n = upto[:-1], np.diff(upto)
        many = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))  # as starts() has them
        doc = np.repeat(np.arange(len(cleaned)), many)
        own = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
        logits = np.empty(len(doc), np.float32)
        steps = np.arange(WINDOW)[:, None]
        for at in range(0, len(doc), BATCH):
            d, o = doc[at : at + BATCH], own[at : at + BATCH]
            place = np.minimum(begin[d] + o + steps, len(flat) - 1)
            logits[at : at + BATCH] = self.net.forward(self.gates, np.where(o + steps < n[d], flat[place], 0))
        return np.maximum.reduceat(logits, np.cumsum(many) - many).astype(np.float64) if len(doc) else np.empty(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Per text, the logistic of the shifted logit of its highest window."""
        return _sigmoid(self.logits([clean(t) for t in texts]) - self.net.shift)


_scorers: dict[str, Scorer] = {}


def scorer(name: str, net: Network) -> Scorer:
    """One per worker and training run."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(net)
    return _scorers[name]


def sample(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> list[tuple[list[list[bytes]], int]]:
    """Windows and label of a bounded sample of the labelled documents that may be learnt from."""
    named = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    named = named.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    order = [F.xxhash64(F.lit(seed), "doc_id"), "doc_id"]
    some = named.filter("toxic = 1").orderBy(*order).limit(MOST_DOCS).union(named.filter("toxic = 0").orderBy(*order).limit(MOST_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = clean(text).split()
                at = list(starts(len(words)))
                draw = random.Random(seed * 1_000_003 + doc_id)
                for a in draw.sample(at, min(len(at), MOST_WINDOWS)):
                    rows.append((doc_id, b" ".join(words[a : a + WINDOW]), toxic))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            kinds = (pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "words", "toxic"])

    # At most 2 * MOST_DOCS labels go to every executor, and that many times MOST_WINDOWS windows come back.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")
    got = rows.mapInArrow(run, "doc_id long, words binary, toxic int").toArrow().to_pylist()
    out: dict[int, tuple[list[list[bytes]], int]] = {}
    once: dict[bytes, bytes] = {}  # a word is held once, however often it occurs
    for row in sorted(got, key=lambda r: (r["doc_id"], r["words"])):
        out.setdefault(row["doc_id"], ([], row["toxic"]))[0].append([once.setdefault(w, w) for w in row["words"].split()])
    return list(out.values())


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    ship(spark)
    net = fit(sample(docs, labels))
    name = f"{spark.sparkContext.applicationId}-{id(net)}-{random.random()}"
    model = spark.sparkContext.broadcast(net)  # buckets and words of the sample: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(name, model.value) if isinstance(model.value, Network) else None
        for part in blocks(batches):
            texts = part.column("text").to_pylist()
            scores = own.scores(texts) if own else np.full(len(texts), float(model.value))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
