"""Toxicity scores of a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of a hashed word vector and the mean of its hashed character
n-gram vectors. Overlapping windows of words run through a forward and a backward GRU;
attention pools each window's states into one logit. A document's logit is a smooth
maximum over all its windows, so one passage is enough. Trained in numpy on the driver
from a bounded sample of labelled rows; scoring is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import map_arrow, texts_of


@dataclass(frozen=True)
class Settings:
    """At most ``sample`` toxic rows and twice as many others are learnt from: all windows of one row of each doc_id."""

    window: int = 32
    stride: int = 24
    hidden: int = 8
    width: int = 16
    word_buckets: int = 1 << 13
    gram_buckets: int = 1 << 13
    grams: tuple[int, ...] = (3, 4, 5)
    sample: int = 1000
    batch_windows: int = 512
    epochs: int = 5
    rate: float = 0.01
    seed: int = 7
    threshold: float = 0.3


def word_keys(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word (0 is kept for pads), and flat buckets of its character n-grams with the word they belong to."""
    low = [w.strip(".,;:!?\"'()[]") for w in "\n".join(words).lower().split("\n")]
    chars = np.frombuffer("".join(f"<{w}>" for w in low).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in low])
    stop = np.cumsum(size)
    owner = np.repeat(np.arange(len(low)), size)
    left = np.repeat(stop, size) - np.arange(len(chars))  # characters from here to the word's end
    mixed = (chars + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    place = (np.repeat(size, size) - left).astype(np.uint64)
    word = np.add.reduceat(_mix(mixed ^ (place * np.uint64(0xC2B2AE3D27D4EB4F))), stop - size)
    code, grams, owners = np.zeros_like(chars), [], []
    for n in range(1, max(s.grams) + 1):
        code = _mix(code[:len(chars) - n + 1] * np.uint64(31) + mixed[n - 1:]) if n <= len(chars) else code[:0]
        if n in s.grams:
            ok = left[:len(code)] >= n
            grams.append(code[ok] % np.uint64(s.gram_buckets))
            owners.append(owner[:len(code)][ok])
    grams, owners = np.concatenate(grams).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (word % np.uint64(s.word_buckets - 1)).astype(np.int64) + 1, grams[order], owners[order]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _sum_rows(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their place in ``at``; places below 0 are left out."""
    flat, rows = at.reshape(-1), values.reshape(-1, values.shape[-1])
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.diff(flat, prepend=flat[:1] - 1))
    out = np.zeros((n, rows.shape[1]), np.float32)
    real = flat[first] >= 0
    out[flat[first][real]] = np.add.reduceat(rows[order], first, axis=0)[real]
    return out


class Network:
    """Weights: word and gram vectors, input and recurrent gates of both directions, attention, output."""

    def __init__(self, s: Settings):
        r, h, d = np.random.default_rng(s.seed), s.hidden, s.width
        self.s = s
        draw = lambda *n, k=0.1: r.normal(0, k, n).astype(np.float32)
        self.w = {"word": draw(s.word_buckets, d), "gram": draw(s.gram_buckets, d),
                  "x": draw(2, d, 3 * h, k=d ** -0.5), "u": draw(2, h, 3 * h, k=h ** -0.5),
                  "b": np.zeros((2, 1, 3 * h), np.float32), "att": draw(2 * h, k=0.3),
                  "out": draw(2 * h, k=0.3), "bias": np.full(1, -1, np.float32)}
        self.w["word"][0] = 0

    def vectors(self, bucket, grams, owner) -> np.ndarray:
        n = np.bincount(owner, minlength=len(bucket)).astype(np.float32)[:, None]
        out = np.zeros((len(bucket), self.s.width), np.float32)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        if len(starts):  # a word without letters has no gram
            out[owner[starts]] = np.add.reduceat(self.w["gram"][grams], starts, axis=0) / n[owner[starts]]
        return out + self.w["word"][bucket]

    def run(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows (rows of ids, -1 pads) from the gate inputs of each distinct word."""
        h, (n, steps) = self.s.hidden, ids.shape
        states = np.zeros((2, steps, n, h), np.float32)
        state, kept = np.zeros((2, n, h), np.float32), []
        for t in range(steps):
            at = np.stack([ids[:, t], ids[:, steps - 1 - t]])
            real = (at >= 0)[:, :, None]
            g = np.stack([gates[0][at[0]], gates[1][at[1]]])
            rec = state @ self.w["u"]
            zr = _sigmoid(g[:, :, :2 * h] + rec[:, :, :2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            new = np.tanh(g[:, :, 2 * h:] + r * rec[:, :, 2 * h:])
            after = np.where(real, state + z * (new - state), state)
            if keep:
                kept.append((at, real, state, rec, z, r, new))
            state = after
            states[0, t], states[1, steps - 1 - t] = after[0], after[1]
        both = np.concatenate([states[0], states[1]], axis=2)
        mask = (ids.T >= 0)
        e = np.where(mask, np.tanh(both) @ self.w["att"] * 4, -30)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * both).sum(axis=0)
        return pooled @ self.w["out"] * 4 + self.w["bias"], (kept, both, mask, a, pooled)

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions; a zero row at the end serves the pads (index -1)."""
        g = vectors[None] @ self.w["x"] + self.w["b"]
        return np.concatenate([g, np.zeros_like(g[:, :1])], axis=1)

    def backward(self, tape, ids, grad_logit):
        """Gradients of the recurrent part, and of the gate inputs of each place."""
        kept, both, mask, a, pooled = tape
        w, h, steps = self.w, self.s.hidden, ids.shape[1]
        g = {"bias": grad_logit.sum(keepdims=True), "out": 4 * pooled.T @ grad_logit, "u": np.zeros_like(w["u"])}
        d_pool = 4 * grad_logit[:, None] * w["out"]
        d_both = a[:, :, None] * d_pool
        d_a = (both * d_pool).sum(axis=2)
        d_e = a * (d_a - (a * d_a).sum(axis=0)) * mask
        th = np.tanh(both)
        g["att"] = 4 * np.einsum("tn,tnk->k", d_e, th)
        d_both += 4 * d_e[:, :, None] * w["att"] * (1 - th * th)
        d_in = np.zeros((2, steps, ids.shape[0], 3 * h), np.float32)
        d_state = np.zeros((2, ids.shape[0], h), np.float32)
        for t in reversed(range(steps)):
            at, real, state, rec, z, r, new = kept[t]
            d = d_state + np.stack([d_both[t, :, :h], d_both[steps - 1 - t, :, h:]])
            dr = np.where(real, d, 0)
            d_new = dr * z * (1 - new * new)
            d_z = dr * (new - state) * z * (1 - z)
            d_r = d_new * rec[:, :, 2 * h:] * r * (1 - r)
            d_in[:, t] = np.concatenate([d_z, d_r, d_new], axis=2)
            d_rec = np.concatenate([d_z, d_r, d_new * r], axis=2)
            g["u"] += np.swapaxes(state, 1, 2) @ d_rec
            d_state = np.where(real, d * (1 - z), d) + d_rec @ np.swapaxes(w["u"], 1, 2)
        return g, d_in

    def document_logits(self, logits: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smooth maximum over each document's windows, and each window's share in it."""
        top = np.maximum.reduceat(logits, starts)
        n = np.diff(np.append(starts, len(logits)))
        e = np.exp(3 * (logits - np.repeat(top, n)))
        total = np.add.reduceat(e, starts)
        return np.add.reduceat(e * logits, starts) / total, e / np.repeat(total, n)


def windows_of(ids: np.ndarray, s: Settings) -> np.ndarray:
    """All windows of a document, each overlapping the next; an empty text gives one window of pads."""
    n = max(1, -(-(len(ids) - s.window) // s.stride) + 1) if len(ids) > s.window else 1
    padded = np.full((n - 1) * s.stride + s.window, -1, np.int32)
    padded[:len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, s.window)[::s.stride]


def batches_of(docs: list[tuple[np.ndarray, int]], windows: int) -> Iterator[list[tuple[np.ndarray, int]]]:
    """Whole documents with ``windows`` windows together or little more; a longer document stands alone."""
    batch, size = [], 0
    for doc in docs:
        if batch and size + len(doc[0]) > windows:
            yield batch
            batch, size = [], 0
        batch.append(doc)
        size += len(doc[0])
    if batch:
        yield batch


def train(rows: list[tuple[str, int]], s: Settings) -> Network:
    """Adam over mini-batches of documents; rows are (text, toxic)."""
    net, r = Network(s), np.random.default_rng(s.seed)
    index: dict[str, int] = {}
    docs = []
    for text, label in rows:
        ids = np.array([index.setdefault(w, len(index)) for w in text.split()], np.int32)
        docs.append((windows_of(ids, s), label))
    if not docs or not index:
        return net
    bucket, grams, owner = word_keys(list(index), s)
    count = np.bincount(owner, minlength=len(bucket))
    first = np.cumsum(count) - count
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    for _ in range(s.epochs):
        order = r.permutation(len(docs))
        for batch in batches_of([docs[i] for i in order], s.batch_windows):
            ids = np.concatenate([w for w, _ in batch])
            y = np.array([label for _, label in batch], np.float32)
            starts = np.cumsum([0] + [len(w) for w, _ in batch[:-1]])
            used, flat = np.unique(ids, return_inverse=True)
            local = flat.reshape(ids.shape).astype(np.int32)
            if used[0] == -1:
                used, local = used[1:], local - 1
            if not len(used):
                continue
            spans = [np.arange(first[u], first[u] + count[u]) for u in used]
            g_sel, g_own = grams[np.concatenate(spans)], np.repeat(np.arange(len(used)), count[used])
            vec = net.vectors(bucket[used], g_sel, g_own)
            logits, tape = net.run(net.gates(vec), local, keep=True)
            doc, share = net.document_logits(logits, starts)
            d_doc = (_sigmoid(doc) - y) / len(batch)
            n = np.diff(np.append(starts, len(logits)))
            mean = np.repeat(doc, n)
            grad, d_in = net.backward(tape, local, (np.repeat(d_doc, n) * share * (
                1 + 3 * (logits - mean))).astype(np.float32))
            d_gate = np.stack([_sum_rows(d_in[0], local.T, len(used)), _sum_rows(d_in[1], local.T[::-1], len(used))])
            grad["x"] = vec.T[None] @ d_gate
            grad["b"] = d_gate.sum(axis=1, keepdims=True)
            d_vec = (d_gate @ np.swapaxes(net.w["x"], 1, 2)).sum(axis=0)
            grad["word"] = _sum_rows(d_vec, bucket[used], s.word_buckets)
            grad["gram"] = _sum_rows((d_vec / np.maximum(count[used], 1)[:, None])[g_own], g_sel, s.gram_buckets)
            step += 1
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.001 * (g * g - v2[k])
                net.w[k] -= s.rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-7)
    return net


class Scorer:
    """Scores batches of texts; gate inputs of words are computed once and kept while there are few enough."""

    CHUNK, WORDS = 4096, 400_000

    def __init__(self, weights: dict[str, np.ndarray], s: Settings):
        self.net = Network(s)
        self.net.w = weights
        h = s.hidden
        self.u = [(np.ascontiguousarray(u[:, :2 * h]), np.ascontiguousarray(u[:, 2 * h:])) for u in weights["u"]]
        self.clear()

    def clear(self) -> None:
        h = self.net.s.hidden
        self.index: dict[str, int] = {}
        #: By direction, gate inputs of each word; the last row serves the pads (index -1).
        self.tables = [(np.zeros((1, 2 * h), np.float32), np.zeros((1, h), np.float32)) for _ in range(2)]

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.WORDS:
            self.clear()
        index, known, h = self.index, len(self.index), self.net.s.hidden
        for w in set(words).difference(index):
            index[w] = len(index)
        fresh = list(index)[known:]
        for i in range(0, len(fresh), 20_000):
            g = self.net.vectors(*word_keys(fresh[i:i + 20_000], self.net.s))[None] @ self.net.w["x"] + self.net.w["b"]
            self.tables = [(np.concatenate([zr[:-1], x[:, :2 * h], zr[-1:]]), np.concatenate([n[:-1], x[:, 2 * h:], n[-1:]]))
                           for (zr, n), x in zip(self.tables, g, strict=True)]
        return np.fromiter(map(index.__getitem__, words), np.int32, len(words))

    def logits(self, ids: np.ndarray) -> np.ndarray:
        """As Network.run, in buffers that stay in the processor's cache."""
        w, h, (n, steps) = self.net.w, self.net.s.hidden, ids.shape
        cols = np.ascontiguousarray(ids.T)
        padded = (cols < 0).any(axis=1)
        both = np.empty((2, steps, n, h), np.float32)
        for d in range(2):
            (t_zr, t_n), (u_zr, u_n) = self.tables[d], self.u[d]
            state = np.zeros((n, h), np.float32)
            for t in range(steps) if d == 0 else reversed(range(steps)):
                at = cols[t]
                zr = t_zr.take(at, axis=0, mode="wrap")
                zr += state @ u_zr
                np.exp(np.negative(zr, out=zr), out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                new = state @ u_n
                new *= zr[:, h:]
                new += t_n.take(at, axis=0, mode="wrap")
                np.tanh(new, out=new)
                new -= state
                new *= zr[:, :h]
                if padded[t]:
                    new *= (at >= 0)[:, None]
                state = np.add(state, new, out=both[d, t])
        score = np.tanh(both[0]) @ w["att"][:h] + np.tanh(both[1]) @ w["att"][h:]
        e = np.where(cols >= 0, score * 4, -30)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        value = both[0] @ w["out"][:h] + both[1] @ w["out"][h:]
        return (a * value).sum(axis=0) * 4 + w["bias"]

    def scores(self, texts: list[str]) -> np.ndarray:
        s = self.net.s
        split = [t.split() for t in texts]
        ids = self.ids([w for ws in split for w in ws])
        ends = np.cumsum([len(ws) for ws in split])
        wins = [windows_of(ids[e - len(ws):e], s) for ws, e in zip(split, ends, strict=True)]
        starts = np.cumsum([0] + [len(w) for w in wins[:-1]])
        every = np.concatenate(wins)
        full = np.argsort(every[:, -1] < 0, kind="stable")  # windows without pads first
        logits = np.empty(len(every), np.float32)
        for i in range(0, len(every), self.CHUNK):
            logits[full[i:i + self.CHUNK]] = self.logits(every[full[i:i + self.CHUNK]])
        return _sigmoid(self.net.document_logits(logits, starts)[0].astype(np.float64))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> list[tuple[str, int]]:
    """A bounded sample: of each class the rows with the smallest hash of their id."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    chosen = None
    for toxic in (0, 1):
        part = marks.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit((2 - toxic) * s.sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy(
        "doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).collect()
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: r.doc_id)]


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(),
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the columns named in ``carry`` as they are.

    Learns only from labelled rows that are not held out. The broadcasts have fixed
    bounds: 3 x ``sample`` ids, and the weights. A null or empty text gets the score of an
    empty window; without labels the network keeps its first weights. Repeated rows are
    scored each. A null doc_id counts as held out (null remainder reads as false).
    """
    net = train(training_rows(docs, labels, settings), settings)
    weights = docs.sparkSession.sparkContext.broadcast(net.w)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights.value, settings)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                got = scorer.scores(texts_of(part.column(1)))
                yield pa.record_batch([part.column(0), pa.array(got, pa.float64()), *part.columns[2:]], ["doc_id", "score", *[f"carried_{c}" for c in carry]])

    scored = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"carried_{c}") for c in carry]), run, ", ".join(
        ["doc_id long", "score double", *(f"`carried_{c}` {kinds[c]}" for c in carry)]))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= settings.threshold).cast("int").alias("predicted"), *[F.col(f"carried_{c}").alias(c) for c in carry])
