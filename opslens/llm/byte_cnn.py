"""Quality scores of a byte-level convolutional network in numpy.

Every byte has a learned vector. Filters over TAPS bytes run over the whole text at every
STEP-th byte; their outputs are max-pooled over overlapping chunks, and the chunks' maxima
enter one logistic unit as their greatest value and their mean over the text. Trained on
the driver from a bounded sample of labelled rows; scoring is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import map_arrow, texts_of

#: A filter sees this many bytes; the filters start at every STEP-th byte.
TAPS, STEP = 8, 2
#: Filter places that are pooled at once, in units of TAPS bytes.
BLOCK = 8
#: A chunk is so many blocks, each chunk sharing its last block with the next one: 512 bytes in steps of 448.
CHUNK = 8
#: What stands behind the end of a text.
PAD = 256
#: Bytes whose filter outputs are held at once.
PIECE = 1 << 19


@dataclass(frozen=True)
class Settings:
    """At most ``sample`` rows of each label are learnt from, whole texts, one row of each doc_id."""

    width: int = 8
    filters: int = 24
    sample: int = 1500
    epochs: int = 5
    batch: int = 32
    rate: float = 0.01
    seed: int = 11
    threshold: float = 0.5


def first_weights(s: Settings) -> dict[str, np.ndarray]:
    r = np.random.default_rng(s.seed)
    draw = lambda *n, k: r.normal(0, k, n).astype(np.float32)
    byte = draw(PAD + 1, s.width, k=0.5)
    byte[PAD] = 0
    return {"byte": byte, "filter": draw(TAPS * s.width, s.filters, k=(TAPS * s.width) ** -0.5),
            "bias": np.zeros(s.filters, np.float32), "out": draw(2 * s.filters, k=0.1), "last": np.zeros(1, np.float32)}


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each filled up to whole blocks behind at least TAPS pads, and the blocks of each."""
    unit = TAPS * BLOCK
    blocks = np.array([(len(t) + TAPS + unit - 1) // unit for t in texts], np.int64)
    out = np.full(int(blocks.sum()) * unit + TAPS, PAD, np.int16)
    at = 0
    for t, n in zip(texts, blocks, strict=True):
        out[at:at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(n) * unit
    return out, blocks


def block_maxima(ids: np.ndarray, ends: np.ndarray, w: dict[str, np.ndarray], places: bool = False):
    """Greatest output of each filter in each block, at least 0, and where it stands (in bytes, -1 for none).

    ``ends`` are the blocks that end a text: filters there never reach into the next one.
    """
    unit, width, filters = TAPS * BLOCK, w["byte"].shape[1], w["filter"].shape[1]
    n = (len(ids) - TAPS) // unit
    best = np.zeros((n, filters), np.float32)
    where = np.full((n, filters), -1, np.int64) if places else None
    last = np.zeros(n, bool)
    last[ends] = True
    for first in range(0, n, PIECE // unit):
        stop = min(n, first + PIECE // unit)
        part = w["byte"].take(ids[first * unit:stop * unit + TAPS], axis=0)
        for shift in range(0, TAPS, STEP):
            out = part[shift:shift + (stop - first) * unit].reshape(-1, TAPS * width) @ w["filter"]
            out += w["bias"]
            out = out.reshape(stop - first, BLOCK, filters)
            if shift:
                out[last[first:stop], -1] = 0  # begins in the pads and ends in the next text
            top = out.max(axis=1)
            if places:
                better = top > best[first:stop]
                spot = (np.arange(first, stop)[:, None] * BLOCK + out.argmax(axis=1)) * TAPS + shift
                where[first:stop] = np.where(better, spot, where[first:stop])
            np.maximum(best[first:stop], top, out=best[first:stop])
    return best, where


def chunks_of(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last block (exclusive) of each chunk, and the chunks of each text."""
    count = np.maximum(1, -(-(blocks - 1) // (CHUNK - 1)))
    end = np.cumsum(blocks)
    text = np.repeat(np.arange(len(blocks)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = (end - blocks)[text] + nth * (CHUNK - 1)
    return start, np.minimum(start + CHUNK, end[text]), count


def pooled(best: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Greatest value of each chunk."""
    rows = np.concatenate([best, np.zeros((1, best.shape[1]), best.dtype)])
    return np.maximum.reduceat(rows, np.stack([start, stop], axis=1).reshape(-1), axis=0)[::2]


def logits(chunk: np.ndarray, count: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logit of each text, and its features: greatest value and mean over its chunks."""
    first = np.cumsum(count) - count
    top = np.maximum.reduceat(chunk, first, axis=0)
    mean = np.add.reduceat(chunk, first, axis=0) / count[:, None].astype(np.float32)
    both = np.concatenate([top, mean], axis=1)
    return both @ w["out"] + w["last"], both, first


def gradients(texts: list[bytes], labels: np.ndarray, w: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss and its gradients; only the places of the maxima carry any."""
    ids, blocks = padded(texts)
    best, where = block_maxima(ids, np.cumsum(blocks) - 1, w, places=True)
    start, stop, count = chunks_of(blocks)
    chunk = pooled(best, start, stop)
    z, both, first = logits(chunk, count, w)
    p = 1 / (1 + np.exp(-z))
    loss = float(np.mean(np.logaddexp(0, z) - labels * z))
    d = ((p - labels) / len(labels)).astype(np.float32)
    f = w["filter"].shape[1]
    g = {"out": both.T @ d, "last": d.sum(keepdims=True)}
    text = np.repeat(np.arange(len(texts)), count)
    d_chunk = (d / count)[text][:, None] * w["out"][f:]
    at_top = chunk >= both[text, :f]
    share = np.add.reduceat(at_top.astype(np.float32), first, axis=0)
    d_chunk = d_chunk + at_top * (d[:, None] * w["out"][:f] / np.maximum(share, 1))[text]
    # the block of a chunk that holds its maximum, and the filter's place there
    spot = np.full(chunk.shape, -1, np.int64)
    for k in range(CHUNK):
        b = np.minimum(start + k, stop - 1)
        hit = (spot < 0) & (best[b] >= chunk)
        spot = np.where(hit, where[b], spot)
    c, j = np.nonzero(spot >= 0)
    value, place = d_chunk[c, j], spot[c, j]
    seen = ids[place[:, None] + np.arange(TAPS)]
    windows = w["byte"][seen].reshape(len(place), -1)
    g["filter"], g["bias"] = np.zeros_like(w["filter"]), np.bincount(j, value, f).astype(np.float32)
    order = np.argsort(j, kind="stable")
    edges = np.searchsorted(j[order], np.arange(f + 1))
    for k in range(f):
        rows = order[edges[k]:edges[k + 1]]
        g["filter"][:, k] = value[rows] @ windows[rows]
    back = (value[:, None] * w["filter"].T[j]).reshape(-1, w["byte"].shape[1])
    g["byte"] = np.stack([np.bincount(seen.reshape(-1), back[:, k], PAD + 1) for k in range(back.shape[1])], axis=1).astype(np.float32)
    g["byte"][PAD] = 0
    return loss, g


def train(rows: list[tuple[bytes, int]], s: Settings) -> dict[str, np.ndarray]:
    """Adam over mini-batches of whole texts; without rows the first weights stay."""
    w, r = first_weights(s), np.random.default_rng(s.seed)
    one = {k: np.zeros_like(v) for k, v in w.items()}
    two = {k: np.zeros_like(v) for k, v in w.items()}
    step, total = 0, s.epochs * -(-len(rows) // s.batch)
    for _ in range(s.epochs):
        order = r.permutation(len(rows))
        for at in range(0, len(order), s.batch):
            part = [rows[i] for i in order[at:at + s.batch]]
            _, g = gradients([t for t, _ in part], np.array([y for _, y in part], np.float32), w)
            step += 1
            rate = s.rate * min(1.0, 2 * (1 - (step - 1) / total))
            for k, x in g.items():
                one[k] += 0.1 * (x - one[k])
                two[k] += 0.001 * (x * x - two[k])
                w[k] -= rate * (one[k] / (1 - 0.9 ** step)) / (np.sqrt(two[k] / (1 - 0.999 ** step)) + 1e-7)
    return w


def scores(texts: list[bytes], w: dict[str, np.ndarray]) -> np.ndarray:
    """Probability of label 1 of each text, over all of its chunks."""
    if not texts:
        return np.zeros(0)
    ids, blocks = padded(texts)
    best, _ = block_maxima(ids, np.cumsum(blocks) - 1, w)
    start, stop, count = chunks_of(blocks)
    return 1 / (1 + np.exp(-logits(pooled(best, start, stop), count, w)[0].astype(np.float64)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> list[tuple[bytes, int]]:
    """A bounded sample: of each label the ids with the smallest hash, and one text of each id."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.where(~held_out(F.col("doc_id")))
    found = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("digest")).join(marks, "doc_id").groupBy(
        "doc_id", "quality").agg(F.min("digest").alias("digest"))
    chosen = None
    for quality in (0, 1):
        part = found.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).join(F.broadcast(chosen), ["doc_id", "digest"])
    # repeated rows of an id have equal texts here: one of them is taken
    rows = rows.groupBy("doc_id", "quality").agg(F.first("text").alias("text")).collect()
    return [(r.text.encode("utf-8", "surrogatepass"), r.quality) for r in sorted(rows, key=lambda r: r.doc_id)]


def score_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns only from labelled rows that are not held out; of contradicting labels of an id
    the lower counts. The broadcasts have fixed bounds: 2 x ``sample`` ids, and the weights. A null
    or empty text is scored as a text of pads; without labels the first weights stay. Repeated
    rows are scored each. A null doc_id counts as not held out, and is never learnt from. Long
    texts run in pieces of fixed size; an empty table gives no row.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs, labels, settings), settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                got = scores([t.encode("utf-8", "surrogatepass") for t in texts_of(part.column(1))], w)
                yield pa.record_batch([part.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    scored = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= settings.threshold).cast("int").alias("predicted"))
