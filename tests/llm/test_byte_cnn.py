"""The byte network: its gradients, its pooling against a plain loop, and what it learns from a table."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from opslens.llm import byte_cnn as B

SMALL = B.Settings(width=3, filters=4, sample=200, epochs=6)


def plain_score(text, w):
    """Filter by filter and chunk by chunk."""
    blocks = (len(text) + B.TAPS + 63) // 64
    ids = list(text) + [B.PAD] * (blocks * 64 + B.TAPS - len(text))
    out = {}
    for at in range(0, blocks * 64, B.STEP):
        if at % B.TAPS and at >= blocks * 64 - B.TAPS:
            continue
        x = np.concatenate([w["byte"][i] for i in ids[at:at + B.TAPS]])
        out[at] = np.maximum(0, x @ w["filter"] + w["bias"])
    chunks = [[v for at, v in out.items() if c * 448 <= at < min(c * 448 + 512, blocks * 64)]
              for c in range(max(1, -(-(blocks - 1) // 7)))]
    top = np.array([np.max(c, axis=0) for c in chunks])
    return 1 / (1 + np.exp(-(np.concatenate([top.max(axis=0), top.mean(axis=0)]) @ w["out"] + w["last"][0])))


def test_scores_equal_a_plain_loop(monkeypatch):
    r = np.random.default_rng(1)
    w = {k: (v + r.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in B.first_weights(SMALL).items()}
    w["byte"][B.PAD] = 0
    texts = [b"", b"x"] + [r.integers(0, 256, n).astype(np.uint8).tobytes() for n in (7, 56, 57, 64, 120, 448, 505, 513, 2000)]
    want = [plain_score(t, w) for t in texts]
    assert np.allclose(B.scores(texts, w), want, atol=1e-5)
    monkeypatch.setattr(B, "PIECE", 192)  # long texts run in pieces
    assert np.allclose(B.scores(texts, w), want, atol=1e-5)
    assert np.allclose([B.scores([t], w)[0] for t in texts], want, atol=1e-5)  # neighbours change nothing


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(2)
    w = {k: (v + r.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in B.first_weights(SMALL).items()}
    w["byte"][B.PAD] = 0
    texts = [r.integers(97, 123, n).astype(np.uint8).tobytes() for n in (30, 700, 1200)]
    labels = np.array([1, 0, 1], np.float32)
    _, g = B.gradients(texts, labels, w)
    for name in w:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        kept, step = w[name][at], 1e-3  # outputs are single precision
        w[name][at] = kept + step
        up = B.gradients(texts, labels, w)[0]
        w[name][at] = kept - step
        down = B.gradients(texts, labels, w)[0]
        w[name][at] = kept
        assert abs(g[name][at] - (up - down) / (2 * step)) < 0.02 * abs(g[name][at]) + 1e-3


def test_learns_from_rows_that_are_not_held_out(spark):
    r = random.Random(3)
    word = lambda: r.choice("sun moon star tree leaf rain wind".split())
    good = lambda: " ".join(word() for _ in range(60))
    texts = [(i, good() + ("" if i % 2 else " ##$$ " + word() + "## ")) for i in range(500)]
    texts += [(900, None), (901, ""), (902, "w " * 200_000), (None, "x"), (5, texts[5][1]), (5, texts[5][1]), (7, "another text")]
    docs = spark.createDataFrame([(i, t, "clash", "en") for i, t in texts], "doc_id long, text string, quality string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(None, 1), (5, None), (901, 7)], "doc_id long, quality int")
    got = B.score_quality(docs, labels, SMALL).collect()
    assert len(got) == len(texts) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 500 and x.doc_id != 7]
    assert sum(x.predicted == x.doc_id % 2 for x in held) > 0.95 * len(held)
    # held-out labels and other columns change nothing
    other = labels.withColumn("quality", F.when(B.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = B.score_quality(docs.withColumn("lang", F.lit("zz")), other, SMALL).collect()
    key = lambda x: (x.doc_id is not None, x.doc_id, x.score)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert B.score_quality(none, labels, SMALL).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert B.score_quality(one, labels, SMALL).first().doc_id == 1
