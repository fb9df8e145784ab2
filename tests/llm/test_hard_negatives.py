"""Hard negatives against a row-by-row restatement, and what the coordinate ranges leave."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opslens.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, key string, cls string, v int"


def brute(rows):
    used = set()
    for i, e, y in rows:
        if i is None or y is None or e is None or any(x is None or not math.isfinite(x * 256) for x in e):
            continue
        used.add((i, (y + 1) % 4 if i % 7 == 0 else y, tuple(math.floor(256 * x) for x in e)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for a in used:
        if a[0] % 10:
            continue
        scored = [(-dot(a[2], r[2]), r[0], r[1]) for r in used if r != a]
        for ps, p, _ in sorted(x for x in scored if x[2] == a[1])[:5]:
            ns = sorted(x for x in scored if x[2] != a[1] and 30 * -ps <= 100 * -x[0] <= 90 * -ps)[:10]
            out += [(a[0], p, k + 1, n, -ps, -s) for k, (s, n, _) in enumerate(ns)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, e, y, "x", "y", 1) for i, e, y in rows], SCHEMA)
    return sorted(tuple(r) for r in H.mine_hard_negatives(
        df, F.col("vec_id") % 10 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label"))).collect())


def vectors(n, d, seed, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 1) * spread ** r.random() / 8 for _ in range(d)], r.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("cells", [200, 1 << 16])
def test_mined_rows_equal_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(H, "BUCKET_CELLS", cells)
    monkeypatch.setattr(H, "BLOCK_CELLS", cells)
    rows = vectors(150, 6, 5, spread=30.0)
    rows += [(i, rows[3][1], 2) for i in range(200, 240)]  # one vector many times: ties
    rows += [rows[10], rows[10], (10, [0.5] * 6, 1)]  # repeated rows; another row of the same id
    rows += [(300, None, 1), (301, [0.1, None, 0.2], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 1),
             (304, [0.2] * 6, None), (None, [0.2] * 6, 1), (310, [0.0] * 6, 2), (320, [], 1), (330, [0.3] * 3, 1),
             (340, [1e300] * 6, 99), (350, [-0.4] * 6, 77)]
    want = brute([r for r in rows if r[0] != 340])
    assert mined(spark, [r for r in rows if r[0] != 340]) == want and want


def test_scores_beyond_a_long_are_held_at_its_ends(spark):
    got = mined(spark, [(10, [1e300, 0.0], 1), (11, [1e300, 1.0], 1), (12, [1.0, 1.0], 2)])
    assert got == []  # the only other row is far below 30 percent


def test_empty_tables_and_lone_labels(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, [1.0, 0.0], 1), (11, [1.0, 0.5], 2)]) == []  # no positive
    assert mined(spark, [(10, [1.0], 1), (11, [-1.0], 1), (12, [-0.5], 2)]) == brute(
        [(10, [1.0], 1), (11, [-1.0], 1), (12, [-0.5], 2)])


def bucket(v):
    items = [{"vec_id": i, "key": i, "label": 0, "v": x} for i, x in enumerate(v)]
    return H.Bucket(pa.array(items, pa.struct({"vec_id": pa.int64(), "key": pa.int64(), "label": pa.int64(), "v": pa.list_(pa.int64())})))


def test_coordinate_ranges_decide_candidates_and_lose_none():
    r = np.random.default_rng(2)
    centres = r.normal(0, 1, (8, 16))
    centres *= 4 / np.linalg.norm(centres, axis=1)[:, None]
    rows = [np.floor(256 * (centres[i % 8] + r.normal(0, 0.1, 16))).astype(int).tolist() for i in range(800)]
    b, q = bucket(rows), bucket(rows[:16])
    scores = q.v @ b.v.T
    for share in (0.95, 0.5, 0.0, -0.5, 1.2):
        least = share * q.length ** 2
        found = H.candidates(q, least, b)
        for i, c in enumerate(found):
            true = set(np.flatnonzero(scores[i] >= least[i]))
            assert c is None or true <= set(c.tolist())
        if share == 0.95:
            assert max(len(c) for c in found) < 400  # of 800 rows
        if share == 1.2:
            assert sum(len(c) for c in found) < 16 * 20


def test_rows_handed_on_do_not_grow_with_buckets(spark, monkeypatch):
    """Blocks and buckets were shuffled to each other, and each bucket handed on rows of each anchor."""
    monkeypatch.setattr(H, "BUCKET_CELLS", 200)
    monkeypatch.setattr(H, "BLOCK_CELLS", 2000)
    read, handed, run = [], [], H.map_arrow

    def counted(df, function, schema):
        out = run(df, function, schema)
        read.append(df.count())
        handed.append(out.count())
        return out

    monkeypatch.setattr(H, "map_arrow", counted)
    rows = [(i, [x / math.sqrt(sum(y * y for y in e)) for x in e], y) for i, e, y in vectors(1200, 6, 8)]
    want = brute(rows)
    assert mined(spark, rows) == want and len(want) > 1000
    assert handed[-1] <= 120 * 5 * 10 * 2  # two slices of about 42 buckets
    assert max(handed[:-1]) <= 120 * 5 * 2
    assert max(read) <= 50


@pytest.mark.parametrize("scale", [1.0, 60.0, 1e5, 3e6])
def test_scores_of_any_size_are_exact(spark, scale):
    rows = [(i, [x * scale for x in e], y) for i, e, y in vectors(90, 5, 4)]
    rows += [(100 + i, rows[20][1], 1) for i in range(12)]
    want = brute(rows)
    assert mined(spark, rows) == want and want


def test_first_rows_of_lists_and_their_thresholds():
    best = H.Best(np.array([H._LOWEST, 5]), 2)
    best.add(*(np.array(c) for c in ([0, 0, 1, 1], [7, 9, 5, 4], [3, 4, 8, 9], [0, 0, 0, 0])))
    assert [c.tolist() for c in best.settle()] == [[0, 0, 1], [9, 7, 5], [4, 3, 8], [0, 0, 0]] and best.least.tolist() == [7, 5]
    best.add(*(np.array(c) for c in ([0, 0, 0, 1, 1], [7, 7, 6, 5, 5], [2, 9, 1, 8, 1], [0, 0, 0, -1, 5])))
    assert [c.tolist() for c in best.settle()] == [[0, 0, 1, 1], [9, 7, 5, 5], [4, 2, 1, 8], [0, 0, 5, -1]]
