"""The Merkle manifest against a plain tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from opslens.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp int, node string, chunk long, rank int"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    """Levels of a tree, and for each leaf its siblings by level as (place, run)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, a in enumerate(at):
            paths[i].append((a % 8, level[a - a % 8:a - a % 8 + 8]))
        level = [h("".join(level[i:i + 8])) for i in range(0, len(level), 8)]
        at = [a // 8 for a in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        trees[g] = levels_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])])
    root, tops = levels_of([trees[g][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for (_, _, leaf, row), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            path = path + tops[k]
            node = leaf
            if row[0] is not None and row[0] % 3 == 0 and row[4] is not None:
                node = leaf_of((*row[:4], row[4].replace("A", "a").replace("B", "b")))
            for at, run in path:
                node = h("".join(node if i == at else x for i, x in enumerate(run)))
            proof = h("".join(x for at, run in path for i, x in enumerate(run) if i != at))
            out.append((row[0], leaf, trees[g][0], root, proof, node, node == root))
    return sorted(out, key=str)


def made(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA).repartition(3)
    got = merkle.manifest(df, COLUMNS, "doc_id", "lang", {"text": F.translate("text", "AB", "ab")}, F.col("doc_id") % 3 == 0)
    return sorted((tuple(r) for r in got.drop("lang").collect()), key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9, None: 3, "": 2, "zz": 1}, {"en": 700, "dé": 65, "b": 8, None: 64}, {
    f"l{i}": 1 + i % 3 for i in range(75)}])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "CHUNK", 8)
    r = random.Random(4)
    rows = [(r.randrange(10_000), r.choice(["s", None, "é"]), g, r.choice([None, 5]), r.choice([None, "", "ABc", "x", "é" * 300, "A\nB"]))
            for g, n in sizes.items() for _ in range(n)]
    if "dé" in sizes:
        rows += [(None, None, "en", None, None)] * 3 + [rows[0]] * 20 + [(7, "s", "b", 1, "A" * 200_000)]
    assert made(spark, rows) == brute(rows)


def test_whole_chunks_and_empty_table(spark):
    rows = [(i, "s", "en" if i % 5 else None, i, f"A text {i}") for i in range(1300)]
    got = made(spark, rows)
    assert got == brute(rows) and {x[-1] for x in got} == {True, False}
    assert made(spark, []) == []
