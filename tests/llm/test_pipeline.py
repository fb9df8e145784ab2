"""The pipeline's stages and run() on a small corpus against plain Python."""

import hashlib
import random
import struct

import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline as P
import public_tokenizers
from opslens.llm import toxicity
from opslens.llm.queries import RANKS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, kept boolean, component_id string"


def words(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnopqrst", k=r.randint(2, 7))) for _ in range(n))


def corpus():
    r = random.Random(8)
    texts = [words(r, r.randint(60, 120)) for _ in range(30)]
    item = words(r, 40)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, t + " tail") for i, t in enumerate(texts[:8])]  # near copies
    rows += [(3, texts[3]), (3, texts[3]), (3, texts[4]), (None, texts[5]), (None, words(r, 70)), (None, None)]
    rows += [(200, words(r, 60) + " " + item + " " + words(r, 60)), (201, item), (202, ""), (203, "too short")]
    rows += [(204, "w " * 400), (205, words(r, 3000)), (206, "awful nasty " + words(r, 80)), (7, words(r, 80) + " awful nasty")]
    learnt = [(1000 + i, words(r, 70) + (" awful nasty " if i % 2 else " ") + words(r, 9)) for i in range(240)]
    rows += learnt
    labels = [(i, 1, i % 2) for i, _ in learnt] + [(None, 0, 1)]
    return [(d, t, "en", "s", 0 if t is None else len(t), 9, True, "x") for d, t in rows], labels, item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, item = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def wanted(spark, folder):
    rows, labels, item = corpus()
    rows = [(d, t) for d, t, *_ in rows]

    def base(t):
        w = (t or "").split()
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i:i + 3]), []).append(i)
        again = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
        return len(w) >= 50 and 100 * len(again) <= 50 * len(w)

    rows = [x for x in rows if base(x[1])]
    yield rows
    s = toxicity.Settings()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = toxicity.train(toxicity.training_rows(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), s), s)
    score = toxicity.Scorer(net.w, s).scores([t or "" for _, t in rows])
    rows = [x for x, y in zip(rows, score, strict=True) if y < s.threshold]
    yield rows
    rows = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    rows = [x for i, x in enumerate(rows) if group[i] == i]
    yield rows
    rows = [x for x in rows if item not in (x[1] or "")]
    yield rows
    bpe = tiktoken.Encoding("b", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=load_tiktoken_bpe(RANKS))
    out = []
    for d, t in rows:
        ids = bpe.encode_ordinary(t or "")
        out.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))
    yield out


def test_stages_and_run_equal_brute_force(spark, folder):
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = list(wanted(spark, folder))
    for (name, stage), want in zip(P.STAGES[:-1], expected[:-1], strict=True):
        docs = P.materialise(stage(spark, docs, folder), "test-stage")
        assert docs.columns == P.COLUMNS, name
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=key) == sorted(want, key=key), name
    assert {x[0] for x in expected[0]} > {206, 7, None} and 206 not in {x[0] for x in expected[1]}
    assert 201 not in {x[0] for x in expected[3]}
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in P.run(spark, folder).collect()), key=key)
    assert got == sorted(expected[4], key=key) and got


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_joins_with_the_texts_are_the_same_at_any_size(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if every table were large
        found = plan(P.quality_rules(spark, docs, folder))
        assert "SortMergeJoin" not in found and "hashpartitioning(row" not in found  # no text is shuffled
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")  # tiny tables: no broadcast of row numbers
        found = plan(P.near_duplicates(spark, docs, folder))
        assert "SortMergeJoin" in found and "BroadcastHashJoin" not in found
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
