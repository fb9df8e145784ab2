"""Cases in which an operator once did less than its whole job."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from opslens.llm import html_text, licenses, ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "more") for i, t in texts], DOCS)


LONG = ("The rain came over the hills in the morning and it was not until the evening that they had the time to go out, "
        "as it is with all the days that we have had here in the last years and which will be with us for a long time. ")


def test_text_outside_teaser_articles_is_kept():
    card = '<article><h2><a href="/s">Another story</a></h2><p><a href="/s">How it came that the sun was out again</a></p></article>'
    page = f"<body><nav><a href=/>Home</a></nav><div><p>{LONG}</p>{card}<p>And so it was.</p><p>{LONG}</p></div>{card}"
    assert html_text.main_text(page) == "\n".join([LONG.strip(), "And so it was.", LONG.strip()])


def test_links_inside_an_article_are_kept():
    page = (f"<article><h1>Head</h1><p>{LONG}</p><p><a href=/a>{LONG}</a></p><ul><li><a href=/r>First source of it</a>"
            f"<li><a href=/q>Second source</a></ul></article><p><a href=/x>More of this</a></p>")
    assert html_text.main_text(page) == "\n".join(
        ["Head", LONG.strip(), LONG.strip(), "First source of it", "Second source"])


def test_stop_words_decide_in_articles_too():
    junk = "xq zv kj " * 30
    page = f"<article><p>{LONG}</p></article><main><p>{junk}</p></main>"
    assert html_text.main_text(page) == LONG.strip()
    assert html_text.main_text(f"<article><p>{junk}</p></article>") == junk.strip()


def brute_links(texts, size, percent):
    """Other documents that each (doc_id, text) links to; a document counts once for each of its sets."""
    def of(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    each = {(i, of(t)) for i, t in texts if i is not None and of(t)}
    return {(i, t): sum((j, b) != (i, of(t)) and 100 * len(of(t) & b) >= percent * len(of(t) | b) for j, b in each) if of(t) and i is not None
            else 0 for i, t in texts}


@pytest.mark.parametrize("blocks", [(1 << 19, 1024), (400, 3)])
@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_links_equal_brute_force(spark, monkeypatch, blocks, size, percent):
    monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", blocks[0])
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", blocks[1])
    r = random.Random(size)
    texts = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "one two"), (None, "one")]
    for g in range(4):
        base = [r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(90)]
        for _ in range(14):
            words = list(base) + ["end"] * r.choice([0, 0, 0, 9])
            for _ in range(r.randint(0, 3)):
                words[r.randrange(90)] = str(r.random())
            texts.append((len(texts), " ".join(words)))
    a = " ".join(map(str, range(100)))
    texts += [(500, a), (501, a), (502, a + " x"), (503, a + " y"), (503, a + " y"), (504, a + " z"), (504, "other words here")]
    got = ngram_join.jaccard_components(docs(spark, texts), size, percent).collect()
    want = brute_links(texts, size, percent)
    assert want[(502, a + " x")] == 4 and want[(500, a)] == 4
    assert sorted((x.doc_id or -1, x.n_links) for x in got) == sorted(((i or -1), want[i, t]) for i, t in texts)


def test_whole_license_files_and_wrapped_statements(spark):
    whole = dict(licenses.TEXTS)
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 Some One <one@example.org>\n\n" + whole["MIT"].split("\n", 1)[1]
    wrapped = "# This program is licensed\n# under the GNU General\n# Public License,\n# version 2.\ncode = 1\n" + "more code words\n" * 9
    inside = "some words go here " * 20 + "Licensed under the Apache License, Version 2.0. " + "and yet more words follow " * 20
    files = [(1, "a/LICENSE", mit), (2, "a/b/c.py", "code only"), (3, "d/LICENSE", whole["Apache-2.0"]), (4, "d/x.py", None),
             (5, "e/LICENSE", whole["BSD-2-Clause"]), (6, "f/LICENSE", whole["ISC"]), (7, "g/COPYING", whole["LGPL-2.1"]),
             (8, "h/w.py", wrapped), (9, "h/i.py", inside), (10, "h/z.py", "nothing at all")]
    got = licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string"), F.col("path")).collect()
    assert {r.doc_id: (r.license, r.origin) for r in got} == {
        1: ("MIT", "license_file"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "license_file"), 4: ("Apache-2.0", "inherited"),
        5: ("BSD-2-Clause", "license_file"), 6: ("ISC", "license_file"), 7: ("LGPL-2.1", "license_file"),
        8: ("GPL-2.0", "header"), 9: ("Apache-2.0", "header"), 10: (None, "none")}


def test_pipeline_decides_each_row(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    r = random.Random(4)
    good = [" ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(80)) for _ in range(4)]
    bad, leak = "same " * 80, good[0] + " " + item
    texts = [(None, good[0]), (None, bad), (1, good[1]), (1, bad), (2, good[2]), (2, good[2]), (3, good[2]), (None, good[2]),
             (4, leak), (4, good[3]), (None, None), (5, "")]
    ends = {name: stage for name, stage in corpus_pipeline.STAGES}
    run = lambda name, rows: sorted(((x.doc_id, x.text) for x in ends[name](
        spark, docs(spark, rows), str(tmp_path)).collect()), key=repr)
    by = lambda rows: sorted(rows, key=repr)
    assert run("quality rules", texts) == by((i, t) for i, t in texts if t and t != bad)
    scores = corpus_pipeline.toxicity.score_toxicity(docs(spark, list(enumerate(t for _, t in texts))), spark.read.parquet(
        str(tmp_path / "labels.parquet"))).collect()
    clean = {x.doc_id for x in scores if x.predicted == 0}
    assert run("toxicity", texts) == by(x for k, x in enumerate(texts) if k in clean)
    assert run("n-gram Jaccard join", texts) == by(  # the row of good[0] is a near copy of the leak, and has no doc_id
        [(None, None), (5, ""), (1, bad), (1, good[1]), (2, good[2]), (4, leak), (4, good[3])])
    assert run("benchmark decontamination", texts) == by(x for x in texts if x[1] != leak)
    assert all(run(name, []) == [] for name in ("quality rules", "benchmark decontamination"))


def test_only_named_files_hold_for_their_folder(spark):
    one = "# Licensed under the Apache License, Version 2.0."
    files = [(1, "a/__init__.py", one), (2, "a/x.py", "code only"), (3, "b/LICENSE-APACHE.txt", one), (4, "b/c/x.py", "code"),
             (5, "d/legal.txt", dict(licenses.TEXTS)["ISC"]), (6, "d/x.py", ""), (7, None, one), (8, "b/NOTICE", one),
             (8, "b/NOTICE", one), (9, "b/COPYING", "Released under the MIT License."), (10, "licenses.py", one), (11, "top.py", "code")]
    got = licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string"), F.col("path")).collect()
    by_id = {r.doc_id: (r.license, r.origin) for r in got}
    assert by_id == {
        1: ("Apache-2.0", "header"), 2: (None, "none"), 3: ("Apache-2.0", "license_file"), 4: ("Apache-2.0", "inherited"),
        5: ("ISC", "license_file"), 6: ("ISC", "inherited"), 7: ("Apache-2.0", "header"), 8: ("Apache-2.0", "license_file"),
        9: ("MIT", "license_file"), 10: ("Apache-2.0", "header"), 11: (None, "none")}
    assert len(got) == len(files)
    empty = spark.createDataFrame([], "doc_id long, path string, text string")
    assert licenses.scan_licenses(empty, F.col("path")).count() == 0


@pytest.mark.parametrize("most", [0, 1, 7, 40, 41, 300, 1000])
def test_most_frequent_ngrams_with_ties(spark, most):
    r = random.Random(most)
    rows = [(r.randrange(-2 ** 63, 2 ** 63), r.choice([2, 2, 2, 3, 9])) for _ in range(500)]
    rows += rows[:40]  # found by two tasks: their numbers add up
    made = spark.createDataFrame([*rows, (None, 5)], "token long, n int")
    total = {}
    for token, n in rows:
        total[token] = total.get(token, 0) + n
    tokens, counts = ngram_join.most_frequent(made, most)
    assert list(zip(tokens.astype("int64").tolist(), counts.tolist(), strict=True)) == sorted(
        total.items(), key=lambda x: (-x[1], x[0]))[:most]


def test_frequent_ngrams_do_not_reach_the_driver_as_rows(spark, monkeypatch):
    words = [f"w{i}" for i in range(3000)]
    texts = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, "another text altogether")]
    frame, collected = type(spark.range(0)), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: collected.append(collect(self)) or collected[-1])
    # in one task, so that n-grams are frequent in its chunk
    found = ngram_join.jaccard_components(docs(spark, texts).coalesce(1), 5, 80, links=False)
    assert max(map(len, collected)) < 100
    assert sorted(tuple(r) for r in found.select("doc_id", "component_id").toLocalIterator()) == [(1, 1), (2, 1), (3, 3)]
