"""Small tables with nulls, empty texts, ties, repeats and clashing names against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from opslens.llm import chat, html_text, licenses, ngram_join, prefix_bpe, quality, tiling, token_files, toxicity, warc
from opslens.llm.components import connected_components
from opslens.llm.queries import END_OF_DOCUMENT, RANKS, _bpe_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long, stratum string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in texts], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_quality_counts_and_empty_tables(spark):
    texts = [(1, None), (2, ""), (3, "a b c a b c a b"), (4, "x\ny\nx\n \nx # $"), (4, "x\ny\nx\n \nx # $"), (5, "w " * 30_000)]
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    got = quality.quality_rules(docs(spark, texts), labels)
    found = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in got.collect())
    assert found == [(1, 0, 0, 0, 0, 0, False), (2, 0, 0, 0, 0, 0, False), (3, 8, 8, 0, 0, 8, False),
                     (4, 6, 6, 2, 1, 0, False), (4, 6, 6, 2, 1, 0, False), (5, 30000, 30000, 0, 0, 30000, False)]
    assert quality.quality_rules(docs(spark, []), labels).count() == 0


def test_cutoffs_are_certified(spark):
    good, bad = [(i, 0.0, 1) for i in range(2000)], [(i, 1.0, 0) for i in range(200)]
    cut = quality.choose_cutoffs(spark.createDataFrame(
        [("en", g, *[s] * 5) for _, s, g in good + bad], "stratum string, good long, " + ", ".join(
            f"{s} double" for s in quality.GRID))).first()
    assert cut.stratum == "en" and all(0 < c < 1 for c in cut.cutoffs.values())
    p = spark.range(1).select(quality.binomial_tail(F.lit(3).cast("long"), F.lit(100).cast("long"), 0.1)).first()[0]
    assert p == pytest.approx(0.00783648711)


def test_chat_round_trip(spark):
    words = ["###", "</turn>", "\\", "\n", "####", " ok", "\\\\", "# ", "\n</turn>\n", "%3A"]
    r = random.Random(3)
    turns = [(c, t, r.choice(["user", "assistant", "a:b%\n#", None]), "".join(r.choices(words, k=r.randint(0, 8))) or None)
             for c in range(60) for t in range(4)] + [(60, 0, "user", "x"), (60, 0, "user", "x")]
    got = chat.parse(chat.render(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")))
    for row in got.collect():
        want = sorted((t, role or "", text or "") for c, t, role, text in turns if c == row.conv_id)
        assert row.identical and [(x.role, x.text) for x in row.turns] == [(a, b) for _, a, b in want]
        assert row.loss_text == "".join(b for _, a, b in want if a == "assistant")


def test_toxicity_learns_a_word_and_scores_empty_texts(spark):
    r = random.Random(1)
    plain = lambda: " ".join(r.choice("sun moon star tree leaf rain wind".split()) for _ in range(40))
    texts = [(i, plain() + (" awfulword" if i % 2 else "") + " " + plain()) for i in range(240)] + [(900, None), (901, ""), (None, "x")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs(spark, texts), labels, toxicity.Settings(epochs=25)).collect()
    assert len(got) == 243 and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.held_out]
    assert held and all(x.predicted == x.doc_id % 2 for x in held if x.doc_id < 900)
    assert toxicity.score_toxicity(docs(spark, []), labels.limit(0), toxicity.Settings()).count() == 0


def test_gradients_by_differences():
    import numpy as np
    net = toxicity.Network(toxicity.Settings(window=5, hidden=3, width=4))
    ids = np.array([[0, 1, 2, 1, -1], [2, 0, -1, -1, -1]], np.int32)
    vec = np.random.default_rng(0).normal(size=(3, 4)).astype(np.float32)
    logits, tape = net.run(net.gates(vec), ids, keep=True)
    grad, _ = net.backward(tape, ids, np.array([1.0, 0.0], np.float32))
    for name in ("u", "att", "out"):
        flat = net.w[name].reshape(-1)
        for k in (0, len(flat) - 1):
            old, e = flat[k], 1e-2
            flat[k] = old + e
            up = net.run(net.gates(vec), ids)[0][0]
            flat[k] = old - e
            down = net.run(net.gates(vec), ids)[0][0]
            flat[k] = old
            assert grad[name].reshape(-1)[k] == pytest.approx((up - down) / (2 * e), abs=2e-2)


def test_token_counts_over_small_blocks(spark):
    texts = [(i, "word " * (i % 7 * 40)) for i in range(50)] + [(7, ""), (None, None)]
    got = token_files.count_tokens(docs(spark, texts), _bpe_ids, END_OF_DOCUMENT, block_bytes=64)
    coder = prefix_bpe.coder_of(RANKS, __import__("public_tokenizers").PATTERN)
    want = [(i, len(coder.encode_packed(t or "")) // 4) for i, t in texts]
    key = lambda x: (x[0] is None, x)
    assert sorted(rows(got), key=key) == sorted(want, key=key)


def test_prefix_encoder_equals_merging_and_edits():
    e = prefix_bpe.PrefixEncoder(prefix_bpe.read_ranks(RANKS))
    r = random.Random(5)
    for _ in range(300):
        piece = "".join(r.choice("theingandoé ") for _ in range(r.randint(1, 40))).encode()
        last = e.extend(piece, [])
        assert e.path(last) == e.merge(piece)
        at = r.randint(0, len(piece))
        new, edited = e.edit(piece, last, at, min(2, len(piece) - at), b"xy")
        assert edited == e.extend(new, [])


def test_tiles_find_reordered_passages(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [(1, "x " * 50 + "Zeta eta theta iota kappa. y alpha, beta gamma delta epsilon"), (2, "alpha beta gamma"), (3, None), (3, item)]
    bench = spark.createDataFrame([(9, item), (10, None), (11, "solo words"), (9, item)], "item_id long, text string")
    got = tiling.contaminated(docs(spark, texts), bench)
    assert sorted((r.doc_id, r.item_id, r.coverage, r.tiles) for r in got.collect()) == [(1, 9, 1.0, 2), (3, 9, 1.0, 1)]
    assert tiling.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def test_archives_and_index(spark):
    pages = spark.createDataFrame([(5, "http://b.org/x", "<p>"), (2, "http://a.org/", "<p>"), (3, None, None), (4, "::bad", ""),
                                   (None, "http://a.org/", "<p>"), (6, "http://a.org/", "long")], "page_id long, url string, html string")
    index, records = warc.archive_round_trip(pages, F.timestamp_seconds(F.lit(0) + F.coalesce("page_id", F.lit(0))))
    assert {(r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in records.collect()} == {
        (2, "response", 3, None), (5, "revisit", 3, 2), (None, "revisit", 3, 2), (3, "response", 0, None), (4, "revisit", 0, 3),
        (6, "response", 4, None)}
    keys = [(r.url_key, r.ts) for r in index.orderBy("range", "place").collect()]
    assert keys == sorted(keys)
    r = random.Random(2)
    for k in range(9):
        runs = [sorted((r.randint(0, 9),) for _ in range(r.randint(0, 6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_licenses_are_inherited(spark):
    files = spark.createDataFrame([(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "code only here"),
                                   (3, "d/e.py", None), (4, "d/f.py", "some words\nLicensed under CC BY-NC 4.0.\nand many more words of text here")],
                                  "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan_licenses(files, F.col("path")).collect()}
    assert got == {1: ("MIT", "license_file"), 2: ("MIT", "inherited"), 3: (None, "none"), 4: ("CC-BY-NC-4.0", "header")}


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(s), root[i]) for i, s in sets.items()}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, size, percent):
    r = random.Random(size)
    texts = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "one two")]
    for g in range(6):
        base = [r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(90)]
        for _ in range(12):
            words = list(base)
            for _ in range(r.randint(0, 5)):
                words[r.randrange(90)] = str(r.random())
            texts.append((len(texts), " ".join(words)))
    got = ngram_join.jaccard_components(docs(spark, texts), size, percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(texts, size, percent)
    assert ngram_join.jaccard_components(docs(spark, []), size, percent).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(links).collect()} == {0}


def test_main_text():
    page = ('<html><head><title>t</title></head><body><nav><a href="/">menu</a></nav><div class="cookie notice">We use cookies</div>'
            "<article><h1>A &amp; B</h1><p>One<br>two<p>three  four<form>name</form><div id=comments><p>me too</div></article>"
            "<footer>&copy; x</footer>")
    assert html_text.main_text(page) == "A & B\nOne two\nthree four"
    assert html_text.main_text("") == "" and html_text.main_text("<p>" * 10_000) == ""


def test_digest_of_decoded_bytes(spark):
    got = prefix_bpe.encode_documents(docs(spark, [(1, "héllo  wörld\n\n 12"), (2, None)]), RANKS, __import__("public_tokenizers").PATTERN)
    assert {r.doc_id: r.decoded_sha256 for r in got.collect()} == {
        1: hashlib.sha256("héllo  wörld\n\n 12".encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
