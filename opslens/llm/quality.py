"""Quality rules whose cutoffs come with a guarantee on false rejections.

A rule rejects a document whose signal lies above a cutoff. The rules of all signals
tighten together: place j of the grid gives every signal its j-th cutoff, so the places
are one nested family of whole rule sets. For each stratum the places are tested from the
most lenient on: the test of a place is the exact binomial tail of the good labelled
documents that any of its rules rejects. Testing stops at the first place that fails, so
the sequence keeps its level without further correction; the sequences of the strata
share ``delta`` (Bonferroni). A signal that rejects no bad labelled document at the place
is then left out, which only rejects less. With probability 1 - delta no stratum therefore loses more
than a share ``alpha`` of its good documents. Among the certified places the one that
rejects most bad documents at the least cost in good ones is used. A stratum needs
log(delta / strata) / log(1 - alpha) good labels at least (86 with four strata); with
fewer it gets no cutoffs and keeps everything that passes the base rule.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import SPACES, materialise

#: Cutoffs of each signal, as many of each, most lenient last; a document above a cutoff is rejected.
GRID: dict[str, list[float]] = {
    "symbols_per_word": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0],
    "duplicate_line_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "repeat_word_share": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.7, 0.9],
    "capital_share": [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "mark_per_word": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0],
}
ALPHA, DELTA, BASE_WORDS, BASE_REPEAT_PERCENT = 0.05, 0.05, 50, 50
#: A certified place pays this much for each share of the good documents it rejects, in shares of the bad ones.
GOOD_COST = 20.0
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The counts behind the rules, added to each row.

    Null texts count as empty. A repeated three-word window is found by sorting the
    windows' hashes with their places in one array of longs; windows whose hashes meet
    are compared as strings, so the count is exact.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_words", F.array_remove(F.split(t, f"{SPACES}+"), ""))
    w = F.col("_words")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": _count(t, r"[#*$%&|<>]"),
        "_lines": lines,
        "n_capitals": _count(t, r"\p{Lu}"),
        "n_marks": _count(t, r"[!?]"),
        "_keys": F.when(F.size(w) >= 3, F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 31).bitwiseOR(
                i.cast("long"))))).otherwise(F.array().cast("array<bigint>")),
    })
    key, lines = F.col("_keys"), F.col("_lines")
    top = lambda x: F.shiftright(x, 31)
    rows = rows.withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
    # places whose hash has an equal neighbour
    rows = rows.withColumn("_met", F.filter(key, lambda x, i: (
        top(x) == top(F.get(key, i - 1))) | (top(x) == top(F.get(key, i + 1)))))
    rows = rows.withColumn("_win", F.sort_array(F.transform("_met", lambda x: _window(w, x))))
    v = F.col("_win")
    rows = rows.withColumn("_at", F.sort_array(F.transform(F.filter(v, lambda x, i: (
        x["w"] == F.get(v, i - 1)["w"]) | (x["w"] == F.get(v, i + 1)["w"])),
        lambda x: x["p"])))
    at = F.col("_at")
    rows = rows.withColumn("n_repeat_words", F.aggregate(
        F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(
            F.coalesce(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x).cast("long"))
    return rows.drop("_words", "_lines", "_keys", "_met", "_win", "_at")


def _window(w: Column, x: Column) -> Column:
    p = x.bitwiseAND(F.lit(2**31 - 1)).cast("int")
    return F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("w"), p.alias("p"))


def with_signals(features: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return features.withColumns({
        "symbols_per_word": F.col("n_symbols") / words,
        "duplicate_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_share": F.col("n_repeat_words") / words,
        "capital_share": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "mark_per_word": F.col("n_marks") / words,
    })


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(at most k of n) at ``rate``, summed term by term in logarithms; 1 where k is not below the mean."""
    odds = math.log(rate / (1 - rate))
    first = n * math.log1p(-rate)
    zero = F.struct(first.alias("log"), F.exp(first).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), zero, lambda s, i: F.struct(
        (s["log"] + F.log((n - i + 1) / i) + odds).alias("log"),
        (s["sum"] + F.exp(s["log"] + F.log((n - i + 1) / i) + odds)).alias("sum")), lambda s: s["sum"])
    return F.when(k >= n * rate, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(tail)


def choose_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a certified place, as a map from signal to its cutoff.

    ``labelled`` has stratum, good (0/1) and the signals, once per labelled document that
    passes the base rule. All labelled rows are counted; the histogram has strata x
    places rows. A document counts at the tightest place that one of its signals passes.
    """
    places = len(next(iter(GRID.values())))
    above = {s: sum(((F.col(s) > c).cast("int") for c in g), F.lit(0)) for s, g in GRID.items()}
    hist = materialise(labelled.groupBy("stratum", F.greatest(*above.values()).alias("above")).agg(
        F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"),
        *[F.max(F.when(F.col("good") == 0, a)).alias(s) for s, a in above.items()]), "quality-histogram")
    strata = hist.select("stratum").distinct().count()
    # places, the most lenient first; a place rejects the bins from it on
    tests = hist.groupBy("stratum").agg(F.sum("good").alias("goods"), F.sum("bad").alias("bads"),
                                        F.collect_list(F.struct("above", "good", "bad")).alias("bins"),
                                        F.struct(*[F.max(s).alias(s) for s in GRID]).alias("reach"))
    tests = tests.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(places))))
    over = lambda name: F.aggregate("bins", F.lit(0).cast("long"), lambda s, b: s + F.when(
        b["above"] >= F.col("place"), b[name]).otherwise(0))
    tests = tests.withColumns({"good_lost": over("good"), "bad_lost": over("bad")})
    tests = tests.withColumn("p", binomial_tail(F.col("good_lost"), F.col("goods"), alpha))
    tests = tests.withColumn("worst", F.max("p").over(Window.partitionBy("stratum").orderBy(F.desc("place"))))
    value = F.col("bad_lost") / F.greatest("bads", F.lit(1)) - GOOD_COST * F.col("good_lost") / F.greatest("goods", F.lit(1))
    best = tests.where((F.col("worst") <= delta / max(strata, 1)) & (F.col("bad_lost") > 0)).groupBy("stratum").agg(
        F.max_by(F.struct("place", "reach"), F.struct(value, "place")).alias("best"))
    cutoffs = F.array_compact(F.array(*[F.when(F.col("best.reach")[s] >= F.col("best.place"), F.struct(
        F.lit(s), F.get(F.array(*map(F.lit, g)), F.col("best.place") - 1))) for s, g in GRID.items()]))
    return best.select("stratum", F.map_from_entries(cutoffs).alias("cutoffs"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
                  stratum: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``kept`` and the signals that rejected it.

    A stratum is a language code of two or three letters, or "other"; so there are at
    most 18,253 of them, which bounds the table of cutoffs that is broadcast. Of repeated
    labels the lowest counts; labels other than 0 and 1 are not used. Empty tables give
    no row. Columns of ``docs`` beyond doc_id, text and lang are not read,
    but those named in ``carry`` come with their row.
    """
    lang = F.col("lang") if stratum is None else stratum
    code = F.when(lang.rlike("^[a-z]{2,3}$"), lang).otherwise("other")
    rows = docs.select("doc_id", "text", code.alias("stratum"), *carry)
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = text_features(rows.withColumn("n_lines", F.size(F.split(t, "\n")))).drop("text")
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    rows = materialise(with_signals(rows).withColumn("base_failed", failed), "quality-features")
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").cast("long").alias("good"))
    cut = choose_cutoffs(rows.where("not base_failed").join(marks, "doc_id"), alpha, delta)
    rows = rows.join(F.broadcast(cut), "stratum", "left")
    over = F.array_compact(F.array(*[F.when(F.col(s) > F.element_at("cutoffs", F.lit(s)), s) for s in GRID]))
    return rows.withColumn("rejected_by", over).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).select(
        "doc_id", *BASE, "base_failed", "kept", "stratum", "rejected_by", *carry)
