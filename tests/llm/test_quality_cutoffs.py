import math

from pyspark.sql import functions as F

from opslens.llm import quality

SIGNALS = list(quality.GRID)
SCHEMA = "stratum string, good long, " + ", ".join(f"{s} double" for s in SIGNALS)


def labelled(spark, *groups):
    """Groups of (stratum, rows, good, signals by name; the others are 0)."""
    return spark.createDataFrame([(stratum, good, *[float(signals.get(s, 0)) for s in SIGNALS])
                                  for stratum, n, good, signals in groups for _ in range(n)], SCHEMA)


def cutoffs(df):
    return {r.stratum: r.cutoffs for r in quality.choose_cutoffs(df).collect()}


def test_strata_with_enough_good_labels_get_cutoffs(spark):
    need = math.ceil(math.log(quality.DELTA / 2) / math.log(1 - quality.ALPHA))
    got = cutoffs(labelled(spark, ("de", need, 1, {}), ("de", 5, 0, {"symbols_per_word": 0.6}),
                           ("es", need - 1, 1, {}), ("es", 5, 0, {"symbols_per_word": 0.6})))
    assert got == {"de": {"symbols_per_word": 0.5}}


def test_a_signal_without_bad_documents_rejects_nothing(spark):
    got = cutoffs(labelled(spark, ("en", 995, 1, {}), ("en", 5, 1, {"capital_share": 0.95}), ("en", 50, 0, {"mark_per_word": 0.3})))
    assert got == {"en": {"mark_per_word": 0.2}}


def test_testing_stops_where_good_documents_are_lost(spark):
    # At the strict places a third of the good documents would go.
    got = cutoffs(labelled(spark, ("en", 200, 1, {}), ("en", 100, 1, {"symbols_per_word": 0.16}),
                           ("en", 40, 0, {"symbols_per_word": 0.12}), ("en", 10, 0, {"symbols_per_word": 3.0})))
    assert got == {"en": {"symbols_per_word": 2.0}}
    # Where the signal does not separate at all, there is no cutoff.
    assert cutoffs(labelled(spark, ("en", 200, 1, {"symbols_per_word": 3}), ("en", 200, 0, {"symbols_per_word": 3}))) == {}


def test_no_labels_and_only_good_labels(spark):
    assert cutoffs(labelled(spark)) == {} == cutoffs(labelled(spark, ("en", 300, 1, {})))


def test_tail_equals_the_sum_of_terms(spark):
    for k, n in ((0, 40), (1, 90), (4, 300), (30, 300)):
        want = 1.0 if k >= n * 0.05 else sum(math.comb(n, i) * 0.05 ** i * 0.95 ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.05)).first()[0]
        assert math.isclose(got, want, rel_tol=1e-9)
