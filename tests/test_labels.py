import pytest
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.functions import labels as L


def values(df, c="x"):
    return [r[c] for r in df.orderBy("i").collect()]


def test_blank_and_nan_become_null(make):
    df = make("i int, s string, d double", [(0, "", float("nan")), (1, "a", 1.0), (2, None, None)])
    assert values(df.withColumn("x", L.blank_to_null(F.col("s")))) == [None, "a", None]
    assert values(df.withColumn("x", L.nan_to_null(F.col("d")))) == [None, 1.0, None]


def test_rated_drops_blank_calls(make):
    df = make("i int, call string", [(0, " Present\t"), (1, "  "), (2, None), (3, "ABSENT")])
    assert values(L.rated(df, "call"), "call") == ["present", "absent"]


def test_flags(make):
    df = make("i int, s string", [(0, "TRUE"), (1, "yes"), (2, "0"), (3, None), (4, "junk")])
    assert values(df.withColumn("x", L.truthy(F.col("s")))) == [True, True, False, None, False]
    assert values(df.withColumn("x", L.tolerant_flag(F.col("s")))) == [True, True, False, False, False]


def test_strict_recode_fails_on_unseen_and_null(make):
    ok = make("i int, s string", [(0, V.PRESENT), (1, V.ABSENT)])
    assert values(ok.withColumn("x", L.recode_strict(F.col("s"), V.CALL_CLASSES))) == ["present", "absent"]
    for bad in ("other", None):
        with pytest.raises(Exception, match="unexpected value"):
            make("i int, s string", [(0, bad)]).withColumn("x", L.recode_strict(F.col("s"), V.CALL_CLASSES)).collect()


def test_null_reason_is_success_and_nan_never_passes(make):
    df = make("i int, r string, d double", [(0, None, 15.0), (1, V.SHORT_RUN, 15.0), (2, V.NOT_RECOVERED, 20.0), (3, None, float("nan")), (4, None, None), (5, None, 14.9)])
    hit = L.reason_in(F.col("r"), V.PRIMARY_REASONS) & L.at_least(F.col("d"), 15.0)
    assert values(df.withColumn("x", hit)) == [True, True, False, False, False, False]
    assert values(df.withColumn("x", L.evaluable(F.col("r")))) == [True] * 6


def test_change_direction(make):
    p, a, i = V.PRESENT, V.ABSENT, V.INDETERMINATE
    pairs = [(p, p), (a, p), (p, i), (a, i), (i, a), (None, a)]
    df = make("i int, b string, a string", [(k, *x) for k, x in enumerate(pairs)])
    out = values(df.withColumn("x", L.change_direction(F.col("b"), F.col("a"))))
    assert out == ["unchanged", "to_present", "from_present", "to_indeterminate", "from_indeterminate", "other"]


def test_agreement_bands_have_inclusive_upper_bounds(make):
    ks = [-0.1, 0.0, 0.2, 0.21, 0.4, 0.6, 0.8, 0.81, float("nan"), None, float("inf")]
    df = make("i int, k double", list(enumerate(ks)))
    assert values(df.withColumn("x", L.agreement_band(F.col("k")))) == [
        "poor", "slight", "slight", "fair", "fair", "moderate", "substantial", "almost perfect", "undefined", "undefined", "undefined"]


def test_ratios_with_zero_denominator_are_null(make):
    df = make("i int, n bigint, d bigint", [(0, 1, 3), (1, 1, 0)])
    assert values(df.withColumn("x", L.safe_percent(F.col("n"), F.col("d")))) == [33.33, None]
    assert values(df.withColumn("x", L.safe_ratio(F.col("n"), F.col("d"))))[1] is None


def test_disagreement_categories_do_not_overlap(make):
    rows = [(r, d, m, c) for r in V.CALLS for d in (True, False) for m in V.CALLS for c in (0.5, 0.95)]
    df = make("reader_call string, detector_positive boolean, model_call string, model_confidence double", rows)
    flags = df.select(*[F.coalesce(L.disagreement_category(k), F.lit(False)).cast("int").alias(k) for k in L.DISAGREEMENT_CATEGORIES])
    assert all(sum(r) <= 1 for r in flags.collect())
    assert all(x > 0 for x in flags.groupBy().sum().first())
    with pytest.raises(ValueError):
        L.disagreement_category("nope")
