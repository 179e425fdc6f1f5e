import pytest
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.operators import rating, reweight

P, A, I = V.PRESENT, V.ABSENT, V.INDETERMINATE
LONG = "predictor string, reference_call string, predictor_call string, parsed_ok boolean, weight double, subject string"


def test_weights_and_their_errors(make):
    frame = make("stratum string", [("a",)] * 10 + [("b",)] * 4)
    sample = make("stratum string", [("a",)] * 4 + [("b",)] * 4)
    w = reweight.stratum_weights(frame, sample)
    assert {tuple(r) for r in w.collect()} == {("a", 10, 4, 2.5), ("b", 4, 4, 1.0)}
    with pytest.raises(Exception, match="sampled must be positive"):
        reweight.stratum_weights(frame, sample.where("stratum = 'a'")).collect()
    with pytest.raises(Exception, match="universe smaller than sample"):
        reweight.stratum_weights(frame.where("stratum = 'a'"), sample).collect()
    with pytest.raises(Exception, match="no weight for stratum zzz"):
        reweight.assign_weights(make("stratum string", [("zzz",)]), w).collect()


def test_coverage(make):
    w = make("stratum string, universe bigint, sampled bigint, weight double", [("a", 60, 6, 10.0), ("b", 20, 20, 1.0)])
    rows = {r.row_kind: r for r in reweight.partition_coverage(w, 100, "rest").collect() if r.row_kind != "stratum"}
    assert (rows["uncovered_remainder"].universe, rows["uncovered_remainder"].weight, rows["coverage"].weight) == (20, None, 0.8)
    for bad in (79, 0):
        with pytest.raises(Exception, match="exceed|must be positive"):
            reweight.partition_coverage(w, bad).collect()


def cards(make, weight):
    calls = [(P, P, True), (A, P, True), (P, A, True), (A, A, True), (I, P, True), (P, P, False), (P, None, True), (A, A, True)]
    return make(LONG, [("m", r, p, ok, weight(i), f"s{i % 3}") for i, (r, p, ok) in enumerate(calls)])


def test_hand_computed_weighted_ratio(make):
    out = {r.metric: r for r in reweight.weighted_metrics(cards(make, lambda i: float(i + 1))).collect()}
    assert out["precision"].point == pytest.approx(1 / 3) and out["precision"].weighted_denominator == 3.0
    assert out["recall"].point == pytest.approx(1 / 4) and out["specificity"].point == pytest.approx(12 / 14)


def test_unit_weights_equal_plain_metrics_and_intervals(make):
    long = cards(make, lambda i: 1.0)
    pop = {r.metric: r for r in reweight.weighted_intervals(long, "subject", replicates=40).collect()}
    plain = {r.metric: r for r in rating.binary_metrics(long, "subject", replicates=40, cluster_scope="all").collect()}
    for m in rating.METRICS:
        assert (pop[m].point_estimate, pop[m].ci_low, pop[m].ci_high, pop[m].n_eligible_cards) == (
            plain[m].point_estimate, plain[m].ci_low, plain[m].ci_high, plain[m].n_used_for_metric)


def test_zero_denominator_is_null(make):
    long = make(LONG, [("m", A, A, True, 1.0, "s1"), ("m", A, A, True, 1.0, "s2")])
    assert {r.metric: r.point for r in reweight.weighted_metrics(long).collect()} == {"precision": None, "recall": None, "specificity": 1.0}


def test_union_types_its_missing_column(make):
    long = cards(make, lambda i: 1.0)
    both = reweight.sample_and_population(rating.binary_metrics(long, "subject", replicates=5), reweight.weighted_intervals(long, "subject", replicates=5))
    assert dict(both.dtypes)["weighted_denominator"] == "double" and both.count() == 6
    assert both.where(F.col("estimate_kind") == "gallery").where("weighted_denominator IS NOT NULL").count() == 0
