import pytest
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.functions.labels import rated
from troughline.operators import rating as R

P, A, I = V.PRESENT, V.ABSENT, V.INDETERMINATE


@pytest.fixture
def sources(make):
    reader = rated(make("card_id string, call string", [("a", P.upper()), ("b", f" {A} "), ("c", P), ("d", I), ("e", " "), ("f", A), ("only", P)]), "call", "reader_call").drop("call")
    model = R.load_model_calls(make("card_id string, call string, parsed_ok string", [("a", P, "true"), ("b", P, "true"), ("c", None, "false"), ("d", A, "true"), ("e", P, "true"), ("f", I, "true"), ("g", P, None)]))
    manifest = make("card_id string, subject_id string, detector_call string", [(c, s, d) for c, s, d in zip("abcdeg", "112233", (P, P, A, A, P, A))])
    return manifest, reader, model


def test_join_and_drop_counts(sources):
    joined = R.join_sources(*sources)
    assert sorted(r.card_id for r in joined.collect()) == ["a", "b", "c", "d"]
    assert R.source_drops(*sources).first().asDict() == {
        "n_reader": 6, "n_model": 7, "n_manifest": 6, "n_joined": 4, "n_dropped_reader": 2, "n_dropped_model": 0, "n_dropped_manifest": 1}


def test_model_log_needs_its_key(make):
    with pytest.raises(ValueError, match="card_id"):
        R.load_model_calls(make("row_id string, call string, parsed_ok boolean", []))


def long_of(sources):
    return R.long_predictors(R.join_sources(*sources), {"detector": ("detector_call", None), "model": ("model_call", "model_parsed_ok")}, "reader_call", ["subject_id"])


def test_confusion_is_zero_filled(sources):
    out = {(r.predictor, r.reference_value, r.predictor_value): r["count"] for r in R.confusion(long_of(sources)).collect()}
    assert len(out) == 9 + 12
    assert out[("detector", P, P)] == 1 and out[("detector", P, A)] == 1 and out[("detector", A, P)] == 1 and out[("detector", I, A)] == 1
    assert out[("model", P, V.PARSE_FAILURE)] == 1 and out[("model", A, P)] == 1 and out[("model", A, A)] == 0
    assert sum(n for (p, _, _), n in out.items() if p == "model") == 4


def test_metrics_exclude_uncallable_rows(sources):
    out = {(r.predictor, r.metric): (r.point_estimate, r.n_used_for_metric) for r in R.binary_metrics(long_of(sources), "subject_id", replicates=20).collect()}
    assert out[("detector", "precision")] == (0.5, 2) and out[("detector", "recall")] == (0.5, 2) and out[("detector", "specificity")] == (0.0, 1)
    assert out[("model", "precision")] == (0.5, 2) and out[("model", "recall")] == (1.0, 1) and out[("model", "specificity")] == (0.0, 1)


def test_uncallable_rates(sources):
    out = {r.predictor: r for r in R.uncallable_rates(long_of(sources), "subject_id", replicates=20).collect()}
    assert (out["detector"].indeterminate_rate, out["detector"].ci_high) == (0.0, 0.0)
    assert (out["model"].indeterminate_count, out["model"].parse_failure_count, out["model"].total_n, out["model"].indeterminate_rate) == (0, 1, 4, 0.25)


def test_cluster_scope_is_checked(sources):
    with pytest.raises(ValueError):
        R.binary_metrics(long_of(sources), "subject_id", cluster_scope="some")


def test_unresolved_key_fails_the_job(make):
    left, right = make("k string", [("a",), ("b",)]), make("k string, v string", [("a", "1")])
    with pytest.raises(Exception, match="thing did not resolve for b"):
        R.resolve_all(left, right, "k", "v", "thing").collect()


def pairs(make, ab):
    return make("a string, b string, c string", [(x, y, f"s{i % 3}") for i, (x, y) in enumerate(ab)])


def test_kappa_by_hand(make):
    df = pairs(make, [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15)
    r = R.agreement(df, "a", "b").first()
    assert (r.n, r.percent_agreement, r.cohen_kappa, r.categories) == (50, 0.7, pytest.approx(0.4), ["n", "y"])


@pytest.mark.parametrize("ab, kappa", [([("y", "y")] * 4, 1.0), ([("y", "y"), ("n", "n")], 1.0), ([("y", "n"), ("n", "y")], -1.0), ([("y", "n")] * 2, 0.0)])
def test_kappa_edges(make, ab, kappa):
    assert R.agreement(pairs(make, ab), "a", "b").first().cohen_kappa == kappa


def test_reliability(make):
    r = R.reliability(pairs(make, [(P, P)] * 6 + [(P, A)] * 2 + [(A, A)] * 7 + [(A, I)] * 3), "a", "b", "c", 40).first()
    assert r.n == 18 and r.percent_agreement == pytest.approx(13 / 18) and r.agreement_ci_low <= r.percent_agreement <= r.agreement_ci_high
    assert r.kappa_binary > r.kappa_3class and r.band_binary == "substantial"


def test_paired_agreement_and_tidy(make):
    first = make("row_id string, call string", [("1", P), ("2", A), ("3", None), ("4", P), ("x", P)])
    second = make("row_id string, call string", [("1", P), ("2", P), ("3", None), ("4", P), ("y", None)])
    r = R.paired_agreement(first, second).first()
    assert (r.n_first, r.n_rerun, r.n_paired, r.n_agree, r.overall_agreement_pct) == (5, 5, 4, 2, 50.0)
    assert (r.parse_failure_rate_first_pct, r.parse_failure_rate_rerun_pct, r.n_missing_from_first, r.n_missing_from_rerun) == (20.0, 40.0, 1, 1)
    tidy = {x.metric: x.value for x in R.tidy(R.paired_agreement(first, second)).collect()}
    assert tidy[f"confusion[{A}->{P}]"] == 1.0 and tidy[f"confusion[{P}->{P}]"] == 2.0 and len(tidy) == 18
    assert {(x.row_id, x.missing_from) for x in R.unpaired(first, second).collect()} == {("x", "second"), ("y", "first")}


def test_concordance(make):
    bridge = make("card_id string, stratum string, row_id string", [("a", "s1", "r1"), ("b", "s1", "r2"), ("c", "s2", "r3"), ("d", "s2", "r4"), ("lost", "s2", None)])
    canon = make("row_id string, call string, parsed_ok boolean", [("r1", P, True), ("r2", A, True), ("r3", P, True), ("r4", I, True), ("r9", P, True)])
    variant = make("variant string, card_id string, call string, parsed_ok boolean", [("v", "a", P, True), ("v", "b", P, True), ("v", "c", P, True), ("v", "d", I, True), ("v", "lost", None, False), ("v", "unbridged", P, True)])
    p = R.variant_pairs(variant, bridge, canon)
    r = R.concordance(p).first()
    assert (r.n_total, r.n_compare, r.n_matched, r.concordance_pct, r.var_parse_failure, r.var_pos_canon_neg, r.other_mismatch) == (5, 4, 3, 75.0, 1, 1, 0)
    assert r.var_positive_rate_pct == 75.0
    assert {(x.stratum, x.n, x.matched, x.conc_pct) for x in R.concordance_by_stratum(p).collect()} == {("s1", 2, 1, 50.0), ("s2", 2, 2, 100.0)}
    assert tuple(R.canonical_over_bridge(bridge, canon).first()) == (4, 2, 1, 1, 50.0)


def test_two_references_and_delta(make):
    rows = [(P, P)] * 3 + [(A, P)] * 2 + [(P, A)] + [(A, A)] * 5 + [(I, P)]
    df = make("pass1 string, det string, subject string, pass2 string", [(r, d, f"s{i % 4}", P if i == 3 else r) for i, (r, d) in enumerate(rows)])
    m = R.two_reference_metrics(df, {"detector": "det"}, {"pass1": "pass1", "pass2": "pass2"}, "subject", 20)
    point = {(r.metric, r.reference): r.point_estimate for r in m.collect()}
    assert point[("precision", "pass1")] == 0.6 and point[("recall", "pass1")] == 0.75 and point[("specificity", "pass1")] == pytest.approx(5 / 7)
    delta = {r.metric: r for r in R.reference_delta(m).collect()}
    assert delta["precision"].delta == pytest.approx(0.2) and delta["precision"].pass2_point == 0.8


def test_change_log(make):
    second = make("card_id string, stratum string, call string, confidence string", [("a", "s", P, "high"), ("b", "s", A, "low"), ("c", "t", I, None)])
    first = make("card_id string, pass1_call string", [("a", A), ("b", A)])
    log = R.change_log(second, first, make("card_id string, is_occlusion_signature string", [("a", "True")]), make("card_id string, call string", [("a", P.upper())]))
    rows = {r.card_id: r for r in log.collect()}
    assert (rows["a"].direction, rows["a"].detector_call, rows["a"].language_model_call) == ("to_present", P, P)
    assert (rows["b"].changed, rows["c"].changed, rows["c"].direction) == (False, True, "to_indeterminate")
    assert tuple(R.net_change(log).first()) == (1, 0, 1, 1, 1)
    assert {tuple(r) for r in R.change_by_stratum(log).collect()} == {("s", 2, 1), ("t", 1, 1)}


def test_three_way_cells_in_class_order(make):
    df = make("r string, m string", [("absent", "present"), ("present", "absent"), ("present", "present"), ("present", "present"), ("indeterminate", "absent")])
    assert [tuple(x) for x in R.three_way_cells(df, ["r", "m"]).collect()] == [
        ("present", "present", 2), ("present", "absent", 1), ("indeterminate", "absent", 1), ("absent", "present", 1)]
    assert {tuple(x) for x in R.marginals(df, ["r"]).collect()} == {("r", "present", 3), ("r", "absent", 1), ("r", "indeterminate", 1)}
