import pytest
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.operators import funnel as Fn
from troughline.operators import quality

SCHEMA = """subject_id string, record_id string, nbp_timestamp_s double, phase3_duration_s double, pre_window_valid boolean,
reject_reason string, is_occlusion_signature boolean, nadir_depth_frac double, pre_window_quality double"""
NAN = float("nan")


def rows():
    spec = (
        [(V.NO_SIGNAL, NAN, False)] * 10 + [(V.SIGNAL_MOSTLY_MISSING, NAN, False)] + [(V.BASELINE_UNSTABLE, NAN, False)] * 2
        + [(V.NO_DIP, NAN, True)] * 3 + [(V.NOT_ALIGNED_LEGACY, NAN, True)] + [(V.SHORT_RUN, 4.0, True), (V.SHORT_RUN, 5.0, True)]
        + [(None, d, True) for d in (17.0, 18.0, 12.0, 14.0, 10.0)] + [(V.NOT_RECOVERED, 30.0, True)]
    )
    return [(f"p{i % 4}", f"r{i % 5}", float(i), d, ok, reason, reason is None, 0.1 if d == d else NAN, i / 10) for i, (reason, d, ok) in enumerate(spec)]


@pytest.fixture
def inv(make):
    return make(SCHEMA, rows())


def test_funnel_stages(inv):
    got = {r["stage"]: (r["events"], r["patients"]) for r in Fn.funnel(inv).collect()}
    data = rows()
    subjects = lambda keep: len({r[0] for r in data if keep(r)})
    assert list(got.values()) == [
        (25, 4), (10, 0), (1, 0), (14, 0), (12, subjects(lambda r: r[4])), (3, 0), (1, 0), (2, 0), (1, 0),
        (2, subjects(lambda r: r[5] is None and r[3] >= 15)), (6, subjects(lambda r: r[5] in (None, V.NOT_RECOVERED) and r[3] >= 10)),
    ]
    assert list(got)[-2:] == ["occlusion_signature_primary_15s", "occlusion_signature_sensitivity_10s"]


def test_results_do_not_depend_on_order_or_partitions(inv):
    a = Fn.funnel(inv.orderBy(F.rand(1)).repartition(7)).collect()
    assert a == Fn.funnel(inv.coalesce(1)).collect()


def test_thresholds_rename_their_stages(inv):
    assert Fn.funnel(inv, 12.5, 5.0).collect()[-2]["stage"] == "occlusion_signature_primary_12.5s"


def test_missing_column_is_named(inv):
    with pytest.raises(ValueError, match="reject_reason"):
        Fn.funnel(inv.drop("reject_reason"))


def test_subject_without_signal_has_zero_yields(make):
    df = make(SCHEMA, [("p9", "r", float(i), None, False, V.NO_SIGNAL, False, None, None) for i in range(5)])
    r = Fn.per_subject(df).first()
    assert (r.n_total, r.n_evaluable, r.n_no_pleth, r.n_occlusion_signature_primary, r.has_occlusion_signature_sensitivity) == (5, 0, 5, 0, False)
    assert [x.pct_of_candidates for x in Fn.yields(df).collect()] == [0.0, 0.0]
    assert Fn.yield_subjects(df).count() == 0


def test_empty_inventory(make):
    assert [r["events"] for r in Fn.funnel(make(SCHEMA, [])).collect()] == [0] * 11


def test_headline_and_reasons(inv):
    h = Fn.headline(inv).first()
    assert (h.n_candidates, h.n_records, h.excluded_no_pleth, h.qc_pass_pre_window_events, h.primary_events, h.sensitivity_events) == (25, 5, 10, 12, 2, 6)
    assert Fn.reason_counts(inv).first().asDict() == {"reason": V.NO_SIGNAL, "n": 10}


def test_picks(inv):
    assert Fn.most_represented(inv, "never").count() == 0
    with pytest.raises(Exception, match="no such row"):
        Fn.first_row(inv.where("reject_reason = 'never'"), [], "such row").collect()
    assert Fn.first_row(inv.where(F.col("reject_reason") == V.NO_DIP), [-F.col("pre_window_quality")]).first().nbp_timestamp_s == 15.0
    hit = Fn.preferred_event(inv, (("p3", 19.4),), ("p2",)).first()
    assert (hit.priority, hit.nbp_timestamp_s) == (0, 19.0)
    assert Fn.preferred_event(inv, (("p3", 500.0),), ("p0",)).first().nbp_timestamp_s == 20.0
    assert [r.reason for r in Fn.unusable_panels(inv).collect()] == [V.NO_SIGNAL, V.BASELINE_UNSTABLE, V.NO_DIP]


def test_flow_counts_and_identities(make):
    def inv_row(i, reason):
        return (f"p{i % 3}", "r", float(i), None, reason not in (V.NO_SIGNAL, V.SIGNAL_MOSTLY_MISSING), reason, reason is None, None, None)

    reasons = [V.NO_SIGNAL] * 9 + [V.SIGNAL_MOSTLY_MISSING] + [None] * 4 + [V.SHORT_RUN] * 2 + [V.NOT_RECOVERED] * 4 + [V.NOT_ALIGNED] * 2 + [V.BASELINE_IMPLAUSIBLE] + [V.NO_DIP] * 18
    inv = make(SCHEMA, [inv_row(i, r) for i, r in enumerate(reasons)])
    strata = [V.STRATUM_POSITIVE] * 4 + [V.STRATUM_NEAR_MISS] * 3 + [V.STRATUM_NEGATIVE] * 5
    calls = [V.PRESENT] * 3 + [V.ABSENT] * 7 + [V.INDETERMINATE] * 2
    manifest = make("card_id string, stratum string, subject_id string", [(str(i), s, f"p{i % 2}") for i, s in enumerate(strata)])
    reader = make("card_id string, call string", [(str(i), c) for i, c in enumerate(calls)])
    flow = Fn.flow_counts(inv, manifest, reader)
    f = flow.first()
    assert (f.n_evaluable, f.n_near_miss_pool, f.n_negative_pool, f.n_uncovered, f.coverage) == (31, 6, 18, 3, 28)
    assert (f.weight_positive, f.weight_near_miss, f.weight_negative) == (1.0, 2.0, 18 / 5)
    assert f.n_gallery_subjects == 2
    quality.enforce(quality.flow_identities(flow))
    with pytest.raises(ValueError, match="detector-positive census.*|gallery = "):
        quality.enforce(quality.flow_identities(Fn.flow_counts(inv, manifest.limit(11), reader)))


def test_manifest_lines(inv, make):
    files = make("path string, sha256 string, bytes bigint", [("funnel.csv", "ab", 3)])
    lines = quality.manifest(inv, files, "src", F.lit("1970-01-01T00:00:00+00:00")).collect()
    import json

    header = json.loads(lines[0]["json"])
    assert header["headline_counts"]["n_candidates"] == 25
    assert header["yield"]["primary"]["events"] == 2 and header["thresholds"]["sensitivity_phase3_s"] == 10.0
    listed = {x["name"] for x in lines if x["kind"] == "subject"}
    assert listed == {f"{r.tier}/{r.subject_id}" for r in Fn.yield_subjects(inv).collect()}
    assert [x["name"] for x in lines if x["kind"] == "file"] == ["funnel.csv"]


def test_tier_counts(inv):
    t = Fn.tier_counts(inv).first()
    assert (t.n_measured, t.n_signature, t.n_sensitivity_tier, t.n_primary_tier, t.gate_ok, t.sensitivity_ok, t.primary_ok) == (8, 5, 6, 3, True, False, False)
