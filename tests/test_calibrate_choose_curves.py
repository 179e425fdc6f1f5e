import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.operators import calibrate as C
from troughline.operators import choose, curves

SCHEMA = """subject_id string, record_id string, phase3_duration_s double, nadir_depth_frac double, alignment_offset_s double,
pre_window_valid boolean, recovered boolean, reject_reason string"""
NAN = float("nan")
ROWS = [
    ("p1", "r", 20.0, 0.10, -45.0, True, True, None), ("p1", "r", 16.0, 0.10, 25.0, True, True, None), ("p2", "r", 12.0, 0.10, 5.0, True, True, V.SHORT_RUN),
    ("p2", "r", 18.0, 0.15, 0.0, True, True, None), ("p3", "r", 20.0, 0.25, 0.0, True, True, None), ("p3", "r", 9.0, 0.10, 0.0, True, True, V.SHORT_RUN),
    ("p4", "r", NAN, NAN, NAN, False, False, V.BASELINE_UNSTABLE), ("p4", "r", 30.0, 0.05, 10.0, True, False, V.NOT_RECOVERED),
    ("p5", "r", 20.0, 0.10, -20.0, True, True, None), ("p6", "r", 20.0, 0.10, NAN, True, True, None), ("p6", "r", NAN, NAN, NAN, True, False, V.NO_DIP)]


def test_offsets_summary_and_windows(make):
    offsets = C.qualifying_offsets(make(SCHEMA, ROWS))
    xs = sorted(r.alignment_offset_s for r in offsets.collect())
    assert xs == [-45.0, -20.0, 0.0, 5.0, 10.0, 25.0]
    s = C.offset_summary(offsets).first()
    assert (s.n_qualifying, s.median_s, s.iqr_s) == (6, np.median(xs), np.percentile(xs, 75) - np.percentile(xs, 25))
    assert s.p2_5_s == pytest.approx(np.percentile(xs, 2.5)) and s.p97_5_s == pytest.approx(np.percentile(xs, 97.5))
    w = {r.window_name: (r.lower_s, r.upper_s) for r in C.derive_windows(offsets).collect()}
    assert w["prereg"] == (-50.0, 30.0) and w["R-90"] == (pytest.approx(np.percentile(xs, 5)), pytest.approx(np.percentile(xs, 95)))


def test_held_out_yield_counts_each_window(make):
    windows = make("window_no int, window_name string, lower_s double, upper_s double", [(1, "wide", -50.0, 30.0), (2, "edge", -45.0, 0.0)])
    ind = C.window_indicators(make(SCHEMA, ROWS), windows)
    out = {r.window_name: r for r in C.held_out_yields(ind, 30).collect()}
    assert (out["wide"].n_events_primary_heldout, out["wide"].n_patients_primary_heldout, out["wide"].n_evaluable_qc_pass_heldout) == (4, 3, 10)
    assert out["edge"].n_events_primary_heldout == 3
    assert out["wide"].primary_rate_per_evaluable_heldout == pytest.approx(0.4) and out["wide"].ci_low <= 0.4 <= out["wide"].ci_high


def test_missing_column(make):
    with pytest.raises(ValueError, match="alignment_offset_s"):
        C.qualifying_offsets(make(SCHEMA, ROWS).drop("alignment_offset_s"))


def test_zscores_and_constant_feature(make):
    df = make("k int, a double, b double", [(i, x, 4.0) for i, x in enumerate([1.0, 2.0, 6.0])] + [(9, None, 4.0)])
    z = {r.k: r for r in choose.zscores(df, ["a", "b"]).collect()}
    assert z[2].z_a == pytest.approx(3 / statistics.pstdev([1, 2, 6])) and z[9].z_a is None and z[0].z_b == 0.0


def test_nearest_to_median_comes_first(make):
    xs = [(i, float(i), float((i * 5) % 11)) for i in range(11)]
    got = [r.k for r in choose.rank_near_median(make("k int, a double, b double", xs), ["a", "b"], ["k"]).collect()]
    sd = statistics.pstdev(range(11))
    want = sorted(range(11), key=lambda i: (round(math.hypot((xs[i][1] - 5) / sd, (xs[i][2] - 5) / sd), 12), i))
    assert got[0] == want[0] and set(got) == set(want)


def test_top_per_category(make):
    rows = [(f"k{i}", "c1", float(i), "high" if i >= 8 else "med") for i in range(10)] + [("m", "c2", None, None), ("n", None, 1.0, "high")]
    top = choose.top_per_category(make("k string, cat string, x double, conf string", rows), "cat", ["x"], "k", 3, "conf").collect()
    by = {c: [r.k for r in sorted(top, key=lambda r: r.panel_index) if r.cat == c] for c in ("c1", "c2")}
    assert by == {"c1": ["k8", "k9", "k4"], "c2": ["m"]} or by == {"c1": ["k8", "k9", "k5"], "c2": ["m"]}


def test_representatives_ordered_by_size(make):
    rows = [("s1", i, float(i)) for i in range(5)] + [("s2", i, float(i)) for i in range(9)]
    out = choose.representative_per_group(make("s string, k int, v double", rows), "s", "v", ["k"]).collect()
    assert [(r.s, r.k, r.n_rows, r.median_value) for r in out] == [("s2", 4, 9, 4.0), ("s1", 2, 5, 2.0)]


CURVE = "id int, phase2_duration_s double, phase3_duration_s double, nadir_depth_frac double, recovery_fraction_at_window_end double"


def test_curve_equals_interpolation_and_stops_at_its_last_landmark(make):
    rows = [(1, 4.0, 18.0, 0.1, 1.2), (2, 0.0, 10.0, 0.05, 0.9), (3, 6.0, 70.0, 0.2, 1.0)]
    got = curves.landmark_curve(make(CURVE, rows), ["id"]).collect()
    grid = np.linspace(-10, 60, 561)
    for i, p2, p3, low, end in rows:
        p2 = max(p2, 1e-6)
        mine = {r.ti: r.y for r in got if r.id == i}
        valid = [j for j, t in enumerate(grid) if t <= p2 + p3 + 1e-12]
        assert sorted(mine) == valid
        assert [mine[j] for j in valid] == pytest.approx(list(np.interp(grid[valid], [-10, 0, p2, p2 + p3], [1, 1, low, end])), abs=1e-9)


def test_quantiles_need_enough_rows_and_density_peaks_at_one(make):
    df = make(CURVE, [(i, 4.0, 5.0 if i < 7 else 40.0, 0.1, 1.2) for i in range(10)])
    curve = curves.landmark_curve(df, ["id"])
    q = curves.curve_quantiles(curve, df.agg(F.count(F.lit(1)))).collect()
    assert max(r.t for r in q) == 9.0 and all(r.n == 10 for r in q)
    d = curves.density(curve).collect()
    assert max(r.density for r in d) == 1.0 and sum(r.n for r in d) == curve.count() and {r.yi for r in d} <= set(range(200))


def test_tile_geometry(make):
    pts = curves.tile_geometry(make(CURVE, [(1, 5.0, 20.0, 0.1, 1.1)]), ["id"]).collect()
    assert [(r.t_s, pytest.approx(r.pct)) for r in pts] == [(0.0, 100.0), (4.5, 100.0), (9.5, 10.0), (29.5, 110.0)]


def test_equal_curves_are_drawn_once_and_count_as_often_as_they_are(make):
    df = make(CURVE, [(i, 4.0, [18.0, 30.0, None][i % 3], 0.1 * (i % 2), 1.2) for i in range(40)])
    shapes = curves.distinct_curves(df)
    assert shapes.count() == 6
    total = df.agg(F.count(F.lit(1)))
    every = curves.curve_quantiles(curves.landmark_curve(df, ["id"]), total)
    once = curves.curve_quantiles(curves.landmark_curve(shapes, ["copies"]), total, weight="copies")
    rows = lambda q: sorted(tuple(r) for r in q.collect())
    assert rows(once) == rows(every)
