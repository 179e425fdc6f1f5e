"""The Spark detector against a plain per-window detector written from the same rules."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.operators import detect as D

A = 200.0
SCHEMA = "event_id string, anchor double, t int, v double"
FIELDS = ["reject_reason", "recovered", "ambiguous_multi_dip", "pre_window_valid", "pre_event_pi_mean", "pre_window_quality",
          "t_occlusion_start_s", "t_nadir_s", "t_release_s", "phase3_duration_s", "nadir_depth_frac", "recovery_fraction_at_window_end", "alignment_offset_s"]


def plain(points, anchor, p=D.Detector()):
    """`points`: time-ordered (t, value or None)."""
    n, out = len(points), dict.fromkeys(FIELDS)
    out.update(recovered=False, ambiguous_multi_dip=False, pre_window_valid=False)
    half = p.smooth_window // 2
    smooth = []
    for i, (t, _) in enumerate(points):
        near = [v for _, v in points[max(0, i - half): min(n, i + half + 1)]]
        smooth.append((t, None if None in near else statistics.median(near)))
    pre = [v for t, v in smooth if anchor - p.pre_lo <= t < anchor - p.pre_hi and v is not None]
    if len(pre) < p.min_finite:
        return out | {"reject_reason": V.NO_BASELINE}
    base = statistics.median(pre)
    rel = statistics.pstdev(pre) / base if base > 0 else None
    out.update(pre_event_pi_mean=base, pre_window_quality=rel)
    if not p.plausible_lo <= base <= p.plausible_hi:
        return out | {"reject_reason": V.BASELINE_IMPLAUSIBLE}
    if rel is None or rel > p.rel_sd_max:
        return out | {"reject_reason": V.BASELINE_UNSTABLE}
    out["pre_window_valid"] = True
    area = [(t, v) for t, v in smooth if anchor - p.search_lo <= t < anchor + p.search_hi]
    if not area:
        return out | {"reject_reason": V.NO_SEARCH_WINDOW}
    runs, current = [], []
    for i, (_, v) in enumerate(area):
        if v is not None and v < p.occlusion_fraction * base:
            current.append(i)
        elif current:
            runs, current = [*runs, current], []
    runs = [*runs, current] if current else runs
    good = []
    for run in runs:
        low = min(run, key=lambda i: (area[i][1], i))
        if area[run[-1]][0] - area[run[0]][0] >= p.sensitivity_min and area[low][1] < p.nadir_depth * base:
            good.append((run, low))
    if not good:
        return out | {"reject_reason": V.NO_DIP}
    out["ambiguous_multi_dip"] = len(good) >= 2
    aligned = [(r, low) for r, low in good if p.align_lo <= area[low][0] - anchor <= p.align_hi]
    if not aligned:
        return out | {"reject_reason": V.NOT_ALIGNED}
    deepest = min(area[low][1] / base for _, low in aligned)
    run, low = min((x for x in aligned if area[x[1]][1] / base <= deepest + p.tie_eps), key=lambda x: (abs(area[x[1]][0] - anchor), x[0][0]))
    after, release = area[low:], None
    hold = max(1, round(p.recovery_hold))
    for i in range(len(after) - hold + 1):
        if all(v is not None and v >= p.recovery_fraction * base for _, v in after[i:i + hold]):
            release = after[i][0]
            break
    duration = float(area[run[-1]][0] - area[run[0]][0])
    top = None if any(v is None for _, v in after) else max(v for _, v in after) / base
    reason = V.NOT_RECOVERED if release is None else V.SHORT_RUN if duration < p.primary_min else None
    return out | {
        "reject_reason": reason, "recovered": release is not None, "t_occlusion_start_s": float(area[run[0]][0]), "t_nadir_s": float(area[low][0]),
        "t_release_s": None if release is None else float(release), "phase3_duration_s": duration, "nadir_depth_frac": area[low][1] / base,
        "recovery_fraction_at_window_end": top, "alignment_offset_s": area[low][0] - anchor}


def trace(dips=(), level=10.0, noise=0.0, gaps=(), span=(0, 400), seed=0):
    """Ticks of a level trace; a dip is (start, end, depth as a share of level)."""
    rng = random.Random(seed)
    out = []
    for t in range(*span):
        share = min([d for s, e, d in dips if s <= t <= e], default=1.0)
        out.append((t, None if t in gaps else level * share + rng.uniform(-noise, noise)))
    return out


SCENES = {
    "deep": trace([(180, 197, 0.05)]),
    "shallow": trace([(180, 197, 0.30)]),
    "short": trace([(180, 186, 0.05)]),
    "exactly ten": trace([(180, 190, 0.05)]),
    "nine": trace([(180, 189, 0.05)]),
    "medium": trace([(180, 193, 0.05)]),
    "never recovers": trace([(180, 400, 0.05)]),
    "recovers past the window": trace([(180, 287, 0.05)]),
    "recovers for one tick": trace([(180, 288, 0.05)]),
    "misaligned": trace([(240, 270, 0.05)]),
    "two dips": trace([(160, 175, 0.10), (205, 220, 0.05)]),
    "near tie": trace([(150, 170, 0.100), (195, 215, 0.105)]),
    "flat": trace(),
    "implausible": trace([(180, 197, 0.05)], level=0.5),
    "unstable": [(t, 10.0 + 9 * math.sin(t / 4)) for t in range(400)],
    "gap in run": trace([(170, 200, 0.05)], gaps=(185,)),
    "gap after nadir": trace([(180, 197, 0.05)], gaps=(250,)),
    "gappy baseline": trace([(180, 197, 0.05)], gaps=range(80, 125)),
    "starts late": trace([(180, 197, 0.05)], span=(150, 400)),
    "ends early": trace(span=(0, 140)),
    "empty ticks missing": [x for x in trace([(180, 197, 0.05)]) if x[0] not in range(205, 215)],
    **{f"noise {i}": trace([(150 + 7 * i, 165 + 9 * i, 0.02 * i)], noise=1.5 + i / 4, seed=i, gaps=random.Random(i).sample(range(400), 5)) for i in range(12)},
}


@pytest.fixture
def table(make):
    return make(SCHEMA, [(name, A, t, v) for name, pts in SCENES.items() for t, v in pts]).repartition(3)


def same(got, want, name):
    for f in FIELDS:
        g, w = got[f], want[f]
        if isinstance(w, float) and g is not None:
            assert g == pytest.approx(w, rel=1e-9), (name, f)
        else:
            assert g == w, (name, f, g, w)


def test_every_scene_matches_the_plain_detector(table):
    rows = {r["event_id"]: r for r in D.classify(table, ["event_id"]).collect()}
    assert set(rows) == set(SCENES)
    for name, pts in SCENES.items():
        same(rows[name], plain(pts, A), name)
    reasons = {r["reject_reason"] for r in rows.values()}
    assert reasons >= {None, V.NO_DIP, V.SHORT_RUN, V.NOT_RECOVERED, V.NOT_ALIGNED, V.NO_BASELINE, V.BASELINE_IMPLAUSIBLE, V.BASELINE_UNSTABLE, V.NO_SEARCH_WINDOW}


def test_other_settings(table):
    p = D.Detector(nadir_depth=0.35, occlusion_fraction=0.6, recovery_fraction=0.95, recovery_hold=4, align_lo=-60, align_hi=60, primary_min=18, sensitivity_min=6, smooth_window=3)
    for r in D.classify(table, ["event_id"], p=p).collect():
        same(r, plain(SCENES[r["event_id"]], A, p), r["event_id"])


def test_expected_outcomes(table):
    got = {r["event_id"]: r["reject_reason"] for r in D.classify(table, ["event_id"]).collect()}
    assert got["deep"] is None and got["exactly ten"] == V.SHORT_RUN and got["nine"] == V.NO_DIP and got["shallow"] == V.NO_DIP
    assert got["never recovers"] == V.NOT_RECOVERED and got["misaligned"] == V.NOT_ALIGNED and got["ends early"] == V.NO_SEARCH_WINDOW


def test_near_tie_goes_to_the_dip_nearest_the_anchor(table):
    row = D.classify(table.where("event_id = 'near tie'"), ["event_id"]).first()
    assert row.ambiguous_multi_dip and 195 <= row.t_nadir_s <= 215


def test_defaults_are_locked():
    p = D.Detector()
    assert (p.nadir_depth, p.occlusion_fraction, p.recovery_fraction, p.recovery_hold) == (0.20, 0.50, 0.85, 2)
    assert (p.align_lo, p.align_hi, p.primary_min, p.sensitivity_min, p.rel_sd_max, p.smooth_window) == (-50, 30, 15, 10, 0.30, 5)


def test_sweep_equals_one_classification_per_setting(table):
    settings = D.sweep_settings()
    assert len(settings) == 16
    with_subject = table.withColumn("subject", F.substring("event_id", 1, 2))
    got = {(r.parameter, r.value): tuple(r)[2:] for r in D.sweep(with_subject, ["event_id", "subject"], "subject", settings).collect()}
    for s in settings:
        p = D.Detector(**{k: s[k] for k in D.SWEPT})
        found = {n: plain(pts, A, p) for n, pts in SCENES.items()}
        prim = [n for n, r in found.items() if r["reject_reason"] is None]
        sens = [n for n, r in found.items() if r["reject_reason"] in (None, V.SHORT_RUN, V.NOT_RECOVERED) and r["phase3_duration_s"] >= p.sensitivity_min]
        assert got[(s["parameter"], s["value"])] == (len(prim), len({n[:2] for n in prim}), len(sens), len({n[:2] for n in sens})), s


def test_rolling_median_can_skip_missing(make):
    df = make(SCHEMA, [("e", A, i, v) for i, v in enumerate([1.0, None, 3.0, 9.0, 5.0])])
    got = [r.sm for r in D.rolling_median(df, ["event_id"], window=3, skip_missing=True).orderBy("t").collect()]
    assert got == [1.0, 2.0, 6.0, 5.0, 7.0]
    assert [r.sm for r in D.rolling_median(df, ["event_id"], window=1).orderBy("t").collect()] == [1.0, None, 3.0, 9.0, 5.0]


def test_windows_share_one_exchange(table):
    """The whole detector adds the spread by window key and nothing else."""
    plan = D.classify(table, ["event_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_tasks_grow_with_the_trace(make):
    trace = make(SCHEMA, [("e", A, t, 1.0) for t in range(5)])
    partitions = lambda rows: D.prepare(trace, ["event_id"], n_rows=rows).rdd.getNumPartitions()
    assert partitions(20 * D.TASK_TICKS - 1) == 20 and partitions(None) <= 4
