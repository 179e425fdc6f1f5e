import math
import re

import numpy as np
import pytest

from troughline import vocabulary as V
from troughline.operators import signal as S

FS = 25.0


def test_filter_gains():
    f = np.array([0.2, 0.4, 1.0])
    assert S._lowpass_gain(f, 125.0, 0.4, 2) == pytest.approx([0.94118, 0.5, 0.02494], abs=2e-5)
    band = S._bandpass_gain(np.array([0.5, 2.0, 8.0, 20.0]), 125.0, (0.5, 8.0), 4)
    assert band == pytest.approx([0.5, 1.0, 0.5, 0.0], abs=2e-3)


def test_index_of_a_pure_pulse():
    """Mean rectified sine is 2/pi of its amplitude; over a constant baseline that is the index."""
    t = np.arange(0, 60, 1 / 125.0)
    pi = S.perfusion_index(100 + 3 * np.sin(2 * math.pi * 1.5 * t), 125.0)
    assert pi[125 * 10:125 * 50].mean() == pytest.approx(100 * 3 * 2 / math.pi / 100, rel=0.01)


def pulse(t, anchor, depth):
    """Pulse wave whose amplitude collapses around an anchor, then recovers."""
    amp = depth if anchor - 20 <= t <= anchor + 5 else 1.0
    return 100 + 5 * amp * math.sin(2 * math.pi * 1.5 * t)


def samples(record, lo, hi, anchor, depth, missing=0.0):
    n = int((hi - lo) * FS)
    rows = []
    for i in range(n):
        t = lo + i / FS
        gone = (i * 7919) % 1000 < missing * 1000
        rows.append((record, t, None if gone else pulse(t, anchor, depth)))
    return rows


def test_extraction_gives_every_anchor_one_row(make):
    data = samples("dip", 300, 700, 500, 0.02) + samples("flat", 300, 700, 500, 1.0) + samples("sparse", 300, 700, 500, 1.0, 0.8) + samples("holes", 300, 700, 500, 0.02, 0.001)
    anchors = [("p", r, 500.0) for r in ("dip", "flat", "sparse", "holes", "absent")] + [("p", "dip", 5000.0)]
    out = S.extract_events(make("subject_id string, record_id string, t_nbp double", anchors), make("record_id string, t_s double, value double", data), FS)
    rows = {(r.record_id, r.nbp_timestamp_s): r for r in out.collect()}
    assert len(rows) == 6 and out.count() == 6
    assert rows[("absent", 500.0)].reject_reason == V.NO_SIGNAL == rows[("dip", 5000.0)].reject_reason
    assert rows[("absent", 500.0)].pleth_valid_fraction == 0.0 and rows[("absent", 500.0)].pleth_fs is None
    assert rows[("sparse", 500.0)].reject_reason == V.SIGNAL_MOSTLY_MISSING
    assert rows[("flat", 500.0)].reject_reason == V.NO_DIP and rows[("flat", 500.0)].pre_window_valid
    for r in ("dip", "holes"):
        hit = rows[(r, 500.0)]
        assert hit.is_occlusion_signature and hit.reject_reason is None and hit.pleth_fs == FS
        assert 480 <= hit.t_nadir_s <= 506 and hit.t_nadir_s - 500 == pytest.approx(hit.alignment_offset_s)
        assert 22 <= hit.phase3_duration_s <= 28
    assert rows[("dip", 500.0)].pleth_valid_fraction == 1.0


def test_reduced_ticks_count_from_the_window_start(make):
    data = make("record_id string, t_s double, value double", samples("r", 300, 500, 450, 1.0))
    from pyspark.sql import functions as F

    win = data.withColumn("a", F.lit(500.0))
    got = S.reduce_signal(win, ["record_id"], FS, "a").orderBy("t").collect()
    assert [r.t for r in got] == list(range(0, 200))
    whole = S.perfusion_index(np.array([r[2] for r in samples("r", 300, 500, 450, 1.0)]), FS)
    assert [r.v for r in got] == pytest.approx(whole.reshape(200, 25).mean(axis=1))


def test_gap_fill(make):
    rows = [("a", float(i), v) for i, v in enumerate([1.0, None, 3.0, float("nan"), 8.0])] + [("b", 0.0, None), ("b", 1.0, None), ("b", 2.0, 1.0)]
    out = {(r.e, r.t): r for r in S.fill_gaps(make("e string, t double, value double", rows), ["e"]).collect()}
    assert [out[("a", float(i))].filled for i in range(5)] == [1.0, 3.0, 3.0, 3.0, 8.0]
    assert out[("a", 0.0)].valid_fraction == 0.6 and out[("b", 0.0)].rejected and out[("b", 2.0)].filled is None


def test_only_what_a_window_needs_moves(make, capsys):
    rows = make("k string, a double, t_s double, value double, other string", [("x", 200.0, i / 20, 1.0 + i % 7, "unused") for i in range(400)])
    S.reduce_signal(rows, ["k"], 20.0, "a").explain("formatted")
    plan = capsys.readouterr().out
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved and all("other" not in m and "t_s" not in m for m in moved)
