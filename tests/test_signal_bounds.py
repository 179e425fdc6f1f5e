"""Valid fractions over the window clipped to the recording: missing edges are gaps."""

import pytest

from test_signal import FS, samples
from troughline import vocabulary as V
from troughline.operators import signal as S


def extracted(make, data, bounds, at=500.0):
    anchors = [("p", r, at) for r in sorted({r[0] for r in bounds})]
    out = S.extract_events(
        make("subject_id string, record_id string, t_nbp double", anchors), make("record_id string, t_s double, value double", data), FS,
        bounds=make("record_id string, start_s double, end_s double", bounds),
    )
    return {r.record_id: r for r in out.collect()}


def test_missing_edges_are_gaps(make):
    data = samples("short", 490, 510, 500, 1.0) + samples("no_start", 450, 700, 500, 1.0) + samples("no_end", 300, 550, 500, 1.0)
    data += samples("clipped", 450, 550, 500, 1.0) + samples("late", 520, 700, 500, 1.0)
    rows = extracted(make, data, [(r, 0.0, 1000.0) for r in ("short", "no_start", "no_end", "late")] + [("clipped", 450.0, 550.0)])
    assert rows["short"].reject_reason == V.SIGNAL_MOSTLY_MISSING == rows["late"].reject_reason
    assert rows["no_start"].pleth_valid_fraction == pytest.approx(250 / 400) == rows["no_end"].pleth_valid_fraction
    assert rows["clipped"].pleth_valid_fraction == 1.0


def test_filled_edges_have_ticks(make):
    from pyspark.sql import functions as F

    data = make("record_id string, t_s double, value double", samples("r", 40, 240, 100, 1.0))
    win = data.withColumns({"a": F.lit(100.0), "s": F.lit(0.0), "e": F.lit(260.0)})
    got = S.reduce_signal(win, ["record_id"], FS, "a", start="s", end="e").orderBy("t").collect()
    assert [r.t for r in got] == list(range(100, 360)) and got[0].valid_fraction == pytest.approx(200 / 260)
