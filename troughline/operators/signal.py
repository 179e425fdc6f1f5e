"""Sampled signal to a one-tick-per-second index, and the extraction job built on it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from troughline import vocabulary as V
from troughline.operators import detect
from troughline.operators.linkage import anchor_windows
from troughline.schema import EVENT_INVENTORY

# Pulsatile band, baseline and envelope cut-offs (Hz) with their filter orders.
BAND_HZ, BAND_ORDER = (0.5, 8.0), 4
BASELINE_HZ, BASELINE_ORDER = 0.4, 2
ENVELOPE_HZ, ENVELOPE_ORDER = 1.0, 2


def fill_gaps(
    windows: DataFrame, keys: Sequence[str], v: str = "value", min_valid: float = 0.5, out: str = "filled"
) -> DataFrame:
    """Add the valid fraction of each window, a `rejected` flag, and the value with gaps at the window median."""
    every = Window.partitionBy(*keys)
    ok = F.col(v).isNotNull() & ~F.isnan(v)
    clean = F.when(ok, F.col(v))
    return (
        windows.withColumn("valid_fraction", F.avg(ok.cast("double")).over(every))
        .withColumn("rejected", F.col("valid_fraction") < min_valid)
        .withColumn("_median", F.percentile(clean, F.lit(0.5)).over(every))
        .withColumn(out, F.when(~F.col("rejected"), F.coalesce(clean, F.col("_median"))))
        .drop("_median")
    )


def _lowpass_gain(f: np.ndarray, fs: float, cut: float, order: int) -> np.ndarray:
    """Squared Butterworth magnitude: what one forward and one backward pass multiply by."""
    warped = np.tan(np.pi * np.minimum(f, fs * 0.4999999) / fs) / np.tan(np.pi * cut / fs)
    return 1.0 / (1.0 + warped ** (2 * order))


def _bandpass_gain(f: np.ndarray, fs: float, band: tuple[float, float], order: int) -> np.ndarray:
    lo, hi = (np.tan(np.pi * min(c, fs * 0.4999) / fs) for c in band)
    w = np.tan(np.pi * np.clip(f, 1e-9, fs * 0.4999999) / fs)
    return 1.0 / (1.0 + ((w * w - lo * hi) / ((hi - lo) * w)) ** (2 * order))


def _zero_phase(x: np.ndarray, fs: float, gain) -> np.ndarray:
    """Multiply the spectrum by `gain(f)`, after odd reflection at both ends."""
    pad = min(len(x) - 1, int(10 * fs))
    if pad > 0:
        x = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
    spectrum = np.fft.rfft(x)
    y = np.fft.irfft(spectrum * gain(np.fft.rfftfreq(len(x), 1.0 / fs)), len(x))
    return y[pad:len(y) - pad] if pad > 0 else y


def perfusion_index(x: np.ndarray, fs: float) -> np.ndarray:
    """100 x pulsatile envelope / slow baseline, sample by sample."""
    ac = _zero_phase(x, fs, lambda f: _bandpass_gain(f, fs, BAND_HZ, BAND_ORDER))
    dc = _zero_phase(x, fs, lambda f: _lowpass_gain(f, fs, BASELINE_HZ, BASELINE_ORDER))
    env = _zero_phase(np.abs(ac), fs, lambda f: _lowpass_gain(f, fs, ENVELOPE_HZ, ENVELOPE_ORDER))
    return 100.0 * env / np.maximum(np.abs(dc), 1e-9)


def reduce_signal(
    windows: DataFrame, keys: Sequence[str], fs: float, anchor: str = "t_nbp", t: str = "t_s", v: str = "value",
    pre_s: float = 200.0, min_valid: float = 0.5, post_s: float = 200.0, start: str | None = None, end: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per window: gap check, gap fill, filtering and one mean per full second.

    `start` and `end` name columns with the recording's bounds on the sample clock; the window clipped to them is
    what must be valid, so missing edges count as gaps. A bound that is not named or NULL is the window's first or
    last sample row. Output `keys..., anchor, valid_fraction, t, v`: `t` counts seconds from `anchor - pre_s`.
    A window too sparse, or shorter than a second, yields one row with NULL `t`; so does one whose rows all lack `t`,
    with a NULL fraction. `carry` names columns, constant in a window, that every output row keeps. Spark
    groups and shuffles the windows; numpy only filters one window (seconds x rate samples).
    """
    keys = list(keys)
    key_fields = [windows.schema[k] for k in [*keys, *carry]]
    schema = T.StructType([
        *key_fields, T.StructField(anchor, T.DoubleType()), T.StructField("valid_fraction", T.DoubleType()),
        T.StructField("t", T.IntegerType()), T.StructField("v", T.DoubleType()),
    ])

    def one_window(pdf: pd.DataFrame) -> pd.DataFrame:
        a = float(pdf[anchor].iloc[0])
        head = pdf.iloc[0]
        pdf = pdf[pdf["_i"].notna()]
        ticks, means, share = np.array([np.nan]), np.array([np.nan]), np.nan
        if len(pdf):
            index = pdf["_i"].to_numpy(np.int64)
            first, last = int(index.min()), int(index.max())
            if start is not None and pd.notna(begun := head[start]):
                first = min(first, max(0, round((float(begun) - (a - pre_s)) * fs)))
            if end is not None and pd.notna(ended := head[end]):
                last = max(last, round(min(pre_s + post_s, float(ended) - (a - pre_s)) * fs) - 1)
            grid = np.full(last - first + 1, np.nan)
            grid[index - first] = pdf[v].to_numpy(float)
            finite = np.isfinite(grid)
            share = float(finite.mean())
            if share >= min_valid:
                pi = perfusion_index(np.where(finite, grid, np.median(grid[finite])), fs)
                second = np.floor((first + np.arange(len(pi)) + 0.5) / fs).astype(np.int64)
                size = np.bincount(second - second[0])
                total = np.bincount(second - second[0], weights=pi)
                full = size >= int(fs)
                if full.any():
                    ticks, means = (np.nonzero(full)[0] + second[0]).astype(float), total[full] / size[full]
        out = pd.DataFrame({"t": ticks, "v": means}).astype({"t": "Int32"})
        for k in [*keys, *carry]:
            out[k] = head[k]
        out[anchor], out["valid_fraction"] = a, share
        return out[[*keys, *carry, anchor, "valid_fraction", "t", "v"]]

    # Only what a window needs moves, and its samples by number instead of by time: numbers shrink well.
    at = F.col(t).cast("double")
    number = F.when(at.isNotNull() & ~F.isnan(at), F.rint((at - (F.col(anchor) - pre_s)) * fs).cast("long"))
    named = dict.fromkeys(c for c in (*keys, *carry, anchor, start, end, v) if c is not None)
    return windows.select(*named, number.alias("_i")).groupBy(*keys).applyInPandas(one_window, schema)


def to_record_time(local: str, anchor: str, pre_s: float = 200.0):
    """Window time to recording time, NULL staying NULL."""
    return F.when(F.col(local).isNotNull() & ~F.isnan(local), F.col(local) - pre_s + F.col(anchor))


def extract_events(
    anchors: DataFrame, samples: DataFrame, fs: float, p: detect.Detector = detect.Detector(),
    subject: str = "subject_id", record: str = "record_id", anchor_t: str = "t_nbp", sample_t: str = "t_s",
    sample_v: str = "value", pre_s: float = 200.0, post_s: float = 200.0, min_valid: float = 0.5, bounds: DataFrame | None = None,
) -> DataFrame:
    """Anchors and raw samples to the event inventory: every anchor yields exactly one row.

    `bounds` has one row per recording: its id, `start_s` and `end_s` on the sample clock. Without it a recording
    lasts from its first to its last sample row.
    """
    keys = [subject, record, anchor_t]
    anchors = anchors.select(
        F.col(subject).cast("string").alias(subject), F.col(record).cast("string").alias(record),
        F.col(anchor_t).cast("double").alias(anchor_t),
    )
    samples = samples.select(
        F.col(record).cast("string").alias(record), F.col(sample_t).alias(sample_t), F.col(sample_v).alias(sample_v)
    )
    if bounds is None:
        bounds = samples.groupBy(record).agg(F.min(sample_t).alias("start_s"), (F.max(sample_t) + 1 / fs).alias("end_s"))
    limits = bounds.select(F.col(record).cast("string").alias(record), F.col("start_s").alias("_start"), F.col("end_s").alias("_end"))
    # Copies of an anchor share one window; their number travels with it.
    asked = anchors.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_copies")).join(limits, record, "left")
    # A row without a sample stands for the anchor itself, so anchors that meet no sample go the same way as all others.
    marks = asked.withColumns({sample_t: F.lit(None).cast(samples.schema[sample_t].dataType), sample_v: F.lit(None).cast(samples.schema[sample_v].dataType)})
    windows = anchor_windows(asked, samples, record, anchor_t, sample_t, pre_s, post_s).unionByName(marks)
    # The key columns double as the anchor column, so the pandas step is handed a copy.
    windows = windows.withColumn("_anchor", F.col(anchor_t))
    gates = ["valid_fraction", "_copies", "n_ticks"]
    trace = reduce_signal(windows, keys, fs, "_anchor", sample_t, sample_v, pre_s, min_valid, post_s, "_start", "_end", carry=["_copies"])
    found = detect.classify(trace.withColumn("_center", F.lit(float(pre_s))), keys, "_center", p, "t", "v", carry=gates)
    rows = found.drop("_center").withColumnRenamed("valid_fraction", "pleth_valid_fraction").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    reason = (
        F.when(F.coalesce(F.col("pleth_valid_fraction"), F.lit(0.0)) == 0, V.NO_SIGNAL)  # no sample, or none readable
        .when(F.col("pleth_valid_fraction") < min_valid, V.SIGNAL_MOSTLY_MISSING)
        .when(F.col("n_ticks") == 0, V.NO_TRACE)
        .otherwise(F.col("reject_reason"))
    )
    gated = F.col("pleth_valid_fraction").isNull() | (F.col("pleth_valid_fraction") < min_valid)
    # The verdict of a window without ticks is no more than its reason.
    rows = rows.withColumns({c: F.when(F.col("n_ticks") > 0, F.col(c)) for c in found.columns if c not in [*keys, *gates, "_center", "reject_reason"]})
    rows = rows.withColumn("reject_reason", reason).withColumn("nbp_timestamp_s", F.col(anchor_t))
    for c in ("t_occlusion_start_s", "t_deflate_start_s", "t_nadir_s", "t_release_s"):
        rows = rows.withColumn(c, to_record_time(c, anchor_t, pre_s))
    for c in ("is_occlusion_signature", "stat_mode_candidate", "recovered", "ambiguous_multi_dip", "pre_window_valid"):
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(False)))
    rows = rows.withColumn("pleth_fs", F.when(~gated, F.lit(float(fs)))).withColumn(
        "pleth_valid_fraction", F.when(gated, F.lit(0.0)).otherwise(F.col("pleth_valid_fraction"))
    )
    names = {"subject_id": subject, "record_id": record}
    return rows.select(*[F.col(names.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in EVENT_INVENTORY])
