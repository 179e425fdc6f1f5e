"""Dip-and-recovery detection on evenly ticked traces.

A trace is a long table `keys..., t, v` plus the anchor tick of its window. Every step is a
window or an aggregate over the window keys, so the whole chain shares the one exchange that
groups a window's rows; a window holds a few hundred ticks, whatever the table size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troughline import vocabulary as V


@dataclass(frozen=True)
class Detector:
    """Detector settings; the defaults are the fixed published ones."""

    nadir_depth: float = 0.20
    occlusion_fraction: float = 0.50
    recovery_fraction: float = 0.85
    recovery_hold: int = 2
    align_lo: float = -50.0
    align_hi: float = 30.0
    primary_min: float = V.PRIMARY_MIN_S
    sensitivity_min: float = V.SENSITIVITY_MIN_S
    pre_lo: float = 120.0
    pre_hi: float = 60.0
    search_lo: float = 60.0
    search_hi: float = 90.0
    plausible_lo: float = 1.0
    plausible_hi: float = 100.0
    rel_sd_max: float = 0.30
    min_finite: int = 30
    tie_eps: float = 0.01
    smooth_window: int = 5


#: Ticks of windows that a task sorts at once (up to about 300 MB).
TASK_TICKS = 2_000_000

# The settings a sweep may vary row by row.
SWEPT = ("nadir_depth", "occlusion_fraction", "recovery_fraction", "align_lo", "align_hi", "primary_min", "sensitivity_min")


def rolling_median(
    df: DataFrame, keys: Sequence[str], t: str = "t", v: str = "v", window: int = 5, out: str = "sm",
    skip_missing: bool = False,
) -> DataFrame:
    """Centred rolling median over rows; frames shrink at the edges.

    A missing value in the frame makes the result missing unless `skip_missing`. Fixed lead/lag
    offsets sort a five-element array in generated code; no per-row aggregate buffer is built.
    """
    if window <= 1:
        return df.withColumn(out, F.col(v))
    half = window // 2
    w = Window.partitionBy(*keys).orderBy(t)
    frame = w.rowsBetween(-half, half)
    df = df.withColumns({
        "_near": F.sort_array(F.array_compact(F.array(
            *[F.lag(v, k).over(w) for k in range(half, 0, -1)], F.col(v), *[F.lead(v, k).over(w) for k in range(1, half + 1)],
        ))),
        "_gap": F.count(F.lit(1)).over(frame) > F.count(v).over(frame),
    })
    n = F.size("_near")
    # Positions are 1-based; an odd count takes the same element twice.
    mid = (
        F.try_element_at("_near", F.floor((n + 1) / 2).cast("int"))
        + F.try_element_at("_near", F.floor((n + 2) / 2).cast("int"))
    ) / 2
    usable = n > 0 if skip_missing else ~F.col("_gap")
    return df.withColumn(out, F.when(usable, mid)).drop("_near", "_gap")


def _between(t: Column, lo: Column, hi: Column) -> Column:
    return (t >= lo) & (t < hi)


def baseline_quality(
    df: DataFrame, keys: Sequence[str], anchor: str = "anchor", p: Detector = Detector(), t: str = "t", v: str = "sm"
) -> DataFrame:
    """Add `n_pre, n_finite, baseline, rel_sd, quality_reason` of the pre-anchor window to every row.

    Also `n_search` (ticks in the search window), `first_t` and `n_ticks`, taken in the same pass.
    """
    every = Window.partitionBy(*keys)
    in_pre = _between(F.col(t), F.col(anchor) - p.pre_lo, F.col(anchor) - p.pre_hi)
    pre = F.when(in_pre, F.col(v))
    enough = F.col("n_finite") >= p.min_finite
    df = df.withColumns({
        "n_pre": F.count_if(in_pre).over(every),
        "n_finite": F.count(pre).over(every),
        "_median": F.percentile(pre, F.lit(0.5)).over(every),
        "_sd": F.stddev_pop(pre).over(every),
        "n_search": F.count_if(_searching(anchor, p, t)).over(every),
        "first_t": F.min(t).over(every),
        "n_ticks": F.count(t).over(every),
    }).withColumns({
        "baseline": F.when(enough, F.col("_median")),
        "rel_sd": F.when(enough & (F.col("_median") > 0), F.col("_sd") / F.col("_median")),
    })
    reason = (
        F.when(~enough, V.NO_BASELINE)
        .when(~F.col("baseline").between(p.plausible_lo, p.plausible_hi), V.BASELINE_IMPLAUSIBLE)
        .when(F.col("rel_sd").isNull() | (F.col("rel_sd") > p.rel_sd_max), V.BASELINE_UNSTABLE)
    )
    return df.withColumn("quality_reason", reason).drop("_median", "_sd")


def _searching(anchor: str, p: Detector, t: str) -> Column:
    return _between(F.col(t), F.col(anchor) - p.search_lo, F.col(anchor) + p.search_hi)


def _setting(p: Detector, name: str, swept: bool) -> Column:
    return F.col(name) if swept else F.lit(float(getattr(p, name)))


def mark_runs(
    df: DataFrame, keys: Sequence[str], anchor: str = "anchor", p: Detector = Detector(), t: str = "t", v: str = "sm",
    swept: bool = False,
) -> DataFrame:
    """Number the below-threshold runs of the search window (gaps and islands), NULL outside a run.

    Also adds, per row, what a nadir at that row would see: the first held recovery at or after
    it (`next_release`) and the highest later value (`max_after`), from one reverse-ordered pass.
    """
    forward = Window.partitionBy(*keys).orderBy(t)
    backward = Window.partitionBy(*keys).orderBy(F.desc(t)).rowsBetween(Window.unboundedPreceding, 0)
    hold = max(1, int(round(p.recovery_hold)))
    ahead = forward.rowsBetween(0, hold - 1)
    searching = _searching(anchor, p, t)
    below = F.coalesce(searching & (F.col(v) < _setting(p, "occlusion_fraction", swept) * F.col("baseline")), F.lit(False))
    above = F.coalesce(searching & (F.col(v) >= _setting(p, "recovery_fraction", swept) * F.col("baseline")), F.lit(False))
    # Three window passes: run starts, then run numbers and holds, then one reverse pass.
    return (
        df.withColumns({
            "_in": searching, "_below": below, "_above": above,
            "_start": below & ~F.coalesce(F.lag(below).over(forward), F.lit(False)),
        })
        .withColumns({
            "run": F.when(F.col("_below"), F.sum(F.col("_start").cast("int")).over(forward)),
            "_held": (F.min(F.col("_above").cast("int")).over(ahead) == 1) & (F.count(F.lit(1)).over(ahead) == hold),
        })
        .withColumns({
            "next_release": F.min(F.when(F.col("_held"), F.col(t))).over(backward),
            "max_after": F.when(
                F.count_if(F.col("_in") & F.col(v).isNull()).over(backward) == 0,
                F.max(F.when(F.col("_in"), F.col(v))).over(backward),
            ),
        })
        .drop("_in", "_below", "_above", "_start", "_held")
    )


def runs_below(
    df: DataFrame, keys: Sequence[str], anchor: str = "anchor", p: Detector = Detector(), t: str = "t", v: str = "sm",
    swept: bool = False, keep_empty: bool = False, carry: Sequence[str] = (),
) -> DataFrame:
    """One row per run: its span, its first minimum and the recovery seen from there.

    `keep_empty` keeps one run-less row per window so windows without any run survive, also one whose only row has no tick.
    """
    first = F.col(t).eqNullSafe(F.col("first_t"))
    rows = mark_runs(df.where(F.coalesce(_searching(anchor, p, t), F.lit(False)) | first), keys, anchor, p, t, v, swept)
    rows = rows.where(F.col("run").isNotNull() | (first if keep_empty else F.lit(False)))
    low = F.struct(F.col(v).alias("v"), F.col(t).alias("t"), F.col("next_release"), F.col("max_after"))
    constant = [c for c in dict.fromkeys([anchor, "baseline", "n_search", *carry]) if c not in keys]
    grouped = rows.groupBy(*keys, "run").agg(
        F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.min(low).alias("_low"),
        *[F.first(c).alias(c) for c in constant],
    )
    in_run = F.col("run").isNotNull()
    return grouped.select(
        *keys, "run", *constant,
        F.when(in_run, F.col("t_start")).alias("t_start"),
        F.when(in_run, F.col("t_end")).alias("t_end"),
        F.when(in_run, (F.col("t_end") - F.col("t_start")).cast("double")).alias("duration"),
        F.when(in_run, F.col("_low.t")).alias("t_nadir"),
        F.when(in_run, F.col("_low.v") / F.col("baseline")).alias("depth_frac"),
        F.when(in_run, (F.col("_low.t") - F.col(anchor)).cast("double")).alias("offset"),
        F.when(in_run, F.col("_low.next_release")).alias("t_release"),
        F.when(in_run, F.col("_low.max_after") / F.col("baseline")).alias("recovery_end"),
        F.when(in_run, F.col("_low.v")).alias("nadir_v"),
    )


def qualify_runs(runs: DataFrame, p: Detector = Detector(), swept: bool = False) -> DataFrame:
    """Add `qualifies` (long and deep enough) and `aligned` (nadir in the alignment window)."""
    s = lambda name: _setting(p, name, swept)
    qualifies = (F.col("duration") >= s("sensitivity_min")) & (F.col("nadir_v") < s("nadir_depth") * F.col("baseline"))
    aligned = F.col("offset").between(s("align_lo"), s("align_hi"))
    return runs.withColumn("qualifies", F.coalesce(qualifies, F.lit(False))).withColumn(
        "aligned", F.col("qualifies") & F.coalesce(aligned, F.lit(False))
    )


def _best_run(runs: DataFrame, keys: Sequence[str], p: Detector) -> DataFrame:
    """Mark, among aligned runs within `tie_eps` of the deepest, the ordering struct of each."""
    deepest = F.min(F.when(F.col("aligned"), F.col("depth_frac"))).over(Window.partitionBy(*keys))
    near = F.col("aligned") & (F.col("depth_frac") <= F.col("_deepest") + p.tie_eps)
    order = F.struct(
        F.abs("offset").alias("gap"), F.col("t_start"), F.col("t_end"), F.col("duration"), F.col("t_nadir"),
        F.col("depth_frac"), F.col("offset"), F.col("t_release"), F.col("recovery_end"),
    )
    return runs.withColumn("_deepest", deepest).withColumn("_cand", F.when(near, order))


def select_run(runs: DataFrame, keys: Sequence[str], p: Detector = Detector()) -> DataFrame:
    """The chosen run per window: deepest aligned, near ties to the smallest offset, then the earliest."""
    chosen = _best_run(runs, keys, p).groupBy(*keys).agg(F.min("_cand").alias("_m")).where(F.col("_m").isNotNull())
    return chosen.select(*keys, "_m.*").drop("gap")


def classify_windows(
    smoothed: DataFrame, keys: Sequence[str], anchor: str = "anchor", p: Detector = Detector(), t: str = "t",
    v: str = "sm", carry: Sequence[str] = (),
) -> DataFrame:
    """One classified row per window from a smoothed trace that carries its baseline columns.

    `carry` names further columns, constant in a window, that the row keeps (`n_ticks`, its ticks, is one to be had).
    """
    held = ["rel_sd", "quality_reason", *carry]
    runs = runs_below(smoothed, keys, anchor, p, t, v, keep_empty=True, carry=held)
    return _classify_runs(runs, keys, anchor, p, held, False, carry)


def _classify_runs(
    runs: DataFrame, keys: Sequence[str], anchor: str, p: Detector, carry: Sequence[str], swept: bool, shown: Sequence[str] = ()
) -> DataFrame:
    per_window = _best_run(qualify_runs(runs, p, swept), keys, p).groupBy(*keys).agg(
        F.count_if("qualifies").alias("n_qualifying"),
        F.min("_cand").alias("m"),
        *[F.first(c).alias(c) for c in dict.fromkeys([anchor, "baseline", "n_search", *carry]) if c not in keys],
    )
    recovered = F.col("m.t_release").isNotNull()
    reason = (
        F.when(F.col("quality_reason").isNotNull(), F.col("quality_reason"))
        .when(F.col("n_search") == 0, V.NO_SEARCH_WINDOW)
        .when(F.col("n_qualifying") == 0, V.NO_DIP)
        .when(F.col("m").isNull(), V.NOT_ALIGNED)
        .when(~recovered, V.NOT_RECOVERED)
        .when(F.col("m.duration") < _setting(p, "primary_min", swept), V.SHORT_RUN)
    )
    valid = F.col("quality_reason").isNull()
    found = valid & F.col("m").isNotNull()
    pick = lambda field: F.when(found, F.col(f"m.{field}").cast("double"))
    return per_window.withColumn("reject_reason", reason).select(
        *dict.fromkeys([*keys, anchor, *shown]),
        F.col("reject_reason").isNull().alias("is_occlusion_signature"),
        (found & F.col("reject_reason").isNotNull()).alias("stat_mode_candidate"),
        (found & recovered).alias("recovered"),
        (valid & (F.col("n_qualifying") >= 2)).alias("ambiguous_multi_dip"),
        F.col("baseline").alias("pre_event_pi_mean"),
        F.col("rel_sd").alias("pre_window_quality"),
        valid.alias("pre_window_valid"),
        pick("t_start").alias("t_occlusion_start_s"),
        pick("t_nadir").alias("t_deflate_start_s"),
        pick("t_nadir").alias("t_nadir_s"),
        pick("t_release").alias("t_release_s"),
        F.when(found, (F.col("m.t_nadir") - F.col("m.t_start")).cast("double")).alias("phase2_duration_s"),
        pick("duration").alias("phase3_duration_s"),
        pick("depth_frac").alias("nadir_depth_frac"),
        pick("recovery_end").alias("recovery_fraction_at_window_end"),
        pick("offset").alias("alignment_offset_s"),
        "reject_reason",
    )


def prepare(
    trace: DataFrame, keys: Sequence[str], anchor: str = "anchor", p: Detector = Detector(), t: str = "t", v: str = "v",
    skip_missing: bool = False, n_rows: int | None = None,
) -> DataFrame:
    """Smooth a raw trace and attach its baseline: everything that no swept setting changes.

    `n_rows`, about how many rows the trace has, bounds what a task sorts: where the session's partitions would hold more
    than `TASK_TICKS` rows, there are more of them.
    """
    # Spread by the whole key: a trace that arrives partitioned by the recording alone would
    # keep every window of a hot recording in one task.
    tasks = -(-(n_rows or 0) // TASK_TICKS)
    enough = tasks <= int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = trace.repartition(*keys) if enough else trace.repartition(tasks, *keys)
    return baseline_quality(rolling_median(spread, keys, t, v, p.smooth_window, "sm", skip_missing), keys, anchor, p, t)


def _exact_keys(trace: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """The trace with fractional keys named as text, the keys to group by, and the fractional ones.

    Windows group a fractional key by a normalised copy, which no exchange by the key itself serves, so ticks would move twice.
    """
    floats = [k for k in keys if trace.schema[k].dataType.typeName() in ("double", "float")]
    named = trace.withColumns({f"_key_{k}": (F.col(k) + 0.0).cast("string") for k in floats})
    return named, [f"_key_{k}" if k in floats else k for k in keys], floats


def classify(
    trace: DataFrame, keys: Sequence[str], anchor: str = "anchor", p: Detector = Detector(), t: str = "t", v: str = "v",
    skip_missing: bool = False, carry: Sequence[str] = (), n_rows: int | None = None,
) -> DataFrame:
    """Raw trace to one classified row per window; `carry` as in `classify_windows`, `n_rows` as in `prepare`."""
    named, exact, floats = _exact_keys(trace, keys)
    found = classify_windows(prepare(named, exact, anchor, p, t, v, skip_missing, n_rows), exact, anchor, p, t, carry=list(dict.fromkeys([*floats, *carry])))
    lead = list(dict.fromkeys([*keys, anchor, *carry]))
    return found.select(*lead, *[c for c in found.columns if c not in {*lead, *exact}])


def sweep_settings(p: Detector = Detector(), grids: Sequence = V.SWEEP_GRIDS) -> list[dict[str, object]]:
    """One-factor-at-a-time settings: `parameter, value` and the full set of swept numbers."""
    base = {k: float(x) for k, x in asdict(p).items() if k in SWEPT}
    return [
        {"parameter": name, "value": label, **base, **{k: float(x) for k, x in change.items()}}
        for name, entries in grids
        for label, change in entries
    ]


def sweep(
    trace: DataFrame, keys: Sequence[str], subject: str, settings: Sequence[Mapping[str, object]], anchor: str = "anchor",
    p: Detector = Detector(), t: str = "t", v: str = "v", skip_missing: bool = False, n_rows: int | None = None,
) -> DataFrame:
    """Primary and sensitivity events and subjects under every setting.

    The trace is smoothed and its baseline taken once. Only the run and recovery thresholds
    look at ticks, so ticks are repeated per distinct pair of those; every other setting is
    applied to the few runs found. Repeated rows keep the window's partitioning: the sweep adds
    no exchange of the trace.
    """
    trace, keys, floats = _exact_keys(trace, keys)
    ready = prepare(trace, keys, anchor, p, t, v, skip_missing, n_rows).where(
        F.col("quality_reason").isNull() & _searching(anchor, p, t)
    )
    tick_level = ("occlusion_fraction", "recovery_fraction")
    pairs = list(dict.fromkeys(tuple(float(s[k]) for k in tick_level) for s in settings))
    passes = F.array(*[
        F.struct(F.lit(i).alias("pass"), *[F.lit(x).alias(k) for k, x in zip(tick_level, pair)]) for i, pair in enumerate(pairs)
    ])
    repeated = ready.withColumn("_o", F.explode(passes)).select(*ready.columns, "_o.*")
    carry = ["rel_sd", "quality_reason", *([subject] if subject in floats else [])]
    runs = runs_below(repeated, [*keys, "pass"], anchor, p, t, v="sm", swept=True, carry=carry)
    options = F.array(*[
        F.struct(
            F.lit(i).alias("setting"), F.lit(pairs.index(tuple(float(s[k]) for k in tick_level))).alias("of_pass"),
            *[F.lit(float(s[k])).alias(k) for k in SWEPT if k not in tick_level],
        )
        for i, s in enumerate(settings)
    ])
    mine = F.filter(options, lambda o: o["of_pass"] == F.col("pass"))
    expanded = runs.withColumn("_o", F.explode(mine)).select(*runs.columns, "_o.*")
    shown = [subject] if subject in floats else []
    scored = _classify_runs(expanded, [*keys, "setting"], anchor, p, [*carry, "primary_min", "sensitivity_min"], True, shown)
    floor = F.element_at(F.array(*[F.lit(float(s["sensitivity_min"])) for s in settings]), F.col("setting") + 1)
    primary = F.col("reject_reason").isNull() & F.col("phase3_duration_s").isNotNull()
    sensitive = (
        (F.col("reject_reason").isNull() | F.col("reject_reason").isin(V.SHORT_RUN, V.NOT_RECOVERED))
        & F.coalesce(F.col("phase3_duration_s") >= floor, F.lit(False))
    )
    by_subject = scored.groupBy("setting", subject).agg(
        F.count_if(primary).alias("np"), F.count_if(sensitive).alias("ns")
    )
    counts = by_subject.groupBy("setting").agg(
        F.sum("np").alias("n_primary_events"), F.count_if(F.col("np") > 0).alias("n_primary_patients"),
        F.sum("ns").alias("n_sensitivity_events"), F.count_if(F.col("ns") > 0).alias("n_sensitivity_patients"),
    )
    spark = trace.sparkSession
    named = spark.createDataFrame(
        [(i, s["parameter"], s["value"]) for i, s in enumerate(settings)], "setting int, parameter string, value string"
    )
    # The settings list is a literal of the call, so it is broadcast by construction.
    return F.broadcast(named).join(counts, "setting", "left").fillna(0).select(
        "parameter", "value", "n_primary_events", "n_primary_patients", "n_sensitivity_events", "n_sensitivity_patients"
    )
