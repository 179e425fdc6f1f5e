"""Queries over events (ticked traces, nearest events) and over order spans (interval linkage)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.operators import detect, linkage, quality, signal
from troughline.plans.registry import query
from troughline.plans.views import TRACE_SQL, table, trace_rows, trace_windows
from troughline.session import with_scalars

KEYS = ["series", "anchor"]
# Settings suited to the given events table; the operator's defaults are the published ones.
P = detect.Detector(
    nadir_depth=0.6, occlusion_fraction=0.9, recovery_fraction=0.95, recovery_hold=2, primary_min=4.0, sensitivity_min=2.0,
    plausible_lo=10.0, plausible_hi=60.0,
)


# --- interval linkage ------------------------------------------------------------------------------------

SPANS_SQL = """rec AS (SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_custkey AS subject_id, min(o_orderdate) AS record_start, max(l_shipdate) AS record_end
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
stay AS (SELECT o_custkey AS subject_id, year(o_orderdate) * 4 + quarter(o_orderdate) AS stay_id, min(o_orderdate) AS intime, max(o_orderdate) AS outtime FROM orders GROUP BY 1, 2),
hit AS (SELECT record_id, rec.subject_id, stay_id, record_start, record_end, intime AS stay_intime, outtime AS stay_outtime,
 epoch(least(record_end, outtime)) - epoch(greatest(record_start, intime)) AS overlap_s
 FROM rec JOIN stay ON rec.subject_id = stay.subject_id AND record_start < outtime AND intime < record_end WHERE record_end > record_start AND outtime > intime)"""


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    ship = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("record_end"))
    records = orders.join(ship, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("record_start"), "record_end",
    )
    stays = orders.groupBy(
        F.col("o_custkey").alias("subject_id"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("bigint").alias("stay_id")
    ).agg(F.min("o_orderdate").alias("intime"), F.max("o_orderdate").alias("outtime"))
    return records, stays


YEAR_S = 365 * 86_400


@query("c01_interval_overlap", f"WITH {SPANS_SQL} SELECT record_id, subject_id, stay_id, overlap_s FROM hit")
def c01(spark: SparkSession, d: str) -> DataFrame:
    records, stays = _spans(spark, d)
    pairs = linkage.interval_overlap_join(records, stays, "subject_id", ("record_start", "record_end"), ("intime", "outtime"), YEAR_S)
    return pairs.select("record_id", "subject_id", "stay_id", "overlap_s")


@query("c02_modal_match", f"""WITH {SPANS_SQL} SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY overlap_s DESC, stay_intime, stay_id) = 1 AS is_modal FROM hit""")
def c02(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(*_spans(spark, d), bucket_s=YEAR_S)


@query("c03_pruned_intervals", f"WITH {SPANS_SQL} SELECT record_id, record_start, record_end FROM rec WHERE record_start IS NOT NULL AND record_end > record_start")
def c03(spark: SparkSession, d: str) -> DataFrame:
    records, _ = _spans(spark, d)
    return linkage.prune_intervals(records, "record_start", "record_end", ["subject_id"]).select("record_id", "record_start", "record_end")


EV_SQL = "ev AS (SELECT event_id, user_id, event_type, (epoch_us(ts)) / 1e6 AS t, value FROM events)"


def _ev(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), "value")


@query("c11_nearest_within_tol", f"""WITH {EV_SQL}, c AS (SELECT a.event_id, a.user_id, b.t AS click_t, b.event_id AS click_id, abs(b.t - a.t) AS gap FROM ev a JOIN ev b ON a.user_id = b.user_id
 AND a.event_type = 'purchase' AND b.event_type = 'click' AND abs(b.t - a.t) <= 86400e0)
SELECT event_id, user_id, click_id, round(gap, 3) AS gap_s FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap, click_t, click_id) = 1""")
def c11(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    targets = ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", "t")
    clicks = ev.where(F.col("event_type") == "click").select("user_id", F.col("t").alias("click_t"), F.col("event_id").alias("click_id"))
    near = linkage.nearest_within(targets, clicks, "user_id", "t", "click_t", 86_400.0, ["event_id"], ["click_id"])
    return near.select("event_id", "user_id", "click_id", F.round("gap_s", 3).alias("gap_s"))


# --- anchor windows over raw events -----------------------------------------------------------------------

REACH_S = 3 * 3600.0
ANCHORED_SQL = f"""{EV_SQL}, anc AS (SELECT event_id, user_id, t AS t_nbp FROM ev WHERE event_type = 'signup'),
win AS (SELECT a.event_id, a.user_id, a.t_nbp, s.t, s.value FROM anc a LEFT JOIN ev s ON a.user_id = s.user_id AND s.event_type <> 'signup' AND s.t >= a.t_nbp - {REACH_S}::DOUBLE AND s.t < a.t_nbp + {REACH_S}::DOUBLE)"""


def _anchored(spark: SparkSession, d: str, how: str) -> DataFrame:
    ev = _ev(spark, d)
    anchors = ev.where(F.col("event_type") == "signup").select("event_id", "user_id", F.col("t").alias("t_nbp"))
    samples = ev.where(F.col("event_type") != "signup").select("user_id", "t", "value")
    return linkage.anchor_windows(anchors, samples, "user_id", "t_nbp", "t", REACH_S, REACH_S, how)


@query("c10_anchor_window", f"""WITH {ANCHORED_SQL} SELECT event_id, count(t) AS n_samples, round(min(t) - any_value(t_nbp), 3) AS first_s, round(sum(value), 4) AS total,
 CASE WHEN count(t) = 0 THEN 'no_pleth' END AS reason FROM win GROUP BY 1""")
def c10(spark: SparkSession, d: str) -> DataFrame:
    return _anchored(spark, d, "left").groupBy("event_id").agg(
        F.count("t").alias("n_samples"), F.round(F.min("t") - F.first("t_nbp"), 3).alias("first_s"), F.round(F.sum("value"), 4).alias("total"),
        F.when(F.count("t") == 0, V.NO_SIGNAL).alias("reason"),
    )


# Values above 60 count as missing here, so windows with every kind of gap occur.
@query("b13_gap_fill", f"""WITH {ANCHORED_SQL}, w AS (SELECT event_id, t, CASE WHEN value <= 60e0 THEN value END AS v FROM win WHERE t IS NOT NULL),
s AS (SELECT *, avg(CASE WHEN v IS NULL THEN 0e0 ELSE 1e0 END) OVER (PARTITION BY event_id) AS share, median(v) OVER (PARTITION BY event_id) AS m FROM w)
SELECT event_id, round(t, 3) AS t, round(share, 6) AS valid_fraction, share < 0.5e0 AS rejected, CASE WHEN share >= 0.5e0 THEN round(coalesce(v, m), 4) END AS filled FROM s""")
def b13(spark: SparkSession, d: str) -> DataFrame:
    gappy = _anchored(spark, d, "inner").withColumn("v", F.when(F.col("value") <= 60, F.col("value")))
    filled = signal.fill_gaps(gappy, ["event_id"], "v")
    return filled.select("event_id", F.round("t", 3).alias("t"), F.round("valid_fraction", 6).alias("valid_fraction"), "rejected", F.round("filled", 4).alias("filled"))


# --- detector steps ------------------------------------------------------------------------------------------

SMOOTH_SQL = f"""{TRACE_SQL},
sm0 AS (SELECT *, median(v) OVER w AS med, count(v) OVER w AS nv, count(*) OVER w AS nr FROM windows WINDOW w AS (PARTITION BY series, anchor ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
sm AS (SELECT series, anchor, t, CASE WHEN nv = nr THEN med END AS sm FROM sm0)"""
BASE_SQL = f"""{SMOOTH_SQL},
pre AS (SELECT series, anchor, count(sm) AS n_finite, count(*) AS n_pre, median(sm) AS med, stddev_pop(sm) AS sd FROM sm WHERE t >= anchor - 120 AND t < anchor - 60 GROUP BY 1, 2),
base AS (SELECT a.series, a.anchor, coalesce(n_pre, 0) AS n_pre, coalesce(n_finite, 0) AS n_finite, CASE WHEN n_finite >= 30 THEN med END AS baseline,
 CASE WHEN n_finite >= 30 AND med > 0 THEN sd / med END AS rel_sd,
 CASE WHEN coalesce(n_finite, 0) < 30 THEN 'no_pre_window' WHEN med < 10 OR med > 60 THEN 'pre_pi_implausible' WHEN sd / med IS NULL OR sd / med > 0.30e0 THEN 'pre_window_unstable' END AS quality_reason
 FROM anchors a LEFT JOIN pre USING (series, anchor))"""
SEARCH_SQL = f"""{BASE_SQL},
srch AS (SELECT s.*, b.baseline, coalesce(s.sm < {P.occlusion_fraction}::DOUBLE * b.baseline, false) AS below, coalesce(s.sm >= {P.recovery_fraction}::DOUBLE * b.baseline, false) AS above
 FROM sm s JOIN base b USING (series, anchor) WHERE t >= anchor - 60 AND t < anchor + 90),
isl AS (SELECT *, t - row_number() OVER (PARTITION BY series, anchor, below ORDER BY t) AS grp FROM srch),
run0 AS (SELECT series, anchor, grp, min(t) AS t_start, max(t) AS t_end, min(sm) AS low, any_value(baseline) AS baseline FROM isl WHERE below GROUP BY 1, 2, 3),
run1 AS (SELECT r.*, (SELECT min(t) FROM isl i WHERE i.series = r.series AND i.anchor = r.anchor AND i.t BETWEEN r.t_start AND r.t_end AND i.sm = r.low) AS t_nadir FROM run0 r),
held AS (SELECT series, anchor, t, sm, above AND coalesce(lead(above) OVER (PARTITION BY series, anchor ORDER BY t), false) AS held FROM srch),
run AS (SELECT r.series, r.anchor, r.t_start, r.t_end, r.t_nadir, r.low, r.baseline, CAST(r.t_end - r.t_start AS DOUBLE) AS duration, r.low / r.baseline AS depth_frac, CAST(r.t_nadir - r.anchor AS DOUBLE) AS off,
 min(h.t) FILTER (h.held) AS t_release, CASE WHEN count(h.sm) = count(*) THEN max(h.sm) / r.baseline END AS recovery_end
 FROM run1 r JOIN held h ON h.series = r.series AND h.anchor = r.anchor AND h.t >= r.t_nadir GROUP BY r.series, r.anchor, r.t_start, r.t_end, r.t_nadir, r.low, r.baseline)"""
QUAL_SQL = f"""{SEARCH_SQL},
qual AS (SELECT *, duration >= 2 AND low < 0.6e0 * baseline AS qualifies, duration >= 2 AND low < 0.6e0 * baseline AND off BETWEEN -50 AND 30 AS aligned FROM run)"""
PICK_SQL = f"""{QUAL_SQL},
deep AS (SELECT *, min(depth_frac) OVER (PARTITION BY series, anchor) AS deepest FROM qual WHERE aligned),
sel AS (SELECT * FROM deep WHERE depth_frac <= deepest + 0.01e0 QUALIFY row_number() OVER (PARTITION BY series, anchor ORDER BY abs(off), t_start) = 1)"""
EVENT_SQL = f"""{PICK_SQL},
nq AS (SELECT series, anchor, count(*) FILTER (qualifies) AS n_qualifying FROM qual GROUP BY 1, 2),
cls AS (SELECT b.series, b.anchor, b.baseline, b.rel_sd, b.quality_reason, s.*  EXCLUDE (series, anchor, baseline), coalesce(n_qualifying, 0) AS n_qualifying,
 CASE WHEN quality_reason IS NOT NULL THEN quality_reason WHEN coalesce(n_qualifying, 0) = 0 THEN 'no_phase2' WHEN s.t_nadir IS NULL THEN 'no_aligned_occlusion'
  WHEN s.t_release IS NULL THEN 'no_recovery_in_window' WHEN s.duration < 4 THEN 'stat_mode_short_phase3' END AS reject_reason
 FROM base b LEFT JOIN nq USING (series, anchor) LEFT JOIN sel s ON s.series = b.series AND s.anchor = b.anchor AND b.quality_reason IS NULL)"""


def _smoothed(spark: SparkSession, d: str) -> DataFrame:
    return detect.rolling_median(trace_windows(spark, d).repartition(*KEYS), KEYS)


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return detect.prepare(trace_windows(spark, d), KEYS, p=P, n_rows=trace_rows(spark, d))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return detect.qualify_runs(detect.runs_below(_prepared(spark, d), KEYS, p=P), P)


@query("f02_rolling_median", f"WITH {SMOOTH_SQL} SELECT series, anchor, t, round(sm, 6) AS sm FROM sm")
def f02(spark: SparkSession, d: str) -> DataFrame:
    return _smoothed(spark, d).select("series", "anchor", "t", F.round("sm", 6).alias("sm"))


@query("f03_baseline_qc", f"""WITH {BASE_SQL} SELECT series, anchor, n_finite, round(baseline, 6) AS baseline, round(rel_sd, 6) AS rel_sd, quality_reason FROM base""")
def f03(spark: SparkSession, d: str) -> DataFrame:
    rows = _prepared(spark, d).groupBy(*KEYS).agg(
        F.first("n_finite").alias("n_finite"), F.round(F.first("baseline"), 6).alias("baseline"),
        F.round(F.first("rel_sd"), 6).alias("rel_sd"), F.first("quality_reason").alias("quality_reason"),
    )
    return rows


@query("f04_runs_below", f"WITH {SEARCH_SQL} SELECT series, anchor, t_start, t_end, duration, round(depth_frac, 6) AS depth_frac FROM run")
def f04(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("series", "anchor", "t_start", "t_end", "duration", F.round("depth_frac", 6).alias("depth_frac"))


@query("f05_qualifying_runs", f"WITH {QUAL_SQL} SELECT series, anchor, t_start, t_nadir, aligned FROM qual WHERE qualifies")
def f05(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).where("qualifies").select("series", "anchor", "t_start", "t_nadir", "aligned")


@query("f06_select_run", f"WITH {PICK_SQL} SELECT series, anchor, t_start, t_end, t_nadir, round(depth_frac, 6) AS depth_frac, off AS \"offset\" FROM sel")
def f06(spark: SparkSession, d: str) -> DataFrame:
    return detect.select_run(_runs(spark, d), KEYS, P).select(
        "series", "anchor", "t_start", "t_end", "t_nadir", F.round("depth_frac", 6).alias("depth_frac"), "offset"
    )


@query("f07_release_hold", f"WITH {PICK_SQL} SELECT series, anchor, t_nadir, t_release, round(recovery_end, 6) AS recovery_end FROM sel")
def f07(spark: SparkSession, d: str) -> DataFrame:
    return detect.select_run(_runs(spark, d), KEYS, P).select(
        "series", "anchor", "t_nadir", "t_release", F.round("recovery_end", 6).alias("recovery_end")
    )


@query("f08_signature_events", f"""WITH {EVENT_SQL} SELECT series, anchor, reject_reason IS NULL AS is_occlusion_signature, t_nadir IS NOT NULL AND reject_reason IS NOT NULL AS stat_mode_candidate,
 t_nadir IS NOT NULL AND t_release IS NOT NULL AS recovered, quality_reason IS NULL AND n_qualifying >= 2 AS ambiguous_multi_dip, round(baseline, 6) AS pre_event_pi_mean, round(rel_sd, 6) AS pre_window_quality,
 quality_reason IS NULL AS pre_window_valid, CAST(t_start AS DOUBLE) AS t_occlusion_start_s, CAST(t_nadir AS DOUBLE) AS t_nadir_s, CAST(t_release AS DOUBLE) AS t_release_s,
 CAST(t_nadir - t_start AS DOUBLE) AS phase2_duration_s, duration AS phase3_duration_s, round(depth_frac, 6) AS nadir_depth_frac, round(recovery_end, 6) AS recovery_fraction_at_window_end, off AS alignment_offset_s, reject_reason FROM cls""")
def f08(spark: SparkSession, d: str) -> DataFrame:
    out = detect.classify(trace_windows(spark, d), KEYS, p=P, n_rows=trace_rows(spark, d)).drop("t_deflate_start_s")
    rounded = ["pre_event_pi_mean", "pre_window_quality", "nadir_depth_frac", "recovery_fraction_at_window_end"]
    return out.withColumns({c: F.round(c, 6) for c in rounded})


@query("b12_record_time", f"WITH {EVENT_SQL} SELECT series, anchor, CAST(t_nadir - anchor + 200 AS DOUBLE) AS local_nadir, CAST(t_nadir AS DOUBLE) AS t_nadir_s FROM cls")
def b12(spark: SparkSession, d: str) -> DataFrame:
    out = detect.classify(trace_windows(spark, d), KEYS, p=P, n_rows=trace_rows(spark, d))
    local = out.withColumn("local_nadir", F.col("t_nadir_s") - F.col("anchor") + 200.0)
    return local.select("series", "anchor", "local_nadir", signal.to_record_time("local_nadir", "anchor").alias("t_nadir_s"))


def _sweep_sql() -> str:
    settings = detect.sweep_settings(P, SWEEP)
    names = ["nadir_depth", "occlusion_fraction", "recovery_fraction", "align_lo", "align_hi", "primary_min", "sensitivity_min"]
    values = ", ".join(
        f"({i}, '{s['parameter']}', '{s['value']}', " + ", ".join(f"{float(s[n])!r}::DOUBLE" for n in names) + ")" for i, s in enumerate(settings)
    )
    return f"""WITH {BASE_SQL}, p(id, parameter, value, nd, ofr, rf, lo, hi, pm, sm_min) AS (VALUES {values}),
srch AS (SELECT p.*, s.series, s.anchor, s.t, s.sm, b.baseline, coalesce(s.sm < ofr * b.baseline, false) AS below, coalesce(s.sm >= rf * b.baseline, false) AS above
 FROM sm s JOIN base b USING (series, anchor), p WHERE t >= anchor - 60 AND t < anchor + 90 AND quality_reason IS NULL),
isl AS (SELECT *, t - row_number() OVER (PARTITION BY id, series, anchor, below ORDER BY t) AS grp, above AND coalesce(lead(above) OVER (PARTITION BY id, series, anchor ORDER BY t), false) AS held FROM srch),
run0 AS (SELECT id, series, anchor, grp, min(t) AS t_start, max(t) AS t_end, min(sm) AS low, arg_min(t, (sm, t)) AS t_nadir, any_value(baseline) AS baseline, any_value(nd) AS nd, any_value(lo) AS lo, any_value(hi) AS hi, any_value(pm) AS pm, any_value(sm_min) AS sm_min FROM isl WHERE below GROUP BY 1, 2, 3, 4),
al AS (SELECT *, t_nadir - anchor AS off, low / baseline AS frac, min(low / baseline) OVER (PARTITION BY id, series, anchor) AS deepest FROM run0 WHERE t_end - t_start >= sm_min AND low < nd * baseline AND t_nadir - anchor BETWEEN lo AND hi),
sel AS (SELECT * FROM al WHERE frac <= deepest + 0.01e0 QUALIFY row_number() OVER (PARTITION BY id, series, anchor ORDER BY abs(off), t_start) = 1),
rel AS (SELECT s.id, s.series, s.anchor, s.t_end - s.t_start AS dur, any_value(s.pm) AS pm, any_value(s.sm_min) AS sm_min, count(*) FILTER (i.held) > 0 AS recovered FROM sel s JOIN isl i ON i.id = s.id AND i.series = s.series AND i.anchor = s.anchor AND i.t >= s.t_nadir GROUP BY 1, 2, 3, 4)
SELECT p.parameter, p.value, count(r.series) FILTER (recovered AND dur >= r.pm) AS n_primary_events, count(DISTINCT r.series) FILTER (recovered AND dur >= r.pm) AS n_primary_patients,
 count(r.series) FILTER (dur >= r.sm_min) AS n_sensitivity_events, count(DISTINCT r.series) FILTER (dur >= r.sm_min) AS n_sensitivity_patients FROM p LEFT JOIN rel r USING (id) GROUP BY 1, 2"""


# The default grids, moved to the range the given events table reacts to.
SWEEP = (
    ("nadir_depth", tuple((f"{x:g}", {"nadir_depth": x}) for x in (0.5, 0.55, 0.6, 0.7))),
    ("recovery_fraction", tuple((f"{x:g}", {"recovery_fraction": x}) for x in (0.8, 0.9, 0.95, 1.0, 1.1))),
    *[g for g in V.SWEEP_GRIDS if g[0] == "alignment"],
    ("primary_min_s", tuple((f"{x:g}", {"primary_min": x}) for x in (2.0, 4.0, 6.0))),
)


@query("f10_param_sweep", _sweep_sql())
def f10(spark: SparkSession, d: str) -> DataFrame:
    return detect.sweep(trace_windows(spark, d), KEYS, "series", detect.sweep_settings(P, SWEEP), p=P, n_rows=trace_rows(spark, d))


# --- raw signal: events as samples ----------------------------------------------------------------------------

FS = 20.0


def _samples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as signal: one recording of all events and one per type, sampled on a grid of 0.8 ticks per event.

    About 71 % of the whole stream's ticks hold an event; single types are mostly missing. One
    anchor every 500 ticks.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = table(spark, d, "events").select("event_type", us.alias("us"), "value")
    grid = ev.agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.lit(1)).alias("n")).select(
        "lo", F.expr("greatest(1L, ((hi - lo) * 10) div (n * 8))").alias("tick")
    )
    placed = with_scalars(ev, grid).select(
        F.explode(F.array(F.lit("stream"), F.col("event_type"))).alias("record_id"), F.expr("(us - lo) div tick").alias("i"), "value"
    )
    ticks = placed.groupBy("record_id", "i").agg(F.avg("value").alias("value"))
    anchors = ticks.groupBy("record_id", F.expr("i div 500").alias("k")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("all").alias("subject_id"), "record_id", (F.col("k") * 500 / F.lit(FS)).alias("t_nbp")
    )
    return anchors, ticks.select("record_id", (F.col("i") / F.lit(FS)).alias("t_s"), "value")


def _bounds(anchors: DataFrame, samples: DataFrame) -> DataFrame:
    """Every recording lasts as long as the stream: from tick 0 to the last tick of all."""
    last = samples.agg(F.lit(0.0).alias("start_s"), (F.max("t_s") + 1 / FS).alias("end_s"))
    return with_scalars(anchors.select("record_id").distinct(), last)


@query("f01_signal_reduce")
def f01(spark: SparkSession, d: str) -> DataFrame:
    anchors, samples = _samples(spark, d)
    windows = linkage.anchor_windows(anchors.join(_bounds(anchors, samples), "record_id"), samples, "record_id").withColumn("a", F.col("t_nbp"))
    return signal.reduce_signal(windows, ["record_id", "t_nbp"], FS, "a", start="start_s", end="end_s").drop("a")


@query("f09_extract_events")
def f09(spark: SparkSession, d: str) -> DataFrame:
    anchors, samples = _samples(spark, d)
    return signal.extract_events(anchors, samples, FS, bounds=_bounds(anchors, samples))


@query("d37_run_window", """SELECT event_type, CASE WHEN count(nullif(s, '')) = count(*) THEN min(s) END AS run_utc_start, CASE WHEN count(nullif(s, '')) = count(*) THEN max(s) END AS run_utc_end, count(*) AS n_rows
FROM (SELECT event_type, CASE WHEN event_type = 'error' AND value < 1e0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS s FROM events) GROUP BY 1""")
def d37(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    log = table(spark, d, "events").select(
        "event_type", F.when((F.col("event_type") == "error") & (F.col("value") < 1), "").otherwise(stamp).alias("run_utc")
    )
    return quality.run_window(log, by=["event_type"])
