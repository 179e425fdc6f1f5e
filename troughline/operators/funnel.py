"""Screening funnel, yields, per-subject counts and everything read off an inventory."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.functions.labels import at_least, call_label, evaluable, measured, reason_in
from troughline.schema import INVENTORY, InventoryColumns, require_columns
from troughline.session import cut_lineage, with_scalars


def signature_at(
    floor_s: float, reasons: Iterable[str | None], cols: InventoryColumns = INVENTORY
) -> Column:
    """Rows whose reason is admitted and whose measured run lasts at least `floor_s`."""
    return reason_in(F.col(cols.reason), reasons) & at_least(F.col(cols.duration), floor_s)


def _is(reason: str, cols: InventoryColumns) -> Column:
    return F.coalesce(F.col(cols.reason) == reason, F.lit(False))


def _subject_counts(inv: DataFrame, primary_s: float, sensitivity_s: float, cols: InventoryColumns) -> DataFrame:
    require_columns(inv, cols.subject, cols.duration, cols.qc_valid, cols.reason, what="inventory")
    n = lambda cond, name: F.count_if(cond).alias(name)
    return inv.groupBy(cols.subject).agg(
        F.count(F.lit(1)).alias("n_total"),
        n(evaluable(F.col(cols.reason), V.UNUSABLE_REASONS), "n_evaluable"),
        n(_is(V.NO_SIGNAL, cols), "n_no_pleth"),
        n(_is(V.SIGNAL_MOSTLY_MISSING, cols), "n_pleth_nan"),
        n(F.col(cols.qc_valid), "n_qc_pass"),
        n(_is(V.NO_DIP, cols), "n_no_phase2"),
        n(_is(V.NOT_ALIGNED, cols) | _is(V.NOT_ALIGNED_LEGACY, cols), "n_misaligned"),
        n(_is(V.SHORT_RUN, cols), "n_stat_mode"),
        n(_is(V.NOT_RECOVERED, cols), "n_no_recovery"),
        n(signature_at(primary_s, V.PRIMARY_REASONS, cols), "n_primary"),
        n(signature_at(sensitivity_s, V.SENSITIVITY_REASONS, cols), "n_sensitivity"),
    )


def per_subject(
    inv: DataFrame, primary_s: float = V.PRIMARY_MIN_S, sensitivity_s: float = V.SENSITIVITY_MIN_S,
    cols: InventoryColumns = INVENTORY,
) -> DataFrame:
    """One row per subject: counts and has-flags."""
    return _subject_counts(inv, primary_s, sensitivity_s, cols).select(
        cols.subject, "n_total", "n_evaluable", "n_no_pleth", "n_qc_pass", "n_stat_mode",
        F.col("n_primary").alias("n_occlusion_signature_primary"),
        F.col("n_sensitivity").alias("n_occlusion_signature_sensitivity"),
        (F.col("n_primary") >= 1).alias("has_occlusion_signature_primary"),
        (F.col("n_sensitivity") >= 1).alias("has_occlusion_signature_sensitivity"),
    )


def _totals(inv: DataFrame, primary_s: float, sensitivity_s: float, cols: InventoryColumns) -> DataFrame:
    """One row. Distinct subjects fall out of the per-subject counts: one shuffle, no Expand."""
    by_subject = _subject_counts(inv, primary_s, sensitivity_s, cols)
    counts = [c for c in by_subject.columns if c != cols.subject]
    return by_subject.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        F.count(F.lit(1)).alias("s_total"),
        F.count_if(F.col("n_qc_pass") > 0).alias("s_qc_pass"),
        F.count_if(F.col("n_primary") > 0).alias("s_primary"),
        F.count_if(F.col("n_sensitivity") > 0).alias("s_sensitivity"),
    )


def funnel(
    inv: DataFrame, primary_s: float = V.PRIMARY_MIN_S, sensitivity_s: float = V.SENSITIVITY_MIN_S,
    cols: InventoryColumns = INVENTORY,
) -> DataFrame:
    """The 11 screening stages in order: `stage, events, patients, note`."""
    stages: list[tuple[str, str, str | None, str]] = [
        (stage, events, patients, V.FUNNEL_NOTES[stage])
        for stage, events, patients in (
            ("candidate_cuff_cycles", "n_total", "s_total"),
            ("excluded_no_pleth", "n_no_pleth", None),
            ("excluded_pleth_mostly_nan", "n_pleth_nan", None),
            ("evaluable_with_pleth", "n_evaluable", None),
            ("qc_pass_pre_window", "n_qc_pass", "s_qc_pass"),
            ("rejected_no_phase2", "n_no_phase2", None),
            ("rejected_misaligned", "n_misaligned", None),
            ("stat_mode_short_envelope", "n_stat_mode", None),
            ("rejected_no_recovery", "n_no_recovery", None),
        )
    ]
    for tier, floor_s in (("primary", primary_s), ("sensitivity", sensitivity_s)):
        stages.append((f"occlusion_signature_{tier}_{floor_s:g}s", f"n_{tier}", f"s_{tier}",
                       f"reperfusion envelope >= {floor_s:g} s ({tier})"))
    rows = [
        F.struct(
            F.lit(stage).alias("stage"), F.col(events).alias("events"),
            (F.col(patients) if patients else F.lit(0).cast("bigint")).alias("patients"),
            F.lit(note).alias("note"),
        )
        for stage, events, patients, note in stages
    ]
    return _totals(inv, primary_s, sensitivity_s, cols).select(F.inline(F.array(*rows)))


def yields(
    inv: DataFrame, primary_s: float = V.PRIMARY_MIN_S, sensitivity_s: float = V.SENSITIVITY_MIN_S,
    cols: InventoryColumns = INVENTORY,
) -> DataFrame:
    """Events, distinct subjects and share of all candidates at both thresholds."""
    rows = [
        F.struct(
            F.lit(tier).alias("tier"), F.lit(float(floor_s)).alias("phase3_min_s"),
            F.col(f"n_{tier}").alias("n_events"), F.col(f"s_{tier}").alias("n_patients"),
            F.try_divide(100.0 * F.col(f"n_{tier}"), F.col("n_total")).alias("pct_of_candidates"),
        )
        for tier, floor_s in (("primary", primary_s), ("sensitivity", sensitivity_s))
    ]
    return _totals(inv, primary_s, sensitivity_s, cols).select(F.inline(F.array(*rows)))


def yield_subjects(
    inv: DataFrame, primary_s: float = V.PRIMARY_MIN_S, sensitivity_s: float = V.SENSITIVITY_MIN_S,
    cols: InventoryColumns = INVENTORY,
) -> DataFrame:
    """The subjects behind each yield as rows: a subject list has no size bound."""
    return (
        per_subject(inv, primary_s, sensitivity_s, cols)
        .select(cols.subject, F.explode(F.array_compact(F.array(
            F.when(F.col("has_occlusion_signature_primary"), "primary"),
            F.when(F.col("has_occlusion_signature_sensitivity"), "sensitivity"),
        ))).alias("tier"))
        .select("tier", cols.subject)
    )


def reason_counts(inv: DataFrame, cols: InventoryColumns = INVENTORY, success: str = "primary") -> DataFrame:
    """Rows per outcome reason, most frequent first; NULL reads as `success`."""
    return (
        inv.groupBy(F.coalesce(F.col(cols.reason), F.lit(success)).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "reason")
    )


def headline(
    inv: DataFrame, primary_s: float = V.PRIMARY_MIN_S, sensitivity_s: float = V.SENSITIVITY_MIN_S,
    cols: InventoryColumns = INVENTORY,
) -> DataFrame:
    """The nine headline counts in one row, read off the funnel rows."""
    stages = funnel(inv, primary_s, sensitivity_s, cols)
    pick = lambda stage, col, name: F.max(F.when(F.col("stage").startswith(stage), F.col(col))).alias(name)
    row = stages.agg(
        pick("candidate_cuff_cycles", "events", "n_candidates"),
        pick("excluded_no_pleth", "events", "excluded_no_pleth"),
        pick("qc_pass_pre_window", "events", "qc_pass_pre_window_events"),
        pick("qc_pass_pre_window", "patients", "qc_pass_pre_window_patients"),
        pick("occlusion_signature_primary", "events", "primary_events"),
        pick("occlusion_signature_primary", "patients", "primary_patients"),
        pick("occlusion_signature_sensitivity", "events", "sensitivity_events"),
        pick("occlusion_signature_sensitivity", "patients", "sensitivity_patients"),
    )
    records = inv.select(cols.record).distinct().agg(F.count(F.lit(1)).alias("n_records"))
    return with_scalars(row, records)


def tier_counts(
    inv: DataFrame, depth_cut: float = V.NADIR_DEPTH, primary_s: float = V.PRIMARY_MIN_S,
    sensitivity_s: float = V.SENSITIVITY_MIN_S, cols: InventoryColumns = INVENTORY,
) -> DataFrame:
    """Measured rows, their duration tiers and whether the tiers nest as they must."""
    m = measured(F.col(cols.depth))
    row = inv.where(m).agg(
        F.count(F.lit(1)).alias("n_measured"),
        F.count_if(F.col(cols.signature)).alias("n_signature"),
        F.count_if(F.col(cols.depth) < depth_cut).alias("n_below_gate"),
        F.count_if(at_least(F.col(cols.duration), sensitivity_s)).alias("n_sensitivity_tier"),
        F.count_if(at_least(F.col(cols.duration), primary_s)).alias("n_primary_tier"),
    )
    return row.select(
        "*",
        (F.col("n_below_gate") == F.col("n_measured")).alias("gate_ok"),
        (F.col("n_sensitivity_tier") == F.col("n_measured")).alias("sensitivity_ok"),
        (F.col("n_primary_tier") >= F.col("n_signature")).alias("primary_ok"),
    )


def most_represented(
    inv: DataFrame, reason: str, groups: tuple[str, ...] | None = None, cols: InventoryColumns = INVENTORY
) -> DataFrame:
    """The group with the most rows of `reason`, ties by group keys; no such row, no result."""
    groups = groups or (cols.subject, cols.record)
    return (
        inv.where(F.col(cols.reason) == reason)
        .groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), *groups)
        .limit(1)
    )


def first_row(rows: DataFrame, order: Sequence[Column], what: str = "row", cols: InventoryColumns = INVENTORY) -> DataFrame:
    """The row that comes first by `order`, then by subject, record and anchor; missing values come last.

    One mergeable `min` of an ordering struct: each task sends a row, nothing is sorted. Where there is no row the
    query fails when it runs.
    """
    last_if_missing = [F.struct(k.isNull().alias("absent"), k.alias("value")) for k in [*order, *map(F.col, (cols.subject, cols.record, cols.anchor))]]
    whole = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(last_if_missing)], F.struct(*rows.columns).alias("row"))
    best = rows.agg(F.min(whole).alias("_best"))
    none = F.col("_best").isNull()
    checked = best.where(F.when(none, F.raise_error(F.lit(f"no {what}")).cast("boolean")).otherwise(True))
    return checked.select("_best.row.*")


# Illustration preferences, best first: (reason, valid only, sort column role, descending).
UNUSABLE_PREFERENCES = (
    (V.NO_SIGNAL, False, None, False),
    (V.BASELINE_UNSTABLE, False, "quality", True),
    (V.NO_DIP, True, "quality", False),
    (V.SIGNAL_MOSTLY_MISSING, False, None, False),
    (V.BASELINE_IMPLAUSIBLE, False, None, False),
)


def unusable_panels(inv: DataFrame, n_panels: int = 3, cols: InventoryColumns = INVENTORY) -> DataFrame:
    """Per preferred reason that occurs (first `n_panels`): one row of its most-represented record.

    Both choices are mergeable `min` aggregates of ordering structs; the reasons are a fixed
    list, so the only group that is ever large, (reason, record), is counted map-side.
    """
    rank = F.lit(None).cast("int")
    sort_key = F.lit(None).cast("double")
    needs_valid = F.lit(False)
    for i, (reason, valid, role, desc) in reversed(list(enumerate(UNUSABLE_PREFERENCES))):
        hit = F.col(cols.reason) == reason
        rank = F.when(hit, F.lit(i)).otherwise(rank)
        needs_valid = F.when(hit, F.lit(valid)).otherwise(needs_valid)
        if role:
            v = F.col(getattr(cols, role)).cast("double")
            sort_key = F.when(hit, -v if desc else v).otherwise(sort_key)
    keyed = inv.select(
        rank.alias("preference"), F.col(cols.reason).alias("reason"), F.col(cols.subject), F.col(cols.record),
        F.col(cols.anchor), sort_key.alias("_key"), (~needs_valid | F.col(cols.qc_valid)).alias("_ok"),
    ).where(F.col("preference").isNotNull())
    per_record = keyed.groupBy("preference", "reason", cols.subject, cols.record).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("_ok"), F.struct(F.coalesce("_key", F.lit(float("inf"))).alias("k"), F.col(cols.anchor)))).alias("first"),
    )
    per_reason = per_record.groupBy("preference", "reason").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col(cols.subject), F.col(cols.record), F.col("first"))).alias("m")
    )
    chosen = per_reason.orderBy("preference").limit(n_panels)
    return chosen.select(
        "preference", "reason", F.col(f"m.{cols.subject}").alias(cols.subject), F.col(f"m.{cols.record}").alias(cols.record),
        (-F.col("m.n")).alias("n_events"), F.col(f"m.first.{cols.anchor}").alias(cols.anchor),
    )


def preferred_event(
    inv: DataFrame, pins: tuple[tuple[str, float], ...], fallback_subjects: tuple[str, ...] = (),
    floor_s: float = V.PRIMARY_MIN_S, tol_s: float = 1.0, cols: InventoryColumns = INVENTORY,
) -> DataFrame:
    """One primary row: the first pinned (subject, time) that exists, else a fallback subject's first."""
    survivors = inv.where(F.col(cols.reason).isNull() & at_least(F.col(cols.duration), floor_s))
    priority = F.lit(None).cast("int")
    gap = F.lit(0.0)
    for i, subject in reversed(list(enumerate(fallback_subjects))):
        priority = F.when(F.col(cols.subject) == subject, F.lit(len(pins) + i)).otherwise(priority)
    for i, (subject, t) in reversed(list(enumerate(pins))):
        near = (F.col(cols.subject) == subject) & (F.abs(F.col(cols.anchor) - t) <= tol_s)
        priority = F.when(near, F.lit(i)).otherwise(priority)
        gap = F.when(near, F.abs(F.col(cols.anchor) - t)).otherwise(gap)
    return (
        survivors.withColumn("priority", priority).withColumn("_gap", gap)
        .where(F.col("priority").isNotNull())
        .orderBy("priority", "_gap", cols.anchor, cols.record)
        .limit(1)
        .drop("_gap")
    )


def flow_counts(
    inv: DataFrame, manifest: DataFrame, reader: DataFrame, stratum: str = "stratum", call: str = "call",
    cols: InventoryColumns = INVENTORY,
) -> DataFrame:
    """Every count of the study flow, pools, sampled cards, weights and calls, in one row."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    # The inventory is read once, for a row per subject and record; everything else is counted from those.
    base = cut_lineage(inv.groupBy(cols.subject, cols.record).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        n(_is(V.NO_SIGNAL, cols), "n_no_pleth"),
        n(_is(V.SIGNAL_MOSTLY_MISSING, cols), "n_pleth_nan"),
        n(F.col(cols.qc_valid), "n_qc_pass"),
        n(F.col(cols.reason).isNull(), "n_detector_positive"),
        n(_is(V.SHORT_RUN, cols) | _is(V.NOT_RECOVERED, cols), "n_near_miss_pool"),
        n(_is(V.NOT_ALIGNED, cols), "n_uncovered_no_align"),
        n(_is(V.BASELINE_IMPLAUSIBLE, cols), "n_uncovered_implausible"),
    ))
    sums = [c for c in base.columns if c not in (cols.subject, cols.record)]
    totals = base.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    number = lambda c, name: base.select(c).distinct().agg(F.count(F.lit(1)).alias(name))
    totals = with_scalars(with_scalars(totals, number(cols.subject, "n_subjects")), number(cols.record, "n_records"))
    cards = manifest.groupBy(cols.subject).agg(
        F.count(F.lit(1)).alias("n_gallery"),
        n(F.col(stratum) == V.STRATUM_POSITIVE, "n_sampled_positive"),
        n(F.col(stratum) == V.STRATUM_NEAR_MISS, "n_sampled_near_miss"),
        n(F.col(stratum) == V.STRATUM_NEGATIVE, "n_sampled_negative"),
    )
    card_totals = cards.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cards.columns if c != cols.subject],
        F.count(F.lit(1)).alias("n_gallery_subjects"),
    )
    calls = reader.agg(
        n(F.col(call) == V.PRESENT, "n_reader_present"),
        n(F.col(call) == V.ABSENT, "n_reader_absent"),
        n(F.col(call) == V.INDETERMINATE, "n_reader_indeterminate"),
    )
    row = with_scalars(with_scalars(totals, card_totals), calls)
    c = F.col
    row = (
        row.withColumn("n_evaluable", c("n_candidates") - c("n_no_pleth") - c("n_pleth_nan"))
        .withColumn("n_uncovered", c("n_uncovered_no_align") + c("n_uncovered_implausible"))
        .withColumn("n_negative_pool", c("n_evaluable") - c("n_detector_positive") - c("n_near_miss_pool") - c("n_uncovered"))
        .withColumn("coverage", c("n_detector_positive") + c("n_near_miss_pool") + c("n_negative_pool"))
    )
    return (
        row.withColumn("coverage_pct", F.try_divide(100.0 * c("coverage"), c("n_evaluable")))
        .withColumn("pct_detector_positive", F.try_divide(100.0 * c("n_detector_positive"), c("n_qc_pass")))
        .withColumn("weight_positive", F.try_divide(c("n_detector_positive").cast("double"), c("n_sampled_positive")))
        .withColumn("weight_near_miss", F.try_divide(c("n_near_miss_pool").cast("double"), c("n_sampled_near_miss")))
        .withColumn("weight_negative", F.try_divide(c("n_negative_pool").cast("double"), c("n_sampled_negative")))
    )


def call_rates(
    log: DataFrame, call: str = "call", parsed: str = "parsed_ok", by: tuple[str, ...] = ()
) -> DataFrame:
    """Call counts of a run log with the callable, uncallable and headline rates."""
    from troughline.functions.labels import safe_ratio, tolerant_flag

    ok = tolerant_flag(F.col(parsed))
    counted = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(ok).alias("n_parsed"),
        F.count_if(ok & (F.col(call) == V.PRESENT)).alias("n_present"),
        F.count_if(ok & (F.col(call) == V.ABSENT)).alias("n_absent"),
        F.count_if(ok & (F.col(call) == V.INDETERMINATE)).alias("n_indeterminate"),
    )
    full = counted.withColumn("n_callable", F.col("n_present") + F.col("n_absent")).withColumn(
        "n_uncallable", F.col("n_indeterminate") + F.col("n_total") - F.col("n_parsed")
    )
    return full.select(
        *by, "n_total", "n_parsed", "n_uncallable", "n_callable", "n_present",
        safe_ratio(F.col("n_callable"), F.col("n_total")).alias("callable_rate"),
        safe_ratio(F.col("n_uncallable"), F.col("n_total")).alias("uncallable_rate"),
        safe_ratio(F.col("n_present"), F.col("n_callable")).alias("headline_rate_per_callable"),
    )


def signature_label(cols: InventoryColumns = INVENTORY) -> Column:
    return call_label(F.col(cols.signature))
