"""Scoring raters: joins with drop counts, confusion, binary metrics, agreement, concordance, change logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.functions.labels import (
    agreement_band, call_label, change_direction, collapse_binary, safe_percent, tolerant_flag, truthy,
)
from troughline.operators.bootstrap import mean_interval, ratio_intervals
from troughline.session import with_scalars

METRICS = ("precision", "recall", "specificity")


# --- joins -------------------------------------------------------------------------------------

def join_sources(manifest: DataFrame, reader: DataFrame, model: DataFrame, key: str = "card_id") -> DataFrame:
    """Cards present in all three sources."""
    return manifest.join(reader, key).join(model, key)


def source_drops(manifest: DataFrame, reader: DataFrame, model: DataFrame, key: str = "card_id") -> DataFrame:
    """Sizes of the three sources, of their join, and cards each source alone is missing.

    One presence table (union, then one mergeable aggregate per key) answers all counts.
    """
    tagged = None
    for i, df in enumerate((manifest, reader, model)):
        part = df.select(key, *[F.lit(int(i == j)).alias(f"n{j}") for j in range(3)])
        tagged = part if tagged is None else tagged.unionByName(part)
    seen = tagged.groupBy(key).agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(3)])
    has = [F.col(f"n{j}") > 0 for j in range(3)]
    return seen.agg(
        F.sum("n1").alias("n_reader"), F.sum("n2").alias("n_model"), F.sum("n0").alias("n_manifest"),
        F.coalesce(F.sum(F.col("n0") * F.col("n1") * F.col("n2")), F.lit(0)).alias("n_joined"),
        F.count_if(has[0] & has[2] & ~has[1]).alias("n_dropped_reader"),
        F.count_if(has[0] & has[1] & ~has[2]).alias("n_dropped_model"),
        F.count_if(has[1] & has[2] & ~has[0]).alias("n_dropped_manifest"),
    )


def resolve_all(df: DataFrame, lookup: DataFrame, key: str | Sequence[str], must: str, what: str) -> DataFrame:
    """Left join whose every row must find `must`; a gap fails the job that reads it."""
    joined = df.join(lookup, key, "left")
    keys = [key] if isinstance(key, str) else list(key)
    message = F.concat(F.lit(f"{what} did not resolve for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    kept = F.when(F.col(must).isNotNull(), F.col(must)).otherwise(
        F.raise_error(message).cast(joined.schema[must].dataType)
    )
    return joined.withColumn(must, kept)


def deblind(
    export: DataFrame, blind_map: DataFrame, manifest: DataFrame, bridge: DataFrame
) -> DataFrame:
    """Blind ids back to cards, subjects and inventory rows; every hop must resolve."""
    cards = resolve_all(export, blind_map.select("blind_id", "card_id", "stratum"), "blind_id", "card_id", "blind_id")
    subjects = resolve_all(cards, manifest.select("card_id", "subject_id", "image_path"), "card_id", "subject_id", "card_id")
    return resolve_all(subjects, bridge.select("card_id", "row_id"), "card_id", "row_id", "row_id")


def unpaired(first: DataFrame, second: DataFrame, key: str = "row_id") -> DataFrame:
    """Keys found on one side only: `key, missing_from`."""
    a, b = first.select(key).distinct(), second.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("missing_from", F.lit("first")).unionByName(
        a.join(b, key, "left_anti").withColumn("missing_from", F.lit("second"))
    )


def ordered_lookup(ordered_keys: DataFrame, table: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of `table` for the given keys, in the order the keys were given."""
    return ordered_keys.join(table, key).orderBy(position)


# --- confusion and binary metrics -----------------------------------------------------------------

def long_predictors(
    df: DataFrame, predictors: Mapping[str, tuple[str, str | None]], reference: str, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per (item, predictor): `predictor, reference_call, predictor_call, parsed_ok`."""
    rows = [
        F.struct(
            F.lit(name).alias("predictor"), F.col(call).alias("predictor_call"),
            (F.col(ok) if ok else F.lit(True)).alias("parsed_ok"),
            F.lit(ok is not None).alias("can_fail"),
        )
        for name, (call, ok) in predictors.items()
    ]
    return df.select(*carry, F.col(reference).alias("reference_call"), F.inline(F.array(*rows)))


def confusion(long: DataFrame, calls: Sequence[str] = V.CALLS, failure: str = V.PARSE_FAILURE) -> DataFrame:
    """Zero-filled reference x predictor counts; only predictors that can fail get a failure column.

    Every cell is a conditional count of one aggregate per predictor: no vocabulary join.
    """
    seen = F.when(F.col("can_fail") & ~F.col("parsed_ok"), F.lit(failure)).otherwise(F.col("predictor_call"))
    cells = [(r, p) for r in calls for p in (*calls, failure)]
    counted = long.groupBy("predictor", "can_fail").agg(
        *[F.count_if((F.col("reference_call") == r) & (seen == p)).alias(f"_{i}") for i, (r, p) in enumerate(cells)]
    )
    rows = F.array(*[
        F.struct(F.lit(r).alias("reference_value"), F.lit(p).alias("predictor_value"), F.col(f"_{i}").alias("count"))
        for i, (r, p) in enumerate(cells)
    ])
    return (
        counted.select("predictor", "can_fail", F.inline(rows))
        .where(F.col("can_fail") | (F.col("predictor_value") != failure))
        .drop("can_fail")
    )


def metric_indicators(reference: Column, predicted: Column) -> dict[str, tuple[Column, Column]]:
    """0/1 numerator and denominator per metric; an uncallable side contributes to neither."""
    r_ok, p_ok = reference.isin(*V.CALLABLE), predicted.isin(*V.CALLABLE)
    both = F.coalesce(r_ok & p_ok, F.lit(False))
    flag = lambda c: F.when(both & c, 1.0).otherwise(0.0)
    pp, rp, rn = predicted == V.PRESENT, reference == V.PRESENT, reference == V.ABSENT
    return {
        "precision": (flag(pp & rp), flag(pp)),
        "recall": (flag(rp & pp), flag(rp)),
        "specificity": (flag(rn & ~pp), flag(rn)),
    }


def eligible(long: DataFrame) -> DataFrame:
    return long.where(
        F.col("reference_call").isin(*V.CALLABLE) & F.col("predictor_call").isin(*V.CALLABLE) & F.col("parsed_ok")
    )


def binary_metrics(
    long: DataFrame, cluster: str, by: Sequence[str] = ("predictor",), replicates: int = 5_000, seed: int = V.SEED,
    cluster_scope: str = "eligible",
) -> DataFrame:
    """Precision, recall and specificity with cluster intervals.

    `cluster_scope="eligible"` resamples the clusters of eligible rows only, `"all"` every cluster.
    """
    if cluster_scope not in ("eligible", "all"):
        raise ValueError("cluster_scope must be 'eligible' or 'all'")
    call = F.when(F.col("parsed_ok"), F.col("predictor_call")).otherwise(F.lit(V.PARSE_FAILURE))
    rows = eligible(long) if cluster_scope == "eligible" else long
    out = ratio_intervals(rows, cluster, metric_indicators(F.col("reference_call"), call), by, replicates, seed)
    return out.select(
        *by, "metric", F.col("point").alias("point_estimate"), "ci_low", "ci_high",
        F.col("denominator").cast("bigint").alias("n_used_for_metric"),
    )


def uncallable_rates(
    long: DataFrame, cluster: str, by: Sequence[str] = ("predictor",), replicates: int = 5_000, seed: int = V.SEED,
    call: str = "predictor_call",
) -> DataFrame:
    """Indeterminate and failed calls per predictor with the cluster interval of their rate."""
    failed = ~F.coalesce(F.col("parsed_ok"), F.lit(False))
    undecided = ~failed & F.coalesce(F.col(call) == V.INDETERMINATE, F.lit(False))
    counts = long.groupBy(*by).agg(
        F.count_if(undecided).alias("indeterminate_count"), F.count_if(failed).alias("parse_failure_count"),
        F.count(F.lit(1)).alias("total_n"),
    )
    rate = mean_interval(long, (failed | undecided).cast("double"), cluster, by, replicates, seed)
    return counts.join(rate, list(by)).select(
        *by, "indeterminate_count", "parse_failure_count", "total_n", F.col("point").alias("indeterminate_rate"), "ci_low", "ci_high"
    )


def two_reference_metrics(
    df: DataFrame, tests: Mapping[str, str], references: Mapping[str, str], cluster: str, replicates: int = 5_000,
    seed: int = V.SEED,
) -> DataFrame:
    """Every index test against every reference: one expanded pass, one set of draws per pair."""
    pairs = F.array(*[
        F.struct(
            F.lit(t).alias("index_test"), F.lit(r).alias("reference"), F.col(tc).alias("predictor_call"),
            F.col(rc).alias("reference_call"), F.lit(True).alias("parsed_ok"),
        )
        for t, tc in tests.items() for r, rc in references.items()
    ])
    long = df.select(cluster, F.inline(pairs))
    return binary_metrics(long, cluster, ("index_test", "reference"), replicates, seed)


def reference_delta(metrics: DataFrame, before: str = "pass1", after: str = "pass2") -> DataFrame:
    """One row per (test, metric) with both references side by side and their difference."""
    wide = metrics.groupBy("index_test", "metric").pivot("reference", [before, after]).agg(
        F.first("point_estimate").alias("point"), F.first("ci_low").alias("ci_low"), F.first("ci_high").alias("ci_high")
    )
    return wide.withColumn("delta", F.col(f"{after}_point") - F.col(f"{before}_point"))


# --- three-way cells, marginals, categories ------------------------------------------------------------

def three_way_cells(df: DataFrame, raters: Sequence[str], classes: Sequence[str] = V.CLASS_ORDER) -> DataFrame:
    """Observed cells of the rater cross table in class order."""
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in classes]), F.col(c))
    return df.groupBy(*raters).agg(F.count(F.lit(1)).alias("n")).orderBy(*[rank(c) for c in raters])


def marginals(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Counts of every call of every rater."""
    rows = F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("call")) for r in raters])
    return df.select(F.inline(rows)).groupBy("rater", "call").agg(F.count(F.lit(1)).alias("n"))


# --- agreement -----------------------------------------------------------------------------------------

def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """`n, percent_agreement, cohen_kappa, categories` per group.

    Rows shrink to pair counts, pair counts to category marginals; nothing is joined.
    """
    by = list(by)
    pairs = df.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("_a").alias("cat"), F.col("_n").alias("na"), zero.alias("nb"),
                 F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(zero).alias("same")),
        F.struct(F.col("_b").alias("cat"), zero.alias("na"), F.col("_n").alias("nb"), zero.alias("same")),
    )
    cats = pairs.select(*by, F.inline(sides)).groupBy(*by, "cat").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("same").alias("same"))
    total = cats.groupBy(*by).agg(
        F.sum("na").alias("n"), F.sum("same").alias("_same"),
        F.sum(F.col("na").cast("double") * F.col("nb")).alias("_cross"),
        F.array_sort(F.collect_list("cat")).alias("categories"),
    )
    n = F.col("n").cast("double")
    total = total.withColumn("percent_agreement", F.col("_same") / n).withColumn("_pe", F.col("_cross") / (n * n))
    # Same closeness rule as a relative 1e-5 plus absolute 1e-8 comparison with 1.
    certain = F.abs(F.col("_pe") - 1.0) <= 1e-8 + 1e-5
    kappa = F.when(certain, F.when(F.col("_same") == F.col("n"), 1.0)).otherwise(
        F.try_divide(F.col("percent_agreement") - F.col("_pe"), 1.0 - F.col("_pe"))
    )
    return total.withColumn("cohen_kappa", kappa).select(*by, "n", "percent_agreement", "cohen_kappa", "categories")


def reliability(
    df: DataFrame, a: str, b: str, cluster: str, replicates: int = 10_000, seed: int = V.SEED
) -> DataFrame:
    """Three-class and binary kappa with bands, agreement with its cluster interval: one row."""
    three = agreement(df, a, b).select("n", F.col("cohen_kappa").alias("kappa_3class"), "percent_agreement")
    binary = df.select(collapse_binary(F.col(a)).alias("_ba"), collapse_binary(F.col(b)).alias("_bb"))
    two = agreement(binary, "_ba", "_bb").select(F.col("cohen_kappa").alias("kappa_binary"))
    ci = mean_interval(df, (F.col(a) == F.col(b)).cast("double"), cluster, (), replicates, seed).select(
        F.col("ci_low").alias("agreement_ci_low"), F.col("ci_high").alias("agreement_ci_high")
    )
    return with_scalars(with_scalars(three, two), ci).withColumns({
        "band_3class": agreement_band(F.col("kappa_3class")), "band_binary": agreement_band(F.col("kappa_binary")),
    })


def paired_agreement(first: DataFrame, second: DataFrame, key: str = "row_id", call: str = "call") -> DataFrame:
    """Re-run agreement in one row: sizes, pairs, agreement, nine confusion cells, failure rates, unpaired keys."""
    tag = lambda df, side: df.select(
        key, F.col(call).alias("c"), F.lit(side).alias("s")
    )
    both = tag(first, 1).unionByName(tag(second, 2))
    per_key = both.groupBy(key).agg(
        F.count_if(F.col("s") == 1).alias("n1"), F.count_if(F.col("s") == 2).alias("n2"),
        F.count_if((F.col("s") == 1) & F.col("c").isNull()).alias("f1"),
        F.count_if((F.col("s") == 2) & F.col("c").isNull()).alias("f2"),
        F.max(F.when(F.col("s") == 1, F.col("c"))).alias("c1"), F.max(F.when(F.col("s") == 2, F.col("c"))).alias("c2"),
    )
    pair = (F.col("n1") > 0) & (F.col("n2") > 0)
    cells = [(x, y) for x in V.CALLS for y in V.CALLS]
    row = per_key.agg(
        F.coalesce(F.sum("n1"), F.lit(0)).alias("n_first"), F.coalesce(F.sum("n2"), F.lit(0)).alias("n_rerun"),
        F.count_if(pair).alias("n_paired"), F.count_if(pair & (F.col("c1") == F.col("c2"))).alias("n_agree"),
        F.coalesce(F.sum("f1"), F.lit(0)).alias("_f1"), F.coalesce(F.sum("f2"), F.lit(0)).alias("_f2"),
        F.count_if((F.col("n1") == 0)).alias("n_missing_from_first"),
        F.count_if((F.col("n2") == 0)).alias("n_missing_from_rerun"),
        *[F.count_if(pair & (F.col("c1") == x) & (F.col("c2") == y)).alias(f"confusion[{x}->{y}]") for x, y in cells],
    )
    pct = lambda n, d: F.coalesce(F.try_divide(100.0 * F.col(n), F.col(d)), F.lit(0.0))
    return row.select(
        "n_first", "n_rerun", "n_paired", "n_agree", pct("n_agree", "n_paired").alias("overall_agreement_pct"),
        pct("_f1", "n_first").alias("parse_failure_rate_first_pct"), pct("_f2", "n_rerun").alias("parse_failure_rate_rerun_pct"),
        "n_missing_from_first", "n_missing_from_rerun", *[F.col(f"`confusion[{x}->{y}]`") for x, y in cells],
    )


def tidy(row: DataFrame) -> DataFrame:
    """One wide row to `metric, value` rows."""
    wide = row.select([F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(row.columns)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"_{i}").alias("value")) for i, c in enumerate(row.columns)
    ])))


# --- concordance ----------------------------------------------------------------------------------------

def bridge_reference(bridge: DataFrame, canonical: DataFrame) -> DataFrame:
    """Bridge cards with their canonical call, NULL where the canonical run has none."""
    return bridge.select("card_id", "stratum", "row_id").join(
        canonical.select("row_id", F.col("call").alias("canonical_call"), F.col("parsed_ok").alias("canonical_ok")),
        "row_id", "left",
    )


def variant_pairs(variants: DataFrame, bridge: DataFrame, canonical: DataFrame) -> DataFrame:
    """Variant calls (`variant, card_id, call, parsed_ok`) against the canonical call of the same card."""
    calls = variants.select("variant", "card_id", F.col("call").alias("variant_call"), F.col("parsed_ok").alias("variant_ok"))
    return calls.join(bridge_reference(bridge, canonical), "card_id")


def concordance(pairs: DataFrame) -> DataFrame:
    """Counts and rates per variant. `var_positive_rate_pct` counts indeterminate calls as calls."""
    v, c = F.col("variant_call"), F.col("canonical_call")
    both = v.isNotNull() & c.isNotNull()
    flips = both & (v == V.PRESENT) & (c == V.ABSENT), both & (v == V.ABSENT) & (c == V.PRESENT)
    n = lambda cond, name: F.count_if(cond).alias(name)
    out = pairs.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_total"), n(both, "n_compare"), n(both & (v == c), "n_matched"),
        n(v == V.PRESENT, "var_present"), n(v == V.ABSENT, "var_absent"), n(v == V.INDETERMINATE, "var_indeterminate"),
        n(~F.col("variant_ok"), "var_parse_failure"), n(~F.col("canonical_ok"), "canon_parse_fail_in_sub"),
        n(flips[0], "var_pos_canon_neg"), n(flips[1], "var_neg_canon_pos"),
    )
    called = F.col("var_present") + F.col("var_absent") + F.col("var_indeterminate")
    return out.withColumns({
        "concordance_pct": safe_percent(F.col("n_matched"), F.col("n_compare")),
        "var_positive_rate_pct": safe_percent(F.col("var_present"), called),
        "other_mismatch": F.col("n_compare") - F.col("n_matched") - F.col("var_pos_canon_neg") - F.col("var_neg_canon_pos"),
    })


def concordance_by_stratum(pairs: DataFrame) -> DataFrame:
    v, c = F.col("variant_call"), F.col("canonical_call")
    return (
        pairs.where(v.isNotNull() & c.isNotNull()).groupBy("variant", "stratum")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(v == c).alias("matched"))
        .withColumn("conc_pct", safe_percent(F.col("matched"), F.col("n"), 1))
    )


def canonical_over_bridge(bridge: DataFrame, canonical: DataFrame) -> DataFrame:
    """Canonical calls over every bridged card, whether or not a variant drew it."""
    c = F.col("canonical_call")
    out = bridge_reference(bridge, canonical).where(c.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c == V.PRESENT).alias("present"),
        F.count_if(c == V.ABSENT).alias("absent"), F.count_if(c == V.INDETERMINATE).alias("indeterminate"),
    )
    return out.withColumn("positive_rate_pct", safe_percent(F.col("present"), F.col("n")))


# --- re-read change log -------------------------------------------------------------------------------------

def change_log(second: DataFrame, first: DataFrame, manifest: DataFrame, model: DataFrame) -> DataFrame:
    """Second-pass readings with the first-pass call, both machine calls and the direction of change.

    All four tables meet in one aggregate by card: each tells what it knows, and every second reading of the card gets it.
    Of a card told several times the greatest value counts; cards without a second reading are left out.
    """
    reading = F.struct("stratum", F.col("call").alias("pass2_call"), F.col("confidence").alias("pass2_confidence"))
    told = [
        first.select("card_id", "pass1_call"),
        manifest.select("card_id", call_label(truthy(F.col("is_occlusion_signature"))).alias("detector_call")),
        model.select("card_id", F.lower("call").alias("language_model_call")),
    ]
    known = second.select("card_id", reading.alias("reading"))
    for side in told:
        known = known.unionByName(side.where(F.col("card_id").isNotNull()), allowMissingColumns=True)
    calls = ["detector_call", "language_model_call", "pass1_call"]
    per_card = known.groupBy("card_id").agg(F.collect_list("reading").alias("_readings"), *[F.max(c).alias(c) for c in calls])
    each = per_card.select("card_id", F.explode("_readings").alias("_r"), *calls)
    before, after = F.col("pass1_call"), F.col("_r.pass2_call")
    return each.select(
        "card_id", "_r.stratum", *calls, "_r.pass2_call", "_r.pass2_confidence",
        (~before.eqNullSafe(after)).alias("changed"), change_direction(before, after).alias("direction"),
    )


def net_change(log: DataFrame) -> DataFrame:
    d = F.col("direction")
    out = log.agg(
        F.count_if(d == "to_present").alias("to_present"), F.count_if(d == "from_present").alias("from_present"),
        F.count_if(~d.isin("to_present", "from_present", "unchanged")).alias("other_changed"),
        F.count_if(d == "unchanged").alias("unchanged"),
    )
    return out.withColumn("net_present_delta", F.col("to_present") - F.col("from_present"))


def change_by_stratum(log: DataFrame) -> DataFrame:
    return log.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_sampled"), F.count_if("changed").alias("n_changed"))


def load_model_calls(log: DataFrame, key: str = "card_id") -> DataFrame:
    """Card-keyed model calls: lower-cased call, tolerant parse flag."""
    if key not in log.columns:
        raise ValueError(f"model log has no {key!r} column; bridge its row ids to cards first")
    return log.select(key, F.lower(F.col("call").cast("string")).alias("model_call"), tolerant_flag(F.col("parsed_ok")).alias("model_parsed_ok"))
