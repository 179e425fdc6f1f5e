"""Count identities, staging checks, drift checks, digests and manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.operators.funnel import headline, yield_subjects, yields
from troughline.session import with_scalars


def checks(row: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """`check, ok` rows of named conditions over a one-row table."""
    flags = row.select(*[F.coalesce(c, F.lit(False)).alias(f"_{i}") for i, c in enumerate(rules.values())])
    return flags.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(f"_{i}").alias("ok")) for i, name in enumerate(rules)
    ])))


def enforce(check_rows: DataFrame, what: str = "checks") -> DataFrame:
    """Fail, naming every failed check at once; otherwise return the rows. A check list is short."""
    failed = [r["check"] for r in check_rows.where(~F.col("ok")).select("check").collect()]
    if failed:
        raise ValueError(f"{what} failed: " + "; ".join(failed))
    return check_rows


def flow_identities(flow: DataFrame) -> DataFrame:
    """The eight identities the study-flow counts must satisfy."""
    c = F.col
    # Identity names.
    return checks(flow, {
        "evaluable = candidates - no_pleth - pleth_mostly_nan":
            c("n_evaluable") == c("n_candidates") - c("n_no_pleth") - c("n_pleth_nan"),
        "evaluable = positive + near_miss_pool + negative_pool + uncovered":
            c("n_evaluable") == c("n_detector_positive") + c("n_near_miss_pool") + c("n_negative_pool") + c("n_uncovered"),
        "uncovered = no_aligned_occlusion + pre_pi_implausible":
            c("n_uncovered") == c("n_uncovered_no_align") + c("n_uncovered_implausible"),
        "coverage = positive + near_miss_pool + negative_pool":
            c("coverage") == c("n_detector_positive") + c("n_near_miss_pool") + c("n_negative_pool"),
        "coverage + uncovered = evaluable": c("coverage") + c("n_uncovered") == c("n_evaluable"),
        "gallery = sampled positive + near_miss + negative":
            c("n_gallery") == c("n_sampled_positive") + c("n_sampled_near_miss") + c("n_sampled_negative"),
        "gallery = reader present + absent + indeterminate":
            c("n_gallery") == c("n_reader_present") + c("n_reader_absent") + c("n_reader_indeterminate"),
        "detector-positive census (sampled positive == positive pool)":
            c("n_sampled_positive") == c("n_detector_positive"),
    })


def staging_checks(
    staged: DataFrame, expected: DataFrame, key: str = "card_id", position: str = "display_pos",
    digest: str = "sha256", source_digest: str = "sha256",
) -> DataFrame:
    """Counts, unique keys, contiguous 1..N positions and equal digests of a staged set.

    Uniqueness and contiguity come from per-key counts and position bounds, not from a sort.
    """
    by_key = staged.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.min(digest).alias("_d"))
    keys = by_key.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_staged"), F.count_if(F.col("k") > 1).alias("dup_keys"))
    spots = staged.groupBy(position).agg(F.count(F.lit(1)).alias("k")).agg(
        F.count_if(F.col("k") > 1).alias("dup_pos"), F.min(position).alias("lo"), F.max(position).alias("hi"),
    )
    source = expected.select(key, F.col(source_digest).alias("_want"))
    match = source.join(by_key.select(key, "_d"), key, "left").agg(
        F.count(F.lit(1)).alias("n_expected"), F.count_if(~F.col("_d").eqNullSafe(F.col("_want"))).alias("n_differ")
    )
    row = with_scalars(with_scalars(keys, spots), match)
    c = F.col
    return checks(row, {
        "staged count = plan count": c("n_staged") == c("n_expected"),
        "keys unique": c("dup_keys") == 0,
        "positions unique": c("dup_pos") == 0,
        "positions contiguous 1..N": (c("lo") == 1) & (c("hi") == c("n_staged")),
        "content equal to source": c("n_differ") == 0,
    })


def drift(observed: DataFrame, expected: DataFrame, key: str | Sequence[str], value: str, tol: float) -> DataFrame:
    """Expected values against observed ones: `ok` when both exist and differ by at most `tol`."""
    keys = [key] if isinstance(key, str) else list(key)
    both = expected.select(*keys, F.col(value).alias("expected")).join(
        observed.select(*keys, F.col(value).alias("observed")), keys, "left"
    )
    return both.withColumn("ok", F.coalesce(F.abs(F.col("observed") - F.col("expected")) <= tol, F.lit(False)))


def cardinality(df: DataFrame, expected: DataFrame, no_null: Sequence[str]) -> DataFrame:
    """`check, ok` rows: the table has the expected row count and no NULL in the listed columns."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"_n_{c}") for c in no_null])
    row = with_scalars(row, expected.toDF("_expected"))
    return checks(row, {
        "row count as expected": F.col("n") == F.col("_expected"),
        **{f"no null in {c}": F.col(f"_n_{c}") == 0 for c in no_null},
    })


def content_digests(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """SHA-256 and length of every file of a (path, content) table."""
    return files.select(path, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.length(F.col(content).cast("binary")).cast("bigint").alias("bytes"))


def stamped_content(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Check a first line `# sha256: <hex>` against the digest of everything after it.

    `status` is ok, missing, malformed or mismatch.
    """
    text = F.col(content).cast("string")
    cut = F.instr(text, "\n")
    first = F.btrim(F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text), F.lit(" \t\r\n"))
    body = F.when(cut > 0, F.substring(text, cut + 1, F.length(text))).otherwise(F.lit(""))
    prefix = "# sha256:"
    has = first.startswith(prefix)
    stamp = F.lower(F.btrim(F.substring(first, F.lit(len(prefix) + 1), F.length(first)), F.lit(" \t\r\n")))
    actual = F.sha2(body.cast("binary"), 256)
    status = (
        F.when(~has, "missing").when(~stamp.rlike("^[0-9a-f]{64}$"), "malformed")
        .when(stamp != actual, "mismatch").otherwise("ok")
    )
    return files.select(
        path, status.alias("status"), F.when(has, stamp).alias("stamped"), F.when(has, actual).alias("sha256"),
        F.when(has, F.length(body.cast("binary"))).cast("bigint").alias("body_bytes"),
    )


def latest_payload(
    files: DataFrame, fields: str, path: str = "path", content: str = "content", by: Sequence[str] = ()
) -> DataFrame:
    """Newest file by name per group, its JSON parsed permissively; an unreadable one reads as NULLs."""
    latest = files.groupBy(*by).agg(F.max(path).alias(path), F.max_by(F.col(content).cast("string"), F.col(path)).alias("_text"))
    return latest.withColumn("_p", F.from_json("_text", fields, {"mode": "PERMISSIVE"})).select(*by, path, "_p.*")


def manifest(
    inv: DataFrame, files: DataFrame, source: str | None = None, generated: Column | None = None,
    primary_s: float = V.PRIMARY_MIN_S, sensitivity_s: float = V.SENSITIVITY_MIN_S,
) -> DataFrame:
    """Reproducibility manifest as JSON lines: one header, one line per subject behind a yield, one per file.

    Headline counts, thresholds and yields sit in the header. Subjects and files have no size
    bound, so they are rows of their own instead of arrays in one value.
    """
    stamp = generated if generated is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    y = yields(inv, primary_s, sensitivity_s)
    tier = lambda name: F.max(F.when(F.col("tier") == name, F.struct(
        F.col("n_events").alias("events"), F.col("n_patients").alias("patients"), "pct_of_candidates"
    ))).alias(name)
    tiers = y.agg(tier("primary"), tier("sensitivity"))
    head = headline(inv, primary_s, sensitivity_s)
    counts = F.struct(*[F.col(c) for c in head.columns])
    header = with_scalars(head, tiers).select(
        F.lit("header").alias("kind"), F.lit("manifest").alias("name"),
        F.to_json(F.struct(
            F.lit("feasibility-manifest/1").alias("manifest_schema"), stamp.alias("generated_utc"),
            F.lit(source).alias("inventory_source"),
            F.struct(F.lit(float(primary_s)).alias("primary_phase3_s"), F.lit(float(sensitivity_s)).alias("sensitivity_phase3_s")).alias("thresholds"),
            counts.alias("headline_counts"), F.struct("primary", "sensitivity").alias("yield"),
        )).alias("json"),
    )
    subjects = yield_subjects(inv, primary_s, sensitivity_s).select(
        F.lit("subject").alias("kind"), F.concat_ws("/", "tier", "subject_id").alias("name"),
        F.to_json(F.struct("tier", "subject_id")).alias("json"),
    )
    listed = files.select(
        F.lit("file").alias("kind"), F.col("path").cast("string").alias("name"), F.to_json(F.struct("path", "sha256", "bytes")).alias("json")
    )
    return header.unionByName(subjects).unionByName(listed)


def run_window(log: DataFrame, stamp: str = "run_utc", by: Sequence[str] = ()) -> DataFrame:
    """First and last ISO timestamp of a run log, NULL unless every row carries one."""
    full = F.count(F.nullif(F.col(stamp), F.lit(""))) == F.count(F.lit(1))
    return log.groupBy(*by).agg(
        F.when(full, F.min(stamp)).alias("run_utc_start"), F.when(full, F.max(stamp)).alias("run_utc_end"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def robustness_rows(rerun_metrics: DataFrame, reworded: DataFrame, reference: DataFrame, rendered: DataFrame) -> DataFrame:
    """`analysis, result`: three text rows on re-run agreement, changed wording and changed rendering.

    `rerun_metrics` is tidy (`metric, value`), `reworded` and `rendered` are concordance tables, `reference` holds
    the canonical positive rate (`positive_rate_pct, n`) that the positive rates of the wordings stand beside.
    """
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    rerun = rerun_metrics.agg(
        pick("overall_agreement_pct").alias("a"), pick("n_agree").alias("k"), pick("n_paired").alias("n")
    ).select(
        F.lit("determinism").alias("analysis"),
        F.format_string("%.0f%% paired agreement (%d/%d)", "a", F.col("k").cast("bigint"), F.col("n").cast("bigint")).alias("result"),
    )
    # A run compares a handful of named variants; the text lists each of them.
    listed = lambda form, rate: F.concat_ws(", ", F.transform(
        F.array_sort(F.collect_list(F.struct("variant", rate))), lambda x: F.format_string(form, x["variant"], x[rate])
    ))
    by_wording = reworded.agg(listed("%s %.1f%%", "concordance_pct").alias("w"), listed("%s %.0f%%", "var_positive_rate_pct").alias("p"))
    by_wording = with_scalars(by_wording, reference.select("positive_rate_pct", F.col("n").alias("_n"))).select(
        F.lit("prompt sensitivity").alias("analysis"),
        F.format_string("Concordance: %s. Positive rate: %s (reference %.0f%% positive over %d).", "w", "p", "positive_rate_pct", "_n").alias("result"),
    )
    by_render = rendered.agg(listed("%s %.1f%%", "concordance_pct").alias("w")).select(
        F.lit("render sensitivity").alias("analysis"), F.format_string("Concordance: %s.", "w").alias("result")
    )
    return rerun.unionByName(by_wording).unionByName(by_render)


def never_empty(rows: DataFrame, what: str) -> DataFrame:
    """The rows; where there are none the query fails when it runs. The check is a count beside the rows, without a job while the query is built."""
    nothing = rows.agg(F.count(F.lit(1)).alias("n")).where(F.when(F.col("n") == 0, F.raise_error(F.lit(f"no {what}")).cast("boolean")).otherwise(False))
    empty = nothing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    return rows.unionByName(empty)
