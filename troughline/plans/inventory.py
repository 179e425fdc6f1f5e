"""Queries over the event inventory (lineitem joined to orders)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.functions.keys import content_id, sorted_row_id, time_key
from troughline.functions.labels import blank_to_null, evaluable, measured
from troughline.operators import calibrate, choose, curves, funnel, quality, sampling
from troughline.operators.linkage import artifact_lookup, artifact_triples, bridge, bridge_summary, lookup_report, resolve_artifacts, with_artifact
from troughline.plans.registry import draw_sql, query
from troughline.plans.views import INV, inventory
from troughline.schema import require_columns
from troughline.session import cut_lineage
from troughline.sources.files import missing_as_null

SEED = V.SEED
WITH = f"WITH {INV}"
EPISODE = "coalesce(reject_reason, 'primary') AS reason"


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


# --- cleaning and keys --------------------------------------------------------------------------------

@query("b01_blank_to_null", f"""{WITH} SELECT subject_id, count(*) AS n, count(nullif(coalesce(reject_reason, ''), '')) AS n_reason
FROM inv GROUP BY 1""")
def b01(spark: SparkSession, d: str) -> DataFrame:
    inv = inventory(spark, d).withColumn("reject_reason", F.coalesce("reject_reason", F.lit("")))
    inv = inv.withColumn("reject_reason", blank_to_null(F.col("reject_reason")))
    return inv.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.count("reject_reason").alias("n_reason"))


@query("b07_row_id", f"""{WITH} SELECT subject_id || '_' || record_id || '_' || (row_number() OVER (ORDER BY subject_id, record_id, nbp_timestamp_s) - 1) AS row_id,
nbp_timestamp_s FROM inv""")
def b07(spark: SparkSession, d: str) -> DataFrame:
    inv = inventory(spark, d).select("subject_id", "record_id", "nbp_timestamp_s")
    return sorted_row_id(inv).select("row_id", "nbp_timestamp_s")


STRATUM_SQL = """CASE WHEN is_occlusion_signature THEN 'detector_positive'
 WHEN phase3_duration_s >= 10e0 AND nadir_depth_frac < 0.20e0 AND reject_reason IN ('stat_mode_short_phase3', 'no_recovery_in_window') THEN 'detector_rejected_near_miss'
 WHEN reject_reason IN ('no_phase2', 'pre_window_unstable') AND pleth_valid_fraction >= 0.5e0 THEN 'detector_negative_random' END"""
POOL = f"pool AS (SELECT *, {STRATUM_SQL} AS stratum, CAST(round(nbp_timestamp_s * 1000) AS BIGINT) AS ms FROM inv)"
CARD_ID_SQL = f"""(CASE stratum WHEN 'detector_positive' THEN 'A' WHEN 'detector_rejected_near_miss' THEN 'B' ELSE 'C' END) || '-' ||
substr(sha256(subject_id || '|' || printf('%.6f', nbp_timestamp_s) || '|' || stratum || '|{SEED}'), 1, 16)"""


@query("b08_content_id", f"{WITH}, {POOL} SELECT {CARD_ID_SQL} AS card_id, record_id, stratum FROM pool WHERE stratum IS NOT NULL")
def b08(spark: SparkSession, d: str) -> DataFrame:
    pool = inventory(spark, d).withColumn("stratum", sampling.stratum_of()).where(F.col("stratum").isNotNull())
    return pool.select(
        content_id(F.col("subject_id"), F.col("nbp_timestamp_s"), F.col("stratum")).alias("card_id"), "record_id", "stratum"
    )


@query("b09_time_key", f"{WITH} SELECT subject_id, CAST(round(nbp_timestamp_s * 1000) AS BIGINT) AS t_key, count(*) AS n FROM inv GROUP BY 1, 2")
def b09(spark: SparkSession, d: str) -> DataFrame:
    inv = inventory(spark, d)
    return inv.groupBy("subject_id", time_key(F.col("nbp_timestamp_s")).alias("t_key")).agg(F.count(F.lit(1)).alias("n"))


@query("b10_evaluable", f"""{WITH} SELECT record_id, count(*) FILTER (reject_reason IS DISTINCT FROM 'no_pleth') AS n_evaluable, count(*) AS n
FROM inv GROUP BY 1""")
def b10(spark: SparkSession, d: str) -> DataFrame:
    return inventory(spark, d).groupBy("record_id").agg(
        F.count_if(evaluable(F.col("reject_reason"))).alias("n_evaluable"), F.count(F.lit(1)).alias("n")
    )


PRIMARY_SQL = "(reject_reason IS NULL OR reject_reason = 'stat_mode_short_phase3') AND coalesce(phase3_duration_s >= 15e0, false)"
SENS_SQL = "(reject_reason IS NULL OR reject_reason IN ('stat_mode_short_phase3', 'no_recovery_in_window')) AND coalesce(phase3_duration_s >= 10e0, false)"


@query("b11_reason_membership", f"{WITH} SELECT record_id, nbp_timestamp_s, {PRIMARY_SQL} AS is_primary, {SENS_SQL} AS is_sensitivity FROM inv")
def b11(spark: SparkSession, d: str) -> DataFrame:
    return inventory(spark, d).select(
        "record_id", "nbp_timestamp_s",
        funnel.signature_at(V.PRIMARY_MIN_S, V.PRIMARY_REASONS).alias("is_primary"),
        funnel.signature_at(V.SENSITIVITY_MIN_S, V.SENSITIVITY_REASONS).alias("is_sensitivity"),
    )


@query("b17_required_columns", f"{WITH} SELECT count(*) AS n, count(DISTINCT record_id) AS n_records FROM inv")
def b17(spark: SparkSession, d: str) -> DataFrame:
    inv = require_columns(inventory(spark, d), "subject_id", "record_id", "phase3_duration_s", "pre_window_valid", "reject_reason")
    per_record = inv.groupBy("record_id").agg(F.count(F.lit(1)).alias("k"))
    return per_record.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_records"))


@query("b24_measured_subset", f"""{WITH} SELECT subject_id, count(*) AS n_measured, count(*) FILTER (is_occlusion_signature) AS n_signature
FROM inv WHERE nadir_depth_frac IS NOT NULL GROUP BY 1""")
def b24(spark: SparkSession, d: str) -> DataFrame:
    background = missing_as_null(inventory(spark, d)).where(measured(F.col("nadir_depth_frac")))
    return background.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n_measured"), F.count_if("is_occlusion_signature").alias("n_signature")
    )


# --- funnel, yields, summaries ---------------------------------------------------------------------------

def _note(stage: str) -> str:
    return V.FUNNEL_NOTES[stage]


def _count(reason: str) -> str:
    return f"(SELECT count(*) FROM inv WHERE reject_reason = '{reason}')"


FUNNEL_SQL = f"""funnel AS (
SELECT 'candidate_cuff_cycles' AS stage, (SELECT count(*) FROM inv) AS events, (SELECT count(DISTINCT subject_id) FROM inv) AS patients, '{_note("candidate_cuff_cycles")}' AS note
UNION ALL SELECT 'excluded_no_pleth', {_count("no_pleth")}, 0, '{_note("excluded_no_pleth")}'
UNION ALL SELECT 'excluded_pleth_mostly_nan', {_count("pleth_mostly_nan")}, 0, '{_note("excluded_pleth_mostly_nan")}'
UNION ALL SELECT 'evaluable_with_pleth', (SELECT count(*) FROM inv WHERE reject_reason IS NULL OR reject_reason NOT IN ('no_pleth', 'pleth_mostly_nan')), 0, '{_note("evaluable_with_pleth")}'
UNION ALL SELECT 'qc_pass_pre_window', (SELECT count(*) FROM inv WHERE pre_window_valid), (SELECT count(DISTINCT subject_id) FROM inv WHERE pre_window_valid), '{_note("qc_pass_pre_window")}'
UNION ALL SELECT 'rejected_no_phase2', {_count("no_phase2")}, 0, '{_note("rejected_no_phase2")}'
UNION ALL SELECT 'rejected_misaligned', {_count("no_aligned_occlusion")} + {_count("phase2_misaligned")}, 0, '{_note("rejected_misaligned")}'
UNION ALL SELECT 'stat_mode_short_envelope', {_count("stat_mode_short_phase3")}, 0, '{_note("stat_mode_short_envelope")}'
UNION ALL SELECT 'rejected_no_recovery', {_count("no_recovery_in_window")}, 0, '{_note("rejected_no_recovery")}'
UNION ALL SELECT 'occlusion_signature_primary_15s', (SELECT count(*) FROM inv WHERE {PRIMARY_SQL}), (SELECT count(DISTINCT subject_id) FROM inv WHERE {PRIMARY_SQL}), 'reperfusion envelope >= 15 s (primary)'
UNION ALL SELECT 'occlusion_signature_sensitivity_10s', (SELECT count(*) FROM inv WHERE {SENS_SQL}), (SELECT count(DISTINCT subject_id) FROM inv WHERE {SENS_SQL}), 'reperfusion envelope >= 10 s (sensitivity)')"""


@query("d01_funnel", f"{WITH}, {FUNNEL_SQL} SELECT * FROM funnel")
def d01(spark: SparkSession, d: str) -> DataFrame:
    return funnel.funnel(inventory(spark, d))


@query("d02_yield_strata", f"""{WITH} SELECT 'primary' AS tier, 15e0 AS phase3_min_s, count(*) FILTER ({PRIMARY_SQL}) AS n_events,
 count(DISTINCT subject_id) FILTER ({PRIMARY_SQL}) AS n_patients, round(100e0 * count(*) FILTER ({PRIMARY_SQL}) / count(*), 6) AS pct_of_candidates FROM inv
UNION ALL SELECT 'sensitivity', 10e0, count(*) FILTER ({SENS_SQL}), count(DISTINCT subject_id) FILTER ({SENS_SQL}),
 round(100e0 * count(*) FILTER ({SENS_SQL}) / count(*), 6) FROM inv""")
def d02(spark: SparkSession, d: str) -> DataFrame:
    return funnel.yields(inventory(spark, d)).withColumn("pct_of_candidates", F.round("pct_of_candidates", 6))


@query("d02_yield_subjects", f"""{WITH} SELECT DISTINCT 'primary' AS tier, subject_id FROM inv WHERE {PRIMARY_SQL}
UNION ALL SELECT DISTINCT 'sensitivity', subject_id FROM inv WHERE {SENS_SQL}""")
def d02_subjects(spark: SparkSession, d: str) -> DataFrame:
    return funnel.yield_subjects(inventory(spark, d))


@query("d03_per_subject", f"""{WITH} SELECT subject_id, count(*) AS n_total,
 count(*) FILTER (reject_reason IS NULL OR reject_reason NOT IN ('no_pleth', 'pleth_mostly_nan')) AS n_evaluable,
 count(*) FILTER (reject_reason = 'no_pleth') AS n_no_pleth, count(*) FILTER (pre_window_valid) AS n_qc_pass,
 count(*) FILTER (reject_reason = 'stat_mode_short_phase3') AS n_stat_mode,
 count(*) FILTER ({PRIMARY_SQL}) AS n_occlusion_signature_primary, count(*) FILTER ({SENS_SQL}) AS n_occlusion_signature_sensitivity,
 bool_or({PRIMARY_SQL}) AS has_occlusion_signature_primary, bool_or({SENS_SQL}) AS has_occlusion_signature_sensitivity
FROM inv GROUP BY 1""")
def d03(spark: SparkSession, d: str) -> DataFrame:
    return funnel.per_subject(inventory(spark, d))


@query("d04_reason_counts", f"{WITH} SELECT {EPISODE}, count(*) AS n FROM inv GROUP BY 1")
def d04(spark: SparkSession, d: str) -> DataFrame:
    return funnel.reason_counts(inventory(spark, d))


@query("d30_tier_counts", f"""{WITH}, m AS (SELECT * FROM inv WHERE nadir_depth_frac IS NOT NULL), c AS (SELECT count(*) AS n_measured,
 count(*) FILTER (is_occlusion_signature) AS n_signature, count(*) FILTER (nadir_depth_frac < 0.2e0) AS n_below_gate,
 count(*) FILTER (phase3_duration_s >= 10e0) AS n_sensitivity_tier, count(*) FILTER (phase3_duration_s >= 15e0) AS n_primary_tier FROM m)
SELECT *, n_below_gate = n_measured AS gate_ok, n_sensitivity_tier = n_measured AS sensitivity_ok, n_primary_tier >= n_signature AS primary_ok FROM c""")
def d30(spark: SparkSession, d: str) -> DataFrame:
    return funnel.tier_counts(inventory(spark, d))


@query("d33_headline", f"""{WITH} SELECT count(*) AS n_candidates, count(DISTINCT record_id) AS n_records,
 count(*) FILTER (reject_reason = 'no_pleth') AS excluded_no_pleth, count(*) FILTER (pre_window_valid) AS qc_pass_pre_window_events,
 count(DISTINCT subject_id) FILTER (pre_window_valid) AS qc_pass_pre_window_patients,
 count(*) FILTER ({PRIMARY_SQL}) AS primary_events, count(DISTINCT subject_id) FILTER ({PRIMARY_SQL}) AS primary_patients,
 count(*) FILTER ({SENS_SQL}) AS sensitivity_events, count(DISTINCT subject_id) FILTER ({SENS_SQL}) AS sensitivity_patients FROM inv""")
def d33(spark: SparkSession, d: str) -> DataFrame:
    return funnel.headline(inventory(spark, d))


# --- gallery: strata, samples, manifest, flow --------------------------------------------------------------

TARGETS = {V.STRATUM_POSITIVE: None, V.STRATUM_NEAR_MISS: 200, V.STRATUM_NEGATIVE: 100}
RANK_SQL = f"row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', subject_id, record_id, CAST(ms AS VARCHAR), '{SEED}')), subject_id, record_id, ms)"
MANIFEST_SQL = f"""ranked AS (SELECT *, {RANK_SQL} AS rk FROM pool WHERE stratum IS NOT NULL),
manifest AS (SELECT {CARD_ID_SQL} AS card_id, stratum, subject_id, record_id, nbp_timestamp_s AS t_nbp, is_occlusion_signature,
 phase3_duration_s, nadir_depth_frac, alignment_offset_s, reject_reason FROM ranked
 WHERE stratum = 'detector_positive' OR (stratum = 'detector_rejected_near_miss' AND rk <= 200) OR (stratum = 'detector_negative_random' AND rk <= 100))"""
READER_RULE = """CASE WHEN phase3_duration_s >= 30e0 THEN 'occlusion_signature_present'
 WHEN stratum = 'detector_rejected_near_miss' THEN 'indeterminate' ELSE 'no_occlusion_signature' END"""


def manifest_of(spark: SparkSession, d: str) -> DataFrame:
    return sampling.gallery(inventory(spark, d), TARGETS)


@query("g01_strata", f"{WITH}, {POOL} SELECT record_id, ms AS t_key, stratum FROM pool WHERE stratum IS NOT NULL")
def g01(spark: SparkSession, d: str) -> DataFrame:
    inv = inventory(spark, d).withColumn("stratum", sampling.stratum_of()).where(F.col("stratum").isNotNull())
    return inv.select("record_id", time_key(F.col("nbp_timestamp_s")).alias("t_key"), "stratum")


def _pool(spark: SparkSession, d: str) -> DataFrame:
    inv = inventory(spark, d).withColumn("stratum", sampling.stratum_of()).where(F.col("stratum").isNotNull())
    return inv.withColumn("ms", time_key(F.col("nbp_timestamp_s")))


@query("g02_sample_per_stratum", f"""{WITH}, {POOL}, ranked AS (SELECT *, {RANK_SQL} AS rk FROM pool WHERE stratum IS NOT NULL)
SELECT stratum, record_id, ms FROM ranked WHERE rk <= CASE stratum WHEN 'detector_positive' THEN 268 WHEN 'detector_rejected_near_miss' THEN 200 ELSE 100 END""")
def g02(spark: SparkSession, d: str) -> DataFrame:
    drawn = sampling.sample_strata(_pool(spark, d), V.STRATUM_TARGETS, ["subject_id", "record_id", "ms"])
    return drawn.select("stratum", "record_id", "ms")


@query("g11_gallery", f"""{WITH}, {POOL}, {MANIFEST_SQL} SELECT *, stratum || '/' || card_id || '.png' AS image_path, CAST(NULL AS VARCHAR) AS image_sha256 FROM manifest""")
def g11(spark: SparkSession, d: str) -> DataFrame:
    return manifest_of(spark, d)


@query("b20_blinded_form", f"""{WITH}, {POOL}, {MANIFEST_SQL} SELECT card_id, stratum || '/' || card_id || '.png' AS image_path, '' AS call, '' AS notes FROM manifest""")
def b20(spark: SparkSession, d: str) -> DataFrame:
    return sampling.blinded_form(sampling.gallery(inventory(spark, d), TARGETS, root="gallery"), "gallery")


@query("b21_manifest_rows", f"""{WITH}, {POOL} SELECT {CARD_ID_SQL} AS card_id, stratum, subject_id, record_id, nbp_timestamp_s AS t_nbp,
 stratum || '/' || {CARD_ID_SQL} || '.png' AS image_path, sha256(subject_id || stratum) AS image_sha256, is_occlusion_signature,
 phase3_duration_s, nadir_depth_frac, alignment_offset_s, reject_reason FROM pool WHERE stratum IS NOT NULL""")
def b21(spark: SparkSession, d: str) -> DataFrame:
    pool = _pool(spark, d)
    digests = sampling.manifest_rows(pool).select("image_path", F.sha2(F.concat("subject_id", "stratum"), 256).alias("image_sha256"))
    return sampling.manifest_rows(pool, digests=digests)


@query("a15_sampling_log", f"""{WITH}, {POOL}, c AS (SELECT stratum, count(*) AS available, CASE stratum WHEN 'detector_positive' THEN 268 WHEN 'detector_rejected_near_miss' THEN 200 ELSE 100 END AS target
 FROM pool WHERE stratum IS NOT NULL GROUP BY 1) SELECT run, stratum, target, available, least(target, available) AS sampled, greatest(target - available, 0) AS shortfall
FROM c, (VALUES ('first'), ('second')) r(run)""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    from troughline.session import scratch_path
    from troughline.sources.files import append_log

    log = scratch_path(spark, "sampling-log")
    for run in ("first", "second"):
        append_log(sampling.sampling_report(_pool(spark, d), V.STRATUM_TARGETS).withColumn("run", F.lit(run)), log)
    return spark.read.parquet(log)


@query("c04_bridge_unmatched", f"""{WITH}, {POOL}, {MANIFEST_SQL}, ids AS (SELECT subject_id, record_id, CAST(round(nbp_timestamp_s * 1000) AS BIGINT) AS t,
 subject_id || '_' || record_id || '_' || (row_number() OVER (ORDER BY subject_id, record_id, nbp_timestamp_s) - 1) AS row_id FROM inv WHERE pre_window_valid)
SELECT count(*) AS n_cards, count(row_id) AS n_matched, count(*) FILTER (row_id IS NULL) AS n_unmatched
FROM manifest m LEFT JOIN ids i ON m.subject_id = i.subject_id AND m.record_id = i.record_id AND CAST(round((m.t_nbp + 1e-4) * 1000) AS BIGINT) = i.t""")
def c04(spark: SparkSession, d: str) -> DataFrame:
    inv = inventory(spark, d).where("pre_window_valid").select("subject_id", "record_id", "nbp_timestamp_s")
    nudged = manifest_of(spark, d).withColumn("t_nbp", F.col("t_nbp") + 1e-4)
    return bridge_summary(bridge(nudged, sorted_row_id(inv)))


@query("c14_signature_cards", f"""{WITH}, {POOL}, {MANIFEST_SQL} SELECT m.card_id, i.record_id, i.nadir_depth_frac FROM inv i JOIN manifest m
ON i.subject_id = m.subject_id AND i.record_id = m.record_id AND CAST(round(i.nbp_timestamp_s * 1000) AS BIGINT) = CAST(round(m.t_nbp * 1000) AS BIGINT)
WHERE i.is_occlusion_signature AND m.stratum = 'detector_positive'""")
def c14(spark: SparkSession, d: str) -> DataFrame:
    cards = manifest_of(spark, d).where(F.col("stratum") == V.STRATUM_POSITIVE).select("card_id", "subject_id", "record_id", "t_nbp")
    events = inventory(spark, d).where("is_occlusion_signature").withColumnRenamed("nadir_depth_frac", "depth")
    found = bridge(cards, events, row_id="depth").where(F.col("depth").isNotNull())
    found = found.select("card_id", "record_id", F.col("depth").alias("nadir_depth_frac"))
    return quality.never_empty(found, "signature row that matches a card")


# A folder of cards named by triple: long runs have theirs, short ones are off by a millisecond, others are absent; some files belong to no card.
_NAMED = "subject_id || '_' || record_id || '_' || CAST(CAST(round({t} * 1000) AS BIGINT) + {off} AS {text}) || '.png'"
_FOLDERS = (
    ("manifest", "'gallery/' || stratum || '/' || ", "t_nbp", 0, "phase3_duration_s >= 20e0"),
    ("manifest", "'gallery/' || stratum || '/' || ", "t_nbp", 1, "phase3_duration_s < 10e0"),
    ("inv", "'gallery/extra/' || ", "nbp_timestamp_s", 0, "reject_reason = 'no_pleth' AND phase3_duration_s IS NULL"),
)


def _listing_sql(text: str) -> str:
    return " UNION ALL ".join(f"SELECT {folder}{_NAMED.format(t=t, off=off, text=text)} AS path FROM {rows} WHERE {cond}" for rows, folder, t, off, cond in _FOLDERS)


C15_SQL = f"""{WITH}, {POOL}, {MANIFEST_SQL}, listing AS ({_listing_sql("VARCHAR")} UNION ALL SELECT 'gallery/notes/' || card_id || '.txt' FROM manifest),
files AS (SELECT regexp_extract(path, '([^/_]+)_([^/_]+)_(-?[0-9]+)\\.png$', ['s', 'r', 'ms']) AS k FROM listing WHERE regexp_matches(path, '([^/_]+)_([^/_]+)_(-?[0-9]+)\\.png$'))"""


def _triple_listing(manifest: DataFrame, inv: DataFrame) -> DataFrame:
    """Paths as a folder of rendered cards would list them."""
    rows = {"manifest": manifest, "inv": inv}
    parts = [rows[r].where(cond).selectExpr(f"{folder}{_NAMED.format(t=t, off=off, text='STRING')} AS path") for r, folder, t, off, cond in _FOLDERS]
    notes = manifest.selectExpr("'gallery/notes/' || card_id || '.txt' AS path")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(notes)


@query("c15_cards_on_disk", f"""{C15_SQL} SELECT card_id, stratum FROM manifest m
WHERE EXISTS (SELECT 1 FROM files f WHERE f.k.s = m.subject_id AND f.k.r = m.record_id AND CAST(f.k.ms AS BIGINT) = CAST(round(m.t_nbp * 1000) AS BIGINT))""")
def c15(spark: SparkSession, d: str) -> DataFrame:
    manifest = cut_lineage(manifest_of(spark, d))
    files = artifact_triples(_triple_listing(manifest, inventory(spark, d)))
    return with_artifact(manifest, files).select("card_id", "stratum")


CARD_FILES_SQL = f"""{WITH}, {POOL}, {MANIFEST_SQL}, cardfiles AS (SELECT 'run7/' || stratum || '/' || card_id || '.png' AS path FROM manifest WHERE coalesce(phase3_duration_s, 0e0) < 10e0 OR phase3_duration_s >= 15e0
 UNION ALL SELECT 'run7/retired/' || card_id || '.png' FROM manifest WHERE phase3_duration_s >= 10e0 AND phase3_duration_s < 15e0 UNION ALL SELECT 'run7/' || stratum || '/' || card_id || '.svg' FROM manifest),
lookup AS (SELECT m.subject_id, m.record_id, CAST(round(m.t_nbp * 1000) AS BIGINT) AS ms, max(path) AS path FROM manifest m JOIN cardfiles f ON f.path = 'run7/' || m.stratum || '/' || m.card_id || '.png' GROUP BY 1, 2, 3)"""


def _card_listing(manifest: DataFrame) -> DataFrame:
    """Cards by id: some are only in a folder of retired cards, and every card has a drawing of another kind."""
    named = lambda cond, path: manifest.where(cond).selectExpr(f"{path} AS path")
    return named("coalesce(phase3_duration_s, 0) < 10 OR phase3_duration_s >= 15", "'run7/' || stratum || '/' || card_id || '.png'").unionByName(
        named("phase3_duration_s >= 10 AND phase3_duration_s < 15", "'run7/retired/' || card_id || '.png'")
    ).unionByName(named("true", "'run7/' || stratum || '/' || card_id || '.svg'"))


# Times a tenth of a millisecond off round to the card's; times 0.6 ms off do not.
@query("c15_resolved_rows", f"""{CARD_FILES_SQL}, asked AS (SELECT subject_id, record_id, nbp_timestamp_s + CASE WHEN phase3_duration_s >= 30e0 THEN 6e-4 ELSE 1e-4 END AS t FROM inv WHERE pre_window_valid)
SELECT a.subject_id, a.record_id, round(a.t, 4) AS t, l.path AS artifact FROM asked a LEFT JOIN lookup l ON l.subject_id = a.subject_id AND l.record_id = a.record_id AND l.ms = CAST(round(a.t * 1000) AS BIGINT)""")
def c15_resolved(spark: SparkSession, d: str) -> DataFrame:
    manifest = cut_lineage(manifest_of(spark, d))
    asked = inventory(spark, d).where("pre_window_valid").select(
        "subject_id", "record_id", (F.col("nbp_timestamp_s") + F.when(F.col("phase3_duration_s") >= 30, 6e-4).otherwise(1e-4)).alias("t")
    )
    found = resolve_artifacts(asked, artifact_lookup(manifest, _card_listing(manifest)), t="t")
    return found.withColumn("t", F.round("t", 4))


@query("c15_lookup_report", f"""{CARD_FILES_SQL} SELECT (SELECT count(*) FROM manifest) AS n_cards, (SELECT count(*) FROM lookup) AS n_resolved, (SELECT count(*) FROM cardfiles) AS n_files""")
def c15_report(spark: SparkSession, d: str) -> DataFrame:
    manifest = cut_lineage(manifest_of(spark, d))
    listing = _card_listing(manifest)
    return lookup_report(manifest, listing, artifact_lookup(manifest, listing))


FLOW_SQL = f"""{POOL}, {MANIFEST_SQL}, reader AS (SELECT card_id, {READER_RULE} AS call FROM manifest), f AS (SELECT
 (SELECT count(*) FROM inv) AS n_candidates, (SELECT count(DISTINCT record_id) FROM inv) AS n_records, (SELECT count(DISTINCT subject_id) FROM inv) AS n_subjects,
 {_count("no_pleth")} AS n_no_pleth, {_count("pleth_mostly_nan")} AS n_pleth_nan, (SELECT count(*) FROM inv WHERE pre_window_valid) AS n_qc_pass,
 (SELECT count(*) FROM inv WHERE reject_reason IS NULL) AS n_detector_positive, {_count("stat_mode_short_phase3")} + {_count("no_recovery_in_window")} AS n_near_miss_pool,
 {_count("no_aligned_occlusion")} AS n_uncovered_no_align, {_count("pre_pi_implausible")} AS n_uncovered_implausible,
 (SELECT count(*) FROM manifest) AS n_gallery, (SELECT count(DISTINCT subject_id) FROM manifest) AS n_gallery_subjects,
 (SELECT count(*) FROM manifest WHERE stratum = 'detector_positive') AS n_sampled_positive,
 (SELECT count(*) FROM manifest WHERE stratum = 'detector_rejected_near_miss') AS n_sampled_near_miss,
 (SELECT count(*) FROM manifest WHERE stratum = 'detector_negative_random') AS n_sampled_negative,
 (SELECT count(*) FROM reader WHERE call = 'occlusion_signature_present') AS n_reader_present,
 (SELECT count(*) FROM reader WHERE call = 'no_occlusion_signature') AS n_reader_absent,
 (SELECT count(*) FROM reader WHERE call = 'indeterminate') AS n_reader_indeterminate),
g AS (SELECT *, n_candidates - n_no_pleth - n_pleth_nan AS n_evaluable, n_uncovered_no_align + n_uncovered_implausible AS n_uncovered FROM f),
h AS (SELECT *, n_evaluable - n_detector_positive - n_near_miss_pool - n_uncovered AS n_negative_pool FROM g),
flow AS (SELECT *, n_detector_positive + n_near_miss_pool + n_negative_pool AS coverage FROM h)"""


def _flow(spark: SparkSession, d: str) -> DataFrame:
    manifest = cut_lineage(manifest_of(spark, d))
    reader = manifest.select("card_id", F.expr(READER_RULE).alias("call"))
    return funnel.flow_counts(inventory(spark, d), manifest, reader)


@query("d29_flow_counts", f"""{WITH}, {FLOW_SQL} SELECT *, round(100e0 * coverage / n_evaluable, 6) AS coverage_pct, round(100e0 * n_detector_positive / n_qc_pass, 6) AS pct_detector_positive,
 round(n_detector_positive * 1e0 / n_sampled_positive, 6) AS weight_positive, round(n_near_miss_pool * 1e0 / n_sampled_near_miss, 6) AS weight_near_miss,
 round(n_negative_pool * 1e0 / n_sampled_negative, 6) AS weight_negative FROM flow""")
def d29(spark: SparkSession, d: str) -> DataFrame:
    rates = ["coverage_pct", "pct_detector_positive", "weight_positive", "weight_near_miss", "weight_negative"]
    flow = _flow(spark, d)
    return flow.select(*[c for c in flow.columns if c not in rates], *r6(*rates))


@query("j01_count_identities", f"""{WITH}, {FLOW_SQL} SELECT 'evaluable = candidates - no_pleth - pleth_mostly_nan' AS "check", n_evaluable = n_candidates - n_no_pleth - n_pleth_nan AS ok FROM flow
UNION ALL SELECT 'evaluable = positive + near_miss_pool + negative_pool + uncovered', n_evaluable = n_detector_positive + n_near_miss_pool + n_negative_pool + n_uncovered FROM flow
UNION ALL SELECT 'uncovered = no_aligned_occlusion + pre_pi_implausible', n_uncovered = n_uncovered_no_align + n_uncovered_implausible FROM flow
UNION ALL SELECT 'coverage = positive + near_miss_pool + negative_pool', coverage = n_detector_positive + n_near_miss_pool + n_negative_pool FROM flow
UNION ALL SELECT 'coverage + uncovered = evaluable', coverage + n_uncovered = n_evaluable FROM flow
UNION ALL SELECT 'gallery = sampled positive + near_miss + negative', n_gallery = n_sampled_positive + n_sampled_near_miss + n_sampled_negative FROM flow
UNION ALL SELECT 'gallery = reader present + absent + indeterminate', n_gallery = n_reader_present + n_reader_absent + n_reader_indeterminate FROM flow
UNION ALL SELECT 'detector-positive census (sampled positive == positive pool)', n_sampled_positive = n_detector_positive FROM flow""")
def j01(spark: SparkSession, d: str) -> DataFrame:
    return quality.flow_identities(_flow(spark, d))


@query("g07_split_half", f"""{WITH}, s AS (SELECT DISTINCT subject_id FROM inv), p AS (SELECT subject_id, row_number() OVER (ORDER BY md5(concat_ws('|', subject_id, '{SEED}')), subject_id) AS rk, count(*) OVER () AS n FROM s)
SELECT subject_id, CASE WHEN rk <= n // 2 THEN 'calibration' ELSE 'held_out' END AS split FROM p""")
def g07(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_half(inventory(spark, d))


PILOT = ("10", "20")


@query("g10_pilot_pool", f"""{WITH}, ids AS (SELECT *, subject_id || '_' || record_id || '_' || (row_number() OVER (ORDER BY subject_id, record_id, nbp_timestamp_s) - 1) AS row_id FROM inv),
c AS (SELECT *, row_number() OVER (PARTITION BY reject_reason ORDER BY subject_id, record_id, nbp_timestamp_s) AS k FROM ids
 WHERE reject_reason IN ('pre_window_unstable', 'no_phase2', 'pre_pi_implausible', 'phase2_misaligned', 'pleth_mostly_nan', 'stat_mode_short_phase3'))
SELECT row_id, reject_reason FROM c WHERE k <= 2 UNION ALL SELECT row_id, reject_reason FROM ids WHERE subject_id IN ('10', '20') AND phase3_duration_s >= 15e0 AND is_occlusion_signature""")
def g10(spark: SparkSession, d: str) -> DataFrame:
    inv = inventory(spark, d).select(
        "subject_id", "record_id", "nbp_timestamp_s", "reject_reason", "phase3_duration_s", "is_occlusion_signature"
    )
    return sampling.pilot_pool(sorted_row_id(inv), PILOT).select("row_id", "reject_reason")


@query("g12_sorted_head", f"{WITH} SELECT subject_id, record_id, nbp_timestamp_s FROM inv ORDER BY 1, 2, 3 LIMIT 100")
def g12(spark: SparkSession, d: str) -> DataFrame:
    """Top of a multi-key sort: the limit is the feature."""
    return inventory(spark, d).select("subject_id", "record_id", "nbp_timestamp_s").orderBy("subject_id", "record_id", "nbp_timestamp_s").limit(100)


@query("j04_manifest", None)
def j04(spark: SparkSession, d: str) -> DataFrame:
    files = quality.content_digests(
        manifest_of(spark, d).select(F.col("image_path").alias("path"), F.concat_ws("|", "card_id", "stratum").alias("content"))
    )
    return quality.manifest(inventory(spark, d), files, "lineitem x orders", F.lit("1970-01-01T00:00:00+00:00"))


# --- calibration --------------------------------------------------------------------------------------------

QUAL_SQL = "phase3_duration_s >= 10e0 AND nadir_depth_frac < 0.2e0 AND alignment_offset_s IS NOT NULL"
SPLIT_SQL = f"""s AS (SELECT DISTINCT subject_id FROM inv), p AS (SELECT subject_id, row_number() OVER (ORDER BY md5(concat_ws('|', subject_id, '{SEED}')), subject_id) AS rk, count(*) OVER () AS n FROM s),
cal AS (SELECT inv.* FROM inv JOIN p USING (subject_id) WHERE rk <= n // 2), held AS (SELECT inv.* FROM inv JOIN p USING (subject_id) WHERE rk > n // 2),
off AS (SELECT alignment_offset_s AS o FROM cal WHERE {QUAL_SQL})"""


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    inv = inventory(spark, d)
    # One row per subject: kept, so the halves do not redo the split.
    split = cut_lineage(sampling.split_half(inv))
    tagged = inv.join(split, "subject_id")
    return tagged.where(F.col("split") == "calibration"), tagged.where(F.col("split") == "held_out")


def _q(p: float) -> str:
    return f"quantile_cont(o, {p})"


OFFSETS_SQL = f"""SELECT count(*) AS n_qualifying, round({_q(0.5)}, 6) AS median_s, round({_q(0.75)} - {_q(0.25)}, 6) AS iqr_s, round({_q(0.25)}, 6) AS q25_s, round({_q(0.75)}, 6) AS q75_s,
 {", ".join(f"round({_q(p / 100)}, 6) AS p{p:g}_s".replace(f"p{p:g}_s", f"p{p:g}_s".replace(".", "_")) for p in V.OFFSET_PERCENTILES)} FROM off"""


@query("d20_offset_summary", f"{WITH}, {SPLIT_SQL} {OFFSETS_SQL}")
def d20(spark: SparkSession, d: str) -> DataFrame:
    summary = calibrate.offset_summary(calibrate.qualifying_offsets(_halves(spark, d)[0]))
    return summary.select("n_qualifying", *r6(*summary.columns[1:]))


@query("d21_qualifying_offsets", f"{WITH} SELECT subject_id, record_id, alignment_offset_s FROM inv WHERE {QUAL_SQL}")
def d21(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.qualifying_offsets(inventory(spark, d)).select("subject_id", "record_id", "alignment_offset_s")


WINDOWS_SQL = f"""win AS (SELECT 1 AS window_no, 'R-95' AS window_name, {_q(0.025)} AS lower_s, {_q(0.975)} AS upper_s FROM off
 UNION ALL SELECT 2, 'R-90', {_q(0.05)}, {_q(0.95)} FROM off UNION ALL SELECT 3, 'prereg', -50e0, 30e0)"""


@query("d22_derived_windows", f"{WITH}, {SPLIT_SQL}, {WINDOWS_SQL} SELECT window_no, window_name, round(lower_s, 6) AS lower_s, round(upper_s, 6) AS upper_s FROM win")
def d22(spark: SparkSession, d: str) -> DataFrame:
    w = calibrate.derive_windows(calibrate.qualifying_offsets(_halves(spark, d)[0]))
    return w.select("window_no", "window_name", *r6("lower_s", "upper_s"))


REPS = 5_000
HELD_SQL = f"""ind AS (SELECT subject_id, w.*, CAST(coalesce(phase3_duration_s >= 15e0 AND nadir_depth_frac < 0.2e0 AND alignment_offset_s >= lower_s AND alignment_offset_s <= upper_s AND recovered, false) AS INTEGER) AS hit
 FROM held, win w WHERE pre_window_valid),
cl AS (SELECT window_no, subject_id, sum(hit) * 1e0 AS x, count(*) * 1e0 AS y FROM ind GROUP BY 1, 2),
num AS (SELECT *, row_number() OVER (PARTITION BY window_no ORDER BY md5(concat_ws('|', subject_id, '{SEED}')), subject_id) - 1 AS pos, count(*) OVER (PARTITION BY window_no) AS k FROM cl),
draw AS ({draw_sql('num', REPS, SEED, 'window_no, ')}),
reps AS (SELECT d.window_no, rep, sum(x) / sum(y) AS v FROM draw d JOIN num n ON d.window_no = n.window_no AND d.pick = n.pos GROUP BY 1, 2),
ci AS (SELECT window_no, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high FROM reps GROUP BY 1),
heldout AS (SELECT i.window_no, window_name, lower_s, upper_s, CAST(sum(hit) AS BIGINT) AS n_events_primary_heldout, count(DISTINCT subject_id) FILTER (hit = 1) AS n_patients_primary_heldout,
 count(*) AS n_evaluable_qc_pass_heldout, avg(hit) AS primary_rate_per_evaluable_heldout, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high
 FROM ind i JOIN ci ON i.window_no = ci.window_no GROUP BY 1, 2, 3, 4)"""
HELD_COLS = """window_no, window_name, round(lower_s, 6) AS lower_s, round(upper_s, 6) AS upper_s, n_events_primary_heldout, n_patients_primary_heldout, n_evaluable_qc_pass_heldout,
 round(primary_rate_per_evaluable_heldout, 6) AS primary_rate_per_evaluable_heldout, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high"""


def _held(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cal, held = _halves(spark, d)
    offsets = calibrate.qualifying_offsets(cal)
    indicators = calibrate.window_indicators(held, calibrate.derive_windows(offsets))
    return offsets, calibrate.held_out_yields(indicators, REPS)


HELD_FLOATS = ["lower_s", "upper_s", "primary_rate_per_evaluable_heldout", "ci_low", "ci_high"]


@query("d23_heldout_windows", f"{WITH}, {SPLIT_SQL}, {WINDOWS_SQL}, {HELD_SQL} SELECT {HELD_COLS} FROM heldout")
def d23(spark: SparkSession, d: str) -> DataFrame:
    held = _held(spark, d)[1]
    return held.select(*[c for c in held.columns if c not in HELD_FLOATS], *r6(*HELD_FLOATS))


@query("d24_split_half_table", f"""{WITH}, {SPLIT_SQL}, {WINDOWS_SQL}, {HELD_SQL} SELECT {HELD_COLS}, (SELECT round({_q(0.5)}, 6) FROM off) AS calibration_median_s,
 (SELECT round({_q(0.75)} - {_q(0.25)}, 6) FROM off) AS calibration_iqr_s FROM heldout""")
def d24(spark: SparkSession, d: str) -> DataFrame:
    offsets, held = _held(spark, d)
    out = calibrate.split_half_table(calibrate.offset_summary(offsets), held)
    floats = [*HELD_FLOATS, "calibration_median_s", "calibration_iqr_s"]
    return out.select(*[c for c in out.columns if c not in floats], *r6(*floats))


# --- typical rows and curves -----------------------------------------------------------------------------------

FEATURES = ["nadir_depth_frac", "phase3_duration_s"]


@query("e10_zscore", f"""{WITH}, m AS (SELECT avg(nadir_depth_frac) AS m1, stddev_pop(nadir_depth_frac) AS s1, avg(phase3_duration_s) AS m2, stddev_pop(phase3_duration_s) AS s2 FROM inv)
SELECT record_id, nbp_timestamp_s, round((nadir_depth_frac - m1) / s1, 6) AS z_nadir_depth_frac, round((phase3_duration_s - m2) / s2, 6) AS z_phase3_duration_s FROM inv, m""")
def e10(spark: SparkSession, d: str) -> DataFrame:
    z = choose.zscores(inventory(spark, d).select("record_id", "nbp_timestamp_s", *FEATURES), FEATURES)
    return z.select("record_id", "nbp_timestamp_s", *r6("z_nadir_depth_frac", "z_phase3_duration_s"))


@query("f11_near_median_rank", f"""{WITH}, sig AS (SELECT * FROM inv WHERE is_occlusion_signature), m AS (SELECT median(nadir_depth_frac) AS q1, stddev_pop(nadir_depth_frac) AS s1, median(phase3_duration_s) AS q2, stddev_pop(phase3_duration_s) AS s2 FROM sig)
SELECT record_id, nbp_timestamp_s, round(sqrt(((nadir_depth_frac - q1) / s1) * ((nadir_depth_frac - q1) / s1) + ((phase3_duration_s - q2) / s2) * ((phase3_duration_s - q2) / s2)), 6) AS dist FROM sig, m""")
def f11(spark: SparkSession, d: str) -> DataFrame:
    sig = inventory(spark, d).where("is_occlusion_signature").select("subject_id", "record_id", "nbp_timestamp_s", *FEATURES)
    ranked = choose.rank_near_median(sig, FEATURES, ["subject_id", "record_id", "nbp_timestamp_s"])
    return ranked.select("record_id", "nbp_timestamp_s", *r6("dist"))


@query("f13_representative_per_subject", f"""{WITH}, sig AS (SELECT *, CAST(round(nbp_timestamp_s * 1000) AS BIGINT) AS ms FROM inv WHERE is_occlusion_signature),
m AS (SELECT subject_id, median(nadir_depth_frac) AS median_value, count(*) AS n_rows FROM sig GROUP BY 1),
r AS (SELECT sig.*, median_value, n_rows, row_number() OVER (PARTITION BY subject_id ORDER BY round(abs(nadir_depth_frac - median_value), 9), md5(concat_ws('|', record_id, CAST(ms AS VARCHAR), '{SEED}')), record_id, ms) AS k FROM sig JOIN m USING (subject_id))
SELECT subject_id, round(median_value, 6) AS median_value, record_id, ms, round(nadir_depth_frac, 6) AS nadir_depth_frac, phase3_duration_s, n_rows FROM r WHERE k = 1""")
def f13(spark: SparkSession, d: str) -> DataFrame:
    sig = inventory(spark, d).where("is_occlusion_signature").withColumn("ms", time_key(F.col("nbp_timestamp_s")))
    out = choose.representative_per_group(sig, "subject_id", "nadir_depth_frac", ["record_id", "ms"], ["phase3_duration_s"])
    return out.select("subject_id", *r6("median_value"), "record_id", "ms", *r6("nadir_depth_frac"), "phase3_duration_s", "n_rows")


@query("f14_most_represented", f"{WITH} SELECT subject_id, record_id, count(*) AS n FROM inv WHERE reject_reason = 'no_phase2' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return funnel.most_represented(inventory(spark, d), "no_phase2")


@query("f15_pick_event", f"""{WITH} SELECT record_id, nbp_timestamp_s, pre_window_quality FROM inv WHERE reject_reason = 'no_phase2' AND pre_window_valid
ORDER BY pre_window_quality DESC, subject_id, record_id, nbp_timestamp_s LIMIT 1""")
def f15(spark: SparkSession, d: str) -> DataFrame:
    usable = inventory(spark, d).where((F.col("reject_reason") == V.NO_DIP) & F.col("pre_window_valid"))
    found = funnel.first_row(usable, [-F.col("pre_window_quality")], "usable row without a dip")
    return found.select("record_id", "nbp_timestamp_s", "pre_window_quality")


@query("f15_unusable_panels", f"""{WITH}, pref(preference, reason, need, sgn) AS (VALUES (0, 'no_pleth', false, NULL), (1, 'pre_window_unstable', false, -1e0), (2, 'no_phase2', true, 1e0), (3, 'pleth_mostly_nan', false, NULL), (4, 'pre_pi_implausible', false, NULL)),
g AS (SELECT preference, reason, subject_id, record_id, count(*) AS n FROM inv JOIN pref ON reject_reason = reason GROUP BY ALL),
top AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY reason ORDER BY n DESC, subject_id, record_id) = 1 ORDER BY preference LIMIT 3),
e AS (SELECT t.preference, t.reason, t.subject_id, t.record_id, t.n AS n_events, i.nbp_timestamp_s,
 row_number() OVER (PARTITION BY t.reason ORDER BY coalesce(sgn * pre_window_quality, 'inf'::DOUBLE), i.nbp_timestamp_s) AS k
 FROM top t JOIN pref USING (reason) JOIN inv i ON i.reject_reason = t.reason AND i.subject_id = t.subject_id AND i.record_id = t.record_id WHERE NOT need OR pre_window_valid)
SELECT preference, reason, subject_id, record_id, n_events, nbp_timestamp_s FROM e WHERE k = 1""")
def f15_panels(spark: SparkSession, d: str) -> DataFrame:
    return funnel.unusable_panels(inventory(spark, d))


@query("f16_preferred_event", f"""{WITH}, c AS (SELECT *, CASE WHEN subject_id = '3' AND abs(nbp_timestamp_s - 1e6) <= 1e0 THEN 0 WHEN subject_id = '10' THEN 1 WHEN subject_id = '20' THEN 2 END AS priority
 FROM inv WHERE reject_reason IS NULL AND phase3_duration_s >= 15e0)
SELECT subject_id, record_id, nbp_timestamp_s, priority FROM c WHERE priority IS NOT NULL ORDER BY priority, nbp_timestamp_s, record_id LIMIT 1""")
def f16(spark: SparkSession, d: str) -> DataFrame:
    found = funnel.preferred_event(inventory(spark, d), (("3", 1e6),), ("10", "20"))
    return found.select("subject_id", "record_id", "nbp_timestamp_s", "priority")


def _curve_sql(n_t: int) -> str:
    step = 70.0 / (n_t - 1)
    return f"""pts AS (SELECT record_id, nbp_timestamp_s, nadir_depth_frac AS low, recovery_fraction_at_window_end AS fin, greatest(phase2_duration_s, 1e-6) AS p2, greatest(phase3_duration_s, 1e-6) AS p3,
 ti, -10e0 + ti * {step!r}::DOUBLE AS t FROM inv, range({n_t}) g(ti) WHERE is_occlusion_signature),
curve AS (SELECT record_id, nbp_timestamp_s, CAST(ti AS INTEGER) AS ti, t, CASE WHEN t <= 0 THEN 1e0 WHEN t <= p2 THEN 1e0 + (low - 1e0) * (t / p2) ELSE low + (fin - low) * ((t - p2) / p3) END AS y FROM pts WHERE t <= p2 + p3)"""


def _curve(spark: SparkSession, d: str, n_t: int) -> DataFrame:
    sig = inventory(spark, d).where("is_occlusion_signature")
    return curves.landmark_curve(sig, ["record_id", "nbp_timestamp_s"], n_t=n_t)


@query("f17_landmark_curve", f"""{WITH}, {_curve_sql(561)} SELECT record_id, nbp_timestamp_s, count(*) AS n_points, min(ti) AS first_ti, max(ti) AS last_ti,
round(min(y) + 1e-9, 6) AS low, round(max(y) + 1e-9, 6) AS high, round(avg(y) + 1e-9, 6) AS mean FROM curve GROUP BY 1, 2""")
def f17(spark: SparkSession, d: str) -> DataFrame:
    """Every event's curve on the whole grid, summed up to a row: the points themselves are 300 times the events."""
    near = lambda c: F.round(c + 1e-9, 6)
    return _curve(spark, d, 561).groupBy("record_id", "nbp_timestamp_s").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("ti").alias("first_ti"), F.max("ti").alias("last_ti"),
        near(F.min("y")).alias("low"), near(F.max("y")).alias("high"), near(F.avg("y")).alias("mean"),
    )


@query("d31_curve_quantiles", f"""{WITH}, {_curve_sql(561)} SELECT ti, t, count(*) AS n, round(median(y) + 1e-9, 6) AS median, round(quantile_cont(y, 0.25) + 1e-9, 6) AS q25, round(quantile_cont(y, 0.75) + 1e-9, 6) AS q75 FROM curve
GROUP BY 1, 2 HAVING count(*) >= 0.40e0 * (SELECT count(*) FROM inv WHERE is_occlusion_signature)""")
def d31(spark: SparkSession, d: str) -> DataFrame:
    # Equal curves are one: events shrink before each becomes hundreds of points.
    shapes = cut_lineage(curves.distinct_curves(inventory(spark, d).where("is_occlusion_signature")))
    total = shapes.agg(F.sum("copies"))
    out = curves.curve_quantiles(curves.landmark_curve(shapes, ["copies"], n_t=561), total, weight="copies")
    # Means of two values often end half way between two roundings; a nudge sends them up in both engines.
    return out.select("ti", "t", "n", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("median", "q25", "q75")])


@query("d32_density_2d", f"""{WITH}, {_curve_sql(561)}, c AS (SELECT ti, CAST(greatest(0, least(199, floor((y - 0.7e0) / 0.005e0))) AS INTEGER) AS yi, count(*) AS n FROM curve GROUP BY 1, 2)
SELECT ti, yi, n, round(n * 1e0 / max(n) OVER (), 6) AS density FROM c""")
def d32(spark: SparkSession, d: str) -> DataFrame:
    return curves.density(_curve(spark, d, 561)).withColumn("density", F.round("density", 6))


@query("f18_tile_geometry", f"""{WITH}, s AS (SELECT *, greatest(4e0, 0.18e0 * (phase2_duration_s + phase3_duration_s)) AS lead FROM inv WHERE is_occlusion_signature)
SELECT record_id, nbp_timestamp_s, 0 AS point, 0e0 AS t_s, 100e0 AS pct FROM s UNION ALL SELECT record_id, nbp_timestamp_s, 1, round(lead, 6), 100e0 FROM s
UNION ALL SELECT record_id, nbp_timestamp_s, 2, round(lead + phase2_duration_s, 6), round(nadir_depth_frac * 100e0, 6) FROM s
UNION ALL SELECT record_id, nbp_timestamp_s, 3, round(lead + phase2_duration_s + phase3_duration_s, 6), round(recovery_fraction_at_window_end * 100e0, 6) FROM s""")
def f18(spark: SparkSession, d: str) -> DataFrame:
    sig = inventory(spark, d).where("is_occlusion_signature")
    out = curves.tile_geometry(sig, ["record_id", "nbp_timestamp_s"])
    return out.select("record_id", "nbp_timestamp_s", "point", *r6("t_s", "pct"))
