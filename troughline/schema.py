"""Table layouts, column roles and the missing-column guard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _D, _B, _L = T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


# Column names and types of the exchanged tables.
EVENT_INVENTORY = _struct(
    subject_id=_S, record_id=_S, nbp_timestamp_s=_D, is_occlusion_signature=_B,
    stat_mode_candidate=_B, recovered=_B, ambiguous_multi_dip=_B, pre_event_pi_mean=_D,
    pre_window_quality=_D, pre_window_valid=_B, t_occlusion_start_s=_D, t_deflate_start_s=_D,
    t_nadir_s=_D, t_release_s=_D, phase2_duration_s=_D, phase3_duration_s=_D,
    nadir_depth_frac=_D, recovery_fraction_at_window_end=_D, alignment_offset_s=_D,
    pleth_fs=_D, pleth_valid_fraction=_D, reject_reason=_S,
)
STAYS = _struct(subject_id=_L, hadm_id=_L, stay_id=_L, intime=T.TimestampNTZType(), outtime=T.TimestampNTZType())
LINKAGE = _struct(
    record_id=_S, subject_id=_L, stay_id=_L, record_start=T.TimestampNTZType(), record_end=T.TimestampNTZType(),
    stay_intime=T.TimestampNTZType(), stay_outtime=T.TimestampNTZType(), overlap_s=_D, is_modal=_B,
)
RUN_LOG = _struct(
    subject_id=_S, record_id=_S, row_id=_S, mode=_S, model=_S, base_url=_S, temperature=_D,
    max_tokens=_L, seed=_L, prompt_sha256=_S, run_utc=_S, parsed_ok=_B, schema_complete=_B,
    parse_error=_S, phenotype=_S, vasopressor_use=_B, shock_state=_S, notes=_S, image_path=_S,
    image_sha256=_S, observed=_S, call=_S, confidence=_D, rationale=_S, raw_response=_S,
)
GALLERY_MANIFEST = _struct(
    card_id=_S, stratum=_S, subject_id=_S, record_id=_S, t_nbp=_D, image_path=_S, image_sha256=_S,
    is_occlusion_signature=_B, phase3_duration_s=_D, nadir_depth_frac=_D, alignment_offset_s=_D,
    reject_reason=_S,
)
RATER_FORM = _struct(card_id=_S, image_path=_S, call=_S, notes=_S)


@dataclass(frozen=True)
class InventoryColumns:
    """Which column plays which role in an event inventory."""

    subject: str = "subject_id"
    record: str = "record_id"
    anchor: str = "nbp_timestamp_s"
    signature: str = "is_occlusion_signature"
    recovered: str = "recovered"
    baseline: str = "pre_event_pi_mean"
    quality: str = "pre_window_quality"
    qc_valid: str = "pre_window_valid"
    descent: str = "phase2_duration_s"
    duration: str = "phase3_duration_s"
    depth: str = "nadir_depth_frac"
    recovery: str = "recovery_fraction_at_window_end"
    offset: str = "alignment_offset_s"
    valid_fraction: str = "pleth_valid_fraction"
    reason: str = "reject_reason"


INVENTORY = InventoryColumns()


def require_columns(df: DataFrame, *names: str, what: str = "input") -> DataFrame:
    """Return `df` unchanged, or fail naming every column it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} missing required columns: {missing}")
    return df
