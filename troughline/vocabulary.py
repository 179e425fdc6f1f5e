"""Values that results must carry verbatim. Nothing here is computed."""

# Outcome reasons, one per anchor. NULL means "primary event".
NO_SIGNAL = "no_pleth"
SIGNAL_MOSTLY_MISSING = "pleth_mostly_nan"
NO_TRACE = "no_pi"
NO_BASELINE = "no_pre_window"
BASELINE_IMPLAUSIBLE = "pre_pi_implausible"
BASELINE_UNSTABLE = "pre_window_unstable"
NO_SEARCH_WINDOW = "no_search_window"
NO_DIP = "no_phase2"
NOT_ALIGNED = "no_aligned_occlusion"
NOT_ALIGNED_LEGACY = "phase2_misaligned"
NOT_RECOVERED = "no_recovery_in_window"
SHORT_RUN = "stat_mode_short_phase3"

# Reason sets. None stands for the NULL reason.
UNUSABLE_REASONS = (NO_SIGNAL, SIGNAL_MOSTLY_MISSING)
PRIMARY_REASONS = (None, SHORT_RUN)
SENSITIVITY_REASONS = (None, SHORT_RUN, NOT_RECOVERED)
NEAR_MISS_REASONS = (SHORT_RUN, NOT_RECOVERED)
NEGATIVE_REASONS = (NO_DIP, BASELINE_UNSTABLE)
PILOT_REASONS = (
    BASELINE_UNSTABLE,
    NO_DIP,
    BASELINE_IMPLAUSIBLE,
    NOT_ALIGNED_LEGACY,
    SIGNAL_MOSTLY_MISSING,
    SHORT_RUN,
)

# Rater calls.
PRESENT = "occlusion_signature_present"
ABSENT = "no_occlusion_signature"
INDETERMINATE = "indeterminate"
PARSE_FAILURE = "parse_failure"
CALLS = (PRESENT, ABSENT, INDETERMINATE)
CALLABLE = (PRESENT, ABSENT)
LEGACY_CALLS = ("ipsilateral", "not_ipsilateral")
CALL_CLASSES = {PRESENT: "present", INDETERMINATE: "indeterminate", ABSENT: "absent"}
CLASS_ORDER = ("present", "indeterminate", "absent")

# Sampling strata, their id prefixes and their targets.
STRATUM_POSITIVE = "detector_positive"
STRATUM_NEAR_MISS = "detector_rejected_near_miss"
STRATUM_NEGATIVE = "detector_negative_random"
STRATUM_PREFIX = {STRATUM_POSITIVE: "A", STRATUM_NEAR_MISS: "B", STRATUM_NEGATIVE: "C"}
STRATUM_TARGETS = {STRATUM_POSITIVE: 268, STRATUM_NEAR_MISS: 200, STRATUM_NEGATIVE: 100}

# Seeds and thresholds.
SEED = 20260426
PRIMARY_MIN_S = 15.0
SENSITIVITY_MIN_S = 10.0
NADIR_DEPTH = 0.20
OFFSET_PERCENTILES = (2.5, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0, 95.0, 97.5)

# One-factor sweep grids around the default detector settings.
SWEEP_GRIDS = (
    ("nadir_depth", (("0.1", {"nadir_depth": 0.10}), ("0.15", {"nadir_depth": 0.15}),
                     ("0.2", {"nadir_depth": 0.20}), ("0.25", {"nadir_depth": 0.25}))),
    ("recovery_fraction", (("0.7", {"recovery_fraction": 0.70}), ("0.8", {"recovery_fraction": 0.80}),
                           ("0.85", {"recovery_fraction": 0.85}), ("0.9", {"recovery_fraction": 0.90}),
                           ("0.95", {"recovery_fraction": 0.95}))),
    ("alignment", (("+/-30", {"align_lo": -30.0, "align_hi": 30.0}),
                   ("+/-45", {"align_lo": -45.0, "align_hi": 45.0}),
                   ("+/-60", {"align_lo": -60.0, "align_hi": 60.0}),
                   ("[-50,+30]", {"align_lo": -50.0, "align_hi": 30.0}))),
    ("primary_min_s", (("10", {"primary_min": 10.0}), ("15", {"primary_min": 15.0}),
                       ("20", {"primary_min": 20.0}))),
)

# Funnel notes by stage.
FUNNEL_NOTES = {
    "candidate_cuff_cycles": "charted NBP timestamps across all records",
    "excluded_no_pleth": "no co-recorded PPG window available",
    "excluded_pleth_mostly_nan": "PPG window more than half missing",
    "evaluable_with_pleth": "candidates - no_pleth - pleth_mostly_nan",
    "qc_pass_pre_window": "stable, plausible pre-cuff PI window",
    "rejected_no_phase2": "no qualifying deep dip in the search window",
    "rejected_misaligned": "deep dip present but its nadir not aligned with the NBP timestamp",
    "stat_mode_short_envelope": "deep aligned dip recovered but sub-occlusion run < primary threshold",
    "rejected_no_recovery": "deep aligned dip that never returned to baseline (sensitivity only)",
}

# Confidence words, best first.
CONFIDENCE_RANK = {"high": 0, "med": 1, "low": 2}
