"""Column expressions for labels, flags, ratios and named categories."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from troughline import vocabulary as V

_BLANKS = " \t\r\n"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def normalise_label(c: Column) -> Column:
    return F.lower(F.btrim(c.cast("string"), F.lit(_BLANKS)))


def rated(df: DataFrame, call: str, out: str | None = None) -> DataFrame:
    """Normalise a label column and drop rows nobody has rated."""
    out = out or call
    return df.withColumn(out, normalise_label(F.col(call))).where(F.col(out) != "")


def truthy(c: Column) -> Column:
    return F.lower(c.cast("string")).isin("true", "1", "t", "yes")


def tolerant_flag(c: Column) -> Column:
    """Whatever casts to true; everything else, NULL included, is false."""
    return F.coalesce(c.try_cast("boolean"), F.lit(False))


def recode_strict(c: Column, mapping: Mapping[str, str], what: str = "value") -> Column:
    """Map labels; a label outside the mapping (NULL too) fails the job."""
    (first, to), *rest = mapping.items()
    expr = F.when(c == first, to)
    for old, new in rest:
        expr = expr.when(c == old, new)
    return expr.otherwise(
        F.raise_error(F.concat(F.lit(f"unexpected {what}: "), F.coalesce(c, F.lit("NULL")))).cast("string")
    )


def call_label(flag: Column, yes: str = V.PRESENT, no: str = V.ABSENT) -> Column:
    return F.when(flag, F.lit(yes)).otherwise(F.lit(no))


def reason_in(reason: Column, allowed: Iterable[str | None]) -> Column:
    """Membership where None in `allowed` admits the NULL reason."""
    allowed = tuple(allowed)
    named = F.coalesce(reason.isin(*[r for r in allowed if r is not None]), F.lit(False))
    return (reason.isNull() | named) if None in allowed else named


def at_least(value: Column, floor: float | Column) -> Column:
    """`value >= floor`, false for NULL and for NaN (which Spark ranks above everything)."""
    return F.coalesce(~F.isnan(value) & (value >= floor), F.lit(False))


def measured(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def evaluable(reason: Column, excluded: Iterable[str] = (V.NO_SIGNAL,)) -> Column:
    return ~F.coalesce(reason.isin(*excluded), F.lit(False))


def collapse_binary(call: Column) -> Column:
    return F.when(call == V.PRESENT, F.lit(V.PRESENT)).otherwise(F.lit(V.ABSENT))


def change_direction(before: Column, after: Column) -> Column:
    before = F.coalesce(before, F.lit(""))
    return (
        F.when(before == after, "unchanged")
        .when(after == V.PRESENT, "to_present")
        .when(before == V.PRESENT, "from_present")
        .when(after == V.INDETERMINATE, "to_indeterminate")
        .when(before == V.INDETERMINATE, "from_indeterminate")
        .otherwise("other")
    )


# Inclusive upper bounds of the verbal agreement bands (Landis and Koch, 1977).
AGREEMENT_BANDS = ((0.20, "slight"), (0.40, "fair"), (0.60, "moderate"), (0.80, "substantial"))


def agreement_band(kappa: Column) -> Column:
    finite = measured(kappa) & (F.abs(kappa) != float("inf"))
    band = F.when(~finite, "undefined").when(kappa < 0, "poor")
    for upper, name in AGREEMENT_BANDS:
        band = band.when(kappa <= upper, name)
    return band.otherwise("almost perfect")


def safe_ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def safe_percent(num: Column, den: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(100.0 * num.cast("double"), den.cast("double")), digits)


def disagreement_category(
    key: str,
    reader: str = "reader_call",
    flagged: str = "detector_positive",
    model: str = "model_call",
    model_conf: str = "model_confidence",
    confident: float = 0.9,
) -> Column:
    """Membership predicate of one named three-rater pattern."""
    r, d, m = F.col(reader), F.col(flagged), F.col(model)
    patterns = {
        "detector_overcall": (r == V.ABSENT) & d & (m != V.PRESENT),
        "both_machines_overcall": (r == V.ABSENT) & d & (m == V.PRESENT),
        "reader_only_present": (r == V.PRESENT) & ~d & (m == V.ABSENT),
        "reader_indeterminate": (r == V.INDETERMINATE) & at_least(F.col(model_conf), confident),
        "all_agree_positive": (r == V.PRESENT) & d & (m == V.PRESENT),
    }
    if key not in patterns:
        raise ValueError(f"unknown category {key!r}; expected one of {sorted(patterns)}")
    return patterns[key]


# Categories in report order.
DISAGREEMENT_CATEGORIES = (
    "detector_overcall",
    "both_machines_overcall",
    "reader_only_present",
    "reader_indeterminate",
    "all_agree_positive",
)


def disagreement_label(**roles: str) -> Column:
    """The one category a row falls in; the five patterns never overlap."""
    return F.coalesce(*[F.when(disagreement_category(k, **roles), F.lit(k)) for k in DISAGREEMENT_CATEGORIES])


# Fixed value: what a number looks like as text; type suffixes such as `120f` are none.
NUMBER = r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+)?$|^[+-]?(nan|inf|infinity)$"


def number(text: Column) -> Column:
    """A number written as text, blanks around it aside; NULL for anything else."""
    bare = F.btrim(text, F.lit(" \t\r\n"))
    return F.when(bare.rlike(NUMBER), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))
