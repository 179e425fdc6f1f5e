"""Split-half calibration of alignment windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.functions.labels import at_least, measured
from troughline.functions.quantiles import exact_quantiles
from troughline.operators.bootstrap import ratio_intervals
from troughline.schema import INVENTORY, InventoryColumns, require_columns
from troughline.session import cut_lineage, with_scalars


def qualifying_offsets(
    inv: DataFrame, min_s: float = V.SENSITIVITY_MIN_S, depth: float = V.NADIR_DEPTH, cols: InventoryColumns = INVENTORY
) -> DataFrame:
    """Rows with a long and deep enough run and a finite alignment offset."""
    require_columns(inv, cols.duration, cols.depth, cols.offset, what="inventory")
    finite = measured(F.col(cols.offset)) & (F.abs(F.col(cols.offset)) != float("inf"))
    return inv.where(at_least(F.col(cols.duration), min_s) & (F.col(cols.depth) < depth) & finite)


def offset_summary(
    rows: DataFrame, percentiles: Sequence[float] = V.OFFSET_PERCENTILES, cols: InventoryColumns = INVENTORY
) -> DataFrame:
    """Count, median, quartiles and the reported percentiles of the offsets, in one row."""
    wanted = sorted({*percentiles, 25.0, 50.0, 75.0})
    q = exact_quantiles(rows, cols.offset, [p / 100.0 for p in wanted])
    at = {p: F.col(f"q{i}") for i, p in enumerate(wanted)}
    return q.select(
        F.col("n").alias("n_qualifying"), at[50.0].alias("median_s"), (at[75.0] - at[25.0]).alias("iqr_s"),
        at[25.0].alias("q25_s"), at[75.0].alias("q75_s"),
        *[at[p].alias(f"p{p:g}_s".replace(".", "_")) for p in percentiles],
    )


def derive_windows(
    rows: DataFrame, fixed: tuple[float, float] = (-50.0, 30.0), cols: InventoryColumns = INVENTORY
) -> DataFrame:
    """Three windows: central 95 %, central 90 % and the fixed one."""
    q = exact_quantiles(rows, cols.offset, [0.025, 0.975, 0.05, 0.95])
    window = lambda i, name, lo, hi: F.struct(
        F.lit(i).alias("window_no"), F.lit(name).alias("window_name"), lo.alias("lower_s"), hi.alias("upper_s")
    )
    return q.select(F.inline(F.array(
        window(1, "R-95", F.col("q0"), F.col("q1")), window(2, "R-90", F.col("q2"), F.col("q3")),
        window(3, "prereg", F.lit(float(fixed[0])), F.lit(float(fixed[1]))),
    )))


def window_indicators(
    inv: DataFrame, windows: DataFrame, primary_s: float = V.PRIMARY_MIN_S, depth: float = V.NADIR_DEPTH,
    cols: InventoryColumns = INVENTORY,
) -> DataFrame:
    """Per QC-passing row and window: 1 when the row is primary under that window.

    The windows ride along as one short array looked up once, not as a joined table.
    """
    packed = cut_lineage(windows).agg(F.array_sort(F.collect_list(F.struct("window_no", "window_name", "lower_s", "upper_s"))).alias("_w"))
    base = with_scalars(inv.where(cols.qc_valid), packed)
    offset = F.col(cols.offset)
    hit = (
        at_least(F.col(cols.duration), primary_s) & (F.col(cols.depth) < depth) & measured(offset)
        & (offset >= F.col("lower_s")) & (offset <= F.col("upper_s")) & F.col(cols.recovered)
    )
    return base.select(cols.subject, cols.duration, cols.depth, cols.offset, cols.recovered, F.inline("_w")).select(
        cols.subject, "window_no", "window_name", "lower_s", "upper_s",
        F.coalesce(hit, F.lit(False)).cast("int").alias("is_primary"),
    )


def held_out_yields(
    indicators: DataFrame, replicates: int = 10_000, seed: int = V.SEED, cols: InventoryColumns = INVENTORY
) -> DataFrame:
    """Events, subjects, evaluable rows and the rate with its cluster interval, per window."""
    by = ["window_no", "window_name", "lower_s", "upper_s"]
    # Rows shrink to one per (window, subject); counts and bootstrap both start from there.
    per_subject = cut_lineage(indicators.groupBy(*by, cols.subject).agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_primary").alias("k")
    ))
    counts = per_subject.groupBy(*by).agg(
        F.sum("k").alias("n_events_primary_heldout"), F.count_if(F.col("k") > 0).alias("n_patients_primary_heldout"),
        F.sum("n").alias("n_evaluable_qc_pass_heldout"),
    )
    # Every window holds the same subjects, so all windows are metrics of one set of draws. Windows are few by nature.
    numbers = [r["window_no"] for r in counts.select("window_no").orderBy("window_no").collect()]
    side = lambda i, c: F.sum(F.when(F.col("window_no") == i, F.col(c)).otherwise(0)).alias(f"{c}{i}")
    wide = per_subject.groupBy(cols.subject).agg(*[side(i, c) for i in numbers for c in ("k", "n")])
    rate = ratio_intervals(wide, cols.subject, {str(i): (F.col(f"k{i}"), F.col(f"n{i}")) for i in numbers}, (), replicates, seed)
    rate = rate.select(F.col("metric").cast("int").alias("window_no"), "point", "ci_low", "ci_high")
    return counts.join(F.broadcast(rate), "window_no").select(
        *by, "n_events_primary_heldout", "n_patients_primary_heldout", "n_evaluable_qc_pass_heldout",
        F.col("point").alias("primary_rate_per_evaluable_heldout"), "ci_low", "ci_high",
    )


def split_half_table(calibration: DataFrame, held_out: DataFrame) -> DataFrame:
    """Held-out rows with the calibration median and spread beside them."""
    return with_scalars(held_out, calibration.select(
        F.col("median_s").alias("calibration_median_s"), F.col("iqr_s").alias("calibration_iqr_s")
    ))
