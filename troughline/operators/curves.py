"""Landmark curves: reconstruction on a grid, pointwise quantiles, density, tile geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troughline.functions.quantiles import binned_quantiles
from troughline.schema import INVENTORY, InventoryColumns
from troughline.session import with_scalars

# Curve grid, display band and bins.
T_MIN, T_MAX, N_T = -10.0, 60.0, 561
Y_MIN, Y_MAX, N_Y = 0.70, 1.70, 200
MIN_SEGMENT = 1e-6
MIN_SHARE = 0.40


def landmark_curve(
    df: DataFrame, keys: list[str], cols: InventoryColumns = INVENTORY, t_min: float = T_MIN, t_max: float = T_MAX, n_t: int = N_T
) -> DataFrame:
    """Piecewise-linear curve baseline -> nadir -> recovery on the common grid, one row per grid point.

    Points past a row's last landmark are left out rather than extrapolated. The nadir level is
    `depth` itself (value over baseline).
    """
    step = (t_max - t_min) / (n_t - 1)
    p2 = F.greatest(F.col(cols.descent), F.lit(MIN_SEGMENT))
    p3 = F.greatest(F.col(cols.duration), F.lit(MIN_SEGMENT))
    grid = F.explode(F.sequence(F.lit(0), F.lit(n_t - 1))).alias("ti")
    low, end = F.col(cols.depth), F.col(cols.recovery)
    value = (
        F.when(F.col("t") <= 0, F.lit(1.0))
        .when(F.col("t") <= F.col("_p2"), 1.0 + (low - 1.0) * (F.col("t") / F.col("_p2")))
        .otherwise(low + (end - low) * ((F.col("t") - F.col("_p2")) / F.col("_p3")))
    )
    return (
        df.select(*keys, low, end, p2.alias("_p2"), p3.alias("_p3"), grid)
        .withColumn("t", F.lit(t_min) + F.col("ti") * F.lit(step))
        .where(F.col("t") <= F.col("_p2") + F.col("_p3"))
        .select(*keys, "ti", "t", value.alias("y"))
    )


def distinct_curves(df: DataFrame, cols: InventoryColumns = INVENTORY, out: str = "copies") -> DataFrame:
    """The landmarks that make a curve, once for all rows that share them, and the number of those rows."""
    return df.groupBy(cols.depth, cols.recovery, cols.descent, cols.duration).agg(F.count(F.lit(1)).alias(out))


def curve_quantiles(curve: DataFrame, n_rows: DataFrame, min_share: float = MIN_SHARE, weight: str | None = None) -> DataFrame:
    """Median and quartiles per grid point, kept where at least `min_share` of all rows contribute.

    `n_rows` is the one-row count of all curves; `weight` names a whole number that says how many rows a curve stands for.
    """
    q = binned_quantiles(curve, "y", [0.25, 0.5, 0.75], ["ti", "t"], weight=weight)
    total = n_rows.toDF("_rows")
    return with_scalars(q, total).where(F.col("n") >= min_share * F.col("_rows")).select(
        "ti", "t", "n", F.col("q1").alias("median"), F.col("q0").alias("q25"), F.col("q2").alias("q75")
    )


def density(curve: DataFrame, y_min: float = Y_MIN, y_max: float = Y_MAX, n_y: int = N_Y) -> DataFrame:
    """Counts over the (time, value) grid, edges clipped, scaled to the fullest cell."""
    raw = F.floor((F.col("y") - y_min) / F.lit((y_max - y_min) / n_y))
    yi = F.greatest(F.lit(0), F.least(F.lit(n_y - 1), raw)).cast("int")
    counts = curve.groupBy("ti", yi.alias("yi")).agg(F.count(F.lit(1)).alias("n"))
    peak = counts.agg(F.max("n").alias("_peak"))
    return with_scalars(counts, peak).select("ti", "yi", "n", (F.col("n") / F.col("_peak")).alias("density"))


def tile_geometry(df: DataFrame, keys: list[str], cols: InventoryColumns = INVENTORY, baseline_pct: float = 100.0) -> DataFrame:
    """Four landmarks per row in percent of baseline: start, onset, nadir, end."""
    p2, p3 = F.col(cols.descent), F.col(cols.duration)
    lead = F.greatest(F.lit(4.0), 0.18 * (p2 + p3))
    point = lambda i, t, y: F.struct(F.lit(i).alias("point"), t.alias("t_s"), y.alias("pct"))
    flat = F.lit(float(baseline_pct))
    return df.select(*keys, F.inline(F.array(
        point(0, F.lit(0.0), flat), point(1, lead, flat), point(2, lead + p2, F.col(cols.depth) * 100.0),
        point(3, lead + p2 + p3, F.col(cols.recovery) * 100.0),
    )))
