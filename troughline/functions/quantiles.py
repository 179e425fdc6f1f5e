"""Exact interpolated quantiles that never hold a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troughline.functions.keys import join_per_group
from troughline.session import cut_lineage, with_scalars

# Sketch size. Groups up to this many rows are bracketed by their own extremes; larger ones
# by sketch quantiles set wide enough to contain the wanted rank.
_ACCURACY = 10_000
_MARGIN = 4.0 / _ACCURACY
# Brackets up to this many (about 30 MB) are broadcast.
_FEW = 500_000


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), out: str = "q"
) -> DataFrame:
    """Linear-interpolated quantiles per group: `by..., n, <out>0, <out>1, ...`.

    1. A mergeable sketch brackets each wanted rank (partial aggregates, no skew).
    2. Rows meet their bracket by broadcast (salted by value where the groups are too many for that), are
       dropped above it and counted below it before any of them moves; only values inside are
       shuffled, as counts, and ordered.
    """
    by = list(by)
    probs = [float(p) for p in probs]
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *by, F.col(value).cast("double").alias("_v")
    )
    edges = [e for p in probs for e in (max(0.0, p - _MARGIN), min(1.0, p + _MARGIN))]
    sketch = rows.groupBy(*by).agg(
        F.count("_v").alias("n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", edges, _ACCURACY).alias("_e"),
    )
    small = F.col("n") <= _ACCURACY
    brackets = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            F.lit(p).alias("p"),
            F.when(small, F.col("_min")).otherwise(F.col("_e")[2 * i]).alias("lo"),
            F.when(small, F.col("_max")).otherwise(F.col("_e")[2 * i + 1]).alias("hi"),
        )
        for i, p in enumerate(probs)
    ])
    sketch = sketch.select(*by, "n", brackets.alias("_brackets"))

    if by:
        # One row per group, read twice: written once, and small enough to know its size.
        sketch = cut_lineage(sketch)
        if sketch.count() * len(probs) <= _FEW:
            joined = rows.join(F.broadcast(sketch), by)
        else:
            joined = join_per_group(rows, sketch, by, F.col("_v"), size="n").drop("_salt")
    else:
        joined = with_scalars(rows, sketch)
    # Rows meet their bracket where they are: what lies below it is one count per task, what lies above is gone.
    inside = (
        joined.select(*by, "_v", "n", F.explode("_brackets").alias("_k"))
        .where(F.col("_v") <= F.col("_k.hi"))
        .select(
            *by, "n", F.col("_k.i").alias("_i"), F.col("_k.p").alias("_p"),
            F.when(F.col("_v") >= F.col("_k.lo"), F.col("_v")).alias("_v"),
        )
        .groupBy(*by, "n", "_i", "_p", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = Window.partitionBy(*by, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    rank = F.col("_p") * (F.col("n") - 1)
    ranked = inside.withColumn("_cum", F.sum("_c").over(upto)).withColumn("_rank", rank)
    at_floor = F.min(F.when(F.col("_cum") > F.floor("_rank"), F.col("_v")))
    at_ceil = F.min(F.when(F.col("_cum") > F.ceil("_rank"), F.col("_v")))
    per_prob = ranked.groupBy(*by, "n", "_i", "_rank").agg(at_floor.alias("_a"), at_ceil.alias("_z"))
    interpolated = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_rank") - F.floor("_rank"))
    return per_prob.groupBy(*by, "n").agg(
        *[F.max(F.when(F.col("_i") == i, interpolated)).alias(f"{out}{i}") for i in range(len(probs))]
    )


# Value cells per factor of e. Cells follow the logarithm, so they fit values of any scale.
_PER_E = 256
_SCALE = 1e6


def value_cell(v: Column) -> Column:
    """Cell of a value; never falls as the value rises, so ranks can be found among cells first."""
    return (F.signum(v) * F.floor(F.log1p(F.abs(v) * _SCALE) * _PER_E)).cast("bigint")


def binned_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), out: str = "q", weight: str | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per group of many rows: `by..., n, <out>0, ...`; equal to those of `exact_quantiles`.

    Rows are counted per value cell (a whole-stage aggregate without sketches), which tells the one or two cells that hold
    each rank. In a second reading only rows of those cells are counted by value and ordered. `weight` names
    a whole number that says how often a row counts.
    """
    by, probs = list(by), [float(p) for p in probs]
    w = F.col(weight) if weight else F.lit(1)
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"), w.cast("bigint").alias("_w"), value_cell(v).alias("_b"))
    wanted, few = wanted_cells(rows.groupBy(*by, "_b").agg(F.sum("_w").alias("_c")), probs, by)
    inside = rows.join(F.broadcast(wanted) if few else wanted, [*by, "_b"])
    return of_wanted_cells(inside.groupBy(*by, "n", "_b", "_before", "_v").agg(F.sum("_w").alias("_c")), probs, by, out)


def _ranks(probs: Sequence[float]) -> list[Column]:
    return [F.lit(p) * (F.col("n") - 1) for p in probs]


def wanted_cells(counts: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> tuple[DataFrame, bool]:
    """From rows per cell (`by..., _b, _c`) the one or two cells that hold each rank: `by..., _b, n, _before`; and whether they are few."""
    cells = cut_lineage(counts.where("_c > 0"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    upto = F.sum("_c").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    placed = cells.withColumns({"_upto": upto, "n": F.sum("_c").over(group)}).withColumn("_before", F.col("_upto") - F.col("_c"))
    holds = F.lit(False)
    for rank in _ranks(probs):
        for edge in (F.floor(rank), F.ceil(rank)):
            holds = holds | ((F.col("_before") <= edge) & (edge < F.col("_upto")))
    wanted = cut_lineage(placed.where(holds).select(*by, "_b", "n", "_before"))
    # At most two cells a quantile and group; counted before they are sent to every task.
    return wanted, wanted.count() <= _FEW


def of_wanted_cells(inside: DataFrame, probs: Sequence[float], by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """The quantiles from the values of wanted cells and their counts (`by..., n, _b, _before, _v, _c`)."""
    ranks = _ranks(probs)
    within = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = inside.withColumn("_cum", F.col("_before") + F.sum("_c").over(within)).withColumn("_from", F.col("_cum") - F.col("_c"))
    at = lambda edge: F.max(F.when((F.col("_from") <= edge) & (edge < F.col("_cum")), F.col("_v")))
    found = ordered.groupBy(*by, "n").agg(
        *[at(F.floor(r)).alias(f"_a{i}") for i, r in enumerate(ranks)], *[at(F.ceil(r)).alias(f"_z{i}") for i, r in enumerate(ranks)]
    )
    return found.select(*by, "n", *[
        (F.col(f"_a{i}") + (F.col(f"_z{i}") - F.col(f"_a{i}")) * (r - F.floor(r))).alias(f"{out}{i}") for i, r in enumerate(ranks)
    ])
