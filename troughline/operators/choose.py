"""Picking typical rows: z-scores, distance to medians and centroids, representatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.functions.keys import hash_order, join_per_group
from troughline.functions.labels import measured
from troughline.functions.quantiles import exact_quantiles
from troughline.session import cut_lineage, with_scalars


def _finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(measured(c.cast("double")), c.cast("double"))


def _moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    sd = lambda f: F.stddev_pop(_finite(f))
    return df.agg(
        *[F.avg(_finite(f)).alias(f"_m_{f}") for f in features],
        *[F.when(sd(f) > 0, sd(f)).otherwise(1.0).alias(f"_s_{f}") for f in features],
    )


def zscores(df: DataFrame, features: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Add population z-scores (population sd; a zero or undefined sd counts as 1)."""
    scaled = with_scalars(df, _moments(df, features))
    return scaled.select(
        *df.columns, *[((_finite(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}")).alias(f"{prefix}{f}") for f in features]
    )


def rank_near_median(df: DataFrame, features: Sequence[str], keys: Sequence[str], out: str = "dist") -> DataFrame:
    """Rows by standardized Euclidean distance to the feature medians, nearest first."""
    scaled = with_scalars(df, _moments(df, features))
    total = F.lit(0.0)
    for i, f in enumerate(features):
        scaled = with_scalars(scaled, exact_quantiles(df, f, [0.5]).select(F.col("q0").alias(f"_q_{f}")))
    for f in features:
        gap = (_finite(f) - F.col(f"_q_{f}")) / F.col(f"_s_{f}")
        total = total + gap * gap
    return scaled.withColumn(out, F.sqrt(total)).select(*df.columns, out).orderBy(out, *keys)


def confidence_rank(c: Column) -> Column:
    rank = F.lit(len(V.CONFIDENCE_RANK))
    for word, i in V.CONFIDENCE_RANK.items():
        rank = F.when(c == word, F.lit(i)).otherwise(rank)
    return rank


def top_per_category(
    df: DataFrame, category: str, features: Sequence[str], key: str, n: int, confidence: str | None = None, seed: int = V.SEED,
) -> DataFrame:
    """The `n` most typical rows per category: confidence, then distance to its centroid, then a seeded key.

    Features are z-scored over all of `df`, so scaling does not depend on the category. The
    centroid averages rows with every feature present; a missing feature adds no distance.
    Rows outside every category (NULL) are ignored. `row_number() <= n` is cut in every task
    before rows move, so a category holding a third of the table ships `n` rows per task.
    """
    z = zscores(df, features, "_z_").where(F.col(category).isNotNull())
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f"_z_{f}").isNotNull()
    centre = z.groupBy(category).agg(*[
        F.coalesce(F.avg(F.when(whole, F.col(f"_z_{f}"))), F.lit(0.0)).alias(f"_c_{f}") for f in features
    ], F.count(F.lit(1)).alias("_rows"))
    joined = join_per_group(z, cut_lineage(centre), [category], F.col(key), size="_rows")
    total = F.lit(0.0)
    for f in features:
        gap = F.col(f"_z_{f}") - F.col(f"_c_{f}")
        total = total + F.coalesce(gap * gap, F.lit(0.0))
    rank = confidence_rank(F.col(confidence)) if confidence else F.lit(0)
    order = Window.partitionBy(category).orderBy("_rank", F.round("_dist", 9), hash_order([key], seed), key)
    return (
        joined.withColumn("_dist", F.sqrt(total)).withColumn("_rank", rank)
        .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
        .select(*df.columns, (F.col("_n") - 1).alias("panel_index"), F.round("_dist", 6).alias("centroid_distance"))
    )


def representative_per_group(
    df: DataFrame, group: str, value: str, keys: Sequence[str], carry: Sequence[str] = (), seed: int = V.SEED
) -> DataFrame:
    """Per group its row nearest the group median, with the group size: `min` of an ordering struct, no sort."""
    medians = cut_lineage(exact_quantiles(df, value, [0.5], [group]).select(group, F.col("q0").alias("median_value"), F.col("n").alias("_rows")))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    names = list(dict.fromkeys([*keys, value, *carry]))
    told = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    near = join_per_group(told, medians, [group], F.struct(*keys), size="_rows")
    order = F.struct(
        F.round(F.abs(F.col(value) - F.col("median_value")), 9).alias("gap"), hash_order([*keys], seed).alias("tie"),
        *[F.col(c) for c in names],
    )
    # Once per salt, then over the few winners: a hot group is never read by one task.
    per_salt = near.groupBy(group, "median_value", "_salt").agg(F.min(order).alias("_m"))
    best = per_salt.groupBy(group, "median_value").agg(F.min("_m").alias("_m"))
    picked = best.select(group, "median_value", *[F.col(f"_m.{c}").alias(c) for c in names if c != group])
    return picked.join(sizes, group).orderBy(F.desc("n_rows"), group)
