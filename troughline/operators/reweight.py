"""Inverse-probability weights, coverage of a sampling frame and weighted metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.operators.bootstrap import ratio_intervals
from troughline.operators.rating import METRICS, metric_indicators


def stratum_weights(universe: DataFrame, sample: DataFrame, stratum: str = "stratum") -> DataFrame:
    """`stratum, universe, sampled, weight` from a frame and the cards drawn from it.

    A stratum without a sampled card, or sampled beyond its universe, fails the job.
    """
    u = universe.groupBy(stratum).agg(F.count(F.lit(1)).alias("universe"))
    s = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("sampled"))
    both = u.join(s, stratum, "full").fillna(0, ["universe", "sampled"])
    return weigh(both, stratum)


def weigh(strata: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Add `weight = universe / sampled`, refusing degenerate strata."""
    bad = lambda text: F.raise_error(F.concat(F.lit("stratum "), F.col(stratum), F.lit(text))).cast("double")
    weight = (
        F.when(F.col("sampled") <= 0, bad(": sampled must be positive"))
        .when(F.col("universe") < F.col("sampled"), bad(": universe smaller than sample"))
        .otherwise(F.try_divide(F.col("universe").cast("double"), F.col("sampled").cast("double")))
    )
    return strata.withColumn("weight", weight)


def assign_weights(cards: DataFrame, weights: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Weight per card; a card of an unknown stratum fails the job.

    The lookup has one row per stratum, so Spark's own size check broadcasts it.
    """
    joined = cards.join(weights.select(stratum, "weight"), stratum, "left")
    unknown = F.raise_error(F.concat(F.lit("no weight for stratum "), F.coalesce(F.col(stratum), F.lit("NULL"))))
    return joined.withColumn(
        "weight", F.when(F.col("weight").isNotNull(), F.col("weight")).otherwise(unknown.cast("double"))
    )


def partition_coverage(weights: DataFrame, evaluable: int | Column | DataFrame, uncovered_label: str = "") -> DataFrame:
    """Reconciliation rows: every stratum, the uncovered remainder, the covered share.

    `evaluable` is the population size, or a one-row, one-column table of it.
    """
    from troughline.session import with_scalars

    covered = weights.agg(F.sum("universe").alias("covered"))
    if isinstance(evaluable, DataFrame):
        total = with_scalars(covered, evaluable.toDF("evaluable"))
    else:
        total = covered.withColumn("evaluable", F.lit(evaluable).cast("bigint"))
    wrong = (
        F.when(F.col("evaluable") <= 0, F.raise_error(F.lit("evaluable population must be positive")).cast("bigint"))
        .when(F.col("covered") > F.col("evaluable"), F.raise_error(F.lit("strata exceed the evaluable population")).cast("bigint"))
        .otherwise(F.col("evaluable"))
    )
    total = total.withColumn("evaluable", wrong)
    extra = total.select(F.inline(F.array(
        F.struct(
            F.lit("uncovered_remainder").alias("row_kind"), F.lit(uncovered_label).alias("name"),
            (F.col("evaluable") - F.col("covered")).alias("universe"), F.lit(0).cast("bigint").alias("sampled"),
            F.lit(None).cast("double").alias("weight"),
        ),
        F.struct(
            F.lit("coverage").alias("row_kind"), F.lit("covered / evaluable").alias("name"), F.col("covered").alias("universe"),
            F.col("evaluable").alias("sampled"), (F.col("covered") / F.col("evaluable")).alias("weight"),
        ),
    )))
    rows = weights.select(F.lit("stratum").alias("row_kind"), F.col(weights.columns[0]).alias("name"), "universe", "sampled", "weight")
    return rows.unionByName(extra)


def _weighted(long: DataFrame) -> dict[str, tuple[Column, Column]]:
    call = F.when(F.col("parsed_ok"), F.col("predictor_call")).otherwise(F.lit(V.PARSE_FAILURE))
    plain = metric_indicators(F.col("reference_call"), call)
    return {m: (F.col("weight") * n, F.col("weight") * d) for m, (n, d) in plain.items()}


def weighted_metrics(long: DataFrame, by: Sequence[str] = ("predictor",)) -> DataFrame:
    """Horvitz-Thompson ratio per metric: `sum(w*num) / sum(w*den)`, NULL on a zero denominator."""
    parts = _weighted(long)
    sums = long.groupBy(*by).agg(*[F.sum(p[k]).alias(f"_{a}{m}") for m, p in parts.items() for k, a in enumerate("xy")])
    return sums.select(*by, F.inline(F.array(*[
        F.struct(
            F.lit(m).alias("metric"), F.try_divide(F.col(f"_x{m}"), F.col(f"_y{m}")).alias("point"),
            F.col(f"_y{m}").alias("weighted_denominator"),
        ) for m in METRICS
    ])))


def weighted_intervals(
    long: DataFrame, cluster: str, by: Sequence[str] = ("predictor",), replicates: int = 5_000, seed: int = V.SEED,
) -> DataFrame:
    """Weighted metrics with intervals over every cluster of the sample: the population table."""
    call = F.when(F.col("parsed_ok"), F.col("predictor_call")).otherwise(F.lit(V.PARSE_FAILURE))
    plain = metric_indicators(F.col("reference_call"), call)
    ci = ratio_intervals(long, cluster, _weighted(long), by, replicates, seed)
    cards = long.groupBy(*by).agg(*[F.sum(plain[m][1]).cast("bigint").alias(m) for m in METRICS])
    cards = cards.select(*by, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("n_eligible_cards")) for m in METRICS
    ])))
    return ci.join(cards, [*by, "metric"]).select(
        *by, "metric", F.lit("population").alias("estimate_kind"), F.col("point").alias("point_estimate"), "ci_low", "ci_high",
        "n_eligible_cards", F.col("denominator").alias("weighted_denominator"),
    )


def sample_and_population(sample_metrics: DataFrame, population: DataFrame) -> DataFrame:
    """Tall union of sample and population estimates; the sample rows carry a typed NULL denominator."""
    rows = sample_metrics.select(
        "predictor", "metric", F.lit("gallery").alias("estimate_kind"), "point_estimate", "ci_low", "ci_high",
        F.col("n_used_for_metric").alias("n_eligible_cards"), F.lit(None).cast("double").alias("weighted_denominator"),
    )
    return rows.unionByName(population)
