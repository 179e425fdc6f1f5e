"""Incremental work: skip finished keys, resume from a checkpoint log, guard its settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work rows whose keys are not materialised yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def resume(pool: DataFrame, checkpoint: DataFrame, key: str = "row_id") -> DataFrame:
    """Pool rows still to do; finished ones are those with a key in the checkpoint log."""
    done = checkpoint.select(F.col(key).cast(pool.schema[key].dataType).alias(key)).where(F.col(key).isNotNull())
    return pool.join(done, key, "left_anti")


def finish_log(checkpoint: DataFrame, fresh: DataFrame) -> DataFrame:
    """Final log: everything resumed from plus everything newly done."""
    return checkpoint.unionByName(fresh)


def incompatible_settings(checkpoint: DataFrame, expected: Mapping[str, object]) -> DataFrame:
    """`setting, expected, n_conflicts`: rows whose recorded setting differs, compared as text; NULL agrees."""
    row = checkpoint.agg(*[
        F.count_if(F.col(k).isNotNull() & (F.col(k).cast("string") != str(v))).alias(k) for k, v in expected.items()
    ])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("setting"), F.lit(str(v)).alias("expected"), F.col(k).alias("n_conflicts"))
        for k, v in expected.items()
    ])))


def require_compatible(checkpoint: DataFrame, expected: Mapping[str, object]) -> DataFrame:
    """The checkpoint itself, or an error naming every setting it was made with differently."""
    bad = [r["setting"] for r in incompatible_settings(checkpoint, expected).where("n_conflicts > 0").collect()]
    if bad:
        raise ValueError(f"checkpoint was made with other settings: {bad}")
    return checkpoint
