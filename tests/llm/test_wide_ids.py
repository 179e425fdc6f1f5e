"""Ids of any span, and the spread of the mix's index permutations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from troughline.llm import mixing, spotsigs
from troughline.llm.common import id_ranges

LOW, HIGH = -(1 << 63), (1 << 63) - 1
SPANS = {
    "hashed": [int(x) for x in np.random.default_rng(2).integers(LOW, HIGH, 300)] + [LOW, HIGH, HIGH - 1],
    "outlier": [*range(500), 10**15], "negative": [*range(-40, 40)], "one": [7], "same": [3] * 20,
}


@pytest.mark.parametrize("name", SPANS)
def test_ranges_rise_with_the_id_and_stay_even(spark, name):
    ids = SPANS[name]
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "id long")
    out = df.select("id", id_ranges(df, "id", len(ids), 20).alias("r")).collect()
    assert [r.r for r in out if r.id is None] == [None]
    known = sorted((r.id, r.r) for r in out if r.id is not None)
    numbers = [r for _, r in known]
    assert numbers == sorted(numbers) and numbers[0] >= 0
    if name != "same":
        assert max(np.unique(numbers, return_counts=True)[1]) <= 60


@pytest.mark.parametrize("name", ["hashed", "outlier", "negative"])
def test_neighbours_of_any_ids(spark, name):
    ids = SPANS[name]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.id: r.next_t for r in spotsigs.with_next(df, "doc_id", "text", 20).collect()}
    down = sorted(ids, reverse=True)
    assert got == {i: f"t{down[(n + 1) % len(down)]}" for n, i in enumerate(down)}


@pytest.mark.parametrize("name", ["hashed", "outlier"])
def test_mix_of_any_ids(spark, name):
    ids = SPANS[name]
    df = spark.createDataFrame([(i, "w " * (n % 7), "s") for n, i in enumerate(ids)], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(ids) and sum(r.taken for r in rows) == pytest.approx(rows[0].target, abs=mixing.BLOCK)


@pytest.mark.parametrize("n", [256, 1000, 1024])
def test_permuted_blocks_are_spread(spark, n):
    """The first eight tenths of the slots must leave out blocks all over, in short stretches, and differ by source."""
    seen = []
    for src in range(3):
        got = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(src).cast("long")).alias("b")).collect()
        order = [r.b for r in sorted(got)]
        seen.append(order)
        out = np.sort(order[int(0.8 * n):])
        gaps = np.diff(out)
        assert np.bincount(out * 8 // n, minlength=8).min() >= len(out) // 20
        longest = max(len(run) for run in np.split(out, np.flatnonzero(gaps > 1) + 1))
        assert longest <= 10
        assert abs(np.corrcoef(order, range(n))[0, 1]) < 0.2
    assert seen[0] != seen[1] != seen[2]
