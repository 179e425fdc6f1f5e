"""Cluster bootstrap intervals as joins and aggregates.

Rows collapse to per-cluster sums first. Replicate draws are named by (replicate, slot) and
picked by an integer mix, so they depend on neither partitioning nor order and a lost task redraws the same.
Nothing is sampled on the driver: each task draws a block of replicates over arrays of the cluster sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from troughline import vocabulary as V
from troughline.functions.keys import SLOT_FACTORS, SLOT_PRIME, hash_position, mixed_slot
from troughline.functions.quantiles import binned_quantiles, of_wanted_cells, value_cell, wanted_cells
from troughline.session import cut_lineage, with_scalars


#: Clusters in one row of arrays.
CHUNK = 1 << 15
#: Numbers (8 bytes each) of cluster sums that a task holds; of longer tables it holds one range of clusters after the other.
HELD_VALUES = 1 << 24
#: Slots whose draws are counted at once, and of those the ones drawn at once, which stay in a core's cache.
SLOTS, AT_ONCE = 1 << 22, 1 << 14
#: Draws worth a task of their own, and the most tasks: each reads the cluster sums once.
TASK_DRAWS, TASKS = 5_000_000, 96


def _check(replicates: int, confidence: float) -> tuple[float, float]:
    if not isinstance(replicates, int) or replicates < 1:
        raise ValueError(f"need at least one replicate as an int, not {replicates!r}")
    if not 0.0 < confidence < 1.0:
        raise ValueError(f"confidence lies between 0 and 1, not {confidence!r}")
    tail = (1.0 - confidence) / 2.0
    return tail, 1.0 - tail


def cluster_draws(
    clusters: DataFrame, cluster: str, replicates: int, seed: int, by: Sequence[str] = ()
) -> DataFrame:
    """Multiplicity of every drawn cluster per replicate: `by..., rep, cluster, m`.

    `clusters` holds one row per (by, cluster). Groups over the same clusters get the same draws.
    """
    by = list(by)
    numbered = hash_position(clusters.select(*by, cluster), [cluster], seed, by, "pos", "n_clusters")
    drawn = _picks(numbered, replicates, seed, by).groupBy(*by, "rep", "pick").agg(F.count(F.lit(1)).alias("m"))
    return drawn.join(numbered.select(*by, F.col("pos").alias("pick"), cluster), [*by, "pick"]).drop("pick")


def _picks(numbered: DataFrame, replicates: int, seed: int, by: Sequence[str]) -> DataFrame:
    """As many draws per replicate as there are clusters: every cluster row is one slot.

    The cluster table is small in bytes but each row stands for `replicates` draws, so rows are
    first repeated per block of replicates and spread over all cores by number (which adaptive
    execution does not merge back), then expanded.
    """
    # Not the cores known now, which an idle cluster has few of.
    spark = numbered.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = max(1, -(-replicates // 64))
    blocks = numbered.select(*by, "pos", "n_clusters").withColumn(
        "_from", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(block)))
    ).repartition(cores, "pos", "_from")
    reps = blocks.withColumn(
        "rep", F.explode(F.sequence("_from", F.least(F.lit(replicates - 1), F.col("_from") + (block - 1))))
    )
    return reps.select(*by, "rep", mixed_slot(F.col("n_clusters"), F.col("rep"), F.col("pos"), seed).alias("pick"))


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """x %= SLOT_PRIME in place, for x below 2^62: the prime is 2^31 - 1, so halves of 31 bits add up."""
    for _ in range(2):
        np.right_shift(x, 31, out=spare)
        np.bitwise_and(x, SLOT_PRIME, out=x)
        np.add(x, spare, out=x)
    np.subtract(x, SLOT_PRIME, out=spare)  # below the prime this wraps to a large number
    np.minimum(x, spare, out=x)


def slot_bases(start: int, end: int, seed: int) -> list[np.ndarray]:
    """The part of `drawn_slots` that all replicates share, for positions from `start` to below `end`."""
    pos = np.arange(start, end, dtype=np.uint64) % SLOT_PRIME
    return [((pos * (per_pos % SLOT_PRIME) + seed % SLOT_PRIME) % SLOT_PRIME).astype(np.uint32) for _, per_pos, _, _ in SLOT_FACTORS]


def drawn_slots(n: int, rep: int, bases: Sequence[np.ndarray]) -> np.ndarray:
    """`mixed_slot` of one replicate for the positions of `slot_bases`."""
    out = None
    for base, (per_rep, _, first, second) in zip(bases, SLOT_FACTORS):
        u = base + np.uint64(rep * per_rep % SLOT_PRIME)
        spare = np.empty_like(u)
        _fold(u, spare)
        for shift, factor in ((15, first), (13, second)):
            np.right_shift(u, shift, out=spare)
            np.bitwise_xor(u, spare, out=u)
            np.multiply(u, factor, out=u)
            _fold(u, spare)
        np.right_shift(u, 16, out=spare)
        np.bitwise_xor(u, spare, out=u)
        np.subtract(u, SLOT_PRIME, out=spare)
        np.minimum(u, spare, out=u)
        out = u if out is None else out * SLOT_PRIME + u
    return (out - out // n * n).view(np.int64)


def _add_draws(sums: np.ndarray, met: np.ndarray, reps: range, n: int, low: int, columns: Sequence[np.ma.MaskedArray], seed: int) -> None:
    """Add to each replicate what its draws among the clusters from `low` on hold in each column; `met` counts those not NULL."""
    size = len(columns[0])
    known = [(~np.ma.getmaskarray(c)).astype(float) if np.ma.is_masked(c) else None for c in columns]
    values = [c.filled(0.0) for c in columns]
    finite = [bool(np.isfinite(v).all()) for v in values]
    for start in range(0, n, SLOTS):
        end = min(n, start + SLOTS)
        bases, picks = slot_bases(start, end, seed), np.empty(end - start, np.int64)
        for i, rep in enumerate(reps):
            for at in range(0, end - start, AT_ONCE):
                picks[at:at + AT_ONCE] = drawn_slots(n, rep, [b[at:at + AT_ONCE] for b in bases])
            own = picks if size == n else picks[(picks >= low) & (picks < low + size)] - low
            times = np.bincount(own, minlength=size).astype(float)
            for j, v in enumerate(values):
                sums[i, j] += times @ v if finite[j] else v[own].sum()
                met[i, j] += len(own) if known[j] is None else times @ known[j]


def _replicate_sums(numbered: DataFrame, by: Sequence[str], stats: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """`by..., rep, stats...`: sums over as many draws per replicate as a group has clusters.

    Clusters (`pos`, `n_clusters`, `stats`) travel as arrays, once for each block of replicates. A task holds one range of a
    group's clusters at a time; where there are more, its draws are made again for each range.
    """
    width = len(stats)
    chunks = numbered.groupBy(*by, "n_clusters", F.floor(F.col("pos") / CHUNK).alias("_chunk")).agg(
        F.array_sort(F.collect_list(F.struct("pos", *stats))).alias("_rows")
    ).select(*by, "n_clusters", "_chunk", *[F.col(f"_rows.{c}").alias(c) for c in stats])
    tasks = max(1, min(TASKS, replicates, -(-numbered.count() * replicates // TASK_DRAWS)))
    block = -(-replicates // tasks)
    dealt = chunks.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // block) - 1))))
    dealt = dealt.repartitionById(tasks, "_task").sortWithinPartitions(*by, "_chunk")
    kept = [dealt.schema[c] for c in by]
    schema = T.StructType([*kept, T.StructField("rep", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in stats]])
    held = max(CHUNK, HELD_VALUES // width // CHUNK * CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, low, kinds = None, [], 0, {}

        def spend() -> None:
            nonlocal parts, low
            columns = [np.ma.concatenate(p) for p in zip(*parts)]
            _add_draws(sums, met, reps, n, low, columns, seed)
            parts, low = [], low + len(columns[0])

        def done() -> pa.RecordBatch:
            if parts:
                spend()
            whole = [np.ma.MaskedArray(sums[:, j], met[:, j] == 0) for j in range(width)]
            arrays = [pa.array([g] * len(reps), kinds[c]) for c, g in zip(by, group)]
            return pa.RecordBatch.from_arrays(
                [*arrays, pa.array(reps, pa.int32()), *[pa.array(w.data, mask=np.ma.getmaskarray(w)) for w in whole]], names=[*by, "rep", *stats],
            )

        for batch in batches:
            kinds = {c: batch.schema.field(c).type for c in by}
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for i in range(batch.num_rows):
                own = tuple(cols[c][i].as_py() for c in by)
                if group != own:
                    if group is not None:
                        yield done()
                    task, n = cols["_task"][i].as_py(), cols["n_clusters"][i].as_py()
                    reps = range(task * block, min(replicates, (task + 1) * block))
                    group, parts, low = own, [], 0
                    sums, met = np.zeros((len(reps), width)), np.zeros((len(reps), width))
                row = [cols[c][i].values for c in stats]
                parts.append([np.ma.MaskedArray(v.fill_null(0.0).to_numpy(zero_copy_only=False), v.is_null().to_numpy(zero_copy_only=False)) for v in row])
                if sum(len(p[0]) for p in parts) >= held:
                    spend()
        if group is not None:
            yield done()

    return dealt.mapInArrow(run, schema)


def ratio_intervals(
    df: DataFrame,
    cluster: str,
    metrics: Mapping[str, tuple[Column, Column]],
    by: Sequence[str] = (),
    replicates: int = 5_000,
    seed: int = V.SEED,
    confidence: float = 0.95,
) -> DataFrame:
    """Cluster percentile interval of every `sum(num) / sum(den)`: `by..., metric, point, ci_low, ci_high, ...`.

    All metrics of a group share one set of draws. Undefined replicates (zero denominator) are
    left out and counted. With one cluster the interval is the point; with a zero denominator
    everything is NULL. A mean is the ratio (value, 1).
    """
    tails = _check(replicates, confidence)
    by, names = list(by), list(metrics)
    sums = df.groupBy(*by, F.col(cluster).alias("_cluster")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(metrics[m][0].cast("double")).alias(f"_x{i}") for i, m in enumerate(names)],
        *[F.sum(metrics[m][1].cast("double")).alias(f"_y{i}") for i, m in enumerate(names)],
    )
    # One row per cluster from here on: the input is read once, for these sums.
    sums = cut_lineage(sums)
    # Numbered once: the draws come from these rows and are looked up in them.
    numbered = cut_lineage(hash_position(sums, ["_cluster"], seed, by, "pos", "n_clusters"))
    stats = [f"_{a}{i}" for i in range(len(names)) for a in "xy"]
    per_rep = _replicate_sums(numbered, by, stats, replicates, seed)
    ratio = lambda i: F.when(F.col(f"_y{i}") > 0, F.col(f"_x{i}") / F.col(f"_y{i}"))
    # One value per replicate and group: the percentile input is bounded by `replicates`.
    bounds = per_rep.groupBy(*by).agg(
        *[F.percentile(ratio(i), F.array(*[F.lit(q) for q in tails])).alias(f"_ci{i}") for i in range(len(names))],
        *[F.count(ratio(i)).alias(f"_used{i}") for i in range(len(names))],
    )
    totals = sums.groupBy(*by).agg(
        F.sum("_n").alias("n_obs"), F.count(F.lit(1)).alias("n_clusters"), *[F.sum(c).alias(c) for c in stats]
    )
    joined = totals.join(bounds, by) if by else with_scalars(totals, bounds)
    lone = F.col("n_clusters") <= 1
    rows = []
    for i, m in enumerate(names):
        point = ratio(i)
        edge = lambda k, i=i, point=point: F.when(F.col(f"_y{i}") > 0, F.when(lone, point).otherwise(F.col(f"_ci{i}")[k]))
        rows.append(F.struct(
            F.lit(m).alias("metric"), point.alias("point"), edge(0).alias("ci_low"), edge(1).alias("ci_high"),
            F.col(f"_x{i}").alias("numerator"), F.col(f"_y{i}").alias("denominator"),
            F.col(f"_used{i}").alias("n_replicates_used"),
        ))
    return joined.select(*by, "n_obs", "n_clusters", F.inline(F.array(*rows)))


def mean_interval(
    df: DataFrame, value: Column, cluster: str, by: Sequence[str] = (), replicates: int = 10_000,
    seed: int = V.SEED, confidence: float = 0.95,
) -> DataFrame:
    """Cluster bootstrap of a mean (a proportion for 0/1 values)."""
    one = F.when(value.isNotNull(), 1.0).otherwise(0.0)
    return ratio_intervals(df, cluster, {"mean": (value, one)}, by, replicates, seed, confidence).drop("metric")


def _counted(df: DataFrame, value: str, cluster: str, replicates: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows counted by (cluster, value): `_cluster, _v, _k`; the clusters; and the draws: `rep, _cluster, m`."""
    counted = cut_lineage(df.groupBy(F.col(cluster).alias("_cluster"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_k")))
    clusters = counted.select("_cluster").distinct()
    return counted, clusters, cluster_draws(clusters, "_cluster", replicates, seed)


def _of_replicates(per_rep: DataFrame, tails: tuple[float, float], point: DataFrame, counted: DataFrame, clusters: DataFrame) -> DataFrame:
    bounds = per_rep.agg(
        F.percentile("s", F.array(*[F.lit(q) for q in tails])).alias("_ci"), F.count("s").alias("n_replicates_used")
    )
    sizes = counted.agg(F.sum("_k").alias("n_obs"))
    k = clusters.agg(F.count(F.lit(1)).alias("n_clusters"))
    return with_scalars(with_scalars(with_scalars(point, sizes), k), bounds).select(
        "point", F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"), "n_obs", "n_clusters", "n_replicates_used"
    )


def statistic_interval(
    df: DataFrame,
    value: str,
    cluster: str,
    statistic: Callable[[Column, Column], Column],
    replicates: int = 1_000,
    seed: int = V.SEED,
    confidence: float = 0.95,
) -> DataFrame:
    """Cluster bootstrap of any aggregate that takes a value and an integer weight.

    `statistic(value, weight)` returns a Spark aggregate that merges, for example
    `lambda v, w: F.sum(v * w) / F.sum(w)`. Rows are first counted by (cluster, value),
    then weighted by how often a replicate drew their cluster. For quantiles use `quantile_interval`.
    """
    tails = _check(replicates, confidence)
    counted, clusters, draws = _counted(df, value, cluster, replicates, seed)
    weighted = draws.join(counted, "_cluster").select("rep", "_v", (F.col("_k") * F.col("m")).alias("_w"))
    per_rep = weighted.groupBy("rep").agg(statistic(F.col("_v"), F.col("_w")).alias("s"))
    point = counted.agg(statistic(F.col("_v"), F.col("_k")).alias("point"))
    return _of_replicates(per_rep, tails, point, counted, clusters)


def quantile_interval(
    df: DataFrame, value: str, cluster: str, prob: float = 0.5, replicates: int = 1_000, seed: int = V.SEED, confidence: float = 0.95,
) -> DataFrame:
    """Cluster bootstrap of an exact quantile.

    Draws meet each cluster's counts per value cell, of which there are a few thousand however many values there are; that
    tells the one or two cells that hold a replicate's rank. Only the values of those meet the replicate and are ordered.
    NULL and NaN values are left out.
    """
    tails = _check(replicates, confidence)
    v = F.col(value).cast("double")
    counted, clusters, draws = _counted(df.where(v.isNotNull() & ~F.isnan(v)).withColumn("_x", v), "_x", cluster, replicates, seed)
    # Dealt by replicate before each meets thousands of cells: the draws alone are so small that they would stay in one task.
    draws = cut_lineage(draws)
    counted = counted.withColumn("_b", value_cell(F.col("_v")))
    cells = cut_lineage(counted.groupBy("_cluster", "_b").agg(F.sum("_k").alias("_k")))
    drawn = F.sum(F.col("_k") * F.col("m")).alias("_c")
    wanted, few = wanted_cells(draws.repartition(TASKS, "rep").join(cells, "_cluster").groupBy("rep", "_b").agg(drawn), [prob], ["rep"])
    # A replicate's wanted cell is named for each cluster that it drew and that has values there.
    named = draws.repartition(TASKS, "rep").join(F.broadcast(wanted) if few else wanted, "rep").join(cells.select("_cluster", "_b"), ["_cluster", "_b"], "left_semi")
    inside = named.join(counted, ["_cluster", "_b"]).groupBy("rep", "n", "_b", "_before", "_v").agg(drawn)
    per_rep = of_wanted_cells(inside, [prob], ["rep"]).select(F.col("q0").alias("s"))
    point = binned_quantiles(counted, "_v", [prob], weight="_k").select(F.col("q0").alias("point"))
    return _of_replicates(per_rep, tails, point, counted, clusters)
