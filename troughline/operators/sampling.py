"""Deterministic stratified samples, splits, display orders and blind ids.

Membership comes from hash positions (`functions.keys.hash_position`): the same rows are drawn
whatever the partitioning, and no stratum is ever sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.functions.keys import content_id, hash_position, time_key
from troughline.functions.labels import at_least
from troughline.schema import INVENTORY, InventoryColumns
from troughline.session import cut_lineage, with_scalars


def stratum_of(
    cols: InventoryColumns = INVENTORY, duration_floor: float = V.SENSITIVITY_MIN_S, depth_cut: float = V.NADIR_DEPTH,
    valid_floor: float = 0.5,
) -> Column:
    """Sampling stratum of an inventory row, NULL outside every stratum."""
    reason = F.col(cols.reason)
    near = (
        at_least(F.col(cols.duration), duration_floor) & (F.col(cols.depth) < depth_cut)
        & reason.isin(*V.NEAR_MISS_REASONS)
    )
    negative = reason.isin(*V.NEGATIVE_REASONS) & at_least(F.col(cols.valid_fraction), valid_floor)
    return F.when(F.col(cols.signature), V.STRATUM_POSITIVE).when(near, V.STRATUM_NEAR_MISS).when(negative, V.STRATUM_NEGATIVE)


def _quota(targets: Mapping[str, int | None], stratum: str) -> Column:
    quota = F.lit(0).cast("bigint")
    for name, n in targets.items():
        quota = F.when(F.col(stratum) == name, F.lit(n if n is not None else (1 << 62))).otherwise(quota)
    return quota


def sample_strata(
    df: DataFrame, targets: Mapping[str, int | None], keys: Sequence[str], stratum: str = "stratum", seed: int = V.SEED
) -> DataFrame:
    """Fixed-size sample per stratum; a pool no larger than its target (or target None) is taken whole."""
    pool = df.where(F.col(stratum).isin(*targets))
    limit = _quota(targets, stratum)
    return hash_position(pool, keys, seed, [stratum], "_pos", below=limit, few_groups=True).drop("_pos")


def sampling_report(df: DataFrame, targets: Mapping[str, int], stratum: str = "stratum") -> DataFrame:
    """Target, available, sampled and shortfall per stratum."""
    pool = df.where(F.col(stratum).isin(*targets)).groupBy(stratum).agg(F.count(F.lit(1)).alias("available"))
    target = _quota(targets, stratum)
    return pool.select(
        stratum, target.alias("target"), "available", F.least(target, F.col("available")).alias("sampled"),
        F.greatest(target - F.col("available"), F.lit(0).cast("bigint")).alias("shortfall"),
    )


def quotas(df: DataFrame, n_rows: int, stratum: str = "stratum", ties: str = "asc") -> DataFrame:
    """Largest-remainder quotas: `stratum, size, quota`. Equal remainders go by name, `asc` or `desc`."""
    if n_rows <= 0:
        raise ValueError(f"n_rows must be positive, got {n_rows}")
    if ties not in ("asc", "desc"):
        raise ValueError("ties must be 'asc' or 'desc'")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    totals = sizes.agg(F.sum("size").alias("_total"))
    too_many = F.raise_error(F.lit(f"n_rows={n_rows} exceeds the table")).cast("double")
    # Each tie rule has its own order of multiplication, kept so that remainders round alike.
    raw = (
        F.col("size") / F.col("_total") * F.lit(n_rows) if ties == "asc" else F.lit(n_rows) * F.col("size") / F.col("_total")
    )
    shares = with_scalars(sizes, totals).withColumn(
        "_raw", F.when(F.col("_total") < n_rows, too_many).otherwise(raw)
    ).withColumn("_floor", F.floor("_raw").cast("bigint"))
    # One row per stratum: the only ordering is over stratum names.
    name = F.col(stratum).asc() if ties == "asc" else F.col(stratum).desc()
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("_raw") - F.col("_floor")), name))
    spare = F.lit(n_rows) - F.sum("_floor").over(Window.partitionBy(F.lit(0)))
    return (
        shares.withColumn("_rank", rank).withColumn("_spare", spare)
        .select(stratum, "size", (F.col("_floor") + F.when(F.col("_rank") <= F.col("_spare"), 1).otherwise(0)).alias("quota"))
    )


def proportional_sample(
    df: DataFrame, n_rows: int, keys: Sequence[str], stratum: str = "stratum", seed: int = V.SEED, ties: str = "asc"
) -> DataFrame:
    """Stratified sample of exactly `n_rows` rows in proportion to the strata."""
    # No quota exceeds `n_rows`, so later buckets are dropped before rows move.
    placed = hash_position(df, keys, seed, [stratum], "_pos", below=F.lit(n_rows))
    # Rows without a stratum are a stratum of their own, in the quotas and here.
    share = quotas(df, n_rows, stratum, ties).select(F.col(stratum).alias("_stratum"), "quota")
    met = placed.join(share, F.col(stratum).eqNullSafe(F.col("_stratum")))
    return met.where(F.col("_pos") < F.col("quota")).select(*df.columns)


def simple_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = V.SEED) -> DataFrame:
    """`n` rows drawn across the whole table; everything when `n` covers it, nothing when it is not positive."""
    if n <= 0:
        return df.limit(0)
    return hash_position(df, keys, seed, (), "_pos", below=F.lit(n)).drop("_pos")


def overlap_subset(cards: DataFrame, n: int, key: str = "card_id", seed: int = V.SEED) -> DataFrame:
    """Double-read subset across all strata, in key order."""
    return simple_sample(cards, n, [key], seed).orderBy(key)


def split_half(df: DataFrame, subject: str = "subject_id", seed: int = V.SEED) -> DataFrame:
    """`subject, split`: floor(n/2) subjects calibrate, the rest (odd one included) is held out."""
    placed = hash_position(df.select(subject).distinct(), [subject], seed, (), "_pos", "_n")
    few = F.raise_error(F.lit("need at least 2 distinct subjects to split")).cast("string")
    side = F.when(F.col("_pos") < F.floor(F.col("_n") / 2), "calibration").otherwise("held_out")
    return placed.select(subject, F.when(F.col("_n") < 2, few).otherwise(side).alias("split"))


def blind_order(df: DataFrame, keys: Sequence[str], seed: int = V.SEED, out: str = "display_pos") -> DataFrame:
    """Seeded presentation order, 1-based."""
    return hash_position(df, keys, seed, (), "_pos").withColumn(out, F.col("_pos") + 1).drop("_pos")


def blind_ids(df: DataFrame, position: str = "display_pos", out: str = "blind_id", width: int = 4) -> DataFrame:
    return df.withColumn(out, F.format_string(f"blind_%0{width}d", F.col(position)))


# --- spreading strata over a display order ------------------------------------------------------------

#: Share of the list that neighbouring places lie apart where nothing forbids it: the least periodic one.
STRIDE = (5 ** 0.5 - 1) / 2


def spread_stride(n: int, most: int) -> int | None:
    """How far apart in the list of all cards, stratum after stratum, neighbouring places of the display lie.

    Two places with one stratum between them would need a stride shorter than the largest stratum (`most`), so
    the stride is at least that on either side; it has no factor in common with `n`, so every card gets a place. NULL
    where no such stride exists: then even places are filled before odd ones.
    """
    low, high = most, n - most
    middle = min(max(round(n * STRIDE), low), high) if low <= high else low
    for off in range(max(0, high - low) + 1):
        for d in (middle + off, middle - off):
            if low <= d <= high and math.gcd(d, n) == 1:
                return d
    return None


def _list_place(place: Column, n: int, most: int) -> Column:
    """Display place (from 0) of a place in the list, in whole numbers of any size."""
    i = place.cast("decimal(19,0)")
    d = spread_stride(n, most)
    if d is not None:
        back = F.lit(pow(d, -1, n) if n > 1 else 0).cast("decimal(19,0)")
        return ((i * back) % F.lit(max(1, n)).cast("decimal(19,0)")).cast("bigint")
    half = (n + 1) // 2
    if most <= half:
        return F.when(place < half, place * 2).otherwise((place - half) * 2 + 1).cast("bigint")
    # More of one stratum than of all others together: those are dealt evenly between its cards.
    rest, m = n - most, F.lit(most).cast("decimal(19,0)")
    whole = lambda x, by: ((x - x % by) / by).cast("bigint")
    own = place + F.least(F.lit(rest), whole((i + 1) * (rest + 1) - 1, m))
    other = whole((i - most + 1) * m, F.lit(rest + 1).cast("decimal(19,0)")) + (place - most)
    return F.when(place < most, own).otherwise(other).cast("bigint")


def spread_order(
    df: DataFrame, keys: Sequence[str], stratum: str = "stratum", seed: int = V.SEED, out: str = "display_pos"
) -> DataFrame:
    """1-based display order in which equal strata follow each other only where their numbers force it, and as rarely as can be.

    Cards are listed by stratum (largest first, ties by name, NULL as a stratum of its own) and by hash position
    inside; a card's place is arithmetic on its place in that list. Only the number of cards and the largest
    stratum reach the driver; strata may be as many as cards.
    """
    ranked = hash_position(df, keys, seed, [stratum], "_rank")
    sizes = cut_lineage(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")))
    order = Window.orderBy(F.desc("_n"), F.col(stratum).asc_nulls_last())
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(stratum).alias("_s"), before.alias("_start"))
    facts = sizes.agg(F.sum("_n").alias("n"), F.max("_n").alias("most")).first()
    placed = ranked.join(starts, F.col(stratum).eqNullSafe(F.col("_s")))
    return placed.withColumn(out, _list_place(F.col("_start") + F.col("_rank"), facts.n or 0, facts.most or 0) + 1).select(*df.columns, out)


def adjacent_repeats(df: DataFrame, stratum: str = "stratum", position: str = "display_pos") -> DataFrame:
    """Number of neighbouring places that share a stratum: a self equi-join on the next place."""
    here = df.select(F.col(position).alias("p"), F.col(stratum).alias("a"))
    after = df.select((F.col(position) - 1).alias("p"), F.col(stratum).alias("b"))
    return here.join(after, "p").agg(F.count_if(F.col("a") == F.col("b")).alias("n_adjacent"))


# --- galleries and pools ---------------------------------------------------------------------------------

def pilot_pool(
    inv: DataFrame, survivors: Sequence[str], reasons: Sequence[str] = V.PILOT_REASONS, per_reason: int = 2,
    row_id: str = "row_id", cols: InventoryColumns = INVENTORY, floor_s: float = V.PRIMARY_MIN_S,
) -> DataFrame:
    """Primary rows of the named subjects plus the first rows of each control reason, without duplicates.

    "First" is inventory order. `row_number() <= n` is cut per task before the shuffle, so a
    reason that holds a third of the table sends only `n` rows per task.
    """
    usable = inv.where(~F.coalesce(F.col(cols.reason).isin(V.NO_SIGNAL), F.lit(False)))
    kept = usable.where(
        F.col(cols.subject).isin(*survivors) & at_least(F.col(cols.duration), floor_s) & F.col(cols.signature)
    )
    order = Window.partitionBy(cols.reason).orderBy(cols.subject, cols.record, cols.anchor)
    controls = (
        usable.where(F.col(cols.reason).isin(*reasons))
        .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_reason).drop("_n")
    )
    # Survivors carry the NULL reason and controls a named one, so the parts cannot share a row.
    return kept.unionByName(controls).dropDuplicates([row_id]).orderBy(row_id)


def gallery(
    inv: DataFrame, targets: Mapping[str, int | None] = V.STRATUM_TARGETS, seed: int = V.SEED,
    cols: InventoryColumns = INVENTORY, root: str = "",
) -> DataFrame:
    """Strata, samples and ids in one deterministic manifest."""
    pool = inv.withColumn("stratum", stratum_of(cols)).where(F.col("stratum").isNotNull())
    pool = pool.withColumn("_ms", time_key(F.col(cols.anchor)))
    drawn = sample_strata(pool, targets, [cols.subject, cols.record, "_ms"], "stratum", seed)
    return manifest_rows(drawn, seed, cols, root)


def manifest_rows(
    drawn: DataFrame, seed: int = V.SEED, cols: InventoryColumns = INVENTORY, root: str = "", digests: DataFrame | None = None
) -> DataFrame:
    """Sampled inventory rows in manifest layout; `digests` (image_path, image_sha256) is optional.

    Rows of one subject, time and stratum share an image: each path is looked up once, however often `digests` names it.
    """
    prefix = f"{root.rstrip('/')}/" if root else ""
    ident = content_id(F.col(cols.subject), F.col(cols.anchor), F.col("stratum"), seed)
    rows = drawn.select(
        ident.alias("card_id"), "stratum", F.col(cols.subject).cast("string").alias("subject_id"),
        F.col(cols.record).cast("string").alias("record_id"), F.col(cols.anchor).cast("double").alias("t_nbp"),
        F.coalesce(F.col(cols.signature), F.lit(False)).alias("is_occlusion_signature"),
        F.col(cols.duration).cast("double").alias("phase3_duration_s"), F.col(cols.depth).cast("double").alias("nadir_depth_frac"),
        F.col(cols.offset).cast("double").alias("alignment_offset_s"), F.col(cols.reason).alias("reject_reason"),
    ).withColumn("image_path", F.concat(F.lit(prefix), F.col("stratum"), F.lit("/"), F.col("card_id"), F.lit(".png")))
    if digests is None:
        rows = rows.withColumn("image_sha256", F.lit(None).cast("string"))
    else:
        of_path = digests.groupBy("image_path").agg(F.max("image_sha256").alias("image_sha256"))
        rows = rows.join(of_path, "image_path", "left")
    return rows.select(
        "card_id", "stratum", "subject_id", "record_id", "t_nbp", "image_path", "image_sha256", "is_occlusion_signature",
        "phase3_duration_s", "nadir_depth_frac", "alignment_offset_s", "reject_reason",
    )


def blinded_form(manifest: DataFrame, root: str = "") -> DataFrame:
    """The reader's form: an allow-list of columns, so no machine column can leak."""
    prefix = f"{root.rstrip('/')}/" if root else ""
    path = F.col("image_path")
    relative = F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
    return manifest.select("card_id", relative.alias("image_path"), F.lit("").alias("call"), F.lit("").alias("notes"))
