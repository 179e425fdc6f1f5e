"""Row keys, hash order and dense positions that no single task has to produce."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.session import cut_lineage, with_scalars


def time_key(t: Column) -> Column:
    """Millisecond-rounded time as an integer, safe to join and hash on."""
    return F.round(t * 1000).cast("bigint")


def content_id(
    subject: Column, t: Column, stratum: Column, seed: int = V.SEED,
    prefixes: Mapping[str, str] = V.STRATUM_PREFIX,
) -> Column:
    """`<letter>-<16 hex>` digest id of an event in a stratum."""
    letter = F.lit("X")
    for name, value in prefixes.items():
        letter = F.when(stratum == name, F.lit(value)).otherwise(letter)
    text = F.concat_ws("|", subject.cast("string"), F.format_string("%.6f", t), stratum, F.lit(str(seed)))
    return F.concat(letter, F.lit("-"), F.substring(F.sha2(text, 256), 1, 16))


def hash_order(keys: Sequence[str | Column], seed: int) -> Column:
    """Seeded pseudo-random sort key: depends on the key values only, never on partitions."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed))))


#: Fixed values of `mixed_slot`: for each half the factors of the replicate and of the position, then of the two rounds.
SLOT_PRIME = 2147483647
SLOT_FACTORS = ((48271, 69621, 1597334677, 1403630843), (39373, 62089911, 1812433253, 1664525013))


def mixed_slot(n: Column, rep: Column, pos: Column, seed: int) -> Column:
    """Deterministic draw from 0..n-1 named by a replicate, a position (both from 0, below 2^37) and a seed.

    Two 31-bit mixes of whole numbers below 2^63, so billions of draws cost no text and no digest.
    """
    half = F.lit(0).cast("bigint")
    for per_rep, per_pos, first, second in SLOT_FACTORS:
        u = (rep * F.lit(per_rep).cast("bigint") + pos * F.lit(per_pos).cast("bigint") + F.lit(seed).cast("bigint")) % SLOT_PRIME
        u = (u.bitwiseXOR(F.shiftright(u, 15)) * F.lit(first).cast("bigint")) % SLOT_PRIME
        u = (u.bitwiseXOR(F.shiftright(u, 13)) * F.lit(second).cast("bigint")) % SLOT_PRIME
        half = half * SLOT_PRIME + u.bitwiseXOR(F.shiftright(u, 16)) % SLOT_PRIME
    return half % n


def hash_position(
    df: DataFrame, keys: Sequence[str], seed: int, within: Sequence[str] = (), out: str = "pos",
    size: str | None = None, below: Column | None = None, few_groups: bool = False,
) -> DataFrame:
    """Add a dense 0-based position in hash order, per `within` group (and the group's `size`).

    A group holding a third of the rows is never ranked in one task: rows are split by the
    leading three hex digits of their hash (4096 even buckets), ranked inside a bucket, and
    shifted by the size of the buckets before it. Only the bucket counts are summed in sequence.

    `below` keeps positions under a limit (an expression of the group columns): buckets that start
    at or beyond it are dropped before any row moves. `few_groups` promises a short, fixed list
    of groups, so the bucket table (4096 rows per group at most) is broadcast.
    """
    within = list(within)
    hashed = df.withColumn("_h", hash_order(keys, seed)).withColumn("_b", F.substring("_h", 1, 3))
    counted = hashed.groupBy(*within, "_b").agg(F.count(F.lit(1)).alias("_n"))
    buckets = Window.partitionBy(*(within or [F.lit(0)]))
    before = buckets.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if size:
        offsets = offsets.withColumn(size, F.sum("_n").over(buckets))
    if below is not None:
        offsets = offsets.where(F.col("_off") < below)
    offsets = offsets.select(
        *[F.col(c).alias(f"_o_{c}") for c in within], F.col("_b").alias("_o_b"), "_off", *([size] if size else [])
    )
    on = hashed["_b"] == offsets["_o_b"]
    for c in within:
        on = on & hashed[c].eqNullSafe(offsets[f"_o_{c}"])
    in_bucket = Window.partitionBy(*within, "_b").orderBy("_h", *keys)
    placed = hashed.join(F.broadcast(offsets) if few_groups or not within else offsets, on).withColumn(
        out, (F.col("_off") + F.row_number().over(in_bucket) - 1).cast("bigint")
    )
    if below is not None:
        placed = placed.where(F.col(out) < below)
    return placed.select(*df.columns, out, *([size] if size else []))


#: Salts of every group where group sizes are not known; rows of a salt where they are.
SALTS, ROWS_PER_SALT = 32, 1 << 20


def join_per_group(
    rows: DataFrame, per_group: DataFrame, by: Sequence[str], spread_on: Column, salt: str = "_salt", size: str | None = None
) -> DataFrame:
    """Join rows to a table of one row per group so that no group lands in one task.

    Rows get a salt from `spread_on`, the small side is repeated once per salt, and both meet on
    (group, salt). Keep the salt in the next aggregate to keep a hot group spread there too. `size` names the column
    of `per_group` that counts a group's rows: then a group has as many salts as its rows need, most have one.
    """
    if size is None:
        salted = rows.withColumn(salt, F.pmod(F.xxhash64(spread_on), F.lit(SALTS)).cast("int"))
        copies = per_group.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return salted.join(copies, [*by, salt])
    salts = F.greatest(F.lit(1), F.ceil(F.col(size) / ROWS_PER_SALT)).cast("int")
    # At most one hot group for every `ROWS_PER_SALT` rows of the whole table, so the list of them fits every task.
    hot = per_group.where(F.col(size) > ROWS_PER_SALT).select(*by, salts.alias("_salts"))
    placed = rows.join(F.broadcast(hot), [*by], "left")
    placed = placed.withColumn(salt, F.pmod(F.xxhash64(spread_on), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copies = per_group.withColumn(salt, F.explode(F.sequence(F.lit(0), salts - 1)))
    return placed.join(copies, [*by, salt])


def sorted_position(df: DataFrame, keys: Sequence[str], out: str = "idx") -> DataFrame:
    """Add the dense 0-based position in a full sort, without a one-task window.

    The range-partitioned sort is checkpointed with Spark's per-partition row ids, so the
    partition sizes that shift the ids are read from the very rows they shift.
    """
    kept = cut_lineage(
        df.orderBy(*keys).withColumn("_mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("_mid", 33).cast("int")
    sizes = kept.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per sort partition, empty ones included, so that the partition's number is the place of its offset in one array.
    every = sizes.agg(F.max("_p").alias("_last")).select(F.explode(F.sequence(F.lit(0), "_last")).alias("_p"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = every.join(sizes, "_p", "left").select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    array = offsets.agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_off"))), lambda x: x["_off"]).alias("_offs"))
    return with_scalars(kept, array).withColumn(
        out, (F.get("_offs", part) + F.col("_mid").bitwiseAND((1 << 33) - 1)).cast("bigint")
    ).select(*df.columns, out)


def sorted_row_id(
    df: DataFrame, subject: str = "subject_id", record: str = "record_id",
    keys: Sequence[str] = ("subject_id", "record_id", "nbp_timestamp_s"), out: str = "row_id",
) -> DataFrame:
    """`subject_record_index`, the index being the position in the sorted inventory."""
    placed = sorted_position(df, keys, "_idx")
    return placed.withColumn(out, F.concat_ws("_", subject, record, F.col("_idx").cast("string"))).drop("_idx")
