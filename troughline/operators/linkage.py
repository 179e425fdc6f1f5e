"""Interval linkage: overlap join, invalid-interval pruning, modal match, nearest event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troughline.functions.keys import time_key
from troughline.session import cut_lineage, with_scalars


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def prune_intervals(df: DataFrame, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """Drop rows with a null key or bound and rows whose end is not after their start."""
    keep = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start))
    for k in keys:
        keep = keep & F.col(k).isNotNull()
    return df.where(keep)


#: Grids of an overlap join, each this many times as wide as the one before; an interval lies on the first where it touches few cells.
GRIDS, WIDER, FEW_CELLS = 8, 16, 4


def _bucket(ts: Column, width_s: Column) -> Column:
    return F.floor(seconds(ts) / width_s)


def _width(level: Column, bucket_s: float) -> Column:
    return F.lit(float(bucket_s)) * F.pow(F.lit(float(WIDER)), level)


def _level(start: str, end: str, bucket_s: float) -> Column:
    """The finest grid on which the interval touches at most `FEW_CELLS` cells."""
    cells = lambda g: _bucket(F.col(end), _width(F.lit(g), bucket_s)) - _bucket(F.col(start), _width(F.lit(g), bucket_s)) + 1
    return F.coalesce(*[F.when(cells(g) <= FEW_CELLS, F.lit(g)) for g in range(GRIDS)], F.lit(GRIDS - 1))


def grid_cells(df: DataFrame, start: str, end: str, bucket_s: float, other_levels: DataFrame) -> DataFrame:
    """Rows with their own grid (`_own`), once for each cell (`_level`, `_cell`) in which they may meet the other side.

    `other_levels` is one row with the list of grids on which intervals of the other side lie. A row shows itself on its own
    grid and on those wider ones, so even an open end makes a handful of rows.
    """
    placed = with_scalars(df.withColumn("_own", _level(start, end, bucket_s)), other_levels.toDF("_used"))
    levels = F.filter(F.sequence("_own", F.lit(GRIDS - 1)), lambda g: (g == F.col("_own")) | F.array_contains("_used", g))
    shown = placed.withColumn("_level", F.explode(levels)).drop("_used")
    width = _width(F.col("_level"), bucket_s)
    return shown.withColumn("_cell", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(end), width))))


def interval_overlap_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_bounds: tuple[str, str],
    right_bounds: tuple[str, str],
    bucket_s: float = 7 * 86_400,
    out: str = "overlap_s",
) -> DataFrame:
    """Pairs of the same key whose intervals share more than zero seconds, with that overlap.

    Both sides are cut along time grids and joined on (key, grid, cell), so the rows of one hot key
    spread over the cells instead of meeting in one task. Intervals lie on a grid that suits their length and meet
    on the wider of their two grids. A pair that shares several cells is
    kept only in the cell where the later of the two starts falls. Set the cell width to a
    typical interval length: most intervals then cover one or two cells of the finest grid.
    """
    (ls, le), (rs, re) = left_bounds, right_bounds
    left = prune_intervals(left, ls, le, [key])
    right = prune_intervals(right, rs, re, [key])
    used = lambda df, s, e: df.agg(F.collect_set(_level(s, e, bucket_s)))
    a = grid_cells(left, ls, le, bucket_s, used(right, rs, re)).withColumnRenamed("_own", "_own_a")
    b = grid_cells(right, rs, re, bucket_s, used(left, ls, le)).withColumnRenamed("_own", "_own_b")
    start, end = F.greatest(ls, rs), F.least(le, re)
    pairs = a.join(b, [key, "_level", "_cell"]).where(F.col("_level") == F.greatest("_own_a", "_own_b"))
    return (
        pairs.where((end > start) & (F.col("_cell") == _bucket(start, _width(F.col("_level"), bucket_s))))
        .withColumn(out, seconds(end) - seconds(start))
        .drop("_cell", "_level", "_own_a", "_own_b")
    )


def flag_modal(
    df: DataFrame, group: str, overlap: str = "overlap_s", order: Sequence[str] = ("stay_intime", "stay_id"),
    out: str = "is_modal",
) -> DataFrame:
    """Flag the row with the largest overlap of each group; ties go to the first in `order`.

    The winner is a mergeable `min` of an ordering struct, so a hot group shrinks to one row
    per task before it is shuffled; the flag comes back by an equi-join on the group. The rows are written once, so
    that what made them is not made again for the second use.
    """
    df = cut_lineage(df)
    rank = F.struct((-F.col(overlap)).alias("o"), *[F.col(c) for c in order])
    best = df.groupBy(group).agg(F.min(rank).alias("_best"))
    return df.join(best, group).withColumn(out, F.col("_best") == rank).drop("_best")


def link(records: DataFrame, stays: DataFrame, bucket_s: float = 7 * 86_400) -> DataFrame:
    """Recordings to stays: prune, overlap, flag the modal stay."""
    stays = stays.select(
        "subject_id", "stay_id", F.col("intime").alias("stay_intime"), F.col("outtime").alias("stay_outtime")
    ).where(F.col("stay_id").isNotNull())
    pairs = interval_overlap_join(
        records, stays, "subject_id", ("record_start", "record_end"), ("stay_intime", "stay_outtime"), bucket_s
    )
    return flag_modal(pairs, "record_id").select(
        "record_id", "subject_id", "stay_id", "record_start", "record_end",
        "stay_intime", "stay_outtime", "overlap_s", "is_modal",
    )


def record_window(
    df: DataFrame, day: str = "base_date", clock: str = "base_time", length: str = "sig_len", rate: str = "fs"
) -> DataFrame:
    """Wall-clock window of a recording: date + time, plus length / rate seconds.

    Rows without a readable date, time, positive length or positive rate are dropped.
    """
    text = F.concat_ws(" ", F.date_format(F.col(day).cast("date"), "yyyy-MM-dd"), F.col(clock).cast("string"))
    start = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp")
    n, fs = F.col(length).cast("string").try_cast("bigint"), F.col(rate).cast("string").try_cast("double")
    usable = F.col(day).isNotNull() & F.col(clock).isNotNull() & (n > 0) & (fs > 0) & start.isNotNull()
    end = F.timestamp_micros(F.unix_micros(start) + F.round(n / fs * 1_000_000).cast("bigint"))
    return (
        df.where(usable)
        .withColumn("record_start", start.cast("timestamp_ntz"))
        .withColumn("record_end", end.cast("timestamp_ntz"))
    )


def nearest_within(
    targets: DataFrame,
    events: DataFrame,
    key: str,
    target_t: str,
    event_t: str,
    tol_s: float,
    target_id: Sequence[str],
    carry: Sequence[str] = (),
) -> DataFrame:
    """For every target the event of the same key nearest in time, at most `tol_s` away.

    Ties go to the earlier event. Targets without a candidate are absent. Events and targets
    first collapse to one row per (key, time); events are laid out in cells `tol_s` wide and copied to both
    neighbours; inside a cell the nearest event before and after each target is a running `last`
    in either direction. No target-event pairs are formed, so a burst costs a sort, not a product.
    """
    width = F.lit(float(tol_s) if tol_s > 0 else 1.0)
    payload = F.struct(F.col("_t").alias(event_t), *[F.col(f"_p.{c}").alias(c) for c in carry])
    distinct = events.where(F.col(event_t).isNotNull()).groupBy(F.col(key), F.col(event_t).alias("_t")).agg(
        F.min(F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry])).alias("_p")
    )
    cell = F.floor(F.col("_t") / width)
    laid = distinct.select(
        F.col(key), "_t", payload.alias("_event"), F.explode(F.sequence(cell - 1, cell + 1)).alias("_cell")
    )
    asked = targets.where(F.col(target_t).isNotNull()).select(F.col(key), F.col(target_t).alias("_t")).distinct().select(
        key, "_t", F.lit(None).cast(laid.schema["_event"].dataType).alias("_event"), cell.alias("_cell")
    )
    # An event at the target's own time sorts before it in both directions.
    is_target = F.col("_event").isNull()
    cells = Window.partitionBy(key, "_cell")
    upto = lambda order: F.last("_event", ignorenulls=True).over(
        cells.orderBy(order, is_target).rowsBetween(Window.unboundedPreceding, 0)
    )
    both = laid.unionByName(asked).withColumn("_before", upto(F.asc("_t"))).withColumn("_after", upto(F.desc("_t")))
    gap = lambda side: F.abs(F.col(f"{side}.{event_t}") - F.col("_t"))
    best = F.when(F.coalesce(gap("_before") <= gap("_after"), F.col("_before").isNotNull()), F.col("_before")).otherwise(F.col("_after"))
    found = (
        both.where(is_target).withColumn("_best", best).withColumn("gap_s", gap("_best"))
        .where(F.col("gap_s") <= tol_s)
        .select(key, F.col("_t").alias(target_t), "gap_s", "_best.*")
    )
    # Targets at the same key and time share one answer.
    return targets.select(*dict.fromkeys([key, *target_id, target_t])).join(found, [key, target_t])


def bridge(
    manifest: DataFrame,
    inventory: DataFrame,
    subject: str = "subject_id",
    record: str = "record_id",
    manifest_t: str = "t_nbp",
    inventory_t: str = "nbp_timestamp_s",
    row_id: str = "row_id",
) -> DataFrame:
    """Attach the inventory row id to manifest cards by (subject, record, millisecond)."""
    ids = inventory.select(
        F.col(subject).cast("string").alias("_s"), F.col(record).cast("string").alias("_r"),
        time_key(F.col(inventory_t)).alias("_t"), F.col(row_id),
    )
    on = (
        (F.col(subject).cast("string") == F.col("_s"))
        & (F.col(record).cast("string") == F.col("_r"))
        & (time_key(F.col(manifest_t)) == F.col("_t"))
    )
    return manifest.join(ids, on, "left").drop("_s", "_r", "_t")


def bridge_summary(bridged: DataFrame, row_id: str = "row_id") -> DataFrame:
    return bridged.agg(
        F.count(F.lit(1)).alias("n_cards"),
        F.count(row_id).alias("n_matched"),
        F.count_if(F.col(row_id).isNull()).alias("n_unmatched"),
    )


#: `<subject>_<record>_<millisecond>.png` in any folder.
TRIPLE_NAME = r"(?:^|/)([^/_]+)_([^/_]+)_(-?[0-9]{1,18})\.png$"


def artifact_triples(listing: DataFrame, path: str = "path", pattern: str = TRIPLE_NAME) -> DataFrame:
    """`path, subject, record, ms` of the listed files whose name states a triple; other files are left out."""
    part = lambda i: F.regexp_extract(path, pattern, i)
    return listing.where(F.col(path).rlike(pattern)).select(
        F.col(path).alias("path"), part(1).alias("subject"), part(2).alias("record"), part(3).cast("bigint").alias("ms")
    )


def _same_triple(rows: DataFrame, files: DataFrame, subject: str, record: str, t: str) -> Column:
    """Equality of (subject, record, rounded time), null matching null."""
    mine = (F.col(f"_rows.{subject}").cast("string"), F.col(f"_rows.{record}").cast("string"), time_key(F.col(f"_rows.{t}")))
    same = F.lit(True)
    for value, name in zip(mine, ("subject", "record", "ms")):
        same = same & value.eqNullSafe(F.col(f"_files.{name}"))
    return same


def with_artifact(
    rows: DataFrame, files: DataFrame, subject: str = "subject_id", record: str = "record_id", t: str = "t_nbp",
) -> DataFrame:
    """Rows whose triple has a file (`files`: subject, record, ms), each once however many files it has."""
    return rows.alias("_rows").join(files.alias("_files"), _same_triple(rows, files, subject, record, t), "left_semi")


def artifact_lookup(
    manifest: DataFrame, listing: DataFrame, card: str = "card_id", stratum: str = "stratum", subject: str = "subject_id",
    record: str = "record_id", t: str = "t_nbp", path: str = "path", suffix: str = ".png",
) -> DataFrame:
    """`subject, record, ms, path`: the listed file of each manifest card, `<stratum>/<card><suffix>` in any folder.

    Cards without a file and files without a card are left out. Cards that share a rounded triple give one row,
    that of the greatest path.
    """
    tail = F.concat_ws("/", F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1))
    files = listing.where(F.col(path).endswith(suffix) & F.col(path).contains("/")).select(F.col(path).alias("path"), tail.alias("_tail"))
    cards = manifest.select(
        F.concat(F.col(stratum), F.lit("/"), F.col(card), F.lit(suffix)).alias("_tail"), F.col(subject).cast("string").alias("subject"),
        F.col(record).cast("string").alias("record"), time_key(F.col(t)).alias("ms"),
    )
    return cards.join(files, "_tail").groupBy("subject", "record", "ms").agg(F.max("path").alias("path"))


def resolve_artifacts(
    rows: DataFrame, lookup: DataFrame, subject: str = "subject_id", record: str = "record_id", t: str = "t_nbp", out: str = "artifact",
) -> DataFrame:
    """Every row with the path of its triple's file, NULL where there is none."""
    files = lookup.withColumnRenamed("path", "_path").alias("_files")
    return rows.alias("_rows").join(files, _same_triple(rows, files, subject, record, t), "left").select(
        *[F.col(f"_rows.{c}") for c in rows.columns], F.col("_files._path").alias(out)
    )


def lookup_report(manifest: DataFrame, listing: DataFrame, lookup: DataFrame) -> DataFrame:
    """Cards, triples with a file, and listed files, in one row."""
    cards = manifest.agg(F.count(F.lit(1)).alias("n_cards"))
    return with_scalars(with_scalars(cards, lookup.agg(F.count(F.lit(1)).alias("n_resolved"))), listing.agg(F.count(F.lit(1)).alias("n_files")))


def anchor_windows(
    anchors: DataFrame,
    samples: DataFrame,
    key: str = "record_id",
    anchor_t: str = "t_nbp",
    sample_t: str = "t_s",
    pre_s: float = 200.0,
    post_s: float = 200.0,
    how: str = "inner",
) -> DataFrame:
    """Samples inside `[anchor - pre, anchor + post)` of every anchor.

    Joined on (key, time cell): a recording with a third of all samples is spread over its
    cells, and each anchor touches two or three of them. `how="left"` keeps every anchor without a
    sample, equal anchors and those with a NULL included.
    """
    width = float(pre_s + post_s)
    lo, hi = F.col(anchor_t) - pre_s, F.col(anchor_t) + post_s
    spread = anchors.withColumn("_cell", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    laid = samples.withColumn("_cell", F.floor(F.col(sample_t) / width))
    found = spread.join(laid, [key, "_cell"]).where((F.col(sample_t) >= lo) & (F.col(sample_t) < hi)).drop("_cell")
    if how == "inner":
        return found
    # Equal anchors match the same samples, so anchors without any are told by content, NULLs included.
    names, extra = anchors.columns, [c for c in samples.columns if c != key]
    matched = found.select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(names)]).distinct()
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"_m{i}"))
    lone = anchors.join(matched, same, "left_anti")
    return found.select(*names, *extra).unionByName(lone, allowMissingColumns=True)
