"""The given tables seen in the shapes the operators expect.

Every column is one SQL expression that Spark and the checking engine read alike, so a view
and its SQL twin cannot drift apart. Number literals carry an exponent to be doubles in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from troughline.session import tune, with_scalars
from troughline.sources.files import scan_parquet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


def _exprs(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


# --- event inventory: one row per lineitem -----------------------------------------------------------

# The reason is picked by number from a fixed list: filters on it then stay one small expression.
_REASON = """split_part('no_pleth,pleth_mostly_nan,pre_pi_implausible,no_pre_window,pre_window_unstable,no_phase2,no_aligned_occlusion,phase2_misaligned,stat_mode_short_phase3,no_recovery_in_window', ',',
 CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_tax <= 0.06e0 THEN 1 ELSE 2 END WHEN l_tax <= 0.02e0 THEN 3 WHEN l_tax <= 0.03e0 THEN 4 ELSE 5 END
 WHEN 'N' THEN CASE WHEN l_linestatus = 'F' THEN 6 WHEN l_tax <= 0.05e0 THEN 7 ELSE 8 END
 ELSE CASE WHEN l_quantity < 15e0 THEN 9 WHEN l_linestatus = 'F' THEN 10 END END)"""
_DEEP = "l_returnflag = 'R'"
INVENTORY_COLUMNS = {
    "subject_id": "CAST(o_custkey AS STRING)",
    "record_id": "CAST(l_orderkey AS STRING)",
    "nbp_timestamp_s": "l_linenumber * 1e6 + l_extendedprice",
    "is_occlusion_signature": f"{_DEEP} AND l_linestatus = 'O' AND l_quantity >= 15e0",
    "recovered": f"{_DEEP} AND (l_linestatus = 'O' OR l_quantity < 15e0)",
    "pre_event_pi_mean": "l_quantity + 1e0",
    "pre_window_quality": "l_tax + 0e0",
    "pre_window_valid": "l_returnflag <> 'A'",
    "phase2_duration_s": f"CASE WHEN {_DEEP} THEN l_linenumber - 1e0 END",
    "phase3_duration_s": f"CASE WHEN {_DEEP} THEN l_quantity END",
    "nadir_depth_frac": f"CASE WHEN {_DEEP} THEN l_discount * 2e0 + 0e0 END",
    "recovery_fraction_at_window_end": f"CASE WHEN {_DEEP} THEN 0.7e0 + l_tax * 10e0 END",
    "alignment_offset_s": f"CASE WHEN {_DEEP} THEN floor(l_extendedprice / 1e3) - 60e0 END",
    "pleth_valid_fraction": "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 0e0 ELSE 1e0 - l_discount * 7e0 END",
    "reject_reason": _REASON,
}
INV = f"inv AS (SELECT {_select(INVENTORY_COLUMNS)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to orders, as an event inventory."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*_exprs(INVENTORY_COLUMNS))


# --- rater calls: labelled documents --------------------------------------------------------------------

CARD_COLUMNS = {
    "card_id": "CAST(d.doc_id AS STRING)",
    "subject_id": "source",
    "stratum": "lang",
    "quality": "quality",
    "toxic": "toxic",
    "n_chars": "n_chars",
    "reader_call": "CASE WHEN n_chars > 3000 THEN 'indeterminate' WHEN quality = 1 THEN 'occlusion_signature_present' ELSE 'no_occlusion_signature' END",
    "detector_flag": "n_chars > 900",
    "detector_call": "CASE WHEN n_chars > 900 THEN 'occlusion_signature_present' ELSE 'no_occlusion_signature' END",
    "model_call": "CASE WHEN n_chars < 400 THEN NULL WHEN toxic = 1 OR lang = 'fr' THEN 'no_occlusion_signature' WHEN n_chars > 5000 THEN 'indeterminate' ELSE 'occlusion_signature_present' END",
    "model_ok": "n_chars >= 400",
    "pass2_call": "CASE WHEN n_chars > 4000 THEN 'indeterminate' WHEN quality = 1 AND lang <> 'es' THEN 'occlusion_signature_present' ELSE 'no_occlusion_signature' END",
}
CARDS = f"cards AS (SELECT {_select(CARD_COLUMNS)} FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined to labels, as rated cards; the text itself is never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").alias("d")
    labels = table(spark, sf_dir, "labels").alias("l")
    return docs.join(labels, F.col("d.doc_id") == F.col("l.doc_id")).selectExpr(*_exprs(CARD_COLUMNS))


# --- ticked traces: events per type -----------------------------------------------------------------------

# About 2.8 events per tick and series at any table size: the tick follows from count and time span.
PER_TICK = 14
EVERY = 12
REACH = 200
BLOCK = 1 << 15
STATS_SQL = """span AS (SELECT min(us) AS lo, max(us) AS hi, count(*) AS n FROM (SELECT epoch_us(ts) AS us FROM events)),
grid AS (SELECT lo, hi, CAST(greatest(1, (hi - lo) * 14 // n) AS BIGINT) AS tick FROM span)"""
TRACE_SQL = f"""{STATS_SQL},
raw AS (SELECT event_type AS series, CAST((epoch_us(ts) - lo) // tick AS INTEGER) AS t, CAST(round(value * 100) AS BIGINT) AS cents FROM events, grid),
trace AS (SELECT series, t, (sum(cents) * 1e0) / (count(*) * 100) AS v FROM raw GROUP BY 1, 2),
ends AS (SELECT CAST((hi - lo) // tick AS INTEGER) AS last FROM grid),
anchors AS (SELECT series, CAST(a AS INTEGER) AS anchor FROM (SELECT DISTINCT series FROM raw), (SELECT unnest(range(0, last + 1, {EVERY})) AS a FROM ends)),
windows AS (SELECT w.series, w.anchor, w.t, trace.v FROM (
   SELECT series, anchor, CAST(anchor + o AS INTEGER) AS t FROM anchors, (SELECT unnest(range(-{REACH}, {REACH})) AS o), ends
   WHERE anchor + o >= 0 AND anchor + o <= last) w LEFT JOIN trace USING (series, t))"""


def trace_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`series, anchor, t, v`: mean value per tick around an anchor every twelfth tick; empty ticks are NULL."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), us.alias("us"), "value")
    grid = ev.agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.lit(1)).alias("n")).select(
        "lo", "hi", F.expr(f"greatest(1L, ((hi - lo) * {PER_TICK}) div n)").alias("tick")
    )
    placed = with_scalars(ev, grid).select(
        "series", F.expr("CAST((us - lo) div tick AS INT)").alias("t"), F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.lit(1).alias("one")
    )
    ends = grid.select(F.expr("CAST((hi - lo) div tick AS INT)").alias("last"))
    series = with_scalars(ev.select("series").distinct(), ends)
    # Every tick of every series, as two short sequences instead of one as long as the series.
    blocks = series.select("series", "last", F.explode(F.sequence(F.lit(0), F.expr(f"CAST(last div {BLOCK} AS INT)"))).alias("b"))
    empty = blocks.select("series", F.explode(F.sequence(
        F.col("b") * BLOCK, F.least(F.col("last"), F.col("b") * BLOCK + (BLOCK - 1))
    )).alias("t"), F.lit(None).cast("bigint").alias("cents"), F.lit(0).alias("one"))
    # Filled and empty ticks meet in one aggregate, and only then are they repeated for the windows that hold them.
    ticks = placed.unionByName(empty).groupBy("series", "t").agg(F.sum("cents").alias("cents"), F.sum("one").alias("n"))
    ticks = with_scalars(ticks.select("series", "t", F.when(F.col("n") > 0, F.col("cents") * F.lit(1.0) / (F.col("n") * 100)).alias("v")), ends)
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - (REACH - 1)) / EVERY).cast("int") * EVERY)
    until = F.least(F.floor((F.col("t") + REACH) / EVERY).cast("int"), F.floor(F.col("last") / EVERY).cast("int")) * EVERY
    return ticks.withColumn("_first", first).withColumn("_until", until).where("_first <= _until").select(
        "series", F.explode(F.sequence("_first", "_until", F.lit(EVERY))).alias("anchor"), "t", "v"
    )


def trace_rows(spark: SparkSession, sf_dir: str) -> int:
    """About how many rows `trace_windows` has, from one pass over the events."""
    ev = table(spark, sf_dir, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    seen = ev.agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct("event_type").alias("series")).first()
    if not seen.n:
        return 0
    ticks = (seen.hi - seen.lo) // max(1, (seen.hi - seen.lo) * PER_TICK // seen.n) + 1
    return seen.series * ticks * (2 * REACH // EVERY + 1)


def given_files(spark: SparkSession, sf_dir: str, glob: str) -> DataFrame:
    return scan_parquet(tune(spark), sf_dir, glob)
