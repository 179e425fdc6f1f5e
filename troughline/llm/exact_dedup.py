"""Exact dedup by content sort: range partitions of normalised text, an external sort, neighbour comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from troughline.llm.common import ascii_lower, batch_rows, keep, rows_of, shuffle_width, text_of

#: Splitters hold this many characters of a text and its digest, so that the driver's sample stays small.
PREFIX = 16
#: Texts that reach a task in one Arrow batch; whole texts have no bound, so batches are short.
BATCH = 256
_RUNS = "pid int, run long, id long, run_size long, run_keep long, digest string, first boolean, last boolean, edge_text string"
_ARROW = pa.schema([
    ("pid", pa.int32()), ("run", pa.int64()), ("id", pa.int64()), ("run_size", pa.int64()), ("run_keep", pa.int64()),
    ("digest", pa.string()), ("first", pa.bool_()), ("last", pa.bool_()), ("edge_text", pa.string()),
])


def _runs(largest: bool):
    """Compare each row's whole text with the row before it; rows of a run leave together once it ends."""
    best = max if largest else min

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, run, text, digest, ids = 0, 0, None, None, []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            first = run == 1
            known = [i for i in ids if i is not None]
            keeper = best(known) if known else None
            for at in range(0, len(ids), 8192):
                part = ids[at:at + 8192]
                n = len(part)
                # The text itself travels once, on the first row of a run at an edge of the partition.
                edge = [text if at == 0 and (first or last) else None] + [None] * (n - 1)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((
                    [pid] * n, [run] * n, part, [len(ids)] * n, [keeper] * n, [digest] * n, [first] * n, [last] * n, edge,
                ), _ARROW)], schema=_ARROW)

        for pid_, id_, text_, digest_ in rows_of(batches, "pid", "id", "norm", "digest"):
            if ids and text_ == text:
                ids.append(id_)
                continue
            if ids:
                yield from flush(False)
            pid, run, text, digest, ids = pid_, run + 1, text_, digest_, [id_]
        if ids:
            yield from flush(True)

    return walk


def content_sort(docs: DataFrame, key: str = "doc_id", text: str = "text", largest: bool = False) -> DataFrame:
    """One row per document: `key, keep_id, group_size, kept, text_sha256`.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the smallest id stays (`largest`: the largest). Sampled splitters deal rows out by
    (leading characters, digest, id), so a text with very many copies is spread over as many
    partitions as it needs; each partition is sorted externally and every text is compared in full
    with the one before it. A run cut by a partition's edge is joined to its continuation by
    comparing the whole texts at the edge. Rows that repeat an id are all returned, and all of
    them are `kept` where their id is the one that stays. A null id stays only in a group that has
    no other. An empty table gives no rows; other columns are ignored.
    """
    norm = ascii_lower(text_of(text))
    rows = docs.select(F.col(key).cast("long").alias("id"), norm.alias("norm")).select(
        "id", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("digest"), F.substring("norm", 1, PREFIX).alias("lead")
    )
    # The digest as 32 bytes keeps splitters short. Equal texts share lead and digest, so they are neighbours.
    dealt = rows.repartitionByRange(shuffle_width(docs), "lead", F.unhex("digest"), "id").sortWithinPartitions(
        "lead", F.unhex("digest"), "norm", "id"
    ).select(F.spark_partition_id().alias("pid"), "id", "norm", "digest")
    with batch_rows(docs.sparkSession, BATCH):
        runs = keep(dealt.mapInArrow(_runs(largest), _RUNS), "runs")
    merged = _merge_edges(runs, largest)
    # At most two rows per partition, so the lookup is bounded by the number of partitions.
    out = runs.select("pid", "run", "id", "run_size", "run_keep", "digest").join(F.broadcast(merged), ["pid", "run"], "left")
    keep_id = F.coalesce("whole_keep", "run_keep")
    return out.select(
        F.col("id").alias(key), keep_id.alias("keep_id"), F.coalesce("whole_size", "run_size").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def _merge_edges(runs: DataFrame, largest: bool) -> DataFrame:
    """`pid, run, whole_keep, whole_size` of the runs at partition edges, summed over a text's continuations."""
    edges = runs.where("edge_text IS NOT NULL")
    facts = edges.select("pid", "run", "run_size", "run_keep", "first", "last")
    order = Window.orderBy("pid", "run")
    # Two short rows per partition in one task; the texts are compared in a join instead.
    linked = facts.withColumn("_before", F.lag(F.struct("pid", "run")).over(order))
    texts = edges.select(F.struct("pid", "run").alias("_before"), F.col("edge_text").alias("_text_before"))
    same = edges.select("pid", "run", "edge_text").join(linked.select("pid", "run", "_before"), ["pid", "run"]).join(texts, "_before")
    same = same.where(F.col("edge_text") == F.col("_text_before")).select("pid", "run", F.lit(1).alias("_joins"))
    marked = facts.join(same, ["pid", "run"], "left")
    group = F.sum(F.when(F.col("_joins").isNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("_group")
    best = F.max if largest else F.min
    return marked.withColumn("_group", group).select(
        "pid", "run", best("run_keep").over(whole).alias("whole_keep"), F.sum("run_size").over(whole).alias("whole_size")
    )
