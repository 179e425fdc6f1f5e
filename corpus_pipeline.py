"""Corpus pipeline: classify, deduplicate lines, deduplicate documents, mix sources, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from troughline.llm import line_dedup, mixing, packing, quality, shingle_dedup
from troughline.llm.common import FEW_IDS, id_remainder, keep, without
from troughline.llm.queries import tokenizer_path
from troughline.plans.views import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the ranking calls good; it learns from labels of ids with remainder 0 or 2."""
    labels = table(spark, sf_dir, "labels")
    return quality.good_documents(docs.select(*COLUMNS), labels, id_remainder("doc_id", 3) != 1)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that repeat an earlier line; a document may end up empty, and `n_chars` follows its text."""
    return line_dedup.remove_repeated_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep one row, of the smallest id.

    A group is linked by a Jaccard similarity of five-word shingles of 0.8 or more, which fingerprints within a
    few bits would miss. Rows are numbered, so those that repeat an id are told apart.
    """
    kept = keep(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = shingle_dedup.near_copies(kept.select(F.col("_row").alias("row"), F.col("text").alias("t")))
    ranked = groups.join(kept.select(F.col("_row").alias("row"), "doc_id"), "row")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    first = ranked.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.row").alias("first"))
    gone = keep(ranked.join(first, "root").where("row <> first").select(F.col("row").alias("_row")), "gone")
    return without(kept, gone, "_row").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, on average; not at all where it takes too few."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    times = mixed.select("doc_id", mixing.copies(F.col("taken"), F.col("size"), F.col("doc_id")).alias("_times")).where("_times > 0")
    # A row for each id: rows that repeat an id share the larger number.
    times = keep(times.groupBy(F.col("doc_id").alias("_id")).agg(F.max("_times").alias("_times")), "times")
    few = times.limit(FEW_IDS + 1).count() <= FEW_IDS  # then texts do not move
    joined = docs.select(*COLUMNS).join(F.broadcast(times) if few else times, F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their place in the packed sequences.

    Workers still hold what the stages before made them load, so they remember fewer words than alone.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), remember=100_000)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: SQL cannot state the classifier, the similarity stages or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
