"""What several text operators share: written intermediate tables, texts, ids and small number packing."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, suppress
from decimal import Decimal

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from troughline.session import scratch_path

#: Separators of words in every operator: the blank and the five ASCII controls from tab to carriage return.
BLANK = "\\x20\\x09-\\x0D"
WORD = f"[^{BLANK}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


#: Id lists up to this length are broadcast (16 bytes each).
FEW_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the one-column table `gone`; texts move only if the list is too long to broadcast."""
    short = gone.limit(FEW_IDS + 1).count() <= FEW_IDS
    return docs.join(F.broadcast(gone) if short else gone, key, "left_anti")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def shuffle_width(df: DataFrame, least: int = 1) -> int:
    """The session's number of shuffle partitions, which the cluster sets to fit the input."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words as UTF-8; `bytes.split` and `bytes.lower` know ASCII only, as wanted."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def pack(values: np.ndarray) -> bytes:
    """Integers or floats as compressed bytes; ascending integers shrink best, so callers pass differences."""
    if not len(values):
        return b""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def unpack(data: bytes, dtype: str) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(dtype)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows inside the block, for tasks that start there: whole texts have no bound."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as Python tuples, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names])


def give_back() -> None:
    """Return a worker's freed memory to the system: workers stay for later tasks, which need it elsewhere."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def even_parts(n_rows: int, per_part: int) -> int:
    """Number of parts that keeps about `per_part` rows in each."""
    return max(1, math.ceil(n_rows / per_part))


#: Quantiles that cut ids first; between two of them ids are cut evenly.
CUTS, FAN = 1024, 32


def id_ranges(ids: DataFrame, column: str, n_rows: int, per_range: int) -> Column:
    """Number, from 0 and rising with the id, of a range of about `per_range` rows; NULL for a null id.

    Approximate quantiles cut the ids first, so neither their span nor single far ones matter; `CUTS` of them at most are
    collected, and each stretch between two is cut into ranges of one width. Any two ranges are apart in ids.
    """
    parts = even_parts(n_rows, per_range)
    coarse = min(CUTS, parts)
    edges = F.percentile_approx(column, [i / coarse for i in range(1, coarse)], 8 * CUTS) if coarse > 1 else F.array().cast("array<bigint>")
    facts = ids.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), edges.alias("edges")).first()
    if facts.lo is None:
        return F.lit(None).cast("bigint")
    lows = sorted({facts.lo, *(facts.edges or [])})
    fine = -(-parts // len(lows))
    widths = [max(1, -(-(end - low) // fine)) for low, end in zip(lows, [*lows[1:], facts.hi + 1])]
    wide = lambda c: c.cast("decimal(20,0)")
    numbers = lambda xs: F.array(*[F.lit(Decimal(x)).cast("decimal(20,0)") for x in xs])
    blocks = [lows[i:i + FAN] for i in range(0, len(lows), FAN)]
    upto = lambda low: low <= wide(F.col(column))
    top = F.greatest(F.lit(1), F.size(F.filter(numbers([b[0] for b in blocks]), upto)))
    inner = F.greatest(F.lit(1), F.size(F.filter(F.element_at(F.array(*[numbers(b) for b in blocks]), top), upto)))
    at = (top - 1) * FAN + inner
    within = F.floor((wide(F.col(column)) - F.element_at(numbers(lows), at)) / F.element_at(numbers(widths), at))
    return F.when(F.col(column).isNotNull(), ((at - 1) * fine + within).cast("bigint"))


def bare(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the columns an operator works on, so that others may have any name."""
    return df.select(*columns)
