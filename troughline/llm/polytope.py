"""Nearest neighbours by cross-polytope hashing: a unit vector's cell is the signed axis its rotation lies closest to.

A rotation is three rounds of random signs and a fast Hadamard transform. A cell joins `digits` rotations; there are
`TABLES` tables of cells. A query visits its likeliest cells of every table (multiprobe) and its candidates are
reranked by exact inner products in double precision. Inner products also depend on lengths, so cells hold vectors
of about one length (bands a factor of the square root of two wide) and a query visits the cells in every band.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troughline.llm.common import batch_rows, keep, without

#: Tables of cells; rows that a cell holds on average before a further digit splits it.
TABLES, CELL_ROWS = 10, 8192
#: Queries whose true neighbours are found among all rows to choose the number of probes, and the recall aimed at there.
SAMPLE, RECALL = 200, 0.96
#: Rows and queries of a cell that meet in one group; larger cells are dealt out as blocks against blocks.
BLOCK, QUERY_BLOCK = 2048, 1024
#: Longest probe list of a table with several digits; a table that would need more gets a digit less.
PROBES = 4096
#: Rows turned into cells at once.
ROWS = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(units: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-random rotation named by `seed`; rows are filled up with zeros to a power of two."""
    n, d = units.shape
    wide = 1 << max(0, d - 1).bit_length()
    x = np.zeros((n, wide))
    x[:, :d] = units
    signs = np.random.default_rng(seed).integers(0, 2, (3, wide)) * 2 - 1
    for s in signs:
        x = hadamard(x * s)
    return x


def lengths(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and the length band of each."""
    peak = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / peak
    norm = np.linalg.norm(scaled, axis=1, keepdims=True)
    band = np.round(2 * (np.log2(peak[:, 0]) + np.log2(norm[:, 0]))).astype(np.int64)
    return scaled / norm, band


def cells(units: np.ndarray, table: int, digits: int) -> np.ndarray:
    """Cell number of each unit vector in a table."""
    code = np.zeros(len(units), np.int64)
    for j in range(digits):
        z = rotate(units, 1000 * table + j)
        axis = np.abs(z).argmax(axis=1)
        code = code * 2 * z.shape[1] + 2 * axis + (z[np.arange(len(z)), axis] < 0)
    return code


def probes(units: np.ndarray, table: int, digits: int, count: int) -> np.ndarray:
    """The `count` likeliest cells of each unit vector, likeliest first: largest sums of signed coordinates."""
    best = None
    for j in range(digits):
        z = rotate(units, 1000 * table + j)
        signed = np.stack((z, -z), axis=2).reshape(len(z), -1)
        order = np.argsort(-signed, axis=1, kind="stable")[:, :count]
        score = np.take_along_axis(signed, order, axis=1)
        if best is None:
            best, code = score, order.astype(np.int64)
            continue
        both = (best[:, :, None] + score[:, None, :]).reshape(len(z), -1)
        codes = (code[:, :, None] * signed.shape[1] + order[:, None, :]).reshape(len(z), -1)
        top = np.argsort(-both, axis=1, kind="stable")[:, :count]
        best, code = np.take_along_axis(both, top, axis=1), np.take_along_axis(codes, top, axis=1)
    return code


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Slices of rows whose vectors have one number of components."""
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for dim in np.unique(dims):
            same = batch.filter(pa.array(dims == dim))
            for at in range(0, same.num_rows, ROWS):
                yield int(dim), pa.Table.from_batches([same.slice(at, ROWS)])


def _rows_in_cells(digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows in _by_dim(batches):
            units, band = lengths(_matrix(rows.column("data"), dim))
            for t in range(TABLES):
                names = [f"{dim}.{t}.{b}.{c}" for b, c in zip(band.tolist(), cells(units, t, digits).tolist())]
                yield from rows.append_column("cell", pa.array(names, pa.string())).select(["cell", "vid", "first", "dim", "data"]).to_batches()

    return run


def _queries_to_cells(digits: int, count: int, bands: dict[int, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows in _by_dim(batches):
            units, _ = lengths(_matrix(rows.column("data"), dim))
            for t in range(TABLES):
                codes = probes(units, t, digits, count)
                at = np.repeat(np.arange(len(codes)), codes.shape[1])
                for b in bands[dim]:
                    names = pa.array([f"{dim}.{t}.{b}.{c}" for c in codes.reshape(-1).tolist()], pa.string())
                    out = rows.select(["vid", "dim", "data"]).take(pa.array(at)).append_column("cell", names)
                    yield from out.select(["cell", "vid", "dim", "data"]).to_batches()

    return run


def _closest(k: int):
    """The k nearest rows of a block for each query of a block."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            dim = rows.column("dim")[0].as_py()
            x, q = _matrix(rows.column("data"), dim), _matrix(queries.column("data"), dim)
            with np.errstate(over="ignore", invalid="ignore"):
                near = q @ x.T
                width = min(len(x), k + 4)
                at = np.argpartition(-near, width - 1, axis=1)[:, :width] if width < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
                # Sums of one pair must not depend on the block it is met in, as they do in the product above.
                exact = np.stack([(x[a] * v).sum(axis=1) for a, v in zip(at, q)])
            firsts = np.array([np.iinfo(np.int64).max if f is None else f for f in rows.column("first").to_pylist()])[at]
            order = np.lexsort((firsts, -exact), axis=1)[:, :k]
            vids = np.asarray(rows.column("vid"))[np.take_along_axis(at, order, axis=1)]
            score = np.take_along_axis(exact, order, axis=1)
            first = np.take_along_axis(firsts, order, axis=1)
            out = [np.repeat(np.asarray(queries.column("vid")), order.shape[1]), vids.reshape(-1), score.reshape(-1), first.reshape(-1)]
        return pa.table(dict(zip(("query", "vid", "score", "first"), out or [[]] * 4)), schema=_FOUND)

    return run


_FOUND = pa.schema([("query", pa.int64()), ("vid", pa.int64()), ("score", pa.float64()), ("first", pa.int64())])


def _dealt(df: DataFrame, hot: DataFrame, own: str, other: str) -> DataFrame:
    """Each row in one of its cell's `own` blocks, and there once for each of the `other` blocks."""
    joined = df.join(hot, "cell", "left").withColumns({own: F.coalesce(own, F.lit(1)), other: F.coalesce(other, F.lit(1))})
    joined = joined.withColumn(f"{own}_at", F.pmod(F.xxhash64("vid"), F.col(own)).cast("int"))
    return joined.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other).cast("int") - 1))).drop(own, other)


def meet(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`query, vid, score, first`: the k nearest rows that each query meets in the cells it visits, each once.

    Cells of many rows or queries are cut into blocks, and every row block meets every query block, so no group
    exceeds about `BLOCK` rows and `QUERY_BLOCK` queries and no pair of a cell is left out.
    """
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("r"), F.lit(0).cast("long").alias("q")).unionByName(
        queries.groupBy("cell").agg(F.lit(0).cast("long").alias("r"), F.count(F.lit(1)).alias("q"))
    ).groupBy("cell").agg(F.sum("r").alias("r"), F.sum("q").alias("q"))
    hot = counts.where((F.col("r") > BLOCK) & (F.col("q") > 0) | (F.col("q") > QUERY_BLOCK) & (F.col("r") > 0)).select(
        "cell", F.ceil(F.col("r") / BLOCK).alias("rb"), F.ceil(F.col("q") / QUERY_BLOCK).alias("qb")
    )
    hot = keep(hot, "cells")
    keys = ("cell", "rb_at", "qb_at")
    left = _dealt(rows, hot, "rb", "qb").groupBy(*keys)
    right = _dealt(queries, hot, "qb", "rb").groupBy(*keys)
    found = left.cogroup(right).applyInArrow(_closest(k), "query long, vid long, score double, first long")
    found = found.groupBy("query", "vid").agg(F.max("score").alias("score"), F.min("first").alias("first"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first", "vid"))
    return found.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def _everywhere(df: DataFrame) -> DataFrame:
    """All rows of one number of components in a single cell."""
    return df.withColumn("cell", F.col("dim").cast("string"))


def choose_probes(known: DataFrame, asked: DataFrame, bands: dict[int, list[int]], n_rows: int, k: int) -> tuple[int, int]:
    """Digits of a cell and probes per table that reach `RECALL` on `SAMPLE` queries, whose neighbours are found among all rows."""
    sample = keep(asked.orderBy(F.xxhash64("data"), "vid").limit(SAMPLE), "sample")
    true = meet(_everywhere(known), _everywhere(sample), k + 1).where("query <> vid")
    true = true.join(sample.select(F.col("vid").alias("query"), F.col("data").alias("asked"), "dim"), "query")
    pairs = true.join(known.select("vid", "data"), "vid").select("dim", "asked", "data").collect()  # at most SAMPLE * k
    if not pairs:
        return 1, 1
    dims = {r["dim"] for r in pairs}
    widest = max(dims, key=lambda d: sum(r["dim"] == d for r in pairs))
    axes = 2 << max(0, widest - 1).bit_length()
    digits = max(1, int(np.floor(np.log(max(2.0, n_rows / CELL_ROWS)) / np.log(axes))) + (n_rows > CELL_ROWS * axes))
    while True:
        ranks = np.concatenate([_ranks([r for r in pairs if r["dim"] == d], d, digits) for d in dims])
        need = int(np.sort(ranks)[int(np.ceil(RECALL * len(ranks))) - 1]) + 1
        if digits == 1 or need <= PROBES:
            return digits, need
        digits -= 1


def _ranks(pairs: list, dim: int, digits: int) -> np.ndarray:
    """For each pair the first probe of any table that visits the neighbour's cell."""
    asked = lengths(_matrix(pa.array([r["asked"] for r in pairs]), dim))[0]
    units = lengths(_matrix(pa.array([r["data"] for r in pairs]), dim))[0]
    count = PROBES if digits > 1 else 2 << max(0, dim - 1).bit_length()
    least = np.full(len(pairs), count, np.int64)
    for t, at in itertools.product(range(TABLES), range(0, len(pairs), 256)):
        met = probes(asked[at:at + 256], t, digits, count) == cells(units[at:at + 256], t, digits)[:, None]
        least[at:at + 256] = np.minimum(least[at:at + 256], np.where(met.any(axis=1), met.argmax(axis=1), count))
    return least


def _fits(vector: Column) -> Column:
    """Finite components, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`query_id, rank, vec_id, score`: for each row that is a query its k nearest others by inner product, nearest first.

    Approximate: which rows are found depends on the cells; scores, ranks among the rows found and their number (k, or
    all others if fewer) do not. Ties go to the smaller id, rows without id last. Equal vectors are searched once and
    listed by their smallest ids. Rows with a vector that is null, zero, or holds null or non-finite components take no
    part; vectors meet only others of as many components. A row that repeats is a candidate for its twin, not for itself.
    A row without id is never a query. Other columns may have any name.
    """
    plain = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).alias("id"), F.coalesce(is_query & F.col(id_column).isNotNull(), F.lit(False)).alias("asks"), plain.alias("vec"))
    rows = rows.where(_fits(F.col("vec")))
    order = Window.partitionBy("vec").orderBy(F.col("id").asc_nulls_last())
    members = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).groupBy("vec").agg(
        F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))).alias("ids")
    )
    known = keep(members.select(
        F.monotonically_increasing_id().alias("vid"), F.col("ids")[0]["id"].alias("first"), F.size("vec").alias("dim"), "vec", "ids"
    ), "vectors")
    packed = keep(_packed(known), "packed")
    n_rows = packed.count()
    bands: dict[int, list[int]] = {}
    for r in packed.select("dim", "band").distinct().collect():  # one for each order of magnitude of a length
        bands.setdefault(r["dim"], []).append(r["band"])
    packed = packed.drop("band")
    asking = rows.where("asks").select("vec").distinct().join(known.select("vec", "vid"), "vec").select("vid")
    asked = keep(packed.join(asking, "vid", "left_semi"), "asked")
    digits, count = choose_probes(packed, asked, bands, n_rows, k)
    placed = packed.mapInArrow(_rows_in_cells(digits), "cell string, vid long, first long, dim int, data binary")
    sent = asked.mapInArrow(_queries_to_cells(digits, count, bands), "cell string, vid long, dim int, data binary")
    with batch_rows(packed.sparkSession, ROWS):
        found = keep(meet(keep(placed, "placed"), keep(sent, "sent"), k + 1), "found")
    # Too few were met: those queries go through all rows, block by block.
    enough = found.groupBy("query").count().where(F.col("count") > k).select(F.col("query").alias("vid"))
    short = keep(without(asked, enough, "vid"), "short")
    few = short.limit(1).count() > 0
    if few:
        rest = meet(_everywhere(packed), _everywhere(short), k + 1)
        found = found.join(short.select(F.col("vid").alias("query")), "query", "left_anti").unionByName(rest)
    entry = F.struct((-F.col("score")).alias("less"), "member.none", "member.id", "vid")
    lists = found.join(known.select("vid", "ids"), "vid").withColumn("member", F.explode("ids")).groupBy("query").agg(
        F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("list")
    )
    listed = known.select("vid", "vec").join(lists.withColumnRenamed("query", "vid"), "vid").withColumnRenamed("vid", "own")
    each = rows.where("asks").select(F.col("id").alias("query_id"), "vec").join(listed, "vec")
    at = F.array_position(F.transform("list", lambda x: F.struct(x["vid"].alias("v"), x["id"].alias("i"))), F.struct(F.col("own").alias("v"), F.col("query_id").alias("i")))
    others = each.withColumn("_at", at).select(
        "query_id", F.posexplode(F.slice(F.filter("list", lambda x, i: i + 1 != F.col("_at")), 1, k)).alias("n", "x")
    )
    return others.select("query_id", (F.col("n") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def _packed(known: DataFrame) -> DataFrame:
    """Vectors as bytes, with their length bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.asarray(v, np.float64).tobytes() for v in batch.column("vec").to_pylist()]
            band = [int(lengths(np.frombuffer(d).reshape(1, -1))[1][0]) for d in data]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vid"), batch.column("first"), batch.column("dim"), pa.array(data, pa.binary()), pa.array(band, pa.int64())],
                ["vid", "first", "dim", "data", "band"],
            )

    return known.select("vid", "first", "dim", "vec").mapInArrow(run, "vid long, first long, dim int, data binary, band long")
