"""SimHash near-duplicates by the generalised pigeonhole principle over unequal bit groups."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troughline.functions.keys import hash_order
from troughline.llm.common import batch_rows, keep, rows_of, shuffle_width, words_of
from troughline.llm.components import components

BITS = 64
SEED = 42
#: Bound of the sample on which bit correlations and candidate counts are estimated; only the cost depends on it.
SAMPLE = 4096
#: Numbers of bit groups that are tried.
GROUPS = (2, 3, 4)
#: Buckets above this size are linked through midpoints (65 keys a row at most) instead of by pairs.
DENSE = 64
#: Documents in an Arrow batch.
BATCH = 256
#: Hashes whose bits are summed at once.
BLOCK = 1 << 16


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set: a histogram per byte, unfolded."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    sums = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), BLOCK):
        for i, column in enumerate(hashes[at:at + BLOCK].view(np.uint8).reshape(-1, 8).T):
            sums[i] += np.bincount(column, minlength=256) @ bits
    return sums.reshape(-1)


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64-bit number of the bits that are set in over half the hashes."""
    return int(np.packbits((bit_sums(hashes) * 2 > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included; zero where there is no word."""
    w = words_of(text)
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """`id, fp` (a signed long with the fingerprint's bits) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for (t,) in rows_of([batch], "t")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, fp long")


# --- the plan: which bits go together, and how far each group may differ ----------------------------------


def correlated_groups(sample: np.ndarray, groups: int) -> list[list[int]]:
    """Bits in `groups` even sets, each filled with the bits most correlated with what it holds.

    Correlated bits in one set keep the sets' values close to independent, so that few unrelated
    fingerprints agree on a whole set.
    """
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    centred = bits - bits.mean(0)
    spread = np.sqrt((centred ** 2).sum(0)) + 1e-9
    near = np.abs(centred.T @ centred / np.outer(spread, spread))
    left, out = list(range(BITS)), []
    for g in range(groups):
        size = len(left) // (groups - g)
        own = [left.pop(0)]
        while len(own) < size:
            best = max(left, key=lambda b: (near[b, own].sum(), -b))
            own.append(best)
            left.remove(best)
        out.append(sorted(own))
    return out


def _masked(values: np.ndarray, bits: Sequence[int]) -> np.ndarray:
    return values & np.uint64(sum(1 << b for b in bits))


def estimated_cost(sample: np.ndarray, total: int, bits: Sequence[int], radius: int) -> float:
    """Rows and candidates of a bit group at a radius, per fingerprint of the whole table.

    Candidates are the evenly spread ones and those that share the sample's crowded values. A dense
    bucket costs its midpoints, not its pairs.
    """
    if radius < 0:
        return 0.0
    if radius >= len(bits):
        return float("inf")
    probes = sum(math.comb(len(bits), r) for r in range(radius + 1))
    crowd = 0.0
    if len(sample):
        _, at, counts = np.unique(_masked(sample, bits), return_inverse=True, return_counts=True)
        crowd = float(np.minimum((counts[at] - 1) / len(sample) * total, BITS + 1).mean())
    return probes + total * probes / 2.0 ** len(bits) + crowd


def allocate(costs: Sequence[Sequence[float]], distance: int) -> tuple[float, list[int]]:
    """Radii, one per group and -1 for a group left out, that sum to `distance - groups + 1` at the least cost.

    `costs[g][r + 1]` is the cost of group g at radius r. By dynamic programming over the groups:
    if two fingerprints differ in `distance` bits, some group differs in at most its radius.
    """
    target = distance + 1  # sum of (radius + 1) over the groups
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, radii) in best.items():
            for r1, c in enumerate(own):
                if used + r1 <= target and (used + r1 not in step or cost + c < step[used + r1][0]):
                    step[used + r1] = (cost + c, [*radii, r1 - 1])
        best = step
    return best[target]


def plan(sample: np.ndarray, total: int, distance: int) -> list[tuple[list[int], int]]:
    """(bits, radius) of each group to probe, the cheapest over the tried numbers of groups."""
    options = []
    for m in GROUPS:
        sets = correlated_groups(sample, m) if len(sample) else [list(range(64))[g::m] for g in range(m)]
        costs = [[estimated_cost(sample, total, s, r) for r in range(-1, distance + 1)] for s in sets]
        cost, radii = allocate(costs, distance)
        options.append((cost, [(s, r) for s, r in zip(sets, radii) if r >= 0]))
    return min(options, key=lambda o: o[0])[1]


# --- probing ------------------------------------------------------------------------------------------------


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _flips(bits: Sequence[int], radius: int) -> list[int]:
    """Every pattern of at most `radius` of the bits."""
    out = [0]
    for _ in range(radius):
        out = list(dict.fromkeys([*out, *(v ^ (1 << b) for v in out for b in bits)]))
    return out


def _patterns(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(_signed(v)).cast("long") for v in values])


def _probes(home: Column, group: int, flips: Sequence[int]) -> Column:
    """Buckets of a group that a fingerprint looks into."""
    return F.transform(_patterns(flips), lambda v: F.struct(F.lit(group).alias("g"), home.bitwiseXOR(v).alias("k")))


def _planned(distinct: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """The plan for a table of fingerprints, from its sample."""
    drawn = distinct.select("fp", hash_order(["fp"], SEED).alias("o")).orderBy("o").limit(SAMPLE).select("fp").toPandas()
    return plan(np.ascontiguousarray(drawn["fp"].to_numpy(np.int64)).view(np.uint64), distinct.count(), distance)


def close_pairs(distinct: DataFrame, distance: int) -> DataFrame:
    """Pairs `a, b` of distinct fingerprints (`fp`) that differ in at most `distance` bits, by the buckets of the plan.

    Of two buckets that differ, the smaller one's rows probe the larger. Every pair in buckets of up to `DENSE` rows is found.
    In a crowded bucket probes meet the first `DENSE` rows, and each further row the one before it, so the work stays in
    proportion to the rows; a caller that may lose no pair has to look for the others among what is not connected yet.
    """
    groups = [(g, _signed(sum(1 << b for b in bits)), _flips(bits, radius)) for g, (bits, radius) in enumerate(_planned(distinct, distance))]
    distinct = distinct.repartition(shuffle_width(distinct), "fp")  # a few MB of fingerprints become many rows
    whole = lambda **values: F.struct(*[F.lit(v).cast("long").alias(k) for k, v in values.items()])
    looks = F.array(*[whole(g=g, mask=mask, flip=_signed(flip)) for g, mask, flips in groups for flip in flips])
    lives = F.array(*[whole(g=g, mask=mask) for g, mask, _ in groups])
    own = F.col("fp").bitwiseAND(F.col("at.mask"))
    probes = distinct.select("fp", F.explode(looks).alias("at")).select("fp", "at.g", own.alias("own"), own.bitwiseXOR(F.col("at.flip")).alias("k"))
    homes = distinct.select("fp", F.explode(lives).alias("at")).select(F.col("fp").alias("home"), "at.g", own.alias("k"))
    order = Window.partitionBy("g", "k").orderBy("home")
    placed = homes.select("*", F.row_number().over(order).alias("place"), F.lag("home").over(order).alias("before"))
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= distance
    first = placed.where(F.col("place") <= DENSE).select("home", "g", "k")
    # Spark takes exploded rows for as few as they came from, and would broadcast them.
    met = probes.where("k >= own").select("fp", "g", "k").join(first.hint("merge"), ["g", "k"]).where((F.col("fp") != F.col("home")) & near("fp", "home"))
    in_rows = placed.where((F.col("place") > DENSE) & near("before", "home")).select(F.col("before").alias("fp"), "home")
    found = met.select("fp", "home").union(in_rows)
    return found.select(F.least("fp", "home").alias("a"), F.greatest("fp", "home").alias("b")).distinct()


def near_links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Edges `a, b` between distinct fingerprints (`fp`) that differ in 1 to `distance` bits, an even number.

    Each bit group of the plan has buckets by the value on its bits; a fingerprint probes those within the
    group's radius. In small buckets every candidate is verified, so every link is found. In a dense
    bucket pairs would grow with the square of its size; fingerprints of any dense bucket meet in midpoints
    instead: all within `distance / 2` bits of one pattern are within `distance` of each other, and
    every pair that close has such a pattern. Linking each to the pattern's smallest leaves
    the components as they are.
    """
    if distance < 2 or distance % 2:
        raise ValueError("distance must be even: midpoints halve it")
    probing, living = [], []
    for g, (bits, radius) in enumerate(_planned(distinct, distance)):
        home = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        probing.append(_probes(home, g, _flips(bits, radius)))
        living.append(F.struct(F.lit(g).alias("g"), home.alias("k")))
    probes = distinct.select("fp", F.explode(F.concat(*probing)).alias("at")).select("fp", "at.g", "at.k")
    homes = distinct.select(F.col("fp").alias("home"), F.explode(F.array(*living)).alias("at")).select("home", "at.g", "at.k")
    dense = probes.groupBy("g", "k").count().where(F.col("count") > DENSE).select("g", "k")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("home"))) <= distance
    pairs = probes.join(dense, ["g", "k"], "left_anti").join(homes, ["g", "k"]).where((F.col("fp") < F.col("home")) & near)
    crowded = probes.join(dense, ["g", "k"], "left_semi").select("fp").distinct()
    middles = crowded.select("fp", F.explode(
        F.transform(_patterns(_flips(range(BITS), distance // 2)), lambda v: F.col("fp").bitwiseXOR(v))
    ).alias("mid"))
    met = middles.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most share a pattern
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.select(F.col("fp").alias("a"), F.col("home").alias("b")).union(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """One row per document: `key, fingerprint` (16 hex digits), `component_id` (smallest id reachable over links).

    Null and empty texts have fingerprint zero and are linked like any other. Equal fingerprints
    are one node, so copies never form pairs. Rows that repeat an id are all returned. A null id
    gets a component like any other row but names none unless it is alone. An empty table gives no
    rows; other columns are ignored.
    """
    with batch_rows(docs.sparkSession, BATCH):
        prints = keep(fingerprints(docs, key, text, words), "fingerprints")
    nodes = keep(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    reached = components(near_links(nodes.select("fp"), distance))
    rooted = nodes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
