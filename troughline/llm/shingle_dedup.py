"""Near copies by exact Jaccard similarity of word-shingle sets: SimHash fingerprints first, then what they miss.

Fingerprints of the texts' distinct words meet within `DISTANCE` bits by the generalised pigeonhole principle; every pair
they give is verified on whole sets. A fingerprint can miss a pair, so sets that it left in different groups also meet on
the members of their prefixes (with length and positional filters), which loses none. Only members that two sets hold
stay after the one exchange that brings equal members together. A group of thousands of near copies would meet in all
its pairs, so sets are linked in rows before: along each member's list, from one group to the next, each set to the one
it meets most often. Pairs are held against parity sketches before whole texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troughline.llm.common import FEW_IDS, batch_rows, give_back, keep, rows_of, words_of
from troughline.llm.components import components
from troughline.llm.simhash_dedup import close_pairs, majority

SEED = 42
#: Documents, or pairs of them, in an Arrow batch: whole texts and their sketches have no bound.
BATCH = 256
#: Slack of bounds computed in floating point; it only lets more candidates through.
SLACK = 1e-9
#: Bits in which fingerprints of near copies may differ: 45 of the 48 close pairs of sf0.1 are within.
DISTANCE = 7
#: Rounds of linking, by fingerprints and then in rows; they lower the number of pairs and do not change the groups.
ROUNDS = 2
#: Bits of a sketch for each member of the set.
PER_MEMBER = 2
#: Hashes whose bits are summed one by one; histograms are faster for more.
FEW_WORDS = 2000
#: Words of 64 bits of the short sketch that travels with the members of prefixes.
MAPS = [f"m{i}" for i in range(8)]


def shingle_set(text: str | None, words: int) -> set[bytes]:
    """Distinct shingles of `words` words; a shorter text is one shingle, one without words none."""
    w = words_of(text)
    if len(w) < words:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*[w[i:] for i in range(words)])))


def prefix_length(n: int, least: float) -> int:
    """Members, first in any fixed order, of which two sets share one if their Jaccard similarity is at least `least`."""
    return n - math.ceil(n * least - SLACK) + 1 if n else 0


def sketch(hashes: np.ndarray, size: int = 0) -> bytes:
    """Parity of the members in each of a power of two of cells. A sketch of double length folds onto one by exclusive or."""
    size = size or 1 << max(6, math.ceil(math.log2(max(1, PER_MEMBER * len(hashes)))))
    cells = (hashes & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound, from two sketches, of the number of members that only one of the sets holds."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        half = len(a) // 2
        a = (int.from_bytes(a[:half], "little") ^ int.from_bytes(a[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def word_fingerprint(text: str | None) -> int:
    """SimHash of the text's distinct words, as a signed number; zero where there is none."""
    own = set(words_of(text))
    if not own:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in own), np.uint64, len(own))
    if len(own) > FEW_WORDS:
        return int(np.uint64(majority(hashes)).view(np.int64))
    sums = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(sums * 2 > len(own), bitorder="little").view("<i8")[0])


def _sets(rows: DataFrame, words: int, least: float) -> DataFrame:
    """`row, digest, n, prefix, bits, fp, m0..m7`: the whole set as 16 bytes, its size, its smallest hashes, its sketch,
    its text's fingerprint and its sketch of fixed length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for (text,) in rows_of([batch], "t"):
                own = shingle_set(text, words)
                hashes = np.sort(np.fromiter((digest(s, SEED) for s in own), np.uint64, len(own)))
                prefix = hashes[:prefix_length(len(own), least)].view(np.int64)
                short = np.frombuffer(sketch(hashes, 64 * len(MAPS)), "<i8").tolist()
                out.append((xxhash.xxh3_128_digest(hashes.tobytes()), len(own), prefix, sketch(hashes), word_fingerprint(text), *short))
            cols = list(zip(*out)) or [()] * (5 + len(MAPS))
            types = [pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary(), *[pa.int64()] * (1 + len(MAPS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, cols, types)], names=["row", "digest", "n", "prefix", "bits", "fp", *MAPS]
            )
        give_back()

    schema = "row long, digest binary, n int, prefix array<long>, bits binary, fp long, " + ", ".join(f"{m} long" for m in MAPS)
    with batch_rows(rows.sparkSession, BATCH):
        return keep(rows.select("row", "t").mapInArrow(run, schema), "shingles")


def _only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the one-column table `ids`; they move only if the list is too long to broadcast."""
    short = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
    return rows.join(F.broadcast(ids) if short else ids, key, "left_semi")


def _possible(n_a: Column, at_a: Column, n_b: Column, at_b: Column, least: float) -> Column:
    """Whether sets of these sizes that share a prefix member at these positions can be alike.

    Only the first shared member is sure to pass: from there on both sets must hold enough.
    """
    need = (n_a + n_b) * (least / (1 + least)) - SLACK
    return F.least(n_a - at_a, n_b - at_b) >= need


def _postings(nodes: DataFrame) -> DataFrame:
    """`k, node, n, at`: prefix members that at least two nodes hold."""
    posted = nodes.select("node", "n", F.posexplode("prefix").alias("at", "k"))
    held = posted.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy("k")))
    return keep(held.where("_m > 1").drop("_m"), "postings")


def _grouped(postings: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return postings.withColumn("root", F.col("node"))
    return postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs `a, b` of nodes whose fingerprints are close; nodes of one fingerprint meet the smallest of them."""
    prints = keep(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("c")), "prints")
    same = nodes.select("node", "fp").join(prints.where("c > 1"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    close = keep(close_pairs(prints.select("fp"), DISTANCE), "near-prints")
    side = lambda s: prints.select(F.col("fp").alias(s), F.col("first").alias(f"first_{s}"))
    other = close.join(side("a"), "a").join(side("b"), "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return same.union(other)


def _in_rows(grouped: DataFrame, least: float) -> DataFrame:
    """For each node at most one pair `a, b` with a node of another group: the one it follows in most lists."""
    order = Window.partitionBy("k").orderBy("root", "node")
    before = F.lag(F.struct("node", "root", "n", "at")).over(order)
    met = grouped.withColumn("p", before).where((F.col("p.root") != F.col("root")) & _possible(F.col("n"), F.col("at"), F.col("p.n"), F.col("p.at"), least))
    counted = met.groupBy("node", F.col("p.node").alias("other")).agg(F.count(F.lit(1)).alias("c"))
    best = counted.groupBy("node").agg(F.max_by("other", F.struct("c", "other")).alias("other"))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _pair_by_pair(grouped: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """All pairs `a, b` of nodes of different groups that share a prefix member and that sizes, positions and short sketches leave possible."""
    dealt = grouped.join(nodes.select("node", *MAPS), "node").repartition("k")  # both sides of the join are this one exchange
    left, right = (dealt.select("k", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "n", "at", *MAPS)]) for s in "ab")
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
    differ = reduce(add, [F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in MAPS])
    alike = differ <= (F.col("n_a") + F.col("n_b")) * ((1 - least) / (1 + least)) + SLACK
    met = left.join(right, "k").where(apart & _possible(*[F.col(c) for c in ("n_a", "at_a", "n_b", "at_b")], least) & alike)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _close(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs whose sketches leave a similarity of `least` possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                (a, b) for a, b, n_a, n_b, x, y in rows_of([batch], "a", "b", "n_a", "n_b", "bits_a", "bits_b")
                if least_difference(x, y) <= (n_a + n_b) * (1 - least) / (1 + least) + SLACK
            ]
            cols = list(zip(*good)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    with batch_rows(nodes.sparkSession, BATCH):  # a sketch grows with its text
        return keep(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long"), "close")


def _alike(pairs: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs whose whole shingle sets reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, held, last = [], set(), None
            for a, b, x, y in rows_of([batch], "a", "b", "ta", "tb"):
                if last != a:
                    held, last = shingle_set(x, words), a
                other = shingle_set(y, words)
                common = len(held & other)
                if common >= least * (len(held) + len(other) - common) - SLACK:
                    good.append((a, b))
            cols = list(zip(*good)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    named = keep(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), "named")
    texts = keep(_only(rows.select("row", "t"), named, "row"), "texts")
    second = pairs.join(texts.select(F.col("row").alias("b"), F.col("t").alias("tb")), "b")
    both = second.join(texts.select(F.col("row").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb")
    with batch_rows(rows.sparkSession, BATCH):
        return keep(both.mapInArrow(run, "a long, b long"), "alike")


def near_copies(rows: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """`row, root`: each row (`row`, a distinct number, and its text `t`) and the smallest row reachable over links.

    Two rows are linked if the Jaccard similarity of their shingle sets is at least `least`: all rows that such links
    connect share a root, and no others. Close fingerprints give most links, shared members the others. Equal sets are one node, so copies never form pairs; texts without words are
    equal. A null text counts as empty. Many sets that share a member and are not alike meet in pairs nonetheless.
    """
    sets = _sets(rows, words, least)
    first = keep(sets.groupBy("digest").agg(F.min("row").alias("node")), "first")
    nodes = _only(sets, first.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "n", "prefix", "bits", "fp", *MAPS)
    postings, links, roots = _postings(nodes), None, None
    for turn in range(ROUNDS + 1):
        grouped = _grouped(postings, roots)
        met = _by_fingerprint(nodes) if not turn else _in_rows(grouped, least) if turn < ROUNDS else _pair_by_pair(grouped, nodes, least)
        pairs = keep(met, "pairs")
        found = _alike(_close(pairs, nodes, least), rows, words, least)
        if not found.limit(1).count() and turn < ROUNDS:
            continue
        links = found if links is None else links.union(found)
        roots = keep(components(links), "roots")
    rooted = first.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return sets.select("row", "digest").join(rooted, "digest").select("row", "root")
