"""Mixing sources to target weights: fixed-length blocks drawn into output shards through index permutations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troughline.functions.keys import join_per_group
from troughline.llm.common import WORD, even_parts, id_ranges, keep, shuffle_width, text_of

#: Words in a block; a source's mix misses its target by less than one block.
BLOCK = 64
#: Block slots in an output shard, on average.
SHARD = 4096
#: No source gives more than this many times its size.
MOST = 3
WEIGHTS = (5, 2, 1)
#: Rounds of a permutation, and times an index is sent round again at most: each time fewer than 1 in sqrt(n) stay outside.
ROUNDS, WALKS = 4, 40
#: Up to so many sources, a row for each is broadcast; beyond, rows meet it in a salted join.
FEW_SOURCES = 50_000
#: Slots of a source that one row unfolds to.
RUN = 1 << 14
#: Documents that one running sum is meant to hold.
PER_SUM = 4_096


def _to_source(rows: DataFrame, per_source: DataFrame, n_sources: int, spread: str) -> DataFrame:
    """Rows with their source's columns; `src_key` marks the null source."""
    if n_sources <= FEW_SOURCES:
        return rows.join(F.broadcast(per_source), "src_key")
    return join_per_group(rows, per_source, ["src_key"], F.col(spread)).drop("_salt")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`src_key, src, source_size, target` per source, from `src_key` and `size` rows.

    Sources are ranked by code point, null last, and weigh `weights` in turn. Targets share the
    total size by weight; one above `most` times its source's size stops there and the excess is
    shared again. In order of (limit / weight) the sources that stop come first, so running sums
    give the level at which the rest share, without iterating.
    """
    per = sizes.groupBy("src_key").agg(F.sum("size").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy("src_key")) - 1).alias("src")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    ranked = per.select("src_key", "source_size", rank).withColumn("w", cycle).withColumn("most", most * F.col("source_size"))
    # One row per source in these windows, whatever the number of documents.
    order = Window.orderBy(F.col("most") / F.col("w"), "src")
    stopped = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_w = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(Window.partitionBy(F.lit(0))) - stopped) / open_w
    levels = ranked.withColumn("level", level).withColumn("holds", F.col("level") * F.col("w") <= F.col("most"))
    first = F.min_by(F.when(F.col("holds"), F.col("level")), F.when(F.col("holds"), F.struct(F.col("most") / F.col("w"), "src")))
    share = F.coalesce(first.over(Window.partitionBy(F.lit(0))), F.lit(0.0))
    return levels.withColumn("target", F.least(share * F.col("w"), F.col("most").cast("double"))).select(
        "src_key", F.col("src").cast("long").alias("src"), "source_size", "target"
    )


def permuted(slot: Column, n: Column, src: Column) -> Column:
    """Block index of a slot: a keyed pseudorandom permutation of 0..n-1, another for each source.

    A Feistel network of `ROUNDS` rounds over an a x b grid with a * b >= n > (a - 1) * b or so; an index that falls on the few
    grid places beyond n goes round again (cycle walking), which ends as every place is visited once.
    """
    a = F.ceil(F.sqrt(n.cast("double")))
    b = F.ceil(n / a)

    def once(x: Column) -> Column:
        halves = [x % a, F.floor(x / a)]
        for j in range(ROUNDS):
            own, size = j % 2, (a, b)[j % 2]
            halves[own] = (halves[own] + draw(size, src, F.lit(j), halves[1 - own])) % size
        return (halves[1] * a + halves[0]).cast("long")

    first = once(slot.cast("long"))
    again = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    lost = F.expr("CAST(raise_error('an index was not walked back') AS BIGINT)")
    return F.when(first < n, first).otherwise(F.when(again < n, again).otherwise(lost))


def draw(shards: Column, *parts: Column) -> Column:
    """Seeded uniform draw of an output shard, the same in every run."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % shards


def slots(per_source: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per slot of the mix: `shard, src, slot, block, length`; `length` is below `block` only in a source's last slot.

    The targets fix how many slots a source has. Every slot draws its shard, so that a shard's
    counts of sources are a multinomial draw, given these totals. Slot s of a source takes the
    block that the source's permutation puts at s; after the last block it starts again.
    """
    words = F.round("target").cast("long")
    n = F.ceil(F.col("source_size") / block)
    rest = words % F.col("source_size")
    known = per_source.where("source_size > 0").withColumns({
        "n": n, "full": words.cast("long") - rest, "rest": rest,
    }).withColumn("count", (F.expr("full div source_size") * F.col("n") + F.expr(f"(rest + {block - 1}) div {block}")).cast("long"))
    total = known.agg(F.sum("count")).first()[0] or 0
    runs = known.where("count > 0").withColumn("run", F.explode(F.sequence(F.lit(0), F.expr(f"(count - 1) div {RUN}"))))
    spread = runs.repartition(shuffle_width(per_source), "src", "run")
    each = spread.withColumn("slot", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + (RUN - 1), F.col("count") - 1))))
    last = (F.col("slot") == F.col("count") - 1) & (F.col("rest") % block > 0)
    return each.select(
        draw(F.lit(even_parts(total, shard)), F.col("src"), F.col("slot")).alias("shard"), "src", "slot",
        permuted(F.col("slot") % F.col("n"), F.col("n"), F.col("src")).alias("block"),
        F.when(last, F.col("rest") % block).otherwise(F.lit(block)).cast("long").alias("length"),
    )


def placed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """Documents with their first word's place in their source's stream, the sources, and their number.

    The stream of a source runs in order of id (null first, ties by size). It is summed in ranges of ids:
    the ranges' sums first, then inside each range, so a hot source is never one task.
    """
    src_key = F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"))
    sizes = keep(docs.select(
        F.col(key).alias("id"), src_key.alias("src_key"), F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size")
    ), "sizes")
    per_source = keep(targets(sizes), "sources")
    n_sources = per_source.count()
    part = F.coalesce(id_ranges(sizes, "id", sizes.count(), PER_SUM), F.lit(-1).cast("long"))
    known = _to_source(sizes, per_source, n_sources, "id").withColumn("part", part)
    sums = known.groupBy("src", "part").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("src", "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("off"))
    inside = Window.partitionBy("src", "part").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("off") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    out = known.join(offsets, ["src", "part"]).withColumn("start", start).withColumn("row", F.monotonically_increasing_id())
    return keep(out.select("row", "id", "src", "size", "source_size", "target", "start"), "placed"), per_source, n_sources


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per document: `key, size, source_size, target, taken, first_shard`.

    `size` counts words (null text: 0); `taken` the words that the mix takes of it, repeats
    counted, at most three times its size; `first_shard` the lowest output shard with any of
    them, null where none is taken. Rows that repeat an id are mixed each. A table without words
    has targets of 0. An empty table gives no rows; other columns are ignored.
    """
    rows, per_source, _ = placed(docs, key, text, source)
    used = slots(per_source, block, shard).groupBy("src", "block").agg(
        F.sum(F.when(F.col("length") == block, 1).otherwise(0)).alias("times"),
        F.max(F.when(F.col("length") < block, F.col("length"))).alias("part"), F.min("shard").alias("shard"),
    )
    last = F.greatest(F.col("start") + F.col("size") - 1, F.col("start"))
    cells = rows.where("size > 0").select("row", "src", "start", "size", F.explode(
        F.sequence(F.expr(f"start div {block}"), F.floor(last / block))
    ).alias("block"))
    # Both sides grow with the words, but a planner sees only the few source rows that slots unfold from.
    met = cells.join(used.hint("merge"), ["src", "block"])
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    partly = F.greatest(F.least(end, F.col("block") * block + F.coalesce("part", F.lit(0))) - begin, F.lit(0))
    got = F.col("times") * (end - begin) + partly
    taken = met.select("row", got.alias("got"), F.when(got > 0, F.col("shard")).alias("shard")).groupBy("row").agg(
        F.sum("got").alias("taken"), F.min("shard").alias("first_shard")
    )
    return rows.join(taken, "row", "left").select(
        F.col("id").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_shard"
    )


def copies(taken: Column, size: Column, key: Column) -> Column:
    """Whole copies that stand for `taken` words: rounded down or up by a draw named by the id, right on average."""
    chance = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / (1 << 32)
    return F.when(size > 0, F.floor(taken / size + chance)).otherwise(F.lit(0)).cast("int")
