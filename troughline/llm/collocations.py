"""Collocations by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a cycle. A phrase starts to be counted (is active) at the first
shard after both its subphrases, without the last and without the first word, have reached the threshold in what was
scanned so far; so lengths are interleaved instead of one pass for each. It is counted for one full cycle, which
makes its count whole, wherever in the cycle it started. The empty phrase counts all words.

Scanning tasks learn what is active from a table of fixed size (`SLOTS` bytes) that holds, for the hash of a reached
phrase, the step at which longer phrases may start. Two phrases that share a slot can only make a task count a phrase
too early or too long, and a shard is entered once into a phrase's total, so counts are exact however full the table is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troughline.llm.common import LOWER, UPPER, batch_rows, keep, pack, text_of, unpack
from troughline.session import scratch_path

#: Shards of a cycle; bytes of the table of reached phrases; bytes of text that a task counts at once.
SHARDS, SLOTS, CHUNK = 2, 1 << 24, 12 << 20
LONGEST = 4
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = np.frombuffer(bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode())), np.uint8)
_IS_END = np.isin(np.arange(256), list(_ENDS))
_IS_GAP = np.isin(np.arange(256), list(_ENDS + _BLANKS))
_CODED = "shard int, lang string, words binary, codes binary, begins binary"
_COUNTS = "lang string, n int, phrase string, c long, slot int, until int"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(32))


def _slots(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes & np.uint64(size - 1)).astype(np.int64)


def _parts(text: bytes) -> Iterator[bytes]:
    """A text of more than `CHUNK` bytes in parts that end where a piece ends."""
    at = 0
    while len(text) - at > CHUNK:
        nearest = max(text.rfind(bytes([e]), at, at + CHUNK) for e in _ENDS)
        if nearest < 0:  # a single piece over this length stays whole
            later = [p for e in _ENDS if (p := text.find(bytes([e]), at + CHUNK)) >= 0]
            if not later:
                break
            nearest = min(later)
        yield text[at:nearest]
        at = nearest + 1
    yield text[at:]


def _coded(lang: str, texts: list[bytes], shard: int) -> pa.RecordBatch:
    """Words of some texts of a language as numbers, with the words they stand for and a mark where a piece begins."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    gap = _IS_GAP[raw]
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    piece = np.cumsum(_IS_END[raw], dtype=np.int32)[start]
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[~gap]])])
    coded = words.dictionary_encode()
    begins = np.packbits(np.diff(piece, prepend=-1) > 0)
    return pa.RecordBatch.from_arrays([
        pa.array([shard], pa.int32()), pa.array([lang]), pa.array([pack(np.frombuffer(b"\n".join(coded.dictionary.to_pylist()), np.uint8))], pa.binary()),
        pa.array([pack(np.asarray(coded.indices).astype(np.int32))], pa.binary()), pa.array([pack(begins)], pa.binary()),
    ], ["shard", "lang", "words", "codes", "begins"])


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as coded chunks, which go round the shards."""
    held: dict[str, list[bytes]] = {}
    size, shard = 0, TaskContext.get().partitionId() % SHARDS
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for part in _parts(text.encode()):
                held.setdefault(lang, []).append(part)
                size += len(part) + 1
                if size >= CHUNK:
                    yield from (_coded(name, texts, shard) for name, texts in held.items())
                    held, size, shard = {}, 0, (shard + 1) % SHARDS
    yield from (_coded(name, texts, shard) for name, texts in held.items())


def _counted(step: int, latest: np.ndarray, lang: str, distinct: list[bytes], code: np.ndarray, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of a chunk that are active at `step`; `until`: the last step of a phrase's cycle."""
    total, size = len(code), len(distinct)
    seed = xxhash.xxh64_intdigest(lang.encode())
    hashed = np.array([xxhash.xxh64_intdigest(w, seed=seed) for w in distinct], np.uint64)
    if step < SHARDS:
        n = np.bincount(code, minlength=size)
        yield _batch(lang, 0, [b""], np.array([total]), np.zeros(1), np.array([SHARDS - 1]))
        yield _batch(lang, 1, distinct, n, _slots(hashed, len(latest)), np.full(size, SHARDS - 1))
    piece = np.cumsum(begins, dtype=np.int32)
    # For the phrases of one length less at every place: hash, step at which longer ones start (0: never).
    hashes, first, pair_code = hashed[code], latest[_slots(hashed, len(latest))][code], None
    for length in range(2, LONGEST + 1):
        places = total - length + 1
        if places <= 0 or not first.any():
            return
        within = piece[:places] == piece[length - 1:]
        until = np.maximum(first[:places], first[1:places + 1]).astype(np.int16) + SHARDS - 1
        both = within & (first[:places] > 0) & (first[1:places + 1] > 0)
        hashes = _mix(hashes[:places], hashes[1:places + 1])
        at = np.flatnonzero(both & (until >= step))
        if len(at):
            if length == 2:
                key = code[at].astype(np.int64) * size + code[at + 1]
            else:  # dense numbers of neighbouring words, so that longer keys fit 64 bits
                if pair_code is None:
                    pair_code = np.unique(code[:-1].astype(np.int64) * size + code[1:], return_inverse=True)[1]
                    pairs = int(pair_code.max()) + 1
                key = pair_code[at] * size + code[at + 2] if length == 3 else pair_code[at] * pairs + pair_code[at + 2]
            _, where, n = np.unique(key, return_index=True, return_counts=True)
            place = at[where]
            parts = [map(distinct.__getitem__, code[place + i].tolist()) for i in range(length)]
            yield _batch(lang, length, list(map(b" ".join, zip(*parts))), n, _slots(hashes[place], len(latest)), until[place])
        # A phrase that no task may have counted cannot have reached the threshold.
        first = np.where(both, latest[_slots(hashes, len(latest))], 0)


def _batch(lang: str, n: int, phrases: list[bytes], counts: np.ndarray, slots: np.ndarray, until: np.ndarray) -> pa.RecordBatch:
    size = len(phrases)
    return pa.RecordBatch.from_arrays([
        pa.array([lang] * size, pa.string()), pa.array(np.full(size, n, np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()),
        pa.array(counts.astype(np.int64)), pa.array(slots.astype(np.int32)), pa.array(until.astype(np.int32)),
    ], ["lang", "n", "phrase", "c", "slot", "until"])


def _scan(step: int, latest):
    """Counting of one shard; `latest` is the broadcast table of reached phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, codes, begins in zip(*[batch.column(c).to_pylist() for c in ("lang", "words", "codes", "begins")]):
                code = unpack(codes, "int32")
                if len(code):
                    starts = np.unpackbits(unpack(begins, "uint8"), count=len(code))
                    yield from _counted(step, latest.value, lang, unpack(words, "uint8").tobytes().split(b"\n"), code, starts)

    return run


def _entered(step: int, state: DataFrame | None, found: DataFrame, threshold: int) -> DataFrame:
    """Totals after this step. A shard's count enters once, though a phrase may be counted in it again."""
    bit = 1 << (step % SHARDS)
    new = found.select("lang", "phrase", "n", "slot", "until", "c", F.lit(None).cast("long").alias("old"), F.lit(0).alias("mask"))
    if state is not None:
        new = new.unionByName(state.select("lang", "phrase", "n", "slot", "until", F.lit(None).cast("long").alias("c"), F.col("total").alias("old"), "mask"))
    met = new.groupBy("lang", "phrase").agg(
        F.max("n").alias("n"), F.max("slot").alias("slot"), F.max("until").alias("until"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.max("old"), F.lit(0)).alias("old"), F.max("mask").alias("mask"),
    )
    seen = F.col("mask").bitwiseAND(F.lit(bit)) > 0
    met = met.withColumn("total", F.col("old") + F.when(seen, 0).otherwise(F.col("c")))
    met = met.withColumn("mask", F.when(F.col("c") > 0, F.col("mask").bitwiseOR(F.lit(bit))).otherwise(F.col("mask")))
    # Frequent phrases stay after their cycle: one that is counted again must not reach the threshold a second time.
    frequent = (F.col("total") >= threshold) | (F.col("n") == 0)
    return met.where((F.col("until") > step) | frequent).withColumn("reached", (F.col("total") >= threshold) & (F.col("old") < threshold))


def _new_slots(state: DataFrame) -> np.ndarray:
    """Slots of the phrases that reached the threshold in this step, as bitmaps: `SLOTS` bits at most."""
    spot = (F.col("slot") + 1).cast("long")
    reached = state.where("reached AND n BETWEEN 1 AND 3").select(F.bitmap_bucket_number(spot).alias("b"), F.bitmap_bit_position(spot).alias("p"))
    out = [np.zeros(0, np.int64)]
    for row in reached.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect():
        bits = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little")
        out.append(np.flatnonzero(bits) + (row["b"] - 1) * len(bits))
    return np.concatenate(out)


def phrase_counts(docs: DataFrame, text: Column, lang: Column, threshold: int = 30) -> DataFrame:
    """`lang, n, phrase, f`: exact counts of all phrases of 1 to 4 words that occur `threshold` times or more in a language,
    and of all words as the empty phrase (n = 0).

    Every step scans one shard, and steps end a full cycle after the last phrase reached the threshold (four cycles at most).
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    with batch_rows(spark, 256):
        coded = docs.select(lang.alias("lang"), text.alias("text")).mapInArrow(_code, _CODED)
        coded.write.partitionBy("shard").parquet(path)
    shards = spark.read.schema(_CODED).parquet(path)
    latest = np.zeros(SLOTS, np.uint8)
    state, step, last = None, 0, 0
    with batch_rows(spark, 1):  # a row is a whole chunk
        while step <= max(last + SHARDS, SHARDS - 1):
            known = spark.sparkContext.broadcast(latest)
            shard = shards.where(F.col("shard") == step % SHARDS).select("lang", "words", "codes", "begins")
            found = shard.mapInArrow(_scan(step, known), _COUNTS)
            state = keep(_entered(step, state, found, threshold), "phrases")
            slots = _new_slots(state)
            latest[slots] = step + 1
            last = step if len(slots) else last
            known.unpersist()
            step += 1
    return state.where((F.col("total") >= threshold) | (F.col("n") == 0)).select("lang", "n", "phrase", F.col("total").alias("f"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = 30, cover: int = 80, top: int = 2000) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: each language's best phrases of 2 to 4 words.

    Texts are lower-cased (A-Z) and cut at `.,;:!?` and line ends into pieces, those at blanks and tabs into words. A phrase
    that occurs `a >= threshold` times scores `floor(2000000 * a / (l + r))` at its worst cut into two parts that occur l and r
    times (ties: the shortest first part). It is dropped where a longer phrase that also reached the threshold holds it and
    occurs `cover` percent as often or more. Ranks follow score, count, then the phrase by bytes.

    Null texts count as empty, a null language as `und`; empty texts and tables give nothing; repeated rows count each time.
    Other columns are not read. A piece stays whole in memory; texts of any length are counted part by part.
    """
    f = keep(phrase_counts(docs, text_of(text), F.coalesce(F.col(lang), F.lit("und")), threshold), "counts")
    found = f.where("n >= 2").select("lang", "phrase", "n", F.col("f").alias("a"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(head) + 2)"))
    part = f.where("n BETWEEN 1 AND 3").select("lang", F.col("phrase").alias("part"), "f")
    met = cuts.join(part.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    met = met.join(part.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0))) AS BIGINT)")
    scored = met.withColumn("score", score).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # Each longer phrase tells the phrases inside it how often it occurs.
    inner = F.expr("flatten(transform(sequence(2, n - 1), k -> transform(sequence(1, n - k + 1), i -> array_join(slice(split(phrase, ' ', -1), i, k), ' '))))")
    held = found.where("n >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = scored.join(held, ["lang", "phrase"], "left").where(
        F.expr(f"longer IS NULL OR CAST(100 AS DECIMAL(3, 0)) * CAST(longer AS DECIMAL(19, 0)) < CAST({cover} AS DECIMAL(3, 0)) * CAST(a AS DECIMAL(19, 0))")
    )
    free = free.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    words = f.where("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
