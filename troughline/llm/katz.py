"""Language-model scores: Katz backoff over word pairs with Good-Turing discounts.

Texts are read once, into chunks: a chunk holds the distinct words of some documents and, for every
token, the index of its word. Counting and looking up both go by request and response: a chunk sends
its distinct words (then its distinct pairs of words) to the tasks that own them, these sum the counts
over all chunks, and answer each chunk in the order of its request. So a token never moves, and what
moves is a few bytes for each distinct word or pair of a chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from troughline.llm.common import batch_rows, even_parts, keep, pack, rows_of, shuffle_width, text_of, unpack
from troughline.session import scratch_path

#: Counts up to this are discounted; above, counts are trusted.
TRUSTED = 5
#: Tokens in a chunk, unless its partition has fewer or one document more.
CHUNK = 1_000_000
#: Requested words, pairs that an owning task sums at once.
WORDS, PAIRS = 500_000, 600_000
#: At most this many words count as hot: their pairs are dealt over several owners and their sums broadcast.
HOT_WORDS = 10_000
#: Words a reading task remembers.
REMEMBER = 300_000
BATCH = 256
#: The end of a text is the token with the hash of no characters, which no word has. It also stands before the first word.
END = xxhash.xxh64_intdigest(b"")


class Hashes(dict):
    """Word hashes; words are told apart by 64 bits."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


# --- chunks -------------------------------------------------------------------------------------------------------


_CHUNK = pa.schema([
    ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
    ("tokens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()),
])
_CHUNK_DDL = "chunk long, ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words binary, counts binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, number = Hashes(), 0
    ids, held, sizes, parts, total = [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
        learnt = np.repeat(~np.array(held, bool), sizes)
        counts = np.bincount(tokens[learnt], minlength=len(words))
        chunk = (TaskContext.get().partitionId() << 32) + number
        row = (chunk, ids, held, sizes, pack(tokens.astype("<i4")), pack(np.diff(words, prepend=np.uint64(0))), pack(counts.astype("<i8")))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _CHUNK)], schema=_CHUNK)

    for i, text, out in rows_of(batches, "id", "t", "held"):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        own = np.empty(len(words) + 1, np.uint64)
        own[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        own[-1] = END
        ids.append(i)
        held.append(out)
        sizes.append(len(own))
        parts.append(own)
        total += len(own)
        if total >= CHUNK:
            yield flush()
            number += 1
            ids, held, sizes, parts, total = [], [], [], [], 0
    if ids:
        yield flush()


def chunked(docs: DataFrame, key: str, text: str, held: Column) -> DataFrame:
    """Chunks of all documents, as a table bucketed by chunk: joins to responses leave it in place."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t"), held.alias("held"))
    name = f"chunks_{uuid.uuid4().hex}"
    with batch_rows(spark, BATCH):
        rows.mapInArrow(_read, _CHUNK_DDL).write.bucketBy(shuffle_width(docs), "chunk").option(
            "path", scratch_path(spark, "chunks")
        ).format("parquet").saveAsTable(name)
    return spark.table(name)


# --- words --------------------------------------------------------------------------------------------------------


def _ask_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words, counts in rows_of(batches, "chunk", "words", "counts"):
            words, counts = np.cumsum(unpack(words, "<u8"), dtype=np.uint64), unpack(counts, "<i8")
            # Owners hold ranges of hashes, so a chunk's ascending words fall into consecutive slices.
            edges = np.searchsorted(words, np.array([p * (1 << 64) // parts for p in range(1, parts)], np.uint64))
            edges = [0, *edges.tolist(), len(words)]
            rows = [
                (p, chunk, pack(np.diff(words[a:b], prepend=np.uint64(0))), pack(counts[a:b]))
                for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["part", "chunk", "words", "counts"])

    return run


def _own_words(parts: int):
    def run(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        words = [np.cumsum(unpack(w, "<u8"), dtype=np.uint64) for w in asked["words"]]
        known, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, at, np.concatenate([unpack(c, "<i8") for c in asked["counts"]]))
        part, ends = int(key[0]), np.cumsum([len(w) for w in words])
        rows = []
        for chunk, own in zip(asked["chunk"], np.split(at, ends[:-1])):
            rows.append((chunk, part, pack(np.diff(own.astype("<i8"), prepend=0)), pack(total[own]), None))
        learnt = total[total > 0]
        seen = [len(learnt), int(learnt.sum()), *[int((learnt == r).sum()) for r in range(1, TRUSTED + 2)]]
        rows.append((None, part, None, None, seen))
        return pd.DataFrame(rows, columns=["chunk", "part", "ids", "counts", "seen"]).astype({"chunk": "Int64"})

    return run


@dataclass(frozen=True)
class Discounts:
    """Good-Turing factors of counts 1 to `TRUSTED`; 1 above it, and where the counts of counts allow none."""

    factors: tuple[float, ...]

    @classmethod
    def learn(cls, n: list[int]) -> Discounts:
        """`n[r - 1]` words or pairs occur r times, for r up to `TRUSTED` + 1. Katz's form, so that counts above need no discount."""
        out = []
        lost = (TRUSTED + 1) * n[TRUSTED] / n[0] if n[0] else 1.0
        for r in range(1, TRUSTED + 1):
            turing = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 1.0
            d = (turing - lost) / (1 - lost) if lost < 1 else 1.0
            out.append(d if 0 < d < 1 else 1.0)
        return cls(tuple(out))

    def of(self, counts: np.ndarray) -> np.ndarray:
        table = np.array([0.0, *self.factors, 1.0])
        return table[np.minimum(counts, TRUSTED + 1)]


@dataclass(frozen=True)
class Unigrams:
    """Probabilities of single words; all unknown words are one word, which gets the mass that discounts free."""

    tokens: int
    kinds: int
    discounts: Discounts
    free: float
    scale: float

    @classmethod
    def learn(cls, kinds: int, tokens: int, n: list[int]) -> Unigrams:
        d = Discounts.learn(n)
        lost = sum((1 - f) * r * n[r - 1] for r, f in enumerate(d.factors, 1)) / max(tokens, 1)
        free = max(lost, 1 / (tokens + 1))
        return cls(tokens, kinds, d, free, (1 - free) / (1 - lost))

    def p(self, counts: np.ndarray) -> np.ndarray:
        seen = self.scale * self.discounts.of(counts) * counts / max(self.tokens, 1)
        return np.where(counts > 0, seen, self.free)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


# --- pairs --------------------------------------------------------------------------------------------------------


@dataclass
class Pairs:
    """A chunk's distinct pairs of neighbouring words, in the order of its requests."""

    history: np.ndarray  # global word ids
    word: np.ndarray
    history_count: np.ndarray
    word_count: np.ndarray
    learnt: np.ndarray  # occurrences in this chunk's training documents
    at: np.ndarray  # of each token, its pair
    part: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _pairs(sizes: list[int], held: list[bool], tokens: bytes, words: bytes, answers: list[dict], word_parts: int, parts: int, hot: int) -> Pairs:
    answers = sorted(answers, key=lambda a: a["part"])
    ids = np.concatenate([np.cumsum(unpack(a["ids"], "<i8")) * word_parts + a["part"] for a in answers])
    counts = np.concatenate([unpack(a["counts"], "<i8") for a in answers])
    index = unpack(tokens, "<i4").astype(np.int64)
    known = np.cumsum(unpack(words, "<u8"), dtype=np.uint64)
    before = np.empty_like(index)
    before[1:] = index[:-1]
    before[np.r_[0, np.cumsum(sizes)[:-1]]] = np.searchsorted(known, np.uint64(END))
    pair, at = np.unique(before * len(known) + index, return_inverse=True)
    h, w = pair // len(known), pair % len(known)
    learnt = np.bincount(at[np.repeat(~np.array(held, bool), sizes)], minlength=len(pair))
    history, word, c = ids[h], ids[w], counts[h]
    # A word's pairs share an owner; those of a hot word are dealt over as many owners as its count asks for.
    share = np.maximum(-(-c // hot), 1)
    deal = _mix(history.astype(np.uint64) + (_mix(word.astype(np.uint64)) % share.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))
    part = (deal % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((word, history, part))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return Pairs(history[order], word[order], c[order], counts[w][order], learnt[order], place[at], part[order])


def _ask_pairs(word_parts: int, parts: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, *own in rows_of(batches, "chunk", "sizes", "held", "tokens", "words", "answers"):
            p = _pairs(*own, word_parts, parts, hot)
            edges = np.searchsorted(p.part, np.arange(parts + 1)).tolist()
            rows = []
            for part, (a, b) in enumerate(zip(edges, edges[1:])):
                if b > a:
                    is_hot = np.unique(p.history[a:b][p.history_count[a:b] > hot])
                    rows.append((
                        part, chunk, pack(np.diff(p.history[a:b].astype("<i8"), prepend=0)), pack(p.word[a:b].astype("<i8")),
                        pack(p.learnt[a:b].astype("<i8")), pack(p.word_count[a:b].astype("<i8")), pack(is_hot.astype("<i8")),
                    ))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=_ASKED)

    return run


_ASKED = ["part", "chunk", "history", "word", "learnt", "word_count", "hot"]
_ASKED_DDL = "part long, chunk long, history binary, word binary, learnt binary, word_count binary, hot binary"
_ANSWER_DDL = "kind string, chunk long, part long, counts binary, after binary, n binary, covered binary, seen array<long>"


def _own_pairs(unigrams: Unigrams):
    """Sum the pairs of one owner. Answers: each pair's count, and for histories with an unseen pair in the chunk,
    how many successors occur 1, 2, ... times and the unigram mass of all successors."""

    def run(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        each = [np.cumsum(unpack(h, "<i8")) for h in asked["history"]]
        history, word = np.concatenate(each), np.concatenate([unpack(w, "<i8") for w in asked["word"]])
        learnt = np.concatenate([unpack(c, "<i8") for c in asked["learnt"]])
        order = np.lexsort((word, history))
        new = np.ones(len(order), bool)
        new[1:] = (history[order][1:] != history[order][:-1]) | (word[order][1:] != word[order][:-1])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        total = np.bincount(at, weights=learnt).astype(np.int64)
        first = order[new]
        mass = unigrams.p(np.concatenate([unpack(c, "<i8") for c in asked["word_count"]])[first])
        known, of = np.unique(history[first], return_inverse=True)
        n = np.stack([np.bincount(of[total == r], minlength=len(known)) for r in range(1, TRUSTED + 1)])
        covered = np.bincount(of[total > 0], weights=mass[total > 0], minlength=len(known))
        hot = np.unique(np.concatenate([unpack(h, "<i8") for h in asked["hot"]]))
        rows, end = [], np.cumsum([len(h) for h in each])
        for chunk, own, places in zip(asked["chunk"], each, np.split(at, end[:-1])):
            counts = total[places]
            after = np.setdiff1d(own[counts == 0], hot)
            i = np.searchsorted(known, after)
            rows.append(("chunk", chunk, part, pack(counts), pack(after), pack(n[:, i].reshape(-1).astype("<i8")), pack(covered[i]), None))
        i = np.searchsorted(known, hot)
        if len(hot):
            rows.append(("hot", None, part, None, pack(hot), pack(n[:, i].reshape(-1).astype("<i8")), pack(covered[i]), None))
        rows.append(("seen", None, part, None, None, None, None, [int((total == r).sum()) for r in range(1, TRUSTED + 2)]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _ANSWER_DDL.split(", ")]).astype({"chunk": "Int64"})

    return run


@dataclass(frozen=True)
class Backoff:
    """Everything of the model that has a bound: the unigram facts, both orders' discounts, sums of hot histories."""

    unigrams: Unigrams
    discounts: Discounts
    hot: np.ndarray
    hot_n: np.ndarray
    hot_covered: np.ndarray

    def seen(self, pairs: np.ndarray, history: np.ndarray) -> np.ndarray:
        """Chance of a successor that was seen `pairs` times after a history of `history` tokens.

        One token more is set aside for unseen successors, since discounts alone may free nothing.
        """
        return self.discounts.of(pairs) * pairs / (history + 1)

    def weight(self, history: np.ndarray, n: np.ndarray, covered: np.ndarray) -> np.ndarray:
        """Backoff weight: what the seen successors leave, over the unigram mass of all others."""
        r = np.arange(1, TRUSTED + 1)
        lost = ((1 - np.array(self.discounts.factors)) * r) @ n
        return (lost + 1) / (history + 1) / (1 - covered)


def _score(model, word_parts: int, parts: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Backoff = model.value
        for ids, sizes, held, tokens, words, answers, replies in rows_of(
            batches, "ids", "sizes", "held", "tokens", "words", "answers", "replies"
        ):
            p = _pairs(sizes, held, tokens, words, answers, word_parts, parts, hot)
            replies = sorted(replies, key=lambda a: a["part"])
            counts = np.concatenate([unpack(a["counts"], "<i8") for a in replies])
            after = np.concatenate([m.hot, *[unpack(a["after"], "<i8") for a in replies]])
            n = np.concatenate([m.hot_n, *[unpack(a["n"], "<i8").reshape(TRUSTED, -1) for a in replies]], axis=1)
            covered = np.concatenate([m.hot_covered, *[unpack(a["covered"], "<f8") for a in replies]])
            order = np.argsort(after, kind="stable")
            after, n, covered = after[order], n[:, order], covered[order]
            single = m.unigrams.p(p.word_count)
            chance = single.copy()  # after a history that training never saw the weight is 1
            met = p.history_count > 0
            unseen, seen = np.flatnonzero(met & (counts == 0)), np.flatnonzero(met & (counts > 0))
            i = np.searchsorted(after, p.history[unseen])
            chance[unseen] *= m.weight(p.history_count[unseen], n[:, i], covered[i])
            chance[seen] = m.seen(counts[seen], p.history_count[seen])
            logs, base, is_known = np.log10(chance), m.unigrams.base(p.word_count), p.word_count > 0
            start = np.r_[0, np.cumsum(sizes)[:-1]]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(np.array(sizes, np.int64)),
                pa.array(np.add.reduceat(is_known[p.at].astype(np.int64), start)), pa.array(np.full(len(ids), m.unigrams.tokens, np.int64)),
                pa.array(np.add.reduceat(base[p.at], start)), pa.array(np.add.reduceat(logs[p.at], start)),
            ], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


# --- the operator -------------------------------------------------------------------------------------------------


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """All answers to a chunk in one row; a chunk asks each owner once."""
    return rows.groupBy("chunk").agg(F.collect_list(F.struct("part", *columns)).alias(name))


def score_texts(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: `key, held_out, n_tokens, n_known, train_tokens, base_score, score`.

    The model learns from all documents where `held` is false and scores all documents. Tokens are
    lower-cased (A-Z) words and one end of text. `score` is the log10 probability of the text: a
    word after a known neighbour has its discounted share of that history, any other the history's
    backoff weight times its unigram probability, and a word unknown to training the unigram
    probability of the one unknown word. Null texts count as empty: one end. Rows that repeat are
    learnt and scored each. With no training text every word is unknown. An empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    chunks = chunked(docs, key, text, held)
    kinds = F.expr("length(words)")
    word_parts = even_parts((chunks.agg(F.sum(kinds)).first()[0] or 0) // 4, WORDS)
    with batch_rows(spark, 1):
        asked = chunks.select("chunk", "words", "counts").mapInArrow(_ask_words(word_parts), "part long, chunk long, words binary, counts binary")
        named = keep(asked.groupBy("part").applyInPandas(
            _own_words(word_parts), "chunk long, part long, ids binary, counts binary, seen array<long>"
        ), "words")
    facts = named.agg(*[F.coalesce(F.sum(F.get("seen", F.lit(i))), F.lit(0)) for i in range(TRUSTED + 3)]).first()
    unigrams = Unigrams.learn(facts[0], facts[1], list(facts[2:]))
    answers = _listed(named.where("chunk IS NOT NULL"), "answers", "ids", "counts")
    hot = max(unigrams.tokens // HOT_WORDS, 100_000)
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = even_parts(total, PAIRS)
    with_words = chunks.join(answers.hint("merge"), "chunk")
    with batch_rows(spark, 1):
        asked = with_words.select("chunk", "sizes", "held", "tokens", "words", "answers").mapInArrow(
            _ask_pairs(word_parts, parts, hot), _ASKED_DDL
        )
        owned = keep(asked.groupBy("part").applyInPandas(_own_pairs(unigrams), _ANSWER_DDL), "pairs")
    seen = owned.where("kind = 'seen'").agg(*[F.coalesce(F.sum(F.get("seen", F.lit(i))), F.lit(0)) for i in range(TRUSTED + 1)]).first()
    model = spark.sparkContext.broadcast(Backoff(unigrams, Discounts.learn(list(seen)), *_hot_sums(owned)))
    replies = _listed(owned.where("kind = 'chunk'"), "replies", "counts", "after", "n", "covered")
    with batch_rows(spark, 1):
        scored = with_words.join(replies.hint("merge"), "chunk").select("ids", "sizes", "held", "tokens", "words", "answers", "replies").mapInArrow(
            _score(model, word_parts, parts, hot),
            "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
        return keep(scored, "scored").withColumnRenamed("id", key)


def _hot_sums(owned: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the hot histories over their owners: at most twice `HOT_WORDS` rows, whatever the input."""
    rows = owned.where("kind = 'hot'").select("after", "n", "covered").collect()
    after = np.concatenate([np.zeros(0, np.int64), *[unpack(bytes(r.after), "<i8") for r in rows]])
    n = np.concatenate([np.zeros((TRUSTED, 0), np.int64), *[unpack(bytes(r.n), "<i8").reshape(TRUSTED, -1) for r in rows]], axis=1)
    covered = np.concatenate([np.zeros(0), *[unpack(bytes(r.covered), "<f8") for r in rows]])
    known, at = np.unique(after, return_inverse=True)
    sums = np.stack([np.bincount(at, weights=v, minlength=len(known)) for v in n]) if len(known) else n
    return known, sums.astype(np.int64), np.bincount(at, weights=covered, minlength=len(known))
