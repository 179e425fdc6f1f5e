"""Best-fit packing of token pieces into sequences by bin completion."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troughline.llm.common import batch_rows, even_parts, keep, rows_of, text_of

CAPACITY = 2048
END_ID = 0
#: Short pieces that one search packs together; a group wastes part of one sequence at most beyond its optimum.
GROUP = 8_192
#: Items beside a bin's largest that a filling may have, and fillings kept per bin; the search branches over these.
FILL, BRANCHES = 3, 3
#: First pieces of a filling that are tried, longest first; each deeper piece gets a quarter of that.
TRIES = 48
#: Nodes of the search per bin; beyond, the best packing so far stands.
EFFORT = 2
#: Words whose ids a worker remembers, about 200 bytes each.
REMEMBER = 800_000
#: Marks that may follow a word's letters; none of them begins a contraction.
MARKS = ".,!?;:|"
#: Characters that `str.split` takes for white space and the tokenizer does not.
CONTROLS = "\x1c\x1d\x1e\x1f"
#: Runs without Unicode White_Space, which is what the tokenizer drops.
RUNS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Documents in an Arrow batch: whole texts have no bound.
BATCH = 256


# --- pieces -----------------------------------------------------------------------------------------------------


def token_words(text: str) -> list[str]:
    """The text cut at the tokenizer's white space. The faster `str.split` does the same where no control stands."""
    return RUNS.findall(text) if any(c in text for c in CONTROLS) else text.split()


class WordIds:
    """Token ids of words as little-endian bytes. The tokenizer drops white space and never merges across it,
    so a text's ids are its words' ids. New words are encoded together and remembered up to a bound."""

    def __init__(self, path: str, remember: int = REMEMBER):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # the same merges, without normaliser or pre-tokens
        self.remember, self.known = remember, {}
        self.closing: dict[str, bool] = {}

    def _closes(self, letter: str) -> bool:
        """Whether a mark after this letter begins a pre-token: some letters end in a combining mark once normalised."""
        if letter not in self.closing:
            shown = self.tokenizer.normalizer.normalize_str(letter + ".")
            self.closing[letter] = self.tokenizer.pre_tokenizer.pre_tokenize_str(shown)[-1][0] == "."
        return self.closing[letter]

    def _encode(self, words: list[str]) -> None:
        """Small ASCII letters are one pre-token that stays as it is: the merges alone give its ids."""
        letters = [w for w in words if w.isascii() and w.isalpha() and w.islower()]
        others = [w for w in words if not (w.isascii() and w.isalpha() and w.islower())]
        for tokenizer, own in ((self.merges, letters), (self.tokenizer, others)):
            for at in range(0, len(own), 20_000):
                part = own[at:at + 20_000]
                for w, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                    self.known[w] = array("I", e.ids).tobytes() if LITTLE else np.array(e.ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        if len(self.known) > self.remember:  # words met early are the frequent ones
            self.known = dict(islice(self.known.items(), self.remember // 2))
        known, split = self.known, {}
        # Letters and marks after them are pre-tokens of their own, so "Word," is "word" and ",".
        whole = set()
        for w in words:
            if w not in known:
                base = w.rstrip(MARKS)
                if base.isalpha() and (base.isascii() or self._closes(base[-1])):
                    split[w] = base.lower() if base.isascii() else base, w[len(base):]
                else:
                    whole.add(w)
        whole.update(part for own in split.values() for part in own if part)
        self._encode([w for w in whole if w not in known])
        for w, (base, marks) in split.items():
            known[w] = known[base] + known[marks] if marks else known[base]

    def of(self, words: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


@cache
def word_ids(path: str, remember: int) -> WordIds:
    """One tokenizer and its remembered words per Python worker, which serves task after task."""
    return WordIds(path, remember)


PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, remember: int = REMEMBER) -> DataFrame:
    """`id, piece, start, length, ids_crc32`: token ids of whole texts and one end id, cut only where longer than `capacity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already keeps every core busy
        ids_of, end = word_ids(tokenizer, remember), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            split = [(i, token_words(t)) for i, t in rows_of([batch], "id", "t")]
            ids_of.learn({w for _, words in split for w in words})
            for i, words in split:
                ids = ids_of.of(words) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    out.append((i, n, at // 4, len(own) // 4, zlib.crc32(own)))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t"))
    with batch_rows(docs.sparkSession, BATCH):
        return keep(rows.mapInArrow(run, PIECES), "pieces")


# --- packing one group ----------------------------------------------------------------------------------------------


class Stock:
    """Remaining pieces by length: counts and the ascending list of lengths in stock."""

    def __init__(self, lengths: np.ndarray):
        values, counts = np.unique(lengths, return_counts=True)
        self.lengths = values.tolist()
        self.count = dict(zip(self.lengths, counts.tolist()))
        self.items = int(counts.sum())

    def take(self, length: int) -> None:
        self.count[length] -= 1
        self.items -= 1
        if not self.count[length]:
            self.lengths.pop(bisect_right(self.lengths, length) - 1)

    def put(self, length: int) -> None:
        if not self.count[length]:
            self.lengths.insert(bisect_right(self.lengths, length), length)
        self.count[length] += 1
        self.items += 1

    def fits(self, room: int) -> int:
        """Largest length in stock that fits, 0 if none."""
        at = bisect_right(self.lengths, room)
        return self.lengths[at - 1] if at else 0


def fillings(stock: Stock, room: int, more: int = FILL, keep_best: int = BRANCHES) -> list[tuple[int, ...]]:
    """Undominated fillings of the room beside a bin's largest piece, fullest first.

    A filling is dominated if its pieces fit inside another's: a single piece by a larger one, a pair
    by one piece of at least its sum. So each filling takes, for a descending choice of first piece,
    the largest partners that still fit. A filling without waste dominates the rest of the search.
    """
    best: dict[tuple[int, ...], int] = {}
    single = stock.fits(room)
    if not single:
        return [()]
    best[(single,)] = single
    if single == room or more < 2:
        return [(single,)]

    def extend(chosen: tuple[int, ...], left: int, ceiling: int, depth: int, tries: int) -> bool:
        at = bisect_right(stock.lengths, min(left, ceiling))
        for a in stock.lengths[max(0, at - tries):at][::-1]:
            if stock.count[a] <= chosen.count(a):
                continue
            own, rest = (*chosen, a), left - a
            b = stock.fits(min(rest, a))
            while b and stock.count[b] <= own.count(b):
                b = stock.fits(b - 1)
            full = (*own, b) if b else own
            total = sum(full)
            if total > single:
                best[full] = total
            if total == room or depth > 2 and rest and extend(own, rest, a, depth - 1, tries // 4):
                return True
        return False

    extend((), room, room, more, TRIES)
    return [f for f, _ in sorted(best.items(), key=lambda f: (-f[1], len(f[0]), f[0]))[:keep_best]]


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece into the fullest bin that takes it. The first incumbent of the search."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    for length in sorted(lengths.tolist(), reverse=True):
        at = bisect_right(rooms, (length, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(length)
        if room > length:
            left = (room - length, b)
            rooms.insert(bisect_right(rooms, left), left)
    return bins


def complete(lengths: np.ndarray, capacity: int = CAPACITY, effort: int = EFFORT) -> list[list[int]]:
    """Pack lengths into few bins: branch and bound over completions of each bin's largest piece.

    Every node takes the largest piece left and branches over its undominated fillings, least waste
    first. The waste so far may not exceed what a packing with one bin less than the incumbent's
    could waste in all, else the node is cut. The incumbent starts as best-fit decreasing and is final
    once it meets the bound `ceil(sum / capacity)`, or when the effort is spent.
    """
    incumbent = best_fit(lengths, capacity)
    total = int(lengths.sum())
    least = -(-total // capacity)
    stock, nodes, budget = Stock(lengths), 0, max(64, effort * len(incumbent))
    path: list[list[int]] = []
    stack: list[Iterator[tuple[int, ...]]] = []
    waste = 0

    def undo() -> None:
        nonlocal waste
        own = path.pop()
        waste -= capacity - sum(own)
        for length in own:
            stock.put(length)

    if len(incumbent) <= least:
        return incumbent
    largest = stock.lengths[-1]
    stock.take(largest)
    stack.append(iter(fillings(stock, capacity - largest)))
    stock.put(largest)
    while stack and len(incumbent) > least and nodes < budget:
        filling = next(stack[-1], None)
        if filling is None:
            stack.pop()
            if path:
                undo()
            continue
        nodes += 1
        own = [stock.lengths[-1], *filling]
        for length in own:
            stock.take(length)
        # Rooms that a filling leaves open still take what fits, up to any number of pieces.
        room = capacity - sum(own)
        while (extra := stock.fits(room)) > 0:
            stock.take(extra)
            own.append(extra)
            room -= extra
        path.append(own)
        waste += room
        allowed = (len(incumbent) - 1) * capacity - total
        if not stock.items:
            if len(path) < len(incumbent):
                incumbent = [list(b) for b in path]
            undo()
        elif waste > allowed:
            undo()
        else:
            largest = stock.lengths[-1]
            stock.take(largest)
            stack.append(iter(fillings(stock, capacity - largest)))
            stock.put(largest)
    return incumbent


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, in the given order."""
    whole = lengths >= capacity
    bins = complete(lengths[~whole], capacity) if (~whole).any() else []
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number[whole] = np.arange(whole.sum())
    waiting: dict[int, list[int]] = {}
    for i in np.flatnonzero(~whole)[::-1].tolist():
        waiting.setdefault(int(lengths[i]), []).append(i)
    for b, own in enumerate(bins, int(whole.sum())):
        at = 0
        for length in own:
            i = waiting[length].pop()
            number[i], offset[i] = b, at
            at += length
    return number, offset


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces with `sequence_id` and `offset`. Groups of about `group` pieces, dealt by a hash of the piece, are
    packed one to a task step; the number of groups follows the number of pieces."""
    n = even_parts(cut.count(), group)

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="last")
        number, offset = place(own["length"].to_numpy(np.int64), capacity)
        return own.assign(sequence_id=own["g"].to_numpy(np.int64) * (1 << 32) + number, offset=offset).drop(columns="g")

    dealt = cut.withColumn("g", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.lit(n)).cast("long"))
    return dealt.groupBy("g").applyInPandas(one, f"{PIECES}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group: int = GROUP,
    remember: int = REMEMBER,
) -> DataFrame:
    """One row per piece: `key, piece, start, length, ids_crc32, sequence_id, offset`.

    A document's ids are those of its text (null: none) and one end id, so an empty text is a piece
    of one token. Longer ones than `capacity` are cut into full pieces and a rest. Rows that repeat
    are packed each. An empty table gives no rows; other columns are ignored. `tokenizer` is a
    tokenizers file whose pre-tokenizer drops white space. A worker remembers the ids of `remember` words,
    about 200 bytes each: fewer need less memory and encode more words again.
    """
    return pack(pieces(docs, tokenizer, key, text, capacity, remember), capacity, group).withColumnRenamed("id", key)


