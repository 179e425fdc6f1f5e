"""Line dedup: exact set-similarity join of lines by prefix, positional and length filters."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troughline.llm.common import batch_rows, even_parts, give_back, keep, pack, text_of, unpack
from troughline.llm.words import Words, cut, mix

SIMILARITY = Fraction(4, 5)
#: Word hashes fall into this many cells, whose frequencies order tokens; any order gives the same result.
CELL = 18
CELLS = 1 << CELL
#: Bits of a word's hash that name a line's set.
NAME = 52
#: A token is 12 bits of rarity class and 34 bits of hash, so that a line's number fits beside it in 64 bits.
CLASS, HASH = 12, 34
TOKEN = CLASS + HASH
#: Tokens that occur more often than this are joined together with a second token of the line.
HOT = 2000
#: Earlier lines that are verified at first; where none holds and there are more, all are verified.
FIRST = 3
#: Candidates after which a line looks for no more at first, counted as often as they are met.
ENOUGH = 16
#: Postings that one task joins at a time, lines that one mapping step turns into postings.
POSTINGS, LINES = 400_000, 60_000
#: Keys and tokens of lines that are asked for fall into this many cells each.
SPREAD = 1 << 20
BATCH = 256
#: Documents whose lines' names meet in one group, lines whose names a task compares before it sends them.
NAMED, NAMES = 8192, 1_000_000
#: Cells whose frequencies are added up in one group.
SLICE = 4096
#: Lists of lines are broadcast up to so many bytes.
FEW = 32 << 20


def rarity_class(count: np.ndarray | float) -> np.ndarray:
    """64 classes for each doubling of a frequency."""
    return np.minimum(np.round(np.log2(np.asarray(count) + 1.0) * 64), (1 << CLASS) - 1).astype(np.uint64)


def overlap(n: np.ndarray, m: np.ndarray | int, s: Fraction) -> np.ndarray:
    """Least number of common tokens of sets of n and m with Jaccard similarity s."""
    return -((-s.numerator * (n + m)) // (s.numerator + s.denominator))


def _batched(docs: DataFrame, fn, schema: str, label: str) -> DataFrame:
    with batch_rows(docs.sparkSession, BATCH):
        return keep(docs.mapInArrow(fn, schema), label)


# --- tokens -------------------------------------------------------------------------------------------------------


def _classes(counted: DataFrame) -> np.ndarray:
    """Rarity class of each cell of word hashes, from slices `id, cells` of their frequencies."""
    out = np.zeros(CELLS, np.uint64)
    for row in counted.collect():
        out[row["id"] * SLICE:(row["id"] + 1) * SLICE] = rarity_class(unpack(row["cells"], _NAMES["cells"]))
    return out


def _line_starts(words: Words) -> np.ndarray:
    """Where a line's words begin."""
    new = np.ones(len(words.start), bool)
    new[1:] = (words.doc[1:] != words.doc[:-1]) | (words.line[1:] != words.line[:-1])
    return np.flatnonzero(new)


def _sets(words: Words, values: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Distinct values, below 2^width, of each line: document index, line number, set size, and all values, ascending in each line."""
    firsts = _line_starts(words)
    span = 1 << (64 - width)
    for at in range(0, len(firsts), span):
        lo, hi = firsts[at], firsts[at + span] if at + span < len(firsts) else len(values)
        own = firsts[at:at + span]
        owner = np.repeat(np.arange(len(own), dtype=np.uint64), np.diff(np.r_[own, hi]))
        both = np.sort(owner << np.uint64(width) | values[lo:hi])
        both = both[np.r_[True, both[1:] != both[:-1]]]
        n = np.bincount((both >> np.uint64(width)).astype(np.int64))
        yield words.doc[own], words.line[own], n, both & np.uint64((1 << width) - 1)


def token_sets(words: Words, classes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Distinct tokens of each line: document index, line number, set size, and all tokens, rarest first in each line."""
    h = words.hashes()
    token = classes[(h >> np.uint64(64 - CELL)).astype(np.int64)] << np.uint64(HASH) | h & np.uint64((1 << HASH) - 1)
    yield from _sets(words, token, TOKEN)


def whole_sets(words: Words) -> tuple[np.ndarray, ...]:
    """Distinct words of each line by their whole 64-bit hashes: document index, line number, set size, all hashes."""
    h, firsts = words.hashes(), _line_starts(words)
    owner = np.repeat(np.arange(len(firsts)), np.diff(np.r_[firsts, len(h)]))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    kept = np.ones(len(h), bool)
    kept[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return words.doc[firsts], words.line[firsts], np.bincount(owner[kept], minlength=len(firsts)), h[kept]


def _listed(words: Words, lists: list[list[int] | None], inside: bool) -> Words:
    """Words of the listed lines only, or of all others."""
    codes = np.sort(np.array([(d << 32) + n for d, own in enumerate(lists) for n in own or ()], np.int64))
    if not len(codes):
        return words.where(slice(0, 0)) if inside else words
    code = (words.doc.astype(np.int64) << 32) + words.line
    found = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
    return words.where(found if inside else ~found)


def _prefix(n: np.ndarray, s: Fraction) -> np.ndarray:
    """Length of the probing prefix: lines this similar share a token in it."""
    return n - (-((-n * s.numerator) // s.denominator)) + 1


def _first_of_equals(s1: np.ndarray, s2: np.ndarray, ids: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the earliest line of each name, and of all lines that a line before them equals."""
    order = np.lexsort((line, ids, s2, s1))
    new = np.ones(len(order), bool)
    new[1:] = (s1[order[1:]] != s1[order[:-1]]) | (s2[order[1:]] != s2[order[:-1]])
    first = order[new]
    of = first[np.cumsum(new) - 1]
    return first, order[(ids[order] != ids[of]) | (line[order] != line[of])]


_NAMES = {"s1": "<u8", "s2": "<u8", "id": "<i8", "line": "<i4", "gone_id": "<i8", "gone_line": "<i4", "cells": "<i8"}
_NAMES_SCHEMA = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in _NAMES]])
_EQUAL_SCHEMA = pa.schema([("id", pa.int64()), ("line", pa.int32()), ("n", pa.int64()), ("cells", pa.binary())])


def _named_lines(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Lines with words by part of the name space, each under two sums over its distinct words that name the set.

    Of equal lines that meet here only the first goes on under its name; the others are `gone`. Then, in parts of
    their own, how often the words of each cell occur.
    """
    cells = np.zeros(CELLS, np.int64)
    held, count = [], 0

    def dealt() -> pa.RecordBatch:
        s1, s2, ids, line = (np.concatenate(c) for c in zip(*held))
        first, gone = _first_of_equals(s1, s2, ids, line)
        blocks = []
        part = s1 % np.uint64(parts)
        by_part = [x[np.argsort(part[x], kind="stable")] for x in (first, gone)]
        edges = [np.searchsorted(part[x], np.arange(parts + 1)) for x in by_part]
        for p in range(parts):
            f, g = (x[e[p]:e[p + 1]] for x, e in zip(by_part, edges))
            if len(f) or len(g):
                values = {"s1": np.diff(s1[f], prepend=np.uint64(0)), "s2": s2[f], "id": ids[f], "line": line[f], "gone_id": ids[g], "gone_line": line[g]}
                blocks.append({"part": p, **{c: pack(v.astype(_NAMES[c])) for c, v in values.items()}})
        return pa.RecordBatch.from_pylist(blocks, schema=_NAMES_SCHEMA)

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for words in cut(batch.column(1)):
            h = words.hashes()
            cells += np.bincount((h >> np.uint64(64 - CELL)).astype(np.int64), minlength=CELLS)
            for doc, line, n, values in _sets(words, h & np.uint64((1 << NAME) - 1), NAME):
                start = np.r_[0, np.cumsum(n)[:-1]]
                held.append((np.add.reduceat(mix(values, 1), start), np.add.reduceat(mix(values, 2), start), ids[doc], line.astype(np.int32)))
                count += len(n)
        if count >= NAMES:
            yield dealt()
            held, count = [], 0
    if held:
        yield dealt()
    slices = [{"part": parts + i, "cells": pack(cells[i * SLICE:(i + 1) * SLICE])} for i in range(CELLS // SLICE) if cells[i * SLICE:(i + 1) * SLICE].any()]
    yield pa.RecordBatch.from_pylist(slices, schema=_NAMES_SCHEMA)
    give_back()


def _equal_lines(blocks: pa.Table, parts: int) -> pa.Table:
    """`id, line` of lines that equal an earlier one and, in a row of its own, the number `n` of different ones; or
    a slice of the cells' frequencies, its number in `id`."""
    part = blocks["part"][0].as_py()
    if part >= parts:
        cells = np.zeros(SLICE, np.int64)
        for own in blocks["cells"]:
            cells += unpack(own.as_py(), _NAMES["cells"])
        return pa.table([[part - parts], [None], [None], [pack(cells)]], schema=_EQUAL_SCHEMA)
    col = {c: [unpack(v.as_py(), t) for v in blocks[c]] for c, t in _NAMES.items() if c != "cells"}
    col["s1"] = [np.cumsum(v, dtype=np.uint64) for v in col["s1"]]
    col = {c: np.concatenate(v) for c, v in col.items()}
    first, gone = _first_of_equals(*[col[c] for c in ("s1", "s2", "id", "line")])
    ids, line = np.r_[col["gone_id"], col["id"][gone]], np.r_[col["gone_line"], col["line"][gone]]
    lines = pa.table([pa.array(ids), pa.array(line), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.binary())], schema=_EQUAL_SCHEMA)
    give_back()
    return pa.concat_tables([lines, pa.table([[None], [None], [len(first)], [None]], schema=_EQUAL_SCHEMA)])


def _equals(rows: DataFrame) -> DataFrame:
    """`id, line, n, cells` from documents `id, t`, see `_equal_lines`."""
    parts = even_parts(rows.count(), NAMED)
    with batch_rows(rows.sparkSession, BATCH):
        blocks = rows.mapInArrow(lambda batches: _named_lines(batches, parts), "part int, " + ", ".join(f"{c} binary" for c in _NAMES))
        return keep(blocks.groupBy("part").applyInArrow(lambda own: _equal_lines(own, parts), "id long, line int, n long, cells binary"), "equal")


# --- candidates ---------------------------------------------------------------------------------------------------


_BLOCK = ("key", "id", "line", "n", "pos", "bits", "half", "low", "high", "asked")
_TYPES = ("<u8", "<i8", "<i4", "<i4", "<i4", "<u8", "<u8", "<u8", "<u8", "<u1")
#: Lines of so many tokens have a parity bitmap of 128 bits, of 256 bits; shorter ones of 64.
WIDE, WIDER = 64, 128
#: Earlier lines that all lines together look at in one step, at least.
STRIDE = 1 << 14
#: Pairs that a task holds before it cuts them down to what it returns.
PAIRS = 400_000


def parity(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parity bitmaps of each set: sets that differ in k tokens have bitmaps that differ in k bits at most.

    A bitmap folded in two is the one of half the length: `bits` is 64 bits, with `half` of the 128
    the other half is `bits ^ half`, and with the `low` and `high` words of the 256 so are the other two.
    """
    start = np.r_[0, np.cumsum(n)[:-1]]
    bit = np.uint64(1) << (tokens & np.uint64(63))  # tokens end in bits of a hash
    bits = np.bitwise_xor.reduceat(bit, start)
    half, low, high = (np.zeros(len(n), np.uint64) for _ in range(3))
    wide = np.flatnonzero(n >= WIDE)
    if len(wide):
        own = np.repeat(n >= WIDE, n)
        bit, word, begin = bit[own], (tokens[own] >> np.uint64(6)) & np.uint64(3), np.r_[0, np.cumsum(n[wide])[:-1]]
        q = [np.bitwise_xor.reduceat(np.where(word == i, bit, np.uint64(0)), begin) for i in range(3)]
        half[wide] = q[0] ^ q[2]
        wider = n[wide] >= WIDER
        low[wide[wider]], high[wide[wider]] = q[0][wider], q[1][wider]
    return bits, half, low, high


def apart(a: dict, b: dict) -> np.ndarray:
    """Bits in which the longest bitmaps that both lines have differ."""
    x = {c: a[c] ^ b[c] for c in ("bits", "half", "low", "high")}
    shorter = np.minimum(a["n"], b["n"])
    one, count = x["bits"], np.bitwise_count
    two = count(x["half"]).astype(np.int64) + count(x["half"] ^ one)
    four = count(x["low"]).astype(np.int64) + count(x["high"]) + count(x["half"] ^ x["low"]) + count(one ^ x["half"] ^ x["high"])
    return np.where(shorter >= WIDER, four, np.where(shorter >= WIDE, two, count(one)))


def _postings(lines: list[tuple], parts: int, only: np.ndarray | None, s: Fraction) -> Iterator[dict]:
    """Postings of lines, by part of the key space: a token of the prefix, or two tokens where it is hot.

    `lines` holds arrays of id, line, size, tokens, asked. Similar lines share a token in their prefixes
    and two in prefixes that are one longer, so both kinds of key lose none.
    """
    ids, line, n, tokens, asked = (np.concatenate(c) for c in zip(*lines))
    start = np.r_[0, np.cumsum(n)]
    # A set that is too small to be similar to one with a token more matches only its equals.
    size = np.where(n * s.denominator >= (n + 1) * s.numerator, _prefix(n, s), 0)
    owner = np.repeat(np.arange(len(n)), size)
    pos = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
    own = tokens[start[owner] + pos]
    hot = (own >> np.uint64(HASH)) > rarity_class(HOT)
    # A hot token meets every other one of a prefix that is one longer.
    reach = np.minimum(size + 1, n)[owner[hot]]
    first = np.repeat(own[hot], reach)
    at = np.repeat(owner[hot], reach)
    second = tokens[start[at] + np.arange(len(at)) - np.repeat(np.cumsum(reach) - reach, reach)]
    apart_ = first != second
    first, second, at = first[apart_], second[apart_], at[apart_]
    key = np.concatenate([mix(own[~hot], 0), mix(np.minimum(first, second), 1) ^ mix(np.maximum(first, second), 2)])
    at, pos = np.concatenate([owner[~hot], at]), np.concatenate([pos[~hot], np.zeros(len(at), np.int64)])
    if only is not None:
        known = only[(key >> np.uint64(44)).astype(np.int64)]
        key, at, pos = key[known], at[known], pos[known]
    maps = [np.zeros(len(n), np.uint64) for _ in range(4)]
    if len(at):
        met = np.zeros(len(n), bool)
        met[at] = True
        for lo in range(0, len(n), 4096):  # few lines at a time, as their tokens are many
            hi = min(lo + 4096, len(n))
            some, own = np.flatnonzero(met[lo:hi]), tokens[start[lo]:start[hi]]
            if len(some):
                for whole, bits in zip(maps, parity(own[np.repeat(met[lo:hi], n[lo:hi])], n[lo + some])):
                    whole[lo + some] = bits
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(key)
    order = order[np.argsort(part[order].astype(np.uint16) if parts <= 1 << 16 else part[order], kind="stable")]
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        rows = order[edges[p]:edges[p + 1]]
        if len(rows):
            o = at[rows]
            values = [np.diff(key[rows], prepend=np.uint64(0)), ids[o], line[o], n[o], pos[rows], *[m[o] for m in maps], asked[o]]
            yield {"part": p, **{c: pack(v.astype(t)) for c, v, t in zip(_BLOCK, values, _TYPES)}}


def _like_asked(n: np.ndarray, tokens: np.ndarray, among: np.ndarray, s: Fraction) -> np.ndarray:
    """Which lines may be similar to one that is asked for: at least a share s of their tokens lies in cells of such lines' tokens."""
    found = np.add.reduceat(among[(tokens & np.uint64(SPREAD - 1)).astype(np.int64)], np.r_[0, np.cumsum(n)[:-1]], dtype=np.int64)
    return found * s.denominator >= n * s.numerator


def _line_batches(batches: Iterator[pa.RecordBatch], classes: np.ndarray, among: np.ndarray | None = None, s: Fraction = SIMILARITY) -> Iterator[list[tuple]]:
    """First lines of batches of `id, t, equal, asked`, about `LINES` at a time; with `among` those that `_like_asked` leaves."""
    held, count = [], 0
    for batch in batches:
        equal, asked = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for words in cut(batch.column(1)):
            for doc, line, n, tokens in token_sets(_listed(words, equal, False), classes):
                if among is not None and len(n):
                    like = _like_asked(n, tokens, among, s)
                    doc, line, n, tokens = doc[like], line[like], n[like], tokens[np.repeat(like, n)]
                code = (doc.astype(np.int64) << 32) + line
                wanted = np.array([(d << 32) + x for d, own in enumerate(asked) for x in own or ()], np.int64)
                if len(n):
                    held.append((ids[doc], line, n, tokens, np.isin(code, wanted)))
                count += len(n)
                if count >= LINES:
                    yield held
                    held, count = [], 0
    if held:
        yield held


def _in_order(ids: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Indices that sort lines; one number for a line sorts fastest, where ids are near enough for that."""
    low, width = int(ids.min()), int(line.max()) + 1
    if (int(ids.max()) - low + 1) * width < 1 << 63:
        return np.argsort((ids - low) * width + line)
    return np.lexsort((line, ids))


def _meet(blocks: pd.DataFrame, s: Fraction, first: int | None) -> pd.DataFrame:
    """Pairs of one part that pass the length, positional and bitmap filters: for each later line the closest `first`
    of the earlier ones it met and whether there may be more; without `first`, all of the lines that are asked for.

    A line stops once it has `ENOUGH` candidates, so a crowd of similar lines costs work in proportion to its size.
    """
    col = {c: np.concatenate([unpack(v, t) for v in blocks[c]]) for c, t in zip(_BLOCK[1:], _TYPES[1:])}
    key = np.concatenate([np.cumsum(unpack(v, "<u8"), dtype=np.uint64) for v in blocks["key"]])
    # Number the part's lines in their order, then bring equal keys together, short lines first.
    order = _in_order(col["id"], col["line"])
    ids, line = col.pop("id")[order], col.pop("line")[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (line[1:] != line[:-1])]
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(new) - 1
    ids, line = ids[new], line[new]
    # Postings of equal keys and like lengths lie together in the order of their lines: similar lines are one class apart at most.
    shape = np.floor(np.log(col["n"]) / (np.log(float(1 / s)) * (1 + 1e-9))).astype(np.int64) if s < 1 else col["n"].astype(np.int64)
    order = np.argsort(key)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.r_[False, key[order[1:]] != key[order[:-1]]])
    low = int(shape.min())
    order = np.argsort((rank * (int(shape.max()) - low + 1) + shape - low) * len(ids) + of)
    key, shape, of = key[order], shape[order], of[order]
    col = {c: v[order] for c, v in col.items()}
    n, pos = col["n"].astype(np.int64), col["pos"].astype(np.int64)
    maps = {c: col[c] for c in ("n", "bits", "half", "low", "high")}
    opens = np.r_[True, (key[1:] != key[:-1]) | (shape[1:] != shape[:-1])]
    starts, group = np.flatnonzero(opens), np.cumsum(opens) - 1
    place = group * len(ids) + of
    held, waiting, more = [np.zeros((3, 0), np.int64)], 0, np.zeros(len(ids), bool)

    def cut_down() -> np.ndarray:
        """Each pair once; of each later line the closest `first` pairs, marked if there are more."""
        pairs = np.concatenate(held, axis=1)
        pairs = pairs[:, np.unique(pairs[0] * len(ids) + pairs[1], return_index=True)[1]]
        if first is None or not pairs.shape[1]:
            return pairs
        pairs = pairs[:, np.lexsort((pairs[1], pairs[2], pairs[0]))]
        begins = np.r_[True, pairs[0, 1:] != pairs[0, :-1]]
        rank = np.arange(len(begins)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        more[pairs[0][rank >= first]] = True
        return pairs[:, rank < first]

    found = np.zeros(len(ids), np.int64)
    # No similar line lets more bits differ than this, whatever its size.
    most = np.minimum((n + n * s.denominator // s.numerator) * (s.denominator - s.numerator) // (s.denominator + s.numerator), 64).astype(np.uint8)
    askers = np.arange(len(key)) if first is not None else np.flatnonzero(col["asked"])
    for offset in (0, -1, 1) if s < 1 else (0,):
        # The neighbouring class of the same key is the neighbouring group, if there is one.
        to = np.clip(group[askers] + offset, 0, len(starts) - 1)
        own = (key[starts[to]] == key[askers]) & (shape[starts[to]] == shape[askers] + offset)
        alive, to = askers[own], to[own]
        at = np.searchsorted(place, to * len(ids) + of[alive]) - 1
        left = starts[to] - at - 1  # below zero
        # Every line walks back to earlier ones, until none is left or it has met enough; those with the longest way come first.
        order = np.argsort(left, kind="stable")
        walk = [x[order] for x in (alive, at, left, col["bits"][alive], most[alive])]
        step, fuller = 0, first is not None
        while True:
            if fuller:
                full = found[of[walk[0]]] >= ENOUGH
                more[of[walk[0][full & (walk[2] < -step)]]] = True
                walk = [x[~full] for x in walk]
            walk = [x[:np.searchsorted(walk[2], -step)] for x in walk]
            alive, at, left, bits, bound = walk
            if not len(alive):
                break
            at, width = at - step, max(1, STRIDE // len(alive))
            if width > 1:
                # A few lines with a long way take several earlier ones at a time.
                reach = np.minimum(-left - step, width)
                alive, at, bits, bound = (np.repeat(x, reach) for x in (alive, at, bits, bound))
                at -= np.arange(len(at)) - np.repeat(np.cumsum(reach) - reach, reach)
            step += width
            good = np.flatnonzero(np.bitwise_count(bits ^ col["bits"][at]) <= bound)
            a, b = alive[good], at[good]
            need = overlap(n[a], n[b], s)
            slack = n[a] + n[b] - 2 * need
            ahead = np.minimum(n[a] - pos[a], n[b] - pos[b])
            able = (ahead >= need) & (slack >= 0)
            a, b, slack = a[able], b[able], slack[able]
            differ = apart({c: v[a] for c, v in maps.items()}, {c: v[b] for c, v in maps.items()})
            kept = differ <= slack
            late, soon = of[a[kept]], of[b[kept]]
            np.add.at(found, late, 1)
            fuller = first is not None and bool((found[late] >= ENOUGH).any())
            held.append(np.stack([late, soon, differ[kept]]).astype(np.int64))
            waiting += held[-1].shape[1]
            if waiting > PAIRS:
                held, waiting = [cut_down()], 0
    late, soon, _ = cut_down()
    return pd.DataFrame({
        "id": ids[late], "line": line[late], "to_id": ids[soon], "to_line": line[soon], "more": more[late],
    })


def _candidates(first_lines: DataFrame, classes, n_lines: int, s: Fraction, first: int | None, cells: np.ndarray | None = None) -> DataFrame:
    """`id, line, to_id, to_line, more` from documents `id, t, equal, asked`: lists of lines to pass over and to ask for.

    `cells` tells which cells of keys and of tokens belong to lines that are asked for.
    """
    parts = even_parts(12 * n_lines, POSTINGS)
    spread = first_lines.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, among = (None, None) if spread.value is None else spread.value
        for lines in _line_batches(batches, classes.value, among, s):
            blocks = list(_postings(lines, parts, only, s))
            if blocks:
                yield pa.RecordBatch.from_pylist(blocks, schema=pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in _BLOCK]]))
            del lines, blocks
            give_back()

    def meet(blocks: pd.DataFrame) -> pd.DataFrame:
        out = _meet(blocks, s, first)
        give_back()
        return out

    blocks = first_lines.mapInArrow(run, "part int, " + ", ".join(f"{c} binary" for c in _BLOCK))
    return blocks.groupBy("part").applyInPandas(meet, "id long, line int, to_id long, to_line int, more boolean")


def _short(listed: DataFrame, name: str) -> bool:
    """Whether the lists are small enough to broadcast: 4 bytes a line, 48 a document."""
    return (listed.agg(F.sum(F.lit(48) + 4 * F.size(name))).first()[0] or 0) <= FEW


def _with_lists(docs: DataFrame, lines: DataFrame, name: str) -> DataFrame:
    """Documents with their list of `lines` (null without one); lists are broadcast only if small."""
    listed = keep(lines.groupBy("id").agg(F.collect_list("line").alias(name)), "lists")
    few = _short(listed, name)
    return docs.join(F.broadcast(listed) if few else listed, "id", "left")


def _verified(pairs: DataFrame, docs: DataFrame, s: Fraction) -> DataFrame:
    """`id, line` of later lines with an earlier one that is similar enough, by their whole token sets."""
    pairs = pairs.select("id", "line", "to_id", "to_line").distinct()
    ends = pairs.select("id", "line").union(pairs.select("to_id", "to_line")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(2).to_pylist()
            for words in cut(batch.column(1)):
                some = _listed(words, lines, True)
                if len(some.start):
                    doc, line, n, tokens = whole_sets(some)
                    sets = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(tokens.view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(doc)), pa.array(line.astype(np.int32)), sets], names=["id", "line", "tokens"]
                    )
        give_back()

    some = _with_lists(docs, ends, "lines").where("lines IS NOT NULL")
    sets = _batched(some, run, "id long, line int, tokens array<long>", "sets").dropDuplicates(["id", "line"])
    mine = sets.select("id", "line", F.col("tokens").alias("a"))
    theirs = sets.select(F.col("id").alias("to_id"), F.col("line").alias("to_line"), F.col("tokens").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return pairs.join(mine, ["id", "line"]).join(theirs, ["to_id", "to_line"]).where(
        common * (s.numerator + s.denominator) >= (F.size("a") + F.size("b")) * s.numerator
    ).select("id", "line").distinct()


# --- the operator -------------------------------------------------------------------------------------------------


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: Fraction = SIMILARITY) -> DataFrame:
    """`id, line` of the lines to remove: an earlier line, by (id, line number), has Jaccard similarity of at least `similarity`.

    Lines are sets of lower-cased (A-Z) words. Candidates tell words apart by 46 bits of hash and frequency, the similarity of
    a pair by 64 bits of hash, equal sets by sums of 52 bits of their words' hashes. Equal sets are one line of the join, named by the earliest, so copies never form pairs. Rows that repeat an id count as one document. A null id
    comes first. Lines without words are never listed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("id"), text_of(text).alias("t"))
    named = _equals(rows)
    classes = spark.sparkContext.broadcast(_classes(named.where("cells IS NOT NULL").select("id", "cells")))
    n_lines = named.agg(F.sum("n")).first()[0] or 0
    equal = named.where("line IS NOT NULL").select("id", "line")
    firsts = _with_lists(rows, equal, "equal")
    none = F.lit(None).cast("array<int>").alias("asked")
    with batch_rows(spark, BATCH):
        pairs = keep(_candidates(firsts.select("id", "t", "equal", none), classes, n_lines, similarity, FIRST), "pairs")
    near = keep(_verified(pairs, rows, similarity), "near")
    open_ = keep(pairs.where("more").select("id", "line").distinct().join(near, ["id", "line"], "left_anti"), "open")
    if open_.limit(1).count():
        asking = _with_lists(firsts, open_, "asked").select("id", "t", "equal", "asked")
        with batch_rows(spark, BATCH):
            cells = _cells_of(asking.where("asked IS NOT NULL"), classes, similarity)
            pairs = keep(_candidates(asking, classes, n_lines, similarity, None, cells), "pairs")
        near = near.union(_verified(pairs, rows, similarity))
    return equal.union(near).distinct()


def _cells_of(asking: DataFrame, classes, s: Fraction) -> np.ndarray:
    """Two rows of `SPREAD` cells: which hold a posting of a line that is asked for, by key, and which a token of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in _line_batches(batches, classes.value):
            for block in _postings(lines, 1, None, s):
                keys = np.cumsum(unpack(block["key"], "<u8"), dtype=np.uint64)[unpack(block["asked"], "<u1") > 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(keys >> np.uint64(44)).astype(np.int64))], names=["cell"])
            for _, _, n, tokens, asked in lines:
                own = np.unique(tokens[np.repeat(asked, n)] & np.uint64(SPREAD - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own + SPREAD)], names=["cell"])

    cells = asking.mapInArrow(run, "cell long").distinct().toPandas()["cell"].to_numpy()
    out = np.zeros(2 * SPREAD, bool)
    out[cells] = True
    return out.reshape(2, SPREAD)


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: Fraction = SIMILARITY) -> DataFrame:
    """`docs` with repeated lines cut out of the text, and `n_lines`, `n_removed`.

    See `repeated_lines`. Lines end with a newline character; those that stay keep their order and bytes. A
    null text stays null, an empty one empty, and a document may end up empty. Every row stays, and so
    do other columns; those named as the result's are replaced, and none may be `_line_id` or `_gone`.
    """
    gone = keep(repeated_lines(docs, key, text, similarity).groupBy("id").agg(F.collect_list("line").alias("_gone")), "gone")
    few = _short(gone, "_gone")
    listed = gone.withColumnRenamed("id", "_line_id")
    own = docs.withColumn("_line_id", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))))
    joined = own.join(F.broadcast(listed) if few else listed, "_line_id", "left")
    lines = F.split(F.col(text), "\n")
    breaks = (F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))).cast("int")
    left = F.filter(lines, lambda _, i: ~F.array_contains("_gone", i))
    return joined.withColumns({
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(breaks + 1), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)),
        text: F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")),
    }).select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")], "n_lines", F.greatest("n_removed", F.lit(0)).alias("n_removed"))
