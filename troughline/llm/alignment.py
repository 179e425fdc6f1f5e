"""Alignment of two tokenizers by an associative fragment monoid.

Tokens of both tokenizers cover the same bytes. Where an A token and a B token end at one byte, a group ends. The tokens
that end in a byte range form a fragment: an open prefix (up to the first common end), closed groups, an open suffix
(after the last). Fragments of neighbouring ranges compose: the suffix of the left and the prefix of the right close one
group, and composition is associative. A text of ordinary length is one fragment, made whole in one task. A long
text is cut where each tokenizer must end a token, its parts are encoded by any tasks, the tokens meet by byte range,
and a tree of compositions, each over `FAN` neighbours, closes the groups that cross ranges.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troughline.llm.common import batch_rows, keep, shuffle_width

#: Bytes from which a text is long; characters of a part of it; bytes of a range; fragments composed at once.
LONG, PART, RANGE, FAN = 1 << 16, 1 << 14, 1 << 14, 8
_SPACE = "▁"
#: A surely ends a token between a letter or digit and one of these signs; scripts as in the first class.
_A_END = re.compile("(?<=[A-Za-z0-9À-ÖØ-öø-ɏЀ-яぁ-ゖァ-ヺ一-龥가-힣])(?=[ \n\t.,;:!?、。，])")
_DOC = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, times array<int>"
_FRAGMENT = "row long, at long, head long, pre_a array<int>, pre_b array<int>, suf_a array<int>, suf_b array<int>, closed boolean"
_PIECE = "row long, k long, part int, n_groups long, body string, pairs array<int>"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class Pair:
    """Both tokenizers, the bytes of their tokens, and the numbers of all pairs that can be linked."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        n = self.b.get_piece_size()
        self.pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id(_SPACE)

    @property
    def keys(self) -> np.ndarray:
        """`a * |B| + b` of all pairs whose tokens can end together: one's bytes end with the other's."""
        if not hasattr(self, "_keys"):
            by_bytes: dict[bytes, list[int]] = {}
            for i, x in enumerate(self.b_bytes):
                by_bytes.setdefault(x, []).append(i)
            ends_a: dict[bytes, list[int]] = {}
            for i, x in enumerate(self.a_bytes):
                ends_a.setdefault(x, []).append(i)
            n, out = len(self.b_bytes), set()
            for a, x in enumerate(self.a_bytes):
                out.update(a * n + b for s in range(len(x)) for b in by_bytes.get(x[s:], ()))
            for b, x in enumerate(self.b_bytes):
                out.update(a * n + b for s in range(len(x)) for a in ends_a.get(x[s:], ()))
            self._keys = np.array(sorted(out), np.int64)
        return self._keys

    @property
    def adjacent(self) -> set[str]:
        """Neighbouring characters inside pieces of B; nothing else can be merged over a cut."""
        if not hasattr(self, "_adjacent"):
            texts = [p.replace(_SPACE, " ") for i, p in enumerate(self.pieces) if not self.b.is_byte(i)]
            self._adjacent = {t[i:i + 2] for t in texts for i in range(len(t) - 1)}
        return self._adjacent

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]

    def encode_b(self, part: str) -> list[int]:
        """B's tokens of a part of space+text. B adds a space in front, so one goes: the part's own, or the token made of it."""
        if part[0] == " ":
            return self.b.encode(part[1:]) if len(part) > 1 else [self.space]
        return self.b.encode(part)[1:]

    def cuts_a(self, text: str, size: int) -> list[int]:
        out, at = [0], 0
        while len(text) - at > 2 * size and (m := _A_END.search(text, at + size)) and m.start() < len(text):
            at = m.start()
            out.append(at)
        return out

    def cuts_b(self, text: str, size: int) -> list[int]:
        out, i = [0], size
        shown = text.replace(_SPACE, " ")
        while i < len(text) - size:
            y = shown[i]
            if shown[i - 1:i + 1] not in self.adjacent and (text[i] == " " or y != " " and " " + y not in self.adjacent):
                out.append(i)
                i += size
            else:
                i += 1
        return out


@lru_cache(2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


@dataclass
class Groups:
    """Closed groups of some tokens: their number, their text token by token, the pair keys of their links."""

    n: int
    labels: list[str]
    links: np.ndarray

    @property
    def body(self) -> str:
        return "".join(self.labels)


def _texts(n: int, signs: tuple[str, str]) -> list[str]:
    return [f"{i}{s}" for i in range(n) for s in signs]


@lru_cache(2)
def _labels(n_a: int, n_b: int) -> list[str]:
    """Tokens as text, followed by the sign inside a group and by that at its side's end."""
    return [*_texts(n_a, (",", "|")), *_texts(n_b, (",", ";"))]


def close(pair: Pair, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, common: np.ndarray) -> Groups:
    """Groups of tokens that all end at or before the last common end."""
    if not len(common):
        return Groups(0, [], np.zeros(0, np.int64))
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    last_a, last_b = ends_a == common[group_a], ends_b == common[group_b]
    per_a, per_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    before_b = np.cumsum(per_b) - per_b
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + before_b[group_a]] = 2 * a + last_a
    order[np.arange(len(b)) + np.cumsum(per_a)[group_b]] = 2 * len(pair.a_bytes) + 2 * b + last_b
    labels = _labels(len(pair.a_bytes), len(pair.b_bytes))
    # Tokens without bytes do not exist in either vocabulary, so one token of each side ends at a common end.
    return Groups(len(common), list(map(labels.__getitem__, order.tolist())), a[last_a] * len(pair.b_bytes) + b[last_b])


def _same_bytes(table: list[bytes], ids: list[int], target: bytes) -> bool:
    return b"".join(map(table.__getitem__, ids)) == target


#: A lone blank between other signs than white space: neither tokenizer has a token over its front.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Parts that a worker remembers.
REMEMBER = 300_000


class Parts:
    """Fragments of the parts between lone blanks, remembered, as words come back.

    Both tokenizers end a token at the end of every part, so its groups are closed and a text's fragment is that of
    its parts in a row. A part stands for itself after one blank.
    """

    def __init__(self, pair: Pair) -> None:
        self.pair, self.number, self.bodies = pair, {}, []
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups (as many links), 1 if the bytes come back
        self.links = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Half of the parts; those met early are the frequent ones."""
        half = len(self.bodies) // 2
        self.number = dict(islice(self.number.items(), half))
        self.bodies, self.sizes = self.bodies[:half], self.sizes[:half]
        self.links = self.links[:self.sizes[:, 2].sum()]

    def learn(self, parts: set[str]) -> None:
        if len(self.bodies) + len(parts) > REMEMBER:
            self._forget()
        new = [p for p in parts if p not in self.number]
        # Parts in a row are encoded at once, but for those with blanks at an end (of a text), which would run into their
        # neighbours, and those whose bytes change on the way, which would shift them.
        alone = {p for p in new if not p or _SPACE in p or p[0].isspace() or p[-1].isspace()}
        plain, odd = [p for p in new if p not in alone], list(alone)
        if plain and not self._add(plain):
            odd += plain
        for p in odd:
            if not p or not self._add([p]):
                self._enter([p], [""], np.zeros((1, 4), np.int64), self.links[:0])

    def _add(self, parts: list[str]) -> bool:
        """Enter some parts, unless the tokens of either side do not give their bytes back."""
        pair, whole = self.pair, " ".join(parts)
        ids_a, ids_b, target = pair.encode_a([" " + whole])[0], pair.b.encode(whole), b" " + whole.encode()
        if not _same_bytes(pair.a_bytes, ids_a, target) or not _same_bytes(pair.b_bytes, ids_b, target):
            return False
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        groups = close(pair, a, b, ends_a, ends_b, common)
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        counts = [np.diff(np.searchsorted(e, ends, "right"), prepend=0) for e in (ends_a, ends_b, common)]
        at = np.concatenate(([0], np.cumsum(counts[0] + counts[1]))).tolist()
        bodies = ["".join(groups.labels[i:j]) for i, j in zip(at, at[1:])]
        self._enter(parts, bodies, np.stack([*counts, np.ones(len(parts), np.int64)], axis=1), np.searchsorted(pair.keys, groups.links).astype(np.int32))
        return True

    def _enter(self, parts: list[str], bodies: list[str], sizes: np.ndarray, links: np.ndarray) -> None:
        self.number.update(zip(parts, range(len(self.bodies), len(self.bodies) + len(parts))))
        self.bodies += bodies
        self.sizes, self.links = np.concatenate((self.sizes, sizes)), np.concatenate((self.links, links))
        self.starts = np.cumsum(self.sizes[:, 2]) - self.sizes[:, 2]

    def text(self, parts: list[str]) -> tuple[int, int, int, str, np.ndarray, np.ndarray] | None:
        """Sizes, body and counted links of a text of known parts; None where its bytes do not come back."""
        at = list(map(self.number.__getitem__, parts))
        own = np.array(at)
        sizes = self.sizes[own]
        n_a, n_b, n, same = sizes.sum(axis=0).tolist()
        if same < len(parts):
            return None
        each = sizes[:, 2]
        place = np.arange(n) + np.repeat(self.starts[own] - (np.cumsum(each) - each), each)
        pairs, times = np.unique(self.links[place], return_counts=True)
        return n_a, n_b, n, "".join(map(self.bodies.__getitem__, at)), pairs, times.astype(np.int32)


@lru_cache(2)
def _parts_of(a_path: str, b_path: str) -> Parts:
    return Parts(_pair(a_path, b_path))


def _short(a_path: str, b_path: str):
    """Whole texts of ordinary length, each put together from the fragments of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _parts_of(a_path, b_path)
        for batch in batches:
            split = [_BETWEEN.split(t) if t else [] for t in batch.column("text").to_pylist()]
            known.learn({p for parts in split for p in parts})
            out = []
            for parts, row, doc in zip(split, batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()):
                made = known.text(parts) if parts else None
                if made is None:
                    out.append((row, doc, 0, 0, 0, "", [], []))
                    continue
                n_a, n_b, n, body, pairs, times = made
                out.append((row, doc, n_a, n_b, n, hashlib.sha256(body[:-1].encode()).hexdigest(), pairs, times))
            yield _doc_batch(out)

    return run


_DOC_TYPES = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def _doc_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _DOC.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_DOC_TYPES)], names)


def _cut(a_path: str, b_path: str, size: int):
    """Parts of long texts for each tokenizer, with the byte of space+text they start at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                text = " " + text
                for side, cuts in ((0, pair.cuts_a(text, size)), (1, pair.cuts_b(text, size))):
                    parts = [text[i:j] for i, j in zip(cuts, [*cuts[1:], len(text)])]
                    starts = np.cumsum([0, *[len(p.encode()) for p in parts[:-1]]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(parts), pa.int64()), pa.array([side] * len(parts), pa.int32()), pa.array(starts, pa.int64()), pa.array(parts, pa.string())],
                        ["row", "side", "start", "part"],
                    )

    return run


def _encode(a_path: str, b_path: str, span: int):
    """Tokens of parts, dealt out by the byte range in which they end; `same`: the part's bytes come back from its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for batch in batches:
            rows: list[tuple] = []
            for row, side, start, part in zip(*[batch.column(c).to_pylist() for c in ("row", "side", "start", "part")]):
                ids = pair.encode_b(part) if side else pair.encode_a([part])[0]
                same = _same_bytes(pair.b_bytes if side else pair.a_bytes, ids, part.encode())
                tokens = np.array(ids, np.int64)
                ends = start + np.cumsum((pair.b_size if side else pair.a_size)[tokens])
                k = (ends - 1) // span
                for at in np.split(np.arange(len(k)), np.flatnonzero(np.diff(k)) + 1):
                    if len(at):
                        rows.append((row, int(k[at[0]]), side, same, tokens[at].astype(np.int32), ends[at]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64())))],
                ["row", "k", "side", "same", "ids", "ends"],
            )

    return run


def _side(table: pa.Table, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of one side in a range and their ends, in order."""
    own = table.filter(pa.array(np.asarray(table.column("side")) == side))
    ids = np.array([i for x in own.column("ids").to_pylist() for i in x], np.int64)
    ends = np.array([e for x in own.column("ends").to_pylist() for e in x], np.int64)
    order = np.argsort(ends, kind="stable")
    return ids[order], ends[order]


def _range_fragment(a_path: str, b_path: str):
    """A byte range's fragment: its open ends, and its closed groups as text and links."""

    def run(table: pa.Table) -> pa.Table:
        pair = _pair(a_path, b_path)
        (a, ends_a), (b, ends_b) = _side(table, 0), _side(table, 1)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        row, k = table.column("row")[0].as_py(), table.column("k")[0].as_py()
        if not len(common):
            parts = (a, b, a[:0], b[:0])
            groups = close(pair, a[:0], b[:0], ends_a[:0], ends_b[:0], common)
        else:
            i, j, x, y = (np.searchsorted(e, c, "right") for c in (common[0], common[-1]) for e in (ends_a, ends_b))
            parts = (a[:i], b[:j], a[x:], b[y:])
            groups = close(pair, a[i:x], b[j:y], ends_a[i:x], ends_b[j:y], common[1:])
        return pa.Table.from_arrays(
            [pa.array([row], pa.int64()), pa.array([k], pa.int64()), pa.array([k if len(common) else None], pa.int64()),
             *[pa.array([p.astype(np.int32)], pa.list_(pa.int32())) for p in parts], pa.array([len(common) > 0]),
             pa.array([groups.n], pa.int64()), pa.array([groups.body], pa.string()),
             pa.array([np.searchsorted(pair.keys, groups.links).astype(np.int32)], pa.list_(pa.int32()))],
            ["row", "at", "head", "pre_a", "pre_b", "suf_a", "suf_b", "closed", "n_groups", "body", "pairs"],
        )

    return run


@dataclass
class Fragment:
    """Open prefix and suffix; `head`: the byte range in which the first common end lies (None: no common end yet)."""

    head: int | None
    pre: tuple[list[int], list[int]]
    suf: tuple[list[int], list[int]]

    def join(self, right: Fragment) -> tuple[Fragment, tuple[int, list[int], list[int]] | None]:
        """Both as one fragment, and the group that closes between them, named by the range it ends in."""
        if self.head is None:
            pre = tuple(x + y for x, y in zip(self.pre, right.pre))
            return Fragment(right.head, pre, right.suf), None
        if right.head is None:
            return Fragment(self.head, self.pre, tuple(x + y for x, y in zip(self.suf, right.pre))), None
        a, b = (x + y for x, y in zip(self.suf, right.pre))
        return Fragment(self.head, self.pre, right.suf), (right.head, a, b)


def _compose(table: pa.Table) -> pa.Table:
    """Up to `FAN` neighbouring fragments as one row, after the groups that close between them."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    whole, closed = None, []
    for r in rows:
        part = Fragment(r["head"], (r["pre_a"], r["pre_b"]), (r["suf_a"], r["suf_b"]))
        if whole is None:
            whole = part
            continue
        whole, group = whole.join(part)
        closed += [group] if group else []
    row = rows[0]["row"]
    out = [(row, None, k, a, b, [], [], True) for k, a, b in closed]
    out.append((row, rows[0]["at"] // FAN, whole.head, *whole.pre, *whole.suf, whole.head is not None))
    ints = pa.list_(pa.int32())
    types = (pa.int64(), pa.int64(), pa.int64(), ints, ints, ints, ints, pa.bool_())
    return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [c.split()[0] for c in _FRAGMENT.split(", ")])


def _heads(a_path: str, b_path: str):
    """Groups that closed across ranges, as text and link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                key = r["pre_a"][-1] * len(pair.b_bytes) + r["pre_b"][-1]
                body = f"{','.join(map(str, r['pre_a']))}|{','.join(map(str, r['pre_b']))};"
                rows.append((r["row"], r["head"], 0, 1, body, [int(np.searchsorted(pair.keys, key))]))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [c.split()[0] for c in _PIECE.split(", ")])

    return run


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of each text in order, hashed as they pass; only link counts, which the vocabularies bound, stay in memory."""
    row, held = None, ""

    def finished() -> pa.RecordBatch:
        keys = np.array(sorted(times), np.int32)
        return _doc_batch([(row, None, 0, 0, n, digest.hexdigest(), keys, np.array([times[x] for x in keys.tolist()], np.int32))])

    for batch in batches:
        for r in batch.to_pylist():
            if r["row"] != row:
                if row is not None:
                    digest.update(held[:-1].encode())
                    yield finished()
                row, held, n, times, digest = r["row"], "", 0, {}, hashlib.sha256()
            if r["body"]:
                digest.update(held.encode())
                held = r["body"]
            n += r["n_groups"]
            for p in r["pairs"]:
                times[p] = times.get(p, 0) + 1
    if row is not None:
        digest.update(held[:-1].encode())
        yield finished()


def _long_groups(long: DataFrame, a_path: str, b_path: str, part: int, span: int) -> DataFrame:
    """Groups of long texts (`row, doc_id, text`) through fragments."""
    spark = long.sparkSession
    width = shuffle_width(long)
    with batch_rows(spark, 64):
        parts = keep(long.select("row", "text").mapInArrow(_cut(a_path, b_path, part), "row long, side int, start long, part string"), "parts")
        tokens = keep(
            parts.repartition(width).mapInArrow(_encode(a_path, b_path, span), "row long, k long, side int, same boolean, ids array<int>, ends array<long>"), "tokens"
        )
        per_text = tokens.groupBy("row").agg(
            F.sum(F.when(F.col("side") == 0, F.size("ids")).otherwise(0)).alias("n_a"),
            F.sum(F.when(F.col("side") == 1, F.size("ids")).otherwise(0)).alias("n_b"), F.min("same").alias("same"),
        )
        per_text = keep(per_text, "sizes")
        aligned = tokens.join(per_text.where("same").select("row"), "row")
        fragments = keep(aligned.groupBy("row", "k").applyInArrow(_range_fragment(a_path, b_path), f"{_FRAGMENT}, n_groups long, body string, pairs array<int>"), "fragments")
        inside = fragments.select("row", F.col("at").alias("k"), F.lit(1).alias("part"), "n_groups", "body", "pairs")
        level = fragments.drop("n_groups", "body", "pairs")
        closed = None
        while True:
            step = keep(level.withColumn("up", F.floor(F.col("at") / FAN)).groupBy("row", "up").applyInArrow(lambda t: _compose(t.drop(["up"])), _FRAGMENT), "level")
            between = step.where("at IS NULL")
            closed = between if closed is None else closed.unionByName(between)
            level = step.where("at IS NOT NULL")
            if not level.where("at > 0").limit(1).count():
                break
        # The first common end closes the group that begins with the text; both sides end with its last byte.
        closed = closed.unionByName(level.where("closed"))
        pieces = inside.unionByName(closed.mapInArrow(_heads(a_path, b_path), _PIECE))
        done = pieces.repartition(width, "row").sortWithinPartitions("row", "k", "part").mapInArrow(_assembled, _DOC).select("row", "n_groups", "groups_sha256", "pairs", "times")
        joined = long.select("row", "doc_id").join(per_text, "row", "left").join(done, "row", "left")
        size = lambda name: F.when(F.col("same"), F.col(name)).otherwise(0).cast("long").alias(name)
        none = F.array().cast("array<int>")
        return keep(joined.select(
            "row", "doc_id", size("n_a"), size("n_b"), F.coalesce("n_groups", F.lit(0)).cast("long").alias("n_groups"),
            F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"), F.coalesce("pairs", none).alias("pairs"), F.coalesce("times", none).alias("times"),
        ), "long-groups")


def _link_counts(n_pairs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            pairs, times = (batch.column(c).flatten() for c in ("pairs", "times"))
            total += np.bincount(np.asarray(pairs), np.asarray(times), minlength=n_pairs).astype(np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["pair", "count"])

    return run


def _scored(counts, best):
    """Per text: links whose count is the highest of their B token, and the sum of counts over its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, top = counts.value, best.value
        for batch in batches:
            offsets = np.asarray(batch.column("pairs").offsets) - batch.column("pairs").offsets[0].as_py()
            pairs, times = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("pairs", "times"))
            sums = [np.concatenate(([0], np.cumsum(x)))[offsets] for x in (times, times * top[pairs], times * count[pairs])]
            links, n_best, total = (np.diff(s).astype(np.int64) for s in sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")] + [pa.array(links), pa.array(n_best), pa.array(total), batch.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return run


def align(
    docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", long_from: int = LONG, part: int = PART, span: int = RANGE
) -> DataFrame:
    """`doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`, one row for each row of `docs`.

    A encodes space+text, B the text to which it adds the space itself, both without special tokens. A text that is null,
    empty, or does not come back byte for byte from the tokens of both has no tokens: zeros and an empty digest. Groups end
    where tokens of both end; a link is the pair of tokens that ends a group; `n_best` counts links whose pair is the most
    frequent of its B token in all rows (ties included); `count_sum` adds up the pairs' counts over the links.

    Rows that repeat, or lack an id, count each time. Other columns are not read. The counts that go to every task have as many
    entries as pairs of tokens of which one's bytes end with the other's: the vocabularies bound them, not the texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    pair = _pair(a_path, b_path)
    with batch_rows(spark, 256):
        short = rows.where(size <= long_from).select(F.lit(-1).cast("long").alias("row"), "doc_id", "text")
        groups = keep(short.mapInArrow(_short(a_path, b_path), _DOC), "groups")
    long = keep(rows.where(size > long_from).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "long")
    if long.limit(1).count():
        groups = groups.unionByName(_long_groups(long, a_path, b_path, part, span))
    met = groups.select("pairs", "times").mapInArrow(_link_counts(len(pair.keys)), "pair int, count long")
    met = met.groupBy("pair").agg(F.sum("count").alias("count")).toArrow()
    count = np.zeros(len(pair.keys), np.int64)
    count[np.asarray(met.column("pair"))] = np.asarray(met.column("count"))
    b = pair.keys % len(pair.b_bytes)
    highest = np.zeros(len(pair.b_bytes), np.int64)
    np.maximum.at(highest, b, count)
    counts, best = (spark.sparkContext.broadcast(x) for x in (count, (count == highest[b]) & (count > 0)))
    return groups.select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times").mapInArrow(
        _scored(counts, best), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
