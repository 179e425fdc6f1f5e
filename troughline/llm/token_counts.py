"""Edit-aware token counts: a segment tree per document, re-encoded only where edits touch it."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troughline.llm.common import rows_of, text_of

#: Characters after which a leaf ends at the next safe place.
LEAF = 512
#: A blank between two characters that are no white space: every pre-token ends before it, whatever stands around.
SAFE = re.compile(r"(?<=\S) (?=\S)")


def load_encoding(path: str, pattern: str):
    """tiktoken encoding of a rank file and its pre-token pattern; special strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def leaves(text: str, least: int = LEAF) -> list[int]:
    """Lengths of pieces that tokenize independently of each other."""
    out, at = [], 0
    while at < len(text):
        found = SAFE.search(text, at + least)
        end = found.start() if found else len(text)
        out.append(end - at)
        at = end
    return out


class CountTree:
    """Sums of characters and tokens over a document's leaves, in heap order: node i has children 2i and 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n = len(chars)
        self.size = 1 << max(0, (self.n - 1).bit_length())
        pad = [0] * (self.size - self.n)
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character `at`, and where the leaf starts; the last leaf beyond the end."""
        if at >= self.chars[1]:
            at = self.chars[1] - 1
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.size
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def edit(self, text: str, start: int, cut: int, insert: str, count) -> tuple[str, int]:
        """Replace `cut` characters at `start`; returns the new text and how many characters were encoded again.

        The region runs over the touched leaves and grows until both its ends are safe in the new
        text. It becomes one leaf; the others in it stay as empty leaves.
        """
        start = min(max(start, 0), len(text))
        cut = min(max(cut, 0), len(text) - start)
        new = text[:start] + insert + text[start + cut:]
        if not self.n or not self.chars[1]:
            self.__init__([len(new)], [count(new)])
            return new, len(new)
        grown = len(insert) - cut
        a, left = self.find(start)
        b, right = self.find(max(start, start + cut - 1))
        right += self.chars[b + self.size]
        while left and not SAFE.match(new, left):
            a, left = self.find(left - 1)
        while right < len(text) and not SAFE.match(new, right + grown):
            b, right = self.find(right)
            right += self.chars[b + self.size]
        region = new[left:right + grown]
        self.put(a, len(region), count(region))
        for leaf in range(a + 1, b + 1):
            if self.chars[leaf + self.size]:
                self.put(leaf, 0, 0)
        return new, len(region)


def count_trees(docs: DataFrame, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`id, t, leaf_chars, leaf_tokens, edits`: each whole text with its tree's leaves; `edits` passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoding(tokenizer, pattern).encode_ordinary
        for batch in batches:
            chars, tokens = [], []
            for (t,) in rows_of([batch], "t"):
                own, at, counts = leaves(t), 0, []
                for n in own:
                    counts.append(len(encode(t[at:at + n])))
                    at += n
                chars.append(own)
                tokens.append(counts)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), batch.column(2),
            ], names=["id", "t", "leaf_chars", "leaf_tokens", "edits"])

    rows = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t"), "edits")
    return rows.mapInArrow(run, f"id long, t string, leaf_chars array<int>, leaf_tokens array<int>, edits {_EDITS}")


_EDITS = "array<struct<start:int,cut:int,insert:string>>"


def with_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with the list `edits` from a table of `key, edit_no, start, cut, insert`, in order of `edit_no`."""
    one = F.struct("edit_no", F.col("start").cast("int").alias("start"), F.col("cut").cast("int").alias("cut"), "insert")
    listed = edits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda e: F.struct(
        e["start"].alias("start"), e["cut"].alias("cut"), e["insert"].alias("insert")
    )).alias("edits"))
    return docs.join(listed, key, "left")


def recount(trees: DataFrame, tokenizer: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """One row per document: `key, n_chars, n_tokens, n_leaves, edited_chars, edited_tokens, recoded_chars`.

    Edits apply in order, each to the text that the one before it left; places outside the text move to its
    nearest end, and null fields count as 0 or empty. A document without edits keeps its counts and
    encodes nothing again. Null texts count as empty: no leaf, no token. Repeated rows are counted
    each. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoding(tokenizer, pattern).encode_ordinary
        for batch in batches:
            out = []
            for i, text, chars, tokens, edits in rows_of([batch], "id", "t", "leaf_chars", "leaf_tokens", "edits"):
                tree, new, recoded = CountTree(chars, tokens), text, 0
                before = sum(tokens)
                for e in edits or ():
                    if e is not None:
                        new, n = tree.edit(new, e["start"] or 0, e["cut"] or 0, e["insert"] or "", lambda s: len(encode(s)))
                        recoded += n
                out.append((i, len(text), before, len(chars), len(new), tree.tokens[1], recoded))
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_COUNTS)

    return trees.mapInArrow(run, ", ".join(f"{c} long" for c in _COUNTS)).withColumnRenamed("id", key)


_COUNTS = ["id", "n_chars", "n_tokens", "n_leaves", "edited_chars", "edited_tokens", "recoded_chars"]


def edit_counts(docs: DataFrame, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Count whole texts, apply their `edits`, count again where they touch; see `recount`. No row leaves its task."""
    return recount(count_trees(docs, tokenizer, pattern, key, text), tokenizer, pattern, key)
