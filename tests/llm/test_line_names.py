"""Line dedup in one process: what its names, its walk of posting lists and its second round read and send."""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from troughline.llm import line_dedup
from troughline.llm.common import unpack
from troughline.llm.words import cut

S = line_dedup.SIMILARITY
CLASSES = np.zeros(line_dedup.CELLS, np.uint64)


def named(texts, parts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "t"])
    return [r for b in line_dedup._named_lines(iter([batch]), parts) for r in b.to_pylist()]


def test_equal_lines_are_sent_once():
    """A task sends a block for each part and slice, not a row for each line and word cell; of equal lines one goes on."""
    texts = [f"Common LINE here\n\nown line {i % 7}" for i in range(400)]
    blocks = named(texts, 3)
    lines = [r for r in blocks if r["part"] < 3]
    assert len(lines) <= 3 and len(blocks) - len(lines) <= line_dedup.CELLS // line_dedup.SLICE
    assert sum(len(unpack(r["id"], "<i8")) for r in lines) == 8
    assert sum(len(unpack(r["gone_id"], "<i8")) for r in lines) == 792
    assert sum(unpack(r["cells"], "<i8").sum() for r in blocks if r["part"] >= 3) == 400 * 6


@pytest.mark.parametrize("names", [1, 1_000_000])
def test_equal_lines_of_several_tasks(names, monkeypatch):
    """The earliest line of each set stays, wherever its equals were sent from, and frequencies add up."""
    monkeypatch.setattr(line_dedup, "NAMES", names)
    texts = ["a b\nb A\nc", "C\na b\n", "d d d\nc c", " \n"]
    blocks = [r for _ in range(2) for r in named(texts, 2)]
    tables = [
        line_dedup._equal_lines(pa.Table.from_pylist([r for r in blocks if r["part"] == p], schema=line_dedup._NAMES_SCHEMA), 2).to_pylist()
        for p in sorted({r["part"] for r in blocks})
    ]
    rows = [r for t in tables for r in t]
    assert {(r["id"], r["line"]) for r in rows if r["line"] is not None} == {(0, 1), (1, 0), (1, 1), (2, 1)}
    assert sum(r["n"] for r in rows if r["n"] is not None) == 3
    assert sum(unpack(r["cells"], "<i8").sum() for r in rows if r["cells"] is not None) == 2 * (5 + 3 + 5)


def lines_of(texts):
    """Lines as the candidate step holds them, all of them asked for, and their sets of words."""
    lines = []
    for words in cut(pa.array(texts)):
        for doc, line, n, tokens in line_dedup.token_sets(words, CLASSES):
            lines.append((doc, line, n, tokens, np.ones(len(n), bool)))
    return lines, [frozenset(t.split()) for t in texts]


def similar(sets):
    return {(j, i) for i, j in combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4}


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(3)
    return [" ".join(f"w{i}" if rng.random() < 0.93 else f"v{rng.integers(90)}" for i in range(int(rng.choice([6, 20, 24, 90, 150])))) for _ in range(160)]


@pytest.mark.parametrize("stride", [1, 64, 1 << 14])
def test_walk_meets_every_similar_pair(crowd, stride, monkeypatch):
    """However many earlier lines it looks at in a step; with a limit it marks the lines that may have more."""
    monkeypatch.setattr(line_dedup, "STRIDE", stride)
    monkeypatch.setattr(line_dedup, "ENOUGH", 2)
    lines, sets = lines_of(crowd)
    blocks = pd.DataFrame(list(line_dedup._postings(lines, 1, None, S)))
    want = similar(sets)
    different = {(i, j) for i, j in want if sets[i] != sets[j]}
    every = line_dedup._meet(blocks, S, None)
    assert different and different <= set(zip(every["id"], every["to_id"]))
    some = line_dedup._meet(blocks, S, 1)
    met = set(zip(some["id"], some["to_id"]))
    # A line whose similar ones were all passed over is open.
    assert {i for i, _ in different} <= {i for i, _ in met & want} | set(some.loc[some["more"], "id"])


def test_second_round_passes_over_no_similar_line(crowd):
    """Lines with too few tokens among those of lines that are asked for are passed over, none that is similar to one."""
    texts = [*crowd, *[f"other{i} line{i} apart{i}" for i in range(40)]]
    (line,), sets = lines_of(texts)
    _, _, n, tokens, _ = line
    asked = [3, 50, 99]
    among = np.zeros(line_dedup.SPREAD, bool)
    start = np.r_[0, np.cumsum(n)]
    for i in asked:
        among[(tokens[start[i]:start[i + 1]] & np.uint64(line_dedup.SPREAD - 1)).astype(np.int64)] = True
    left = set(np.flatnonzero(line_dedup._like_asked(n, tokens, among, S)))
    assert {*asked, *[x for pair in similar(sets) for x in pair if set(pair) & set(asked)]} <= left
    assert not left & set(range(160, 200))
