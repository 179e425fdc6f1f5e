"""Near copies by exact shingle similarity against brute force, and the pipeline stage built on it."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as P
from troughline.llm import shingle_dedup as D
from troughline.llm import simhash_dedup as S


def jaccard(x, y):
    a, b = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()} for w in (x.lower().split(), y.lower().split()))
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_texts():
    """Texts of several lengths with one to eight words changed, so that similarities lie on both sides of 0.8."""
    rng = random.Random(7)
    out = []
    for size in (3, 5, 9, 13, 39, 44, 60, 120, 300):
        for _ in range(4):
            base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
            out.append(" ".join(base))
            for changes in range(1, 9):
                own = list(base)
                for i in rng.sample(range(size), min(changes, size)):
                    own[i] = f"x{rng.randrange(10_000)}"
                out.append(" ".join(own))
    return [*out, "", " \n", "Same five Words in here", "same five words in here"]


def grouped(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= 0.8 - 1e-9:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_every_pair_of_brute_force_is_found(spark):
    texts = edited_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, t string")
    want = grouped(texts)
    assert sum(i != r for i, r in want.items()) > 30
    assert {r.row: r.root for r in D.near_copies(rows).collect()} == want


def test_stage_keeps_one_row_of_each_group(spark):
    texts = edited_texts()
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    rows += [(5, "one two three four five six"), (5, "one two three four five six"), (5, "a b c d e f g"), (4, "A b c d e f g"), (None, "a b c d e f g"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    root = grouped([t or "" for _, t in rows])
    groups: dict = {}
    for at, r in root.items():
        groups.setdefault(r, []).append(rows[at])
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    got = [(r.doc_id, r.text) for r in P.simhash_stage(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fingerprints_alone_link_near_copies(spark, monkeypatch):
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(10_000)}" for _ in range(300)]
        own = list(base)
        for i in rng.sample(range(300), 5):
            own[i] = f"x{rng.randrange(10_000)}"
        texts += [" ".join(base), " ".join(own)]
    want = grouped(texts)
    assert sum(i != r for i, r in want.items()) == 40
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(D, "_in_rows", lambda *_: none)
    monkeypatch.setattr(D, "_pair_by_pair", lambda *_: none)
    got = {r.row: r.root for r in D.near_copies(spark.createDataFrame(list(enumerate(texts)), "row long, t string")).collect()}
    assert sum(got[i] == want[i] != i for i in got) >= 36


@pytest.mark.parametrize("crowd", [0, 300])
def test_close_fingerprints_against_brute_force(spark, crowd):
    rng = random.Random(3)
    prints = []
    for _ in range(150):
        base = rng.getrandbits(64)
        prints += [base, *(base ^ sum(1 << b for b in rng.sample(range(64), d)) for d in (1, 4, 7, 8))]
    middle = rng.getrandbits(64)
    prints += [middle ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(crowd)]
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    want = {tuple(sorted((signed[i], signed[j]))) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 7}
    pairs = [tuple(r) for r in S.close_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), 7).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want
    assert crowd or set(pairs) == want  # a crowded bucket gives some pairs of each row, not all
    rooted = {a for a, b in pairs} | {b for a, b in pairs}
    assert rooted >= {f for pair in want for f in pair}


def test_sets_that_share_a_member_only_do_not_meet(spark):
    """A crowd with one common shingle and different texts otherwise makes no pairs."""
    rng = random.Random(5)
    texts = ["a b c d e " + " ".join(f"w{rng.randrange(100_000)}" for _ in range(60)) for _ in range(50)]
    sets = D._sets(spark.createDataFrame(list(enumerate(texts)), "row long, t string"), 5, 0.8)
    nodes = sets.withColumnRenamed("row", "node")
    one = nodes.select("node", "n").selectExpr("node", "n", "0 AS at", "1L AS k", "node AS root")
    assert D._pair_by_pair(one, nodes, 0.8).count() == 0
    assert D._pair_by_pair(one, nodes, 0.0).count() == 50 * 49 // 2


def test_both_ways_of_summing_give_one_fingerprint(monkeypatch):
    texts = ["", "one", "one two", *(" ".join(f"w{i}" for i in range(n)) for n in (3, 64, 500))]
    few = [D.word_fingerprint(t) for t in texts]
    monkeypatch.setattr(D, "FEW_WORDS", 0)
    assert few == [D.word_fingerprint(t) for t in texts] and few[0] == 0


def test_probes_are_not_broadcast(spark):
    """Fingerprints are few bytes, their probes are not."""
    prints = spark.createDataFrame([(f * 0x9E3779B97F4A7C15 % (1 << 63),) for f in range(1, 500)], "fp long")
    plan = S.close_pairs(prints, 7)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_texts_and_sketches_move_in_small_batches(spark, monkeypatch):
    """A sketch of a long text has thousands of bytes, so a batch of 10,000 pairs fills memory beside the heap."""
    name, rows, held = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, D.keep

    def noted(df, label):
        if "MapInArrow" in df._jdf.queryExecution().logical().toString():
            rows[label] = int(spark.conf.get(name))
        return held(df, label)

    before = spark.conf.get(name)
    monkeypatch.setattr(D, "keep", noted)
    D.near_copies(spark.createDataFrame([(0, "a b c d e f g"), (1, "a b c d e f h"), (2, "i")], "row long, t string"))
    assert {"shingles", "close", "alike"} <= set(rows)
    assert max(rows.values()) <= D.BATCH and spark.conf.get(name) == before
