"""Fingerprints, packing, counts, language model, mixing, licences and ranking against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from troughline.llm import common, katz, licenses, mixing, packing, quality, spotsigs, token_counts, words

tokenizers = pytest.importorskip("public_tokenizers")
END = b""


def lowered(text):
    return (text or "").encode().lower().split()


# --- words as arrays ------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB Éx\n\t\r漢.", max_size=40), max_size=6), st.sampled_from([8, 1 << 20]))
def test_words_of_a_batch(texts, size):
    words.BYTES = words.BLOCK = size
    got = defaultdict(list)
    hashes = {}
    for w in words.cut(pa.array(texts, pa.string())):
        for d, n, s, e, h in zip(w.doc, w.line, w.start, w.end, w.hashes()):
            word = bytes(w.data[s:e])
            assert hashes.setdefault(word, h) == h
            got[d, n].append(word)
    want = {(d, n): line.split() for d, t in enumerate(texts) for n, line in enumerate(t.encode().lower().split(b"\n")) if line.split()}
    assert got == want and len(set(hashes.values())) == len(hashes)
    words.BYTES, words.BLOCK = 4 << 20, 1 << 20


@given(st.lists(st.integers(0, 2**63 - 1), max_size=50))
def test_packed_numbers_come_back(values):
    assert common.unpack(common.pack(np.array(values, "<i8")), "<i8").tolist() == values


# --- fingerprints -----------------------------------------------------------------------------------------------


def signatures(text, chain=2):
    import re

    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    out = set()
    for i, a in enumerate(w):
        if a in spotsigs.ANCHORS:
            own = [x for x in w[i + 1:i + 50] if x not in spotsigs.ANCHORS][:chain]
            if own:
                out.add((a, *own))
    return out, w


def test_fingerprints_of_texts_and_edits(docs, texts):
    """Ids are distinct here but for repeats, which follow each other in order of text."""
    ordered = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    want = Counter()
    for at, (i, t) in enumerate(ordered):
        t, following = t or "", ordered[(at + 1) % len(ordered)][1] or ""
        third = len(t) // 3
        edited = t[:len(t) - third] + following[:third]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    got = spotsigs.fingerprint_edits(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    sets = lambda f: {f[i:i + 8] for i in range(0, len(f), 8)}
    by_text = defaultdict(set)
    text_of = {i: t or "" for i, t in texts if i is not None}
    for r in got:
        a, b = sets(r.fingerprint), sets(r.edited_fingerprint)
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0) and 0 <= r.near_next <= 1
        if r.doc_id is not None:
            by_text[text_of[r.doc_id]].add(r.fingerprint)
            chains, w = signatures(text_of[r.doc_id])
            if len(chains) >= 30:  # clear of the rule for sparse texts, which adds single words
                assert len(a) == len(chains)
    assert all(len(v) == 1 for v in by_text.values())


def test_ranges_do_not_change_neighbours(spark):
    rows = spark.createDataFrame([(i * i, f"text {i}") for i in range(60)], "doc_id int, text string")
    pairs = {w: {r.id: r.next_t for r in spotsigs.with_next(rows, "doc_id", "text", w).collect()} for w in (None, 1, 7)}
    assert pairs[None] == pairs[1] == pairs[7]
    assert pairs[1][0] == "text 59" and pairs[1][25] == "text 4"


def test_near_pairs(spark):
    a = "The cat and the dog of a house were in the garden with an old tree by the gate and a stone on the path to the sea from the hill " * 2
    rows = [(1, a + " and the end of days"), (2, a + " and the end of days"), (3, a + " and the rim of worlds"), (4, "The fox ran to a den"), (5, ""), (6, None)]
    pairs, members = spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id int, text string"), 0.6)
    assert [(r.a, r.b) for r in pairs.collect()] in ([(3, 1)], [(1, 3)])
    assert {(r.doc_id, r.representative) for r in members.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


# --- packing ----------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_completed_bins_hold_every_piece(lengths):
    bins = packing.complete(np.array(lengths), 100, 50)
    assert sorted(x for b in bins for x in b) == sorted(lengths) and max(map(sum, bins)) <= 100
    assert len(bins) <= len(packing.best_fit(np.array(lengths), 100))


def test_search_beats_best_fit():
    """Best-fit decreasing needs three bins here; two are enough."""
    lengths = np.array([40, 30, 30, 30, 35, 35])
    assert len(packing.best_fit(lengths, 100)) == 3 and len(packing.complete(lengths, 100, 500)) == 2


def test_packed_documents(docs, texts, nothing):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    want = Counter()
    for i, t in texts:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at:at + 2048]
            want[i, n, at, len(own), zlib.crc32(own.tobytes())] += 1
    got = packing.pack_documents(docs, path, group=100).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(nothing, path).count() == 0


# --- token counts -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    return token_counts.load_encoding(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 1.'s\n\x1c é", max_size=120), st.lists(st.tuples(st.integers(-5, 140), st.integers(-2, 40), st.text(alphabet="ab 1.'\n ", max_size=12)), max_size=4))
def test_edited_counts_equal_full_counts(encoding, text, edits):
    count = lambda s: len(encoding.encode_ordinary(s))
    own = token_counts.leaves(text, 5)
    ends = np.cumsum([0, *own]).tolist()
    tree = token_counts.CountTree(own, [count(text[a:b]) for a, b in zip(ends, ends[1:])])
    assert sum(own) == len(text) and tree.tokens[1] == count(text)
    for start, cut, insert in edits:
        at = min(max(start, 0), len(text))
        want = text[:at] + insert + text[at + min(max(cut, 0), len(text) - at):]
        text, _ = tree.edit(text, start, cut, insert, count)
        assert text == want and tree.tokens[1] == count(text) and tree.chars[1] == len(text)


def test_counts_of_a_table(spark, docs, texts, encoding, nothing):
    path, pattern = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    edits = spark.createDataFrame(
        [(10_004, 1, 100, 7, "new words"), (10_004, 2, 90_000, 0, "x"), (10_002, 1, 5, 5, "filled"), (10_009, 1, None, None, None)],
        "doc_id long, edit_no int, start int, cut int, insert string",
    )
    got = token_counts.edit_counts(token_counts.with_edits(docs, edits), path, pattern).collect()
    n = lambda t: len(encoding.encode_ordinary(t or ""))
    assert Counter((r.doc_id, r.n_chars, r.n_tokens) for r in got) == Counter((i, len(t or ""), n(t)) for i, t in texts)
    by_id = {r.doc_id: r for r in got}
    long = dict(x for x in texts if x[0] is not None)[10_004]
    long = long[:100] + "new words" + long[107:]
    long = long[:90_000] + "x" + long[90_000:]
    assert by_id[10_004].edited_tokens == n(long) and by_id[10_004].recoded_chars < 4000
    assert by_id[10_002].edited_tokens == n("filled") and by_id[10_009].edited_tokens == n("one")
    assert by_id[10_001].n_leaves == 0 and by_id[10_008].recoded_chars == 0
    empty = nothing.withColumn("edits", F.lit(None).cast(token_counts._EDITS))
    assert token_counts.edit_counts(empty, path, pattern).count() == 0


# --- language model -----------------------------------------------------------------------------------------------


def model(train):
    """Katz bigrams over lists of tokens: (unigram chance, conditional chance, counts)."""
    k = katz.TRUSTED
    c1, c2 = Counter(), Counter()
    for w in train:
        c1.update(w)
        c2.update(zip([END, *w], w))
    n = sum(c1.values())
    d1, d2 = (katz.Discounts.learn([sum(v == r for v in c.values()) for r in range(1, k + 2)]).factors for c in (c1, c2))
    d = lambda f, c: f[c - 1] if c <= k else 1.0
    lost = sum((1 - d(d1, c)) * c for c in c1.values()) / max(n, 1)
    free = max(lost, 1 / (n + 1))
    p1 = lambda w: (1 - free) / (1 - lost) * d(d1, c1[w]) * c1[w] / n if c1[w] else free
    after = defaultdict(list)
    for (h, w), c in c2.items():
        after[h].append((w, c))
    alpha = {h: (1 - sum(d(d2, c) * c for _, c in s) / (c1[h] + 1)) / (1 - sum(p1(w) for w, _ in s)) for h, s in after.items()}
    p2 = lambda h, w: d(d2, c2[h, w]) * c2[h, w] / (c1[h] + 1) if c2[h, w] else alpha.get(h, 1.0) * p1(w)
    return p1, p2, c1


@pytest.mark.parametrize("hot", [False, True])
def test_katz_scores(docs, texts, hot, monkeypatch):
    """Also with many small chunks and owners, and with nearly every word dealt over several owners."""
    if hot:
        for name, value in (("CHUNK", 500), ("WORDS", 300), ("PAIRS", 400)):
            monkeypatch.setattr(katz, name, value)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    lists = [(i, [*lowered(t), END]) for i, t in texts]
    p1, p2, c1 = model([w for i, w in lists if not held(i)])
    for h in (END, b"the", b"of"):
        assert sum(p2(h, w) for w in c1) + p2(h, b"never seen") == pytest.approx(1, abs=1e-9)
    n, v = sum(c1.values()), len(c1)
    want = sorted((
        i or -1, held(i), len(w), sum(c1[x] > 0 for x in w), n, sum(math.log10((c1[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w),
        sum(math.log10(p2(h, x)) for h, x in zip([END, *w], w)),
    ) for i, w in lists)
    got = katz.score_texts(docs, common.id_remainder("doc_id", 5) == 1)
    got = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got.collect())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5:] for r in got] == [pytest.approx(r[5:], rel=1e-9) for r in want]


def test_hot_histories_are_summed_over_owners():
    """A hot word's successors lie with several owners; the chunk's answer and the broadcast sums say the same."""
    import pandas as pd

    uni = katz.Unigrams.learn(4, 40, [1, 1, 0, 0, 0, 0])
    ask = lambda chunk, h, w, c, hot: {
        "part": 0, "chunk": chunk, "history": common.pack(np.diff(np.array(h, "<i8"), prepend=0)), "word": common.pack(np.array(w, "<i8")),
        "learnt": common.pack(np.array(c, "<i8")), "word_count": common.pack(np.array([5] * len(w), "<i8")), "hot": common.pack(np.array(hot, "<i8")),
    }
    out = katz._own_pairs(uni)((0,), pd.DataFrame([ask(1, [3, 3, 9], [1, 2, 1], [1, 0, 2], [9]), ask(2, [3, 9], [1, 4], [1, 0], [9])]))
    assert out[out.kind == "chunk"].counts.map(lambda b: common.unpack(b, "<i8").tolist()).tolist() == [[2, 0, 2], [2, 0]]
    hot = out[out.kind == "hot"].iloc[0]
    assert common.unpack(hot.after, "<i8").tolist() == [9] and common.unpack(hot.n, "<i8").tolist() == [0, 1, 0, 0, 0]
    assert out[out.kind == "seen"].iloc[0].seen == [0, 2, 0, 0, 0, 0]


def test_katz_without_training_text(docs, texts, nothing):
    out = katz.score_texts(docs, F.lit(True)).agg(F.count("*"), F.sum("n_known"), F.max("train_tokens"), F.max("score")).first()
    assert out[:3] == (len(texts), 0, 0) and out[3] <= 0
    assert katz.score_texts(nothing, F.lit(False)).count() == 0


# --- mixing -------------------------------------------------------------------------------------------------------


def targets_by_force(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, left = sum(sizes.values()), {}, set(names)
    while left:
        unit = (total - sum(out.values())) / sum(w[s] for s in left)
        over = {s for s in left if unit * w[s] > most * sizes[s] + 1e-9}
        if not over:
            return out | {s: unit * w[s] for s in left}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= over
    return out


def test_mix(docs, texts, nothing):
    source = {}
    for n, (i, t) in enumerate(texts):
        source.setdefault(None if n % 4 == 0 else f"src{n % 3}", []).append(len(lowered(t)))
    sizes = {s: sum(v) for s, v in source.items()}
    want = targets_by_force(sizes)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts) and rows == mixing.mix(docs.repartition(5)).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    by = defaultdict(list)
    for r in rows:
        by[r.source_size].append(r)
        assert 0 <= r.taken <= 3 * r.size and (r.first_shard is None) == (r.taken == 0)
    assert {s: own[0].target for s, own in by.items()} == {sizes[s]: pytest.approx(t) for s, t in want.items()}
    for size, own in by.items():
        assert abs(sum(r.taken for r in own) - own[0].target) <= mixing.BLOCK
    assert mixing.mix(nothing).count() == 0


def test_limits_share_their_excess(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0)], "s string, size long")
    key = F.struct(F.col("s").isNull().alias("none"), F.coalesce("s", F.lit("")).alias("name"))
    got = {r.src_key.name if not r.src_key.none else None: r.target for r in mixing.targets(rows.select(key.alias("src_key"), "size")).collect()}
    assert got == {k: pytest.approx(v) for k, v in targets_by_force({"a": 10, "b": 1000, "c": 500, None: 0}).items()}
    assert got["a"] == 30 and got[None] == 0


@pytest.mark.parametrize("n", [1, 2, 64, 997, 5000])
def test_permutations_visit_every_block_once(spark, n):
    for src in range(3):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(src).cast("long")).alias("b"))
        assert got.agg(F.countDistinct("b"), F.min("b"), F.max("b")).first() == (n, 0, n - 1)


# --- licences -----------------------------------------------------------------------------------------------------


def test_license_scan(spark, docs, texts, nothing):
    rows = [
        (1, "a/b/LICENSE", "Released under the MIT License.", True), (2, "a/b/c/x", "no notice", False), (3, "a/y", "none\n", False),
        (4, "a/b/c/z", "text\nLicensed under CC BY-NC 4.0.\n", False), (5, "LICENSE", "This work is licensed under the GNU General Public License, version 3.", True),
        (6, None, None, False), (7, "a/b/d/LICENSE", "licensed UNDER the Apache License, version 2.0!", True), (8, "a/b/d/e/f", "", False),
        (9, "a/bc/q", "license to kill is not a notice at all, this line only mentions the word license", False),
    ]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id int, p string, text string, f boolean"), F.col("p"), F.col("f"))
    got = {r.doc_id: (r.own_licence, r.licence, r.licence_folder) for r in out.collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "MIT", "a/b"), 3: (None, "GPL-3.0", ""), 4: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 5: ("GPL-3.0", "GPL-3.0", None),
        6: (None, "GPL-3.0", ""), 7: ("Apache-2.0", "Apache-2.0", None), 8: (None, "Apache-2.0", "a/b/d"), 9: (None, "GPL-3.0", ""),
    }
    assert licenses.scan(docs, F.lit("x/y"), F.lit(False)).count() == len(texts)
    assert licenses.scan(nothing, F.lit("x"), F.lit(True)).count() == 0


# --- ranking ------------------------------------------------------------------------------------------------------


def test_ranking_separates_held_out_documents(spark):
    import random

    rng = random.Random(4)
    word = lambda: rng.choice(["stone", "river", "light", "garden", "walk", "quiet", "under", "morning"])
    rows, labels = [], []
    for i in range(240):
        own = [word() for _ in range(rng.randint(20, 60))]
        good = i % 4 > 0
        text = " ".join(own).capitalize() + "." if good else (own[0] + "!! ").upper() * 20
        rows.append((i, text, 9))
        labels.append((i, int(good)))
    labels += [(None, 1), (5, None), (77_777, 0)]
    docs = spark.createDataFrame([*rows, (900, None, 1), (901, "", 1), (None, "Stone.", 1), (3, rows[3][1], 1)], "doc_id long, text string, score int")
    held = common.id_remainder("doc_id", 3) == 1
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.score_documents(docs, known, ~held).select("doc_id", held.alias("held"), "score", "predicted").collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    tested = [r for r in out if r.held and r.doc_id is not None and r.doc_id < 240]
    assert len(tested) > 40 and all(r.predicted == int(r.doc_id % 4 > 0) for r in tested)
    kept = quality.good_documents(docs, known, ~held)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)


def test_ranking_without_labels_or_rows(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_documents(docs, labels, F.lit(True)).select("score").distinct().collect() == [(0.5,)]
    assert quality.score_documents(nothing, labels, F.lit(True)).count() == 0
