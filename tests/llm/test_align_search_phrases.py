"""Tokenizer alignment, nearest neighbours and collocations against brute force and on edge cases."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from troughline.llm import alignment, collocations, polytope

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "<|endoftext|> <s> </s> <0x41>"), (5, "a▁b"), (6, "漢字かな交じり文。" * 60), (7, "word one, two\n\nthree  four " * 40),
    (None, "x" * 900), (9, "日本" * 90 + "é ñ é ﬁ" + "中文字符測試，。" * 80), (9, "a\x00b\tc"), (9, "a\x00b\tc"), (10, "_" * 300 + " a_b" * 200), (11, " " * 400 + "end " * 200),
]


# --- alignment ----------------------------------------------------------------------------------------------


def _ends(ids, table):
    out, at = [], 0
    for i in ids:
        at += len(table[i])
        out.append(at)
    return out


def aligned(pair, rows):
    """The definition, text by text, on whole encodings."""
    per, count, best = [], Counter(), {}
    for doc, text in rows:
        target = (" " + (text or "")).encode()
        a, b = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids, pair.b.encode(text or "")
        if not text or any(b"".join(t[i] for i in x) != target for t, x in ((pair.a_bytes, a), (pair.b_bytes, b))):
            per.append((doc, None))
            continue
        at_a, at_b = ({e: n for n, e in enumerate(_ends(x, t))} for x, t in ((a, pair.a_bytes), (b, pair.b_bytes)))
        groups, links, i, j = [], [], 0, 0
        for end in at_a:
            if end in at_b:
                x, y = at_a[end] + 1, at_b[end] + 1
                groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
                links.append((a[x - 1], b[y - 1]))
                i, j = x, y
        count.update(links)
        per.append((doc, (len(a), len(b), groups, links)))
    for (_, b), c in count.items():
        best[b] = max(best.get(b, 0), c)
    out = []
    for doc, r in per:
        if r is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = r
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(A, B)


@pytest.mark.parametrize("sizes", [{}, {"long_from": 100, "part": 60, "span": 40}])
def test_alignment_equals_whole_encodings_and_fragments_agree(spark, pair, sizes):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id long, text string, row string, n_a int")
    got = sorted(map(tuple, alignment.align(docs, A, B, **sizes).collect()), key=repr)
    assert got == aligned(pair, TEXTS)
    assert sum(r[1] > 0 for r in got) >= 8


def test_fragments_compose_associatively(pair):
    text = "Some words, ünïcode 漢字 and    blanks. " * 6
    a, b = np.array(pair.a.encode(" " + text, add_special_tokens=False).ids), np.array(pair.b.encode(text))
    ends_a, ends_b = np.array(_ends(a.tolist(), pair.a_bytes)), np.array(_ends(b.tolist(), pair.b_bytes))
    common = np.intersect1d(ends_a, ends_b)
    parts = []
    for k in range(0, int(ends_a[-1]), 3):  # many ranges hold no common end
        x, y, c = (e[(e > k) & (e <= k + 3)] for e in (ends_a, ends_b, common))
        ids = lambda own, ends: own[np.isin(ends_a if own is a else ends_b, ends)].tolist()
        if len(c):
            parts.append(alignment.Fragment(k, (ids(a, x[x <= c[0]]), ids(b, y[y <= c[0]])), (ids(a, x[x > c[-1]]), ids(b, y[y > c[-1]]))))
        else:
            parts.append(alignment.Fragment(None, (ids(a, x), ids(b, y)), ([], [])))

    def folded(items, from_left):
        closed, items = [], list(items)
        while len(items) > 1:
            i = 0 if from_left else len(items) - 2
            whole, group = items[i].join(items[i + 1])
            items[i:i + 2] = [whole]
            closed += [group] if group else []
        return items[0], sorted(closed)

    assert folded(parts, True) == folded(parts, False)
    whole, _ = folded(parts, True)
    assert whole.head is not None and whole.suf == ([], [])


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_every_link_of_the_vocabularies_has_a_number(pair):
    keys = set(pair.keys.tolist())
    n = len(pair.b_bytes)
    assert len(keys) <= sum(map(len, pair.a_bytes)) * 2 + sum(map(len, pair.b_bytes))
    a, b = pair.a.encode(" the", add_special_tokens=False).ids[-1], pair.b.encode("the")[-1]
    assert a * n + b in keys


# --- nearest neighbours ---------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, cell string, vid int, ids string"


def _nearest(rows, query, k):
    """Ranked others of a row, by position, so that repeated rows stay apart."""
    me = rows[query]
    other = [(-float(np.dot(np.array(v, np.float64), np.array(me[1], np.float64))), i is None, i or 0) for n, (i, v) in enumerate(rows) if n != query and len(v) == len(me[1])]
    return [(round(-s, 9), None if none else i) for s, none, i in sorted(other)[:k]]


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(70)]
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(20, rows[20][1]), (None, rows[5][1]), (300, [1.0, 2.0]), (320, [2.0, 1.0])]
    odd = [(400, None), (420, [0.0] * 12), (440, [float("nan")] * 12), (460, [float("inf")] + [1.0] * 11), (480, [None] + [1.0] * 11), (500, [])]
    df = spark.createDataFrame([(i, v, 0, "c", 1, "x") for i, v in rows + odd], VECTORS)
    got: dict = {}
    for r in polytope.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], round(r["score"], 9), r["vec_id"]))
    assert set(got) == {i for i, _ in rows if i is not None and i % 20 == 0}
    assert got[300] == [(1, 4.0, 320)] and got[320] == [(1, 4.0, 300)]
    for n, (i, v) in enumerate(rows):
        if i is None or i % 20 or len(v) == 2 or i == 20:
            continue
        assert [(s, j) for _, s, j in sorted(got[i])] == _nearest(rows, n, 20)
        assert [r for r, _, _ in sorted(got[i])] == list(range(1, 21))
    # Both rows of id 20 are queries; each finds the other first.
    assert len(got[20]) == 40 and [(s, j) for _, s, j in sorted(got[20])][:2] == [_nearest(rows, 20, 1)[0]] * 2


def test_search_of_nothing(spark):
    assert polytope.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_over_lengths_and_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(polytope, "BLOCK", 64)
    monkeypatch.setattr(polytope, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 16)) * np.exp(rng.normal(size=(1500, 1)))
    x[:500] = x[0] + rng.normal(size=(500, 16)) * 0.01  # a third of all rows close together
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0, "c", 1, "x") for i, v in rows], VECTORS.replace("float", "double"))
    found: dict = {}
    for r in polytope.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(found[i] & {j for _, j in _nearest(rows, i, 10)}) / 10 for i in range(0, 1500, 20)]
    assert len(hits) == 75 and np.mean(hits) >= 0.9


def test_cells_with_several_digits_are_probed_likeliest_first():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 24))
    units, band = polytope.lengths(x)
    assert np.allclose(np.linalg.norm(units, axis=1), 1) and set(band.tolist()) <= set(range(2, 8))
    assert np.allclose(np.linalg.norm(polytope.rotate(units, 4), axis=1), 1)
    for digits in (1, 2):
        own = polytope.cells(units, 0, digits)
        assert (polytope.probes(units, 0, digits, 5)[:, 0] == own).all()
    all_cells = polytope.probes(units[:3], 1, 2, 64 * 64)
    assert all(len(set(r)) == 64 * 64 for r in all_cells.tolist())


# --- collocations ---------------------------------------------------------------------------------------------


def phrases(rows, threshold, cover, top):
    import re

    out = []
    langs: dict = {}
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            langs.setdefault(lang or "und", []).append(re.findall("[^ \t]+", piece))
    for lang, pieces in langs.items():
        f = Counter(tuple(p[i:i + k]) for p in pieces for k in (1, 2, 3, 4) for i in range(len(p) - k + 1))
        total, good = sum(map(len, pieces)), {p: c for p, c in f.items() if len(p) > 1 and c >= threshold}
        rows_of = []
        for p, a in good.items():
            cut = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = [c for q, c in good.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * c >= cover * a for c in inside):
                rows_of.append((-cut[0], -a, " ".join(p).encode(), f[p[:cut[1]]], f[p[cut[1]:]]))
        for n, (s, a, p, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, n, p.decode(), -a, left, right, total, -s))
    return sorted(out)


def _corpus():
    rng = np.random.default_rng(11)
    words = [*"abcdefgh", "漢字", "É", "é", "New", "new", "york"]
    rows = [("en" if i % 3 else None, " ".join(rng.choice(words, 60)) + rng.choice([".", "\n", ", ", " "]) + "New York city hall. " * int(rng.integers(0, 3))) for i in range(60)]
    return [*rows, ("und", "und too: new york city"), ("en", None), ("en", ""), (None, " \t.;"), ("de", "a b c d e " * 2000), ("de", "a b c d e " * 2000), ("xx", "one word")]


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_brute_force(spark, monkeypatch, small):
    if small:  # a full table of reached phrases changes what is counted early, not the result
        monkeypatch.setattr(collocations, "SLOTS", 64)
    rows = _corpus()
    df = spark.createDataFrame([(lang, text, "x", 1, 2) for lang, text in rows], "lang string, text string, phrase string, n int, shard int").repartition(7)
    got = collocations.collocations(df, threshold=5, top=50)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases(rows, 5, 80, 50)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_long_texts_are_cut_at_pieces():
    text = b"ab cd. " * 10 + b"x" * 50 + b"; tail"
    original = collocations.CHUNK
    try:
        collocations.CHUNK = 32
        parts = list(collocations._parts(text))
    finally:
        collocations.CHUNK = original
    assert b"".join(parts).replace(b".", b"").replace(b";", b"") == text.replace(b".", b"").replace(b";", b"")
    assert all(len(p) <= 32 or b"x" * 50 in p for p in parts)
