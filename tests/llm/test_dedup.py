"""Exact, line and SimHash dedup against brute force, on given documents and edge cases."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from troughline.llm import components, exact_dedup, line_dedup, simhash_dedup
from troughline.llm.words import cut


def lowered(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("largest", [False, True])
def test_content_sort(docs, texts, largest):
    groups = defaultdict(list)
    for i, t in texts:
        groups[lowered(t)].append(i)
    best = max if largest else min
    want = Counter()
    for norm, ids in groups.items():
        keep = best((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(norm).hexdigest()] += 1
    got = exact_dedup.content_sort(docs, largest=largest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(map(tuple, got.collect())) == want


def test_content_sort_merges_a_run_over_many_partitions(spark):
    many = [(i, "copy") for i in range(5000)] + [(-i, f"text {i}") for i in range(1, 50)]
    out = exact_dedup.content_sort(spark.createDataFrame(many, "doc_id int, text string").repartition(7)).where("group_size > 1")
    assert out.selectExpr("count(*)", "min(keep_id)", "max(keep_id)", "min(group_size)", "max(group_size)", "sum(int(kept))").first() == (5000, 0, 0, 5000, 5000, 1)


def removed_by_force(texts, similarity=0.8):
    """(id, line) of lines with an earlier similar one; rows of one id are one document."""
    seen, gone = {}, set()
    lines = sorted({(-(1 << 63) if i is None else i, n, frozenset(line.split())) for i, t in texts for n, line in enumerate(lowered(t).split(b"\n"))}, key=lambda x: x[:2])
    first, index = [], defaultdict(list)
    for i, n, words in lines:
        if not words:
            continue
        if words in seen:
            if seen[words] != (i, n):
                gone.add((i, n))
            continue
        seen[words] = (i, n)
        common = Counter(r for w in words for r in index[w])
        if any(k / (len(words) + len(first[r]) - k) >= similarity - 1e-12 for r, k in common.items()):
            gone.add((i, n))
        for w in words:
            index[w].append(len(first))
        first.append(words)
    return gone


@pytest.mark.parametrize("hot", [None, 0, 4])
def test_repeated_lines(spark, docs, texts, hot, monkeypatch):
    """Also where nearly every token counts as hot, and where most candidates wait for the second round."""
    if hot is not None:
        monkeypatch.setattr(line_dedup, "HOT", hot)
        monkeypatch.setattr(line_dedup, "FIRST", 1)
        monkeypatch.setattr(line_dedup, "POSTINGS", 500)
    got = {tuple(r) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == removed_by_force(texts)


def test_near_lines_of_one_group(spark):
    """Many variants of one line: each later one has an earlier one that is similar enough, or not."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(30)]
    texts = []
    for i in range(150):
        own = list(base)
        for at in rng.choice(30, rng.integers(0, 7), replace=False):
            own[at] = f"v{rng.integers(40)}"
        texts.append((i, " ".join(own)))
    got = {tuple(r) for r in line_dedup.repeated_lines(spark.createDataFrame(texts, "doc_id int, text string")).collect()}
    assert got == removed_by_force(texts)


def test_crowd_of_near_lines_that_stops_early(spark, monkeypatch):
    """Lines that stop at their first candidate, sets of many sizes: what the first round misses, the second finds."""
    monkeypatch.setattr(line_dedup, "ENOUGH", 1)
    monkeypatch.setattr(line_dedup, "FIRST", 1)
    rng = np.random.default_rng(11)
    texts = []
    for i in range(120):
        own = [f"w{j}" for j in range(int(rng.integers(1, 24)))] + [f"u{rng.integers(60)}" for _ in range(int(rng.integers(0, 5)))]
        texts.append((i, " ".join(own)))
    got = {tuple(r) for r in line_dedup.repeated_lines(spark.createDataFrame(texts, "doc_id int, text string")).collect()}
    assert got == removed_by_force(texts)


def test_whole_hashes_of_lines():
    """Sets of whole hashes hold each word of a line once, whatever its case."""
    (words,) = cut(pa.array(["a B b\n\nc a C", "d"]))
    doc, line, n, hashes = line_dedup.whole_sets(words)
    assert (doc.tolist(), line.tolist(), n.tolist()) == ([0, 0, 1], [0, 2, 0], [2, 2, 1])
    assert len(set(hashes.tolist())) == 4


def test_removing_lines_keeps_rows_and_order(spark, nothing):
    rows = [(1, "a b c d e\nkeep me\n"), (2, "A b c d e\nother\n\nother"), (3, None), (4, "")]
    out = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id int, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "a b c d e\nkeep me\n", 3, 0), (2, "other\n", 4, 2), (3, None, 0, 0), (4, "", 1, 0)]
    assert line_dedup.remove_repeated_lines(nothing).count() == 0


def fingerprint(text, k):
    w = lowered(text).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups_by_force(prints, distance):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = sorted(prints)
    for at, a in enumerate(own):
        for b in own[:at]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("words", [3, 5])
def test_simhash_groups(docs, texts, words):
    prints = [(i, fingerprint(t, words)) for i, t in texts]
    root = groups_by_force({p for _, p in prints}, 2)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = Counter((i, f"{p:016x}", least.get(root[p])) for i, p in prints)
    got = simhash_dedup.near_duplicates(docs, words=words).select("doc_id", "fingerprint", "component_id")
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize(("distance", "dense"), [(2, 4), (2, 64), (4, 10)])
def test_links_of_crowded_fingerprints(spark, distance, dense, monkeypatch):
    """A tight cluster fills dense buckets; components stay those of all links."""
    monkeypatch.setattr(simhash_dedup, "DENSE", dense)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)}
    for c in centres:
        for _ in range(60):
            prints.add(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    signed = [(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints]
    edges = simhash_dedup.near_links(spark.createDataFrame(signed, "fp long"), distance)
    pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in edges.collect()]
    assert all(0 < (a ^ b).bit_count() <= distance for a, b in pairs)
    root = groups_by_force(prints, distance)
    reached = {r.node % (1 << 64): r.root % (1 << 64) for r in components.components(edges).collect()}
    split = lambda names: sorted(sorted(p for p in prints if names.get(p, p) == n) for n in {names.get(p, p) for p in prints})
    assert split(reached) == split(root)


def test_radii_cover_the_distance():
    """If every group differed by more than its radius, two fingerprints would differ by more than the distance."""
    cost, radii = simhash_dedup.allocate([[0, 1, 9, 99], [0, 2, 9, 99], [0, 1, 9, 99], [0, 5, 9, 99]], 2)
    assert sum(r + 1 for r in radii) == 3 and radii == [0, 0, 0, -1] and cost == 4


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (500, 502), (7, 7)], "a long, b long")
    got = {tuple(r) for r in components.components(edges).collect()}
    assert got == {(i, 0) for i in range(101)} | {(500, 500), (501, 500), (502, 500)}


def test_empty_tables(nothing):
    assert exact_dedup.content_sort(nothing).count() == 0
    assert simhash_dedup.near_duplicates(nothing).count() == 0
