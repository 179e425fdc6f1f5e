import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from troughline.functions.keys import sorted_row_id
from troughline.operators import linkage as Ln

DAY0 = dt.datetime(2020, 1, 1)


def at(hours):
    return None if hours is None else DAY0 + dt.timedelta(hours=hours)


REC = "record_id string, subject_id bigint, record_start timestamp_ntz, record_end timestamp_ntz"
STAY = "subject_id bigint, stay_id bigint, intime timestamp_ntz, outtime timestamp_ntz"


def test_overlap_rules_and_modal_ties(make):
    records = make(REC, [("a", 1, at(0), at(10)), ("touch", 1, at(30), at(40)), ("rev", 1, at(9), at(2)), ("null", 1, None, at(5)), ("other", 2, at(0), at(10))])
    stays = make(STAY, [(1, 11, at(5), at(8)), (1, 12, at(1), at(4)), (1, 13, at(1), at(4)), (1, 14, at(-5), at(0)), (1, 15, at(20), at(30)), (1, None, at(0), at(9)), (1, 16, at(8), at(6)), (3, 17, at(0), at(9))])
    out = {r.stay_id: r for r in Ln.link(records, stays).collect()}
    assert set(out) == {11, 12, 13}
    assert {k: r.overlap_s for k, r in out.items()} == {11: 10800.0, 12: 10800.0, 13: 10800.0}
    assert [k for k, r in out.items() if r.is_modal] == [12]


@pytest.mark.parametrize("bucket_h", [1, 7, 1000])
def test_overlap_join_equals_brute_force_for_any_cell_width(make, bucket_h):
    rng = random.Random(5)
    spans = lambda n: [(rng.choice([1, 1, 1, 2]), i, *sorted(rng.sample(range(0, 120), 2))) for i in range(n)]
    a, b = spans(60), spans(50)
    records = make(REC, [(str(i), k, at(s), at(e)) for k, i, s, e in a])
    stays = make(STAY, [(k, i, at(s), at(e)) for k, i, s, e in b])
    got = Ln.interval_overlap_join(records, stays, "subject_id", ("record_start", "record_end"), ("intime", "outtime"), bucket_h * 3600)
    want = {(str(i), j): 3600.0 * (min(e, f) - max(s, t)) for k, i, s, e in a for m, j, t, f in b if k == m and min(e, f) > max(s, t)}
    rows = got.collect()
    assert {(r.record_id, r.stay_id): r.overlap_s for r in rows} == want and len(rows) == len(want)


def test_record_window_drops_unusable_headers(make):
    df = make("id int, base_date date, base_time string, sig_len bigint, fs double", [
        (1, dt.date(2020, 1, 1), "10:00:00", 1250, 125.0), (2, None, "10:00:00", 1, 1.0), (3, dt.date(2020, 1, 1), None, 1, 1.0),
        (4, dt.date(2020, 1, 1), "10:00:00", 0, 1.0), (5, dt.date(2020, 1, 1), "10:00:00", 5, 0.0), (6, dt.date(2020, 1, 1), "bad", 5, 1.0)])
    (r,) = Ln.record_window(df).collect()
    assert (r.record_start, r.record_end) == (dt.datetime(2020, 1, 1, 10), dt.datetime(2020, 1, 1, 10, 0, 10))


def test_nearest_equals_brute_force(make):
    rng = random.Random(6)
    targets = [(i, rng.choice("ab"), rng.randrange(0, 400) / 4) for i in range(80)]
    events = [(j, rng.choice("ab"), rng.randrange(0, 400) / 4) for j in range(120)]
    got = Ln.nearest_within(make("i int, k string, t double", targets), make("j int, k string, et double", events), "k", "t", "et", 1.0, ["i"], ["j"])
    want = {}
    for i, k, t in targets:
        near = sorted((abs(e - t), e, j) for j, kk, e in events if kk == k and abs(e - t) <= 1.0)
        if near:
            want[i] = near[0]
    assert {r.i: (r.gap_s, r.et, r.j) for r in got.collect()} == want


def test_bridge_absorbs_noise_and_reports_orphans(make):
    inv = sorted_row_id(make("subject_id string, record_id string, nbp_timestamp_s double", [("p2", "8", 50.0), ("p1", "7", 100.0001), ("p1", "7", 20.0)]))
    man = make("card_id string, subject_id string, record_id int, t_nbp double", [("A", "p1", 7, 100.0), ("B", "p2", 8, 50.0), ("C", "p9", 9, 1.0)])
    bridged = Ln.bridge(man, inv)
    assert {r.card_id: r.row_id for r in bridged.collect()} == {"A": "p1_7_1", "B": "p2_8_2", "C": None}
    assert Ln.bridge_summary(bridged).first().asDict() == {"n_cards": 3, "n_matched": 2, "n_unmatched": 1}


def test_anchor_windows_equal_brute_force(make):
    rng = random.Random(7)
    anchors = [("r1", float(rng.randrange(0, 900))) for _ in range(20)] + [("none", 5.0)]
    samples = [(rng.choice(["r1", "r2"]), rng.randrange(0, 9000) / 10, float(i)) for i in range(500)]
    a, s = make("record_id string, t_nbp double", sorted(set(anchors))), make("record_id string, t_s double, value double", samples)
    want = sorted((r, t, x) for r, t in set(anchors) for rr, x, _ in samples if rr == r and t - 30 <= x < t + 50)
    got = Ln.anchor_windows(a, s, pre_s=30, post_s=50)
    assert sorted((r.record_id, r.t_nbp, r.t_s) for r in got.collect()) == want
    kept = Ln.anchor_windows(a, s, pre_s=30, post_s=50, how="left")
    assert [r.t_s for r in kept.where(F.col("record_id") == "none").collect()] == [None]


# --- artifacts by triple ------------------------------------------------------------------------------------

MANIFEST = "card_id string, stratum string, subject_id string, record_id string, t_nbp double, path string"


def test_only_cards_whose_triple_is_listed(make):
    cards = make(MANIFEST, [("A", "s", "1", "r1", 10.0004, "x"), ("B", "s", "1", "r1", 10.0006, "x"), ("C", "s", "2", "r1", -0.5, "x"), ("D", "s", None, "r1", 1.0, "x"), ("E", "s", "1", "r1", None, "x")])
    listing = make("path string", [("g/s/1_r1_10000.png",), ("h/1_r1_10000.png",), ("1_r1_10002.png",), ("g/2_r1_-500.png",), ("g/9_r9_1.png",), ("g/1_r1_10001.svg",), ("g/notes.txt",), (None,)])
    files = Ln.artifact_triples(listing)
    assert sorted(r.ms for r in files.collect()) == [-500, 1, 10000, 10000, 10002]
    assert sorted(r.card_id for r in Ln.with_artifact(cards, files).collect()) == ["A", "C"]
    nulls = make("path string, subject string, record string, ms long", [("p", None, "r1", 1000), ("q", "1", "r1", None)])
    assert sorted(r.card_id for r in Ln.with_artifact(cards, nulls).collect()) == ["D", "E"]


def test_cards_resolve_to_files_that_exist(spark, make, tmp_path):
    from troughline.sources.files import list_files

    for name in ("s/A.png", "s/B.png", "old/C.png", "s/A.svg", "s/Z.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 3)
    listing = list_files(spark, str(tmp_path), "*.png")
    assert {r.n_bytes for r in listing.collect()} == {3} and listing.count() == 4
    cards = make(MANIFEST, [("A", "s", "1", "r1", 10.0, "x"), ("B", "s", "1", "r1", 10.0001, "x"), ("C", "s", "2", "r1", 1.0, "x"), ("D", "s", "3", "r1", 1.0, "x")])
    lookup = Ln.artifact_lookup(cards, listing)
    assert [(r.subject, r.ms, r.path.split("/")[-1]) for r in lookup.collect()] == [("1", 10000, "B.png")]
    rows = make("subject_id string, record_id string, t_nbp double, path int", [("1", "r1", 10.0004, 1), ("1", "r1", 10.0006, 2), ("2", "r1", 1.0, 3), (None, "r1", 1.0, 4)])
    found = {r.path: r.artifact and r.artifact.split("/")[-1] for r in Ln.resolve_artifacts(rows, lookup).collect()}
    assert found == {1: "B.png", 2: None, 3: None, 4: None}
    assert tuple(Ln.lookup_report(cards, listing, lookup).first()) == (4, 1, 4)


def test_open_ends_make_a_handful_of_rows(make):
    import datetime

    at = lambda y, m=1, d=1: datetime.datetime(y, m, d)
    rows = [("k", at(2000), at(9999, 12, 31)), ("k", at(2020), at(2020, 1, 3)), ("k", at(1, 1, 2), at(2020, 1, 2)), ("k", at(2021), at(2023))]
    left = make("key string, a timestamp_ntz, b timestamp_ntz", rows)
    right = left.withColumnsRenamed({"a": "c", "b": "e"})
    levels = make("l array<int>", [([0, 1, 2, 3, 4, 5, 6, 7],)])
    assert Ln.grid_cells(left, "a", "b", 86_400.0, levels).count() <= len(rows) * Ln.GRIDS * Ln.FEW_CELLS
    got = sorted((r.a, r.c, r.overlap_s) for r in Ln.interval_overlap_join(left, right, "key", ("a", "b"), ("c", "e"), 86_400.0).collect())
    want = sorted((a, c, (min(b, e) - max(a, c)).total_seconds()) for _, a, b in rows for _, c, e in rows if min(b, e) > max(a, c))
    assert got == want


def test_lengths_of_every_scale_meet(make):
    rng = random.Random(5)
    base = dt.datetime(2020, 1, 1)
    def some(n):
        out = []
        for i in range(n):
            s = base + dt.timedelta(seconds=rng.uniform(0, 4e7))
            out.append((rng.choice("xy"), s, s + dt.timedelta(seconds=10 ** rng.uniform(-1, 9)), i))
        return out
    a, b = some(60), some(60)
    left = make("key string, a timestamp_ntz, b timestamp_ntz, i int", a)
    right = make("key string, c timestamp_ntz, e timestamp_ntz, j int", b)
    got = sorted((r.i, r.j) for r in Ln.interval_overlap_join(left, right, "key", ("a", "b"), ("c", "e"), 60.0).collect())
    assert got == sorted((i, j) for k, s, e, i in a for m, t, f, j in b if k == m and min(e, f) > max(s, t))
