import math
import random

import pytest
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.operators import sampling as S
from troughline.operators.quality import enforce, staging_checks

INV = """subject_id string, record_id string, nbp_timestamp_s double, is_occlusion_signature boolean, phase3_duration_s double,
nadir_depth_frac double, alignment_offset_s double, pleth_valid_fraction double, reject_reason string"""


def test_strata(make):
    nan = float("nan")
    rows = [
        ("p", "r", 1.0, True, 20.0, 0.1, 0.0, 1.0, None, V.STRATUM_POSITIVE),
        ("p", "r", 2.0, False, 10.0, 0.19, 0.0, 1.0, V.SHORT_RUN, V.STRATUM_NEAR_MISS),
        ("p", "r", 3.0, False, 9.9, 0.1, 0.0, 1.0, V.SHORT_RUN, None),
        ("p", "r", 4.0, False, 30.0, 0.20, 0.0, 1.0, V.NOT_RECOVERED, None),
        ("p", "r", 5.0, False, nan, nan, nan, 0.5, V.NO_DIP, V.STRATUM_NEGATIVE),
        ("p", "r", 6.0, False, nan, nan, nan, 0.49, V.BASELINE_UNSTABLE, None),
        ("p", "r", 7.0, False, nan, nan, nan, 1.0, V.NOT_ALIGNED, None),
        ("p", "r", 8.0, False, nan, nan, nan, 0.0, V.NO_SIGNAL, None)]
    df = make(INV + ", want string", rows).withColumn("got", S.stratum_of())
    assert df.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def pool(make, sizes):
    return make("card_id string, stratum string", [(f"{g}{i:04d}", g) for g, n in sizes.items() for i in range(n)])


def test_sample_sizes_census_and_shortfall(make):
    df = pool(make, {"a": 50, "b": 5, "ignored": 9})
    drawn = S.sample_strata(df, {"a": 20, "b": 8}, ["card_id"])
    assert {r.stratum: r["count"] for r in drawn.groupBy("stratum").count().collect()} == {"a": 20, "b": 5}
    ids = lambda d: sorted(r.card_id for r in d.collect())
    assert ids(drawn) == ids(S.sample_strata(df.repartition(6).orderBy(F.rand(3)), {"a": 20, "b": 8}, ["card_id"]))
    assert ids(drawn) != ids(S.sample_strata(df, {"a": 20, "b": 8}, ["card_id"], seed=1))
    assert {tuple(r) for r in S.sampling_report(df, {"a": 20, "b": 8}).collect()} == {("a", 20, 50, 20, 0), ("b", 8, 5, 5, 3)}
    assert S.sample_strata(df, {"a": None}, ["card_id"]).count() == 50


def hamilton(sizes, n, desc):
    total = sum(sizes.values())
    raw = {s: k / total * n for s, k in sizes.items()}
    out = {s: math.floor(x) for s, x in raw.items()}
    order = sorted(sizes, reverse=desc)
    order.sort(key=lambda s: -(raw[s] - out[s]))
    for s in order[: n - sum(out.values())]:
        out[s] += 1
    return out


@pytest.mark.parametrize("sizes, n", [({"a": 268, "b": 200, "c": 100}, 150), ({"a": 1, "b": 1, "c": 1}, 2), ({"a": 7, "b": 3}, 10), ({"x": 5, "y": 5, "z": 5, "w": 5}, 6)])
@pytest.mark.parametrize("ties", ["asc", "desc"])
def test_largest_remainder(make, sizes, n, ties):
    df = pool(make, sizes)
    assert {r.stratum: r.quota for r in S.quotas(df, n, ties=ties).collect()} == hamilton(sizes, n, ties == "desc")
    assert S.proportional_sample(df, n, ["card_id"], ties=ties).count() == n


def test_quota_errors(make):
    with pytest.raises(ValueError):
        S.quotas(pool(make, {"a": 3}), 0)
    with pytest.raises(Exception, match="exceeds the table"):
        S.quotas(pool(make, {"a": 3}), 4).collect()


def test_simple_sample_and_overlap(make):
    df = pool(make, {"a": 30, "b": 30})
    assert S.simple_sample(df, 0, ["card_id"]).count() == 0
    assert S.simple_sample(df, 100, ["card_id"]).count() == 60
    ids = [r.card_id for r in S.overlap_subset(df, 12).collect()]
    assert len(set(ids)) == 12 and ids == sorted(ids)


@pytest.mark.parametrize("n, cal", [(2, 1), (7, 3), (10, 5)])
def test_split_half(make, n, cal):
    df = make("subject_id string", [(f"p{i % n}",) for i in range(40)])
    split = {r.subject_id: r.split for r in S.split_half(df).collect()}
    assert len(split) == n and sum(s == "calibration" for s in split.values()) == cal


def test_split_half_needs_two_subjects(make):
    with pytest.raises(Exception, match="at least 2"):
        S.split_half(make("subject_id string", [("p",)])).collect()


def least_repeats(sizes):
    """Cards of one stratum beyond what all others can keep apart."""
    return max(0, 2 * max(sizes.values()) - sum(sizes.values()) - 1)


@pytest.mark.parametrize("sizes", [
    {"a": 268, "b": 200, "c": 100}, {"a": 1}, {"a": 9}, {"a": 5, "b": 2, "c": 1}, {"a": 3, "b": 3}, {"a": 100, "b": 3}, {"d": 46, "e": 262, "f": 39, "g": 52}, {"a": 4, "b": 2, "c": 2},
    {"a": 17, "b": 17, "c": 17, "d": 2}, *[{s: random.Random(i * 9 + ord(s)).randrange(1, 60) for s in "abcde"[: 2 + i % 4]} for i in range(12)]])
def test_equal_strata_meet_only_where_forced(make, sizes):
    placed = S.spread_order(pool(make, sizes), ["card_id"])
    rows = sorted((r.display_pos, r.stratum, r.card_id) for r in placed.collect())
    n = sum(sizes.values())
    assert [p for p, _, _ in rows] == list(range(1, n + 1)) and len({c for _, _, c in rows}) == n
    assert sum(x[1] == y[1] for x, y in zip(rows, rows[1:])) == least_repeats(sizes) == S.adjacent_repeats(placed).first().n_adjacent


def test_every_stratum_lies_all_over_the_order(make):
    sizes = {"a": 268, "b": 200, "c": 100}
    rows = sorted((r.display_pos, r.stratum) for r in S.spread_order(pool(make, sizes), ["card_id"]).collect())
    for s, size in sizes.items():
        quarter = [sum(x == s for _, x in rows[i * 142:(i + 1) * 142]) for i in range(4)]
        assert all(abs(q - size / 4) <= 0.15 * size for q in quarter)


def test_a_missing_stratum_is_a_stratum(make):
    cards = make("card_id string, stratum string", [(f"c{i:03}", None if i % 2 else "ab"[i % 4 // 2]) for i in range(80)])
    placed = S.spread_order(cards, ["card_id"]).collect()
    assert len(placed) == 80 and sorted(r.display_pos for r in placed) == list(range(1, 81))
    order = [r.stratum for r in sorted(placed, key=lambda r: r.display_pos)]
    assert all(x != y for x, y in zip(order, order[1:]))


def test_as_many_strata_as_cards(spark):
    cards = spark.range(100_000).select(F.col("id").cast("string").alias("card_id"), F.concat(F.lit("s"), F.col("id")).alias("stratum"))
    got = S.spread_order(cards, ["card_id"]).agg(F.countDistinct("display_pos"), F.min("display_pos"), F.max("display_pos")).first()
    assert tuple(got) == (100_000, 1, 100_000)


def test_strides_of_billions(make):
    for n, most in ((8_000_000_000, 4_000_000_000), (8_000_000_000, 3_999_999_999), (7, 3), (6, 2), (2, 1), (1, 1)):
        d = S.spread_stride(n, most)
        assert d is None or (most <= d <= n - most and math.gcd(d, n) == 1)
    places = make("i long", [(0,), (1,), (7_999_999_999,)]).select(S._list_place(F.col("i"), 8_000_000_000, 3_000_000_000)).collect()
    d = S.spread_stride(8_000_000_000, 3_000_000_000)
    assert [r[0] * d % 8_000_000_000 for r in places] == [0, 1, 7_999_999_999]


def test_blind_ids_follow_the_order(make):
    placed = S.spread_order(pool(make, {"a": 27, "b": 20, "c": 10}), ["card_id"])
    assert S.blind_ids(placed).where("display_pos = 7").first().blind_id == "blind_0007"


def test_staging_checks_find_each_defect(make):
    df = pool(make, {"a": 6, "b": 5}).withColumn("sha256", F.sha2("card_id", 256))
    staged = S.spread_order(df, ["card_id"])
    enforce(staging_checks(staged, df))
    bad = lambda d: {r.check for r in staging_checks(d, df).where("NOT ok").collect()}
    assert bad(staged.where("display_pos <> 4")) == {"staged count = plan count", "positions contiguous 1..N", "content equal to source"}
    assert "keys unique" in bad(staged.unionByName(staged.where("display_pos = 2").withColumn("display_pos", F.lit(12).cast("bigint"))))
    assert bad(staged.withColumn("sha256", F.when(F.col("display_pos") == 1, "x").otherwise(F.col("sha256")))) == {"content equal to source"}


def test_gallery_and_form(make):
    rows = [("p1", "r", float(i), i < 3, 20.0 if i < 6 else None, 0.1 if i < 6 else None, 0.0, 1.0, None if i < 3 else V.SHORT_RUN if i < 6 else V.NO_DIP) for i in range(30)]
    manifest = S.gallery(make(INV, rows), {V.STRATUM_POSITIVE: 2, V.STRATUM_NEAR_MISS: 9, V.STRATUM_NEGATIVE: 5}, root="g")
    assert {r.stratum: r["count"] for r in manifest.groupBy("stratum").count().collect()} == {V.STRATUM_POSITIVE: 2, V.STRATUM_NEAR_MISS: 3, V.STRATUM_NEGATIVE: 5}
    form = S.blinded_form(manifest, "g")
    assert form.columns == ["card_id", "image_path", "call", "notes"]
    assert all(not r.image_path.startswith("g/") and r.call == "" for r in form.collect())


def test_rows_without_a_stratum_are_sampled_too(make):
    cards = make("card_id string, stratum string", [(f"c{i:03}", None if i % 4 == 0 else "ab"[i % 2]) for i in range(100)])
    picked = S.proportional_sample(cards, 20, ["card_id"]).collect()
    assert len(picked) == 20 and sum(r.stratum is None for r in picked) == 5


def test_digests_of_rows_that_share_an_image(make):
    rows = [("p1", f"r{i}", 1.0, True, 20.0, 0.1, 0.0, 1.0, None, V.STRATUM_POSITIVE) for i in range(3)]
    pool = make(INV + ", stratum string", rows)
    digests = S.manifest_rows(pool).select("image_path", F.lit("d").alias("image_sha256"))
    assert sorted((r.record_id, r.image_sha256) for r in S.manifest_rows(pool, digests=digests).collect()) == [("r0", "d"), ("r1", "d"), ("r2", "d")]
