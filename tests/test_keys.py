import hashlib
import random

from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.functions import keys as K


def test_content_id_matches_a_plain_digest(make):
    df = make("s string, t double, stratum string", [("p1", 100.5, V.STRATUM_POSITIVE), ("p2", 7.25, "odd")])
    got = [r[0] for r in df.select(K.content_id(F.col("s"), F.col("t"), F.col("stratum"))).collect()]
    want = [f"{p}-" + hashlib.sha256(f"{s}|{t:.6f}|{g}|{V.SEED}".encode()).hexdigest()[:16]
            for p, s, t, g in (("A", "p1", 100.5, V.STRATUM_POSITIVE), ("X", "p2", 7.25, "odd"))]
    assert got == want


def test_time_key_absorbs_float_noise(make):
    df = make("t double", [(100.0001,), (100.0004,), (100.001,)])
    assert [r[0] for r in df.select(K.time_key(F.col("t"))).collect()] == [100000, 100000, 100001]


def test_hash_position_is_dense_and_independent_of_partitioning(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("g"))
    place = lambda d: {(r.g, r.k): (r.pos, r.n) for r in K.hash_position(d, ["k"], 7, ["g"], "pos", "n").collect()}
    one, two = place(df.coalesce(1)), place(df.repartition(9, "k"))
    assert one == two
    for g, n in (("hot", 4000), ("cold", 1000)):
        assert sorted(p for (gg, _), (p, _) in one.items() if gg == g) == list(range(n))
        order = sorted((k for gg, k in one if gg == g), key=lambda k: (hashlib.md5(f"{k}|7".encode()).hexdigest(), k))
        assert [one[(g, k)][0] for k in order] == list(range(n))
        assert {one[(g, k)][1] for k in order} == {n}
    top = K.hash_position(df, ["k"], 7, ["g"], "pos", below=F.lit(100)).collect()
    assert {(r.g, r.k) for r in top} == {x for x, (p, _) in one.items() if p < 100}


def test_null_group_is_a_group(make):
    df = make("g string, k string", [(None, "a"), (None, "b"), ("x", "c")])
    assert sorted(r.pos for r in K.hash_position(df, ["k"], 1, ["g"]).collect()) == [0, 0, 1]


def test_sorted_row_ids_follow_the_sort_whatever_the_input_order(make):
    rows = [(f"p{i % 7}", f"r{i % 3}", float(i)) for i in range(300)]
    want = {(s, r, t): f"{s}_{r}_{i}" for i, (s, r, t) in enumerate(sorted(rows))}
    random.Random(1).shuffle(rows)
    df = make("subject_id string, record_id string, nbp_timestamp_s double", rows).repartition(5)
    assert {(r.subject_id, r.record_id, r.nbp_timestamp_s): r.row_id for r in K.sorted_row_id(df).collect()} == want


def test_groups_get_the_salts_their_rows_need(make, monkeypatch):
    from troughline.functions import keys as K

    monkeypatch.setattr(K, "ROWS_PER_SALT", 10)
    rows = make("g string, v int", [("hot", i) for i in range(95)] + [("cold", i) for i in range(7)] + [(None, 1), ("lone", 5)])
    sizes = rows.groupBy("g").count()
    out = K.join_per_group(rows, sizes, ["g"], F.col("v"), size="count").collect()
    assert sorted((r.g, r.v, r["count"]) for r in out) == sorted([("hot", i, 95) for i in range(95)] + [("cold", i, 7) for i in range(7)] + [("lone", 5, 1)])
    salts = {g: {r["_salt"] for r in out if r.g == g} for g in ("hot", "cold", "lone")}
    assert salts["hot"] == set(range(10)) and salts["cold"] == salts["lone"] == {0}
