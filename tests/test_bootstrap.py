import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.functions import keys
from troughline.functions.quantiles import of_wanted_cells
from troughline.operators import bootstrap as B


def slot(rep, pos, seed):
    """The named draw, step by step in whole numbers."""
    out, prime = 0, 2**31 - 1
    for a, b, c, d in keys.SLOT_FACTORS:
        u = (rep * a + pos * b + seed) % prime
        u = (u ^ u >> 15) * c % prime
        u = (u ^ u >> 13) * d % prime
        out = out * prime + (u ^ u >> 16) % prime
    return out


def test_draws_are_even():
    for k in (7, 1000):
        counts = np.bincount([slot(rep, pos, V.SEED) % k for rep in range(200) for pos in range(500)], minlength=k)
        expected = 100_000 / k
        assert ((counts - expected) ** 2 / expected).sum() < k + 5 * np.sqrt(2 * k)
    per_rep = [len({slot(rep, pos, 1) % 500 for pos in range(500)}) for rep in range(200)]
    assert abs(np.mean(per_rep) / 500 - (1 - np.exp(-1))) < 0.01  # as many different ones as draws with replacement give


def brute(rows, reps, seed):
    """rows: (cluster, num, den). Same named draws, walked in plain Python."""
    sums = {}
    for c, x, y in rows:
        a, b = sums.get(c, (0.0, 0.0))
        sums[c] = (a + x, b + y)
    names = sorted(sums, key=lambda c: (hashlib.md5(f"{c}|{seed}".encode()).hexdigest(), c))
    k, out = len(names), []
    for rep in range(reps):
        picks = [slot(rep, pos, seed) % k for pos in range(k)]
        x, y = (sum(sums[names[p]][i] for p in picks) for i in (0, 1))
        if y > 0:
            out.append(x / y)
    return np.percentile(out, [2.5, 97.5]), len(out)


def rows(n=300, k=12, seed=1):
    rng = np.random.default_rng(seed)
    return [(f"c{int(rng.integers(k))}", float(rng.integers(2)), float(rng.integers(2))) for _ in range(n)]


def test_ratio_interval_equals_plain_resampling(make):
    data = rows()
    out = B.ratio_intervals(make("c string, x double, y double", data), "c", {"r": (F.col("x"), F.col("y"))}, replicates=150, seed=9).first()
    (lo, hi), used = brute(data, 150, 9)
    assert (out.ci_low, out.ci_high, out.n_replicates_used) == (pytest.approx(lo), pytest.approx(hi), used)
    assert out.point == pytest.approx(sum(r[1] for r in data) / sum(r[2] for r in data))
    assert (out.n_obs, out.n_clusters) == (300, 12)


def test_same_seed_same_interval_whatever_the_partitioning(make):
    df = make("c string, x double, y double", rows())
    run = lambda d, s: tuple(B.mean_interval(d, F.col("x"), "c", replicates=80, seed=s).first())
    assert run(df.repartition(7), 1) == run(df.coalesce(1), 1)
    assert run(df, 1) != run(df, 2)


def test_single_cluster_collapses_and_empty_denominator_is_null(make):
    df = make("g string, c string, x double, y double", [("one", "a", 1.0, 1.0), ("one", "a", 0.0, 1.0), ("zero", "a", 1.0, 0.0), ("zero", "b", 1.0, 0.0)])
    out = {r.g: r for r in B.ratio_intervals(df, "c", {"r": (F.col("x"), F.col("y"))}, ["g"], 20).collect()}
    assert (out["one"].point, out["one"].ci_low, out["one"].ci_high) == (0.5, 0.5, 0.5)
    assert (out["zero"].point, out["zero"].ci_low, out["zero"].ci_high) == (None, None, None)


def test_undefined_replicates_are_left_out(make):
    data = [("a", 1.0, 1.0), ("b", 0.0, 0.0), ("c", 0.0, 0.0)]
    out = B.ratio_intervals(make("c string, x double, y double", data), "c", {"r": (F.col("x"), F.col("y"))}, replicates=60).first()
    _, used = brute(data, 60, V.SEED)
    assert 0 < used < 60 and out.n_replicates_used == used and (out.ci_low, out.ci_high) == (1.0, 1.0)


def test_concentrated_clusters_widen_the_interval(make):
    lumpy = [("big" if i < 100 else f"c{i}", 1.0 if i < 100 else 0.0, 1.0) for i in range(200)]
    even = [(f"c{i % 100}", float(i < 100), 1.0) for i in range(200)]
    width = lambda data: (lambda r: r.ci_high - r.ci_low)(B.ratio_intervals(make("c string, x double, y double", data), "c", {"r": (F.col("x"), F.col("y"))}, replicates=100).first())
    assert width(lumpy) > width(even)


def test_any_weighted_statistic(make):
    data = rows(120, 8)
    df = make("c string, x double, y double", data).withColumn("v", F.col("x") * 3 + F.col("y"))
    out = B.statistic_interval(df, "v", "c", lambda v, w: F.sum(v * w) / F.sum(w), 90, 4).first()
    (lo, hi), _ = brute([(c, 3 * x + y, 1.0) for c, x, y in data], 90, 4)
    assert (out.ci_low, out.ci_high, out.n_clusters) == (pytest.approx(lo), pytest.approx(hi), 8)


def test_quantile_interval_equals_plain_resampling(make):
    rng = np.random.default_rng(3)
    data = [(f"c{int(rng.integers(9))}", float(np.round(rng.normal() * 10, 1))) for _ in range(200)] + [("c1", None), ("c2", float("nan"))]
    clean = [(c, v) for c, v in data if v is not None and v == v]
    out = B.quantile_interval(make("c string, v double", data), "v", "c", 0.5, 60, 4).first()
    names = sorted({c for c, _ in clean}, key=lambda c: (hashlib.md5(f"{c}|4".encode()).hexdigest(), c))
    own = {c: [v for d, v in clean if d == c] for c in names}
    medians = [np.median([v for pos in range(len(names)) for v in own[names[slot(rep, pos, 4) % len(names)]]]) for rep in range(60)]
    lo, hi = np.percentile(medians, [2.5, 97.5])
    assert (out.point, out.ci_low, out.ci_high) == (pytest.approx(np.median([v for _, v in clean])), pytest.approx(lo), pytest.approx(hi))
    assert (out.n_obs, out.n_clusters, out.n_replicates_used) == (200, 9, 60)


def test_no_task_holds_the_values_of_a_replicate(make, capsys):
    B.quantile_interval(make("c string, v double", [("a", 1.0), ("b", 2.0)]), "v", "c", 0.5, 5).explain("formatted")
    plan = capsys.readouterr().out
    assert "percentile(_v" not in plan and "percentile_approx" not in plan


@pytest.mark.parametrize("reps, conf", [(0, 0.95), (10, 1.0), (10, 0.0)])
def test_bad_arguments(make, reps, conf):
    with pytest.raises(ValueError):
        B.mean_interval(make("c string, x double", [("a", 1.0)]), F.col("x"), "c", replicates=reps, confidence=conf)


def test_draws_of_a_run_equal_the_named_ones():
    for n in (7, 1000, 1 << 33):
        for low in (0, (1 << 33) - 5):
            bases = B.slot_bases(low, low + 10, 9)
            assert B.drawn_slots(n, 4999, bases).tolist() == [slot(4999, pos, 9) % n for pos in range(low, low + 10)]


def test_draws_in_many_tasks_over_ranges_of_clusters(make, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 2)
    monkeypatch.setattr(B, "HELD_VALUES", 8)
    monkeypatch.setattr(B, "TASK_DRAWS", 100)
    data = rows(300, 25)
    df = make("g string, c string, x double, y double", [(g, *r) for g in "ab" for r in data[: 300 if g == "a" else 40]])
    out = {r.g: r for r in B.ratio_intervals(df, "c", {"r": (F.col("x"), F.col("y"))}, ["g"], 70, 9).collect()}
    for g, own in (("a", data), ("b", data[:40])):
        (lo, hi), used = brute(own, 70, 9)
        assert (out[g].ci_low, out[g].ci_high, out[g].n_replicates_used) == (pytest.approx(lo), pytest.approx(hi), used)


def test_sums_leave_nulls_out_and_keep_what_is_not_finite(monkeypatch):
    monkeypatch.setattr(B, "SLOTS", 4)
    monkeypatch.setattr(B, "AT_ONCE", 3)
    column = np.ma.MaskedArray([1.0, np.inf, 2.0, 4.0, 0.0, 8.0, 0.0], [0, 0, 0, 0, 1, 0, 1])
    sums, met = np.zeros((30, 1)), np.zeros((30, 1))
    B._add_draws(sums, met, range(30), 7, 0, [column], 9)
    for rep in range(30):
        picks = [slot(rep, pos, 9) % 7 for pos in range(7)]
        known = [column[p] for p in picks if p not in (4, 6)]
        assert (sums[rep, 0], met[rep, 0]) == (sum(known), len(known))


def test_replicates_meet_values_of_wanted_cells_only(make, monkeypatch):
    seen = []
    monkeypatch.setattr(B, "of_wanted_cells", lambda inside, *rest: seen.append(inside) or of_wanted_cells(inside, *rest))
    rng = np.random.default_rng(5)
    data = [(f"c{i % 3}", float(v)) for i, v in enumerate(rng.normal(100, 30, 600))]
    out = B.quantile_interval(make("c string, v double", data), "v", "c", 0.5, 40, 4).first()
    own = {c: [v for d, v in data if d == c] for c in ("c0", "c1", "c2")}
    names = sorted(own, key=lambda c: (hashlib.md5(f"{c}|4".encode()).hexdigest(), c))
    medians = [np.median([v for pos in range(3) for v in own[names[slot(rep, pos, 4) % 3]]]) for rep in range(40)]
    assert (out.ci_low, out.ci_high) == tuple(pytest.approx(x) for x in np.percentile(medians, [2.5, 97.5]))
    assert seen[0].count() < 40 * 20  # of 600 values to each replicate
