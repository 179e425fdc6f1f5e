import numpy as np
import pytest
from pyspark.sql import functions as F

from troughline.functions import quantiles
from troughline.functions.quantiles import exact_quantiles

PROBS = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]


def check(got, values):
    assert got["n"] == len(values)
    for i, p in enumerate(PROBS):
        assert got[f"q{i}"] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12)


def test_groups_with_ties_gaps_and_one_row(make):
    rng = np.random.default_rng(3)
    groups = {"ties": rng.integers(0, 5, 400).astype(float), "spread": rng.normal(size=301), "one": np.array([2.5]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None), ("one", float("nan")), ("empty", None)]
    out = {r["g"]: r for r in exact_quantiles(make("g string, v double", rows), "v", PROBS, ["g"]).collect()}
    assert set(out) == set(groups)
    for g, xs in groups.items():
        check(out[g], xs)


def test_bracketed_path_is_exact(make, monkeypatch):
    """A tiny sketch size forces the path large groups take, with half of all rows on one value."""
    monkeypatch.setattr(quantiles, "_ACCURACY", 50)
    monkeypatch.setattr(quantiles, "_MARGIN", 4.0 / 50)
    rng = np.random.default_rng(4)
    xs = np.concatenate([rng.normal(size=3000), np.full(3000, 0.125)])
    df = make("v double", [(float(x),) for x in xs])
    check(exact_quantiles(df, "v", PROBS).first(), xs)
    by = {r["g"]: r for r in exact_quantiles(df.selectExpr("v", "v > 0 AS g"), "v", PROBS, ["g"]).collect()}
    check(by[True], xs[xs > 0])
    check(by[False], xs[xs <= 0])


def test_counting_cells_finds_the_same_quantiles(make):
    rng = np.random.default_rng(8)
    groups = {
        "ties": rng.integers(-3, 4, 500).astype(float), "spread": rng.normal(size=701), "one": np.array([-2.5]), "two": np.array([1.0, 2.0]),
        "wild": np.concatenate([rng.normal(size=200) * 1e9, rng.normal(size=200) * 1e-9, [0.0, -0.0, 1e308, -1e308]]), "flat": np.full(50, 0.125),
    }
    rows = [(g, float(x), 1) for g, xs in groups.items() for x in xs] + [("one", None, 1), ("one", float("nan"), 1), ("empty", None, 1), (None, 3.0, 1)]
    df = make("g string, v double, w int", rows)
    out = {r["g"]: r for r in quantiles.binned_quantiles(df.where("g IS NOT NULL"), "v", PROBS, ["g"]).collect()}
    assert set(out) == set(groups)
    for g, xs in groups.items():
        check(out[g], xs)
    check(quantiles.binned_quantiles(df.where("g = 'spread'"), "v", PROBS).first(), groups["spread"])


def test_weights_repeat_rows(make):
    rng = np.random.default_rng(9)
    xs, ws = rng.normal(size=120), rng.integers(0, 5, 120)
    df = make("v double, w int", [(float(x), int(w)) for x, w in zip(xs, ws)])
    check(quantiles.binned_quantiles(df, "v", PROBS, weight="w").first(), np.repeat(xs, ws))


def test_cells_never_fall(make):
    vs = sorted([*np.random.default_rng(1).normal(size=300), 0.0, 1e-300, -1e-300, 5e-324, 1e300, -1e300])
    cells = [r[0] for r in make("v double", [(float(v),) for v in vs]).select(quantiles.value_cell(F.col("v"))).collect()]
    assert cells == sorted(cells)
