"""Invariants and hand-made cases of the operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspan.operators import grids, listing, matching, models, phenology, pixels, series, zonal


def frame(spark, ys):
    return spark.createDataFrame([(1, i, None if y is None else float(y)) for i, y in enumerate(ys)], "k int, bin int, value double")


def values(df):
    return [r.value for r in df.orderBy("bin").collect()]


def test_pchip_reproduces_knots_and_stays_between(spark):
    ys = [1.0, 2.0, None, None, 5.0, None, None, None, None, 4.0]
    out = values(series.pchip(frame(spark, ys), ["k"], "value"))
    assert all(abs(a - b) < 1e-12 for a, b in zip(out, ys) if b is not None)
    assert all(2 <= v <= 5 for v in out[1:5]) and all(4 <= v <= 5 for v in out[5:])


@pytest.mark.parametrize(("ys", "want"), [([None, 3, None], [3, 3, 3]), ([1, None, 3, None], [1, 2, 3, 4]), ([None, None], [None, None])])
def test_pchip_few_knots(spark, ys, want):
    assert values(series.pchip(frame(spark, ys), ["k"], "value")) == want


def test_savgol_keeps_quadratics_to_the_ends(spark):
    ys = [2 - 3 * t + 0.5 * t * t for t in range(20)]
    assert np.allclose(values(series.savgol(frame(spark, ys), ["k"], "value")), ys)
    assert values(series.savgol(frame(spark, [1, 2, 3]), ["k"], "value")) == [None] * 3
    with pytest.raises(ValueError):
        series.savgol(frame(spark, ys), ["k"], "value", window=3, degree=3)


def test_gaussian_keeps_constants(spark):
    assert np.allclose(values(series.gaussian(frame(spark, [4.0] * 12), ["k"], "value", sigma=2)), 4.0)


def test_fills(spark):
    ys = [None, 1, None, 3, None]
    assert values(series.forward_fill(frame(spark, ys), ["k"], "value", "bin")) == [None, 1, 1, 3, 3]
    assert values(series.complete(frame(spark, ys), ["k"], "value", "bin")) == [2, 1, 1, 3, 3]
    assert values(series.interpolate_linear(frame(spark, ys), ["k"], "value", "bin")) == [None, 1, 2, 3, None]


def test_daily_fill_stops_at_the_last_row(spark):
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(d, 1.0), (d + dt.timedelta(8), 2.0)], "day date, v double")
    out = series.daily_forward_fill(df, ["v"]).orderBy("day").collect()
    assert [r.v for r in out] == [1.0] * 8 + [2.0]


def test_gradient_on_uneven_steps_is_exact_for_quadratics(spark):
    xs = [0, 1, 3, 4, 8]
    df = spark.createDataFrame([(1, x, float(x * x)) for x in xs], "k int, bin int, value double")
    out = [r.gradient for r in series.gradient(df, ["k"], "value", "bin").orderBy("bin").collect()]
    assert np.allclose(out[1:-1], [2 * x for x in xs[1:-1]])


def test_resample_is_anchored_at_the_first_day_of_all(spark):
    t = dt.datetime
    df = spark.createDataFrame([(1, t(2024, 1, 3, 7), 1.0), (1, t(2024, 1, 12), 3.0), (1, t(2024, 1, 13), 9.0), (2, t(2024, 2, 2), 5.0)], "k int, time timestamp_ntz, value double")
    out = {(r.k, r.bin): (r.value, r.observed, r.label) for r in series.resample(df, ["k"], ["value"]).collect()}
    assert out[1, 0] == (2.0, True, dt.date(2024, 1, 3)) and out[1, 1][0] == 9.0 and out[1, 2] == (None, False, dt.date(2024, 1, 23)) and out[2, 3][0] == 5.0 and len(out) == 8


def season(spark, ys):
    return spark.createDataFrame([(1, 2024, 1 + 10 * i, None if y is None else float(y)) for i, y in enumerate(ys)], "zone int, year int, doy int, v double")


def test_one_season(spark):
    ys = [0.2 + 0.6 * math.exp(-(((i - 18) / 6) ** 2)) for i in range(37)]
    m = phenology.metrics(season(spark, ys), ["zone", "year"], "v").first()
    assert m.pos_times == 181 and m.sos_times < m.pos_times < m.eos_times and m.los_values == m.eos_times - m.sos_times
    assert abs(m.liot_values - (sum(ys) - (ys[0] + ys[-1]) / 2)) < 1e-9
    assert phenology.num_peaks(season(spark, ys), ["zone", "year"], "v").first().num_peaks == 1


def test_odd_seasons(spark):
    down = phenology.metrics(season(spark, range(30, 0, -1)), ["zone", "year"], "v").first()
    assert down.sos_times is None and down.roi_values is None and down.los_values is None and down.eos_times is not None
    flat = phenology.metrics(season(spark, [1] * 30), ["zone", "year"], "v").first()
    assert flat.sos_times is None and flat.eos_times is None and flat.aos_values == 0 and flat.liot_values == 29
    assert phenology.metrics(season(spark, [None] * 5), ["zone", "year"], "v").count() == 0
    with pytest.raises(ValueError):
        phenology.metrics(season(spark, [1]), ["zone", "year"], "v", method="other")


def test_peaks():
    v = [0, 3, 0, 5, 5, 5, 0, 4, 0]
    assert phenology.find_peaks(v, 3, 1) == [1, 4, 7]
    assert phenology.find_peaks(v, 3, 4) == [4]
    assert phenology.find_peaks([3, 2, 1, 2, 3], 0, 1) == []


def test_stl_trend_of_a_line_with_a_season():
    t = np.arange(60.0)
    trend = phenology.stl_trend(0.1 * t + np.sin(2 * np.pi * t / 12), period=12)
    assert np.abs(trend[12:-12] - 0.1 * t[12:-12]).max() < 0.15


def test_scene_filter_is_strict(spark):
    df = spark.createDataFrame([(t, p, 0 if p < k else 2, 5, 0) for t, k in ((1, 2), (2, 3), (3, 0)) for p in range(4)], "time int, p int, fmask int, a int, b int")
    kept = pixels.keep_clear_scenes(pixels.cloud_mask(df, ["a", "b"]), ["a", "b"])
    assert {r.time for r in kept.collect()} == {2}


def test_indices_of_zeros_are_null(spark):
    df = spark.createDataFrame([(100, 100, 300, 900, 0, 100)], "blue int, green int, red int, nir1 int, swir2 int, swir3 int")
    r = pixels.with_indices(df, pixels.ALL_INDICES).first()
    assert r.ndvi == 0.5 and r.ndti is None and r.cai is None and r.mavi is None
    with pytest.raises(ValueError):
        pixels.index_named("other")


def test_rasterise_last_zone_wins(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    z = spark.createDataFrame([(1, [(float(x), float(y)) for x, y in ring(0, 4)]), (2, [(float(x), float(y)) for x, y in ring(2, 6)])], "zone_id int, ring array<struct<x:double,y:double>>")
    p = spark.range(64).selectExpr("floor(id / 8) + 0.5D AS y", "id % 8 + 0.5D AS x")
    got = {(r.y, r.x): r.zone_id for r in zonal.rasterise(p, z, 3.0).collect()}
    assert sum(v == 1 for v in got.values()) == 12 and sum(v == 2 for v in got.values()) == 16 and got[2.5, 2.5] == 2


def test_nearest_day_prefers_the_earlier(spark):
    d = lambda n: dt.date(2024, 1, n)
    a, b = spark.createDataFrame([(d(5),), (d(6),), (d(20),)], "day date"), spark.createDataFrame([(d(4), "x"), (d(6), "y")], "other date, v string")
    assert {r.day.day: r.v for r in matching.nearest_day(a, b, "day", "other").collect()} == {5: "x", 6: "y"}


def test_flow_gathers_in_a_valley(spark):
    g = spark.createDataFrame([(0, y, x, float(abs(x - 2) * 10 + y)) for y in range(5) for x in range(5)], "a int, y int, x int, z double")
    out = {(r.y, r.x): r.accumulation for r in grids.flow(g, "a").collect()}
    assert len(out) == 25 and max(out.values()) == out[0, 2]


def test_downscale_keeps_the_coarse_means():
    rng = np.random.default_rng(0)
    prior, cell = rng.normal(0.3, 0.4, 16), np.repeat([0, 1, 2, 3], 4)
    theta = models.downscale_group(prior, cell, {0: 0.5, 1: 0.1, 3: 0.2}, np.full((16, 4), 16), weight=0.0)
    assert theta.min() >= 0 and np.allclose([theta[:4].mean(), theta[4:8].mean(), theta[12:].mean()], [0.5, 0.1, 0.2], atol=1e-4)


def test_downscale_against_dense_algebra():
    # without a bound that binds, the answer is that of one linear system
    rng = np.random.default_rng(3)
    y, x = (a.ravel() for a in np.mgrid[0:6, 0:7])
    keep = rng.random(len(y)) > 0.1
    y, x = y[keep], x[keep]
    near, cell, prior = models.neighbours(y, x), y // 3 * 3 + x // 3, rng.uniform(5, 6, keep.sum())
    n = len(y)
    lap = 4 * np.eye(n)
    for i in range(n):
        lap[i, near[i][near[i] < n]] = -1
        assert {(y[j], x[j]) for j in near[i] if j < n} == {p for p in zip(y, x) if abs(p[0] - y[i]) + abs(p[1] - x[i]) == 1}
    known = [c for c in np.unique(cell) if c != 4]
    a = np.stack([(cell == c) / (cell == c).sum() for c in known])
    b = np.array([5.0 + 0.2 * k for k in range(len(known))])
    system = np.block([[np.eye(n) + 0.5 * lap.T @ lap, a.T], [a, np.zeros((len(known), len(known)))]])
    want = np.linalg.solve(system, np.concatenate([prior, b]))[:n]
    assert want.min() > 0 and np.allclose(models.downscale_group(prior, cell, dict(zip(known, b)), near), want, atol=1e-6)


def test_least_squares_and_its_fallback(spark):
    df = spark.createDataFrame([(1, float(x), float(y), 2.0 + 3 * x - y) for x in range(4) for y in (1, 5, 2)] + [(2, 1.0, 1.0, 7.0)], "k int, x double, y double, v double")
    got = {r.k: r.coefficients for r in models.least_squares(df, ["k"], "v", ["x", "y"]).collect()}
    assert np.allclose(got[1], [2, 3, -1]) and got[2] == [7.0, 0.0, 0.0]


def test_natural_order(spark):
    names = ["p10.png", "p2.png", "P1.png"]
    got = spark.createDataFrame([(n,) for n in names], "name string").orderBy(listing.natural_key(F.col("name"))).collect()
    assert [r.name for r in got] == ["P1.png", "p2.png", "p10.png"]
