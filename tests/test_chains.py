"""Hand-made cases of outliers, projections, layouts, tables, sinks and the registry."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspan import chain_queries, plans, queries, sources
from fieldspan.operators import grids, layout, listing, models, phenology, pixels, projection, series, tables, zonal


def frame(spark, ys):
    return spark.createDataFrame([(1, i, None if y is None else float(y)) for i, y in enumerate(ys)], "k int, bin int, value double")


def values(df):
    return [r.value for r in df.orderBy("bin").collect()]


def spikes(ys, far, factor):
    """The rule in plain Python."""
    x = np.array([np.nan if y is None else float(y) for y in ys])
    cut = np.nanstd(x) * factor
    left, right = np.append(np.nan, x[:-1]), np.append(x[1:], np.nan)
    with np.errstate(invalid="ignore"):
        out = far(x) & ((x < (left + right) / 2 - cut) | (x > np.fmax(left, right) + cut))
    return [None if o or np.isnan(v) else v for v, o in zip(x, out)]


def test_a_plateau_is_no_spike(spark):
    ys = [1, 1, 1, 1, 5, 5, 5, 1, 1, 1, 1, 1]
    assert values(series.outliers_zscore(frame(spark, ys), ["k"], "value", "bin")) == ys


def test_zscore_spikes(spark):
    rng = np.random.default_rng(1)
    ys = [float(v) for v in rng.normal(5, 1, 60)]
    ys[7], ys[20], ys[33], ys[34], ys[59] = 14, -6, None, None, 15
    z = lambda x: abs((x - np.nanmean(x)) / np.nanstd(x)) > 1.6449
    want = spikes(ys, z, 1.0)
    assert want != ys and values(series.outliers_zscore(frame(spark, ys), ["k"], "value", "bin", factor=1.0)) == pytest.approx(want, nan_ok=True)
    with pytest.raises(ValueError):
        series.outliers_zscore(frame(spark, ys), ["k"], "value", "bin", p=0.2)


@pytest.mark.parametrize(("times", "years", "want"), [(20, 1, 3), (73, 1, 11), (73, 2, 5), (84, 3, 5), (240, 7, 5), (0, 0, 3)])
def test_rolling_window(times, years, want):
    assert series.rolling_window(times, years) == want


def test_fractional_orders_keep_their_rows(spark):
    df = spark.createDataFrame([(1, x, y) for x, y in ((0.5, 1.0), (1.5, None), (2.5, 3.0))], "k int, bin double, value double")
    assert values(series.pchip(df, ["k"], "value")) == [1, 2, 3]


def test_year_end_and_week_labels(spark):
    d = spark.createDataFrame([(1, dt.date(2020, 12, 3)), (1, dt.date(2020, 12, 20)), (2, dt.date(2020, 11, 30))], "k int, day date")
    assert sorted(r.day for r in series.to_year_end(d, ["k"], "day").collect()) == [dt.date(2020, 11, 30), dt.date(2020, 12, 3), dt.date(2020, 12, 31)]
    x = spark.createDataFrame([(1, dt.date(2020, 1, 8), 1.0)], "k int, time date, v double")
    assert series.climatology(x, ["k"], "v", "week", year=2021).first().label == dt.date(2021, 1, 8)
    with pytest.raises(ValueError):
        series.climatology(x, ["k"], "v", "day")


def test_projections(spark):
    p = spark.createDataFrame([(180.0, 0.0), (0.0, 90.0), (148.5, -33.5), (3.0, 0.0)], "lon double, lat double")
    x, y = projection.equal_area(F.col("lon"), F.col("lat"))
    got = [(r.x, r.y) for r in p.select(x.alias("x"), y.alias("y")).collect()]
    assert got[0][0] == pytest.approx(17367530.45, abs=0.01) and got[1][1] == pytest.approx(7342230.14, abs=0.01)
    e, n = projection.utm(F.col("lon"), F.col("lat"))
    u = p.select("lon", "lat", e.alias("e"), n.alias("n"), projection.utm_zone(F.col("lon")).alias("z"))
    assert [tuple(r)[2:] for r in u.collect()][3] == (pytest.approx(500000), pytest.approx(0), 31)
    lon, lat = projection.from_utm(F.col("e"), F.col("n"), F.col("z"), F.col("lat") < 0)
    r = u.where("lat < 0").select(lon.alias("lon"), lat.alias("lat")).first()
    assert (r.lon, r.lat) == (pytest.approx(148.5, abs=1e-7), pytest.approx(-33.5, abs=1e-7))


def test_projected_area(spark):
    ring = [(148.0, -33.0), (148.01, -33.0), (148.01, -33.01), (148.0, -33.01), (148.0, -33.0)]
    z = spark.createDataFrame([("a", ring)], "zone string, ring array<struct<x:double,y:double>>")
    r = zonal.polygon_metrics(z.withColumn("ring", projection.project_ring("ring", projection.equal_area))).first()
    # a degree of longitude there is 93.5 km, one of latitude 110.9 km
    assert r.area_ha == pytest.approx(0.01 * 93.45 * 0.01 * 110.91 * 100, rel=2e-3)


def test_bilinear(spark):
    g = spark.createDataFrame([(y, x, float(10 * y + x) if (y, x) != (1, 1) else None) for y in range(3) for x in range(3)], "y int, x int, z double")
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.5, 0.5), (2, 1.5, 2.0), (3, 9.0, 9.0)], "k int, py double, px double")
    assert [r.z for r in grids.bilinear(g, p).orderBy("k").collect()] == [0, pytest.approx(11 / 3), 17, None]
    with pytest.raises(ValueError):
        grids.match_raster(g, p, (0, 0), 1.0, how="cubic")


def test_layouts(spark):
    assert layout.frame_size(257, 197) == (1080, 826) and layout.frame_size(2001, 999) == (2000, 998)
    tri = spark.createDataFrame([("a", [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)])], "zone string, ring array<struct<x:double,y:double>>")
    assert tuple(layout.label_points(tri, (0.0, 4.0), 1.0).first()) == ("a", 1.0, 2.0)
    with pytest.raises(ValueError):
        layout.variable_groups(spark.range(1), "id", {"x": ["y"]})


def test_names(spark):
    names = ["sam_paddocks_x_calendar_2020_p3.png", "farm_sentinel2_paddocks.mp4", "other.mp4", "f_ozwald_daily_rain_8day.png", "a_report.pdf", "x.txt", "q.png", "home_phenology_p10.png", "home_phenology_p2.png"]
    out = {r.name: r for r in listing.classify(spark.createDataFrame([(n,) for n in names], "name string"), queries.NAMING, queries.VARIANTS).collect()}
    assert "x.txt" not in out and len(out) == len(names) - 1
    assert out[names[0]][1:] == ("calendar", "", "Calendar 2020 - p03", "SAM", 2020, 3)
    assert out[names[1]].label == "Sentinel-2 + paddocks - farm" and out["other.mp4"].label == "other.mp4"
    assert out[names[3]][1:4] == ("climate", "OzWALD", "Rain 8Day") and out["a_report.pdf"].label == "PDF report" and out["q.png"].grp == "Other"


def test_tables(spark):
    a = spark.createDataFrame([(1, 2.0, "x")], "k int, v double, s string")
    assert tables.choose_values(a, ["k"]).columns == ["k", "v"]
    with pytest.raises(ValueError):
        tables.choose_values(a, ["k"], ["w"])
    with pytest.raises(ValueError):
        tables.rename_bands(a, {"v": "s"})
    with pytest.raises(RuntimeError):
        tables.union_chunks()


def test_sinks_and_markers(spark, tmp_path):
    path, built = str(tmp_path / "c"), []

    def build():
        built.append(1)
        return spark.createDataFrame([(1.5, "2020-01-01")], "v double, day string")

    assert plans.cached_csv(spark, path, "v double, day string", build).first().v == 1.5
    plans.cached_csv(spark, path, "v double, day string", build)
    assert len(built) == 1 and not plans.is_complete(spark, path, plans.BESIDE)
    plans.mark(spark, path)
    assert plans.is_complete(spark, path, plans.BESIDE)
    plans.remove(spark, path)
    assert not plans.exists(spark, path) and not plans.exists(spark, path + plans.BESIDE)
    ring = spark.createDataFrame([("a", [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)])], "zone string, ring array<struct<x:double,y:double>>")
    plans.write_geojson(ring, path)
    assert '"coordinates":[[[0.0,0.0]' in spark.read.text(path).first().value
    assert listing.list_files(spark, path).where("name LIKE 'part-%'").count() >= 1


def test_registry(tmp_path):
    box = (1.0, 2.0, 3.0, 4.0)
    a = plans.Request(box, dt.date(2020, 1, 1), dt.date(2021, 1, 1), stub="s")
    reg = plans.Registry(str(tmp_path / "r.json"))
    reg.register(a, "t1")
    assert reg.register(a, "t2") == {"place": a.place_hash, "time": a.time_hash, "created": "t1", "last_run": "t2"}
    for other in (plans.Request(box, a.start, dt.date(2022, 1, 1), stub="s"), plans.Request((9.0, 2.0, 10.0, 4.0), a.start, a.end, stub="s")):
        with pytest.raises(ValueError):
            reg.register(other, "t3")
    reg.register(plans.Request(box, a.start, dt.date(2022, 1, 1)), "t4")
    assert len(reg.entries()) == 2
    (tmp_path / "s.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        plans.read_settings(str(tmp_path / "s.json"), ("b",))


def test_yearly_and_daily_reading(spark, tmp_path):
    for v in ("rain", "wind"):
        for y in (2020, 2021):
            spark.createDataFrame([(lat, lon, dt.date(y, 1, 1), lat + lon + y) for lat in (-33.0, -34.0) for lon in (148.0, 149.0)], "lat double, lon double, time date, value double").write.parquet(str(tmp_path / f"{v}_{y}.parquet"))
    out = sources.read_years(spark, str(tmp_path), ["rain", "wind"], range(2020, 2022), (-33.2, 148.9)).orderBy("time").collect()
    assert [(r.lat, r.lon, r.rain, r.wind) for r in out] == [(-33.0, 149.0, y + 116.0, y + 116.0) for y in (2020, 2021)]
    assert sources.read_days(spark, [str(tmp_path / "rain_2020.parquet"), str(tmp_path / "gone")]).count() == 4
    with pytest.raises(RuntimeError):
        sources.read_days(spark, [str(tmp_path / "gone")])


def test_prior_falls_back_to_the_mean(spark):
    fine = spark.createDataFrame([(1, c, float(c), True) for c in range(3)] + [(1, 3, None, False)], "time int, cell int, f double, valid boolean")
    coarse = spark.createDataFrame([(1, c, float(c * c)) for c in range(3)], "time int, cell int, coarse double")
    got = {r.cell: r.prior for r in models.linear_prior(fine, coarse, ["f"]).collect()}
    assert got[0] == pytest.approx(-1 / 3) and got[3] is None
    few = models.linear_prior(fine, coarse.where("cell < 2"), ["f"]).collect()
    assert {r.prior for r in few if r.valid} == {0.5}


def test_seasons_by_trend(spark):
    v = [0.2 + 0.6 * np.exp(-(((d - 180) / 50) ** 2)) for d in range(1, 365, 10)]
    df = spark.createDataFrame([(1, 1 + 10 * i, float(x)) for i, x in enumerate(v)], "k int, doy int, v double")
    r = phenology.metrics(df, ["k"], "v", method="stl_trend").first()
    trend = phenology.stl_trend(np.array(v))
    up = [i for i in range(18) if v[i + 1] > v[i]]
    assert r.sos_times == 1 + 10 * min(up, key=lambda i: abs(v[i] - trend[i])) and r.sos_times < r.pos_times < r.eos_times


def test_presegment_of_missing_pixels(spark):
    rows = [(p, t, g, 2000) for p in range(3) for t, g in enumerate([None, 500, None, 900, 700]) if p < 2 or g is None]
    x = spark.createDataFrame([(p, t, None if p == 2 else g, n) for p, t, g, n in rows], "pixel int, time int, green int, nir1 int")
    out = {r.pixel: (r.u0, r.u1, r.u2) for r in pixels.presegment(x, ["pixel"]).collect()}
    assert out[2] == (0, 0, 0) and set(out) == {0, 1, 2} and chain_queries is not None


def test_partitioned_stage_and_reload(spark, tmp_path):
    path = str(tmp_path / "y")
    df = spark.createDataFrame([(2020, 1), (2021, 2)], "year int, v int")
    assert plans.cached(spark, path, lambda: df, partition_by=["year"]).where("year = 2021").first().v == 2
    assert plans.exists(spark, path + "/year=2020") and plans.is_complete(spark, path)
    plans.remove(spark, path)
    assert not plans.is_complete(spark, path)


def test_climate_table_from_csv(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text("day,rain,rain_source,metadata,latitude,longitude\n2020-01-02,1.5,25,x,1,2\n")
    out = sources.read_climate_csv(spark, str(f), "day", "day string, rain double, rain_source int, metadata string, latitude double, longitude double")
    assert out.columns == ["day", "rain"] and out.first().day == dt.date(2020, 1, 2)


def test_one_value_a_solar_day(spark):
    t = dt.datetime
    # at 150 degrees east the sun's day begins ten hours before that of UTC
    cube = spark.createDataFrame([(t(2020, 1, 1, 13), 0, 0, None), (t(2020, 1, 1, 15), 0, 0, 2.0), (t(2020, 1, 2, 1), 0, 0, 3.0)], "time timestamp_ntz, y int, x int, red double")
    out = {r.day: r.red for r in sources.by_solar_day(cube, ["red"], 150.0).collect()}
    assert out == {dt.date(2020, 1, 1): None, dt.date(2020, 1, 2): 2.0}


def test_zones_envelope_labels_and_status(spark):
    z = spark.createDataFrame([("a", [(0.0, 1.0), (4.0, 2.0), (0.0, 1.0)]), ("b", [(-1.0, 3.0), (2.0, -2.0), (-1.0, 3.0)])], "zone string, ring array<struct<x:double,y:double>>")
    assert tuple(zonal.envelope(z).first()) == (-1.0, -2.0, 4.0, 3.0)
    d = spark.createDataFrame([(3, "x"), (1, "y"), (2, "x"), (4, "z")], "o int, label string")
    assert [(r.label, r.id) for r in zonal.label_ids(d, "label", "o").orderBy("id").collect()] == [("y", 1), ("x", 2), ("z", 3)]
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert {tuple(r) for r in listing.expected_status(names("a", "b"), names("b", "c", "b")).collect()} == {("a", False), ("b", True)}


def test_windows_of_a_raster(spark):
    r = spark.createDataFrame([(float(y), float(x), 1) for y in range(4) for x in range(4)], "cy double, cx double, v int")
    assert sources.window_of(r, 1, 1, 2, 2).count() == 4 and sources.first_variable(r.withColumnsRenamed({"cy": "y", "cx": "x"})) == "v"
    with pytest.raises(RuntimeError):
        sources.window_of(r, 9, 9, 10, 10)
    with pytest.raises(RuntimeError):
        models.solved_times(spark.createDataFrame([(1, "infeasible")], "time int, status string"))


def test_dominant_year(spark):
    d = spark.createDataFrame([(dt.date(2020, 5, 1),), (dt.date(2021, 5, 1),), (dt.date(2021, 6, 1),)], "time date")
    assert {r.time.year for r in series.dominant_year(d).collect()} == {2021}
    assert {r.time.year for r in series.dominant_year(d, strict=True).collect()} == {2020}


def test_geojson_in_metres(spark, tmp_path):
    import json

    f = tmp_path / "m.geojson"
    f.write_text(json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": [[[17367530.445, 0.0], [0.0, 0.0], [0.0, 7342230.136], [17367530.445, 0.0]]]}, "properties": {}}]}))
    ring = sources.read_geojson(spark, str(f), degrees=projection.from_equal_area).first().ring
    assert (ring[0].x, ring[0].y) == (pytest.approx(180, abs=1e-6), 0) and ring[2].y == pytest.approx(90, abs=0.02)


def test_gains_of_the_network(spark):
    df = spark.createDataFrame([(1000, 2000, 3000, 1500, 500)], "green int, red int, nir1 int, swir2 int, swir3 int")
    bands = df.columns
    (w, b), (v, c) = models.DEMO_WEIGHTS
    x = np.array([0.1, 0.2, 0.3, 0.15, 0.05]) * 2
    want = np.maximum(x @ w + b, 0) @ v + c
    r = models.unmix(df, bands, gains=[2.0] * 5).first()
    assert [r.bg, r.pv, r.npv] == pytest.approx(want.tolist())
