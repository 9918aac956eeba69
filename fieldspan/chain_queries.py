"""Queries over chains of operators, projections, layouts and tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import grids, layout, models, phenology, pixels, projection, series, tables, zonal
from .queries import _G, _PEAKS, CLEAN, GRID, NDVI, PX, TS, R, _season, query
from .sources import grid_view, pixel_view, series_view

# --- images and zones

_FILL = "last_value(v IGNORE NULLS) OVER (PARTITION BY pixel ORDER BY time, zone ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_NDWI = f"({R['green']} - {R['nir1']}) / nullif({R['green']} + {R['nir1']}, 0)"
#: One value a pixel and day, so that the order of a series is not open.
_DAILY = f"{CLEAN}, day AS (SELECT pixel, zone, min(time) AS time, min(blue) AS blue, max(green) AS green, max(red) AS red, max(nir1) AS nir1, max(swir2) AS swir2, max(swir3) AS swir3 FROM clean WHERE dayofyear(time) <= 40 GROUP BY pixel, zone, CAST(time AS DATE))"


def _daily(spark, sf):
    x = pixels.cloud_mask(pixel_view(spark, sf)).where("dayofyear(time) <= 40").groupBy("pixel", "zone", F.to_date("time").alias("d"))
    return x.agg(F.min("time").alias("time"), F.min("blue").alias("blue"), *[F.max(b).alias(b) for b in pixels.BANDS[1:]]).drop("d")


@query("presegment", f"""WITH {_DAILY}, one AS (SELECT pixel, time, max(green) AS green, max(nir1) AS nir1 FROM day GROUP BY pixel, time), n AS (SELECT pixel, time, 0 AS zone, {_NDWI} AS v FROM one), f AS (SELECT pixel, time, {_FILL} AS v FROM n),
w AS (SELECT pixel, row_number() OVER (PARTITION BY pixel ORDER BY time) - 1 AS t, count(*) OVER (PARTITION BY pixel) AS n, coalesce(v, avg(v) OVER (PARTITION BY pixel)) AS v FROM f),
b AS (SELECT pixel, k, sqrt(pow(sum(v * cos(2 * pi() * k * t / n)), 2) + pow(sum(v * sin(2 * pi() * k * t / n)), 2)) AS m FROM w, (SELECT unnest([1, 2, 3, 4, 6, 7, 8, 9, 11, 12, 13, 14]) AS k) WHERE k < n GROUP BY pixel, k),
g AS (SELECT pixel, avg(m) FILTER (k < 5) AS b0, avg(m) FILTER (k BETWEEN 6 AND 9) AS b1, avg(m) FILTER (k > 10) AS b2 FROM b GROUP BY pixel)
SELECT pixel, {', '.join(f'coalesce(CAST(floor((b{k} - min(b{k}) OVER ()) / nullif(max(b{k}) OVER () - min(b{k}) OVER (), 0) * 255 + 1e-9) AS INT), 0) AS u{k}' for k in range(3))} FROM g""")
def presegment(spark, sf):
    x = _daily(spark, sf).groupBy("pixel", "time").agg(F.max("green").alias("green"), F.max("nir1").alias("nir1"))
    return pixels.presegment(x, ["pixel"])


_MASK = "mask AS (SELECT DISTINCT CAST(p_partkey % 50 AS INT) AS pixel, CAST(p_partkey % 50 AS INT) // 9 AS zone_id FROM part WHERE p_partkey % 50 < 40)"


@query("zonal_mask_series", f"WITH {CLEAN}, {_MASK} SELECT zone_id, time, round(median(red), 5) + 0.0 AS red, round(median(nir1), 5) + 0.0 AS nir1 FROM clean JOIN mask USING (pixel) GROUP BY zone_id, time")
def zonal_mask_series(spark, sf):
    cube = pixels.cloud_mask(pixel_view(spark, sf)).withColumns({"y": F.lit(0), "x": F.col("pixel")})
    mask = grid_view(spark, sf).where("x < 40").selectExpr("0 AS y", "x", "cast(floor(x / 9) AS int) AS zone_id").distinct()
    return zonal.zonal_series(cube, mask, ["red", "nir1"]).select("zone_id", "time", *[(F.round(c, 5) + 0.0).alias(c) for c in ("red", "nir1")])


@query("three_bands", f"WITH {PX} SELECT zone, CAST(sum(red) AS BIGINT) AS band1, CAST(sum(nir1) AS BIGINT) AS band2, CAST(sum(red) AS BIGINT) AS band3 FROM px GROUP BY zone")
def three_bands(spark, sf):
    x = pixels.three_bands(pixel_view(spark, sf).select("zone", "red", "nir1"), ["red", "nir1"])
    return x.groupBy("zone").agg(*[F.sum(f"band{k}").alias(f"band{k}") for k in (1, 2, 3)])


# --- rasters and projections

_POINTS = "p AS (SELECT c_custkey AS k, abs(c_acctbal) % 37 AS py, (abs(c_acctbal) * 7) % 49 AS px FROM customer)"


def _points(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k", "abs(c_acctbal) % 37 AS py", "(abs(c_acctbal) * 7) % 49 AS px")


@query("bilinear", f"""WITH {GRID}, h AS (SELECT y, x, CASE WHEN (x + y) % 7 > 0 THEN z END AS z FROM grid), {_POINTS}, c AS (SELECT k, py, px, floor(py) + i AS y, floor(px) + j AS x, abs(1 - i - (py - floor(py))) * abs(1 - j - (px - floor(px))) AS w FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT k, round(sum(w * z) / nullif(sum(w) FILTER (z IS NOT NULL), 0), 4) AS z FROM c LEFT JOIN h ON h.y = c.y AND h.x = c.x GROUP BY k""")
def bilinear(spark, sf):
    g = grid_view(spark, sf).withColumn("z", F.expr("CASE WHEN (x + y) % 7 > 0 THEN z END"))
    return grids.bilinear(g, _points(spark, sf)).select("k", F.round("z", 4).alias("z"))


@query("nearest_raster", f"WITH {GRID}, {_POINTS} SELECT k, round(z, 4) AS z FROM (SELECT k, 1000 - 30 * py AS cy, 200 + 30 * px AS cx FROM p) t LEFT JOIN grid ON grid.y = floor((1000 - cy) / 30 + 0.5) AND grid.x = floor((cx - 200) / 30 + 0.5)")
def nearest_raster(spark, sf):
    target = _points(spark, sf).selectExpr("k", "1000 - 30 * py AS cy", "200 + 30 * px AS cx")
    return grids.match_raster(grid_view(spark, sf), target, (200.0, 1000.0), 30.0, how="nearest").select("k", F.round("z", 4).alias("z"))


@query("border_and_clip", f"WITH {GRID}, b AS (SELECT y, x, z FROM grid WHERE y > (SELECT min(y) FROM grid) AND y < (SELECT max(y) FROM grid) AND x > (SELECT min(x) FROM grid) AND x < (SELECT max(x) FROM grid)) SELECT y, x, z FROM b WHERE 10.0 * x BETWEEN 80 AND 320 AND 10.0 * y BETWEEN 0 AND 170")
def border_and_clip(spark, sf):
    g = grids.without_border(grid_view(spark, sf)).withColumns({"cy": F.col("y") * 10.0, "cx": F.col("x") * 10.0})
    return grids.clip(g, 100.0, 20.0, 300.0, 150.0, 20.0).select("y", "x", "z")


@query("coarse_cells", f"WITH {GRID}, c AS (SELECT 980 + 140 - (j + 0.5) * 70 AS cy, 250 - 140 + (i + 0.5) * 70 AS cx FROM (SELECT unnest(range(0, 17)) AS i), (SELECT unnest(range(0, 10)) AS j)) SELECT CAST(cy AS DOUBLE) AS cy, CAST(cx AS DOUBLE) AS cx, z FROM c LEFT JOIN grid ON grid.y = floor((1000 - cy) / 30 + 0.5) AND grid.x = floor((cx - 200) / 30 + 0.5)")
def coarse_cells(spark, sf):
    out = grids.to_coarse(grid_view(spark, sf), (250.0, 600.0, 1160.0, 980.0), (200.0, 1000.0), 30.0, 70.0)
    return out.select(F.round("cy", 4).alias("cy"), F.round("cx", 4).alias("cx"), "z")


@query("direction_numbers", "SELECT p_partkey, CASE p_partkey % 260 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 3 WHEN 8 THEN 4 WHEN 16 THEN 5 WHEN 32 THEN 6 WHEN 64 THEN 7 WHEN 128 THEN 8 ELSE 0 END AS direction FROM part")
def direction_numbers(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", grids.direction_number(F.col("p_partkey") % 260).alias("direction"))


_LONLAT = "ll AS (SELECT c_custkey AS k, (c_custkey * 7919 % 36000) / 100.0 - 180 AS lon, (c_custkey * 104729 % 16000) / 100.0 - 80 AS lat FROM customer)"
_E2 = "0.0066943799901413165"


def _lonlat(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k", "(c_custkey * 7919 % 36000) / 100D - 180 AS lon", "(c_custkey * 104729 % 16000) / 100D - 80 AS lat")


@query("project_equal_area", f"""WITH {_LONLAT}, c AS (SELECT *, sqrt({_E2}) AS e, sin(radians(lat)) AS s, cos(radians(30)) / sqrt(1 - {_E2} * pow(sin(radians(30)), 2)) AS k0 FROM ll),
q AS (SELECT *, (1 - {_E2}) * (s / (1 - {_E2} * s * s) + atanh(e * s) / e) AS q FROM c) SELECT k, round(6378137 * k0 * radians(lon), 2) AS x, round(6378137 * q / (2 * k0), 2) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM q""")
def project_equal_area(spark, sf):
    p = _lonlat(spark, sf)
    x, y = projection.equal_area(F.col("lon"), F.col("lat"))
    p = p.select("k", x.alias("x"), y.alias("y"))
    lon, lat = projection.from_equal_area(F.col("x"), F.col("y"))
    return p.select("k", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


# the transverse Mercator by its power series in the distance from the meridian, as printed in manuals; good to centimetres in a zone
_UTM = f"""WITH {_LONLAT}, z AS (SELECT *, CAST(least(floor((lon + 180) / 6) + 1, 60) AS INT) AS zone, radians(lat) AS f FROM ll), c AS (SELECT *, {_E2} AS e2, {_E2} / (1 - {_E2}) AS ep, radians(lon - (zone * 6 - 183)) * cos(f) AS a, pow(tan(f), 2) AS t FROM z),
d AS (SELECT *, ep * pow(cos(f), 2) AS c, 6378137 / sqrt(1 - e2 * pow(sin(f), 2)) AS n, 6378137 * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * f - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * f) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * f) - 35 * e2 ** 3 / 3072 * sin(6 * f)) AS m FROM c)
SELECT k, zone, round(500000 + 0.9996 * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t ** 2 + 72 * c - 58 * ep) * a ** 5 / 120), -2) AS easting,
round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + 0.9996 * (m + n * tan(f) * (a ** 2 / 2 + (5 - t + 9 * c + 4 * c ** 2) * a ** 4 / 24 + (61 - 58 * t + t ** 2 + 600 * c - 330 * ep) * a ** 6 / 720)), -2) AS northing, round(lon, 6) AS lon, round(lat, 6) AS lat FROM d"""


@query("project_utm", _UTM)
def project_utm(spark, sf):
    p = _lonlat(spark, sf).withColumn("zone", projection.utm_zone(F.col("lon")))
    e, n = projection.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    p = p.withColumns({"e": e, "n": n})
    lon, lat = projection.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("lat") < 0)
    return p.select("k", "zone", F.round("e", -2).alias("easting"), F.round("n", -2).alias("northing"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("terrain_chain")
def terrain_chain(spark, sf):
    """Flow over the filled raster, and the wetness and heat load that follow from it."""
    g = grid_view(spark, sf)
    area = grids.flow(g.withColumn("area", F.lit(0)), "area").select("y", "x", "accumulation")
    slope = grids.gradients(g).select("y", "x", grids.slope_degrees().alias("slope"), grids.aspect_degrees().alias("aspect"))
    x = slope.join(area, ["y", "x"])
    return x.select("y", "x", "accumulation", F.round(grids.wetness(F.col("accumulation").cast("double"), F.col("slope")), 4).alias("twi"), F.round(grids.heat_load(F.col("slope"), F.col("aspect"), -33.5), 4).alias("hli"))


@query("plot_terrain", f"WITH {_G} SELECT CAST(floor(y / 4.0) AS INT) AS y, CAST(floor(x / 4.0) AS INT) AS x, round(avg(slope), 4) AS slope, round(max(aspect) FILTER (y % 4 = 2 AND x % 4 = 2), 4) AS aspect, CAST(max(y * 50 + x) AS INT) AS accumulation FROM sl GROUP BY 1, 2")
def plot_terrain(spark, sf):
    s = grids.gradients(grid_view(spark, sf)).select("y", "x", grids.slope_degrees().alias("slope"), grids.aspect_degrees().alias("aspect"), F.expr("y * 50 + x").alias("a"))
    out = grids.regrid(s, 4, {"slope": ("mean", "slope"), "aspect": ("nearest", "aspect"), "accumulation": ("max", "a")})
    return out.select("y", "x", F.round("slope", 4).alias("slope"), F.round("aspect", 4).alias("aspect"), "accumulation")


# --- downscaling

_CUBE = "cube AS (SELECT CAST(year(time) AS INT) AS time, pixel, CAST(floor(pixel / 4) AS INT) AS cell, max(red) AS red, max(nir1) AS nir1, max(swir2) AS swir2, max(swir3) AS swir3 FROM clean GROUP BY 1, 2)"
_FEAT = f"""{CLEAN}, {_CUBE}, ft AS (SELECT time, pixel, cell, {NDVI} AS ndvi, {R['swir2']} AS swir2, {R['swir3']} AS swir3, CAST(least(greatest(pixel - 10, 0), 20) AS DOUBLE) AS twi, 1.0 / (pixel + 1) AS hli FROM cube), fv AS (SELECT *, ndvi IS NOT NULL AND swir2 IS NOT NULL AND swir3 IS NOT NULL AND twi IS NOT NULL AND hli IS NOT NULL AS valid FROM ft)"""


def _features(spark, sf):
    x = pixels.cloud_mask(pixel_view(spark, sf)).withColumn("time", F.year("time")).groupBy("time", "pixel").agg(F.max("red").alias("red"), F.max("nir1").alias("nir1"), F.max("swir2").alias("swir2"), F.max("swir3").alias("swir3"))
    cube = x.withColumns({"y": F.lit(0), "x": F.col("pixel")})
    terrain = cube.select("y", "x").distinct().withColumns({"twi": F.col("x") - 10.0, "hli": 1.0 / (F.col("x") + 1)})
    return models.features(cube, terrain).withColumn("cell", F.floor(F.col("x") / 4).cast("int"))


@query("fine_features", f"WITH {_FEAT} SELECT time, pixel AS x, cell, round(ndvi, 5) + 0.0 AS ndvi, round(swir2, 5) AS swir2, round(swir3, 5) AS swir3, round(twi, 5) AS twi, round(hli, 5) AS hli, valid FROM fv")
def fine_features(spark, sf):
    return _features(spark, sf).select("time", "x", "cell", *[(F.round(c, 5) + 0.0).alias(c) for c in ("ndvi", "swir2", "swir3", "twi", "hli")], "valid")


_COARSE = "coarse AS (SELECT time, cell, CASE WHEN (cell + time) % 5 > 0 THEN 2.0 + 0.3 * cell + 0.01 * (cell * cell % 7) END AS coarse FROM (SELECT DISTINCT time, cell FROM fv))"


@query("linear_prior", f"""WITH {_FEAT}, {_COARSE}, m AS (SELECT time, cell, CASE WHEN avg(CAST(valid AS INT)) > 0.1 THEN avg(twi) FILTER (valid) END AS twi FROM fv GROUP BY 1, 2),
l AS (SELECT time, CASE WHEN regr_count(coarse, twi) >= 3 AND regr_sxx(coarse, twi) > 0 THEN regr_intercept(coarse, twi) ELSE avg(coarse) END AS a, CASE WHEN regr_count(coarse, twi) >= 3 AND regr_sxx(coarse, twi) > 0 THEN regr_slope(coarse, twi) ELSE 0 END AS b FROM coarse LEFT JOIN m USING (time, cell) GROUP BY time)
SELECT fv.time, pixel AS x, round(CASE WHEN valid THEN a + b * twi END, 4) AS prior FROM fv JOIN l USING (time)""")
def linear_prior(spark, sf):
    f = _features(spark, sf)
    coarse = f.select("time", "cell").distinct().withColumn("coarse", F.expr("CASE WHEN (cell + time) % 5 > 0 THEN 2.0D + 0.3D * cell + 0.01D * (cell * cell % 7) END"))
    return models.linear_prior(f, coarse, ["twi"]).select("time", "x", F.round("prior", 4).alias("prior"))


# --- seasons


@query("pheno_stl")
def pheno_stl(spark, sf):
    m = phenology.metrics(_season(spark, sf), ["zone", "year"], "v", method="stl_trend")
    return m.select("zone", "year", "sos_times", "eos_times", F.round("sos_values", 4).alias("sos_values"), F.round("eos_values", 4).alias("eos_values"))


@query("season_table", f"SELECT year, CAST(count(*) AS BIGINT) AS n_series, avg(num_peaks) AS mean_peaks FROM ({_PEAKS}) GROUP BY year")
def season_table(spark, sf):
    t = phenology.season_table(_season(spark, sf), ["zone", "year"], "v", sides="one_sided")
    return phenology.mean_peaks(t, ["year"])


# --- layouts


@query("frames", f"WITH {GRID}, k AS (SELECT CAST(unnest(range(0, 80)) AS INT) AS y), l AS (SELECT CAST(unnest(range(0, 100)) AS INT) AS x) SELECT 0 AS time, k.y, l.x, g.z AS r FROM k, l JOIN (SELECT * FROM grid WHERE y < 40) g ON g.y = floor(k.y * 40 / 80.0) AND g.x = floor(l.x * 50 / 100.0)")
def frames(spark, sf):
    g = grid_view(spark, sf).where("y < 40").select(F.lit(0).alias("time"), "y", "x", F.col("z").alias("r"))
    return layout.frames(g, 40, 50, 100)


@query("label_points", "SELECT CAST(c_custkey AS VARCHAR) AS zone, round((c_custkey % 91 + (40 + c_nationkey) / 2.0 - 10) / 10 * 2, 4) AS px, round((900 - (c_custkey % 53 + (30 + c_custkey % 7) / 2.0)) / 10 * 2, 4) AS py FROM customer")
def label_points(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("cast(c_custkey AS string) AS zone", "cast(c_custkey % 91 AS double) AS x0", "cast(c_custkey % 53 AS double) AS y0", "40D + c_nationkey AS w", "30D + c_custkey % 7 AS h")
    ring = c.select("zone", F.expr("transform(array((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), p -> struct(x0 + p.col1 * w AS x, y0 + p.col2 * h AS y))").alias("ring"))
    return layout.label_points(ring, (10.0, 900.0), 10.0, 2.0).select("zone", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@query("season_panels", f"WITH {TS}, d AS (SELECT zone, CAST(year(time) AS INT) AS year, CAST(dayofyear(time) AS INT) AS doy, avg(value) AS value FROM ts GROUP BY ALL), m AS (SELECT zone, year, max(value) AS top FROM d GROUP BY ALL), p AS (SELECT d.zone, d.year, min(doy) AS doy, any_value(top) AS value, 'pos' AS kind FROM d JOIN m ON d.zone = m.zone AND d.year = m.year AND d.value = m.top GROUP BY ALL) SELECT zone, year, doy, round(value, 8) AS value, CASE WHEN doy % 2 = 0 THEN 'sampled' ELSE 'interpolated' END AS kind FROM d UNION ALL SELECT zone, year, doy, round(value, 8), kind FROM (SELECT zone, year, doy, value, kind FROM p)".replace("any_value(top) AS value, 'pos' AS kind FROM d JOIN m ON d.zone = m.zone AND d.year = m.year AND d.value = m.top GROUP BY ALL", "max(top) AS value, 'pos' AS kind FROM d JOIN m ON d.zone = m.zone AND d.year = m.year AND d.value = m.top GROUP BY d.zone, d.year"))
def season_panels(spark, sf):
    x = series.with_year_and_doy(series_view(spark, sf)).groupBy("zone", "year", "doy").agg(F.avg("value").alias("value")).withColumn("observed", F.expr("doy % 2 = 0"))
    top = x.groupBy("zone", "year").agg(F.min(F.struct(-F.col("value"), F.col("doy"))).alias("t")).selectExpr("zone", "year", "t.doy AS pos_times", "-t.col1 AS pos_values")
    none = {f"{m}_{k}": F.lit(None).cast(t) for m in ("sos", "eos") for k, t in (("times", "int"), ("values", "double"))}
    return layout.season_panels(x, top.withColumns(none), ["zone", "year"]).select("zone", "year", "doy", F.round("value", 8).alias("value"), "kind")


@query("variable_groups", "WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, round(sum(l_quantity), 6) AS rain, max(l_tax) AS tmax, min(l_discount) AS tmin FROM lineitem GROUP BY 1) SELECT 'water' AS grp, 'rain' AS variable, day, rain AS value FROM d UNION ALL SELECT 'heat', 'tmax', day, tmax FROM d UNION ALL SELECT 'heat', 'tmin', day, tmin FROM d")
def variable_groups(spark, sf):
    d = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_quantity"), 6).alias("rain"), F.max("l_tax").alias("tmax"), F.min("l_discount").alias("tmin"))
    return layout.variable_groups(d, "day", {"water": ["rain", "runoff"], "heat": ["tmax", "tmin"]})


@query("month_headings", "SELECT CAST(4 * i AS INT) AS slot, strftime(make_date(2001, CAST(i + 1 AS INT), 1), '%b') AS month FROM (SELECT unnest(range(0, 12)) AS i)")
def month_headings(spark, sf):
    return layout.month_headings(spark)


@query("mask_windows", f"WITH {GRID} SELECT CAST((x + y) // 13 AS INT) AS zone_id, CAST(greatest(min(y) - 2, 0) AS INT) AS y0, CAST(least(max(y) + 3, 400) AS INT) AS y1, CAST(greatest(min(x) - 2, 0) AS INT) AS x0, CAST(least(max(x) + 3, 50) AS INT) AS x1 FROM grid GROUP BY 1")
def mask_windows(spark, sf):
    mask = grid_view(spark, sf).selectExpr("y", "x", "cast(floor((x + y) / 13) AS int) AS zone_id")
    return grids.mask_windows(mask, "zone_id", 400, 50)


# --- tables


@query("chosen_values", f"WITH {PX} SELECT zone, CAST(sum(red) AS BIGINT) AS b_red, CAST(sum(nir1) AS BIGINT) AS nir1, CAST(sum(2 * red) AS BIGINT) AS twice FROM px GROUP BY zone")
def chosen_values(spark, sf):
    x = tables.choose_values(pixel_view(spark, sf).drop("time"), ["zone"], ["red", "nir1", "fmask"], ("fmask",))
    x = tables.with_missing(tables.rename_bands(x, {"red": "b_red", "blue": "b_blue"}), {"nir1": F.lit(0), "twice": F.col("b_red") * 2})
    return x.groupBy("zone").agg(*[F.sum(c).alias(c) for c in ("b_red", "nir1", "twice")])


@query("label_join", "SELECT CAST(c_custkey AS VARCHAR) AS label, n_name, coalesce(n_name, 'none') AS name FROM customer LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = CAST(c_custkey AS VARCHAR)")
def label_join(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("label"))
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("label"), "n_name")
    return tables.join_by_label(c, n, "label").withColumn("name", tables.first_given(F.col("n_name"), F.lit("none")))


@query("shared_years", "SELECT CAST(year(o_orderdate) AS INT) AS year FROM orders INTERSECT SELECT CAST(year(l_shipdate) AS INT) FROM lineitem WHERE l_quantity > 3")
def shared_years(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.year("o_orderdate").alias("year"))
    return tables.shared_keys("year", o, spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 3").select(F.year("l_shipdate").alias("year")))


@query("union_chunks", f"WITH {TS} SELECT zone, CAST(time AS DATE) AS day, value, CASE WHEN year(time) = 1995 THEN zone END AS mark FROM ts WHERE year(time) BETWEEN 1994 AND 1995 AND time >= DATE '1994-06-01' AND time < DATE '1995-06-02'")
def union_chunks(spark, sf):
    x = series_view(spark, sf).selectExpr("zone", "to_date(time) AS day", "value")
    parts = [x.where("year(day) = 1994"), x.where("year(day) = 1995").withColumn("mark", F.col("zone"))]
    return tables.between_days(tables.union_chunks(*parts), "day", "1994-06-01", "1995-06-01")


@query("daily_mean", f"WITH {CLEAN} SELECT CAST(time AS DATE) AS day, round(avg(red), 5) AS red, CAST(count(red) AS BIGINT) AS n FROM clean GROUP BY 1")
def daily_mean(spark, sf):
    x = pixels.cloud_mask(pixel_view(spark, sf)).withColumn("day", F.to_date("time"))
    return tables.daily_mean(x, "red", "day").select("day", F.round("red", 5).alias("red"), "n")
