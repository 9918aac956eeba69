"""The queries over the driver's tables and their SQL: one or more for each family of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import grids, listing, matching, models, phenology, pixels, series, zonal
from .sources import grid_view, pixel_view, series_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PX = """px AS (SELECT l_shipdate AS time, CAST(l_suppkey % 12 AS INT) AS zone, CAST(l_partkey % 50 AS INT) AS pixel, CAST(l_linenumber * 300 AS INT) AS blue, CAST((l_partkey % 37) * 40 AS INT) AS green,
 CAST(round(l_quantity * 60) AS INT) AS red, CAST(round(l_extendedprice / 10) AS INT) AS nir1, CAST(round(l_discount * 10000) AS INT) AS swir2, CAST(round(l_tax * 10000) AS INT) AS swir3,
 CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE CASE WHEN l_linenumber = 7 THEN 3 ELSE 0 END END AS fmask FROM lineitem)"""
CLEAN = PX + ", clean AS (SELECT time, zone, pixel, " + ", ".join(f"CASE WHEN fmask NOT IN (2, 3) THEN {b} END AS {b}" for b in pixels.BANDS) + " FROM px)"
TS = "ts AS (SELECT CAST(o_custkey % 240 AS INT) AS zone, o_orderdate AS time, o_totalprice / 100000 AS value FROM orders)"
GRID = "grid AS (SELECT CAST(floor(p_partkey / 50) AS INT) AS y, CAST(p_partkey % 50 AS INT) AS x, p_retailprice AS z FROM part)"
R = {b: f"(nullif(CAST({b} AS DOUBLE), 0) / 10000)" for b in pixels.BANDS}
NDVI = f"(({R['nir1']} - {R['red']}) / nullif({R['nir1']} + {R['red']}, 0))"
INDEX_SQL = {
    "ndvi": NDVI,
    "cfi": f"{NDVI} * ({R['red']} + 2 * {R['green']} - {R['blue']})",
    "nirv": f"{NDVI} * {R['nir1']}",
    "ndti": f"({R['swir2']} - {R['swir3']}) / nullif({R['swir2']} + {R['swir3']}, 0)",
    "cai": f"0.5 * ({R['swir2']} + {R['swir3']}) - {R['nir1']}",
    "ndwi": f"({R['green']} - {R['nir1']}) / nullif({R['green']} + {R['nir1']}, 0)",
    "evi": f"2.5 * ({R['nir1']} - {R['red']}) / nullif({R['nir1']} + 6 * {R['red']} - 7.5 * {R['blue']} + 1, 0)",
    "mavi": f"({R['nir1']} - {R['red']}) / nullif({R['nir1']} + {R['red']} + {R['swir2']}, 0)",
}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r(c: str, places: int = 5) -> Column:
    """Rounded for comparison; -0 is 0."""
    return (F.round(c, places) + 0.0).alias(c)


def rs(c: str, places: int = 5, name: str | None = None) -> str:
    return f"round({c}, {places}) + 0.0 AS {name or c}"


# --- pixels


@query("cloud_mask", f"WITH {CLEAN} SELECT zone, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"CAST(sum({b}) AS BIGINT) AS {b}, CAST(count({b}) AS BIGINT) AS n_{b}" for b in pixels.BANDS) + " FROM clean GROUP BY zone")
def cloud_mask(spark, sf):
    return pixels.cloud_mask(pixel_view(spark, sf)).groupBy("zone").agg(F.count("*").alias("n"), *[x for b in pixels.BANDS for x in (F.sum(b).alias(b), F.count(b).alias(f"n_{b}"))])


_NULLS = " + ".join(f"CAST({b} IS NULL AS INT)" for b in pixels.BANDS)


@query("scene_null_filter", f"WITH {CLEAN}, f AS (SELECT time, CAST(sum({_NULLS}) AS DOUBLE) / (count(*) * 6) AS null_fraction, count(*) AS n FROM clean GROUP BY time) SELECT time, {rs('null_fraction')}, CAST(n AS BIGINT) AS n_pixels FROM f WHERE null_fraction < 0.5")
def scene_null_filter(spark, sf):
    f = pixels.scene_null_fraction(pixels.cloud_mask(pixel_view(spark, sf))).where("null_fraction < 0.5")
    return f.select("time", r("null_fraction"), "n_pixels")


@query("scene_keep", f"WITH {CLEAN}, k AS (SELECT time FROM clean GROUP BY time HAVING CAST(sum({_NULLS}) AS DOUBLE) / (count(*) * 6) < 0.3) SELECT zone, CAST(count(*) AS BIGINT) AS n, CAST(sum(red) AS BIGINT) AS red FROM clean WHERE time IN (SELECT time FROM k) GROUP BY zone")
def scene_keep(spark, sf):
    return pixels.keep_clear_scenes(pixels.cloud_mask(pixel_view(spark, sf)), most=0.3).groupBy("zone").agg(F.count("*").alias("n"), F.sum("red").alias("red"))


def _index_query(name: str) -> None:
    @query(f"idx_{name}", f"WITH {CLEAN} SELECT zone, pixel, CAST(count(*) AS BIGINT) AS n, CAST(count(v) AS BIGINT) AS n_valid, {rs('avg(v)', name='mean_v')}, {rs('min(v)', name='min_v')}, {rs('max(v)', name='max_v')} FROM (SELECT zone, pixel, {INDEX_SQL[name]} AS v FROM clean) GROUP BY zone, pixel")
    def q(spark, sf):
        x = pixels.cloud_mask(pixel_view(spark, sf)).select("zone", "pixel", pixels.index_named(name).alias("v"))
        return x.groupBy("zone", "pixel").agg(F.count("*").alias("n"), F.count("v").alias("n_valid"), *[(F.round(f("v"), 5) + 0.0).alias(f"{k}_v") for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


for _n in INDEX_SQL:
    _index_query(_n)


@query("zonal_median", f"WITH {CLEAN} SELECT zone, year(time) AS year, {rs('median(red)', name='red')}, {rs('median(nir1)', name='nir1')}, round(median({NDVI}), 5) + 0.0 AS ndvi, CAST(count(*) AS BIGINT) AS n FROM clean GROUP BY zone, year(time)".replace("year(time) AS year", "CAST(year(time) AS INT) AS year"))
def zonal_median(spark, sf):
    x = pixels.with_indices(pixels.cloud_mask(pixel_view(spark, sf)), {"ndvi": pixels.ndvi}).withColumn("year", F.year("time"))
    return zonal.zonal_median(x, ["zone", "year"], ["red", "nir1", "ndvi"], "n").select("zone", "year", r("red"), r("nir1"), r("ndvi"), "n")


@query("minmax_uint8", f"WITH {PX}, b AS (SELECT *, min(red) OVER (PARTITION BY zone) AS lo, max(red) OVER (PARTITION BY zone) AS hi FROM px), u AS (SELECT zone, coalesce(CAST(floor(least(greatest((red - lo) / nullif(CAST(hi - lo AS DOUBLE), 0), 0), 1) * 255) AS INT), 0) AS red_u8 FROM b) SELECT zone, red_u8, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY zone, red_u8")
def minmax_uint8(spark, sf):
    return pixels.to_uint8(pixel_view(spark, sf), "red", ["zone"]).groupBy("zone", "red_u8").agg(F.count("*").alias("n"))


@query("rgb_stretch", f"WITH {CLEAN} SELECT zone, " + ", ".join(f"round(avg(coalesce(least(greatest({R[b]} * 3, 0), 1), 0)), 5) + 0.0 AS {b}" for b in ("red", "green", "blue")) + " FROM clean GROUP BY zone")
def rgb_stretch(spark, sf):
    x = pixels.cloud_mask(pixel_view(spark, sf))
    return x.groupBy("zone").agg(*[(F.round(F.avg(pixels.true_colour(b)), 5) + 0.0).alias(b) for b in ("red", "green", "blue")])


@query("fc_normalise", f"WITH {PX}, c AS (SELECT zone, swir2 / 10000.0 AS bg, swir3 / 10000.0 AS pv, green / 10000.0 AS npv FROM px) SELECT zone, " + ", ".join(f"round(avg(coalesce(least(greatest({p} / greatest(bg + pv + npv, 0.000001), 0), 1), 0)), 5) + 0.0 AS {p}" for p in ("bg", "pv", "npv")) + " FROM c GROUP BY zone")
def fc_normalise(spark, sf):
    parts = ["bg", "pv", "npv"]
    x = pixel_view(spark, sf).selectExpr("zone", "swir2 / 10000D AS bg", "swir3 / 10000D AS pv", "green / 10000D AS npv")
    return x.groupBy("zone").agg(*[(F.round(F.avg(pixels.cover_colour(p, parts)), 5) + 0.0).alias(p) for p in parts])


@query("fourier_bands", "WITH v AS (SELECT vec_id, embedding AS e, f FROM embeddings, (SELECT unnest([1,2,3,4,6,7,8,9,11,12,13,14]) AS f)), t AS (SELECT vec_id, f, sum(CAST(e[i + 1] AS DOUBLE) * cos(2 * pi() * f * i / len(e))) AS re, sum(CAST(e[i + 1] AS DOUBLE) * sin(2 * pi() * f * i / len(e))) AS im FROM (SELECT *, unnest(range(0, len(e))) AS i FROM v) GROUP BY vec_id, f) SELECT vec_id, " + ", ".join(f"round(avg(sqrt(re * re + im * im)) FILTER (f BETWEEN {1 + 5 * k} AND {4 + 5 * k}), 5) AS f{k}" for k in range(3)) + " FROM t GROUP BY vec_id")
def fourier_bands(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", *[F.round(c, 5).alias(f"f{k}") for k, c in enumerate(pixels.fourier_means("embedding"))])


@query("trapz_array", "SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding)), lambda i: (CAST(embedding[i] AS DOUBLE) + CAST(embedding[i + 1] AS DOUBLE)) / 2)), 5) + 0.0 AS area FROM embeddings")
def trapz_array(spark, sf):
    area = "aggregate(zip_with(slice(embedding, 1, size(embedding) - 1), slice(embedding, 2, size(embedding) - 1), (a, b) -> (cast(a AS double) + cast(b AS double)) / 2), 0D, (s, x) -> s + x)"
    return spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id", f"round({area}, 5) + 0.0D AS area")


# --- series

_BIN = "CAST(floor(date_diff('day', (SELECT min(CAST(time AS DATE)) FROM {t}), CAST(time AS DATE)) / 10.0) AS INT)"
BINS = TS + f""", b AS (SELECT zone, {_BIN.format(t='ts')} AS bin, value FROM ts), m AS (SELECT zone, bin, median(value) AS value FROM b GROUP BY zone, bin),
spine AS (SELECT zone, bin FROM (SELECT DISTINCT zone FROM ts), (SELECT CAST(unnest(range(0, (SELECT max(bin) FROM b) + 1)) AS INT) AS bin)),
s AS (SELECT spine.zone, spine.bin, m.value FROM spine LEFT JOIN m USING (zone, bin))"""


def _bins(spark, sf):
    return series.resample(series_view(spark, sf), ["zone"], ["value"], 10)


@query("resample_10d_median", f"WITH {BINS} SELECT zone, bin, CAST((SELECT min(CAST(time AS DATE)) FROM ts) + bin * 10 AS DATE) AS label, round(value, 10) AS value, value IS NOT NULL AS observed FROM s")
def resample_10d_median(spark, sf):
    return _bins(spark, sf).select("zone", "bin", "label", F.round("value", 10).alias("value"), "observed")


@query("resample_month_mean", f"WITH {TS} SELECT zone, CAST(last_day(time) AS DATE) AS label, round(avg(value), 10) AS value FROM ts GROUP BY ALL")
def resample_month_mean(spark, sf):
    return series.resample_calendar(series_view(spark, sf), ["zone"], "value").select("zone", "label", F.round("value", 10).alias("value"))


@query("resample_week_median", f"WITH {TS} SELECT zone, CAST(date_trunc('week', time) AS DATE) + 6 AS label, round(median(value), 10) AS value FROM ts GROUP BY ALL")
def resample_week_median(spark, sf):
    return series.resample_calendar(series_view(spark, sf), ["zone"], "value", "1W", "median").select("zone", "label", F.round("value", 10).alias("value"))


@query("month_sum", f"WITH {TS}, m AS (SELECT zone, last_day(time) AS label, sum(value) AS value FROM ts GROUP BY ALL), d AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', (SELECT min(time) FROM ts)), date_trunc('month', (SELECT max(time) FROM ts)), INTERVAL 1 MONTH)) AS DATE)) AS label) SELECT z.zone, d.label, round(coalesce(m.value, 0), 10) AS value FROM (SELECT DISTINCT zone FROM ts) z CROSS JOIN d LEFT JOIN m ON m.zone = z.zone AND m.label = d.label")
def month_sum(spark, sf):
    return series.month_sum(series_view(spark, sf), ["zone"], "value").select("zone", "label", F.round("value", 10).alias("value"))


@query("climatology_month", f"WITH {TS}, y AS (SELECT (min(year(time)) + max(year(time))) // 2 AS y FROM ts) SELECT zone, CAST(month(time) AS INT) AS month, round(median(value), 10) AS value, make_date(any_value(y.y), month(time), 1) AS label FROM ts, y GROUP BY zone, month(time)")
def climatology_month(spark, sf):
    x = series_view(spark, sf)
    return series.climatology(x, ["zone"], "value", year=series.middle_year(x, "time")).select("zone", "month", F.round("value", 10).alias("value"), "label")


@query("climatology_week", f"WITH {TS} SELECT zone, CAST(weekofyear(time) AS INT) AS week, round(avg(value), 9) AS value FROM ts GROUP BY ALL")
def climatology_week(spark, sf):
    return series.climatology(series_view(spark, sf), ["zone"], "value", "week", "mean").select("zone", "week", F.round("value", 9).alias("value"))


@query("to_year_end", f"WITH {TS}, d AS (SELECT DISTINCT zone % 60 AS zone, year(time) AS y, CAST(time AS DATE) AS day FROM ts WHERE dayofyear(time) % 3 = 0) SELECT zone, CAST(y AS INT) AS year, CASE WHEN day = max(day) OVER (PARTITION BY zone, y) AND month(day) = 12 THEN make_date(y, 12, 31) ELSE day END AS day FROM d")
def to_year_end(spark, sf):
    x = series_view(spark, sf).where("dayofyear(time) % 3 = 0").selectExpr("zone % 60 AS zone", "year(time) AS year", "to_date(time) AS day").distinct()
    return series.to_year_end(x, ["zone", "year"], "day")


_FF = "last_value(value IGNORE NULLS) OVER (PARTITION BY zone ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("ffill", f"WITH {BINS} SELECT zone, bin, round({_FF}, 10) AS value FROM s")
def ffill(spark, sf):
    return series.forward_fill(_bins(spark, sf), ["zone"], "value", "bin").select("zone", "bin", F.round("value", 10).alias("value"))


@query("completion_fill", f"WITH {BINS}, f AS (SELECT zone, bin, {_FF} AS value FROM s) SELECT zone, bin, round(coalesce(value, avg(value) OVER (PARTITION BY zone)), 10) AS value FROM f")
def completion_fill(spark, sf):
    return series.complete(_bins(spark, sf), ["zone"], "value", "bin").select("zone", "bin", F.round("value", 10).alias("value"))


_LIN = """x AS (SELECT zone, bin, value, last_value(CASE WHEN value IS NOT NULL THEN bin END IGNORE NULLS) OVER a AS x0, last_value(value IGNORE NULLS) OVER a AS y0,
 first_value(CASE WHEN value IS NOT NULL THEN bin END IGNORE NULLS) OVER b AS x1, first_value(value IGNORE NULLS) OVER b AS y1 FROM s
 WINDOW a AS (PARTITION BY zone ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY zone ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("interp_linear", f"WITH {BINS}, {_LIN} SELECT zone, bin, round(coalesce(value, y0 + (y1 - y0) * ((bin - x0) / nullif(CAST(x1 - x0 AS DOUBLE), 0))), 13) AS value FROM x")
def interp_linear(spark, sf):
    return series.interpolate_linear(_bins(spark, sf), ["zone"], "value", "bin").select("zone", "bin", F.round("value", 13).alias("value"))


def _end(h0, d0, h1, d1):
    raw = f"((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1})"
    return f"CASE WHEN n = 2 THEN {d0} WHEN sign({raw}) <> sign({d0}) THEN 0 WHEN sign({d0}) <> sign({d1}) AND abs({raw}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {raw} END"


PCHIP = BINS + f""", k1 AS (SELECT zone, CAST(bin AS DOUBLE) AS x, value AS y, count(*) OVER (PARTITION BY zone) AS n, lead(bin) OVER w - bin AS h, (lead(value) OVER w - value) / (lead(bin) OVER w - bin) AS d FROM s WHERE value IS NOT NULL WINDOW w AS (PARTITION BY zone ORDER BY bin)),
k2 AS (SELECT *, lag(h) OVER w AS hp, lag(d) OVER w AS dp, lead(h) OVER w AS hn, lead(d) OVER w AS dn, lag(h, 2) OVER w AS hpp, lag(d, 2) OVER w AS dpp FROM k1 WINDOW w AS (PARTITION BY zone ORDER BY x)),
k3 AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN dp IS NULL THEN {_end('h', 'd', 'hn', 'dn')} WHEN d IS NULL THEN {_end('hp', 'dp', 'hpp', 'dpp')} WHEN dp * d <= 0 THEN 0 ELSE ((2 * h + hp) + (h + 2 * hp)) / ((2 * h + hp) / dp + (h + 2 * hp) / d) END AS s FROM k2),
seg AS (SELECT zone, x, y, s, h, lead(y) OVER w AS y1, lead(s) OVER w AS s1, n, row_number() OVER w AS i FROM k3 WINDOW w AS (PARTITION BY zone ORDER BY x)),
pick AS (SELECT s.zone, s.bin, least(greatest((SELECT count(*) FROM seg WHERE seg.zone = s.zone AND seg.x <= s.bin), 1), (SELECT max(n) - 1 FROM seg WHERE seg.zone = s.zone)) AS i FROM s),
p AS (SELECT pick.zone, pick.bin, (pick.bin - x) / h AS t, x, y, seg.s, h, y1, s1 FROM pick LEFT JOIN seg ON seg.zone = pick.zone AND seg.i = pick.i),
filled AS (SELECT zone, bin, y * (1 + 2 * t) * pow(1 - t, 2) + h * s * t * pow(1 - t, 2) + y1 * pow(t, 2) * (3 - 2 * t) + h * s1 * pow(t, 2) * (t - 1) AS value FROM p)"""


@query("pchip_fill", f"WITH {PCHIP} SELECT zone, bin, floor(value * 1e6 + 0.5) / 1e6 AS value FROM filled")
def pchip_fill(spark, sf):
    return series.pchip(_bins(spark, sf), ["zone"], "value").select("zone", "bin", (F.floor(F.col("value") * 1e6 + 0.5) / 1e6).alias("value"))


_SG = series.savgol_matrix(7, 2)
SAVGOL = PCHIP + f""", a AS (SELECT zone, list(value ORDER BY bin) AS v FROM filled GROUP BY zone), c AS (SELECT {_SG!r} AS c),
sm AS (SELECT f.zone, f.bin, list_sum(list_transform(range(1, 8), lambda j: a.v[least(greatest(f.bin - 3, 0), len(a.v) - 7) + j] * c.c[f.bin - least(greatest(f.bin - 3, 0), len(a.v) - 7) + 1][j])) AS value FROM filled f JOIN a USING (zone), c)"""


@query("savgol_smooth", f"WITH {SAVGOL} SELECT zone, bin, floor(value * 1e4 + 0.5) / 1e4 AS value FROM sm")
def savgol_smooth(spark, sf):
    return series.savgol(series.pchip(_bins(spark, sf), ["zone"], "value"), ["zone"], "value").select("zone", "bin", (F.floor(F.col("value") * 1e4 + 0.5) / 1e4).alias("value"))


def _mirror(i: str, n: str) -> str:
    """SQL: the place of i in a list of n that is mirrored at its ends, from 1."""
    m = f"((({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"(CASE WHEN {m} < {n} THEN {m} ELSE 2 * {n} - 1 - {m} END + 1)"


@query("gaussian_smooth", f"WITH {PCHIP}, a AS (SELECT zone, list(value ORDER BY bin) AS v FROM filled GROUP BY zone), c AS (SELECT {series.gaussian_kernel(1)!r} AS c) SELECT f.zone, f.bin, floor(list_sum(list_transform(range(0, 9), lambda j: c.c[j + 1] * a.v[{_mirror('f.bin + j - 4', 'len(a.v)')}])) * 1e4 + 0.5) / 1e4 AS value FROM filled f JOIN a USING (zone), c")
def gaussian_smooth(spark, sf):
    return series.gaussian(series.pchip(_bins(spark, sf), ["zone"], "value"), ["zone"], "value").select("zone", "bin", (F.floor(F.col("value") * 1e4 + 0.5) / 1e4).alias("value"))


_SPIKE = "(value < (a + b) / 2 - sd * {f} OR value > greatest(a, b) + sd * {f})"


@query("outlier_zscore", f"WITH {BINS}, z AS (SELECT zone, bin, value, lag(value) OVER w AS a, lead(value) OVER w AS b, stddev_pop(value) OVER k AS sd, (value - avg(value) OVER k) / nullif(stddev_pop(value) OVER k, 0) AS z FROM s WINDOW w AS (PARTITION BY zone ORDER BY bin), k AS (PARTITION BY zone)) SELECT zone, bin, round(CASE WHEN abs(z) > 1.2816 AND {_SPIKE.format(f=0.5)} THEN NULL ELSE value END, 10) AS value FROM z")
def outlier_zscore(spark, sf):
    return series.outliers_zscore(_bins(spark, sf), ["zone"], "value", "bin", 0.1, 0.5).select("zone", "bin", F.round("value", 10).alias("value"))


@query("outlier_median", f"""WITH {BINS}, h AS (SELECT CASE WHEN w < 3 THEN 3 WHEN w % 2 = 0 THEN w + 1 ELSE w END // 2 AS h FROM (SELECT (SELECT count(DISTINCT bin) FROM s) // 7 // (SELECT max(year(d)) - min(year(d)) + 1 FROM (SELECT (SELECT min(CAST(time AS DATE)) FROM ts) + bin * 10 AS d FROM s)) AS w)),
o AS (SELECT zone, bin, value, lag(value) OVER w AS a, lead(value) OVER w AS b, stddev_pop(value) OVER (PARTITION BY zone) AS sd FROM s WINDOW w AS (PARTITION BY zone ORDER BY bin)),
med AS (SELECT o.zone, o.bin, CASE WHEN count(n.value) = any_value(2 * h.h + 1) THEN median(n.value) END AS med FROM o, h JOIN s n ON n.zone = o.zone AND n.bin BETWEEN o.bin - h.h AND o.bin + h.h GROUP BY ALL)
SELECT zone, bin, round(CASE WHEN abs(value - coalesce(med, value)) > sd * 0.5 AND {_SPIKE.format(f=0.5)} THEN NULL ELSE value END, 10) AS value FROM o JOIN med USING (zone, bin)""")
def outlier_median(spark, sf):
    x = _bins(spark, sf)
    window = series.rolling_window_of(x, "bin", "label")
    return series.outliers_median(x, ["zone"], "value", "bin", window, 0.5).select("zone", "bin", F.round("value", 10).alias("value"))


_GRAD = """g AS (SELECT zone, bin, value AS f, lag(value) OVER w AS a, lead(value) OVER w AS b, CAST(bin - lag(bin) OVER w AS DOUBLE) AS hs, CAST(lead(bin) OVER w - bin AS DOUBLE) AS hd FROM (SELECT * FROM s WHERE value IS NOT NULL) WINDOW w AS (PARTITION BY zone ORDER BY bin))"""


@query("gradient", f"WITH {BINS}, {_GRAD} SELECT zone, bin, round(CASE WHEN hs IS NULL THEN (b - f) / hd WHEN hd IS NULL THEN (f - a) / hs ELSE (hs * hs * b + (hd * hd - hs * hs) * f - hd * hd * a) / (hs * hd * (hs + hd)) END, 13) + 0.0 AS gradient FROM g")
def gradient(spark, sf):
    x = _bins(spark, sf).where("value IS NOT NULL")
    return series.gradient(x, ["zone"], "value", "bin").select("zone", "bin", r("gradient", 13))


@query("dominant_year", f"WITH {TS}, y AS (SELECT year(time) AS y, count(*) AS n FROM ts GROUP BY 1 ORDER BY n DESC, y LIMIT 1) SELECT zone, CAST(count(*) AS BIGINT) AS n, round(avg(value), 10) AS value FROM ts WHERE year(time) = (SELECT y FROM y) GROUP BY zone")
def dominant_year(spark, sf):
    return series.dominant_year(series_view(spark, sf)).groupBy("zone").agg(F.count("*").alias("n"), F.round(F.avg("value"), 10).alias("value"))


@query("yearly_doy_split", f"WITH {TS} SELECT zone, CAST(year(time) AS INT) AS year, CAST(dayofyear(time) AS INT) AS doy, round(avg(value), 10) AS value FROM ts GROUP BY ALL")
def yearly_doy_split(spark, sf):
    return series.with_year_and_doy(series_view(spark, sf)).groupBy("zone", "year", "doy").agg(F.round(F.avg("value"), 10).alias("value"))


# --- seasons

SEASON = CLEAN + f""", nd AS (SELECT zone, {_BIN.format(t='px')} AS bin, {NDVI} AS v FROM clean), med AS (SELECT zone, bin, median(v) AS v FROM nd GROUP BY zone, bin HAVING median(v) IS NOT NULL),
ser AS (SELECT zone, CAST(year(d) AS INT) AS year, CAST(dayofyear(d) AS INT) AS doy, v FROM (SELECT zone, (SELECT min(CAST(time AS DATE)) FROM px) + bin * 10 AS d, v FROM med))"""


def _season(spark, sf):
    x = pixels.cloud_mask(pixel_view(spark, sf)).select("zone", "time", pixels.ndvi().alias("v"))
    b = series.with_bins(x, 10).groupBy("zone", "bin", "t0").agg(F.median("v").alias("v")).where("v IS NOT NULL")
    return series.with_year_and_doy(b.withColumn("d", F.expr("date_add(t0, bin * 10)")), "d").select("zone", "year", "doy", "v")


@query("valid_count_filter", f"WITH {SEASON} SELECT zone, year, CAST(count(v) AS BIGINT) AS n_obs FROM ser GROUP BY zone, year HAVING count(v) >= 25")
def valid_count_filter(spark, sf):
    return zonal.enough_observations(_season(spark, sf), ["zone", "year"], "v").select("zone", "year", "n_obs").distinct()


def _pheno_sql(method: str, factor: float = 0.05, absolute: float = 0.5) -> str:
    dist = {
        "seasonal_amplitude": ("abs(v - (aos * {f} + bse))",) * 2,
        "first_of_slope": ("v", "v"),
        "median_of_slope": ("abs(v - mu)", "abs(v - md)"),
        "absolute_value": (f"abs(v - {absolute})",) * 2,
        "relative_value": ("abs(v - ((q90 - q10) * {f} + q10))",) * 2,
    }[method]
    up, down = (x.format(f=factor) for x in dist)
    return f"""WITH {SEASON}, p0 AS (SELECT *, max(v) OVER k AS pos, min(v) OVER k AS vos, count(*) OVER k AS n, max(doy) OVER k AS last_doy, min(doy) OVER k AS first_doy, quantile_cont(v, 0.1) OVER k AS q10, quantile_cont(v, 0.9) OVER k AS q90,
 lag(v) OVER w AS pv, lead(v) OVER w AS nv, lag(doy) OVER w AS pd, lead(doy) OVER w AS nd FROM ser WINDOW k AS (PARTITION BY zone, year), w AS (PARTITION BY zone, year ORDER BY doy)),
p1 AS (SELECT *, min(doy) FILTER (v = pos) OVER k AS pos_t, min(doy) FILTER (v = vos) OVER k AS vos_t FROM p0 WINDOW k AS (PARTITION BY zone, year)),
p2 AS (SELECT *, (min(v) FILTER (doy <= pos_t) OVER k + min(v) FILTER (doy >= pos_t) OVER k) / 2 AS bse, (avg(v) FILTER (doy <= pos_t AND v >= 0.8 * pos) OVER k + avg(v) FILTER (doy >= pos_t AND v >= 0.8 * pos) OVER k) / 2 AS mos,
 CASE WHEN pd IS NULL THEN (nv - v) / (nd - doy) WHEN nd IS NULL THEN (v - pv) / (doy - pd) ELSE (pow(doy - pd, 2) * nv + (pow(nd - doy, 2) - pow(doy - pd, 2)) * v - pow(nd - doy, 2) * pv) / ((doy - pd) * (nd - doy) * (nd - pd)) END AS g FROM p1 WINDOW k AS (PARTITION BY zone, year)),
p3 AS (SELECT *, pos - bse AS aos, coalesce(doy <= pos_t AND (nd IS NULL OR nd <= pos_t) AND g > 0, false) AS up, coalesce(doy >= pos_t AND (pd IS NULL OR pd >= pos_t) AND g < 0, false) AS down FROM p2),
p4 AS (SELECT *, median(v) FILTER (up) OVER k AS mu, median(v) FILTER (down) OVER k AS md FROM p3 WINDOW k AS (PARTITION BY zone, year)),
sos AS (SELECT zone, year, doy AS sos_t, v AS sos FROM p4 WHERE up QUALIFY row_number() OVER (PARTITION BY zone, year ORDER BY {up}, doy) = 1),
eos AS (SELECT zone, year, doy AS eos_t, v AS eos FROM p4 WHERE down QUALIFY row_number() OVER (PARTITION BY zone, year ORDER BY {down}, doy) = 1),
j AS (SELECT p4.*, sos_t, sos, eos_t, eos, CASE WHEN doy IN (first_doy, last_doy) THEN 0.5 ELSE 1 END * CASE WHEN n = 1 THEN 0 ELSE 1 END AS wt FROM p4 LEFT JOIN sos USING (zone, year) LEFT JOIN eos USING (zone, year)),
mt AS (SELECT zone, year, any_value(pos) AS pos, any_value(pos_t) AS pos_t, any_value(mos) AS mos, any_value(vos) AS vos, any_value(vos_t) AS vos_t, any_value(bse) AS bse, any_value(aos) AS aos, any_value(sos) AS sos, any_value(sos_t) AS sos_t, any_value(eos) AS eos, any_value(eos_t) AS eos_t,
 any_value(last_doy) AS last_doy, any_value(n) AS n, sum(v * wt) FILTER (doy BETWEEN sos_t AND eos_t) AS li, sum(bse * wt) FILTER (doy BETWEEN sos_t AND eos_t) AS lb, sum(v * wt) AS liot FROM j GROUP BY zone, year)
SELECT zone, year, """ + ", ".join(rs(e, 4, c) for c, e in _METRICS.items()) + " FROM mt"


_METRICS = {
    "pos_values": "pos", "pos_times": "CAST(pos_t AS DOUBLE)", "mos_values": "mos", "vos_values": "vos", "vos_times": "CAST(vos_t AS DOUBLE)", "bse_values": "bse", "aos_values": "aos", "sos_values": "sos", "sos_times": "CAST(sos_t AS DOUBLE)",
    "eos_values": "eos", "eos_times": "CAST(eos_t AS DOUBLE)", "los_values": "CAST(CASE WHEN eos_t < sos_t THEN last_doy + eos_t - sos_t ELSE eos_t - sos_t END AS DOUBLE)", "roi_values": "(pos - sos) / nullif(CAST(pos_t - sos_t AS DOUBLE), 0)",
    "rod_values": "abs((eos - pos) / nullif(CAST(eos_t - pos_t AS DOUBLE), 0))", "lios_values": "CASE WHEN sos_t IS NOT NULL AND eos_t IS NOT NULL THEN coalesce(li, 0) END", "sios_values": "CASE WHEN sos_t IS NOT NULL AND eos_t IS NOT NULL THEN coalesce(li, 0) - coalesce(lb, 0) END",
    "liot_values": "liot", "siot_values": "liot - bse * (n - 1)",
}


def _pheno_query(name: str, method: str) -> None:
    @query(name, _pheno_sql(method))
    def q(spark, sf):
        m = phenology.metrics(_season(spark, sf), ["zone", "year"], "v", method=method, absolute=0.5)
        return m.select("zone", "year", *[(F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in _METRICS])


for _n, _m in (("pheno_metrics", "seasonal_amplitude"), ("pheno_first", "first_of_slope"), ("pheno_median", "median_of_slope"), ("pheno_absolute", "absolute_value"), ("pheno_relative", "relative_value")):
    _pheno_query(_n, _m)


_PEAKS = f"""WITH RECURSIVE {SEASON}, o AS (SELECT zone, year, v, row_number() OVER w - 1 AS i, lag(v) OVER w AS before FROM ser WINDOW w AS (PARTITION BY zone, year ORDER BY doy)), g AS (SELECT *, sum(CASE WHEN before = v THEN 0 ELSE 1 END) OVER (PARTITION BY zone, year ORDER BY i) AS run FROM o),
u AS (SELECT zone, year, run, any_value(v) AS v, (min(i) + max(i)) // 2 AS p FROM g GROUP BY ALL), t AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM u WINDOW w AS (PARTITION BY zone, year ORDER BY run)),
h AS (SELECT zone, year, quantile_cont(v, 0.75) AS q, CAST(ceil(count(*) / 4.0) AS BIGINT) AS d FROM ser GROUP BY ALL),
k AS (SELECT h.zone, h.year, h.d, coalesce(list({{'v': t.v, 'p': t.p}} ORDER BY t.v DESC, t.p DESC) FILTER (t.v > a AND t.v > b AND t.v >= h.q), []) AS l, 0 AS c FROM h JOIN t USING (zone, year) GROUP BY h.zone, h.year, h.d),
s AS (SELECT * FROM k UNION ALL SELECT zone, year, d, list_filter(l, lambda e: abs(e.p - l[1].p) >= d), c + 1 FROM s WHERE len(l) > 0)
SELECT zone, year, CAST(max(c) AS INT) AS num_peaks FROM s GROUP BY zone, year"""


@query("num_peaks", _PEAKS)
def num_peaks(spark, sf):
    return phenology.num_peaks(_season(spark, sf), ["zone", "year"], "v")


_CHAIN = f"""WITH {CLEAN}, kept AS (SELECT time FROM clean GROUP BY time HAVING CAST(sum({_NULLS}) AS DOUBLE) / (count(*) * 6) < 0.5), ts AS (SELECT zone, time, median({NDVI}) AS value FROM clean WHERE time IN (SELECT time FROM kept) GROUP BY zone, time), """
_CHAIN += SAVGOL.split("value FROM orders), ", 1)[1] if "value FROM orders), " in SAVGOL else SAVGOL[len(TS) + 2 :]
_CHAIN += """, ser0 AS (SELECT zone, year(d) AS year, CAST(dayofyear(d) AS INT) AS doy, value AS v FROM (SELECT zone, (SELECT min(CAST(time AS DATE)) FROM ts) + bin * 10 AS d, value FROM sm)), ser AS (SELECT * FROM ser0 WHERE v IS NOT NULL QUALIFY count(v) OVER (PARTITION BY zone, year) >= 25), p0 AS"""
_CHAIN += _pheno_sql("seasonal_amplitude").split(", p0 AS", 1)[1]


@query("season_chain", _CHAIN)
def season_chain(spark, sf):
    from .plans import season_chain as chain

    return chain(pixel_view(spark, sf)).select("zone", "year", *[(F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in _METRICS])


# --- joins

_FORCING = f"""WITH {TS}, rad AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS radiation FROM orders GROUP BY 1), met AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS rain, max(l_tax) AS tmax FROM lineitem GROUP BY 1),
e AS (SELECT day, avg(value) AS growth FROM (SELECT CAST(time AS DATE) - CAST((CAST(time AS DATE) - DATE '1992-01-01') % 8 AS INT) AS day, value FROM ts) GROUP BY day), x AS (SELECT day AS a, growth, lead(day) OVER (ORDER BY day) AS b FROM e)
SELECT rad.day, round(radiation, 7) AS srad, round(rain, 7) AS precipitation, round(tmax, 7) AS maximum, round(growth, 7) AS growth FROM rad JOIN met USING (day) LEFT JOIN x ON rad.day >= x.a AND rad.day < coalesce(x.b, x.a + 1)"""


@query("forcing_join", _FORCING)
def forcing_join(spark, sf):
    rad = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("radiation"))
    met = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("rain"), F.max("l_tax").alias("tmax"))
    e = series_view(spark, sf).withColumn("day", F.expr("date_sub(to_date(time), cast(datediff(to_date(time), date'1992-01-01') % 8 AS int))")).groupBy("day").agg(F.avg("value").alias("growth"))
    x = matching.forcing(rad, met, e, {"radiation": "srad", "rain": "precipitation", "tmax": "maximum", "growth": "growth"})
    return x.select("day", *[F.round(c, 7).alias(c) for c in ("srad", "precipitation", "maximum", "growth")])


@query("nearest_time_join", f"WITH {TS}, a AS (SELECT DISTINCT CAST(time AS DATE) AS day FROM ts), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) - CAST((CAST(l_shipdate AS DATE) - DATE '1992-01-01') % 3 AS INT) AS other FROM lineitem) SELECT day, CAST(abs(other - day) AS INT) AS gap, other FROM a JOIN b ON abs(other - day) <= 1 QUALIFY row_number() OVER (PARTITION BY day ORDER BY abs(other - day), other) = 1")
def nearest_time_join(spark, sf):
    a = series_view(spark, sf).select(F.to_date("time").alias("day")).distinct()
    b = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.expr("date_sub(to_date(l_shipdate), cast(datediff(to_date(l_shipdate), date'1992-01-01') % 3 AS int))").alias("other")).distinct()
    return matching.nearest_day(a, b, "day", "other")


@query("nearest_cell", f"WITH {GRID}, p AS (SELECT c_custkey AS k, abs(c_acctbal) % 50 AS px FROM customer) SELECT k, CAST(c AS DOUBLE) AS x FROM p, (SELECT DISTINCT x - x % 7 AS c FROM grid) QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(c - px), c) = 1")
def nearest_cell(spark, sf):
    p = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k", "abs(c_acctbal) % 50 AS px")
    return matching.nearest_cell(p, grid_view(spark, sf).selectExpr("x - x % 7 AS x"), "px", "x").select("k", "x")


@query("range_agg_coarse", f"WITH {GRID} SELECT CAST(ceil(y / 8.0) - 1 AS INT) AS cy, CAST(floor(x / 8.0) AS INT) AS cx, CASE WHEN count(v) / CAST(count(*) AS DOUBLE) > 0.1 THEN round(avg(v), 4) END AS z, round(count(v) / CAST(count(*) AS DOUBLE), 4) AS valid FROM (SELECT y, x, CASE WHEN (x + y) % 9 > 1 AND x < 40 THEN z END AS v FROM grid) GROUP BY ALL")
def range_agg_coarse(spark, sf):
    g = grid_view(spark, sf).withColumn("z", F.expr("CASE WHEN (x + y) % 9 > 1 AND x < 40 THEN z END"))
    return matching.mean_by_cell(g, 8.0, "z").select("cy", "cx", F.round("z", 4).alias("z"), F.round("valid", 4).alias("valid"))


@query("calendar_slots", f"WITH {PX}, s AS (SELECT DISTINCT zone, CAST(year(time) AS INT) AS year, CAST(dayofyear(time) AS INT) AS doy FROM px), k AS (SELECT CAST(unnest(range(0, 48)) AS INT) AS slot) SELECT zone, year, slot, doy FROM s, k QUALIFY row_number() OVER (PARTITION BY zone, year, slot ORDER BY round(abs(doy - (1 + CAST({364 / 48} AS DOUBLE) * (slot + 0.5))), 9), doy) = 1")
def calendar_slots(spark, sf):
    return matching.slots(pixel_view(spark, sf), ["zone"])


@query("ols_prior", f"WITH {PX} SELECT zone, CAST(count(*) AS BIGINT) AS n, round(regr_intercept(nir1, red), 3) AS a, round(regr_slope(nir1, red), 5) + 0.0 AS b FROM px GROUP BY zone")
def ols_prior(spark, sf):
    m = models.least_squares(pixel_view(spark, sf), ["zone"], "nir1", ["red"])
    return m.select("zone", "n", F.round(F.col("coefficients")[0], 3).alias("a"), (F.round(F.col("coefficients")[1], 5) + 0.0).alias("b"))


# --- zones

_ZONES = [("north", [(0, 20), (30, 20), (30, 39), (0, 39), (0, 20)]), ("wedge", [(5, 2), (45, 10), (20, 30), (5, 2)]), ("sliver", [(0, 0), (49, 0), (49, 0.2), (0, 0.2), (0, 0)]), ("east", [(32, 0), (49, 0), (49, 18), (32, 18), (32, 0)])]


def _zones(spark):
    return spark.createDataFrame([(n, [(float(100 * x), float(100 * y)) for x, y in ring]) for n, ring in _ZONES], "zone string, ring array<struct<x:double,y:double>>")


_Z = "z0 AS (" + " UNION ALL ".join(f"SELECT '{n}' AS zone, {i} AS e, CAST({100 * a[0]} AS DOUBLE) AS ax, CAST({100 * a[1]} AS DOUBLE) AS ay, CAST({100 * b[0]} AS DOUBLE) AS bx, CAST({100 * b[1]} AS DOUBLE) AS by_" for n, ring in _ZONES for i, (a, b) in enumerate(zip(ring[:-1], ring[1:]))) + "), zm AS (SELECT zone, abs(sum(ax * by_ - bx * ay)) / 2 AS area, sum(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2))) AS len FROM z0 GROUP BY zone), zf AS (SELECT zone, area / 10000 AS area_ha, 4 * pi() * area / pow(len, 2) AS compactness, row_number() OVER (ORDER BY area DESC, zone) AS zone_id FROM zm WHERE area / 10000 BETWEEN 5 AND 1500 AND 4 * pi() * area / pow(len, 2) >= 0.1)"


_FIELD = "100 + c_custkey % 50 * 12", "60 + c_nationkey * 30"


@query("polygon_area_filter", f"WITH z AS (SELECT CAST(c_custkey AS VARCHAR) AS zone, CAST({_FIELD[0]} AS DOUBLE) AS w, CAST({_FIELD[1]} AS DOUBLE) AS h FROM customer), m AS (SELECT zone, w * h / 10000 AS area_ha, pi() * w * h / pow(w + h, 2) AS compactness FROM z) SELECT zone, round(area_ha, 4) AS area_ha, round(compactness, 5) AS compactness, CAST(row_number() OVER (ORDER BY area_ha DESC, zone) AS INT) AS zone_id FROM m WHERE area_ha BETWEEN 5 AND 1500 AND compactness >= 0.5")
def polygon_area_filter(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("cast(c_custkey AS string) AS zone", f"cast({_FIELD[0]} AS double) AS w", f"cast({_FIELD[1]} AS double) AS h")
    ring = c.select("zone", F.expr("transform(array((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), p -> struct(p.col1 * w + 7D AS x, p.col2 * h - 3D AS y))").alias("ring"))
    return zonal.select_zones(zonal.polygon_metrics(ring), compact=0.5).select("zone", F.round("area_ha", 4).alias("area_ha"), F.round("compactness", 5).alias("compactness"), "zone_id")


@query("point_in_polygon", f"WITH {_Z}, {GRID}, p AS (SELECT y, x, 100 * x + 50.0 AS px, 100 * y + 50.0 AS py FROM grid), h AS (SELECT p.y, p.x, zf.zone_id, count(*) FILTER ((ay > py) <> (by_ > py) AND px < (bx - ax) * (py - ay) / nullif(by_ - ay, 0) + ax) AS c FROM p, zf JOIN z0 USING (zone) GROUP BY ALL) SELECT CAST(max(zone_id) AS INT) AS zone_id, y, x FROM h WHERE c % 2 = 1 GROUP BY y, x")
def point_in_polygon(spark, sf):
    zones = zonal.select_zones(zonal.polygon_metrics(_zones(spark)))
    g = grid_view(spark, sf).selectExpr("100 * y + 50D AS y", "100 * x + 50D AS x")
    return zonal.rasterise(g, zones, 800.0).selectExpr("cast((y - 50) / 100 AS int) AS y", "cast((x - 50) / 100 AS int) AS x", "zone_id")


# --- grids

_G = GRID + ", gg AS (SELECT y, x, z, CASE WHEN lag(z) OVER rw IS NULL THEN lead(z) OVER rw - z WHEN lead(z) OVER rw IS NULL THEN z - lag(z) OVER rw ELSE (lead(z) OVER rw - lag(z) OVER rw) / 2 END AS gx, CASE WHEN lag(z) OVER cl IS NULL THEN lead(z) OVER cl - z WHEN lead(z) OVER cl IS NULL THEN z - lag(z) OVER cl ELSE (lead(z) OVER cl - lag(z) OVER cl) / 2 END AS gy FROM grid WINDOW rw AS (PARTITION BY y ORDER BY x), cl AS (PARTITION BY x ORDER BY y)), sa AS (SELECT y, x, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, degrees(atan2(-gx, gy)) AS a0 FROM gg), sl AS (SELECT y, x, slope, CASE WHEN a0 < 0 THEN a0 + 360 ELSE a0 END AS aspect FROM sa)"


def _slope(spark, sf):
    g = grids.gradients(grid_view(spark, sf))
    return g.select("y", "x", grids.slope_degrees().alias("slope"), grids.aspect_degrees().alias("aspect"))


@query("slope_aspect", f"WITH {_G} SELECT y, x, round(slope, 4) AS slope, round(aspect, 4) AS aspect FROM sl")
def slope_aspect(spark, sf):
    return _slope(spark, sf).select("y", "x", F.round("slope", 4).alias("slope"), F.round("aspect", 4).alias("aspect"))


@query("twi_hli", f"WITH {_G}, t AS (SELECT y, x, slope, aspect, (1 + x) / nullif(tan(radians(slope)), 0) AS q FROM sl) SELECT y, x, round(ln(CASE WHEN q > 0 THEN q ELSE 1 END), 4) AS twi, round(least(greatest(0.339 + 0.808 * cos(radians(-33.5)) * cos(radians(slope)) - 0.196 * sin(radians(-33.5)) * sin(radians(slope)) - 0.482 * cos(radians(abs(180 - abs(aspect - 225)))) * sin(radians(slope)), 0), 1), 4) AS hli FROM t")
def twi_hli(spark, sf):
    x = _slope(spark, sf)
    return x.select("y", "x", F.round(grids.wetness((F.col("x") + 1).cast("double"), F.col("slope")), 4).alias("twi"), F.round(grids.heat_load(F.col("slope"), F.col("aspect"), -33.5), 4).alias("hli"))


@query("laplacian_stencil", f"WITH {GRID} SELECT g.y, g.x, round(4 * g.z - coalesce(a.z, 0) - coalesce(b.z, 0) - coalesce(c.z, 0) - coalesce(d.z, 0), 4) + 0.0 AS lap FROM grid g LEFT JOIN grid a ON a.y = g.y AND a.x = g.x - 1 LEFT JOIN grid b ON b.y = g.y AND b.x = g.x + 1 LEFT JOIN grid c ON c.x = g.x AND c.y = g.y - 1 LEFT JOIN grid d ON d.x = g.x AND d.y = g.y + 1")
def laplacian_stencil(spark, sf):
    return grids.laplacian(grid_view(spark, sf)).select("y", "x", r("lap", 4))


@query("regrid_mean_max", f"WITH {GRID} SELECT CAST(floor(y / 5.0) AS INT) AS y, CAST(floor(x / 5.0) AS INT) AS x, round(avg(z), 4) AS mean, round(max(z), 4) AS max FROM grid GROUP BY 1, 2")
def regrid_mean_max(spark, sf):
    return grids.regrid(grid_view(spark, sf), 5, {"mean": ("mean", "z"), "max": ("max", "z")}).select("y", "x", F.round("mean", 4).alias("mean"), F.round("max", 4).alias("max"))


@query("d8_accumulation")
def d8_accumulation(spark, sf):
    return grids.flow(grid_view(spark, sf).withColumn("area", F.lit(0)), "area")


def _blur(line: str, at: str, source: str) -> str:
    return f"(SELECT y, x, list_sum(list_transform(range(0, 17), lambda j: k.k[j + 1] * l.v[{_mirror('g.i + j - 8', 'len(l.v)')}])) AS z FROM (SELECT *, row_number() OVER (PARTITION BY {line} ORDER BY {at}) - 1 AS i FROM {source}) g JOIN (SELECT {line}, list(z ORDER BY {at}) AS v FROM {source} GROUP BY {line}) l USING ({line}), k)"


@query("gaussian_2d", f"WITH {GRID}, k AS (SELECT {series.gaussian_kernel(2.0)!r} AS k), a AS {_blur('y', 'x', 'grid')}, b AS {_blur('x', 'y', 'a')} SELECT y, x, round(z, 4) AS z FROM b")
def gaussian_2d(spark, sf):
    return grids.gaussian_2d(grid_view(spark, sf), 2.0).select("y", "x", F.round("z", 4).alias("z"))


@query("qp_downscale")
def qp_downscale(spark, sf):
    # the grid in blocks of 10 x 10, each with four coarse cells, of which one in nine has no value
    fine = grid_view(spark, sf).selectExpr("cast(floor(y / 10) * 5 + floor(x / 10) AS int) AS time", "y", "x", "z / 1000 - 1 AS prior", "cast(floor(y / 5) * 10 + floor(x / 5) AS int) AS cell")
    coarse = fine.groupBy("cell").agg(F.when(F.col("cell") % 9 != 4, F.abs(F.avg("prior"))).alias("coarse"))
    return models.downscale(fine.join(coarse, "cell")).select("time", "y", "x", F.round("theta", 4).alias("theta"), "status")


def _layer(inputs: list[str], weights, bias, relu: bool) -> list[str]:
    """SQL: the outputs of a layer of the network."""
    sums = [" + ".join([*(f"({x}) * {w[k]!r}" for x, w in zip(inputs, weights.tolist())), repr(b)]) for k, b in enumerate(bias.tolist())]
    return [f"CASE WHEN {x} < 0 THEN 0 ELSE {x} END" if relu else x for x in sums]


_MLP = ["green", "red", "nir1", "swir2", "swir3"]
_HIDDEN = _layer([R[b] for b in _MLP], *models.DEMO_WEIGHTS[0], True)
_OUT = _layer(["h0", "h1", "h2"], *models.DEMO_WEIGHTS[1], False)


@query("mlp_unmix", f"WITH {CLEAN}, h AS (SELECT zone, {', '.join(f'{x} AS h{k}' for k, x in enumerate(_HIDDEN))} FROM clean), o AS (SELECT zone, {', '.join(f'{x} AS {n}' for x, n in zip(_OUT, ('bg', 'pv', 'npv')))} FROM h) SELECT zone, round(avg(bg), 5) AS bg, round(avg(pv), 5) AS pv, round(avg(npv), 5) AS npv, CAST(count(bg) AS BIGINT) AS n FROM o GROUP BY zone")
def mlp_unmix(spark, sf):
    out = models.unmix(pixels.cloud_mask(pixel_view(spark, sf)).select("zone", *_MLP), _MLP)
    return out.groupBy("zone").agg(*[F.round(F.avg(c), 5).alias(c) for c in ("bg", "pv", "npv")], F.count("bg").alias("n"))


# --- listings


@query("tile_enumeration", "SELECT CAST(lat AS INT) AS lat, CAST(lon AS INT) AS lon, printf('%s%02d_%s%03d', CASE WHEN lat < 0 THEN 'S' ELSE 'N' END, abs(lat), CASE WHEN lon < 0 THEN 'W' ELSE 'E' END, abs(lon)) AS tile FROM (SELECT unnest(range(-34, -32)) AS lat), (SELECT unnest(range(147, 150)) AS lon)")
def tile_enumeration(spark, sf):
    return listing.tile_names(spark, 147.2, -33.6, 149.4, -32.1)


@query("sha_keys", "SELECT o_orderkey, sha256('[' || printf('%.3f', CAST(o_totalprice AS DOUBLE)) || ', ' || printf('%.3f', CAST(o_custkey AS DOUBLE)) || ']') AS place_hash, sha256(CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR)) AS time_hash FROM orders")
def sha_keys(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey", "o_totalprice", "o_custkey", "to_date(o_orderdate) AS a", "date_add(to_date(o_orderdate), 30) AS b")
    return listing.content_keys(o, ["o_totalprice", "o_custkey"], "a", "b").select("o_orderkey", "place_hash", "time_hash")


@query("registry_upsert", "WITH g AS (SELECT o_custkey % 97 AS k, min(o_orderdate) AS created, max(o_orderdate) AS last_run FROM orders GROUP BY 1), n AS (SELECT o_custkey % 101 AS k, min(o_orderdate) AS first_run, max(o_orderdate) AS run FROM orders GROUP BY 1) SELECT k, coalesce(created, first_run) AS created, CASE WHEN run IS NULL THEN last_run WHEN last_run IS NULL THEN run ELSE greatest(run, last_run) END AS last_run FROM g FULL JOIN n USING (k)")
def registry_upsert(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    g = o.groupBy(F.expr("o_custkey % 97").alias("k")).agg(F.min("o_orderdate").alias("created"), F.max("o_orderdate").alias("last_run"))
    return listing.upsert(g, o.selectExpr("o_custkey % 101 AS k", "o_orderdate AS run"), ["k"])


#: How the outputs of a run are named, most special first.
NAMING = [
    listing.Rule(r"^(.*)_report\.pdf$", "report", label="PDF report"),
    listing.Rule(r"^(.*)\.pdf$", "report"),
    listing.Rule(r"^(.*)_sentinel2_paddocks\.mp4$", "video", label="Sentinel-2 + paddocks - {variant}", variant=1),
    listing.Rule(r"^(.*)_fractional_cover_paddocks\.mp4$", "video", label="Fractional cover + paddocks - {variant}", variant=1),
    listing.Rule(r"^(.*)_sentinel2\.mp4$", "video", label="Sentinel-2 true colour"),
    listing.Rule(r"^(.*)_fractional_cover\.mp4$", "video", label="Fractional cover"),
    listing.Rule(r"^(.*)\.mp4$", "video"),
    listing.Rule(r"^(.*)_topography\.png$", "landscape", "Terrain", "Topography"),
    listing.Rule(r"^(.+)_calendar_(\d{4})_p(\d+)\.png$", "calendar", label="Calendar {2} - p{3:02}", variant=1, year=2, page=3),
    listing.Rule(r"^(.+)_phenology_p(\d+)\.png$", "phenology", label="Phenology - p{2:02}", variant=1, page=2),
    listing.Rule(r"^(.+)_silo_(.+)\.png$", "climate", "SILO", "{2:title}"),
    listing.Rule(r"^(.+)_ozwald_(?:daily|8day)_(.+)\.png$", "climate", "OzWALD", "{2:title}"),
    listing.Rule(r"^(.*)\.png$", "landscape", "Other"),
]
VARIANTS = {"sam_paddocks": "SAM"}

_NAMES = """CASE page_id % 13 WHEN 0 THEN 'sam_paddocks_' || page_id % 4 || '_calendar_' || (2015 + page_id % 10) || '_p' || lpad(CAST(page_id % 20 AS VARCHAR(9)), 2, '0') || '.png' WHEN 1 THEN 'home_fields_phenology_p' || page_id % 12 || '.png'
 WHEN 2 THEN 'farm' || page_id || '_silo_temperature_max.png' WHEN 3 THEN 'farm' || page_id || '_ozwald_daily_rain_total.png' WHEN 4 THEN 'farm' || page_id || '_sentinel2.mp4' WHEN 5 THEN 'sam_paddocks_sentinel2_paddocks.mp4' WHEN 6 THEN 'north_fractional_cover_paddocks.mp4' WHEN 7 THEN 'farm_report.pdf'
 WHEN 8 THEN 'farm_topography.png' WHEN 9 THEN 'slope' || page_id || '.png' WHEN 10 THEN 'clip' || page_id || '.mp4' WHEN 11 THEN 'notes' || page_id || '.txt' ELSE 'farm_ozwald_8day_lai.png' END"""
_STEM = "CASE WHEN name LIKE 'sam_paddocks%' THEN 'SAM' ELSE regexp_extract(name, '^(.*)_(calendar|phenology|sentinel2_paddocks|fractional_cover_paddocks)', 1) END"
_CLASS = f"""n AS (SELECT page_id, {_NAMES} AS name FROM pages WHERE page_id % 13 <> 11), c AS (SELECT page_id, name,
 CASE page_id % 13 WHEN 0 THEN 'calendar' WHEN 1 THEN 'phenology' WHEN 2 THEN 'climate' WHEN 3 THEN 'climate' WHEN 12 THEN 'climate' WHEN 7 THEN 'report' WHEN 8 THEN 'landscape' WHEN 9 THEN 'landscape' ELSE 'video' END AS category,
 CASE page_id % 13 WHEN 2 THEN 'SILO' WHEN 3 THEN 'OzWALD' WHEN 12 THEN 'OzWALD' WHEN 8 THEN 'Terrain' WHEN 9 THEN 'Other' ELSE '' END AS grp,
 CASE page_id % 13 WHEN 0 THEN 'Calendar ' || (2015 + page_id % 10) || ' - p' || lpad(CAST(page_id % 20 AS VARCHAR), 2, '0') WHEN 1 THEN 'Phenology - p' || lpad(CAST(page_id % 12 AS VARCHAR), 2, '0') WHEN 2 THEN 'Temperature Max' WHEN 3 THEN 'Rain Total' WHEN 4 THEN 'Sentinel-2 true colour'
  WHEN 5 THEN 'Sentinel-2 + paddocks - SAM' WHEN 6 THEN 'Fractional cover + paddocks - north' WHEN 7 THEN 'PDF report' WHEN 8 THEN 'Topography' WHEN 12 THEN 'Lai' ELSE name END AS label,
 CASE WHEN page_id % 13 IN (0, 1, 5, 6) THEN {_STEM} ELSE '' END AS variant, CASE WHEN page_id % 13 = 0 THEN CAST(2015 + page_id % 10 AS INT) END AS year, CASE page_id % 13 WHEN 0 THEN CAST(page_id % 20 AS INT) WHEN 1 THEN CAST(page_id % 12 AS INT) END AS page FROM n)"""


def _names(spark, sf):
    return listing.classify(spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", f"{_NAMES} AS name"), NAMING, VARIANTS)


@query("asset_classify", f"WITH {_CLASS} SELECT page_id, name, category, grp, label, variant, year, page FROM c")
def asset_classify(spark, sf):
    return _names(spark, sf)


@query("asset_variants", f"WITH {_CLASS} SELECT variant, CAST(row_number() OVER (ORDER BY min(regexp_replace(lower(name), '([0-9]+)', 'x', 'g'))) AS INT) AS ord FROM c WHERE variant <> '' GROUP BY variant")
def asset_variants(spark, sf):
    return listing.variants_in_order(_names(spark, sf))


_PADDED = "list_aggregate(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN lpad(t, 12, '0') ELSE t END), 'string_agg', '')"


@query("report_manifest", f"WITH {_CLASS}, d AS (SELECT DISTINCT name, category FROM c), s AS (SELECT * FROM (VALUES (0, 'climate'), (1, 'landscape'), (2, 'calendar'), (3, 'phenology'), (4, 'report')) s(sec, category)) SELECT CAST(sec AS INT) AS sec, CAST(row_number() OVER (PARTITION BY sec ORDER BY {_PADDED}, name) AS INT) AS ord, category AS section, name FROM d JOIN s USING (category)")
def report_manifest(spark, sf):
    return listing.manifest(_names(spark, sf).select("name", "category").distinct(), ["climate", "landscape", "calendar", "phenology", "report"])


@query("page_numbers", f"WITH {TS}, z AS (SELECT zone, time FROM ts) SELECT zone, time, CAST(floor((row_number() OVER (PARTITION BY zone ORDER BY time) - 1) / 20.0) AS INT) AS page FROM z")
def page_numbers(spark, sf):
    return matching.page_numbers(series_view(spark, sf).select("zone", "time"), ["zone"], "time", 20)


@query("status_dag", "SELECT * FROM (VALUES ('a', 'done'), ('b', 'error'), ('c', 'skipped'), ('d', 'done')) t(stage, status)")
def status_dag(spark, sf):
    from .plans import Graph, Stage

    g = Graph([Stage("a", lambda c: 1), Stage("b", lambda c: 1 / 0, ("a",)), Stage("c", lambda c: 2, ("b",)), Stage("d", lambda c: 3, ("a",))])
    g.run(raise_errors=False)
    return g.table(spark).select("stage", "status")

from . import chain_queries  # noqa: E402, F401  it adds its queries to these
