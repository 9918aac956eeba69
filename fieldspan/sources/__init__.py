"""Sources: tables of scenes, pixels, climate and zones, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pixel_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic pixel observations over lineitem: time, zone, pixel, six bands as digital numbers, fmask."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_shipdate AS time", "cast(l_suppkey % 12 AS int) AS zone", "cast(l_partkey % 50 AS int) AS pixel", "cast(l_linenumber * 300 AS int) AS blue", "cast((l_partkey % 37) * 40 AS int) AS green",
        "cast(round(l_quantity * 60) AS int) AS red", "cast(round(l_extendedprice / 10) AS int) AS nir1", "cast(round(l_discount * 10000) AS int) AS swir2", "cast(round(l_tax * 10000) AS int) AS swir3",
        "CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE CASE WHEN l_linenumber = 7 THEN 3 ELSE 0 END END AS fmask",
    )


def series_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse series over orders: zone, time, value."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("cast(o_custkey % 240 AS int) AS zone", "o_orderdate AS time", "o_totalprice / 100000 AS value")


def grid_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An elevation grid over part: y, x, z."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("cast(floor(p_partkey / 50) AS int) AS y", "cast(p_partkey % 50 AS int) AS x", "p_retailprice AS z")


def scenes(manifest: DataFrame, west: float, south: float, east: float, north: float, start: str, end: str, cloud: float = 30) -> DataFrame:
    """Rows (scene, west, south, east, north, time, cloud) of a scene manifest that meet the box and the dates, with less cloud. None: an error."""
    found = manifest.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)).where(F.to_date("time").between(start, end) & (F.col("cloud") < cloud))
    if found.isEmpty():
        raise RuntimeError("no scene meets the request")
    return found


def solar_day(time: str, longitude: float) -> Column:
    return F.to_date(F.expr(f"{time} + make_interval(0, 0, 0, 0, 0, 0, {longitude / 15 * 3600:.3f})"))


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """Pixel Parquet; unreadable files count as missing."""
    return spark.read.option("ignoreCorruptFiles", True).parquet(path)


def by_solar_day(cube: DataFrame, bands: list[str], longitude: float) -> DataFrame:
    """One value a day and pixel: the first scene's that has one."""
    day = cube.withColumn("day", solar_day("time", longitude))
    return day.groupBy("day", "y", "x").agg(*[F.min(F.when(F.col(b).isNotNull(), F.struct("time", b)))[b].alias(b) for b in bands])


def read_climate_csv(spark: SparkSession, path: str, day: str, schema: str) -> DataFrame:
    """A daily table; source, metadata and place columns go."""
    df = spark.read.csv(path, header=True, schema=schema)
    gone = [c for c in df.columns if c.endswith("_source") or c in ("metadata", "latitude", "longitude")]
    return df.drop(*gone).withColumn(day, F.to_date(day))


def read_geojson(spark: SparkSession, path: str, label: str | None = None, degrees: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """zone, ring of each polygon of a GeoJSON file (multipolygons exploded); without a label zones are numbered. The format's
    coordinates are degrees; of a file in metres, degrees(x, y) gives longitude and latitude."""
    if not path.endswith((".json", ".geojson")):
        raise ValueError("only .json and .geojson can be read without further libraries")
    props = f", properties: struct<`{label}`: string>" if label else ""
    kind = f"features array<struct<geometry: struct<type: string, coordinates: string>{props}>>"
    rows = spark.read.schema(kind).json(path, multiLine=True).select(F.posexplode("features").alias("n", "f"))
    one, many = F.from_json("f.geometry.coordinates", "array<array<array<double>>>"), F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(one)).when(F.col("f.geometry.type") == "MultiPolygon", many)
    name = F.col(f"f.properties.`{label}`") if label else (F.col("n") + 1).cast("string")
    parts = rows.select(name.alias("zone"), F.explode(polygons).alias("p"))
    at = degrees or (lambda x, y: (x, y))
    return parts.select("zone", F.transform(F.col("p")[0], lambda c: F.struct(*[v.alias(n) for n, v in zip("xy", at(c[0], c[1]), strict=True)])).alias("ring"))


def read_years(spark: SparkSession, path: str, variables: list[str], years: range, point: tuple[float, float]) -> DataFrame:
    """lat, lon, time and the variables at the grid cell nearest to point (lat, lon), from one Parquet file a variable and year
    named {variable}_{year}.parquet with columns lat, lon, time, value; the years follow each other."""
    from fieldspan.operators.tables import union_chunks

    out = None
    for v in variables:
        cube = union_chunks(*[spark.read.parquet(f"{path}/{v}_{y}.parquet") for y in years])
        near = lambda c, x: F.struct(F.abs(F.col(c) - x).alias("d"), F.col(c))
        at = cube.agg(F.min(near("lat", point[0]))["lat"].alias("lat"), F.min(near("lon", point[1]))["lon"].alias("lon"))
        one = cube.join(F.broadcast(at), ["lat", "lon"]).select("lat", "lon", "time", F.col("value").alias(v))
        out = one if out is None else out.join(one.drop("lat", "lon"), "time", "full_outer")
    return out


def read_days(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Daily rasters one after the other; days whose file can't be read are left out, and no day at all is an error."""
    from fieldspan.operators.tables import union_chunks

    found = []
    for p in paths:
        try:
            found.append(spark.read.parquet(p))
        except AnalysisException:
            continue
    return union_chunks(*found)


def window_of(raster: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """The cells (cy, cx) of a raster table in a box; the bounds reach the scan. No cell: an error."""
    found = raster.where(F.col("cx").between(west, east) & F.col("cy").between(south, north))
    if found.isEmpty():
        raise RuntimeError("the raster has no cell in the box")
    return found


def first_variable(df: DataFrame, keys: tuple[str, ...] = ("time", "y", "x"), apart: tuple[str, ...] = ("spatial_ref",)) -> str:
    """The first column that is neither a key nor a reference to the projection."""
    return next(c for c in df.columns if c not in keys and c not in apart)
