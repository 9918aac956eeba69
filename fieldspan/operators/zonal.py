"""Zones: pixels by polygon, exact medians by zone, polygon measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zonal_median(df: DataFrame, keys: list[str], values: list[str], count: str | None = None) -> DataFrame:
    """The exact median of each value by key; NULLs don't count, and a group without values is NULL. count: a column for the rows."""
    return df.groupBy(*keys).agg(*[F.median(v).alias(v) for v in values], *([F.count("*").alias(count)] if count else []))


def in_zones(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """The pixels (y, x) that a mask (y, x, zone_id) holds, each with its zone. A mask is one scene's size against all its
    times; whether it is broadcast is for the planner to decide by its size."""
    return pixels.join(mask.select("y", "x", "zone_id"), ["y", "x"])


def zonal_series(cube: DataFrame, mask: DataFrame, values: list[str], time: str = "time") -> DataFrame:
    """zone_id, time and the median of each value over a zone's pixels."""
    return zonal_median(in_zones(cube, mask), ["zone_id", time], values)


def enough_observations(df: DataFrame, keys: list[str], value: str, least: int = 25) -> DataFrame:
    kept = df.groupBy(*keys).agg(F.count(value).alias("n_obs")).where(F.col("n_obs") >= least)
    return df.join(kept, keys)


_EDGES = "zip_with(slice(ring, 1, size(ring) - 1), slice(ring, 2, size(ring) - 1), (a, b) -> struct(a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by))"


def polygon_metrics(zones: DataFrame) -> DataFrame:
    """area_ha and compactness (4 pi A / L^2) of zones with ring: array<struct<x, y>> in metres, closed."""
    area = f"abs(aggregate({_EDGES}, 0D, (s, e) -> s + e.ax * e.by - e.bx * e.ay)) / 2"
    length = f"aggregate({_EDGES}, 0D, (s, e) -> s + sqrt(pow(e.bx - e.ax, 2) + pow(e.by - e.ay, 2)))"
    return zones.withColumns({"area_ha": F.expr(f"({area}) / 10000"), "compactness": F.expr(f"4 * pi() * ({area}) / nullif(pow({length}, 2), 0)")})


def select_zones(zones: DataFrame, least_ha: float = 5, most_ha: float = 1500, compact: float = 0.1) -> DataFrame:
    """Zones of fit size and shape, numbered from the largest."""
    kept = zones.where(F.col("area_ha").between(least_ha, most_ha) & (F.col("compactness") >= compact))
    # zones are few against pixels; their order is global by nature
    return kept.withColumn("zone_id", F.row_number().over(Window.orderBy(F.desc("area_ha"), "zone")))


def rasterise(pixels: DataFrame, zones: DataFrame, cell: float = 16.0) -> DataFrame:
    """y, x, zone_id of pixels whose centre lies in a zone; where zones overlap the last one wins.

    Zones are cut into square cells of their envelopes, and pixels meet them by cell (an equi-join), so a
    pixel is only tested against zones near it."""
    box = zones.withColumns({f"{f.__name__}_{c}": f(F.expr(f"transform(ring, p -> p.{c})")) for f in (F.array_min, F.array_max) for c in ("x", "y")})
    cells = lambda c: F.explode(F.sequence(F.floor(F.col(f"array_min_{c}") / cell), F.floor(F.col(f"array_max_{c}") / cell)))
    parts = box.select("zone_id", "ring", cells("x").alias("cx"), "array_min_y", "array_max_y").select("zone_id", "ring", "cx", cells("y").alias("cy"))
    p = pixels.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    inside = F.expr(f"aggregate({_EDGES}, false, (odd, e) -> CASE WHEN (e.ay > y) <> (e.by > y) AND x < (e.bx - e.ax) * (y - e.ay) / (e.by - e.ay) + e.ax THEN NOT odd ELSE odd END)")
    return p.join(parts, ["cx", "cy"]).where(inside).groupBy("y", "x").agg(F.max("zone_id").alias("zone_id"))


def envelope(zones: DataFrame) -> DataFrame:
    p = zones.select(F.explode("ring").alias("p"))
    return p.agg(F.min("p.x").alias("west"), F.min("p.y").alias("south"), F.max("p.x").alias("east"), F.max("p.y").alias("north"))


def label_ids(df: DataFrame, label: str, order: str) -> DataFrame:
    """label, id: ids 1.. in the order in which labels first appear."""
    first = df.groupBy(F.col(label).cast("string").alias(label)).agg(F.min(order).alias("_o"))
    return first.withColumn("id", F.row_number().over(Window.orderBy("_o"))).drop("_o")
