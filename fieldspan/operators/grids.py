"""Operators on rasters as rows (y, x, z)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def gradients(grid: DataFrame, z: str = "z", dx: float = 1.0, dy: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """gx, gy: central differences, one-sided at edges. `by` splits a large raster into rows and columns of tiles."""
    by = by or []
    row, col = Window.partitionBy(*by, "y").orderBy("x"), Window.partitionBy(*by, "x").orderBy("y")

    def diff(w: Window, d: float) -> Column:
        a, b, c = F.lag(z).over(w), F.lead(z).over(w), F.col(z)
        return F.when(a.isNull(), (b - c) / d).when(b.isNull(), (c - a) / d).otherwise((b - a) / (2 * d))

    return grid.withColumns({"gx": diff(row, dx), "gy": diff(col, dy)})


def slope_degrees() -> Column:
    return F.degrees(F.atan(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)))


def aspect_degrees() -> Column:
    a = F.degrees(F.atan2(-F.col("gx"), F.col("gy")))
    return F.when(a < 0, a + 360).otherwise(a)


def wetness(accumulation: Column, slope: Column) -> Column:
    """ln(accumulation / tan(slope)); where that ratio isn't positive or the slope is flat, 0."""
    ratio = F.try_divide(accumulation, F.tan(F.radians(slope)))
    return F.log(F.when(ratio > 0, ratio).otherwise(F.lit(1.0)))


def heat_load(slope: Column, aspect: Column, latitude: float) -> Column:
    """McCune and Keon's heat load (their equation 3) with the aspect folded about the south-west line, on 0..1."""
    s, lat = F.radians(slope), math.radians(latitude)
    fold = F.radians(F.abs(180 - F.abs(aspect - 225)))
    value = 0.339 + 0.808 * math.cos(lat) * F.cos(s) - 0.196 * math.sin(lat) * F.sin(s) - 0.482 * F.cos(fold) * F.sin(s)
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def laplacian(grid: DataFrame, z: str = "z") -> DataFrame:
    """y, x, lap: four times a cell less its neighbours that exist (the diagonal stays 4 at borders)."""
    row, col = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    near = lambda w, c, f: F.when(F.abs(f(c).over(w) - F.col(c)) == 1, f(z).over(w)).otherwise(F.lit(0.0))
    total = near(row, "x", F.lag) + near(row, "x", F.lead) + near(col, "y", F.lag) + near(col, "y", F.lead)
    return grid.select("y", "x", (4 * F.col(z) - total).alias("lap"))


def gaussian_2d(grid: DataFrame, sigma: float = 10.0, z: str = "z", truncate: float = 4.0) -> DataFrame:
    """A separable Gaussian: along rows, then along columns, borders mirrored, by one sorted window each."""
    from .series import gaussian_kernel, mirrored

    k = gaussian_kernel(sigma, truncate)
    return mirrored(mirrored(grid, ["y"], z, "x", k), ["x"], z, "y", k)


def mosaic(tiles: DataFrame, order: str = "tile", z: str = "z") -> DataFrame:
    """One value a cell: that of the first tile that has one."""
    return tiles.where(F.col(z).isNotNull()).groupBy("y", "x").agg(F.min_by(z, order).alias(z))


_REDUCERS = {"mean": F.avg, "max": F.max, "min": F.min, "median": F.median}


def regrid(fine: DataFrame, factor: int, values: dict[str, tuple[str, str]]) -> DataFrame:
    """y, x and a column for each of values (name: how, column): blocks of factor x factor cells, in one pass. `how` is a
    reducer, or nearest: the cell that holds the block's middle (of an even factor, the one after it)."""
    middle = (F.col("y") % factor == factor // 2) & (F.col("x") % factor == factor // 2)
    agg = {n: F.max(F.when(middle, F.col(c))) if how == "nearest" else _REDUCERS[how](c) for n, (how, c) in values.items()}
    return fine.groupBy(F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(*[c.alias(n) for n, c in agg.items()])


def bilinear(grid: DataFrame, points: DataFrame, z: str = "z", y: str = "py", x: str = "px") -> DataFrame:
    """points with z interpolated between the four cells (y, x: whole numbers at cell centres) around (py, px). Cells that are
    missing or NULL leave their weight to the others; with none of weight z is NULL. Four equi-joined rows a point."""
    at = points.withColumns({"_id": F.monotonically_increasing_id(), "_y": F.floor(y), "_x": F.floor(x)})
    corners = F.explode(F.array(*[F.struct((F.col("_y") + i).alias("y"), (F.col("_x") + j).alias("x"), ((F.abs(1 - i - (F.col(y) - F.col("_y")))) * F.abs(1 - j - (F.col(x) - F.col("_x")))).alias("w")) for i in (0, 1) for j in (0, 1)]))
    parts = at.select(*points.columns, "_id", corners.alias("c")).where("c.w > 0")
    cells = grid.select(F.col("y").cast("long").alias("_cy"), F.col("x").cast("long").alias("_cx"), F.col(z).cast("double").alias("_z"))
    found = parts.join(cells, (F.col("c.y") == F.col("_cy")) & (F.col("c.x") == F.col("_cx")), "left")
    weight = F.when(F.col("_z").isNotNull(), F.col("c.w"))
    return found.groupBy("_id", *points.columns).agg(F.try_divide(F.sum(weight * F.col("_z")), F.sum(weight)).alias(z)).drop("_id")


def match_raster(source: DataFrame, target: DataFrame, origin: tuple[float, float], size: float, z: str = "z", how: str = "bilinear") -> DataFrame:
    """target (cy, cx: coordinates of cell centres) with z of the source, a raster of square cells whose cell (0, 0) has its
    centre at origin (x, y), y falling with the row. nearest takes the nearer cell, of equally near ones the next."""
    if how not in ("bilinear", "nearest"):
        raise ValueError("how must be bilinear or nearest")
    p = target.withColumns({"py": (F.lit(origin[1]) - F.col("cy")) / size, "px": (F.col("cx") - F.lit(origin[0])) / size})
    if how == "bilinear":
        return bilinear(source, p, z).drop("py", "px")
    cells = source.select(F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"), F.col(z))
    return p.withColumns({"_y": F.floor(F.col("py") + 0.5), "_x": F.floor(F.col("px") + 0.5)}).join(cells, ["_y", "_x"], "left").drop("py", "px", "_y", "_x")


def cells_over(spark: SparkSession, west: float, south: float, east: float, north: float, size: float) -> DataFrame:
    """cy, cx: the centres of the square cells of a raster that covers a box from its north-western corner."""
    nx, ny = math.ceil((east - west) / size), math.ceil((north - south) / size)
    rows = spark.range(ny).select((F.lit(north) - (F.col("id") + 0.5) * size).alias("cy"))
    return rows.select("cy", F.explode(F.transform(F.sequence(F.lit(0), F.lit(nx - 1)), lambda i: F.lit(west) + (i + 0.5) * size)).alias("cx"))


def to_coarse(source: DataFrame, box: tuple[float, float, float, float], origin: tuple[float, float], step: float, size: float = 1000.0, buffer: int = 2, z: str = "z") -> DataFrame:
    """cy, cx, z: the source (whose cell (0, 0) has its centre at origin, `step` apart) on cells of `size` over the box (west,
    south, east, north) and `buffer` cells around it, by the nearest source cell."""
    west, south, east, north = box
    wide = buffer * size
    target = cells_over(source.sparkSession, west - wide, south - wide, east + wide, north + wide, size)
    return match_raster(source, target, origin, step, z, "nearest")


def direction_number(code: Column) -> Column:
    """1 to 8 for the direction codes 1, 2, 4, ... 128; 0 for anything else."""
    power = (code > 0) & (code <= 128) & (F.bit_count(code.cast("int")) == 1)
    return F.when(power, F.round(F.log2(code.cast("double"))).cast("int") + 1).otherwise(0)


def clip(grid: DataFrame, west: float, south: float, east: float, north: float, buffer: float = 0.0, y: str = "cy", x: str = "cx") -> DataFrame:
    """Cells in a box that is widened by buffer on every side."""
    return grid.where(F.col(x).between(west - buffer, east + buffer) & F.col(y).between(south - buffer, north + buffer))


def without_border(grid: DataFrame, width: int = 1) -> DataFrame:
    """The raster without its outermost rows and columns."""
    box = grid.agg(F.min("y").alias("_a"), F.max("y").alias("_b"), F.min("x").alias("_c"), F.max("x").alias("_d"))
    inside = F.col("y").between(F.col("_a") + width, F.col("_b") - width) & F.col("x").between(F.col("_c") + width, F.col("_d") - width)
    return grid.join(F.broadcast(box)).where(inside).drop("_a", "_b", "_c", "_d")


def mask_windows(mask: DataFrame, by: str, height: int, width: int, pad: int = 2) -> DataFrame:
    """by, y0, y1, x0, x1: the rows and columns (ends excluded) that hold each zone's pixels, padded and kept inside the raster."""
    low = lambda c: F.greatest(F.min(c) - pad, F.lit(0)).cast("int")
    high = lambda c, n: F.least(F.max(c) + pad + 1, F.lit(n)).cast("int")
    return mask.groupBy(by).agg(low("y").alias("y0"), high("y", height).alias("y1"), low("x").alias("x0"), high("x", width).alias("x1"))


def flow(grid: DataFrame, by: str, z: str = "z") -> DataFrame:
    """by, y, x, direction, accumulation of each raster (one per value of `by`): depressions are filled by
    priority flood from the border, each cell drains to the neighbour it was flooded from, and the cells that
    drain through a cell, itself included, are counted. A raster is one group: flow has no local answer."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy() - pdf["y"].min() + 1, pdf["x"].to_numpy() - pdf["x"].min() + 1
        wide = int(x.max()) + 2
        at = y * wide + x  # a ring of missing cells is around the raster
        z = np.full(wide * (int(y.max()) + 2), np.nan)
        z[at] = pdf["z"].to_numpy()
        there = np.zeros(len(z), bool)
        there[at] = True
        steps = [1, wide + 1, wide, wide - 1, -1, -wide - 1, -wide, -wide + 1]
        edge = at[~np.logical_and.reduce([there[at + d] for d in steps])]
        heap = list(zip(z[edge].tolist(), edge.tolist(), strict=True))
        heapq.heapify(heap)
        seen, to = ~there, np.zeros(len(z), np.int64)
        seen[edge] = True
        way, order, height, open_ = np.zeros(len(z), np.int32), [], z.tolist(), (~seen).tolist()
        while heap:
            h, c = heapq.heappop(heap)
            order.append(c)
            for k, d in enumerate(steps):
                n = c + d
                if open_[n]:
                    open_[n] = False
                    to[n], way[n] = c, (k + 4) % 8 + 1
                    heapq.heappush(heap, (h if h > height[n] else height[n], n))
        total = [1] * len(z)
        back, flows = to.tolist(), (way > 0).tolist()
        for c in reversed(order):
            if flows[c]:
                total[back[c]] += total[c]
        c = np.array(order, np.int64)
        return pd.DataFrame({by: pdf[by].iloc[0], "y": c // wide - 1 + pdf["y"].min(), "x": c % wide - 1 + pdf["x"].min(), "direction": way[c], "accumulation": np.array(total, np.int64)[c]})

    g = grid.select(by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(z).cast("double").alias("z"))
    return g.groupBy(by).applyInPandas(run, f"{by} {grid.schema[by].dataType.simpleString()}, y int, x int, direction int, accumulation long")
