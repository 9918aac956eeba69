"""What plots and videos show, as tables: frames, label places, panels, groups of variables, month headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frame_size(height: int, width: int, least: int = 1080) -> tuple[int, int]:
    """A frame's height and width: enlarged until the longer side has `least` pixels, and even."""
    scale = max(1.0, least / max(height, width))
    return int(height * scale) // 2 * 2, int(width * scale) // 2 * 2


def frames(pixels: DataFrame, height: int, width: int, least: int = 1080) -> DataFrame:
    """time, y, x and the other columns of each pixel of the enlarged frames: that of the source cell it falls into."""
    h, w = frame_size(height, width, least)

    def covered(c: str, n: int, big: int):
        # the enlarged pixels p with floor(p * n / big) = c
        first = lambda k: F.floor((k.cast("long") * big + (n - 1)) / n)
        return F.sequence(first(F.col(c)), first(F.col(c) + 1) - 1)

    rest = [c for c in pixels.columns if c not in ("y", "x")]
    tall = pixels.select(*rest, "x", F.explode(F.transform(covered("y", height, h), lambda p: p.cast("int"))).alias("y"))
    return tall.select(*rest, "y", F.explode(F.transform(covered("x", width, w), lambda p: p.cast("int"))).alias("x"))


def label_points(zones: DataFrame, origin: tuple[float, float], cell: float, scale: float = 1.0) -> DataFrame:
    """zone, px, py: a place inside each zone in pixels of the frame: the middle of the widest stretch of the zone on the
    horizontal line through the middle of its envelope."""
    edges = "zip_with(slice(ring, 1, size(ring) - 1), slice(ring, 2, size(ring) - 1), (a, b) -> struct(a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by))"
    z = zones.withColumn("_y", F.expr("(array_min(transform(ring, p -> p.y)) + array_max(transform(ring, p -> p.y))) / 2"))
    cuts = f"array_sort(transform(filter({edges}, e -> (e.ay > _y) <> (e.by > _y)), e -> (e.bx - e.ax) * (_y - e.ay) / (e.by - e.ay) + e.ax))"
    z = z.withColumn("_c", F.expr(cuts))
    widest = F.expr("array_max(transform(sequence(0, cast(size(_c) / 2 AS int) - 1), i -> struct(_c[2 * i + 1] - _c[2 * i] AS wide, (_c[2 * i] + _c[2 * i + 1]) / 2 AS x))).x")
    return z.withColumn("_x", widest).select("zone", ((F.col("_x") - origin[0]) / cell * scale).alias("px"), ((F.lit(origin[1]) - F.col("_y")) / cell * scale).alias("py"))


def month_headings(spark: SparkSession, slots: int = 48, every: int = 4) -> DataFrame:
    """slot, month: the name that stands over every fourth of the calendar's slots."""
    return spark.range(0, slots, every).select(F.col("id").cast("int").alias("slot"), F.date_format(F.make_date(F.lit(2001), (F.floor(F.col("id") * 12 / slots) + 1).cast("int"), F.lit(1)), "MMM").alias("month"))


def season_panels(series: DataFrame, metrics: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, doy, value, kind of the points of a season's panel: sampled and interpolated ones, and start, peak and end of season."""
    points = series.select(*keys, "doy", F.col(value).cast("double").alias("value"), F.when(F.col("observed"), "sampled").otherwise("interpolated").alias("kind"))
    marks = F.explode(F.array(*[F.struct(F.col(f"{m}_times").cast("int").alias("doy"), F.col(f"{m}_values").cast("double").alias("value"), F.lit(m).alias("kind")) for m in ("sos", "pos", "eos")]))
    of = metrics.select(*keys, marks.alias("m")).select(*keys, "m.*").where("doy IS NOT NULL")
    return points.unionByName(of)


def variable_groups(df: DataFrame, day: str, groups: dict[str, list[str]]) -> DataFrame:
    """grp, variable, day, value: the variables of each group that df has, one row a day and variable."""
    parts = [F.struct(F.lit(g).alias("grp"), F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for g, vs in groups.items() for v in vs if v in df.columns]
    if not parts:
        raise ValueError("no variable of any group is there")
    return df.select(day, F.explode(F.array(*parts)).alias("p")).select("p.grp", "p.variable", day, "p.value")
