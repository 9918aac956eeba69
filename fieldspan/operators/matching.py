"""Joins by nearness and by range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_day(left: DataFrame, right: DataFrame, day: str, right_day: str, most: int = 1) -> DataFrame:
    """Each row of left with the nearest row of right within `most` days, of equally near ones the earlier.

    Days within reach are exploded, so this is an equi-join; the nearest is kept by an aggregate, not a sort."""
    asked = left.select(F.col(day)).distinct().select(day, F.explode(F.sequence(F.date_sub(day, most), F.date_add(day, most))).alias(right_day))
    best = asked.join(right, right_day).groupBy(day).agg(F.min(F.struct(F.abs(F.datediff(right_day, day)).alias("gap"), F.col(right_day), *[c for c in right.columns if c != right_day])).alias("r"))
    return left.join(best, day).select(*left.columns, "r.*")


def nearest_cell(points: DataFrame, axis: DataFrame, point: str, cell: str) -> DataFrame:
    """Each point with the nearest value of an axis (a raster's rows or columns), of equally near ones the first.

    The axis, as long as a raster's side, is one sorted array; each point halves it until two neighbours are left."""
    values = axis.agg(F.array_sort(F.collect_set(F.col(cell).cast("double"))).alias("_axis"))
    below = F.expr(f"""aggregate(sequence(0, cast(ceil(log2(greatest(size(_axis), 2))) AS int)), named_struct('a', 0, 'b', size(_axis) - 1),
        (s, k) -> CASE WHEN s.a >= s.b THEN s WHEN _axis[cast((s.a + s.b + 1) div 2 AS int)] <= {point} THEN named_struct('a', cast((s.a + s.b + 1) div 2 AS int), 'b', s.b) ELSE named_struct('a', s.a, 'b', cast((s.a + s.b + 1) div 2 AS int) - 1) END).a""")
    near = F.expr(f"CASE WHEN _below + 1 < size(_axis) AND abs(get(_axis, _below + 1) - {point}) < abs(get(_axis, _below) - {point}) THEN get(_axis, _below + 1) ELSE get(_axis, _below) END")
    return points.join(F.broadcast(values)).withColumn("_below", below).withColumn(cell, near).drop("_axis", "_below")


def mean_by_cell(fine: DataFrame, size: float, value: str, least_valid: float = 0.1) -> DataFrame:
    """Means of a fine grid over square cells of `size`; cells in which too few fine pixels have a value are NULL.

    Cell (i, j) holds x in [i size, (i + 1) size) and y in (j size, (j + 1) size]: half-open, as in the range join
    it stands for."""
    cells = fine.withColumns({"cx": F.floor(F.col("x") / size).cast("int"), "cy": (F.ceil(F.col("y") / size) - 1).cast("int")})
    share = F.count(value) / F.count("*")
    return cells.groupBy("cy", "cx").agg(F.when(share > least_valid, F.avg(value)).alias(value), share.alias("valid"))


def slots(df: DataFrame, keys: list[str], n: int = 48) -> DataFrame:
    """keys, year, slot, doy of the nearest observation: n slots a year, centred between n + 1 even marks on days 1 to 365."""
    step = 364.0 / n
    seen = df.select(*keys, F.year("time").alias("year"), F.dayofyear("time").alias("doy")).distinct()
    listed = seen.groupBy(*keys, "year").agg(F.array_sort(F.collect_set("doy")).alias("days"))
    centre = f"(1 + {step} * (slot + 0.5))"
    near = F.expr(f"array_min(transform(days, d -> named_struct('gap', round(abs(d - {centre}), 9), 'doy', d))).doy")
    return listed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*keys, "year", "slot", near.alias("doy"))


def forcing(radiation: DataFrame, daily: DataFrame, eight_day: DataFrame, names: dict[str, str], day: str = "day") -> DataFrame:
    """Radiation joined with daily weather on the day, and, where there is one, the last 8-day row; renamed and ordered by names."""
    from .series import daily_forward_fill

    filled = daily_forward_fill(eight_day, [c for c in eight_day.columns if c != day], day)
    return radiation.join(daily, day).join(filled, day, "left").select(day, *[F.col(a).alias(b) for a, b in names.items()])


def page_numbers(df: DataFrame, by: list[str], order: str, size: int) -> DataFrame:
    return df.withColumn("page", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / size).cast("int"))
