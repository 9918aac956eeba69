"""Choosing, naming and joining columns and rows of field tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_missing(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds those of the columns that df doesn't have."""
    return df.withColumns({n: c for n, c in columns.items() if n not in df.columns})


def choose_values(df: DataFrame, keys: list[str], wanted: list[str] | None = None, unwanted: tuple[str, ...] = ()) -> DataFrame:
    """The keys and the numeric columns among the wanted (all, if None) that aren't unwanted; a wanted one that df lacks is an error."""
    numeric = [f.name for f in df.schema.fields if f.name not in keys and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    if wanted is not None and (gone := [c for c in wanted if c not in df.columns]):
        raise ValueError(f"no such columns: {gone}")
    return df.select(*keys, *[c for c in numeric if (wanted is None or c in wanted) and c not in unwanted])


def rename_bands(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames the bands that df has; two that would get one name are an error."""
    out = [names.get(c, c) for c in df.columns]
    if len(set(out)) < len(out):
        raise ValueError("two columns would have one name")
    return df.toDF(*out)


def first_given(*sources: Column) -> Column:
    return F.coalesce(*sources)


def join_by_label(left: DataFrame, right: DataFrame, label: str, how: str = "left") -> DataFrame:
    """Joins on the label's text, so that 7 meets '7'."""
    return left.withColumn(label, F.col(label).cast("string")).join(right.withColumn(label, F.col(label).cast("string")), label, how)


def shared_keys(key: str, *tables: DataFrame) -> DataFrame:
    """The distinct values of key that every table has."""
    return reduce(lambda a, b: a.intersect(b), [t.select(key) for t in tables])


def union_chunks(*chunks: DataFrame) -> DataFrame:
    """Chunks one after the other, by column name; columns that a chunk lacks are NULL. None: an error."""
    if not chunks:
        raise RuntimeError("no chunk could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chunks)


def between_days(df: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Rows of the days from start to end, both included."""
    return df.where(F.to_date(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def daily_mean(cube: DataFrame, value: str, day: str = "time") -> DataFrame:
    """The mean over all places of each day."""
    return cube.groupBy(day).agg(F.avg(value).alias(value), F.count(value).alias("n"))
