"""Streams of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def observations(spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def binned(stream: DataFrame, keys: list[str], value: str, days: int = 10, origin: str = "1970-01-01", time: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts, sums and means in tumbling bins of days that start at origin; rows later than `late` are left out."""
    at = F.window(F.col(time).cast("timestamp"), f"{days} days", startTime=f"{(_days(origin) % days)} days")
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(at.alias("bin"), *keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def _days(day: str) -> int:
    from datetime import date

    return (date.fromisoformat(day) - date(1970, 1, 1)).days
