"""Requests, cached stages and the stage graph."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Request:
    """A box (west, south, east, north) and dates; its keys name what is stored for it."""

    bbox: tuple[float, float, float, float]
    start: date
    end: date
    root: str = "."
    stub: str = ""

    @classmethod
    def around(cls, lat: float, lon: float, km: float, start: date, end: date, **rest) -> Request:
        import math

        a, b = km / 111, km / (111 * math.cos(math.radians(lat)))
        return cls((lon - b, lat - a, lon + b, lat + a), start, end, **rest)

    @property
    def centre(self) -> tuple[float, float]:
        w, s, e, n = self.bbox
        return (s + n) / 2, (w + e) / 2

    @property
    def place_hash(self) -> str:
        return hashlib.sha256(str([round(c, 3) for c in self.bbox]).encode()).hexdigest()

    @property
    def time_hash(self) -> str:
        return hashlib.sha256(f"{self.start}{self.end}".encode()).hexdigest()

    @property
    def name(self) -> str:
        return self.stub or hashlib.sha256(f"{list(self.bbox)}{self.start}{self.end}".encode()).hexdigest()

    def path(self, stage: str) -> str:
        return f"{self.root}/{self.place_hash[:16]}/{self.time_hash[:16]}/{stage}"


#: Where a stage's success marker lies: in its folder, beside its only file, or nowhere (that it exists is enough).
INSIDE, BESIDE, NONE = "/_SUCCESS", "._SUCCESS", ""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, store = _path(spark, path)
    return store.exists(p)


def is_complete(spark: SparkSession, path: str, marker: str = INSIDE) -> bool:
    """Whether a stage's data and its success marker are there."""
    return exists(spark, path) and exists(spark, path + marker)


def mark(spark: SparkSession, path: str) -> None:
    """Puts the marker of a single file beside it."""
    p, store = _path(spark, path + BESIDE)
    store.create(p, True).close()


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes stages and their markers, so that they are built again."""
    for path in paths:
        for x in (path, path + BESIDE):
            p, store = _path(spark, x)
            store.delete(p, True)


def write_csv(df: DataFrame, path: str, first: list[str] | None = None) -> None:
    """A folder of CSV with a header, in as many parts as df has; `first` are the leading columns."""
    first = first or []
    df.select(*first, *[c for c in df.columns if c not in first]).write.mode("overwrite").csv(path, header=True)


def write_geojson(zones: DataFrame, path: str) -> None:
    """zone, ring and further columns as newline-delimited GeoJSON features."""
    rest = [c for c in zones.columns if c != "ring"]
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), shape.alias("geometry"))
    zones.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def cached_csv(spark: SparkSession, path: str, schema: str, build: Callable[[], DataFrame], reload: bool = False) -> DataFrame:
    """A CSV that is built unless it exists; it has no marker."""
    if reload or not is_complete(spark, path, NONE):
        write_csv(build(), path)
    return spark.read.csv(path, header=True, schema=schema)


def read_settings(path: str, known: tuple[str, ...] = ()) -> dict:
    """A JSON file of settings; an unknown one is an error, a missing file has none."""
    if not os.path.exists(path):
        return {}
    with open(path) as f:
        out = json.load(f)
    if known and (odd := set(out) - set(known)):
        raise ValueError(f"unknown settings: {sorted(odd)}")
    return out


class Registry:
    """The requests that were run, as a JSON file on the driver, under a lock.

    A request is known by its place and dates. Running a known one again only moves its last run on; a name that stands
    for other dates or another place is an error."""

    def __init__(self, path: str):
        self.path = path

    def register(self, request: Request, now: str) -> dict:
        with self._locked():
            known = read_settings(self.path)
            entry = known.get(request.name)
            want = {"place": request.place_hash, "time": request.time_hash}
            if entry and any(entry[k] != v for k, v in want.items()):
                raise ValueError(f"{request.name!r} already stands for another place or other dates")
            known[request.name] = want | {"created": entry["created"] if entry else now, "last_run": now}
            with open(self.path + ".new", "w") as f:
                json.dump(known, f, indent=1)
            os.replace(self.path + ".new", self.path)
            return known[request.name]

    def entries(self) -> dict:
        return read_settings(self.path)

    @contextmanager
    def _locked(self):
        with open(self.path + ".lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], reload: bool = False, partition_by: list[str] | None = None) -> DataFrame:
    """The stage at path, built anew if it is incomplete or can't be read."""
    if not reload and is_complete(spark, path):
        try:
            return spark.read.parquet(path)
        except Exception:  # noqa: BLE001  a marker without readable data: build it again
            pass
    w = build().write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.parquet(path)


@dataclass
class Stage:
    name: str
    run: Callable[[dict], object]
    needs: tuple[str, ...] = ()


@dataclass
class Graph:
    """Runs stages in order; one whose need failed or was skipped is skipped, the rest go on; the first error is raised at the end."""

    stages: list[Stage]
    status: dict[str, str] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    def run(self, context: dict | None = None, raise_errors: bool = True) -> dict:
        context, first = context if context is not None else {}, None
        for s in self.stages:
            if any(self.status.get(n) in ("error", "skipped") for n in s.needs):
                self.status[s.name] = "skipped"
                continue
            began = time.monotonic()
            try:
                context[s.name] = s.run(context)
                self.status[s.name] = "done"
            except Exception as e:  # noqa: BLE001  collected, raised below
                self.status[s.name], first = "error", first or e
            self.seconds[s.name] = time.monotonic() - began
        if first and raise_errors:
            raise first
        return context

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.name, self.status.get(s.name, "waiting"), float(self.seconds.get(s.name, 0))) for s in self.stages], "stage string, status string, seconds double")


def season_chain(pixels: DataFrame, days: int = 10, value: str = "ndvi", least: int = 25) -> DataFrame:
    """Pixels to season metrics: cloud mask, scene filter, index, zonal median, bins, gaps filled, smoothed, years, metrics."""
    from fieldspan.operators import phenology, pixels as px, series, zonal

    clean = px.keep_clear_scenes(px.cloud_mask(pixels))
    medians = zonal.zonal_median(clean.select("zone", "time", px.index_named(value).alias(value)), ["zone", "time"], [value])
    binned = series.resample(medians, ["zone"], [value], days)
    smooth = series.savgol(series.pchip(binned, ["zone"], value), ["zone"], value)
    yearly = series.with_year_and_doy(smooth, "label")
    kept = zonal.enough_observations(yearly, ["year", "zone"], value, least)
    return phenology.metrics(kept, ["year", "zone"], value)
