"""Pixel operators: cloud mask, scene filter, reflectance and spectral indices. Missing data is NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = ["blue", "green", "red", "nir1", "swir2", "swir3"]
CLOUD_CODES = (2, 3)


def non_finite_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def cloud_mask(df: DataFrame, bands: list[str] = BANDS, mask: str = "fmask", codes: tuple[int, ...] = CLOUD_CODES) -> DataFrame:
    """Bands are NULL where the mask has one of the codes; the mask column goes."""
    clear = ~F.col(mask).isin(*codes)
    return df.withColumns({b: F.when(clear, F.col(b)) for b in bands}).drop(mask)


def scene_null_fraction(df: DataFrame, bands: list[str] = BANDS, time: str = "time") -> DataFrame:
    """time, null_fraction, n_pixels of each scene, in one pass."""
    nulls = sum((F.col(b).isNull().cast("int") for b in bands), F.lit(0))
    return df.groupBy(time).agg((F.sum(nulls) / (F.count("*") * len(bands))).alias("null_fraction"), F.count("*").alias("n_pixels"))


def keep_clear_scenes(df: DataFrame, bands: list[str] = BANDS, most: float = 0.5, time: str = "time") -> DataFrame:
    """Scenes whose share of missing band values is below `most` (strictly)."""
    kept = scene_null_fraction(df, bands, time).where(F.col("null_fraction") < most).select(time)
    return df.join(kept, time, "left_semi")


def reflectance(band: str) -> Column:
    """0 is missing; the rest is scaled by 10000, as double."""
    return F.nullif(F.col(band).cast("double"), F.lit(0.0)) / F.lit(10000.0)


def normalised_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def ndvi() -> Column:
    return normalised_difference(reflectance("nir1"), reflectance("red"))


def cfi() -> Column:
    return ndvi() * (reflectance("red") + 2 * reflectance("green") - reflectance("blue"))


def nirv() -> Column:
    return ndvi() * reflectance("nir1")


def ndti() -> Column:
    return normalised_difference(reflectance("swir2"), reflectance("swir3"))


def cai() -> Column:
    return 0.5 * (reflectance("swir2") + reflectance("swir3")) - reflectance("nir1")


def ndwi() -> Column:
    return normalised_difference(reflectance("green"), reflectance("nir1"))


def evi() -> Column:
    n, r, b = (reflectance(x) for x in ("nir1", "red", "blue"))
    return F.try_divide(2.5 * (n - r), n + 6 * r - 7.5 * b + 1)


def mavi() -> Column:
    n, r, s = (reflectance(x) for x in ("nir1", "red", "swir2"))
    return F.try_divide(n - r, n + r + s)


INDICES: dict[str, Callable[[], Column]] = {"ndvi": ndvi, "cfi": cfi, "nirv": nirv, "ndti": ndti, "cai": cai}
ALL_INDICES = INDICES | {"ndwi": ndwi, "evi": evi, "mavi": mavi}


def with_indices(df: DataFrame, indices: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    return df.withColumns({name: f() for name, f in (indices or INDICES).items()})


def index_named(name: str) -> Column:
    if name not in ALL_INDICES:
        raise ValueError(f"unknown index {name!r}; have {sorted(ALL_INDICES)}")
    return ALL_INDICES[name]()


def to_uint8(df: DataFrame, band: str, by: list[str]) -> DataFrame:
    """band_u8: the band from its least to its greatest value in the group, on 0..255, truncated; constant, empty or missing: 0."""
    low, high = F.min(band).over(Window.partitionBy(*by)), F.max(band).over(Window.partitionBy(*by))
    scaled = F.try_divide(F.col(band) - low, (high - low).cast("double"))
    return df.withColumn(f"{band}_u8", F.coalesce(F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) * 255), F.lit(0)).cast("int"))


def true_colour(band: str, gain: float = 3.0) -> Column:
    return F.coalesce(F.least(F.greatest(reflectance(band) * gain, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def cover_colour(part: str, parts: list[str]) -> Column:
    """A part of the sum of all parts (1e-6 at least), on 0..1; missing: 0."""
    total = F.greatest(sum((F.col(p) for p in parts), F.lit(0.0)), F.lit(1e-6))
    return F.coalesce(F.least(F.greatest(F.col(part) / total, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def fourier_means(array: str, n: int = 3, step: int = 5) -> list[Column]:
    """The mean magnitude of the discrete Fourier transform in bins 1 + step k to step (k + 1) - 1, for each k < n."""
    size = f"size({array})"

    def magnitude(f: str) -> str:
        part = lambda fn: f"aggregate(transform({array}, (v, t) -> cast(v AS double) * {fn}(2 * pi() * {f} * t / {size})), 0D, (a, b) -> a + b)"
        return f"sqrt(pow({part('cos')}, 2) + pow({part('sin')}, 2))"

    out = []
    for k in range(n):
        a, b = 1 + step * k, step * (k + 1) - 1
        bins = f"filter(sequence({a}, {b}), f -> f < {size})"
        out.append(F.expr(f"aggregate({bins}, 0D, (s, f) -> s + {magnitude('f')}) / nullif(size({bins}), 0)"))
    return out


def presegment(df: DataFrame, by: list[str], time: str = "time", n: int = 3) -> DataFrame:
    """by, u0, u1, ...: the image that zones are drawn on. Each pixel's water index is filled forward in time, what is missing
    before becomes the mean of the filled values, and the bands are the mean magnitudes of its Fourier transform, each scaled
    to 0..255 over the whole image. Pixels without any value are 0."""
    rows = df.select(*by, time, ndwi().alias("v"))
    x = rows.groupBy(*by).agg(F.expr(f"transform(array_sort(collect_list(struct({time}, v))), r -> r.v)").alias("_s"))
    x = x.withColumn("_s", F.expr("slice(aggregate(_s, array(cast(NULL AS double)), (s, r) -> concat(s, array(coalesce(r, element_at(s, -1))))), 2, size(_s))"))
    mean = "(aggregate(filter(_s, r -> r IS NOT NULL), 0D, (s, r) -> s + r) / size(filter(_s, r -> r IS NOT NULL)))"
    x = x.withColumn("_s", F.expr(f"CASE WHEN exists(_s, r -> r IS NOT NULL) THEN transform(_s, r -> coalesce(r, {mean})) END"))
    bands = x.select(*by, *[c.alias(f"b{k}") for k, c in enumerate(fourier_means("_s", n))])
    span = bands.agg(*[f(f"b{k}").alias(f"{name}{k}") for k in range(n) for name, f in (("lo", F.min), ("hi", F.max))])
    scaled = [F.coalesce(F.floor(F.try_divide(F.col(f"b{k}") - F.col(f"lo{k}"), F.col(f"hi{k}") - F.col(f"lo{k}")) * 255), F.lit(0)).cast("int").alias(f"u{k}") for k in range(n)]
    return bands.join(F.broadcast(span)).select(*by, *scaled)


def three_bands(df: DataFrame, bands: list[str]) -> DataFrame:
    """The bands as three, for an image: one is repeated, of two the first comes again, more are cut."""
    chosen = {1: bands * 3, 2: [*bands, bands[0]] if len(bands) > 1 else bands}.get(len(bands), bands[:3])
    return df.select(*[c for c in df.columns if c not in bands], *[F.col(c).alias(f"band{i + 1}") for i, c in enumerate(chosen)])
