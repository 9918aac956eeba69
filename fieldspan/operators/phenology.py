"""Season metrics of one series a (key, year): rows (keys, doy, v).

All metrics come from window aggregates over one partitioning, so a series is shuffled once. A sample's slope
side is decided before its gradient is taken: the peak's own gradient is missing unless it is the first or
last sample. A series without values has NULL metrics. Missing start or end of season stays NULL, and so does
what depends on it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("seasonal_amplitude", "first_of_slope", "median_of_slope", "absolute_value", "relative_value", "stl_trend")
PEAKS, BASES = ("pos", "mos"), ("bse", "vos")


def _first_at(value: str, wanted: str) -> Column:
    """The (doy, v) with the least `value`, of equal ones the earliest, among rows where `wanted` holds."""
    return F.min(F.expr(f"CASE WHEN {wanted} THEN named_struct('d', {value}, 'doy', doy, 'v', v) END"))


def metrics(df: DataFrame, keys: list[str], value: str, peak: str = "pos", base: str = "bse", method: str = "seasonal_amplitude", factor: float = 0.05, sides: str = "two_sided", absolute: float = 0.0) -> DataFrame:
    if peak not in PEAKS or base not in BASES or method not in METHODS or sides not in ("one_sided", "two_sided"):
        raise ValueError("unknown peak, base, method or sides")
    all_ = Window.partitionBy(*keys)
    w = all_.orderBy("doy")
    x = df.select(*keys, F.col("doy").cast("int").alias("doy"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    if method == "stl_trend":
        x = with_trend(x, keys)
    x = x.withColumns({
        "pos": F.max("v").over(all_), "vos": F.min("v").over(all_),
        "pos_t": F.min(F.expr("named_struct('d', -v, 'doy', doy)")).over(all_)["doy"],
        "vos_t": F.min(F.expr("named_struct('d', v, 'doy', doy)")).over(all_)["doy"],
        "first_doy": F.min("doy").over(all_), "last_doy": F.max("doy").over(all_), "n": F.count("*").over(all_),
        "q10": F.percentile("v", 0.1).over(all_), "q90": F.percentile("v", 0.9).over(all_),
        "pv": F.lag("v").over(w), "nv": F.lead("v").over(w), "pd": F.lag("doy").over(w), "nd": F.lead("doy").over(w),
    })
    on = lambda c, v="v": F.expr(f"CASE WHEN {c} THEN {v} END")
    x = x.withColumns({
        "low_l": F.min(on("doy <= pos_t")).over(all_), "low_r": F.min(on("doy >= pos_t")).over(all_),
        "top_l": F.avg(on("doy <= pos_t AND v >= 0.8 * pos")).over(all_), "top_r": F.avg(on("doy >= pos_t AND v >= 0.8 * pos")).over(all_),
    })
    x = x.withColumns({"bse": F.expr("(low_l + low_r) / 2"), "mos": F.expr("(top_l + top_r) / 2")}).withColumns({"peak": F.col(peak), "base": F.col(base)})
    x = x.withColumn("aos", F.expr("peak - base"))
    grad = """CASE WHEN pd IS NULL THEN (nv - v) / (nd - doy) WHEN nd IS NULL THEN (v - pv) / (doy - pd)
      ELSE (pow(doy - pd, 2) * nv + (pow(nd - doy, 2) - pow(doy - pd, 2)) * v - pow(nd - doy, 2) * pv) / ((doy - pd) * (nd - doy) * (nd - pd)) END"""
    # which neighbours a sample's gradient uses must lie on its own side of the peak
    left = "doy <= pos_t AND (CASE WHEN nd IS NULL THEN true ELSE nd <= pos_t END)"
    right = "doy >= pos_t AND (CASE WHEN pd IS NULL THEN true ELSE pd >= pos_t END)"
    x = x.withColumn("g", F.expr(grad)).withColumns({"up": F.expr(f"coalesce({left} AND g > 0, false)"), "down": F.expr(f"coalesce({right} AND g < 0, false)")})
    x = x.withColumns({"mid_up": F.median(on("up")).over(all_), "mid_down": F.median(on("down")).over(all_)})

    def distance(side: str) -> str:
        low = {"up": "low_l", "down": "low_r"}[side] if sides == "one_sided" else "base"
        return {
            "seasonal_amplitude": f"abs(v - (aos * {factor} + {low}))",
            "first_of_slope": "v",
            "median_of_slope": f"abs(v - mid_{side})",
            "absolute_value": f"abs(v - {absolute})",
            "relative_value": f"abs(v - ((q90 - q10) * {factor} + q10))",
            "stl_trend": "abs(v - trend)",
        }[method]

    x = x.withColumns({"s": _first_at(distance("up"), "up").over(all_), "e": _first_at(distance("down"), "down").over(all_)})
    x = x.withColumn("inside", F.expr("CASE WHEN s.doy IS NOT NULL AND e.doy IS NOT NULL THEN doy >= s.doy AND doy <= e.doy END"))
    ends = F.expr("CASE WHEN doy = first_doy OR doy = last_doy THEN 0.5 ELSE 1.0 END")  # weights of the trapezoid rule with step 1
    weight = F.expr("CASE WHEN n = 1 THEN 0.0 ELSE 1.0 END") * ends
    one = lambda c: F.first(c).alias(c)
    m = x.groupBy(*keys).agg(
        one("pos"), one("pos_t"), one("vos"), one("vos_t"), one("bse"), one("mos"), one("aos"), one("peak"), one("base"), one("last_doy"), one("n"),
        F.first("s.doy").alias("sos_t"), F.first("s.v").alias("sos"), F.first("e.doy").alias("eos_t"), F.first("e.v").alias("eos"),
        F.sum(F.when(F.col("inside"), F.col("v") * weight)).alias("li"), F.sum(F.when(F.col("inside"), F.col("base") * weight)).alias("lb"),
        F.max("inside").alias("any"), F.sum(F.col("v") * weight).alias("liot"),
    )
    return m.select(
        *keys, F.col("pos").alias("pos_values"), F.col("pos_t").alias("pos_times"), F.col("mos").alias("mos_values"), F.col("vos").alias("vos_values"), F.col("vos_t").alias("vos_times"),
        F.col("bse").alias("bse_values"), F.col("aos").alias("aos_values"), F.col("sos").alias("sos_values"), F.col("sos_t").alias("sos_times"), F.col("eos").alias("eos_values"), F.col("eos_t").alias("eos_times"),
        F.expr("CASE WHEN eos_t < sos_t THEN last_doy + eos_t - sos_t ELSE eos_t - sos_t END").alias("los_values"),
        F.expr("try_divide(peak - sos, cast(pos_t - sos_t AS double))").alias("roi_values"), F.expr("abs(try_divide(eos - peak, cast(eos_t - pos_t AS double)))").alias("rod_values"),
        F.expr("CASE WHEN any IS NOT NULL THEN coalesce(li, 0D) END").alias("lios_values"), F.expr("CASE WHEN any IS NOT NULL THEN coalesce(li, 0D) - coalesce(lb, 0D) END").alias("sios_values"),
        F.col("liot").alias("liot_values"), F.expr("liot - base * (n - 1)").alias("siot_values"),
    )


def find_peaks(v: list[float], height: float, distance: int) -> list[int]:
    """Places of strict local maxima (middle of a plateau, ends excluded) of at least `height`; the highest
    stand, others nearer than `distance` to a standing one fall."""
    found, i, n = [], 1, len(v)
    while i < n - 1:
        if v[i] > v[i - 1]:
            j = i
            while j < n - 1 and v[j + 1] == v[i]:
                j += 1
            if j < n - 1 and v[j + 1] < v[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    found = [p for p in found if v[p] >= height]
    stand: dict[int, bool] = dict.fromkeys(found, True)
    for p in sorted(found, key=lambda p: (v[p], p), reverse=True):
        if stand[p]:
            for q in found:
                if q != p and abs(q - p) < distance:
                    stand[q] = False
    return [p for p in found if stand[p]]


def num_peaks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, num_peaks: seasons of each series: peaks of the upper quartile, at least a quarter of the series apart."""
    lists = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("doy", F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("s"), F.percentile(value, 0.75).alias("q"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["num_peaks"] = [len(find_peaks(s.tolist(), q, -(-len(s) // 4))) for s, q in zip(b["s"], b["q"], strict=True)]
            yield b[[*keys, "num_peaks"]]

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return lists.mapInPandas(count, f"{kinds}, num_peaks int")


def season_table(series: DataFrame, keys: list[str], value: str, **how) -> DataFrame:
    """The metrics of each series and num_peaks, as one row."""
    return metrics(series, keys, value, **how).join(num_peaks(series, keys, value), keys, "left")


def mean_peaks(seasons: DataFrame, by: list[str]) -> DataFrame:
    """How many series there are, and their mean number of peaks."""
    return seasons.groupBy(*by).agg(F.count("*").alias("n_series"), F.avg("num_peaks").alias("mean_peaks"))


def with_trend(df: DataFrame, keys: list[str]) -> DataFrame:
    """df (keys, doy, v) with trend: a season is one group of at most a year's samples."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doy")
        return pdf.assign(trend=stl_trend(pdf["v"].to_numpy()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, trend double")


def stl_trend(v, period: int | None = None, seasonal: int = 7):
    """The trend of a non-robust STL decomposition (inner loops of LOESS) of a numpy series."""
    import numpy as np

    n = len(v)
    period = period or n - 1 + n % 2
    window = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    window += 1 - window % 2
    t = np.arange(n, dtype=float)

    def loess(x, y, q):
        out = np.empty(len(x))
        for i, x0 in enumerate(x):
            d = np.abs(x - x0)
            h = np.sort(d)[min(q, len(x)) - 1] * max(1.0, q / len(x)) or 1.0
            wts = np.clip(1 - (d / h) ** 3, 0, None) ** 3
            sw, sx = wts.sum(), (wts * (x - x0)).sum()
            sxx, sy, sxy = (wts * (x - x0) ** 2).sum(), (wts * y).sum(), (wts * (x - x0) * y).sum()
            det = sw * sxx - sx * sx
            out[i] = (sxx * sy - sx * sxy) / det if det > 1e-12 else sy / sw
        return out

    trend = np.zeros(n)
    for _ in range(2):
        detrended = v - trend
        cycle = np.empty(n)
        for k in range(min(period, n)):
            at = np.arange(k, n, period)
            cycle[at] = loess(t[at], detrended[at], seasonal) if len(at) > 1 else detrended[at]
        low = loess(t, cycle, period + 1 - period % 2)
        trend = loess(t, v - (cycle - low), window)
    return trend
