"""Operators on time series: one row a (key, time), NULL where nothing was observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_bins(df: DataFrame, days: int, time: str = "time") -> DataFrame:
    """bin: whole periods of `days` since midnight of the first time of all series."""
    first = df.agg(F.min(F.to_date(time)).alias("t0"))
    return df.join(F.broadcast(first)).withColumn("bin", F.floor(F.datediff(time, "t0") / days).cast("int"))


def resample(df: DataFrame, keys: list[str], values: list[str], days: int = 10, time: str = "time") -> DataFrame:
    """keys, bin, label, the median of each value, observed: every bin from the first to the last of all, for every key."""
    binned = with_bins(df, days, time)
    found = binned.groupBy(*keys, "bin").agg(*[F.median(v).alias(v) for v in values])
    span = binned.agg(F.min("t0").alias("t0"), F.max("bin").alias("n"))
    spine = df.select(*keys).distinct().join(F.broadcast(span)).select(*keys, "t0", F.explode(F.sequence(F.lit(0), "n")).alias("bin"))
    observed = F.coalesce(*[F.col(v) for v in values]).isNotNull()
    return spine.join(found, [*keys, "bin"], "left").withColumn("label", F.expr(f"date_add(t0, bin * {days})")).withColumn("observed", observed).drop("t0")


def period_end(time: str, period: str) -> Column:
    """The last day of the period that a time lies in: '1M', or '1W' (weeks end on Sunday)."""
    if period == "1M":
        return F.last_day(time)
    if period == "1W":
        return F.date_add(F.to_date(F.date_trunc("week", time)), 6)
    raise ValueError("period must be 1W or 1M; 2W comes from resample(days=14)")


def resample_calendar(df: DataFrame, keys: list[str], value: str, period: str = "1M", reducer: str = "mean", time: str = "time") -> DataFrame:
    agg = {"mean": F.avg, "median": F.median, "sum": F.sum}[reducer]
    return df.groupBy(*keys, period_end(time, period).alias("label")).agg(agg(value).alias(value))


def month_sum(df: DataFrame, keys: list[str], value: str, time: str = "time") -> DataFrame:
    """Sums by month end; months without rows between the first and last of all have 0."""
    sums = resample_calendar(df, keys, value, "1M", "sum", time)
    span = sums.agg(F.min("label").alias("a"), F.max("label").alias("b"))
    months = F.expr("transform(sequence(trunc(a, 'month'), trunc(b, 'month'), interval 1 month), d -> last_day(d))")
    spine = df.select(*keys).distinct().join(F.broadcast(span)).select(*keys, F.explode(months).alias("label"))
    return spine.join(sums, [*keys, "label"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def climatology(df: DataFrame, keys: list[str], value: str, by: str = "month", reducer: str = "median", time: str = "time", year: int | None = None) -> DataFrame:
    """The mean or median of each month or week over all years; with a year, also `label`, its day in that year."""
    if by not in ("month", "week"):
        raise ValueError("by must be month or week")
    part = {"month": F.month, "week": F.weekofyear}[by](time)
    out = df.groupBy(*keys, part.alias(by)).agg({"mean": F.avg, "median": F.median}[reducer](value).alias(value))
    if year is None:
        return out
    first = F.make_date(F.lit(year), F.lit(1), F.lit(1))
    return out.withColumn("label", F.make_date(F.lit(year), F.col(by), F.lit(1)) if by == "month" else F.date_add(first, (F.col(by) - 1) * 7))


def _over(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def forward_fill(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.withColumn(value, F.last(value, ignorenulls=True).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def complete(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Forward fill; what is missing before the first value becomes the mean of the filled series."""
    return forward_fill(df, keys, value, order).withColumn(value, F.coalesce(value, F.avg(value).over(Window.partitionBy(*keys))))


#: Another name under which the completion fill is asked for.
fast_fill = complete


def daily_forward_fill(df: DataFrame, values: list[str], day: str = "day") -> DataFrame:
    """Every day from the first to the last of df; values stay until the next."""
    spine = df.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias(day))
    ahead = F.lead(day).over(Window.orderBy(day))
    # each row stands for the days until the next one
    held = df.select(day, *values).withColumn("_to", F.coalesce(F.date_sub(ahead, 1), F.col(day)))
    filled = held.select(F.explode(F.sequence(day, "_to")).alias(day), *values)
    return spine.join(filled, day, "left")


def interpolate_linear(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Straight lines between neighbours in terms of `order` (a number); nothing outside."""
    before, after = _over(keys, order).rowsBetween(Window.unboundedPreceding, 0), _over(keys, order).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    x0, y0 = F.last(at, ignorenulls=True).over(before), F.last(value, ignorenulls=True).over(before)
    x1, y1 = F.first(at, ignorenulls=True).over(after), F.first(value, ignorenulls=True).over(after)
    return df.withColumns({"_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1}).withColumn(
        value, F.coalesce(value, F.col("_y0") + (F.col("_y1") - F.col("_y0")) * F.try_divide(F.col(order) - F.col("_x0"), (F.col("_x1") - F.col("_x0")).cast("double")))
    ).drop("_x0", "_y0", "_x1", "_y1")


def pchip(df: DataFrame, keys: list[str], value: str, order: str = "bin") -> DataFrame:
    """Monotone cubic interpolation (Fritsch-Butland slopes) at every row; the end cubics go on outside. One
    knot: that value; none: NULL."""
    w = _over(keys, order)
    knots = df.where(F.col(value).isNotNull()).select(*keys, F.col(order).cast("double").alias("x"), F.col(value).cast("double").alias("y"))
    wk = _over(keys, "x")
    k = knots.withColumns({"h": F.lead("x").over(wk) - F.col("x"), "d": (F.lead("y").over(wk) - F.col("y")) / (F.lead("x").over(wk) - F.col("x"))})
    k = k.withColumns({"hp": F.lag("h").over(wk), "dp": F.lag("d").over(wk), "hn": F.lead("h").over(wk), "dn": F.lead("d").over(wk), "hpp": F.lag("h", 2).over(wk), "dpp": F.lag("d", 2).over(wk), "n": F.count("*").over(Window.partitionBy(*keys))})

    def end(h0: str, d0: str, h1: str, d1: str) -> str:
        raw = f"((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1})"
        return f"CASE WHEN n = 2 THEN {d0} WHEN sign({raw}) <> sign({d0}) THEN 0D WHEN sign({d0}) <> sign({d1}) AND abs({raw}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {raw} END"

    inner = "CASE WHEN dp * d <= 0 THEN 0D ELSE ((2 * h + hp) + (h + 2 * hp)) / ((2 * h + hp) / dp + (h + 2 * hp) / d) END"
    slope = F.expr(f"CASE WHEN n = 1 THEN 0D WHEN dp IS NULL THEN {end('h', 'd', 'hn', 'dn')} WHEN d IS NULL THEN {end('hp', 'dp', 'hpp', 'dpp')} ELSE {inner} END")
    k = k.withColumn("s", slope)
    seg = F.when(F.col("n") == 1, F.struct("x", "y", "s", F.lit(1.0).alias("h"), F.col("y").alias("y1"), F.lit(0.0).alias("s1")))
    seg = seg.when(F.col("h").isNotNull(), F.struct("x", "y", "s", "h", F.lead("y").over(wk).alias("y1"), F.lead("s").over(wk).alias("s1")))
    seg = seg.otherwise(F.struct(F.lag("x").over(wk).alias("x"), F.lag("y").over(wk).alias("y"), F.lag("s").over(wk).alias("s"), F.col("hp").alias("h"), F.col("y").alias("y1"), F.col("s").alias("s1")))
    k = k.select(*keys, F.col("x").cast(df.schema[order].dataType).alias(order), seg.alias("g"))
    j = df.join(k, [*keys, order], "left")
    g = F.coalesce(F.last("g", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("g", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    t = f"(({order} - g.x) / g.h)"
    cubic = f"g.y * (1 + 2 * {t}) * pow(1 - {t}, 2) + g.h * g.s * {t} * pow(1 - {t}, 2) + g.y1 * pow({t}, 2) * (3 - 2 * {t}) + g.h * g.s1 * pow({t}, 2) * ({t} - 1)"
    return j.withColumn("g", g).withColumn(value, F.expr(cubic)).drop("g")


def savgol_matrix(window: int, order: int) -> list[list[float]]:
    """Row i has the weights that a least-squares polynomial over the window gives its i-th place."""
    import numpy as np

    v = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return (v @ np.linalg.pinv(v)).tolist()


def savgol(df: DataFrame, keys: list[str], value: str, order: str = "bin", window: int = 7, degree: int = 2) -> DataFrame:
    """Savitzky-Golay smoothing; the ends take the polynomial of the first or last window. Series shorter than the window are an error in the data, and become NULL."""
    window += (window + 1) % 2
    if window <= degree:
        raise ValueError("the window must be longer than the degree")
    reach = window - 1
    near = _near(keys, order, reach)
    x = df.withColumns({"_v": F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))).over(near), "_i": F.row_number().over(_over(keys, order)) - 1, "_n": F.count("*").over(Window.partitionBy(*keys)), "_w": F.array(*[F.lit(x) for row in savgol_matrix(window, degree) for x in row])})
    # the window's first row in the series; _v begins `reach` rows before the row itself, or with the series
    start = f"least(greatest(_i - {window // 2}, 0), _n - {window})"
    total = " + ".join(f"_v[{start} - greatest(_i - {reach}, 0) + {j}] * _w[(_i - ({start})) * {window} + {j}]" for j in range(window))
    return x.withColumn(value, F.expr(f"CASE WHEN _n >= {window} THEN nullif({total}, double('NaN')) END")).drop("_v", "_i", "_n", "_w")


def _near(keys: list[str], order: str, reach: int) -> Window:
    """Rows at most `reach` away, so that no row carries its whole series."""
    return _over(keys, order).rowsBetween(-reach, reach)


def mirrored(df: DataFrame, keys: list[str], value: str, order: str, kernel: list[float]) -> DataFrame:
    """The series weighed by a symmetric kernel, mirrored at its ends; rows whose weighing takes in a missing value are NULL."""
    r = len(kernel) // 2
    x = df.withColumns({"_v": F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))).over(_near(keys, order, r)), "_i": F.row_number().over(_over(keys, order)) - 1, "_n": F.count("*").over(Window.partitionBy(*keys)), "_k": F.array(*[F.lit(x) for x in kernel])})
    place = f"pmod(_i + j - {r}, 2 * _n)"
    at = f"(CASE WHEN {place} < _n THEN {place} ELSE 2 * _n - 1 - {place} END) - greatest(_i - {r}, 0)"
    total = f"aggregate(sequence(0, {2 * r}), 0D, (s, j) -> s + _k[j] * _v[cast({at} AS int)])"
    return x.withColumn(value, F.expr(f"nullif({total}, double('NaN'))")).drop("_v", "_i", "_n", "_k")


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    import math

    r = int(truncate * sigma + 0.5)
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(k) for x in k]


def gaussian(df: DataFrame, keys: list[str], value: str, order: str = "bin", sigma: int = 1) -> DataFrame:
    """Gaussian smoothing by a kernel of four sigmas, the series mirrored at its ends."""
    return mirrored(df, keys, value, order, gaussian_kernel(sigma))


def gradient(df: DataFrame, keys: list[str], value: str, order: str, name: str = "gradient") -> DataFrame:
    """Central differences on uneven steps, one-sided at the ends; NULL if a value used is NULL."""
    w = _over(keys, order)
    f, a, b = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    x, xa, xb = F.col(order), F.lag(order).over(w), F.lead(order).over(w)
    hs, hd = (x - xa).cast("double"), (xb - x).cast("double")
    inner = (hs * hs * b + (hd * hd - hs * hs) * f - hd * hd * a) / (hs * hd * (hs + hd))
    return df.withColumn(name, F.when(xa.isNull(), (b - f) / hd).when(xb.isNull(), (f - a) / hs).otherwise(inner))


#: Two-sided critical values of the normal distribution by p-value, as accepted for z-scores.
CRITICAL = {0.01: 2.3263, 0.05: 1.6449, 0.1: 1.2816}


def _without_spikes(df: DataFrame, keys: list[str], value: str, order: str, far: Column, factor: float) -> DataFrame:
    """Rows that are `far` off and also spikes become NULL: below the mean of both neighbours, or above the larger one, by more
    than the series' deviation times the factor. A value that its neighbours share is no spike, however far off it is."""
    w = _over(keys, order)
    limit = F.stddev_pop(value).over(Window.partitionBy(*keys)) * factor
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    spike = F.coalesce(F.col(value) < (a + b) / 2 - limit, F.lit(False)) | F.coalesce(F.col(value) > F.greatest(a, b) + limit, F.lit(False))
    return df.withColumn(value, F.when(~(F.coalesce(far, F.lit(False)) & spike), F.col(value)))


def outliers_zscore(df: DataFrame, keys: list[str], value: str, order: str, p: float = 0.05, factor: float = 2.0) -> DataFrame:
    """Spikes whose z-score is beyond the critical value of p become NULL."""
    if p not in CRITICAL:
        raise ValueError(f"p must be one of {sorted(CRITICAL)}")
    w = Window.partitionBy(*keys)
    z = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))
    return _without_spikes(df, keys, value, order, F.abs(z) > CRITICAL[p], factor)


def rolling_window(times: int, years: int) -> int:
    """The length of the rolling median for so many times over so many calendar years: odd, and three at least."""
    w = times // 7 // max(years, 1)
    return 3 if w < 3 else w + (w + 1) % 2


def rolling_window_of(df: DataFrame, order: str, time: str) -> int:
    """rolling_window for the times of df; one row is brought to the driver."""
    r = df.agg(F.countDistinct(order).alias("n"), (F.max(F.year(time)) - F.min(F.year(time)) + 1).alias("years")).first()
    return rolling_window(r["n"], r["years"] or 1)


def outliers_median(df: DataFrame, keys: list[str], value: str, order: str, window: int = 3, factor: float = 2.0) -> DataFrame:
    """Spikes that are further from the rolling median than the series' deviation times the factor become NULL. Where the window
    isn't full, the median is the value itself."""
    half = window // 2
    band = _over(keys, order).rowsBetween(-half, half)
    middle = F.when(F.count(value).over(band) == 2 * half + 1, F.percentile(value, 0.5).over(band)).otherwise(F.col(value))
    limit = F.stddev_pop(value).over(Window.partitionBy(*keys)) * factor
    return _without_spikes(df, keys, value, order, F.abs(F.col(value) - middle) > limit, factor)


def to_year_end(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """The last day of each series moves to December 31, if it lies in December before that."""
    last = F.max(day).over(Window.partitionBy(*keys))
    late = (F.col(day) == last) & (F.month(day) == 12) & (F.dayofmonth(day) < 31)
    return df.withColumn(day, F.when(late, F.make_date(F.year(day), F.lit(12), F.lit(31))).otherwise(F.col(day)))


def middle_year(df: DataFrame, time: str) -> int:
    """The middle of the years of df, of two the earlier."""
    r = df.agg(F.min(F.year(time)).alias("a"), F.max(F.year(time)).alias("b")).first()
    return (r["a"] + r["b"]) // 2


def dominant_year(df: DataFrame, time: str = "time", strict: bool = False) -> DataFrame:
    """The year with most rows; `strict`: the first year, as a known quirk has it."""
    y = F.year(time)
    order = [F.col("y")] if strict else [F.desc("n"), F.col("y")]
    best = df.groupBy(y.alias("y")).agg(F.count("*").alias("n")).orderBy(*order).limit(1).select("y")
    return df.join(F.broadcast(best), y == F.col("y"), "left_semi")


def with_year_and_doy(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumns({"year": F.year(time), "doy": F.dayofyear(time)})
