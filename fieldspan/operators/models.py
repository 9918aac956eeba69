"""Regression prior, constrained downscaling, and unmixing by a small network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pixels import ndvi, reflectance


def least_squares(df: DataFrame, keys: list[str], y: str, xs: list[str], fallback: bool = True) -> DataFrame:
    """keys, n, mean_y, coefficients (intercept first) of y on xs by group, rows with NULLs left out.

    The normal equations' sums are one aggregate; groups with fewer than len(xs) + 2 rows, or singular ones,
    get the mean as intercept and no slope (or NULL without fallback)."""
    cols = ["1", *xs]
    full = df.where(" AND ".join(f"{c} IS NOT NULL" for c in (y, *xs)))
    sums = [F.sum(F.expr(f"cast({a} AS double) * {b}")).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    right = [F.sum(F.expr(f"cast({a} AS double) * {y}")).alias(f"r{i}") for i, a in enumerate(cols)]
    agg = full.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(y).alias("mean_y"), *sums, *right)
    k = len(cols)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                a = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                if r["n"] >= k + 1 and np.linalg.matrix_rank(a) == k:
                    out.append(np.linalg.solve(a, [r[f"r{i}"] for i in range(k)]).tolist())
                else:
                    out.append([r["mean_y"], *[0.0] * (k - 1)] if fallback else None)
            b["coefficients"] = out
            yield b[[*keys, "n", "mean_y", "coefficients"]]

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keys)
    return agg.mapInPandas(solve, f"{kinds}n long, mean_y double, coefficients array<double>")


def features(cube: DataFrame, terrain: DataFrame | None = None) -> DataFrame:
    """time, y, x, ndvi, swir2, swir3, with terrain (y, x, twi, hli) also twi on 0..20 and hli, and valid: whether none is missing."""
    x = cube.select("time", "y", "x", ndvi().alias("ndvi"), reflectance("swir2").alias("swir2"), reflectance("swir3").alias("swir3"))
    names = ["ndvi", "swir2", "swir3"]
    if terrain is not None:
        x = x.join(terrain.select("y", "x", F.least(F.greatest("twi", F.lit(0.0)), F.lit(20.0)).alias("twi"), "hli"), ["y", "x"], "left")
        names += ["twi", "hli"]
    return x.select("time", "y", "x", *names, F.coalesce(*[F.when(F.col(c).isNull(), False) for c in names], F.lit(True)).alias("valid"))


def linear_prior(fine: DataFrame, coarse: DataFrame, names: list[str], time: str = "time", least_valid: float = 0.1) -> DataFrame:
    """fine (time, cell, valid, names) with prior: the coarse value (time, cell, coarse) by least squares on the cells' mean
    features, applied to each fine pixel; NULL where a feature is missing.

    A cell's means are over its valid pixels, and NULL if too few are valid. A time with fewer than two more usable cells than
    features, or a singular system, has the mean of its coarse values as prior."""
    means = fine.groupBy(time, "cell").agg(F.avg(F.col("valid").cast("double")).alias("share"), *[F.avg(F.when(F.col("valid"), F.col(c))).alias(c) for c in names])
    cells = coarse.join(means.select(time, "cell", *[F.when(F.col("share") > least_valid, F.col(c)).alias(c) for c in names]), [time, "cell"], "left")
    fitted = least_squares(cells, [time], "coarse", names, fallback=False).select(time, "coefficients")
    flat = coarse.groupBy(time).agg(F.avg("coarse").alias("flat"))
    by_time = flat.join(fitted, time, "left")
    line = sum((F.col("coefficients")[i + 1] * F.col(c) for i, c in enumerate(names)), F.col("coefficients")[0])
    prior = F.when(F.col("valid"), F.when(F.col("coefficients").isNotNull(), line).otherwise(F.col("flat")))
    return fine.join(by_time, time, "left").withColumn("prior", prior).drop("coefficients", "flat")


def solved_times(out: DataFrame, time: str = "time") -> DataFrame:
    """The times that could be solved, in order; none: an error."""
    good = out.where(F.col("status") == "ok")
    if good.isEmpty():
        raise RuntimeError("no time could be solved")
    return good.orderBy(time)


def neighbours(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each cell of a raster, the places of its four neighbours; len(y) stands for one that is missing."""
    key = (y - y.min()).astype(np.int64) * (np.ptp(x) + 3) + (x - x.min()) + 1
    order = np.argsort(key)
    wide = np.ptp(x) + 3
    out = np.empty((len(y), 4), np.int64)
    for k, step in enumerate((-wide, wide, -1, 1)):
        i = np.minimum(np.searchsorted(key[order], key + step), len(y) - 1)
        out[:, k] = np.where(key[order][i] == key + step, order[i], len(y))
    return out


def downscale_group(prior: np.ndarray, cell: np.ndarray, coarse: dict[int, float], near: np.ndarray, weight: float = 0.5, rounds: int = 2000) -> np.ndarray:
    """theta >= 0 that keeps the means of cells, near the prior and smooth: min |theta - prior|^2 + weight |L theta|^2, L four times a
    cell less its neighbours.

    ADMM between the equality-constrained quadratic program and theta >= 0. The program is solved by conjugate gradients
    among values that keep the cells' means, so nothing larger than the raster is held: L is applied through the
    neighbours' places, and the means are kept by taking each cell's mean off the residual."""
    _, group = np.unique(cell, return_inverse=True)
    size = np.bincount(group)
    target = np.full(len(size), np.nan)
    for g, c in enumerate(np.unique(cell)):
        target[g] = coarse.get(int(c), np.nan)
    known = ~np.isnan(target)
    rho = 1.0

    def smooth(v: np.ndarray) -> np.ndarray:
        return 4 * v - np.append(v, 0.0)[near].sum(1)

    def apart(v: np.ndarray) -> np.ndarray:
        return (1 + rho) * v + weight * smooth(smooth(v))

    def means(v: np.ndarray) -> np.ndarray:
        return np.where(known, np.bincount(group, v) / size, 0.0)

    z, u = np.maximum(prior, 0), np.zeros(len(prior))
    x = z - (means(z) - np.where(known, target, 0.0))[group]
    for _ in range(rounds):
        r = prior + rho * (z - u) - apart(x)
        r -= means(r)[group]
        p, rr = r.copy(), r @ r
        for _ in range(200):
            if rr < 1e-22 * len(x):
                break
            hp = apart(p)
            hp -= means(hp)[group]
            a = rr / (p @ hp)
            x = x + a * p
            r = r - a * hp
            rr, before = r @ r, rr
            p = r + rr / before * p
        new = np.maximum(x + u, 0)
        u += x - new
        done = np.abs(new - z).max(initial=0) < 1e-10 and np.abs(x - new).max(initial=0) < 1e-8
        z = new
        if done:
            break
    return z


def downscale(fine: DataFrame, time: str = "time", weight: float = 0.5) -> DataFrame:
    """time, y, x, theta, status for rows (time, y, x, prior, cell, coarse): one grid a time, solved apart; times
    whose constraints can't be met keep status 'infeasible' and no theta."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"]).reset_index(drop=True)
        near = neighbours(pdf.y.to_numpy(), pdf.x.to_numpy())
        coarse = pdf.dropna(subset=["coarse"]).groupby("cell").coarse.first().to_dict()
        feasible = all(v >= 0 for v in coarse.values())
        theta = downscale_group(pdf.prior.to_numpy(float), pdf.cell.to_numpy(), coarse, near, weight) if feasible else np.full(len(pdf), np.nan)
        return pdf[[time, "y", "x"]].assign(theta=theta, status="ok" if feasible else "infeasible")

    kind = fine.schema[time].dataType.simpleString()
    return fine.groupBy(time).applyInPandas(run, f"{time} {kind}, y int, x int, theta double, status string")


#: A tiny network with fixed weights, for tests: real weights are handed in.
DEMO_WEIGHTS = [(np.array([[0.2, -0.1, 0.4], [0.1, 0.3, -0.2], [-0.3, 0.5, 0.1], [0.25, -0.15, 0.3], [0.05, 0.2, -0.1]]), np.array([0.1, 0.2, 0.05])), (np.array([[0.6, 0.1, 0.3], [0.2, 0.7, 0.1], [0.1, 0.2, 0.8]]), np.array([0.01, 0.02, 0.03]))]


def unmix(df: DataFrame, bands: list[str], weights: list[tuple[np.ndarray, np.ndarray]] = DEMO_WEIGHTS, names: tuple[str, ...] = ("bg", "pv", "npv"), gains: list[float] | None = None) -> DataFrame:
    """df with the network's outputs (ReLU between layers) of the bands' reflectances; NULL where a band is missing."""

    kept = [*df.columns, *names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[[f"_{c}" for c in bands]].to_numpy(float)
            for i, (w, bias) in enumerate(weights):
                x = x @ w + bias
                if i < len(weights) - 1:
                    x = np.where(x < 0, 0, x)
            for k, name in enumerate(names):
                b[name] = x[:, k]
            yield b[kept]

    gains = gains or [1.0] * len(bands)
    scaled = df.withColumns({f"_{c}": reflectance(c) * g for c, g in zip(bands, gains, strict=True)})
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    out = scaled.mapInPandas(run, f"{kinds}, {', '.join(f'{n} double' for n in names)}")
    return out.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in names})
