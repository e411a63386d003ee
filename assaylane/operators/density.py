"""Gaussian density of two columns on a grid, at a cost that does not grow with the rows once they are binned."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes of the binning grid along one axis, at most.
NODES = 1024
#: Bandwidths beyond the grid within which rows still count.
REACH = 5.0


def _axis(low: float, high: float, sd: float, points: int, nodes: int) -> tuple[float, float, int, int]:
    """Start, step and number of nodes of the binning grid, and how many of its steps a step of the result has."""
    step = (high - low) / (points - 1)
    fine = max(1, int(np.ceil(step / (0.1 * sd))))
    while fine > 1 and (high - low + 2 * REACH * sd) / step * fine > nodes:
        fine -= 1
    margin = int(np.ceil(REACH * sd / (step / fine)))
    return low - margin * step / fine, step / fine, (points - 1) * fine + 1 + 2 * margin, fine


def gaussian_density(df: DataFrame, x: str, y: str, x_bounds: tuple[float, float], y_bounds: tuple[float, float], *, points: int = 120) -> DataFrame:
    """i, j, x, y and density on a grid of ``points`` by ``points`` nodes within the bounds: a Gaussian kernel with Scott's bandwidth.

    One aggregate gives the covariance, another spreads each row over the four nodes around it (linear binning); the binned grid, of at most NODES
    by NODES numbers whatever the rows, is then convolved with the kernel. The error of binning falls with the square of the nodes' distance,
    a tenth of a bandwidth where NODES allow. Rows without x or y count nowhere; fewer than two rows, or rows on a line, give no density.
    """
    spark = df.sparkSession
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    n, vx, vy, cxy = rows.agg(F.count(F.lit(1)), F.var_samp("x"), F.var_samp("y"), F.covar_samp("x", "y")).first()
    schema = "i int, j int, x double, y double, density double"
    factor = float(n) ** (-1 / 6) if n else 0.0
    cov = np.array([[vx, cxy], [cxy, vy]], float) * factor**2 if n > 1 else np.zeros((2, 2))
    if not np.linalg.det(cov) > 1e-12 * max(cov[0, 0] * cov[1, 1], 1e-300):
        return spark.createDataFrame([], schema)
    (x0, dx, nx, fx), (y0, dy, ny, fy) = (_axis(*b, float(np.sqrt(v)), points, NODES) for b, v in ((x_bounds, cov[0, 0]), (y_bounds, cov[1, 1])))
    u, v = (F.col("x") - x0) / dx, (F.col("y") - y0) / dy
    inside = rows.select(u.alias("u"), v.alias("v")).where((F.col("u") >= 0) & (F.col("u") < nx - 1) & (F.col("v") >= 0) & (F.col("v") < ny - 1))
    p, q = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    corner = lambda a, b, w: F.struct((F.floor("u") + a).cast("int").alias("a"), (F.floor("v") + b).cast("int").alias("b"), w.alias("w"))
    spread = inside.select(F.explode(F.array(corner(0, 0, (1 - p) * (1 - q)), corner(1, 0, p * (1 - q)), corner(0, 1, (1 - p) * q), corner(1, 1, p * q))).alias("c"))
    binned = spread.groupBy("c.a", "c.b").agg(F.sum("c.w").alias("w")).toPandas()
    weights = np.zeros((nx, ny))
    weights[binned["a"].to_numpy(int), binned["b"].to_numpy(int)] = binned["w"].to_numpy(float)
    inverse = np.linalg.inv(cov)
    kx, ky = (np.arange(-(k - 1), k) * d for k, d in ((nx, dx), (ny, dy)))
    kernel = np.exp(-0.5 * (inverse[0, 0] * kx[:, None] ** 2 + 2 * inverse[0, 1] * kx[:, None] * ky[None, :] + inverse[1, 1] * ky[None, :] ** 2)) / (2 * np.pi * np.sqrt(np.linalg.det(cov)) * n)
    shape = [3 * k - 2 for k in (nx, ny)]
    smooth = np.fft.irfft2(np.fft.rfft2(weights, shape) * np.fft.rfft2(kernel, shape), shape)[nx - 1 : 2 * nx - 1, ny - 1 : 2 * ny - 1]
    mx, my = round((x_bounds[0] - x0) / dx), round((y_bounds[0] - y0) / dy)
    at_x, at_y = np.arange(points) * fx + mx, np.arange(points) * fy + my
    found = np.maximum(smooth[np.ix_(at_x, at_y)], 0)
    return spark.createDataFrame([(i, j, x0 + dx * int(at_x[i]), y0 + dy * int(at_y[j]), float(found[i, j])) for i in range(points) for j in range(points)], schema)
