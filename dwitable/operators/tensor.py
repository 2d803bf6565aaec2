"""Voxel-wise diffusion tensors by (weighted) log-linear least squares, and the scalars derived from them.

``ln S = ln S0 - b g' D g`` is linear in ``ln S0`` and the six entries of D. The sums of the normal equations are plain
aggregates, so the volumes of a voxel are never collected; only the 7 x 7 systems
themselves go to Python, thousands per Arrow batch.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, StructField, StructType

from dwitable.functions import maths as M
from dwitable.session import if_small, settled

ENTRIES = ("dxx", "dyy", "dzz", "dxy", "dxz", "dyz")
SOLUTION = StructType([StructField(n, DoubleType()) for n in ("ln_s0", *ENTRIES)])
MIN_SIGNAL = 1e-4
B_UNIT = 1000.0
SINGULAR = 1e-12
PAIRS = list(combinations_with_replacement(range(7), 2))


def _regressors() -> list[Column]:
    b = F.col("bval") / B_UNIT
    x, y, z = F.col("gx"), F.col("gy"), F.col("gz")
    return [F.lit(1.0), -b * x * x, -b * y * y, -b * z * z, -2 * b * x * y, -2 * b * x * z, -2 * b * y * z]


def _solve(sums: pd.DataFrame) -> pd.DataFrame:
    values = sums.to_numpy(dtype=float)
    system = np.empty((len(values), 7, 7))
    for n, (r, c) in enumerate(PAIRS):
        system[:, r, c] = system[:, c, r] = values[:, n]
    rhs = values[:, len(PAIRS):]
    scale = np.sqrt(np.einsum("nii->ni", system))
    scale[scale == 0] = 1.0
    scaled = system / scale[:, :, None] / scale[:, None, :]
    regular = np.linalg.det(scaled) > SINGULAR
    out = np.empty((len(values), 7))
    right = (rhs / scale)[:, :, None]
    out[regular] = np.linalg.solve(scaled[regular], right[regular])[:, :, 0]
    if not regular.all():
        inverse = np.linalg.pinv(scaled[~regular], rcond=1e-10, hermitian=True)
        out[~regular] = (inverse @ right[~regular])[:, :, 0]
    out /= scale
    out[:, 1:] /= B_UNIT
    return pd.DataFrame(out, columns=["ln_s0", *ENTRIES])


def _normal_equations(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """Solution per voxel of the (weighted) least-squares problem over rows with ``x0`` to ``x6`` and ``y``."""
    x = [F.col(f"x{n}") for n in range(7)]
    left = x if weight is None else [weight * c for c in x]
    products = [F.sum(left[r] * x[c]).alias(f"p{r}{c}") for r, c in PAIRS]
    moments = [F.sum(left[n] * F.col("y")).alias(f"m{n}") for n in range(7)]
    sums = rows.groupBy("subject", "voxel").agg(*products, *moments)
    inputs = F.struct(*[F.col(f"p{r}{c}") for r, c in PAIRS], *[F.col(f"m{n}") for n in range(7)])
    solved = sums.select("subject", "voxel", F.pandas_udf(_solve, SOLUTION)(inputs).alias("fit"))
    return solved.select("subject", "voxel", "fit.*")


def fit_tensor(
    signal: DataFrame, volumes: DataFrame, weighted: bool = True, clustered: bool = False, min_signal: float = MIN_SIGNAL
) -> DataFrame:
    """Tensor and ``ln S0`` of every voxel. Signals below ``min_signal`` are raised to it, since they have no logarithm.

    ``signal`` is ``(subject, voxel, vol, signal)`` with any set of volumes per voxel, ``volumes`` the gradient table
    ``(subject, vol, bval, gx, gy, gz)``. With ``weighted`` a plain fit is followed by one whose squared weights are
    the squares of the signals it predicts.

    The 35 sums of a voxel are wider than its single measurements. Images come volume by volume, where summing up
    before the shuffle gains nothing, so measurements are brought together first and everything after happens in
    place; say ``clustered`` where the measurements of a voxel already lie together.
    """
    table = volumes.select("subject", "vol", "bval", "gx", "gy", "gz")
    measured = signal.select("subject", "voxel", "vol", "signal")
    if not clustered:
        measured = measured.repartition("subject", "voxel")
    rows = measured.join(if_small(table), ["subject", "vol"]).select(
        "subject", "voxel", *[c.alias(f"x{n}") for n, c in enumerate(_regressors())],
        F.ln(F.greatest(F.col("signal"), F.lit(min_signal))).alias("y"),
    )
    first = _normal_equations(rows)
    if not weighted:
        return first
    decay = sum((F.col(f"x{n}") * F.col(e) * B_UNIT for n, e in enumerate(ENTRIES, start=1)), F.lit(0.0))
    predicted = rows.join(first, ["subject", "voxel"]).withColumn("w", F.exp(2 * decay))
    return _normal_equations(predicted, F.col("w"))


def _fit_rows(signal: pd.Series, design: pd.Series, weighted: bool, min_signal: float) -> pd.DataFrame:
    """The fit of each row on its own: signals and regressors of its volumes, NULL where one was not measured."""
    out = np.empty((len(signal), 7))
    for i, (s, x) in enumerate(zip(signal, design)):
        s = np.asarray(s, float)
        x = np.asarray(x, float).reshape(-1, 7)[: len(s)]
        s = s[: len(x)]
        known = ~np.isnan(s)
        x, y = x[known], np.log(np.maximum(s[known], min_signal))
        w = np.ones(len(y))
        for _ in range(2 if weighted else 1):
            system = np.concatenate([(x * w[:, None]).T @ x, ((x * w[:, None]).T @ y)[:, None]], axis=1)
            flat = [system[r, c] for r, c in PAIRS] + list(system[:, 7])
            solved = _solve(pd.DataFrame([flat])).to_numpy()[0]
            w = np.exp(2 * (x[:, 1:] @ (solved[1:] * B_UNIT)))
        out[i] = solved
    return pd.DataFrame(out, columns=["ln_s0", *ENTRIES])


def fit_arrays(voxels: DataFrame, volumes: DataFrame, weighted: bool = True, min_signal: float = MIN_SIGNAL) -> DataFrame:
    """The fit of voxels that hold their signals as one array: ``(subject, voxel, signal)``, the entry of volume n at n.

    Each row is fitted where it lies, so the image is not shuffled: the regressors of a subject's volumes come as one array, from a
    table with a row per subject, which is broadcast if it is small. A NULL signal, or a volume beyond the gradient
    table, was not measured.
    """
    entries = F.sort_array(F.collect_list(F.struct("vol", F.array(*_regressors()).alias("x"))))
    flat = F.flatten(F.transform(entries, lambda e: e["x"]))
    designs = settled(volumes.groupBy("subject").agg(flat.alias("design")), "designs")

    def fit(signal: pd.Series, design: pd.Series) -> pd.DataFrame:
        return _fit_rows(signal, design, weighted, min_signal)

    fit.__annotations__ = {"signal": pd.Series, "design": pd.Series, "return": pd.DataFrame}
    solved = voxels.join(designs, "subject").select("subject", "voxel", F.pandas_udf(fit, SOLUTION)("signal", "design").alias("fit"))
    return solved.select("subject", "voxel", "fit.*")


def from_arrays(voxels: DataFrame) -> DataFrame:
    """Voxels that hold their signals as one array, volume by volume, as single measurements (``clustered``)."""
    return voxels.select("subject", "voxel", F.posexplode("signal").alias("vol", "signal"))


def signal_of(image: DataFrame) -> DataFrame:
    """An image ``(subject, t, i, j, k, value)`` as measurements, the place of a voxel as its name."""
    return image.select("subject", F.struct("i", "j", "k").alias("voxel"), F.col("t").alias("vol"), F.col("value").alias("signal"))


def scaled(tensors: DataFrame, factor: float = 1000.0) -> DataFrame:
    """Tensor entries times a factor."""
    return tensors.withColumns({e: F.col(e) * factor for e in ENTRIES})


def tensor_scalars(tensors: DataFrame) -> DataFrame:
    """Eigenvalues, fractional anisotropy, mean, axial and radial diffusivity of each tensor.

    Negative eigenvalues, which noise can produce, count as zero.
    """
    e1, e2, e3 = M.sym3_eigenvalues(*ENTRIES)
    solved = tensors.withColumn("_e", F.struct(e1.alias("e1"), e2.alias("e2"), e3.alias("e3")))
    out = solved.select("*", *[F.greatest(F.col(f"_e.{e}"), F.lit(0.0)).alias(e) for e in ("e1", "e2", "e3")]).drop("_e")
    a, b, c = F.col("e1"), F.col("e2"), F.col("e3")
    spread = (a - b) * (a - b) + (b - c) * (b - c) + (c - a) * (c - a)
    return (
        out.withColumn("fa", F.sqrt(F.coalesce(F.try_divide(spread, 2 * (a * a + b * b + c * c)), F.lit(0.0))))
        .withColumn("md", (a + b + c) / 3).withColumn("ad", a).withColumn("rd", (b + c) / 2)
    )


def colour_fa(scalars: DataFrame) -> DataFrame:
    """Red, green and blue as the main direction's components times the anisotropy."""
    direction = M.major_eigenvector("e1", "e2", "e3", *ENTRIES)
    channels = [(F.coalesce(d, F.lit(0.0)) * F.col("fa")).alias(n) for n, d in zip(("r", "g", "b"), direction)]
    return scalars.select("*", *channels)
