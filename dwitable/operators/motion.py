"""Motion parameters and artefact flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwitable.functions import maths as M
from dwitable.operators.indexing import ordered_index, with_previous
from dwitable.session import settled

PARAMETERS = ("rx", "ry", "rz", "tx", "ty", "tz")

# Artefact thresholds of the single-direction flow.
NORM_THRESHOLD = 3
INTENSITY_THRESHOLD = 9


def motion_parameters(matrices: DataFrame) -> DataFrame:
    """Rotations and translations of each volume's 4x4 matrix (columns ``a00`` to ``a23``)."""
    rx, ry, rz = M.rotation_angles(M.affine_columns())
    return matrices.select(
        "subject", "vol", rx.alias("rx"), ry.alias("ry"), rz.alias("rz"),
        F.col("a03").alias("tx"), F.col("a13").alias("ty"), F.col("a23").alias("tz"),
    )


def frame_differences(parameters: DataFrame) -> DataFrame:
    """Euclidean length of the change of the six parameters since the preceding volume that is there; 0 for the first."""
    placed = ordered_index(parameters, ["subject"], "vol", "_place")
    prev = with_previous(placed, ["subject"], "_place", PARAMETERS)
    square = sum(((F.col(p) - F.col(f"prev_{p}")) * (F.col(p) - F.col(f"prev_{p}")) for p in PARAMETERS), F.lit(0.0))
    keep = list(parameters.columns)
    return prev.select(*keep, F.coalesce(F.sqrt(square), F.lit(0.0)).alias("norm"))


def intensity_z(intensities: DataFrame) -> DataFrame:
    """z-score of each volume's mean intensity among the volumes of its subject.

    The statistics are aggregated and joined back, since a window would hold all volumes of a subject in one task.
    """
    stats = intensities.groupBy("subject").agg(
        F.avg("intensity").alias("_mean"), F.stddev_samp("intensity").alias("_sd")
    )
    z = F.try_divide(F.col("intensity") - F.col("_mean"), F.nullif(F.col("_sd"), F.lit(0.0)))
    return intensities.join(settled(stats, "intensity"), "subject").withColumn("z", z).drop("_mean", "_sd")


def artifact_flags(
    parameters: DataFrame,
    intensities: DataFrame,
    norm_threshold: float = NORM_THRESHOLD,
    intensity_threshold: float = INTENSITY_THRESHOLD,
) -> DataFrame:
    """Volumes with their movement, intensity z-score and whether either exceeds its threshold."""
    motion = frame_differences(parameters).select("subject", "vol", "norm")
    bright = intensity_z(intensities).select("subject", "vol", "z")
    return motion.join(bright, ["subject", "vol"]).withColumn("motion_flag", F.col("norm") > norm_threshold).withColumn(
        "intensity_flag", F.coalesce(F.abs("z") > intensity_threshold, F.lit(False))
    )
