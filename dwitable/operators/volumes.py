"""Outlier slices, dropped volumes, thinned images and gradient tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwitable.functions import maths as M
from dwitable.functions.columns import ColumnLike, col
from dwitable.operators.indexing import ordered_index
from dwitable.session import if_small, settled

# The sentence of an outlier report.
OUTLIER_PATTERN = (
    r"^Slice ([-+]?\d+) in scan ([-+]?\d+) is an outlier with mean ([-+]?\d*\.\d+) standard deviations off, "
    r"and mean squared ([-+]?\d*\.\d+) standard deviations off\.$"
)
FIELDS = {"slice": "int", "scan": "int", "mean_sd": "double", "mean_sq_sd": "double"}


def _numbers(line: ColumnLike) -> Column:
    """The four numbers of an outlier line as texts, NULL for a line of another form; one match per line."""
    text = F.trim(col(line))
    found = F.regexp_replace(text, OUTLIER_PATTERN, "$1|$2|$3|$4")
    return F.when(found != text, F.split(found, "[|]"))


def parse_outliers(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Outlier lines as numbers. A line of another form raises, or is left out with ``strict=False``."""
    keep = [c for c in lines.columns if c != "line"]
    numbers = lines.select(*keep, "line", _numbers("line").alias("_n"))
    if strict:
        refused = F.raise_error(F.concat(F.lit("not an outlier line: "), F.coalesce("line", F.lit("NULL"))))
        numbers = numbers.withColumn("_n", F.coalesce("_n", refused.cast("array<string>")))
    else:
        numbers = numbers.filter("_n IS NOT NULL")
    return numbers.select(*keep, *[F.get("_n", F.lit(g)).cast(kind).alias(n) for g, (n, kind) in enumerate(FIELDS.items())])


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The lines ``parse_outliers(strict=False)`` leaves out."""
    return lines.filter(_numbers("line").isNull())


def outliers_per_scan(outliers: DataFrame) -> DataFrame:
    """Number of outlier slices in each scan that has any."""
    return outliers.groupBy("subject", "scan").agg(F.count(F.lit(1)).alias("n_outliers"))


def dropped_scans(outliers: DataFrame, threshold: float, slices: DataFrame | None = None) -> DataFrame:
    """Scans with more outlier slices than allowed, as ``(subject, vol)``.

    A threshold strictly between 0 and 1 is a share of the subject's slices (``slices``: ``subject, n_slices``; without
    it the highest slice number that the subject's report names); any other value is a count. The report lines are read
    once: what is kept of them is a row per scan.
    """
    if not 0 < threshold < 1:
        over = outliers_per_scan(outliers).filter(F.col("n_outliers") > F.lit(threshold))
        return over.select("subject", F.col("scan").alias("vol"))
    counts = settled(outliers.groupBy("subject", "scan").agg(
        F.count(F.lit(1)).alias("n_outliers"), F.max("slice").alias("_top")), "scans")
    if slices is None:
        slices = counts.groupBy("subject").agg(F.max("_top").alias("n_slices"))
    over = counts.join(settled(slices, "slices"), "subject").filter(F.col("n_outliers") > F.lit(threshold) * F.col("n_slices"))
    return over.select("subject", F.col("scan").alias("vol"))


def slice_counts(voxels: DataFrame) -> DataFrame:
    """Number of slices of each subject's image."""
    return voxels.groupBy("subject").agg((F.max("k") + 1).alias("n_slices"))


def reindexed(volumes: DataFrame, dropped: DataFrame) -> DataFrame:
    """The volumes that stay, with their new gap-free index ``new_vol``.

    The list of dropped volumes is worked out once; it is needed for counting and for numbering.
    """
    gone = settled(dropped.select("subject", "vol"), "dropped")
    kept = volumes.join(gone, ["subject", "vol"], "left_anti")
    return ordered_index(kept, ["subject"], "vol", "new_vol")


def drop_volumes(voxels: DataFrame, volumes: DataFrame, dropped: DataFrame) -> DataFrame:
    """An image without the dropped volumes, its time axis compacted.

    Volumes are renumbered on the volume table (one row per volume, about a millionth of the image); voxels then take
    the number from it, without being shuffled as long as that table is small.
    """
    kept = reindexed(volumes.select("subject", "vol"), dropped).withColumnRenamed("vol", "t")
    return voxels.join(settled(kept, "kept"), ["subject", "t"]).withColumn("t", F.col("new_vol")).drop("new_vol")


def drop_gradients(volumes: DataFrame, dropped: DataFrame) -> DataFrame:
    """b-values and b-vectors without the dropped volumes, renumbered."""
    return reindexed(volumes, dropped).withColumn("vol", F.col("new_vol")).drop("new_vol")


def transform_vectors(volumes: DataFrame, affines: DataFrame) -> DataFrame:
    """Gradient vectors times the subject's matrix, as row vectors with a trailing 1; not normalised again."""
    a = M.affine_columns()
    out = M.row_times_affine(("gx", "gy", "gz"), a)
    return volumes.join(if_small(affines), "subject").select(
        *[c for c in volumes.columns if c not in ("gx", "gy", "gz")],
        out[0].alias("gx"), out[1].alias("gy"), out[2].alias("gz"),
    )


def annotate_dropped(series: DataFrame, dropped: DataFrame) -> DataFrame:
    """A per-volume series with a flag on dropped volumes."""
    marks = dropped.select("subject", "vol", F.lit(True).alias("is_outlier"))
    return series.join(marks, ["subject", "vol"], "left").withColumn(
        "is_outlier", F.coalesce("is_outlier", F.lit(False))
    )


def series_domain(series: DataFrame, x: str = "vol", lines: tuple[str, str] = ("rms_abs", "rms_rel")) -> DataFrame:
    """Range of the index and of both series, per subject."""
    a, b = lines
    return series.groupBy("subject").agg(
        F.min(x).alias("x_min"), F.max(x).alias("x_max"),
        F.min(F.least(a, b)).alias("y_min"), F.max(F.greatest(a, b)).alias("y_max"),
    )
