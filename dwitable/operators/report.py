"""Per-subject reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwitable.functions.columns import ColumnLike, col
from dwitable.operators.indexing import BLOCK, block_of

SPRITE = "struct<N:int,M:int,pix:int,num_slices:int,img_type:string>"
STILLS = ("b0", "colorFA", "anat_mask")
# One schema for what is written and what is read; a report of another writer may lack any of it.
REPORT_SCHEMA = (
    f"part long, dwi_corrected array<struct<orientation:string,N:int,M:int,pix:int,num_slices:int,img_type:string>>, b0 {SPRITE}, "
    f"colorFA {SPRITE}, anat_mask {SPRITE}, outlier_volumes array<long>, eddy_report array<string>, "
    "eddy_params array<array<double>>, eddy_quad struct<qc_mot_abs:double,qc_mot_rel:double>"
)


def _listed(df: DataFrame, order: str, value: Column, out: str, width: int) -> DataFrame:
    """Values of a subject as ordered lists, one per block of the order column."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy("subject", block_of(order, width).alias("part")).agg(
        F.transform(ordered, lambda e: e["v"]).alias(out)
    )


def assemble(
    series_layouts: DataFrame, still_layouts: DataFrame, dropped: DataFrame, lines: DataFrame, series: DataFrame, qc: DataFrame,
    width: int = BLOCK,
) -> DataFrame:
    """The report of each subject: sprite layouts, outlier volumes, report lines, movement series, quality block.

    Inputs: layouts of the time series ``(subject, orientation, N, M, pix, num_slices, img_type)`` and of the still images
    ``(subject, image, N, M, pix, num_slices, img_type)``, dropped volumes ``(subject, vol)``, report lines ``(subject,
    line_no, line)``, movement ``(subject, vol, rms_abs, rms_rel)`` and quality measures. Part 0 holds everything of an
    ordinary subject; lists longer than ``width`` continue in further parts, and every part has the quality block, so
    that it is a report of its own. Pixels stay in their own table, line by line, under the same subject and image.
    """
    fields = ("N", "M", "pix", "num_slices", "img_type")
    moving = series_layouts.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("orientation", *fields))).alias("dwi_corrected"))
    still = still_layouts.groupBy("subject").agg(
        *[F.first(F.when(F.col("image") == n, F.struct(*fields)), ignorenulls=True).alias(n) for n in STILLS])
    pictures = moving.join(still, "subject", "full_outer").withColumn("part", F.lit(0).cast("long"))
    quality = qc.select("subject", F.struct(*[c for c in qc.columns if c != "subject"]).alias("eddy_quad"))
    key = ["subject", "part"]
    out = (
        pictures.join(quality.select("subject", F.lit(0).cast("long").alias("part")), key, "full_outer")
        .join(_listed(dropped, "vol", F.col("vol"), "outlier_volumes", width), key, "full_outer")
        .join(_listed(lines, "line_no", F.col("line"), "eddy_report", width), key, "full_outer")
        .join(_listed(series, "vol", F.array("rms_abs", "rms_rel"), "eddy_params", width), key, "full_outer")
        .join(quality, "subject", "left")
    )
    return out.select(
        *key, "dwi_corrected", *STILLS, F.coalesce("outlier_volumes", F.array().cast("array<long>")).alias("outlier_volumes"),
        F.coalesce("eddy_report", F.array().cast("array<string>")).alias("eddy_report"),
        F.coalesce("eddy_params", F.array().cast("array<array<double>>")).alias("eddy_params"), "eddy_quad",
    )


def outlier_line_count(lines: DataFrame) -> DataFrame:
    """Number of outlier lines of each subject's report, from its lines."""
    return lines.groupBy("subject").agg(F.count(F.lit(1)).alias("n_lines"))


def report_lines(reports: DataFrame) -> DataFrame:
    """The outlier lines of reports, part by part, as rows ``(subject, part, line)``."""
    return reports.select("subject", "part", F.explode("eddy_report").alias("line"))


def manifest_size(manifest: DataFrame) -> DataFrame:
    """Number of entries in each bucket's manifest."""
    return manifest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_entries"))


def middle_slice(num_slices: ColumnLike) -> Column:
    """Index of the middle slice."""
    return F.floor(col(num_slices) / 2).cast("int")


def movement_series(reports: DataFrame, column: str = "eddy_params", width: int = BLOCK) -> DataFrame:
    """The two movement series of each report as ``(vol, s0, s1)``; a further part goes on where the one before ended."""
    rows = reports.select(*[c for c in reports.columns if c != column], F.posexplode(column).alias("_at", "_v"))
    begin = F.coalesce(F.col("part"), F.lit(0)) * width if "part" in reports.columns else F.lit(0)
    return rows.withColumn("vol", (F.col("_at") + begin).cast("int")).select(
        *[c for c in reports.columns if c not in (column, "part")], "vol", F.get("_v", F.lit(0)).alias("s0"), F.get("_v", F.lit(1)).alias("s1")
    )


def highlighted(series: DataFrame, vol: int | Column) -> DataFrame:
    """The point of each series at one volume."""
    return series.filter(F.col("vol") == (F.lit(vol) if isinstance(vol, int) else vol))
