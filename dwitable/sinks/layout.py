"""Output layout, file naming, transfer and upload manifests."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwitable.functions import paths as P
from dwitable.functions.columns import ColumnLike, col
from dwitable.operators.indexing import paged
from dwitable.sinks.replace import replace_parts

PIPELINE = "dwitable"
#: Directories that one task writes: opening files takes the time, however few rows they get.
TASK_PARTS = 64

# Tool output names and what they become, in the order in which they are applied. ``{0}`` is the
# image base name; ``{0:x>y}`` the same with x replaced by y; ``{1}`` the subject id; ``{2}`` the pipeline folder.
PAIRED_NAMES = (
    ("vol0000_flirt_merged.nii.gz", "{0}.nii.gz"),
    ("stats.vol0000_flirt_merged.txt", "{0}.art.json"),
    ("motion_parameters.par", "{0}.motion.txt"),
    ("_rotated.bvec", ".bvec"),
    ("art.vol0000_flirt_merged_outliers.txt", "{0}.outliers.txt"),
    ("vol0000_flirt_merged", "{0}"),
    ("_roi_bbreg_freesurfer", "_register"),
    ("dwi/eddy_corrected", "dwi/{0}"),
    ("dti/eddy_corrected", "dti/{0:_dwi>}"),
    ("reg/eddy_corrected", "reg/{0:_dwi>}"),
    ("aparc+aseg_outbin", "{0:_dwi>_mask}"),
    ("aparc+aseg_out", "{0:_dwi>_aparc+aseg}"),
    ("art.eddy_corrected_outliers", "{0:dwi>outliers}"),
    ("color_fa", "colorfa"),
    ("orig_out", "{0:_dwi>_T1w}"),
    ("stats.eddy_corrected", "{0:dwi>artStats}"),
    ("eddy_corrected.eddy_parameters", "{0}.eddy_parameters"),
    ("qc/eddy_corrected", "qc/{0}"),
    ("derivatives/{2}", "derivatives/{1}/{2}"),
    ("_rotatedanat_space_thinned", ""),
    ("_thinned", ""),
    ("eddy_corrected", "{0}"),
    ("_warped", ""),
    ("_maths", "_scaled"),
    ("dropped_scans", "{0:_dwi>_dwi_dropped_scans}"),
    ("report.json", "{0:_dwi>_dwi_report.json}"),
)
SINGLE_NAMES = (
    ("vol0000_flirt_merged.nii.gz", "{0}.nii.gz"),
    ("stats.vol0000_flirt_merged.txt", "{0}.art.json"),
    ("motion_parameters.par", "{0}.motion.txt"),
    ("_rotated.bvec", ".bvec"),
    ("aparc+aseg_warped_out", "{0:_dwi>_aparc+aseg}"),
    ("art.vol0000_flirt_merged_outliers.txt", "{0}.outliers.txt"),
    ("vol0000_flirt_merged", "{0}"),
    ("_roi_bbreg_freesurfer", "_register"),
    ("aparc+asegbin_warped_thresh", "{0:_dwi>_mask}"),
    ("derivatives/{2}", "derivatives/{1}/{2}"),
)


def _render(template: str, base: Column, subject: Column, pipeline: str) -> Column:
    """The replacement text of one naming rule as a column."""
    head, brace, rest = template.partition("{")
    if not brace:
        return F.lit(template)
    code, _, tail = rest.partition("}")
    if code == "1":
        value = subject
    elif code == "2":
        value = F.lit(pipeline)
    elif ":" in code:
        old, _, new = code[2:].partition(">")
        value = F.replace(base, F.lit(old), F.lit(new))
    else:
        value = base
    return F.concat(F.lit(head), value, _render(tail, base, subject, pipeline))


def named(path: ColumnLike, base: ColumnLike, subject: ColumnLike, rules=PAIRED_NAMES, pipeline: str = PIPELINE) -> Column:
    """A tool output path under its final name: every rule applied in order."""
    b, s = col(base), col(subject)
    return reduce(
        lambda p, rule: F.replace(p, _render(rule[0], b, s, pipeline), _render(rule[1], b, s, pipeline)),
        rules, col(path),
    )


def output_path(out_dir: str, subject: ColumnLike, category: ColumnLike, name: ColumnLike, pipeline: str = PIPELINE) -> Column:
    """``out_dir/<subject>/<pipeline>/<category>/<name>``."""
    return F.concat_ws("/", F.lit(out_dir.rstrip("/")), col(subject), F.lit(pipeline), col(category), col(name))


def write_by_category(df: DataFrame, path: str, keys=("subject_id", "category"), file_rows: int = 1_000_000) -> None:
    """Write a table with one directory per subject and category; those of other subjects and categories stay as they are.

    A directory of at most ``file_rows`` rows is one file; only larger ones are spread, by a hash of the row, over as many
    tasks as they need. Many directories are dealt out by their number, as few rows would else end in few tasks.
    """
    rows = [c for c in df.columns if c not in keys]
    spread = paged(df, list(keys), rows or list(keys), file_rows)
    parts = df.select(*keys).distinct().count()
    if parts > TASK_PARTS:
        tasks = max(ceil(parts / TASK_PARTS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        spread = spread.repartition(tasks, *keys, "page")
    replace_parts(spread.drop("page"), path, list(keys))


def transfer_manifest(wanted: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Transfers to make: all of them, or those whose target does not exist yet."""
    if overwrite:
        return wanted
    return wanted.join(existing.select("target"), "target", "left_anti").select(*wanted.columns)


def upload_manifest(files: DataFrame, output_dir: str) -> DataFrame:
    """Each output file with the object key it is uploaded under."""
    return files.withColumn("object_key", P.upload_key("path", output_dir))
