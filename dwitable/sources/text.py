"""Participant files, sidecars, whitespace matrices, report lines and quality-control documents.

Text whose line order matters is read one file per row, so that a line's number does not depend on how the file was
split; everything after that is exploded and spread. That is meant for files of one subject, a few megabytes at most; text
that is larger is written and read in blocks (``sinks.text.write_lines``, ``read_written_lines``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwitable.functions.columns import ColumnLike, col

QC_SCHEMA = "qc_mot_abs double, qc_mot_rel double"


def read_participants(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    """Distinct participant ids of a delimited file; partition directories become columns."""
    raw = spark.read.option("header", "true").option("sep", sep).csv(path)
    extra = [c for c in ("site", "rd") if c in raw.columns]
    return raw.select(*extra, "participant_id").distinct()


def read_bodies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files as ``(path, body)``, with partition directories as further columns."""
    files = spark.read.text(path, wholetext=True)
    extra = [c for c in files.columns if c != "value"]
    return files.select(F.col("_metadata.file_path").alias("path"), *extra, F.col("value").alias("body"))


def json_field(body: ColumnLike, key: str) -> Column:
    """One property of a JSON text."""
    return F.get_json_object(col(body), f"$['{key}']")


def explode_lines(files: DataFrame, body: str = "body") -> DataFrame:
    """One row per line with its number, text kept verbatim; a final line break ends the last line."""
    keep = [c for c in files.columns if c != body]
    trimmed = F.regexp_replace(F.col(body), r"\n$", "")
    return files.select(*keep, F.posexplode(F.split(trimmed, "\n")).alias("line_no", "line"))


def line_values(line: ColumnLike, bad: float | None = None) -> Column:
    """The numbers of a whitespace-separated line.

    A token that is no number raises, or becomes ``bad`` if that is given.
    """
    tokens = F.filter(F.split(col(line), r"\s+"), lambda t: t != "")
    if bad is None:
        return F.transform(tokens, lambda t: t.cast("double"))
    return F.transform(tokens, lambda t: F.coalesce(t.try_cast("double"), F.lit(bad)))


def matrix_entries(lines: DataFrame, bad: float | None = None) -> DataFrame:
    """A line table as ``(…, row, col, value)``; blank and comment lines count as no row."""
    keep = [c for c in lines.columns if c not in ("line_no", "line")]
    content = F.trim(F.regexp_replace("line", "#.*", ""))
    rows = lines.select(*keep, F.col("line_no").alias("row"), content.alias("line")).filter("line <> ''")
    return rows.select(*keep, "row", F.posexplode(line_values("line", bad)).alias("col", "value"))


def read_matrix(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whitespace matrix files as ``(path, …, row, col, value)``; a token that is no number raises."""
    return matrix_entries(explode_lines(read_bodies(spark, path)))


def read_table_lenient(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whitespace table files as ``(path, …, row, col, value)``; tokens that are no numbers become NaN."""
    return matrix_entries(explode_lines(read_bodies(spark, path)), bad=float("nan"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text files as ``(path, line_no, line)``."""
    return explode_lines(read_bodies(spark, path))


def read_written_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as ``sinks.text.write_lines`` wrote them: ``(subject, first, line_no, line)``."""
    return spark.read.schema("subject long, first long, line_no long, line string").json(path)


def read_qc(
    spark: SparkSession, path: str | list[str], schema: str = QC_SCHEMA, one_per_line: bool = False
) -> DataFrame:
    """Quality-control documents with a declared schema: one per file, or one per line."""
    return spark.read.schema(schema).option("multiLine", str(not one_per_line).lower()).json(path).drop("_bucket")


def b_values(entries: DataFrame) -> DataFrame:
    """b-value entries (one row or one column of numbers) as one value per volume; blocks count from their ``first``."""
    keep = [c for c in entries.columns if c not in ("row", "col", "value", "first")]
    return entries.select(*keep, (F.col("row") + F.col("col") + _first(entries)).alias("vol"), F.col("value").alias("bval"))


def _first(entries: DataFrame) -> Column:
    """The first volume of an entry's block, 0 for files that were not cut."""
    return F.col("first") if "first" in entries.columns else F.lit(0)


def b_vectors(entries: DataFrame) -> DataFrame:
    """b-vector entries (three rows, one column per volume) as one vector per volume; blocks count from their ``first``."""
    keep = [c for c in entries.columns if c not in ("row", "col", "value", "first")]
    axes = [F.max(F.when(F.col("row") == r, F.col("value"))).alias(a) for r, a in enumerate(("gx", "gy", "gz"))]
    return entries.groupBy(*keep, (F.col("col") + _first(entries)).alias("vol")).agg(*axes)
