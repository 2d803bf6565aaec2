"""Text and JSON outputs.

Lines of one subject's file are ordered. To keep a large subject out of a single task its lines are cut into blocks
of consecutive volumes. A block is told by its first volume, which is written with every line, so that reading does not
depend on where a file was cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwitable.functions.columns import ColumnLike, col
from dwitable.operators.indexing import BLOCK, block_of
from dwitable.sinks.replace import replace_subjects


def integer_line(value: ColumnLike) -> Column:
    """An integer as a line."""
    return F.format_string("%d", col(value).cast("long"))


def fixed_line(values: Sequence[ColumnLike]) -> Column:
    """Numbers with six decimals, each followed by a blank."""
    return F.format_string("%f " * len(values), *[col(v).cast("double") for v in values])


def scientific(value: ColumnLike) -> Column:
    """A number with eighteen decimals in scientific notation, enough to read back the same double."""
    return F.format_string("%.18e", col(value).cast("double"))


def motion_lines(parameters: DataFrame) -> DataFrame:
    """The line of each volume's motion file: three rotations, then three translations."""
    return parameters.select("subject", "vol", fixed_line(("rx", "ry", "rz", "tx", "ty", "tz")).alias("line"))


def vector_lines(vectors: DataFrame, axes: Sequence[str] = ("gx", "gy", "gz"), width: int = BLOCK) -> DataFrame:
    """Matrix text with one line per axis and one number per volume (the transpose of the vector table).

    ``(subject, first, axis, line)``: a line covers the ``width`` volumes from ``first`` on; a scan with more continues on the
    same line of the next block.
    """
    rows = vectors.select(
        "subject", (block_of("vol", width) * width).alias("first"), "vol",
        F.posexplode(F.array(*[scientific(a) for a in axes])).alias("axis", "text"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("vol", "text")))
    line = F.array_join(F.transform(ordered, lambda e: e["text"]), " ")
    return rows.groupBy("subject", "first", "axis").agg(line.alias("line"))


BUCKETS = 64
#: The column that the folders of documents add; not a name that a document would have.
JSON_BUCKET = "_bucket"


def write_lines(lines: DataFrame, path: str, order: str, width: int = BLOCK, buckets: int = BUCKETS, subjects: DataFrame | None = None) -> None:
    """Write ``(subject, <order>, line)`` as ordered records ``(subject, first, line_no, line)``, in ``buckets`` directories.

    ``first`` begins a block of ``width`` lines unless the table has it already. Subjects share a directory by hash; a file
    holds whole blocks in order. Ordinary subjects have one block, so a directory has one file for them, and the further
    blocks of large subjects are written by other tasks. What other subjects have there stays; ``subjects`` are
    those that the lines are about, if some have none any more.
    """
    if "first" not in lines.columns:
        lines = lines.withColumn("first", block_of(order, width) * width)
    rows = lines.select("subject", F.col("first").cast("long").alias("first"), F.col(order).cast("long").alias("line_no"), "line")
    replace_subjects(rows, path, ["subject"], "json", "bucket", buckets, ("subject", "first", "line_no"), ("first",), subjects)


def write_json(df: DataFrame, path: str, keys: Sequence[str] = ("subject",), buckets: int = BUCKETS) -> None:
    """Write one JSON document per row, in place of the documents that the same keys had; those of other keys stay."""
    replace_subjects(df, path, keys, "json", JSON_BUCKET, buckets)


def document(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns other than the keys as one JSON text."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias("body"))
