"""Phase-encoding direction of field-map images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwitable.functions.columns import ColumnLike, col
from dwitable.operators.manifest import sidecar_completeness
from dwitable.session import settled

# The metadata key and its two values.
JSON_KEY = "PhaseEncodingDirection"
AP_VALUE = "j-"
PA_VALUE = "j"


def filename_direction(name: ColumnLike) -> Column:
    """AP or PA as named by the file, else NULL."""
    n = col(name)
    return F.when(n.contains("dir-AP"), F.lit("AP")).when(n.contains("dir-PA"), F.lit("PA"))


def check_options(metadata_source: str) -> None:
    """Raise for an unknown metadata source."""
    if metadata_source not in ("filename", "json"):
        raise ValueError("metadata_source must be 'filename' or 'json'")


def json_property(body: ColumnLike, key: str = JSON_KEY) -> Column:
    """A top-level JSON property, NULL where absent."""
    return F.get_json_object(col(body), f"$['{key}']")


def determine_directions(
    sidecars: DataFrame,
    metadata_source: str = "json",
    json_key: str = JSON_KEY,
    ap_value: str = AP_VALUE,
    pa_value: str = PA_VALUE,
) -> DataFrame:
    """Direction and warning of each field-map sidecar.

    The metadata value decides; where it is absent or unknown the file name does; else the direction is NULL.
    """
    check_options(metadata_source)
    named = filename_direction("key")
    if metadata_source == "filename":
        return sidecars.withColumn("direction", named).withColumn("warning", F.lit(None).cast("string"))
    value = F.col("value")
    stated = F.when(value == ap_value, F.lit("AP")).when(value == pa_value, F.lit("PA"))
    contradicted = ((value == ap_value) & F.col("key").contains("dir-PA")) | (
        (value == pa_value) & F.col("key").contains("dir-AP")
    )
    warning = (
        F.when(value.isNull(), F.lit("missing_key"))
        .when(stated.isNull(), F.lit("unknown_value"))
        .when(contradicted, F.lit("mismatch"))
    )
    return (
        sidecars.withColumn("value", json_property("body", json_key))
        .withColumn("direction", F.coalesce(stated, named))
        .withColumn("warning", warning)
        .drop("value")
    )


def direction_validity(directions: DataFrame) -> DataFrame:
    """Subjects are invalid where any of their files has no direction."""
    return directions.groupBy("subject_id").agg(F.bool_and(F.col("direction").isNotNull()).alias("valid"))


def relabel_roles(files: DataFrame, directions: DataFrame) -> DataFrame:
    """Replace the field-map roles by ``epi_ap`` and ``epi_pa``; other roles stay.

    An image takes the direction of its own sidecar; one without a direction is left out. A subject whose images and
    sidecars do not match keeps its field-map roles as they are, so every key of the result is a key of ``files``.
    """
    files = files.select("subject_id", "role", "key")
    gaps = settled(sidecar_completeness(files).select("subject_id").distinct(), "gaps")
    fieldmaps = F.col("role").isin("epi_nii", "epi_json")
    stated = directions.filter("direction IS NOT NULL").select(
        "subject_id", F.concat(F.lit("epi_"), F.lower("direction")).alias("_role"), F.col("key").alias("_sidecar"))
    images = files.filter("role = 'epi_nii'").withColumn("_sidecar", F.replace(F.col("key"), F.lit(".nii.gz"), F.lit(".json")))
    split = images.join(gaps, "subject_id", "left_anti").join(stated, ["subject_id", "_sidecar"])
    whole = files.filter(fieldmaps).join(gaps, "subject_id", "left_semi")
    return files.filter(~fieldmaps).unionByName(whole).unionByName(split.select("subject_id", F.col("_role").alias("role"), "key"))


def split_fieldmaps(files: DataFrame, directions: DataFrame) -> DataFrame:
    """The same for files without gaps between images and sidecars: field-map roles are split, and nothing is kept whole."""
    files = files.select("subject_id", "role", "key")
    stated = directions.filter("direction IS NOT NULL").select(
        "subject_id", F.concat(F.lit("epi_"), F.lower("direction")).alias("_role"), F.col("key").alias("_sidecar"))
    images = files.filter("role = 'epi_nii'").withColumn("_sidecar", F.replace(F.col("key"), F.lit(".nii.gz"), F.lit(".json")))
    split = images.join(stated, ["subject_id", "_sidecar"]).select("subject_id", F.col("_role").alias("role"), "key")
    return files.filter(~F.col("role").isin("epi_nii", "epi_json")).unionByName(split)


def relabel_by_name(files: DataFrame) -> DataFrame:
    """The same by file name alone: sidecars and images that name no direction are left out."""
    role = F.when(F.col("role") != "epi_nii", F.col("role")).when(F.col("key").contains("dir-AP"), F.lit("epi_ap")).when(
        F.col("key").contains("dir-PA"), F.lit("epi_pa"))
    named = files.filter("role <> 'epi_json'").select("subject_id", role.alias("role"), "key")
    return named.filter("role IS NOT NULL")
