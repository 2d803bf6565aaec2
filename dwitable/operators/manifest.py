"""From object keys to a register of each subject's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwitable.functions import paths as P
from dwitable.functions.columns import ColumnLike, col
from dwitable.operators.indexing import ordered_position
from dwitable.session import if_small, parts_of

# The file roles of a subject and those that can have a sidecar.
ROLES = ("dwi", "bvec", "bval", "epi_nii", "epi_json", "t1w", "freesurfer")
SIDECAR_ROLES = ("dwi", "bvec", "bval", "epi_nii", "t1w")


def file_role(key: ColumnLike, rd: ColumnLike) -> Column:
    """The role of a key by its directory, suffix and exclusions; NULL where it has none."""
    k, r = col(key), col(rd)
    raw, deriv = r == "raw", r == "deriv"
    dwi, fmap = raw & k.contains("/dwi/"), raw & k.contains("/fmap/")
    return (
        F.when(dwi & k.endswith(".nii.gz") & ~k.contains("TRACEW"), F.lit("dwi"))
        .when(dwi & k.endswith(".bvec"), F.lit("bvec"))
        .when(dwi & k.endswith(".bval"), F.lit("bval"))
        .when(fmap & k.endswith("epi.nii.gz") & ~k.contains("fMRI"), F.lit("epi_nii"))
        .when(fmap & k.endswith("epi.json") & ~k.contains("fMRI"), F.lit("epi_json"))
        .when(deriv & k.endswith("/T1w.nii.gz"), F.lit("t1w"))
        .when(deriv & k.contains("/freesurfer/"), F.lit("freesurfer"))
    )


def classify(keys: DataFrame) -> DataFrame:
    """Add ``role`` to a key table and keep the keys that have one."""
    return keys.withColumn("role", file_role("key", "rd")).filter("role IS NOT NULL")


def keep_site_anatomy(files: DataFrame, site: str, directory: str) -> DataFrame:
    """At one site, keep only the anatomy files of a given directory."""
    anatomy = (F.col("site") == site) & F.col("role").isin("t1w", "freesurfer")
    return files.filter(~anatomy | F.col("key").contains(directory))


def role_flags(files: DataFrame) -> DataFrame:
    """One boolean per role for every subject that has files."""
    return files.groupBy("subject_id").agg(*[F.bool_or(F.col("role") == r).alias(f"has_{r}") for r in ROLES])


def subject_validity(roster: DataFrame, files: DataFrame) -> DataFrame:
    """Whether each subject of the roster has at least one file of every role.

    Files are counted first: both sides are dealt out by subject, as many files to a task whatever their number.
    """
    complete = F.lit(True)
    for r in ROLES:
        complete = complete & F.coalesce(F.col(f"has_{r}"), F.lit(False))
    parts = parts_of(files)
    flags = role_flags(files.repartition(parts, "subject_id"))
    return roster.repartition(parts, "subject_id").join(flags, "subject_id", "left").select("subject_id", complete.alias("valid"))


def validity_after_filter(roster: DataFrame, files: DataFrame, filtered: DataFrame) -> DataFrame:
    """Validity before and after a study filter, since the filter may empty a role."""
    after = subject_validity(roster, filtered).withColumnRenamed("valid", "valid_after_filter")
    return subject_validity(roster, files).join(after, "subject_id")


def register(files: DataFrame) -> DataFrame:
    """The register of each subject: ``(subject_id, role, position, key)``, the keys of a role numbered from 0 in their order.

    One shape for subjects of any size: no list of a subject's files is built.
    """
    return ordered_position(files.select("subject_id", "role", "key"), ["subject_id", "role"], "key", "position")


def sidecars_of(files: DataFrame, keys: DataFrame, distinct: bool = False) -> DataFrame:
    """Sidecar keys of each image, found under its cumulative names among the raw JSON keys.

    A sidecar shared by several files of a subject is listed once for each of them, or once with ``distinct``.
    """
    names = P.cumulative_paths(P.split_extensions("key"), "json")
    wanted = files.filter(F.col("role").isin(*SIDECAR_ROLES)).select("subject_id", F.explode(names).alias("key"))
    present = keys.filter((F.col("rd") == "raw") & F.col("key").endswith(".json")).select("subject_id", "key")
    if distinct:
        wanted = wanted.distinct()
    return wanted.join(present, ["subject_id", "key"])


def sidecar_completeness(files: DataFrame) -> DataFrame:
    """Field-map images and sidecars that lack their counterpart, as ``(subject_id, key, missing)``.

    ``missing`` says whether the sidecar or the image is absent. Both sides meet in one aggregation on the key.
    """
    fmap = files.filter(F.col("role").isin("epi_nii", "epi_json"))
    json_key = F.replace(F.col("key"), F.lit(".nii.gz"), F.lit(".json"))
    sides = fmap.groupBy("subject_id", json_key.alias("key")).agg(
        F.bool_or(F.col("role") == "epi_nii").alias("image"), F.bool_or(F.col("role") == "epi_json").alias("sidecar")
    )
    missing = F.when(~F.col("sidecar"), F.lit("sidecar")).when(~F.col("image"), F.lit("image"))
    return sides.select("subject_id", "key", missing.alias("missing")).filter("missing IS NOT NULL")


def positions_paired(files: DataFrame, directory: str, include_site: bool = False) -> DataFrame:
    """Each key with its local target path."""
    return files.select(
        "subject_id", "site", "role", "key", P.target_path("key", "site", directory, include_site).alias("target")
    )


def zip_pairs(df: DataFrame, left: str, right: str, out: tuple[str, str]) -> DataFrame:
    """Pair two list columns by position, one row per pair."""
    keep = [c for c in df.columns if c not in (left, right)]
    pairs = F.explode(F.arrays_zip(F.col(left).alias(out[0]), F.col(right).alias(out[1])))
    return df.select(*keep, pairs.alias("_p")).select(*keep, f"_p.{out[0]}", f"_p.{out[1]}")


def bids_files(keys: DataFrame) -> DataFrame:
    """Keys with their naming entities as columns.

    A row generator keeps the patterns out of the conditions that are set on the columns later, where each mention would search again.
    """
    entities = F.struct(*[c.alias(f"e_{n}") for n, c in P.bids_entities("key").items()])
    return keys.select("*", F.inline(F.array(entities)))


def workflow_roles(entities: DataFrame) -> DataFrame:
    """The role each file plays as input of the preprocessing flow, by its entities."""
    e = {n: F.col(f"e_{n}") for n in ("datatype", "suffix", "direction", "extension")}
    image = e["extension"].isin(".nii", ".nii.gz")
    epi = (e["datatype"] == "fmap") & (e["suffix"] == "epi") & image
    dwi = (e["datatype"] == "dwi") & (e["suffix"] == "dwi")
    own = F.col("key").contains(F.concat(F.lit("/"), F.col("subject_id"), F.lit("/")))
    role = (
        F.when(epi & (e["direction"] == "AP"), F.lit("ap"))
        .when(epi & (e["direction"] == "PA"), F.lit("pa"))
        .when(dwi & own & F.col("key").endswith(".nii.gz") & ~F.col("key").contains("TRACE"), F.lit("dwi"))
        .when(dwi & F.col("key").endswith(".bval"), F.lit("bval"))
        .when(dwi & F.col("key").endswith(".bvec"), F.lit("bvec"))
    )
    return entities.withColumn("role", role).filter("role IS NOT NULL")


def own_images(keys: DataFrame) -> DataFrame:
    """Images below the subject's own folder, without trace images."""
    own = F.col("key").contains(F.concat(F.lit("/"), F.col("subject_id"), F.lit("/")))
    return keys.filter(own & F.col("key").endswith(".nii.gz") & ~F.col("key").contains("TRACE"))


# The files a subject must have exactly once.
SINGLE_ROLES = ("ap", "pa", "dwi", "bval", "bvec")


def single_file_violations(roster: DataFrame, inputs: DataFrame) -> DataFrame:
    """Subjects and roles whose file count is not one."""
    counts = inputs.groupBy("subject_id").agg(
        *[F.count_if(F.col("role") == r).alias(r) for r in SINGLE_ROLES]
    )
    per_role = F.explode(F.array(*[
        F.struct(F.lit(r).alias("role"), F.coalesce(F.col(r), F.lit(0)).alias("n")) for r in SINGLE_ROLES
    ]))
    return (
        roster.select("subject_id").join(counts, "subject_id", "left").select("subject_id", per_role.alias("v"))
        .select("subject_id", "v.role", "v.n").filter("n <> 1")
    )


def workflow_inputs(
    inputs: DataFrame, bids_dir: str, out_dir: str, eddy_iterations: int = 5, outlier_threshold: float = 0.02
) -> DataFrame:
    """The ten-field input record of every subject whose files are all there exactly once."""
    pick = {"dwi_file": "dwi", "dwi_file_ap": "ap", "dwi_file_pa": "pa", "bvec_file": "bvec", "bval_file": "bval"}
    per_subject = inputs.groupBy("subject_id").agg(
        *[F.min(F.when(F.col("role") == r, F.col("key"))).alias(f) for f, r in pick.items()],
        *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in SINGLE_ROLES],
    )
    ready = F.lit(True)
    for r in SINGLE_ROLES:
        ready = ready & (F.col(f"n_{r}") == 1)
    return per_subject.filter(ready).select(
        "subject_id", *pick, P.derivatives_dir(F.lit(bids_dir), "subject_id").alias("subjects_dir"),
        F.lit(out_dir).alias("out_dir"), F.lit(eddy_iterations).cast("int").alias("eddy_niter"),
        F.lit(outlier_threshold).cast("double").alias("slice_outlier_threshold"),
    )


def with_freesurfer(subjects: DataFrame, files: DataFrame, present: bool = True) -> DataFrame:
    """Subjects that have (or lack) a FreeSurfer directory."""
    have = files.filter(F.col("key").contains("/freesurfer/")).select("subject_id")
    return subjects.join(have, "subject_id", "left_semi" if present else "left_anti")


def missing_required(required: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct required rows that were not found."""
    return required.distinct().join(found, list(required.columns), "left_anti")


def merge_listings(*pages: DataFrame) -> DataFrame:
    """Distinct keys over several listings."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out.distinct()


def manifest_position(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """0-based position of wanted keys in each bucket's sorted manifest of distinct keys; -1 where absent.

    The position is the number of distinct keys that sort before, so no manifest has to be sorted in one task.
    ``wanted`` is ``(bucket, path)`` with one path per bucket, as a browser session has one open report.
    """
    per_bucket = manifest.select("bucket", "key").distinct().join(if_small(wanted), "bucket")
    return per_bucket.groupBy("bucket", "path").agg(
        F.when(F.bool_or(F.col("key") == F.col("path")), F.count_if(F.col("key") < F.col("path")))
        .otherwise(F.lit(-1)).cast("long").alias("position")
    )


def first_per_pattern(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """The first path matching each output pattern, per subject."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(list(patterns.items())):
        kind = F.when(F.col("key").rlike(pattern), F.lit(name)).otherwise(kind)
    return (
        files.select("subject_id", "key", kind.alias("kind")).filter("kind IS NOT NULL")
        .groupBy("subject_id", "kind").agg(F.min("key").alias("key"))
    )
