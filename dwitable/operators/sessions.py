"""Files by session, session checks, and the decision which subjects proceed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwitable.functions import paths as P
from dwitable.functions.columns import before
from dwitable.operators.indexing import ordered_position
from dwitable.session import parts_of, settled

# The roles that belong to a session.
SESSION_ROLES = ("dwi", "bvec", "bval", "epi_ap", "epi_pa")
POLICIES = ("sessions", "concatenate")


def with_session(files: DataFrame) -> DataFrame:
    """Add the session label found in the key."""
    return files.withColumn("session", P.session_id("key"))


def session_role_counts(files: DataFrame) -> DataFrame:
    """File count of every session role, one row per subject and session."""
    own = files.filter(F.col("role").isin(*SESSION_ROLES))
    return own.groupBy("subject_id", "session").agg(
        *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in SESSION_ROLES]
    )


def _counts() -> list:
    return [F.col(f"n_{r}") for r in SESSION_ROLES]


def session_agreement(counts: DataFrame) -> DataFrame:
    """Per subject: whether every session has every role."""
    return counts.groupBy("subject_id").agg(F.bool_and(F.least(*_counts()) > 0).alias("consistent"))


def session_balance(counts: DataFrame) -> DataFrame:
    """Per session: file count and whether it is the same for all roles; unbalanced sessions are dropped."""
    lo, hi = F.least(*_counts()), F.greatest(*_counts())
    return counts.select("subject_id", "session", hi.alias("n_files"), (lo == hi).alias("balanced"))


def files_by_session(files: DataFrame) -> DataFrame:
    """Files of each session and role, numbered from 0: ``(subject_id, session, role, position, key)``."""
    own = files.filter(F.col("role").isin(*SESSION_ROLES)).select("subject_id", "session", "role", "key")
    return ordered_position(own, ["subject_id", "session", "role"], "key", "position")


def split_multiples(files: DataFrame, policy: str = "sessions") -> DataFrame:
    """Give each of several file sets in one session its own place.

    A set is told by its ``run-<label>`` entity, the unlabelled one first. ``sessions`` appends the set number to
    the session label; ``concatenate`` keeps the label and gives the order in which the sets follow one another.
    """
    if policy not in POLICIES:
        raise ValueError("policy must be 'sessions' or 'concatenate'")
    own = files.filter(F.col("role").isin(*SESSION_ROLES)).withColumn(
        "run", F.regexp_extract("key", r"_run-([0-9a-zA-Z]+)", 1)
    )
    runs = own.select("subject_id", "session", "run").distinct()
    w = Window.partitionBy("subject_id", "session")
    sets = runs.select(
        "subject_id", "session", "run",
        F.row_number().over(w.orderBy("run")).alias("set_no"), F.count(F.lit(1)).over(w).alias("n_sets"),
    )
    out = own.join(settled(sets, "sets"), ["subject_id", "session", "run"])
    label = F.when(F.col("n_sets") > 1, F.format_string("%s-%02d", "session", "set_no")).otherwise(F.col("session"))
    if policy == "concatenate":
        label = F.col("session")
    return out.select("subject_id", "session", label.alias("output_session"), "set_no", "role", "key")


def one_freesurfer(files: DataFrame) -> DataFrame:
    """Files of one FreeSurfer directory per subject: the first by name."""
    fs = files.filter(F.col("role") == "freesurfer").withColumn("fs_dir", before("key", "/freesurfer/"))
    chosen = fs.groupBy("subject_id").agg(F.min("fs_dir").alias("fs_dir"))
    return fs.join(settled(chosen, "chosen"), ["subject_id", "fs_dir"])


def first_t1w(files: DataFrame, first_only: bool = True) -> DataFrame:
    """The first anatomical image per subject, or all of them."""
    t1w = files.filter(F.col("role") == "t1w").select("subject_id", "key")
    return t1w.groupBy("subject_id").agg(F.min("key").alias("key")) if first_only else t1w


def output_register(files: DataFrame, assign_empty: bool = True) -> DataFrame:
    """Files of the balanced sessions under their output session label, each session with its own files."""
    own = files.filter(F.col("role").isin(*SESSION_ROLES))
    kept = session_balance(session_role_counts(own)).filter("balanced").select("subject_id", "session")
    return own.join(settled(kept, "sessions"), ["subject_id", "session"]).select(
        "subject_id", P.relabel_session("session", assign_empty).alias("output_session"), "role", "key"
    )


def skip_reasons(validity: DataFrame, directions: DataFrame, counts: DataFrame, gaps: DataFrame) -> DataFrame:
    """Why a subject does not proceed (NULL where it does).

    ``gaps`` has the subjects with a field-map image without sidecar or the other way round
    (``manifest.sidecar_completeness``).
    """
    agreement = session_agreement(counts)
    balanced = session_balance(counts).groupBy("subject_id").agg(F.bool_or("balanced").alias("any_session"))
    out = (
        validity.join(directions.withColumnRenamed("valid", "directed"), "subject_id", "left")
        .join(agreement, "subject_id", "left").join(balanced, "subject_id", "left")
        .join(gaps.select("subject_id", F.lit(True).alias("gap")).distinct(), "subject_id", "left")
    )
    yes = F.lit(False)
    reason = (
        F.when(~F.col("valid"), F.lit("missing_files"))
        .when(F.coalesce("gap", yes), F.lit("incomplete_fieldmaps"))
        .when(~F.coalesce("directed", yes), F.lit("no_direction"))
        .when(~F.coalesce("consistent", yes), F.lit("session_mismatch"))
        .when(~F.coalesce("any_session", yes), F.lit("no_session"))
    )
    return out.select("subject_id", reason.alias("skip_reason"))


def subject_checks(files: DataFrame, directions: DataFrame) -> DataFrame:
    """What decides whether a subject proceeds, from one pass over its files and sidecar directions.

    ``(subject_id, gap, directed, consistent, any_session)``: whether a field-map image or sidecar lacks its counterpart, all
    sidecars have a direction, every session has every role, and some session has equally many files of all. ``files`` is
    ``(subject_id, role, key)`` with classified roles, ``directions`` is ``(subject_id, key, direction)`` with AP, PA or NULL. Files
    and sidecars meet once, by the sidecar's key; what is left are a few numbers for each session and subject. Files are counted
    first and dealt out as many to a task whatever their number, and a sidecar's directions are flags, which need no sort.
    """
    parts = parts_of(files)
    fieldmap = F.col("role").isin("epi_nii", "epi_json")
    none = F.lit(None).cast("string")
    sidecar = F.when(fieldmap, F.replace(F.col("key"), F.lit(".nii.gz"), F.lit(".json")))
    rows = files.select("subject_id", P.session_id("key").alias("session"), sidecar.alias("sidecar"), "role", none.alias("direction")).unionByName(
        directions.select("subject_id", P.session_id("key").alias("session"), F.col("key").alias("sidecar"), F.lit("stated").alias("role"), "direction"))
    others = [r for r in SESSION_ROLES if not r.startswith("epi_")]
    met = rows.repartition(parts, "subject_id", "session", "sidecar").groupBy("subject_id", "session", "sidecar").agg(
        *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in others], F.count_if(F.col("role") == "epi_nii").alias("images"),
        F.bool_or(F.col("role") == "epi_json").alias("noted"), F.bool_or(F.col("role") == "stated").alias("stated"),
        *[F.coalesce(F.bool_or(F.col("direction") == d), F.lit(False)).alias(d) for d in ("AP", "PA")])
    images, faced = F.col("images") > 0, F.col("AP") | F.col("PA")
    towards = {"AP": F.col("AP") & ~F.col("PA"), "PA": F.col("PA")}  # a sidecar that states both counts as PA
    counted = met.repartition(parts, "subject_id").groupBy("subject_id", "session").agg(
        *[F.sum(f"n_{r}").alias(f"n_{r}") for r in others],
        *[F.sum(F.when(towards[d], F.col("images")).otherwise(0)).alias(f"n_epi_{d.lower()}") for d in ("AP", "PA")],
        F.bool_or(images != F.col("noted")).alias("gap"), F.bool_and(F.when(F.col("stated"), faced)).alias("directed"))
    lo, hi = F.least(*_counts()), F.greatest(*_counts())
    some = hi > 0  # a session without any of the roles is none
    return counted.groupBy("subject_id").agg(
        F.bool_or("gap").alias("gap"), F.coalesce(F.bool_and("directed"), F.lit(False)).alias("directed"),
        F.coalesce(F.bool_and(F.when(some, lo > 0)), F.lit(False)).alias("consistent"),
        F.coalesce(F.bool_or(F.when(some, lo == hi)), F.lit(False)).alias("any_session"))


def reasons_of(validity: DataFrame, checks: DataFrame) -> DataFrame:
    """The same as ``skip_reasons``, from ``subject_checks``."""
    yes = F.lit(False)
    reason = (
        F.when(~F.col("valid"), F.lit("missing_files"))
        .when(F.coalesce("gap", yes), F.lit("incomplete_fieldmaps"))
        .when(~F.coalesce("directed", yes), F.lit("no_direction"))
        .when(~F.coalesce("consistent", yes), F.lit("session_mismatch"))
        .when(~F.coalesce("any_session", yes), F.lit("no_session"))
    )
    return validity.join(checks, "subject_id", "left").select("subject_id", reason.alias("skip_reason"))


def eligible(subjects: DataFrame, reasons: DataFrame) -> DataFrame:
    """Rows of the subjects that proceed."""
    going = settled(reasons.filter("skip_reason IS NULL").select("subject_id"), "going")
    return subjects.join(going, "subject_id", "left_semi")
