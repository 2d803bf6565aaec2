"""The flows of a study over all subjects. Small tables that later steps need are written while a flow is put together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwitable.functions import paths as P
from dwitable.operators import directions, groupqc, manifest, mosaic, report, roster, sessions, tensor, volumes, voxels
from dwitable.operators.profile import StudyProfile
from dwitable.operators.volumes import dropped_scans, parse_outliers
from dwitable.session import materialise, settled
from dwitable.sinks.layout import transfer_manifest
from dwitable.sources import keys as key_source
from dwitable.sources import listing


def acquire(
    profile: StudyProfile,
    participants: DataFrame,
    keys: DataFrame,
    sidecars: DataFrame,
    existing: DataFrame,
    directory: str,
    subjects: roster.Subjects = "all",
    include_site: bool = False,
    overwrite: bool = False,
    reuse: bool = True,
) -> DataFrame:
    """Transfers to make for the subjects that proceed, from participant lists, object keys and sidecar bodies.

    ``participants`` is ``(site, rd, participant_id)``, ``keys`` is ``(key)``, ``sidecars`` is ``(subject_id, key,
    body)`` and ``existing`` holds the targets already there. A count of subjects is taken among the valid ones.
    The subjects' keys feed several steps, so they are written to the shared folder once; without ``reuse`` the
    listing is read again for each step.
    """
    study = profile.subjects(participants)
    by_count = subjects is None or isinstance(subjects, int)
    chosen = settled(study if by_count else roster.select_subjects(study, subjects), "subjects")
    listed = key_source.subject_keys(chosen, profile.keys(keys))
    if reuse:
        listed = materialise(listed, "keys")
    files = profile.own_steps("files", manifest.classify(listed))
    validity = manifest.subject_validity(chosen, files)
    kept = profile.key_filter(files)
    faced = materialise(directions.determine_directions(sidecars).select("subject_id", "key", "direction"), "directions")
    reasons = sessions.reasons_of(validity, sessions.subject_checks(kept, faced))
    proceeding = reasons.filter("skip_reason IS NULL").select("subject_id")
    if by_count:
        unfit = F.coalesce(F.col("skip_reason"), F.lit("")).isin("missing_files", "incomplete_fieldmaps", "no_direction")
        valid = reasons.select("subject_id", (~unfit).alias("valid"))
        proceeding = proceeding.join(roster.first_valid(valid, subjects or 1), "subject_id", "left_semi")
    proceeding = settled(proceeding, "proceeding")
    going = kept.join(proceeding, "subject_id", "left_semi")
    notes = manifest.sidecars_of(going, listed, distinct=True).select("subject_id", F.lit("json").alias("role"), "key")
    wanted = directions.split_fieldmaps(going, faced).unionByName(notes).join(chosen, "subject_id")
    targets = manifest.positions_paired(wanted, directory, include_site)
    return transfer_manifest(profile.own_steps("transfers", profile.rewrite(targets)), existing, overwrite)


def upload(keys: DataFrame, output_dir: str, pipeline: str, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Output files to send with the object key each gets: ``(key, object_key)``, without those that are there already.

    ``keys`` are the paths below the output folder, ``existing`` holds the object keys in the bucket.
    """
    found = key_source.output_files(keys, output_dir, pipeline).withColumnRenamed("object_key", "target")
    there = existing.select(F.col("object_key").alias("target"))
    return transfer_manifest(found, there, overwrite).select("key", F.col("target").alias("object_key"))


def thinned_gradients(
    lines: DataFrame, gradients: DataFrame, threshold: float, slices: DataFrame | None = None, profile: StudyProfile | None = None
) -> DataFrame:
    """Outlier report lines to the gradient table without the dropped volumes, renumbered."""
    step = profile.own_steps if profile else (lambda _, df: df)
    dropped = dropped_scans(step("outliers", parse_outliers(lines)), threshold, slices)
    return step("gradients", volumes.drop_gradients(gradients, dropped))


@dataclass(frozen=True)
class Participant:
    """What the flow of one participant makes, for all of them at once.

    ``image`` and ``gradients`` are thinned, the gradients moved into the anatomy's space; ``scalars`` and ``thinned_scalars`` have
    eigenvalues, anisotropy, diffusivities and colours per voxel ``(subject, voxel)`` with all volumes and without the
    dropped ones, ``tensors`` the scaled tensors without them.
    """

    dropped: DataFrame
    image: DataFrame
    gradients: DataFrame
    tensors: DataFrame
    scalars: DataFrame
    thinned_scalars: DataFrame
    report: DataFrame


def participant(
    lines: DataFrame, image: DataFrame, gradients: DataFrame, affines: DataFrame, series: DataFrame, qc: DataFrame,
    threshold: float = 0.02, profile: StudyProfile | None = None,
) -> Participant:
    """From an eddy-corrected image to tensors, scalars and the report.

    ``lines`` is ``(subject, line_no, line)``, ``image`` is ``(subject, t, i, j, k, value)``, ``gradients`` is ``(subject, vol, bval, gx, gy,
    gz)``, ``affines`` has a matrix per subject, ``series`` the movement ``(subject, vol, rms_abs, rms_rel)`` and ``qc`` the quality measures.
    """
    step = profile.own_steps if profile else (lambda _, df: df)
    slices = volumes.slice_counts(image)
    outliers = step("outliers", parse_outliers(lines.select("subject", "line")))
    dropped = settled(dropped_scans(outliers, threshold, slices), "dropped")
    moved = step("gradients", volumes.transform_vectors(gradients, affines))
    thin_image = volumes.drop_volumes(image, gradients.select("subject", "vol"), dropped)
    thin_gradients = volumes.drop_gradients(moved, dropped)
    whole = tensor.fit_tensor(tensor.signal_of(image), moved)
    thinned = materialise(tensor.fit_tensor(tensor.signal_of(thin_image), thin_gradients), "tensors")
    dims = settled(voxels.image_dims(image).join(image.groupBy("subject").agg((F.max("t") + 1).cast("int").alias("nt")), "subject"), "dims")
    assembled = report.assemble(mosaic.series_layouts(dims), mosaic.still_layouts(dims), dropped, lines, series, qc)
    return Participant(
        dropped, thin_image, thin_gradients, tensor.scaled(thinned), tensor.colour_fa(tensor.tensor_scalars(whole)),
        tensor.colour_fa(tensor.tensor_scalars(thinned)), assembled,
    )


def group_quality(pages: DataFrame, bodies: DataFrame, schema: str) -> DataFrame:
    """Listing pages and report documents to each subject's scores against its bucket.

    ``pages`` is ``(bucket, xml)``, ``bodies`` is ``(bucket, key, body)``; only listed reports with a quality block count.
    """
    listed = listing.report_keys(
        pages.select("bucket", F.explode(listing.page_keys("xml")).alias("key"))
    ).distinct()
    reports = listing.reports_with_qc(bodies.join(listed, ["bucket", "key"], "left_semi"), schema)
    reports = reports.filter("coalesce(report.part, 0) = 0")  # every part has the quality block
    qc = reports.select(
        "bucket", P.report_subject("key").alias("subject"), "report.eddy_quad.qc_mot_abs", "report.eddy_quad.qc_mot_rel"
    )
    return groupqc.with_display(groupqc.z_scores(qc))
