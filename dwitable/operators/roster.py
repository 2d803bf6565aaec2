"""Who is in the study: rosters, selections, validity counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwitable.session import settled

Subjects = None | int | str | Sequence[str]


def site_roster(participants: DataFrame) -> DataFrame:
    """Ids listed both as raw and as derivative at the same site, from ``(site, rd, participant_id)``."""
    return participants.groupBy("site", "participant_id").agg(
        F.bool_or(F.col("rd") == "raw").alias("in_raw"), F.bool_or(F.col("rd") == "deriv").alias("in_deriv")
    ).filter("in_raw AND in_deriv").select("site", F.col("participant_id").alias("subject_id"))


def study_roster(roster: DataFrame, sites: Sequence[str]) -> DataFrame:
    """One row per subject; a subject found at several sites belongs to the last of them in site order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in sites]), F.col("site"))
    return roster.groupBy("subject_id").agg(F.max_by("site", rank).alias("site"))


def check_subjects(subjects: Subjects) -> None:
    """Raise for a selection of the wrong type or a count below one."""
    if subjects is None or isinstance(subjects, str):
        return
    if isinstance(subjects, bool):
        raise TypeError("subjects must be a count, an id or a sequence of ids")
    if isinstance(subjects, int):
        if subjects < 1:
            raise ValueError("a count of subjects must be at least 1")
        return
    if not all(isinstance(s, str) for s in subjects):
        raise TypeError("subjects must be a count, an id or a sequence of ids")


def check_study(study_id: str, bucket: str, prefix: str) -> None:
    """Raise where a study parameter is not text."""
    for name, value in (("study_id", study_id), ("bucket", bucket), ("prefix", prefix)):
        if not isinstance(value, str):
            raise TypeError(f"{name} must be a string")


def requested(subjects: Subjects, spark) -> DataFrame | None:
    """The ids named by a selection, or None for counts and ``"all"``."""
    if subjects is None or isinstance(subjects, int) or subjects == "all":
        return None
    names = [subjects] if isinstance(subjects, str) else sorted(set(subjects))
    return spark.createDataFrame([(s,) for s in names], "subject_id string")


def select_subjects(roster: DataFrame, subjects: Subjects = None) -> DataFrame:
    """The first subject, the first N, all, one or a list of them, by id order."""
    check_subjects(subjects)
    wanted = requested(subjects, roster.sparkSession)
    if wanted is not None:
        return roster.join(wanted, "subject_id", "left_semi")
    if subjects == "all":
        return roster
    return roster.orderBy("subject_id").limit(subjects or 1)


def unknown_subjects(wanted: DataFrame, roster: DataFrame) -> DataFrame:
    """Requested ids the study does not have."""
    return wanted.select("subject_id").distinct().join(roster, "subject_id", "left_anti")


def raise_unknown(wanted: DataFrame, roster: DataFrame, shown: int = 20) -> None:
    """Raise with a few of the unknown ids, if there are any."""
    bad = [r.subject_id for r in unknown_subjects(wanted, roster).orderBy("subject_id").limit(shown).collect()]
    if bad:
        raise ValueError(f"not in the study: {', '.join(bad)}")


def first_valid(validity: DataFrame, n: int) -> DataFrame:
    """The first N valid subjects by id, later ones standing in for invalid ones; fewer if there are not enough."""
    check_subjects(n)
    return validity.filter("valid").orderBy("subject_id").limit(n)


def first_valid_of(subjects: DataFrame, validate: Callable[[DataFrame], DataFrame], n: int, first_batch: int | None = None) -> DataFrame:
    """The first N valid subjects by id, where validity is found out batch by batch until there are enough: ``(subject_id, valid)``.

    ``validate`` takes a table of subject ids and says ``(subject_id, valid)`` of each. Batches are the next ids in order, each twice
    as large as the one before, so not many more subjects than needed are looked at, and very few batches if most
    are invalid. The result is that of ``first_valid`` over all subjects. Repeated ids count once.
    """
    check_subjects(n)
    left = subjects.select("subject_id").where("subject_id is not null").distinct()
    size, found, parts = first_batch or n, 0, []
    while found < n:
        batch = settled(left.orderBy("subject_id").limit(size), "batch")
        passed = settled(validate(batch).where("valid").select("subject_id", "valid"), "valid")
        parts.append(passed)
        count, last = batch.agg(F.count(F.lit(1)), F.max("subject_id")).first()
        if count < size:
            break
        found += passed.count()
        left, size = left.where(F.col("subject_id") > last), 2 * size
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("subject_id").limit(n)


def selection_counts(validity: DataFrame) -> DataFrame:
    """How many subjects were asked for, are valid, and were discarded."""
    return validity.agg(
        F.count(F.lit(1)).alias("n_requested"),
        F.count_if("valid").alias("n_valid"),
        F.count_if(~F.col("valid")).alias("n_discarded"),
    )
