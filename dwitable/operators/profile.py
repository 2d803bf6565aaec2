"""Study profiles: what differs from study to study."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwitable.functions import paths as P
from dwitable.operators import manifest, roster

Step = Callable[[DataFrame], DataFrame]

STEP_TABLES = ("files", "transfers", "outliers", "gradients")


def unchanged(df: DataFrame) -> DataFrame:
    """The step that does nothing."""
    return df


@dataclass(frozen=True)
class StudyProfile:
    """Sites in order, key prefix, roster rule, key filter, path rewrite and own steps of a study.

    ``steps`` are functions from table to table that a user plugs into a flow, by the table's name: ``files`` (the classified keys)
    and ``transfers`` (what is to be fetched) in ``plans.study.acquire``, ``outliers`` and ``gradients`` in
    ``thinned_gradients``. They run in order.
    """

    study_id: str
    bucket: str
    prefix: str = ""
    sites: tuple[str, ...] = ()
    roster: Callable[[DataFrame], DataFrame] | None = None
    key_filter: Step = unchanged
    path_rewrite: Callable[[Column, Column], Column] = field(default=lambda path, site: path)
    steps: Mapping[str, tuple[Step, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        roster.check_study(self.study_id, self.bucket, self.prefix)
        unknown = set(self.steps) - set(STEP_TABLES)
        if unknown:
            raise ValueError(f"no flow has a table {', '.join(sorted(unknown))}")

    def keys(self, keys: DataFrame) -> DataFrame:
        """The object keys below the study's prefix; the filter reaches the scan."""
        return keys.filter(F.col("key").startswith(self.prefix)) if self.prefix else keys

    def own_steps(self, table: str, df: DataFrame) -> DataFrame:
        """The user's steps for one table of a flow, applied in order."""
        for step in self.steps.get(table, ()):
            df = step(df)
        return df

    def subjects(self, participants: DataFrame) -> DataFrame:
        """Roster of the study from its participant lists."""
        rule = self.roster or (lambda p: roster.study_roster(roster.site_roster(p), self.sites))
        return rule(participants)

    def rewrite(self, files: DataFrame, column: str = "target") -> DataFrame:
        """Apply the study's path rewrite."""
        return files.withColumn(column, self.path_rewrite(F.col(column), F.col("site")))


# The public multi-site study with one site whose anatomy sits one level deeper.
DEEP_SITE = "Site-CBIC"
DEEP_LEVEL = "T1w_VNavNorm"
MULTI_SITE = StudyProfile(
    study_id="HBN",
    bucket="fcp-indi",
    prefix="data/Projects/HBN/MRI",
    sites=("Site-CBIC", "Site-RU", "Site-SI"),
    key_filter=lambda files: manifest.keep_site_anatomy(files, DEEP_SITE, DEEP_LEVEL),
    path_rewrite=lambda path, site: P.drop_level(path, site, DEEP_SITE, DEEP_LEVEL),
)


def bids_profile(study_id: str, bucket: str, prefix: str = "") -> StudyProfile:
    """A study laid out as a plain BIDS tree, its roster read from the keys."""
    return StudyProfile(study_id, bucket, prefix, roster=lambda p: p.select("subject_id", "site").distinct())
