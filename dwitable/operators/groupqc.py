"""Group statistics of quality measures and each subject's place in its group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwitable.functions import maths as M
from dwitable.session import if_small, materialise

MEASURES = ("qc_mot_abs", "qc_mot_rel")


def group_statistics(qc: DataFrame, by: Sequence[str] = ("bucket",), measures: Sequence[str] = MEASURES) -> DataFrame:
    """Mean and sample deviation of each measure per group; NULL and NaN are skipped."""
    aggs = []
    for m in measures:
        v = F.when(~F.isnan(m), F.col(m))
        aggs += [F.avg(v).alias(f"mean_{m}"), F.stddev_samp(v).alias(f"std_{m}")]
    return qc.groupBy(*by).agg(*aggs)


def against_group(
    individuals: DataFrame, group: DataFrame, by: Sequence[str] = ("bucket",), measures: Sequence[str] = MEASURES
) -> DataFrame:
    """z-scores of individuals against given group statistics."""
    out = individuals.join(if_small(group), list(by))
    for m in measures:
        z = F.try_divide(F.col(m) - F.col(f"mean_{m}"), F.nullif(F.col(f"std_{m}"), F.lit(0.0)))
        out = out.withColumn(f"z_{m}", z)
    return out


def z_scores(qc: DataFrame, by: Sequence[str] = ("bucket",), measures: Sequence[str] = MEASURES) -> DataFrame:
    """z-score of every subject within its own group."""
    return against_group(qc, materialise(group_statistics(qc, by, measures), "group"), by, measures)


def with_display(scores: DataFrame, measures: Sequence[str] = MEASURES, high_is_good: bool = False) -> DataFrame:
    """Scale position, three-digit number and colour of each z-score."""
    out = scores
    for m in measures:
        z = f"z_{m}"
        out = (
            out.withColumn(f"pos_{m}", M.scale_z(z))
            .withColumn(f"text_{m}", M.significant(z))
            .withColumn(f"colour_{m}", M.z_colour(z, high_is_good))
        )
    return out
