"""One subject holds most rows: results stay whole and the work of that subject is spread."""

import pytest
from pyspark.sql import functions as F

from dwitable.operators import indexing as I
from dwitable.operators import manifest as MF
from dwitable.operators import tensor as T
from dwitable.operators import volumes as V
from dwitable.operators import voxels as VX
from dwitable.sinks import text as K


def largest_share(df):
    """Largest share of all rows that one partition holds."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


@pytest.fixture(scope="module")
def hot(spark):
    """Twenty thousand volumes, nine of ten in subject 0."""
    return spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7 + 1).otherwise(F.lit(0)).alias("subject"), F.col("id").alias("vol")
    )


def test_pages_spread_a_hot_group(spark, hot):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert largest_share(I.paged(hot, ["subject"], ["vol"], 50)) < 0.3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbering_spreads_a_hot_group(spark, hot):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = I.ordered_index(hot, ["subject"], "vol", "n", width=100)
        assert largest_share(numbered) < 0.3
        ends = numbered.groupBy("subject").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count_distinct("n").alias("d"))
        assert all(r.lo == 0 and r.hi == r.c - 1 == r.d - 1 for r in ends.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_cartesian_product_and_no_collect_of_a_hot_subject(spark, hot):
    dropped = hot.filter("vol % 3 = 0")
    kept = V.reindexed(hot, dropped)
    assert kept.count() == hot.count() - dropped.count()
    lines = K.vector_lines(hot.filter("subject = 0").select("subject", "vol", *[F.lit(0.5).alias(a) for a in ("gx", "gy", "gz")]), width=500)
    assert lines.agg(F.max(F.length("line"))).first()[0] <= 500 * 25
    assert lines.agg(F.sum(F.size(F.split("line", " ")))).first()[0] == 3 * hot.filter("subject = 0").count()


@pytest.mark.parametrize("build", [
    lambda s, d: VX.grey_scale(d),
    lambda s, d: VX.foreground_mask(d),
    lambda s, d: VX.masked(d, d),
    lambda s, d: VX.padded(d, VX.image_dims(d), F.lit(8), {"k": VX.upto("nk")}),
    lambda s, d: T.fit_tensor(
        d.select("subject", F.xxhash64("i", "j").alias("voxel"), F.col("k").alias("vol"), F.col("value").alias("signal")),
        s.createDataFrame([(0, 1000.0, 1.0, 0.0, 0.0)], "vol int, bval double, gx double, gy double, gz double").withColumn("subject", F.lit(0)),
    ),
    lambda s, d: MF.register(d.select(F.col("subject").cast("string").alias("subject_id"), F.lit("dwi").alias("role"), F.col("i").cast("string").alias("key"))),
])
def test_plans_have_no_cartesian_product(spark, build):
    image = spark.createDataFrame([(0, i, j, k, float(i + j + k)) for i in range(4) for j in range(3) for k in range(2)],
                                  "subject int, i int, j int, k int, value double")
    plan = build(spark, image)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
