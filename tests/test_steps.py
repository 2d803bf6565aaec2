"""Steps as table functions, validity with an early stop, and orientations of sheared affines."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dwitable.operators import roster as R
from dwitable.operators import voxels as V
from dwitable.operators.profile import StudyProfile
from dwitable.operators.steps import SubjectStep, as_step, register_step


def running():
    class Running(SubjectStep):
        def __init__(self):
            self.total = 0

        @staticmethod
        def schema(given):
            return StructType([*given.fields, StructField("total", LongType())])

        def row(self, row):
            self.total += row["v"]
            yield (*row, self.total)

    return Running


def test_a_step_from_sql_and_from_a_flow(spark):
    rows = [(s, n, (s * 7 + n * n) % 11) for s in range(6) for n in range(20)]
    df = spark.createDataFrame(rows, "subject long, n long, v long").repartition(5)
    want = sorted((s, n, v, sum(x[2] for x in rows if x[0] == s and x[1] <= n)) for s, n, v in rows)
    register_step(spark, "running_total", running(), ["n"])
    df.createOrReplaceTempView("measured")
    assert sorted(map(tuple, spark.sql("SELECT * FROM running_total(TABLE(measured))").collect())) == want
    profile = StudyProfile("x", "b", steps={"gradients": (as_step(running(), ["n"]), lambda t: t.where("total > 20"))})
    assert sorted(map(tuple, profile.own_steps("gradients", df).collect())) == [w for w in want if w[3] > 20]
    assert spark.sql("SELECT max(total) AS m FROM running_total(TABLE(SELECT * FROM measured WHERE subject = 3))").first().m == max(w[3] for w in want if w[0] == 3)


def test_a_step_refuses_a_table_without_its_columns(spark):
    with pytest.raises(Exception, match="no column n"):
        as_step(running(), ["n"])(spark.createDataFrame([(1, 2)], "subject long, v long")).collect()


def test_few_batches_are_validated(spark):
    subjects = spark.range(1_000_000).select(F.format_string("sub-%07d", "id").alias("subject_id"))
    looked = []

    def validate(batch):
        seen = Observation()
        looked.append(seen)
        number = F.substring("subject_id", 5, 7).cast("int")
        return batch.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("valid", number % 3 != 0)

    found = [r.subject_id for r in R.first_valid_of(subjects, validate, 40).orderBy("subject_id").collect()]
    assert found == [f"sub-{i:07d}" for i in range(1000) if i % 3][:40]
    assert sum(o.get["n"] for o in looked) == 40 + 80


def test_staged_validity_equals_filter_then_limit(spark):
    valid = {f"s{i:03d}": i % 7 == 3 for i in range(100)}
    rows = [(s,) for s in valid] * 2 + [(None,)]
    subjects = spark.createDataFrame(rows, "subject_id string")
    table = spark.createDataFrame(list(valid.items()), "subject_id string, valid boolean")
    for n, batch in ((1, None), (5, 2), (14, 3), (40, None), (200, None)):
        got = sorted(r.subject_id for r in R.first_valid_of(subjects, lambda b: table.join(b, "subject_id", "left_semi"), n, batch).collect())
        assert got == sorted(r.subject_id for r in R.first_valid(table, n).collect()), n


def plain_axes(a):
    """Axis and direction of each voxel axis, through a singular value decomposition."""
    zooms = np.sqrt((a * a).sum(axis=0))
    zooms[zooms == 0] = 1
    p, s, q = np.linalg.svd(a / zooms)
    r = p @ q
    free, out = r.copy(), []
    for axis in range(3):
        world = int(np.argmax(np.abs(free[:, axis])))
        out.append((world, -1 if r[world, axis] < 0 else 1))
        free[world] = 0
    return r, out


def test_axes_of_sheared_affines(spark):
    rnd = np.random.default_rng(1)
    mats = [rnd.normal(size=(3, 3)) * rnd.uniform(0.5, 4, 3) for _ in range(400)]
    mats += [np.diag(d).astype(float) for d in ((2, 2, 3), (-2, 2, 3), (1, 1, 1))] + [np.array([[0, 0, -3.0], [2, 0, 0], [0, 1, 0]])]
    names = [f"a{r}{c}" for r in range(3) for c in range(3)]
    df = spark.createDataFrame([(n, *map(float, m.reshape(-1))) for n, m in enumerate(mats)], "subject long, " + ", ".join(f"{n} double" for n in names))
    turned = {r.subject: np.array([[r[f"r{x}{y}"] for y in range(3)] for x in range(3)]) for r in V.with_rotation(df).collect()}
    axes = {r.subject: [(r[f"w{k}"], r[f"s{k}"]) for k in range(3)] for r in V.orientation(df).collect()}
    leaning = 0
    for n, m in enumerate(mats):
        r, want = plain_axes(m)
        assert np.allclose(turned[n], r, atol=1e-4) and axes[n] == want
        leaning += want[0][0] != int(np.argmax(np.abs(m[:, 0])))
    assert leaning > 20
    flat = df.where("subject = 0").withColumns({n: F.lit(0.0) for n in ("a02", "a12", "a22")})
    assert V.orientation(flat).count() == 1
