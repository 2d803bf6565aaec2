"""Small tables that become many rows: the work is dealt out by rows, and numbers do not overflow."""

import pytest
from pyspark.sql import functions as F

from dwitable import session
from dwitable.operators import manifest as MF
from dwitable.operators import sessions as S
from dwitable.operators import voxels as VX
from dwitable.sources import listing as LS
from workload import fixtures as FX


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, i % 25, 100.0 * i, ("AUTOMOBILE", "BUILDING", "MACHINERY")[i % 3]) for i in range(60)]
    customers = spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    customers.coalesce(1).write.parquet(f"{path}/customer.parquet")
    return path


def test_customers_are_dealt_out_before_they_become_keys(spark, folder, monkeypatch):
    usual = FX._load(spark, folder, "object_keys")
    monkeypatch.setattr(FX, "SPREAD_ROWS", 10)
    spread = FX._load(spark, folder, "object_keys")
    assert usual.rdd.getNumPartitions() == 1 and spread.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, usual.collect()))


def test_tokens_of_long_listings(spark, folder, monkeypatch):
    """The tokens of a listing of hundreds of thousands of pages pass 32 bits; a larger factor stands for more pages."""
    needs, sql = FX.FIXTURES["listing_responses"]
    usual = {(r["bucket"], r["position"]): r["xml"].split("<Key>")[1:] for r in LS.chained_pages(FX.load(spark, folder, "listing_responses")).collect()}
    monkeypatch.setitem(FX.FIXTURES, "listing_responses", (needs, sql.replace("7919", "2000000011")))
    found = {(r["bucket"], r["position"]): r["xml"].split("<Key>")[1:] for r in LS.chained_pages(FX.load(spark, folder, "listing_responses")).collect()}
    assert found.keys() == usual.keys() and len(found) > 100
    assert all(found[p] == usual[p] for p in usual if p[1] is not None)


def test_frames_are_dealt_out_by_pixels(spark, monkeypatch):
    image = spark.range(12).select(F.col("id").alias("subject"), *[F.lit(1).alias(a) for a in ("i", "j", "k")], F.lit(2.0).alias("value"))
    monkeypatch.setattr(VX, "TASK_PIXELS", 200)
    found = VX.padded(image, VX.image_dims(image), F.lit(10), {"k": VX.upto("nk")})
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 12 * 2 * 100 and max(sizes) < 500
    assert {r["subject"]: r["total"] for r in found.groupBy("subject").agg(F.sum("value").alias("total")).collect()} == {i: 2.0 for i in range(12)}


def test_keys_are_put_together_once(spark, folder):
    plan = FX.load(spark, folder, "sited")._jdf.queryExecution().optimizedPlan().toString()
    assert "data/Projects" not in plan and "Generate" not in plan
    assert FX.load(spark, folder, "object_keys").dtypes == FX._load(spark, folder, "object_keys").dtypes


def test_entities_are_searched_once(spark):
    keys = spark.createDataFrame([("sub-1", "a/sub-1/dwi/sub-1_dwi.nii.gz")], "subject_id string, key string")
    found = MF.workflow_inputs(MF.workflow_roles(MF.bids_files(keys)), "/bids", "/out")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 12
    assert MF.workflow_roles(MF.bids_files(keys)).first()["role"] == "dwi"


def test_subjects_are_dealt_out_by_their_files(spark, monkeypatch):
    """A task takes as many files whatever the table's size, and a sidecar with two directions counts as the later one."""
    places = {"epi_nii": ("fmap", "epi.nii.gz"), "epi_json": ("fmap", "epi.json")}
    epi = [(f"sub-{i}", role, f"sub-{i}/fmap/dir-{d}_{tail}") for i in range(30) for d in ("AP", "PA") for role, (_, tail) in places.items()]
    rest = [(f"sub-{i}", role, f"sub-{i}/x/{role}") for i in range(30) for role in ("dwi", "bvec", "bval", "t1w", "freesurfer") if i % 5 or role != "t1w"]
    files = spark.createDataFrame(epi + rest, "subject_id string, role string, key string")
    stated = [(s, k, None if s == "sub-1" else "PA" if "PA" in k else "AP") for s, r, k in epi if r == "epi_json"]
    stated += [("sub-2", "sub-2/fmap/dir-AP_epi.json", "PA"), ("sub-3", "sub-3/fmap/dir-AP_epi.json", None)]
    directions = spark.createDataFrame(stated, "subject_id string, key string, direction string")
    people = spark.createDataFrame([(f"sub-{i}",) for i in range(31)], "subject_id string")
    found = {}
    for rows in (10, 100_000):
        monkeypatch.setattr(session, "DEALT_ROWS", rows)
        checks, validity = S.subject_checks(files, directions), MF.subject_validity(people, files)
        parts = -(-len(epi + rest) // rows)
        assert checks.rdd.getNumPartitions() == validity.rdd.getNumPartitions() == parts
        assert "SortAggregate" not in checks._jdf.queryExecution().executedPlan().toString()
        found[rows] = {tuple(r) for r in S.reasons_of(validity, checks).collect()}
    expected = {f"sub-{i}": "missing_files" if i % 5 == 0 else None for i in range(31)}
    expected |= {"sub-1": "no_direction", "sub-2": "session_mismatch"}
    assert found[10] == found[100_000] == set(expected.items())
