import pytest
from pyspark.sql import functions as F

from dwitable.functions import paths as P
from dwitable.sinks import layout as L


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("path, parts", [
    ("a/b.nii.gz", ["a/b", ".nii", ".gz"]),
    ("b", ["b"]),
    ("a.b/c", ["a.b/c"]),
    ("a.b/c.txt", ["a.b/c", ".txt"]),
    ("d/.hidden", ["d/.hidden"]),
    ("d/.hidden.json", ["d/.hidden", ".json"]),
    ("x..y", ["x", ".", ".y"]),
])
def test_split_extensions(spark, path, parts):
    assert one(spark, P.split_extensions("p"), p=path) == parts


@pytest.mark.parametrize("ext, names", [
    ("", ["a", "a.b", "a.b.c"]), ("json", ["a.json", "a.b.json", "a.b.c.json"]), (".json", ["a.json", "a.b.json", "a.b.c.json"]),
])
def test_cumulative_paths(spark, ext, names):
    assert one(spark, P.cumulative_paths("p", ext), p=["a", ".b", ".c"]) == names


@pytest.mark.parametrize("path, session", [
    ("s/sub-1/ses-01/dwi/x", "ses-01"), ("s/sub-1/ses-/dwi/x", "ses-"), ("s/sub-1/dwi/x", "null"),
    ("s/ses-a/ses-b/x", "ses-a"), ("s/ses-a_b/x", "null"),
])
def test_session_id(spark, path, session):
    assert one(spark, P.session_id("p"), p=path) == session


@pytest.mark.parametrize("path, suffixed, replaced", [
    ("d/x.nii.gz", "d/x_t.nii.gz", "/w/x_t"), ("d/x.bvec", "d/x_t.bvec", "/w/x_t"), ("x", "x_t", "/w/x_t"),
    ("d.e/x.a.b", "d.e/x.a_t.b", "/w/x.a_t"), ("d/.rc", "d/.rc_t", "/w/.rc_t"),
])
def test_with_suffix(spark, path, suffixed, replaced):
    assert one(spark, P.with_suffix("p", "_t"), p=path) == suffixed
    assert one(spark, P.with_suffix("p", "_t", new_dir="/w", use_ext=False), p=path) == replaced


def test_target_path_takes_the_part_after_the_last_site(spark):
    key = "data/Site-A/x/Site-A/sub-1/f"
    assert one(spark, P.target_path("k", "s", "/out/"), k=key, s="Site-A") == "/out/sub-1/f"
    assert one(spark, P.target_path("k", "s", "/out", True), k=key, s="Site-A") == "/out/Site-A/sub-1/f"


def test_subject_token_needs_its_prefix(spark):
    assert one(spark, P.subject_token("p"), p="d/sub-7_acq_dwi.nii.gz") == "sub-7"
    assert one(spark, P.subject_token("p"), p="d/s7_dwi.nii.gz") is None


def test_eddy_names(spark):
    assert one(spark, P.eddy_base("p"), p="w/a_fix.nii.gz") == "w/a"
    assert one(spark, P.qc_dir("p"), p="w/a_fix.nii.gz") == "w/a_fix.qc"


def test_encode_component_leaves_what_browsers_leave(spark):
    assert one(spark, P.encode_component("p"), p="a b+/=!'()*~-_.") == "a%20b%2B%2F%3D!'()*~-_."


def test_report_address_round_trip(spark):
    url = P.report_url("b", "k")
    assert one(spark, P.report_key(url, "b"), b="bucket", k="sub-1/r.json") == "sub-1/r.json"
    assert one(spark, P.report_key(F.lit("https://elsewhere/x"), "b"), b="bucket") is None


def test_long_names_are_replaced_before_short_ones(spark):
    base = "sub-1_acq_dwi"
    name = one(spark, L.named("p", F.lit(base), F.lit("sub-1")), p="dwi/vol0000_flirt_merged.nii.gz")
    assert name == f"dwi/{base}.nii.gz"
    name = one(spark, L.named("p", F.lit(base), F.lit("sub-1")), p="derivatives/dwitable/dti/eddy_corrected_maths.nii.gz")
    assert name == "derivatives/sub-1/dwitable/dti/sub-1_acq_scaled.nii.gz"


def test_cumulative_paths_compute_their_parts_once(spark):
    keys = spark.createDataFrame([("a/b.nii.gz",), (None,)], "key string")
    named = keys.select(P.cumulative_paths(P.split_extensions("key"), "json").alias("names"))
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:.*/)?") == 2  # the stem, and what follows it
    assert [r[0] for r in named.collect()] == [["a/b.json", "a/b.nii.json", "a/b.nii.gz.json"], None]
