import math

import pytest
from pyspark.sql import functions as F

from dwitable.operators import volumes as V
from dwitable.sinks import layout as L
from dwitable.sinks import text as K
from dwitable.sources import keys as KS
from dwitable.sources import listing as LS
from dwitable.sources import text as TX

GOOD = "Slice 3 in scan 12 is an outlier with mean -4.25 standard deviations off, and mean squared 7.5 standard deviations off."


def test_matrix_files_keep_row_order(spark, tmp_path):
    (tmp_path / "a.bvec").write_text("0 0.5  1\n1 -2e-3 3\n\n4 5 6\n")
    got = TX.read_matrix(spark, str(tmp_path / "a.bvec")).orderBy("row", "col").collect()
    assert [r.value for r in got] == [0, 0.5, 1, 1, -2e-3, 3, 4, 5, 6]
    vectors = TX.b_vectors(TX.read_matrix(spark, str(tmp_path / "a.bvec")).withColumn("row", F.when(F.col("row") == 3, 2).otherwise(F.col("row"))).drop("path"))
    assert [(r.gx, r.gy, r.gz) for r in vectors.orderBy("vol").collect()] == [(0, 1, 4), (0.5, -2e-3, 5), (1, 3, 6)]


def test_bvalues_in_a_row_or_a_column(spark, tmp_path):
    (tmp_path / "row.bval").write_text("0 1000 2000\n")
    (tmp_path / "col.bval").write_text("0\n1000\n2000\n")
    for name in ("row.bval", "col.bval"):
        got = TX.b_values(TX.read_matrix(spark, str(tmp_path / name))).orderBy("vol").collect()
        assert [(r.vol, r.bval) for r in got] == [(0, 0), (1, 1000), (2, 2000)]


def test_bad_numbers_raise_or_become_nan(spark, tmp_path):
    (tmp_path / "rms").write_text("1 n/a\n2 3\n")
    got = TX.read_table_lenient(spark, str(tmp_path / "rms")).orderBy("row", "col").collect()
    assert [("nan" if math.isnan(r.value) else r.value) for r in got] == [1, "nan", 2, 3]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed"):
        TX.read_matrix(spark, str(tmp_path / "rms")).collect()


def test_lines_are_verbatim(spark, tmp_path):
    (tmp_path / "r.txt").write_text("  first \n\nthird\n")
    got = TX.read_lines(spark, str(tmp_path / "r.txt")).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(0, "  first "), (1, ""), (2, "third")]


def test_written_lines_are_ordered_and_cut_into_blocks(spark, tmp_path):
    lines = spark.createDataFrame([(1, v, f"v{v}") for v in reversed(range(10))], "subject int, vol long, line string")
    K.write_lines(lines, str(tmp_path / "out"), "vol", width=4)
    read = TX.read_written_lines(spark, str(tmp_path / "out")).orderBy("first", "line_no").collect()
    assert [r.line for r in read] == [f"v{v}" for v in range(10)]
    assert {r.first for r in read} == {0, 4, 8}


def test_matrix_text_reads_back_the_same_doubles(spark):
    values = [0.1, -1 / 3, 1e-17, 123456.789, 2.0**-40]
    df = spark.createDataFrame([(1, n, v, -v, v * v) for n, v in enumerate(values)], "subject int, vol long, gx double, gy double, gz double")
    lines = K.vector_lines(df, width=2).withColumnRenamed("axis", "line_no")
    got = TX.b_vectors(TX.matrix_entries(lines)).orderBy("vol").collect()
    assert [(r.gx, r.gy, r.gz) for r in got] == [(v, -v, v * v) for v in values]


def test_scans_longer_than_a_block_read_back_whole(spark, tmp_path):
    df = spark.range(5000).select(F.lit(1).alias("subject"), F.col("id").alias("vol"), *[
        (F.col("id") + n / 4).alias(a) for n, a in enumerate(("gx", "gy", "gz"))])
    df = df.unionByName(df.filter("vol < 3").withColumn("subject", F.lit(2)))
    K.write_lines(K.vector_lines(df), str(tmp_path / "v"), "axis")
    got = TX.b_vectors(TX.matrix_entries(TX.read_written_lines(spark, str(tmp_path / "v"))))
    assert sorted((r.subject, r.vol, r.gx, r.gy, r.gz) for r in got.collect()) == sorted(
        (s, v, float(v), v + 0.25, v + 0.5) for s, n in ((1, 5000), (2, 3)) for v in range(n))
    K.write_lines(K.vector_lines(df.withColumn("bval", F.col("gx")), ("bval",), 64), str(tmp_path / "b"), "axis")
    got = TX.b_values(TX.matrix_entries(TX.read_written_lines(spark, str(tmp_path / "b")))).filter("subject = 1")
    assert sorted((r.vol, r.bval) for r in got.collect()) == [(v, float(v)) for v in range(5000)]


def test_files_do_not_grow_with_subjects(spark, tmp_path):
    lines = spark.range(3000).select((F.col("id") / 3).cast("long").alias("subject"), (F.col("id") % 3).alias("vol"), F.lit("x").alias("line"))
    K.write_lines(lines, str(tmp_path / "l"), "vol", buckets=16)
    assert len(list((tmp_path / "l").rglob("part-*.json"))) <= 16
    rows = spark.range(500).select((F.col("id") % 10).alias("subject_id"), (F.col("id") % 3).alias("category"), F.col("id").alias("v"))
    L.write_by_category(rows, str(tmp_path / "k"))
    assert len(list((tmp_path / "k").rglob("part-*.parquet"))) == 30
    L.write_by_category(rows, str(tmp_path / "large"), file_rows=5)
    assert spark.read.parquet(str(tmp_path / "large")).count() == 500


def test_subjects_are_found_wherever_they_lie(spark):
    paths = {
        "data/MRI/S/sub-1/dwi/x": ("sub-1", "S", "raw"), "data/MRI/S/derivatives/sub-1/T1w": ("sub-1", "S", "deriv"),
        "ds/derivatives/tool/sub-2/a/b": ("sub-2", "ds", "deriv"), "sub-3/dwi/x": ("sub-3", None, "raw"),
        "derivatives/tool/sub-3/x": ("sub-3", None, "deriv"), "a/sub-4/sub-5/x": ("sub-4", "a", "raw"),
    }
    other = ["README", "a/b/c", "a/sub-6", "xsub-1/y"]
    keys = spark.createDataFrame([(p,) for p in [*paths, *other]], "key string")
    assert {r.key: (r.subject_id, r.site, r.rd) for r in KS.placed_keys(keys).collect()} == paths
    assert sorted(r.key for r in KS.unplaced_keys(keys).collect()) == sorted(other)
    roster = spark.createDataFrame([("sub-1", "S"), ("sub-2", "S"), ("sub-3", None)], "subject_id string, site string")
    got = sorted(r.key for r in KS.subject_keys(roster, keys).collect())
    assert got == sorted(p for p, (s, _, _) in paths.items() if s in ("sub-1", "sub-3"))


def test_motion_lines_have_rotations_first(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "subject int, vol long, rx double, ry double, rz double, tx double, ty double, tz double")
    assert K.motion_lines(df).first().line == "1.000000 2.000000 3.000000 4.000000 5.000000 6.000000 "


def test_fixed_lines(spark):
    df = spark.createDataFrame([(1.0, -2.5)], "a double, b double")
    assert df.select(K.fixed_line(("a", "b")).alias("x")).first().x == "1.000000 -2.500000 "


def test_outlier_lines(spark):
    df = spark.createDataFrame([(1, GOOD), (1, GOOD + "\n")], "subject int, line string")
    row = V.parse_outliers(df).collect()
    assert [(r.slice, r.scan, r.mean_sd, r.mean_sq_sd) for r in row] == [(3, 12, -4.25, 7.5)] * 2


def test_other_lines_raise_or_are_set_aside(spark):
    df = spark.createDataFrame([(1, GOOD), (1, "Slice x"), (2, None)], "subject int, line string")
    assert V.parse_outliers(df, strict=False).count() == 1
    assert V.rejected_lines(df).count() == 2
    with pytest.raises(Exception, match="not an outlier line"):
        V.parse_outliers(df.filter("line IS NOT NULL")).collect()


def test_threshold_forms(spark):
    rows = [(1, 5, s) for s in range(3)] + [(1, 6, 0)] + [(2, 5, s) for s in range(2)]
    outliers = spark.createDataFrame(rows, "subject int, scan int, slice int")
    slices = spark.createDataFrame([(1, 10), (2, 10)], "subject int, n_slices int")

    def dropped(threshold, with_slices=True):
        return sorted(map(tuple, V.dropped_scans(outliers, threshold, slices if with_slices else None).collect()))

    assert dropped(2, False) == [(1, 5)]
    assert dropped(0, False) == [(1, 5), (1, 6), (2, 5)]
    assert dropped(1, False) == dropped(1.0, False) == [(1, 5), (2, 5)]
    assert dropped(0.2) == [(1, 5)]
    assert dropped(0.1) == [(1, 5), (2, 5)]
    assert dropped(0.5, False) == [(1, 5), (2, 5)]  # of the highest slice each report names


def test_dropping_nothing_changes_nothing(spark):
    volumes = spark.createDataFrame([(1, v, 1.0) for v in range(5)], "subject int, vol long, bval double")
    none = volumes.select("subject", "vol").filter("false")
    assert sorted(map(tuple, V.drop_gradients(volumes, none).select("subject", "vol").collect())) == [(1, v) for v in range(5)]


def test_participants_with_a_tab(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("participant_id\tage\nsub-1\t3\nsub-1\t3\nsub-2\t4\n")
    got = TX.read_participants(spark, str(tmp_path / "p.tsv"))
    assert sorted(r.participant_id for r in got.collect()) == ["sub-1", "sub-2"]


def test_files_below_a_directory(spark, tmp_path):
    (tmp_path / "sub-1" / "dwitable" / "dwi").mkdir(parents=True)
    (tmp_path / "sub-1" / "other").mkdir()
    (tmp_path / "sub-1" / "dwitable" / "dwi" / "a.txt").write_text("abc")
    (tmp_path / "sub-1" / "other" / "b.txt").write_text("")
    listed = KS.list_files(spark, str(tmp_path)).withColumn("key", F.regexp_replace("key", "^file:", ""))
    got = KS.output_files(listed.select("key"), str(tmp_path), L.PIPELINE).collect()
    assert [r.object_key for r in got] == ["sub-1/dwitable/dwi/a.txt"]
    assert KS.output_files(listed.select("key"), str(tmp_path), L.PIPELINE, "sub-2").count() == 0


def test_exact_subject_segments(spark):
    keys = spark.createDataFrame([("m/S/sub-A1/dwi/x",), ("m/S/sub-A12/dwi/x",), ("m/S/derivatives/sub-A1/T1w.nii.gz",)], "key string")
    roster = spark.createDataFrame([("sub-A1", "S")], "subject_id string, site string")
    got = sorted((r.key, r.rd) for r in KS.subject_keys(roster, keys).collect())
    assert got == [("m/S/derivatives/sub-A1/T1w.nii.gz", "deriv"), ("m/S/sub-A1/dwi/x", "raw")]


def test_listing_with_namespace_and_without_token(spark):
    xml = ('<?xml version="1.0"?><ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><IsTruncated>false</IsTruncated>'
           "<Contents><Key>a/b_report.json</Key></Contents><Contents><Key>a/c.txt</Key></Contents></ListBucketResult>")
    pages = spark.createDataFrame([("b", xml)], "bucket string, xml string")
    row = LS.parse_pages(pages).first()
    assert (row["keys"], row.truncated, row.token) == (["a/b_report.json", "a/c.txt"], False, None)
    assert [r.key for r in LS.manifest(pages).collect()] == ["a/b_report.json"]


def test_reports_read_from_files(spark, tmp_path):
    (tmp_path / "a_report.json").write_text('{"outlier_volumes": [1],\n "eddy_quad": {"qc_mot_abs": 0.5}}')
    (tmp_path / "b_report.json").write_text('{"outlier_volumes": [2]}')
    schema = "outlier_volumes array<long>, eddy_quad struct<qc_mot_abs:double>"
    assert [r.outlier_volumes for r in LS.read_reports(spark, str(tmp_path), schema).collect()] == [[1]]
    (tmp_path / "qc.json").write_text('{"qc_mot_abs": 1.5,\n "qc_mot_rel": 0.25}')
    row = TX.read_qc(spark, str(tmp_path / "qc.json")).first()
    assert (row.qc_mot_abs, row.qc_mot_rel) == (1.5, 0.25)
