"""Writes that add: other subjects stay, failed writes change nothing, interrupted ones are finished."""

import pytest
from pyspark.sql import functions as F

from dwitable.sinks import layout as L
from dwitable.sinks import replace as RP
from dwitable.sinks import text as K
from dwitable.sources import text as TX


def rows(spark, subjects, value):
    return spark.createDataFrame([(s, c, value) for s in subjects for c in ("dwi", "qc")], "subject_id string, category string, v long")


def held(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("subject_id", "category", "v").collect())


def test_another_subject_leaves_the_first(spark, tmp_path):
    path = str(tmp_path / "out")
    L.write_by_category(rows(spark, "A", 1), path)
    L.write_by_category(rows(spark, "BC", 2), path)
    assert held(spark, path) == [(s, c, v) for s, v in (("A", 1), ("B", 2), ("C", 2)) for c in ("dwi", "qc")]
    L.write_by_category(rows(spark, "B", 3).where("category = 'qc'"), path)
    assert held(spark, path) == [("A", "dwi", 1), ("A", "qc", 1), ("B", "dwi", 2), ("B", "qc", 3), ("C", "dwi", 2), ("C", "qc", 2)]
    assert not list((tmp_path / "out" / RP.STAGED).glob("*")) and not list((tmp_path / "out" / RP.COMMITS).glob("*"))


def test_a_failed_write_leaves_the_former_version(spark, tmp_path):
    path = str(tmp_path / "out")
    L.write_by_category(rows(spark, "AB", 1), path)
    bad = rows(spark, "ABC", 2).withColumn("v", F.when(F.col("subject_id") == "C", F.raise_error(F.lit("disk full"))).otherwise(F.col("v")).cast("long"))
    with pytest.raises(Exception, match="disk full"):
        L.write_by_category(bad, path)
    assert held(spark, path) == [(s, c, 1) for s in "AB" for c in ("dwi", "qc")]
    L.write_by_category(rows(spark, "C", 4), path)
    assert ("C", "qc", 4) in held(spark, path) and len(held(spark, path)) == 6


def test_an_interrupted_move_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    L.write_by_category(rows(spark, "AB", 1), path)
    move, moved = RP._Folder.move, []

    def some(self, source, target):
        if source.startswith(RP.STAGED) and not source.endswith(".draft"):
            if len(moved) == 2:
                raise OSError("lost")
            moved.append(source)
        move(self, source, target)

    monkeypatch.setattr(RP._Folder, "move", some)
    with pytest.raises(OSError, match="lost"):
        L.write_by_category(rows(spark, "ABC", 2), path)
    monkeypatch.undo()
    assert {v for *_, v in held(spark, path)} == {1, 2}
    assert RP.recover(spark, path) == 1 and RP.recover(spark, path) == 0
    assert held(spark, path) == [(s, c, 2) for s in "ABC" for c in ("dwi", "qc")]


def many(spark, n, value):
    return spark.range(n).select(F.col("id").alias("subject_id"), F.lit("dwi").alias("category"), F.lit(value).cast("long").alias("v"))


def values(spark, path):
    return sorted((r["subject_id"], r["v"]) for r in spark.read.parquet(path).collect())


def test_many_directories_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "out")
    L.write_by_category(many(spark, 300, 1), path)
    files = list((tmp_path / "out").glob("subject_id=*/category=dwi/*.parquet"))
    assert len(files) == 300 and len({f.name.split("-")[1] for f in files}) >= 300 // L.TASK_PARTS
    L.write_by_category(many(spark, 200, 2), path)
    assert values(spark, path) == [(n, 2 if n < 200 else 1) for n in range(300)]


def test_many_moves_are_finished_after_a_failure(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    L.write_by_category(many(spark, 300, 1), path)
    move, tried = RP._Folder.move, []

    def some(self, source, target):
        tried.append(source)
        if len(tried) > 150:
            raise OSError("lost")
        move(self, source, target)

    monkeypatch.setattr(RP._Folder, "move", some)
    with pytest.raises(OSError, match="lost"):
        L.write_by_category(many(spark, 300, 2), path)
    monkeypatch.undo()
    assert RP.recover(spark, path) == 1
    assert values(spark, path) == [(n, 2) for n in range(300)]


def test_a_class_is_looked_up_once(spark, tmp_path):
    folder = RP._Folder(spark, str(tmp_path))
    folder.jvm = None
    assert folder.path("a").toString().endswith("/a") and not folder.exists("a")


def lines_of(spark, path):
    return sorted((r.subject, r.line_no, r.line) for r in TX.read_written_lines(spark, path).collect())


def test_lines_of_other_subjects_in_the_same_folder_stay(spark, tmp_path):
    path = str(tmp_path / "lines")
    make = lambda subjects, word: spark.createDataFrame([(s, n, f"{word} {s} {n}") for s in subjects for n in range(3)], "subject long, vol long, line string")
    K.write_lines(make(range(20), "old"), path, "vol", width=2, buckets=3)
    K.write_lines(make([4, 30], "new"), path, "vol", width=2, buckets=64)
    want = {s: "new" if s in (4, 30) else "old" for s in [*range(20), 30]}
    assert lines_of(spark, path) == sorted((s, n, f"{w} {s} {n}") for s, w in want.items() for n in range(3))
    assert len(list((tmp_path / "lines").glob("bucket=*"))) == 3
    K.write_lines(make([], "x"), path, "vol", subjects=spark.createDataFrame([(s,) for s in range(19)], "subject long"))
    assert {s for s, *_ in lines_of(spark, path)} == {19, 30}


def test_documents_of_other_keys_stay(spark, tmp_path):
    path = str(tmp_path / "docs")
    K.write_json(spark.createDataFrame([("a", 1, 0.5), ("a", 2, None), ("b", 1, 2.5)], "bucket string, subject long, x double"), path, ("bucket", "subject"))
    K.write_json(spark.createDataFrame([("a", 1, 9.0), ("a", None, 3.0)], "bucket string, subject long, x double"), path, ("bucket", "subject"))
    K.write_json(spark.createDataFrame([("a", None, 4.0)], "bucket string, subject long, x double"), path, ("bucket", "subject"))
    found = spark.read.schema("bucket string, subject long, x double").json(path).collect()
    assert sorted((r["bucket"], r["subject"] or 0, r["x"] or 0) for r in found) == [("a", 0, 4.0), ("a", 1, 9.0), ("a", 2, 0), ("b", 1, 2.5)]
