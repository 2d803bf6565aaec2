import json
import random

import pytest
from pyspark.sql import functions as F

from dwitable.operators import directions as D
from dwitable.operators import groupqc as G
from dwitable.operators import manifest as MF
from dwitable.operators import report as RP
from dwitable.operators import roster as R
from dwitable.operators import sessions as S
from dwitable.operators.profile import MULTI_SITE, StudyProfile, bids_profile
from dwitable.sinks import layout as L
from dwitable.sinks import text as K
from dwitable.sources import listing as LS


def files(spark, rows):
    return spark.createDataFrame(rows, "subject_id string, role string, key string")


def test_roster_needs_both_lists_and_the_last_site_wins(spark):
    rows = [("A", "raw", "s1"), ("A", "deriv", "s1"), ("B", "raw", "s1"), ("B", "deriv", "s1"), ("B", "raw", "s2"), ("A", "raw", "s3"), ("B", "deriv", "s3")]
    both = R.site_roster(spark.createDataFrame(rows, "site string, rd string, participant_id string"))
    assert sorted(map(tuple, both.collect())) == [("A", "s1"), ("B", "s1")]
    assert R.study_roster(both, ("B", "A")).first().site == "A"


def test_selection_forms(spark):
    roster = spark.createDataFrame([(f"s{n}", "A") for n in (3, 1, 2)], "subject_id string, site string")

    def ids(selection):
        return sorted(r.subject_id for r in R.select_subjects(roster, selection).collect())

    assert ids(None) == ids(1) == ["s1"]
    assert ids(2) == ["s1", "s2"]
    assert ids("all") == ["s1", "s2", "s3"]
    assert ids("s2") == ["s2"]
    assert ids(["s3", "s3", "s1"]) == ["s1", "s3"]
    with pytest.raises(ValueError, match="s9"):
        R.raise_unknown(R.requested(["s9", "s1"], spark), roster)
    R.raise_unknown(R.requested("s1", spark), roster)


@pytest.mark.parametrize("bad, error", [(0, ValueError), (-1, ValueError), ([1], TypeError), (True, TypeError)])
def test_bad_selections(bad, error):
    with pytest.raises(error):
        R.check_subjects(bad)


def test_study_parameters_are_text():
    with pytest.raises(TypeError):
        StudyProfile(study_id=1, bucket="b")
    assert bids_profile("x", "b").prefix == ""


def test_first_valid_backfills_and_may_fall_short(spark):
    validity = spark.createDataFrame([("a", False), ("b", True), ("c", True)], "subject_id string, valid boolean")
    assert [r.subject_id for r in R.first_valid(validity, 1).collect()] == ["b"]
    assert R.first_valid(validity, 5).count() == 2


def test_subject_without_files_is_invalid(spark):
    roster = spark.createDataFrame([("a", "S"), ("b", "S")], "subject_id string, site string")
    some = files(spark, [("a", r, f"k/{r}") for r in MF.ROLES])
    got = {r.subject_id: r.valid for r in MF.subject_validity(roster, some).collect()}
    assert got == {"a": True, "b": False}


def test_register_has_one_shape_for_any_size(spark):
    rows = [("hot", "dwi", f"k{n:05d}") for n in range(2500)] + [("cold", "dwi", "x"), ("cold", "bval", "y"), ("cold", "bval", "y")]
    got = MF.register(files(spark, rows)).collect()
    hot = sorted((r.position, r.key) for r in got if r.subject_id == "hot")
    assert hot == [(n, f"k{n:05d}") for n in range(2500)]
    assert sorted((r.role, r.position, r.key) for r in got if r.subject_id == "cold") == [("bval", 0, "y"), ("bval", 1, "y"), ("dwi", 0, "x")]


def test_shared_sidecars_are_listed_per_file(spark):
    some = files(spark, [("a", r, f"p/x.{e}") for r, e in (("dwi", "nii.gz"), ("bval", "bval"), ("bvec", "bvec"))])
    keys = spark.createDataFrame([("a", "raw", "p/x.json"), ("a", "deriv", "p/y.json")], "subject_id string, rd string, key string")
    assert MF.sidecars_of(some, keys).count() == 3
    assert MF.sidecars_of(some, keys, distinct=True).count() == 1


@pytest.mark.parametrize("body, name, direction, warning", [
    ({"PhaseEncodingDirection": "j-"}, "x_dir-AP_epi.json", "AP", None),
    ({"PhaseEncodingDirection": "j-"}, "x_dir-PA_epi.json", "AP", "mismatch"),
    ({"PhaseEncodingDirection": "j"}, "x_dir-AP_epi.json", "PA", "mismatch"),
    ({"PhaseEncodingDirection": "j"}, "x_epi.json", "PA", None),
    ({}, "x_dir-PA_epi.json", "PA", "missing_key"),
    ({"PhaseEncodingDirection": None}, "x_dir-AP_epi.json", "AP", "missing_key"),
    ({"PhaseEncodingDirection": "i"}, "x_dir-AP_epi.json", "AP", "unknown_value"),
    ({"PhaseEncodingDirection": "i"}, "x_epi.json", None, "unknown_value"),
    ({}, "x_epi.json", None, "missing_key"),
])
def test_directions(spark, body, name, direction, warning):
    df = spark.createDataFrame([("a", name, json.dumps(body))], "subject_id string, key string, body string")
    row = D.determine_directions(df).first()
    assert (row.direction, row.warning) == (direction, warning)
    assert D.direction_validity(D.determine_directions(df)).first().valid == (direction is not None)


def test_direction_source_is_checked(spark):
    with pytest.raises(ValueError):
        D.check_options("guess")


def session_files(spark, counts):
    rows = [
        (subject, role, f"{subject}{'/' + ses if ses else ''}/{role}{'_run-02' if n else ''}")
        for subject, ses, per_role in counts for role, total in per_role.items() for n in range(total)
    ]
    return S.with_session(files(spark, [(s, r, k.replace(f"/{r}", f"/d/{r}")) for s, r, k in rows]))


def test_sessions_must_agree_and_balance(spark):
    full = dict.fromkeys(S.SESSION_ROLES, 1)
    data = session_files(spark, [
        ("ok", "ses-1", full), ("ok", "ses-2", full),
        ("gap", "ses-1", full), ("gap", "ses-2", {**full, "epi_pa": 0}),
        ("odd", "", {**full, "dwi": 2}), ("pair", "", dict.fromkeys(S.SESSION_ROLES, 2)),
    ])
    counts = S.session_role_counts(data)
    assert {r.subject_id: r.consistent for r in S.session_agreement(counts).collect()} == {"ok": True, "gap": False, "odd": True, "pair": True}
    balanced = {(r.subject_id, r.session): r.balanced for r in S.session_balance(counts).collect()}
    assert balanced["odd", "null"] is False and balanced["pair", "null"] is True and balanced["gap", "ses-2"] is False
    out = S.output_register(data)
    assert {(r.subject_id, r.output_session) for r in out.collect()} == {("ok", "ses-1"), ("ok", "ses-2"), ("gap", "ses-1"), ("pair", "ses-01")}
    assert {r.output_session for r in S.output_register(data, assign_empty=False).filter("subject_id = 'pair'").collect()} == {None}


def test_several_sets_in_one_session(spark):
    data = session_files(spark, [("pair", "", dict.fromkeys(S.SESSION_ROLES, 2)), ("one", "ses-9", dict.fromkeys(S.SESSION_ROLES, 1))])
    split = {(r.subject_id, r.output_session) for r in S.split_multiples(data).collect()}
    assert split == {("pair", "null-01"), ("pair", "null-02"), ("one", "ses-9")}
    joined = {(r.subject_id, r.output_session, r.set_no) for r in S.split_multiples(data, "concatenate").collect()}
    assert joined == {("pair", "null", 1), ("pair", "null", 2), ("one", "ses-9", 1)}
    with pytest.raises(ValueError):
        S.split_multiples(data, "guess")


def test_skip_reasons_name_the_first_problem(spark):
    full = dict.fromkeys(S.SESSION_ROLES, 1)
    data = session_files(spark, [("a", "", full), ("b", "", full), ("c", "", full), ("d", "", {**full, "dwi": 2}), ("e", "", {**full, "dwi": 0}), ("f", "", full)])
    validity = spark.createDataFrame([(s, s != "b") for s in "abcdef"], "subject_id string, valid boolean")
    faced = spark.createDataFrame([(s, s != "c") for s in "abcde"], "subject_id string, valid boolean")
    gaps = spark.createDataFrame([("b",), ("f",), ("f",)], "subject_id string")
    reasons = S.skip_reasons(validity, faced, S.session_role_counts(data), gaps)
    got = {r.subject_id: r.skip_reason for r in reasons.collect()}
    assert got == {"a": None, "b": "missing_files", "c": "no_direction", "d": "no_session", "e": "session_mismatch",
                   "f": "incomplete_fieldmaps"}
    assert {r.subject_id for r in S.eligible(data, reasons).collect()} == {"a"}


def test_anatomy_choices(spark):
    some = files(spark, [("a", "freesurfer", "d2/freesurfer/x"), ("a", "freesurfer", "d1/freesurfer/y"), ("a", "t1w", "q/T1w.nii.gz"), ("a", "t1w", "p/T1w.nii.gz")])
    assert [r.key for r in S.one_freesurfer(some).collect()] == ["d1/freesurfer/y"]
    assert S.first_t1w(some).first().key == "p/T1w.nii.gz"
    assert S.first_t1w(some, first_only=False).count() == 2


def test_site_filter_touches_one_site_only(spark):
    rows = [("a", site, "t1w", f"x/{level}T1w.nii.gz") for site in ("Site-CBIC", "Site-RU") for level in ("", "T1w_VNavNorm/")]
    some = spark.createDataFrame(rows, "subject_id string, site string, role string, key string")
    got = sorted((r.site, r.key) for r in MULTI_SITE.rewrite(MULTI_SITE.key_filter(some), "key").collect())
    assert got == [("Site-CBIC", "x/T1w.nii.gz"), ("Site-RU", "x/T1w.nii.gz"), ("Site-RU", "x/T1w_VNavNorm/T1w.nii.gz")]


def test_transfers_skip_existing_targets(spark):
    wanted = spark.createDataFrame([("k1", "t1"), ("k2", "t2")], "key string, target string")
    there = spark.createDataFrame([("t1",)], "target string")
    assert [r.key for r in L.transfer_manifest(wanted, there).collect()] == ["k2"]
    assert L.transfer_manifest(wanted, there, overwrite=True).count() == 2


def test_manifest_position_of_an_absent_path(spark):
    manifest = spark.createDataFrame([("b", "a"), ("b", "c"), ("b", "c")], "bucket string, key string")
    for path, position in (("a", 0), ("c", 1), ("b", -1)):
        wanted = spark.createDataFrame([("b", path)], "bucket string, path string")
        assert MF.manifest_position(manifest, wanted).first().position == position


def test_group_statistics_skip_nan_and_null(spark):
    qc = spark.createDataFrame([("b", 1.0), ("b", 3.0), ("b", float("nan")), ("b", None), ("c", 5.0)], "bucket string, x double")
    got = {r.bucket: (r.mean_x, r.std_x) for r in G.group_statistics(qc, measures=["x"]).collect()}
    assert got["b"] == (2.0, pytest.approx(2 ** 0.5)) and got["c"] == (5.0, None)
    z = {r.x: r.z_x for r in G.z_scores(qc.filter("bucket = 'c' OR x < 2"), measures=["x"]).collect()}
    assert z == {1.0: None, 5.0: None}


def test_display_of_scores(spark):
    scores = spark.createDataFrame([(-1.0,), (1.0,), (0.0,), (123.456,), (-0.0012345,)], "z_x double")
    shown = {r.z_x: (r.pos_x, r.text_x, r.colour_x) for r in G.with_display(scores, ["x"]).collect()}
    assert shown[-1.0][2] == "success" and shown[1.0][2] == "danger" and shown[0.0] == (50.0, 0.0, "primary")
    assert shown[123.456][1] == 123.0 and shown[-0.0012345][1] == pytest.approx(-0.00123)


def test_long_report_lists_continue_in_parts(spark):
    lines = spark.createDataFrame([(1, n, f"line {n}") for n in range(10)], "subject int, line_no long, line string")
    series = spark.createDataFrame([(1, n, float(n), 0.5) for n in range(5)], "subject int, vol long, rms_abs double, rms_rel double")
    fields = "N int, M int, pix int, num_slices int, img_type string"
    still = spark.createDataFrame([(1, n, 2, 2, 8, 4, "x") for n in RP.STILLS], f"subject int, image string, {fields}")
    moving = spark.createDataFrame([(1, o, 2, 2, 8, 5, "y") for o in ("sag", "ax", "cor")], f"subject int, orientation string, {fields}")
    qc = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.3, 0.4)], "subject int, qc_mot_abs double, qc_mot_rel double")
    dropped = spark.createDataFrame([(1, 3)], "subject int, vol long")
    report = RP.assemble(moving, still, dropped, lines, series, qc, width=4)
    parts = {(r.subject, r.part): r for r in report.collect()}
    assert [len(parts[1, p].eddy_report) for p in range(3)] == [4, 4, 2]
    assert parts[1, 0].outlier_volumes == [3] and parts[1, 0].b0.pix == 8 and parts[1, 0].anat_mask.N == 2
    assert [d.orientation for d in parts[1, 0].dwi_corrected] == ["ax", "cor", "sag"] and parts[1, 1].dwi_corrected is None
    assert parts[1, 1].eddy_params == [[4.0, 0.5]] and parts[1, 2].eddy_quad.qc_mot_abs == 0.1
    assert parts[2, 0].eddy_quad.qc_mot_abs == 0.3 and parts[2, 0].eddy_report == []
    assert {r.subject: r.n_lines for r in RP.outlier_line_count(RP.report_lines(report)).collect()} == {1: 10}
    written = report.select("subject", F.to_json(F.struct(*[c for c in report.columns if c != "subject"])).alias("body"))
    read = LS.reports_with_qc(written, RP.REPORT_SCHEMA).select("subject", "report.*")
    assert sorted(map(str, read.drop("part").collect())) == sorted(map(str, report.drop("part").collect()))
    back = RP.movement_series(read.select("subject", "part", "eddy_params"), width=4)
    assert sorted((r.vol, r.s0) for r in back.collect()) == [(n, float(n)) for n in range(5)]
    body = K.document(report.filter("part = 0 AND subject = 1"), ["subject", "part"]).first().body
    assert json.loads(body)["eddy_quad"] == {"qc_mot_abs": 0.1, "qc_mot_rel": 0.2}


def test_pairs_by_position(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["x", "y"])], "n int, k array<string>, f array<string>")
    assert sorted(map(tuple, MF.zip_pairs(df, "k", "f", ("key", "target")).collect())) == [(1, "a", "x"), (1, "b", "y")]


def test_freesurfer_and_missing_rows(spark):
    subjects = spark.createDataFrame([("a",), ("b",)], "subject_id string")
    keys = spark.createDataFrame([("a", "p/freesurfer/mri/x")], "subject_id string, key string")
    assert [r.subject_id for r in MF.with_freesurfer(subjects, keys).collect()] == ["a"]
    assert [r.subject_id for r in MF.with_freesurfer(subjects, keys, present=False).collect()] == ["b"]
    assert [r.subject_id for r in MF.missing_required(subjects, subjects.filter(F.col("subject_id") == "a")).collect()] == ["b"]


def test_checks_of_one_pass_equal_those_of_parts(spark):
    rnd = random.Random(4)
    rows, notes = [], []
    for s in range(60):
        for ses in rnd.choice([("",), ("ses-1/",), ("ses-1/", "ses-2/")]):
            for role, tail in (("dwi", "dwi/x_dwi.nii.gz"), ("bvec", "dwi/x_dwi.bvec"), ("bval", "dwi/x_dwi.bval"), ("epi_nii", "fmap/x_dir-AP_epi.nii.gz"),
                               ("epi_json", "fmap/x_dir-AP_epi.json"), ("epi_nii", "fmap/x_dir-PA_epi.nii.gz"), ("epi_json", "fmap/x_dir-PA_epi.json"),
                               ("dwi", "dwi/x_run-2_dwi.nii.gz"), ("t1w", "T1w.nii.gz"), ("freesurfer", "freesurfer/a")):
                if rnd.random() < (0.2 if "run-2" in tail else 0.95):
                    key = f"s{s}/{ses}{tail}"
                    rows.append((f"s{s}", role, key))
                    if role == "epi_json":
                        notes.append((f"s{s}", key, rnd.choice(["AP" if "AP" in key else "PA"] * 8 + [None, "AP"])))
    table = files(spark, rows)
    faced = spark.createDataFrame(notes, "subject_id string, key string, direction string")
    roster = spark.createDataFrame([(f"s{s}",) for s in range(62)], "subject_id string")
    validity = MF.subject_validity(roster, table)
    sited = S.with_session(D.relabel_roles(table, faced))
    parts = S.skip_reasons(validity, D.direction_validity(faced), S.session_role_counts(sited), MF.sidecar_completeness(table))
    want = {r.subject_id: r.skip_reason for r in parts.collect()}
    found = {r.subject_id: r.skip_reason for r in S.reasons_of(validity, S.subject_checks(table, faced)).collect()}
    assert found == want and len(set(want.values())) >= 5
