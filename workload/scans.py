"""Queries over outlier reports, gradient tables, motion, group quality, tensors and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dwitable.functions import maths as M
from dwitable.operators import groupqc as G
from dwitable.operators import hemisphere as H
from dwitable.operators import indexing as I
from dwitable.operators import manifest as MF
from dwitable.operators import mosaic as MO
from dwitable.operators import motion as MT
from dwitable.operators import report as RP
from dwitable.operators import tensor as T
from dwitable.operators import volumes as V
from dwitable.operators.profile import MULTI_SITE, StudyProfile
from dwitable.operators.steps import SubjectStep, as_step
from dwitable.plans import study
from dwitable.session import materialise, shared_dir
from dwitable.sinks import text as K
from dwitable.sources import text as TX
from workload.registry import query

# A report's slices are the line numbers 1 to 7; more than a fifth of them may not be outliers.
THRESHOLD = 0.2
DROP_SQL = """slices AS (SELECT subject, max(slice) AS n_slices FROM outliers GROUP BY subject),
per_scan AS (SELECT subject, scan, count(*) AS n_outliers FROM outliers GROUP BY subject, scan),
drops AS (SELECT p.subject, scan AS vol FROM per_scan p JOIN slices s ON p.subject = s.subject WHERE n_outliers > 0.2 * n_slices)"""


def _outliers(t):
    return V.parse_outliers(t.outlier_lines)


def _dropped(t):
    return V.dropped_scans(_outliers(t), THRESHOLD)


def _r(*names: str, digits: int = 6):
    return [F.round(F.col(n), digits).alias(n) for n in names]


# ---------------------------------------------------------------- outlier reports and gradient tables

@query("m1_parse_outliers", "outliers", "SELECT subject, slice, scan, mean_sd, mean_sq_sd FROM outliers")
def m1(t):
    return _outliers(t)


@query("a9_outliers_per_scan", "outliers", "SELECT subject, scan, count(*) AS n_outliers FROM outliers GROUP BY subject, scan")
def a9(t):
    return V.outliers_per_scan(_outliers(t))


@query("a10_dropped_by_share", "outliers", f"+ {DROP_SQL}\nSELECT subject, vol FROM drops")
def a10(t):
    return _dropped(t)


@query("a10_dropped_by_count", "outliers", """
SELECT subject, scan AS vol FROM outliers GROUP BY subject, scan HAVING count(*) > 2""")
def a10_count(t):
    return V.dropped_scans(_outliers(t), 2)


@query("a17_outlier_line_count", "outlier_lines", "SELECT subject, CAST(count(*) AS BIGINT) AS n_lines FROM outlier_lines GROUP BY subject")
def a17(t):
    return RP.outlier_line_count(t.outlier_lines)


KEPT_SQL = """kept AS (
  SELECT v.*, row_number() OVER (PARTITION BY v.subject ORDER BY v.vol) - 1 AS new_vol FROM scan_volumes v
  LEFT JOIN drops d ON v.subject = d.subject AND v.vol = d.vol WHERE d.vol IS NULL)"""


@query("w1_reindexed_volumes", "outliers scan_volumes", f"+ {DROP_SQL}, {KEPT_SQL}\nSELECT subject, vol, new_vol FROM kept")
def w1(t):
    return V.reindexed(t.scan_volumes.select("subject", "vol"), _dropped(t))


@query("j5_drop_gradients", "outliers scan_volumes", f"""+ {DROP_SQL}, {KEPT_SQL}
SELECT subject, new_vol AS vol, bval, round(gx, 6) AS gx, round(gy, 6) AS gy, round(gz, 6) AS gz FROM kept""")
def j5(t):
    return V.drop_gradients(t.scan_volumes, _dropped(t)).select("subject", "vol", "bval", *_r("gx", "gy", "gz"))


@query("flow_thinned_gradients", "outliers scan_volumes", f"""+ {DROP_SQL}, {KEPT_SQL}
SELECT subject, new_vol AS vol, bval, round(gx, 6) AS gx, round(gy, 6) AS gy, round(gz, 6) AS gz FROM kept""")
def thinned(t):
    out = study.thinned_gradients(t.outlier_lines, t.scan_volumes, THRESHOLD)
    return out.select("subject", "vol", "bval", *_r("gx", "gy", "gz"))


@query("j8_annotated_series", "volumes", """
SELECT subject, vol, round(rms_abs, 6) AS rms_abs, round(rms_rel, 6) AS rms_rel, dropped = 1 AS is_outlier FROM volumes""")
def j8(t):
    marked = V.annotate_dropped(t.volumes, t.volumes.filter("dropped = 1"))
    return marked.select("subject", "vol", *_r("rms_abs", "rms_rel"), "is_outlier")


@query("a14_series_domain", "volumes", """
SELECT subject, min(vol) AS x_min, max(vol) AS x_max, round(min(least(rms_abs, rms_rel)), 6) AS y_min,
  round(max(greatest(rms_abs, rms_rel)), 6) AS y_max FROM volumes GROUP BY subject""")
def a14(t):
    return V.series_domain(t.volumes).select("subject", "x_min", "x_max", *_r("y_min", "y_max"))


@query("m2_transformed_vectors", "volumes affines", """
SELECT v.subject, vol, round(gx*a00 + gy*a10 + gz*a20 + a30, 6) AS gx, round(gx*a01 + gy*a11 + gz*a21 + a31, 6) AS gy,
  round(gx*a02 + gy*a12 + gz*a22 + a32, 6) AS gz FROM volumes v JOIN affines a ON v.subject = a.subject""")
def m2(t):
    moved = V.transform_vectors(t.volumes.select("subject", "vol", "gx", "gy", "gz"), t.affines)
    return moved.select("subject", "vol", *_r("gx", "gy", "gz"))


@query("j6_affine_per_subject", "volumes affines", """
SELECT v.subject, vol, bval, round(gx*a00 + gy*a10 + gz*a20 + a30, 6) AS gx, round(gx*a01 + gy*a11 + gz*a21 + a31, 6) AS gy,
  round(gx*a02 + gy*a12 + gz*a22 + a32, 6) AS gz FROM volumes v JOIN affines a ON v.subject = a.subject""")
def j6(t):
    moved = V.transform_vectors(t.volumes.select("subject", "vol", "bval", "gx", "gy", "gz"), t.affines)
    return moved.select("subject", "vol", "bval", *_r("gx", "gy", "gz"))


@query("k3_dropped_scan_lines", "volumes", """
SELECT subject, vol, CAST(vol AS STRING) AS line FROM volumes WHERE dropped = 1""")
def k3(t):
    path = shared_dir(t.spark, "dropped")
    dropped = t.volumes.filter("dropped = 1").select("subject", "vol", K.integer_line("vol").alias("line"))
    K.write_lines(dropped, path, "vol")
    lines = TX.read_written_lines(t.spark, path)
    return lines.select("subject", F.col("line").cast("long").alias("vol"), "line")


@query("k4_motion_lines", "motion_mats", """
+ free AS (SELECT *, power(abs(ry) - pi() / 2, 2) < 1e-9 AS locked FROM motion_mats),
p AS (SELECT subject, vol, CASE WHEN locked THEN 0 ELSE rx END AS r1, ry AS r2,
  CASE WHEN locked THEN atan2(sin(rx + rz), cos(rx + rz)) ELSE atan2(sin(rz), cos(rz)) END AS r3, a03, a13, a23 FROM free)
SELECT subject, vol, 6 AS n, round(r1, 6) + 0.0 AS rx, round(r2, 6) + 0.0 AS ry, round(r3, 6) + 0.0 AS rz,
  round(a03, 6) + 0.0 AS tx, round(a13, 6) + 0.0 AS ty, round(a23, 6) + 0.0 AS tz FROM p""")
def k4(t):
    lines = K.motion_lines(MT.motion_parameters(t.motion_mats.drop("rx", "ry", "rz"))).withColumn("numbers", TX.line_values("line"))
    return lines.select("subject", "vol", F.size("numbers").alias("n"), *[
        (F.get("numbers", F.lit(i)) + 0.0).alias(p) for i, p in enumerate(MT.PARAMETERS)])


@query("k5_matrix_text", "volumes", """
SELECT subject, vol, round(gx, 9) AS gx, round(gy, 9) AS gy, round(gz, 9) AS gz FROM volumes""")
def k5(t):
    width = 16
    lines = K.vector_lines(t.volumes, width=width).withColumnRenamed("axis", "line_no")
    entries = TX.matrix_entries(lines)
    return TX.b_vectors(entries).select("subject", F.col("vol").cast("long").alias("vol"), *_r("gx", "gy", "gz", digits=9))


# ---------------------------------------------------------------- vectors

@query("f12_unit_vectors", "vecs", """+ stretched AS (
  SELECT label, sqrt(x*x + y*y + z*z) * (CASE WHEN m1 > 0.25 THEN 2 ELSE 1 END) AS length FROM vecs)
SELECT label, count(*) FILTER (abs(length - 1) > 1e-8 + 1e-5) AS n_bad FROM stretched GROUP BY label
HAVING count(*) FILTER (abs(length - 1) > 1e-8 + 1e-5) > 0""")
def f12(t):
    factor = F.when(F.col("m1") > 0.25, F.lit(2.0)).otherwise(F.lit(1.0))
    return H.non_unit_groups(t.vecs.withColumns({a: F.col(a) * factor for a in "xyz"}))


@query("m18_cross_products", "volumes", """+ p AS (
  SELECT a.subject, a.vol, a.gy*b.gz - a.gz*b.gy AS cx, a.gz*b.gx - a.gx*b.gz AS cy, a.gx*b.gy - a.gy*b.gx AS cz
  FROM volumes a JOIN volumes b ON a.subject = b.subject AND b.vol = a.vol - 1),
n AS (SELECT *, sqrt(cx*cx + cy*cy + cz*cz) AS norm FROM p)
SELECT subject, vol, round(norm, 6) AS norm, round(cx / nullif(norm, 0), 6) AS ux, round(cy / nullif(norm, 0), 6) AS uy,
  round(cz / nullif(norm, 0), 6) AS uz FROM n""")
def m18(t):
    pairs = I.with_previous(t.volumes, ["subject"], "vol", ("gx", "gy", "gz")).filter("prev_gx IS NOT NULL")
    cross = M.cross3(("gx", "gy", "gz"), ("prev_gx", "prev_gy", "prev_gz"))
    rows = pairs.select("subject", "vol", *[c.alias(n) for n, c in zip(("cx", "cy", "cz"), cross)])
    unit = M.unit3(("cx", "cy", "cz"))
    return rows.select(
        "subject", "vol", F.round(M.norm3(("cx", "cy", "cz")), 6).alias("norm"),
        *[F.round(c, 6).alias(n) for n, c in zip(("ux", "uy", "uz"), unit)],
    )


HEMI_SQL = """pairs AS (
  SELECT a.label, a.vec_id AS ia, b.vec_id AS ib, a.y*b.z - a.z*b.y AS cx, a.z*b.x - a.x*b.z AS cy, a.x*b.y - a.y*b.x AS cz
  FROM vecs a JOIN vecs b ON a.label = b.label AND a.vec_id <> b.vec_id),
cand AS (SELECT label, ia, ib, cx / n AS cx, cy / n AS cy, cz / n AS cz
  FROM (SELECT *, sqrt(cx*cx + cy*cy + cz*cz) AS n FROM pairs) AS q WHERE n > 0),
tested AS (SELECT c.label, ia, ib, any_value(cx) AS cx, any_value(cy) AS cy, any_value(cz) AS cz,
  min(cx*x + cy*y + cz*z) >= -1e-12 AS ok FROM cand c JOIN vecs v ON c.label = v.label GROUP BY c.label, ia, ib),
corner AS (SELECT label, avg(cx) AS px, avg(cy) AS py, avg(cz) AS pz FROM tested WHERE ok GROUP BY label),
hemi AS (SELECT g.label, c.label IS NOT NULL AS is_hemi, coalesce(px / sqrt(px*px + py*py + pz*pz), 0) AS px,
  coalesce(py / sqrt(px*px + py*py + pz*pz), 0) AS py, coalesce(pz / sqrt(px*px + py*py + pz*pz), 0) AS pz
  FROM (SELECT DISTINCT label FROM vecs) g LEFT JOIN corner c ON g.label = c.label)"""


@query("a16_hemisphere", "vecs", f"""+ {HEMI_SQL}
SELECT label, is_hemi, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz FROM hemi""")
def a16(t):
    return H.hemispheres(t.vecs).select("label", "is_hemi", *_r("px", "py", "pz"))


@query("j12_pole_test", "vecs", """+ poles AS (
  SELECT label, avg(x) / sqrt(avg(x)*avg(x) + avg(y)*avg(y) + avg(z)*avg(z)) AS px, avg(y) / sqrt(avg(x)*avg(x) + avg(y)*avg(y) + avg(z)*avg(z)) AS py,
    avg(z) / sqrt(avg(x)*avg(x) + avg(y)*avg(y) + avg(z)*avg(z)) AS pz FROM vecs GROUP BY label)
SELECT v.label, round(min(x*px + y*py + z*pz), 6) AS min_dot, min(x*px + y*py + z*pz) >= -1e-12 AS contains_all
FROM vecs v JOIN poles p ON v.label = p.label GROUP BY v.label""")
def j12(t):
    means = t.vecs.groupBy("label").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    poles = means.select("label", *[c.alias(n) for n, c in zip(("px", "py", "pz"), M.unit3(("mx", "my", "mz")))])
    return H.farthest_from_pole(t.vecs, poles).select("label", *_r("min_dot"), "contains_all")


# ---------------------------------------------------------------- motion

@query("m3_motion_parameters", "motion_mats", """+ free AS (
  SELECT *, power(abs(ry) - pi() / 2, 2) < 1e-9 AS locked FROM motion_mats)
SELECT subject, vol, round(CASE WHEN locked THEN 0 ELSE rx END, 6) AS rx, round(ry, 6) AS ry,
  round(CASE WHEN locked THEN atan2(sin(rx + rz), cos(rx + rz)) ELSE atan2(sin(rz), cos(rz)) END, 6) AS rz,
  round(a03, 6) AS tx, round(a13, 6) AS ty, round(a23, 6) AS tz FROM free""")
def m3(t):
    return MT.motion_parameters(t.motion_mats.drop("rx", "ry", "rz")).select("subject", "vol", *_r(*MT.PARAMETERS))


@query("w4_artifact_flags", "motion_mats volumes", """+ p AS (
  SELECT m.subject, m.vol, rx, ry, rz, a03, a13, a23, rms_abs AS intensity FROM motion_mats m JOIN volumes v ON m.subject = v.subject AND m.vol = v.vol),
d AS (SELECT a.subject, a.vol, coalesce(sqrt(power(a.rx - b.rx, 2) + power(a.ry - b.ry, 2) + power(a.rz - b.rz, 2)
  + power(a.a03 - b.a03, 2) + power(a.a13 - b.a13, 2) + power(a.a23 - b.a23, 2)), 0) AS norm, a.intensity
  FROM p a LEFT JOIN p b ON a.subject = b.subject AND b.vol = a.vol - 1),
s AS (SELECT subject, avg(intensity) AS mean, stddev_samp(intensity) AS sd FROM p GROUP BY subject)
SELECT d.subject, vol, round(norm, 6) AS norm, round((intensity - mean) / nullif(sd, 0), 6) AS z, norm > 3 AS motion_flag,
  coalesce(abs((intensity - mean) / nullif(sd, 0)) > 9, false) AS intensity_flag FROM d JOIN s ON d.subject = s.subject""")
def w4(t):
    parameters = t.motion_mats.select("subject", "vol", "rx", "ry", "rz", F.col("a03").alias("tx"), F.col("a13").alias("ty"), F.col("a23").alias("tz"))
    intensities = t.volumes.select("subject", "vol", F.col("rms_abs").alias("intensity"))
    flags = MT.artifact_flags(parameters, intensities)
    return flags.select("subject", "vol", *_r("norm", "z"), "motion_flag", "intensity_flag")


@query("w4_flags_without_dropped", "motion_mats volumes", """+ p AS (
  SELECT m.subject, m.vol, rx, ry, rz, a03, a13, a23, rms_abs AS intensity FROM motion_mats m JOIN volumes v ON m.subject = v.subject AND m.vol = v.vol
  WHERE v.dropped = 0),
d AS (SELECT subject, vol, intensity, coalesce(sqrt(power(rx - lag(rx) OVER w, 2) + power(ry - lag(ry) OVER w, 2) + power(rz - lag(rz) OVER w, 2)
  + power(a03 - lag(a03) OVER w, 2) + power(a13 - lag(a13) OVER w, 2) + power(a23 - lag(a23) OVER w, 2)), 0) AS norm
  FROM p WINDOW w AS (PARTITION BY subject ORDER BY vol)),
s AS (SELECT subject, avg(intensity) AS mean, stddev_samp(intensity) AS sd FROM p GROUP BY subject)
SELECT d.subject, vol, round(norm, 6) AS norm, round((intensity - mean) / nullif(sd, 0), 6) AS z, norm > 3 AS motion_flag,
  coalesce(abs((intensity - mean) / nullif(sd, 0)) > 9, false) AS intensity_flag FROM d JOIN s ON d.subject = s.subject""")
def w4_gaps(t):
    kept = t.volumes.filter("dropped = 0")
    parameters = t.motion_mats.select("subject", "vol", "rx", "ry", "rz", F.col("a03").alias("tx"), F.col("a13").alias("ty"), F.col("a23").alias("tz"))
    flags = MT.artifact_flags(parameters.join(kept.select("subject", "vol"), ["subject", "vol"], "left_semi"),
                              kept.select("subject", "vol", F.col("rms_abs").alias("intensity")))
    return flags.select("subject", "vol", *_r("norm", "z"), "motion_flag", "intensity_flag")


@query("m15_matrix_product", "affines motion_mats", """+ m AS (
  SELECT mm.subject, vol, a.a00*mm.a00 + a.a01*mm.a10 + a.a02*mm.a20 AS p00, a.a00*mm.a01 + a.a01*mm.a11 + a.a02*mm.a21 AS p01,
    a.a10*mm.a00 + a.a11*mm.a10 + a.a12*mm.a20 AS p10, a.a20*mm.a02 + a.a21*mm.a12 + a.a22*mm.a22 AS p22
  FROM motion_mats mm JOIN affines a ON mm.subject = a.subject)
SELECT subject, vol, round(p00, 6) AS p00, round(p01, 6) AS p01, round(p10, 6) AS p10, round(p22, 6) AS p22 FROM m""")
def m15(t):
    def rows(prefix):
        return F.array(*[F.array(*[F.col(f"{prefix}a{r}{c}") for c in range(3)]) for r in range(3)])

    left = t.affines.select("subject", rows("").alias("a"))
    product = t.motion_mats.select("subject", "vol", rows("").alias("b")).join(left, "subject").select(
        "subject", "vol", M.matmul("a", "b").alias("p")
    )
    return product.select("subject", "vol", *[
        F.round(F.element_at(F.element_at("p", r + 1), c + 1), 6).alias(f"p{r}{c}") for r, c in ((0, 0), (0, 1), (1, 0), (2, 2))
    ])


# ---------------------------------------------------------------- group quality

STATS_SQL = """stats AS (
  SELECT bucket, avg(qc_mot_abs) AS ma, stddev_samp(qc_mot_abs) AS sa, avg(qc_mot_rel) AS mr, stddev_samp(qc_mot_rel) AS sr
  FROM qc GROUP BY bucket),
z AS (SELECT q.bucket, subject, (qc_mot_abs - ma) / nullif(sa, 0) AS za, (qc_mot_rel - mr) / nullif(sr, 0) AS zr
  FROM qc q JOIN stats s ON q.bucket = s.bucket)"""


@query("a12_group_mean", "qc", """
SELECT bucket, round(avg(qc_mot_abs), 5) AS mean_qc_mot_abs, round(avg(qc_mot_rel), 5) AS mean_qc_mot_rel FROM qc GROUP BY bucket""")
def a12(t):
    return G.group_statistics(t.qc).select("bucket", *_r("mean_qc_mot_abs", "mean_qc_mot_rel", digits=5))


@query("a13_group_deviation", "qc", """
SELECT bucket, round(stddev_samp(qc_mot_abs), 6) AS std_qc_mot_abs, round(stddev_samp(qc_mot_rel), 6) AS std_qc_mot_rel FROM qc GROUP BY bucket""")
def a13(t):
    return G.group_statistics(t.qc).select("bucket", *_r("std_qc_mot_abs", "std_qc_mot_rel"))


@query("w3_z_scores", "qc", f"+ {STATS_SQL}\nSELECT bucket, subject, round(za, 6) AS z_qc_mot_abs, round(zr, 6) AS z_qc_mot_rel FROM z")
def w3(t):
    return G.z_scores(t.qc).select("bucket", "subject", *_r("z_qc_mot_abs", "z_qc_mot_rel"))


@query("j10_against_group", "qc", f"""+ {STATS_SQL}
SELECT q.bucket, subject, round((qc_mot_abs - ma) / nullif(sa, 0), 6) AS z FROM qc q JOIN stats s ON s.bucket =
  CASE q.bucket WHEN 'bucket-a' THEN 'bucket-b' WHEN 'bucket-b' THEN 'bucket-c' ELSE 'bucket-a' END""")
def j10(t):
    names = {"bucket-a": "bucket-b", "bucket-b": "bucket-c", "bucket-c": "bucket-a"}
    other = F.col("bucket")
    for own, group in names.items():
        other = F.when(F.col("bucket") == own, F.lit(group)).otherwise(other)
    group = G.group_statistics(t.qc, measures=["qc_mot_abs"]).withColumnRenamed("bucket", "against")
    scored = G.against_group(t.qc.withColumn("against", other), group, ["against"], ["qc_mot_abs"])
    return scored.select("bucket", "subject", F.round("z_qc_mot_abs", 6).alias("z"))


@query("f11_z_colour", "qc", f"""+ {STATS_SQL}
SELECT bucket, subject, CASE WHEN za <= -1 THEN 'success' WHEN za >= 1 THEN 'danger' ELSE 'primary' END AS low_is_good,
  CASE WHEN za <= -1 THEN 'danger' WHEN za >= 1 THEN 'success' ELSE 'primary' END AS high_is_good FROM z""")
def f11(t):
    z = G.z_scores(t.qc)
    return z.select(
        "bucket", "subject", M.z_colour("z_qc_mot_abs", False).alias("low_is_good"),
        M.z_colour("z_qc_mot_abs", True).alias("high_is_good"),
    )


@query("m16_scale_position", "qc", f"+ {STATS_SQL}\nSELECT bucket, subject, round((za + 3) / 6 * 100, 6) AS position FROM z")
def m16(t):
    return G.z_scores(t.qc).select("bucket", "subject", F.round(M.scale_z("z_qc_mot_abs"), 6).alias("position"))


@query("m17_significant_digits", "qc", f"""+ {STATS_SQL}
SELECT bucket, subject, round(CASE WHEN za = 0 THEN 0 ELSE round(za * power(10.0, 2 - floor(log10(abs(za))))) / power(10.0, 2 - floor(log10(abs(za)))) END, 9) AS number
FROM z""")
def m17(t):
    return G.z_scores(t.qc).select("bucket", "subject", F.round(M.significant("z_qc_mot_abs"), 9).alias("number"))


@query("flow_group_quality", "report_json", f"""+ r AS (
  SELECT bucket, subject, CAST(json_extract_string(body, '$.eddy_quad.qc_mot_abs') AS DOUBLE) AS qa,
    CAST(json_extract_string(body, '$.eddy_quad.qc_mot_rel') AS DOUBLE) AS qr FROM report_json
  WHERE json_extract_string(body, '$.eddy_quad') IS NOT NULL),
s AS (SELECT bucket, avg(qa) AS ma, stddev_samp(qa) AS sa, avg(qr) AS mr, stddev_samp(qr) AS sr FROM r GROUP BY bucket)
SELECT r.bucket, 'sub-' || CAST(subject AS STRING) AS subject, round((qa - ma) / nullif(sa, 0), 6) AS z_qc_mot_abs,
  round((qr - mr) / nullif(sr, 0), 6) AS z_qc_mot_rel FROM r JOIN s ON r.bucket = s.bucket""")
def group_quality(t):
    key = F.concat(F.lit("sub-"), F.col("subject").cast("string"), F.lit("/out/report/dwi_report.json"))
    bodies = t.report_json.select("bucket", key.alias("key"), "body")
    xml = F.concat(F.lit("<ListBucketResult><Contents><Key>"), "key", F.lit("</Key></Contents></ListBucketResult>"))
    scored = study.group_quality(bodies.select("bucket", xml.alias("xml")), bodies, RP.REPORT_SCHEMA)
    return scored.select("bucket", "subject", *_r("z_qc_mot_abs", "z_qc_mot_rel"))


# ---------------------------------------------------------------- tensors

TRUTH_SQL = "known AS (SELECT DISTINCT subject, voxel, dxx, dyy, dzz, dxy, dxz, dyz FROM dti_signal)"
EIGEN_SQL = f"""{TRUTH_SQL},
e0 AS (SELECT *, (dxx + dyy + dzz) / 3 AS q FROM known),
e1 AS (SELECT *, sqrt((power(dxx - q, 2) + power(dyy - q, 2) + power(dzz - q, 2) + 2 * (dxy*dxy + dxz*dxz + dyz*dyz)) / 6) AS p FROM e0),
e2 AS (SELECT *, acos(greatest(-1, least(1, ((dxx - q) * ((dyy - q) * (dzz - q) - dyz*dyz) - dxy * (dxy * (dzz - q) - dyz*dxz)
  + dxz * (dxy*dyz - (dyy - q) * dxz)) / (2 * p*p*p)))) / 3 AS phi FROM e1),
e3 AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM e2),
eig AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM e3),
sc AS (SELECT *, sqrt((power(l1 - l2, 2) + power(l2 - l3, 2) + power(l3 - l1, 2)) / (2 * (l1*l1 + l2*l2 + l3*l3))) AS fa FROM eig)"""


def _fit(t):
    return T.fit_tensor(t.dti_signal, t.volumes)


@query("a18_tensor_fit", "dti_signal", f"""+ {TRUTH_SQL}
SELECT subject, voxel, {", ".join(f"round({d} * 1e6, 3) AS {d}" for d in T.ENTRIES)}, round(ln(1000.0), 6) AS ln_s0 FROM known""")
def a18(t):
    return _fit(t).select(
        "subject", "voxel", *[(F.round(F.col(d) * 1e6, 3) + 0.0).alias(d) for d in T.ENTRIES], F.round("ln_s0", 6).alias("ln_s0")
    )


@query("a18_array_fit", "dti_signal", f"""+ {TRUTH_SQL}
SELECT subject, voxel, {", ".join(f"round({d} * 1e6, 3) AS {d}" for d in T.ENTRIES)}, round(ln(1000.0), 6) AS ln_s0 FROM known""")
def a18_arrays(t):
    by_volume = F.map_from_entries(F.collect_list(F.struct("vol", "signal")))
    length = t.volumes.agg(F.max("vol").alias("last"))
    voxels = t.dti_signal.groupBy("subject", "voxel").agg(by_volume.alias("m")).join(F.broadcast(length)).select(
        "subject", "voxel", F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda v: F.element_at("m", v)).alias("signal"))
    fitted = T.fit_arrays(materialise(voxels, "voxels"), t.volumes)
    return fitted.select(
        "subject", "voxel", *[(F.round(F.col(d) * 1e6, 3) + 0.0).alias(d) for d in T.ENTRIES], F.round("ln_s0", 6).alias("ln_s0")
    )


@query("m4_scaled_tensor", "dti_signal", f"""+ {TRUTH_SQL}
SELECT subject, voxel, {", ".join(f"round({d} * 1000, 6) AS {d}" for d in T.ENTRIES)} FROM known""")
def m4(t):
    return T.scaled(_fit(t)).select("subject", "voxel", *[(F.round(d, 6) + 0.0).alias(d) for d in T.ENTRIES])


@query("m6_tensor_scalars", "dti_signal", f"""+ {EIGEN_SQL}
SELECT subject, voxel, round(l1 * 1e6, 3) AS e1, round(l2 * 1e6, 3) AS e2, round(l3 * 1e6, 3) AS e3, round(fa, 6) AS fa,
  round(q * 1e6, 3) AS md, round(l1 * 1e6, 3) AS ad, round((l2 + l3) / 2 * 1e6, 3) AS rd FROM sc""")
def m6(t):
    s = T.tensor_scalars(_fit(t))
    return s.select(
        "subject", "voxel", *[F.round(F.col(c) * 1e6, 3).alias(c) for c in ("e1", "e2", "e3")], F.round("fa", 6).alias("fa"),
        *[F.round(F.col(c) * 1e6, 3).alias(c) for c in ("md", "ad", "rd")],
    )


@query("m6_colour_fa", "dti_signal", f"""+ {EIGEN_SQL},
v AS (SELECT *, dxy * dyz - dxz * (dyy - l1) AS vx, dxz * dxy - (dxx - l1) * dyz AS vy, (dxx - l1) * (dyy - l1) - dxy * dxy AS vz FROM sc)
SELECT subject, voxel, round(abs(vx) / sqrt(vx*vx + vy*vy + vz*vz) * fa, 5) AS r, round(abs(vy) / sqrt(vx*vx + vy*vy + vz*vz) * fa, 5) AS g,
  round(abs(vz) / sqrt(vx*vx + vy*vy + vz*vz) * fa, 5) AS b FROM v""")
def m6_colour(t):
    return T.colour_fa(T.tensor_scalars(_fit(t))).select("subject", "voxel", *_r("r", "g", "b", digits=5))


def _participant(t):
    """The flow over the tensor fixture: an image of known tensors, with three outlier slices in each volume to drop."""
    voxel = F.col("voxel").cast("int")
    image = t.dti_signal.select("subject", F.col("vol").alias("t"), (voxel % 10).alias("i"), F.floor(voxel / 10).cast("int").alias("j"),
                                F.lit(0).alias("k"), F.col("signal").alias("value"))
    bad = t.volumes.filter("dropped = 1").select("subject", "vol", F.explode(F.array(*[F.lit(s) for s in range(3)])).alias("s"))
    lines = bad.select("subject", (F.col("vol") * 3 + F.col("s")).alias("line_no"), F.format_string(
        "Slice %d in scan %d is an outlier with mean -4.5 standard deviations off, and mean squared 7.5 standard deviations off.",
        "s", "vol").alias("line"))
    # a quarter turn that the affine takes back
    turned = t.volumes.select("subject", "vol", "bval", F.col("gy").alias("gx"), (-F.col("gx")).alias("gy"), "gz")
    entries = {f"a{r}{c}": float(v) for r, row in enumerate(((0, 1, 0, 5), (-1, 0, 0, 6), (0, 0, 1, 7), (0, 0, 0, 1))) for c, v in enumerate(row)}
    affines = t.volumes.select("subject").distinct().select("subject", *[F.lit(v).alias(n) for n, v in entries.items()])
    series = t.volumes.select("subject", "vol", "rms_abs", "rms_rel")
    return study.participant(lines, image, turned, affines, series, t.qc.drop("bucket"), 2)


@query("flow_participant", "dti_signal", f"""+ {EIGEN_SQL},
v AS (SELECT *, dxy * dyz - dxz * (dyy - l1) AS vx, dxz * dxy - (dxx - l1) * dyz AS vy, (dxx - l1) * (dyy - l1) - dxy * dxy AS vz FROM sc)
SELECT subject, CAST(voxel % 10 AS INT) AS i, CAST(floor(voxel / 10) AS INT) AS j, round(q * 1e6, 3) AS md, round(fa, 6) AS fa,
  round(q * 1e6, 3) AS md_thinned, round(fa, 6) AS fa_thinned, round(abs(vx) / sqrt(vx*vx + vy*vy + vz*vz) * fa, 5) AS r,
  round(dxx * 1000, 6) AS dxx_scaled FROM v""")
def flow_participant(t):
    made = _participant(t)
    key = ["subject", F.col("voxel.i").alias("i"), F.col("voxel.j").alias("j")]
    whole = made.scalars.select(*key, F.round(F.col("md") * 1e6, 3).alias("md"), F.round("fa", 6).alias("fa"))
    thin = made.thinned_scalars.select(*key, F.round(F.col("md") * 1e6, 3).alias("md_thinned"), F.round("fa", 6).alias("fa_thinned"), F.round("r", 5).alias("r"))
    tensors = made.tensors.select(*key, F.round("dxx", 6).alias("dxx_scaled"))
    return whole.join(thin, ["subject", "i", "j"]).join(tensors, ["subject", "i", "j"])


@query("flow_participant_report", "volumes qc dti_signal", """+ per AS (
  SELECT subject, count(*) FILTER (dropped = 1) AS n_dropped, count(*) AS n_params FROM volumes GROUP BY subject),
image AS (SELECT subject, CAST(max(voxel % 10) + 1 AS INT) AS ni, CAST(max(floor(voxel / 10)) + 1 AS INT) AS nj FROM dti_signal GROUP BY subject)
SELECT coalesce(p.subject, q.subject) AS subject, coalesce(n_dropped, 0) AS n_dropped, 3 * coalesce(n_dropped, 0) AS n_lines,
  coalesce(n_params, 0) AS n_params, round(qc_mot_abs, 6) AS qc_mot_abs, greatest(ni, nj) AS pix
FROM per p FULL OUTER JOIN qc q ON p.subject = q.subject LEFT JOIN image i ON i.subject = p.subject""")
def flow_participant_report(t):
    return _participant(t).report.select(
        "subject", F.size("outlier_volumes").cast("long").alias("n_dropped"), F.size("eddy_report").cast("long").alias("n_lines"),
        F.size("eddy_params").cast("long").alias("n_params"), F.round("eddy_quad.qc_mot_abs", 6).alias("qc_mot_abs"), F.col("b0.pix").alias("pix"))


# ---------------------------------------------------------------- reports

@query("m20_middle_slice", "report_json", """
SELECT bucket, subject, CAST(floor(CAST(json_extract_string(body, '$.b0.num_slices') AS INT) / 2) AS INT) AS middle FROM report_json""")
def m20(t):
    parsed = t.report_json.select("bucket", "subject", F.from_json("body", RP.REPORT_SCHEMA).alias("r"))
    return parsed.select("bucket", "subject", RP.middle_slice("r.b0.num_slices").alias("middle"))


@query("m21_movement_series", "report_json", """+ e AS (
  SELECT subject, CAST(json_extract(body, '$.eddy_params') AS DOUBLE[][]) AS p FROM report_json)
SELECT subject, CAST(vol AS INT) AS vol, s[1] AS s0, s[2] AS s1 FROM (
  SELECT subject, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS vol FROM e) AS x""")
def m21(t):
    parsed = t.report_json.select("subject", F.from_json("body", RP.REPORT_SCHEMA).getField("eddy_params").alias("eddy_params"))
    return RP.movement_series(parsed)


@query("m21_highlighted_point", "report_json", """+ e AS (
  SELECT subject, CAST(json_extract(body, '$.eddy_params') AS DOUBLE[][]) AS p FROM report_json)
SELECT subject, CAST(1 AS INT) AS vol, p[2][1] AS s0, p[2][2] AS s1 FROM e WHERE len(p) >= 2""")
def m21_point(t):
    parsed = t.report_json.select("subject", F.from_json("body", RP.REPORT_SCHEMA).getField("eddy_params").alias("eddy_params"))
    return RP.highlighted(RP.movement_series(parsed), 1)


@query("a17_manifest_size", "report_json", "SELECT bucket, count(*) AS n_entries FROM report_json GROUP BY bucket")
def a17_manifest(t):
    return RP.manifest_size(t.report_json)


def _report(t, width: int = I.BLOCK):
    lines = t.volumes.filter("dropped = 1").select("subject", F.col("vol").alias("line_no"), K.integer_line("vol").alias("line"))
    dims = materialise(t.dims, "dims")
    series = t.volumes.select("subject", "vol", "rms_abs", "rms_rel")
    qc = t.qc.drop("bucket")
    dropped = t.volumes.filter("dropped = 1").select("subject", "vol")
    return RP.assemble(MO.series_layouts(dims), MO.still_layouts(dims), dropped, lines, series, qc, width)


REPORT_SQL = """v AS (SELECT subject, count(*) FILTER (dropped = 1) AS n_dropped, string_agg(CAST(vol AS STRING), ',' ORDER BY vol) FILTER (dropped = 1) AS dropped,
  count(*) AS n_params, round(max(rms_abs) FILTER (vol = 0), 6) AS first_abs FROM volumes GROUP BY subject),
r AS (SELECT coalesce(v.subject, q.subject, d.subject) AS subject, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped,
  coalesce(n_params, 0) AS n_params, first_abs, round(qc_mot_rel, 6) AS qc_mot_rel, greatest(ni, nj) AS pix, nk AS num_slices,
  greatest(ni, nj) AS pix_colour, nk AS n_mask, CASE WHEN ni IS NOT NULL THEN 3 END AS n_moving, greatest(nj, nk) AS pix_ax, nt - 1 AS n_ax
  FROM v FULL OUTER JOIN qc q ON v.subject = q.subject FULL OUTER JOIN dims d ON d.subject = coalesce(v.subject, q.subject))"""


@query("n3_report", "volumes qc dims", f"+ {REPORT_SQL}\nSELECT * FROM r")
def n3(t):
    return _report(t).select(
        "subject", F.size("outlier_volumes").cast("long").alias("n_dropped"), F.array_join("eddy_report", ",").alias("dropped"),
        F.size("eddy_params").cast("long").alias("n_params"), F.round(F.get(F.get("eddy_params", F.lit(0)), F.lit(0)), 6).alias("first_abs"),
        F.round("eddy_quad.qc_mot_rel", 6).alias("qc_mot_rel"), F.col("b0.pix").alias("pix"), F.col("b0.num_slices").alias("num_slices"),
        F.col("colorFA.pix").alias("pix_colour"), F.col("anat_mask.num_slices").alias("n_mask"),
        F.nullif(F.size("dwi_corrected"), F.lit(-1)).alias("n_moving"),
        F.get("dwi_corrected", F.lit(0)).getField("pix").alias("pix_ax"), F.get("dwi_corrected", F.lit(0)).getField("num_slices").alias("n_ax"),
    )


@query("k6_report_json", "volumes qc dims", f"+ {REPORT_SQL}\nSELECT subject, n_dropped, n_params, qc_mot_rel FROM r")
def k6(t):
    path = shared_dir(t.spark, "reports")
    K.write_json(_report(t, width=16), path)  # several parts a report
    read = t.spark.read.schema(f"subject long, {RP.REPORT_SCHEMA}").json(path)
    return read.groupBy("subject").agg(
        F.sum(F.size("outlier_volumes")).cast("long").alias("n_dropped"), F.sum(F.size("eddy_params")).cast("long").alias("n_params"),
        F.first(F.when(F.col("part") == 0, F.round("eddy_quad.qc_mot_rel", 6)), ignorenulls=True).alias("qc_mot_rel"),
    )


@query("n3_report_series", "volumes", """
SELECT subject, CAST(vol AS INT) AS vol, round(rms_abs, 6) AS s0, round(rms_rel, 6) AS s1 FROM volumes""")
def n3_series(t):
    path = shared_dir(t.spark, "reports")
    K.write_json(_report(t, width=16), path)
    read = t.spark.read.schema(f"subject long, {RP.REPORT_SCHEMA}").json(path)
    return RP.movement_series(read.select("subject", "part", "eddy_params"), width=16).select("subject", "vol", *_r("s0", "s1"))


# ---------------------------------------------------------------- profiles and user steps

@query("x1_study_profile", "roster files", """+ both_lists AS (
  SELECT site, participant_id AS subject_id FROM roster WHERE rd = 'raw' INTERSECT SELECT site, participant_id FROM roster WHERE rd = 'deriv'),
study AS (SELECT subject_id, max(site) AS site FROM both_lists GROUP BY subject_id)
SELECT f.subject_id, f.role, CASE WHEN f.site = 'Site-CBIC' THEN replace(f.key, 'T1w_VNavNorm/', '') ELSE f.key END AS path
FROM files f JOIN study s ON f.subject_id = s.subject_id AND f.site = s.site
WHERE NOT (f.site = 'Site-CBIC' AND f.role IN ('t1w', 'freesurfer')) OR contains(f.key, 'T1w_VNavNorm')""")
def x1(t):
    who = MULTI_SITE.subjects(t.roster)
    files = MULTI_SITE.key_filter(MF.classify(t.object_keys)).join(who, ["subject_id", "site"], "left_semi")
    return MULTI_SITE.rewrite(files.withColumn("path", F.col("key")), "path").select("subject_id", "role", "path")


@query("x2_user_step", "outliers scan_volumes", """+ drops AS (
  SELECT subject, scan AS vol FROM outliers WHERE slice <> 1 AND mean_sd < -5 GROUP BY subject, scan HAVING count(*) > 1),
kept AS (SELECT v.subject, bval, row_number() OVER (PARTITION BY v.subject ORDER BY v.vol) - 1 AS vol FROM scan_volumes v
  LEFT JOIN drops d ON v.subject = d.subject AND v.vol = d.vol WHERE d.vol IS NULL)
SELECT subject, vol, bval FROM kept WHERE bval > 0""")
def x2(t):
    mine = StudyProfile("mine", "bucket", steps={"outliers": (lambda df: df.filter("slice <> 1"), lambda df: df.filter("mean_sd < -5")),
                                                "gradients": (lambda df: df.filter("bval > 0"),)})
    thinned = study.thinned_gradients(t.outlier_lines, t.scan_volumes, 1, profile=mine)
    return thinned.select("subject", "vol", "bval")


class Steps(SubjectStep):
    """Each volume with the change of its b-value from the one before, and at the end how many volumes there were."""

    def __init__(self):
        self.last, self.seen, self.subject = None, 0, None

    @staticmethod
    def schema(given):
        return StructType([given["subject"], given["vol"], given["bval"], StructField("change", LongType()), StructField("seen", LongType())])

    def row(self, row):
        self.seen, self.subject = self.seen + 1, row["subject"]
        yield row["subject"], row["vol"], row["bval"], None if self.last is None else row["bval"] - self.last, None
        self.last = row["bval"]

    def end(self):
        yield self.subject, None, None, None, self.seen


@query("x2_table_function", "scan_volumes", """
SELECT subject, vol, bval, CAST(bval - lag(bval) OVER (PARTITION BY subject ORDER BY vol) AS BIGINT) AS change, CAST(NULL AS BIGINT) AS seen
FROM scan_volumes WHERE bval > 0
UNION ALL SELECT subject, NULL, NULL, NULL, count(*) FROM scan_volumes WHERE bval > 0 GROUP BY subject""")
def x2_table_function(t):
    mine = StudyProfile("mine", "bucket", steps={"gradients": (lambda df: df.filter("bval > 0"), as_step(Steps, ["vol"]))})
    return mine.own_steps("gradients", t.scan_volumes)


@query("flow_acquire", "roster sited", """+ both_lists AS (
  SELECT site, participant_id AS subject_id FROM roster WHERE rd = 'raw' INTERSECT SELECT site, participant_id FROM roster WHERE rd = 'deriv'),
study AS (SELECT subject_id, max(site) AS site FROM both_lists GROUP BY subject_id),
own AS (SELECT f.* FROM files f JOIN study s ON f.subject_id = s.subject_id AND f.site = s.site),
valid AS (SELECT s.subject_id FROM study s JOIN own o ON s.subject_id = o.subject_id GROUP BY s.subject_id HAVING count(DISTINCT role) = 7),
kept AS (SELECT * FROM own WHERE NOT (site = 'Site-CBIC' AND role IN ('t1w', 'freesurfer')) OR contains(key, 'T1w_VNavNorm')),
img AS (SELECT subject_id, replace(key, '.nii.gz', '.json') AS key FROM kept WHERE role = 'epi_nii'),
js AS (SELECT subject_id, key FROM kept WHERE role = 'epi_json'),
gaps AS (SELECT coalesce(img.subject_id, js.subject_id) AS subject_id FROM img FULL OUTER JOIN js ON img.key = js.key WHERE img.key IS NULL OR js.key IS NULL),
faces AS (SELECT subject_id FROM directed GROUP BY subject_id HAVING bool_and(direction IS NOT NULL)),
moved AS (SELECT k.subject_id, role, key FROM kept k WHERE role NOT IN ('epi_nii', 'epi_json')
  UNION ALL SELECT s.subject_id, role, key FROM sited s WHERE role IN ('epi_ap', 'epi_pa')),
per_session AS (SELECT subject_id, coalesce(nullif(regexp_extract(key, '/(ses-[0-9a-zA-Z]*)/', 1), ''), 'null') AS session,
  count(*) FILTER (role = 'dwi') AS a, count(*) FILTER (role = 'bvec') AS b, count(*) FILTER (role = 'bval') AS c,
  count(*) FILTER (role = 'epi_ap') AS d, count(*) FILTER (role = 'epi_pa') AS e
  FROM moved WHERE role IN ('dwi', 'bvec', 'bval', 'epi_ap', 'epi_pa') GROUP BY ALL),
fit AS (SELECT subject_id FROM per_session GROUP BY subject_id HAVING bool_and(least(a, b, c, d, e) > 0) AND bool_or(least(a, b, c, d, e) = greatest(a, b, c, d, e))),
go AS (SELECT v.subject_id FROM valid v WHERE v.subject_id IN (SELECT subject_id FROM faces) AND v.subject_id IN (SELECT subject_id FROM fit)
  AND v.subject_id NOT IN (SELECT subject_id FROM gaps)),
notes AS (SELECT DISTINCT o.subject_id, 'json' AS role, o.key FROM object_keys o JOIN (
    SELECT subject_id, regexp_extract(key, '^([^.]*)', 1) || '.json' AS key FROM kept WHERE role IN ('dwi', 'bvec', 'bval', 'epi_nii')) w
  ON o.subject_id = w.subject_id AND o.key = w.key),
everything AS (SELECT * FROM moved UNION ALL SELECT * FROM notes)
SELECT e.subject_id, s.site, e.role, e.key, '/tmp/study/' || CASE WHEN s.site = 'Site-CBIC'
  THEN replace(string_split(e.key, '/' || s.site || '/')[-1], 'T1w_VNavNorm/', '') ELSE string_split(e.key, '/' || s.site || '/')[-1] END AS target
FROM everything e JOIN study s ON e.subject_id = s.subject_id WHERE e.subject_id IN (SELECT subject_id FROM go)""")
def acquire(t):
    nothing = t.object_keys.select(F.lit("").alias("target")).filter("false")
    return study.acquire(MULTI_SITE, t.roster, t.object_keys.select("key"), t.sidecars, nothing, "/tmp/study")
